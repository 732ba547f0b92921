"""Session and checkpoint helpers."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "cladetally", cores: str = "8", partitions: int = 8, **conf) -> SparkSession:
    """Session for tests and the bench. Clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in `spark.checkpoint.dir`.

    A folder of its own is set only for local masters that name none.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="cladetally-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise into the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches; one that is not there is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class _Scope:
    """Tables stored since a block began, and how many blocks still use each."""

    stack: list["_Scope"] = []
    uses: dict[str, int] = {}

    def __init__(self):
        self.paths: list[str] = []

    def use(self, path: str) -> None:
        self.paths.append(path)
        _Scope.uses[path] = _Scope.uses.get(path, 0) + 1

    def end(self, spark: SparkSession) -> None:
        for path in self.paths:
            _Scope.uses[path] -= 1
            if not _Scope.uses[path]:
                del _Scope.uses[path]
                remove(spark, path)


@contextmanager
def stored_tables(spark: SparkSession):
    """Tables that operators store inside the block go when it ends, also when it fails.

    Frames that read them must have been written or collected by then; `keep` hands the tables of a frame to the
    enclosing block. Without a block stored tables stay until the folder is cleared.
    """
    scope = _Scope()
    _Scope.stack.append(scope)
    try:
        yield
    finally:
        _Scope.stack.remove(scope)
        scope.end(spark)


def keep(df: DataFrame) -> DataFrame:
    """`df`, its stored tables used by the block around the innermost one as well, or kept for good if there is none."""
    if not _Scope.stack:
        return df
    read = df.inputFiles()
    for path in dict.fromkeys(_Scope.stack[-1].paths):
        # Folders are named by numbers of their own; stores spell the rest in several ways.
        if any(f"/{path.rsplit('/', 1)[-1]}/" in file for file in read):
            if len(_Scope.stack) > 1:
                _Scope.stack[-2].use(path)
            else:
                _Scope.uses[path] += 1
    return df


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write a table that is read several times to the shared folder and read it back.

    The file sizes give the optimizer a true size, so it broadcasts only what is small. A write that fails
    leaves nothing behind; see `stored_tables` for the end of a table's life.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    try:
        df.write.options(**options).parquet(path)
    except Exception:
        remove(spark, path)
        raise
    if _Scope.stack:
        _Scope.stack[-1].use(path)
    return spark.read.schema(df.schema).parquet(path)
