"""Where the query modules register a Spark query and, if SQL can state it, its counterpart."""

from checks.shapes import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return fn

    return add
