"""Quality of documents from their own evidence and that of their site, by hierarchical empirical Bayes.

A logistic regression over text statistics, fitted on labelled documents, gives each document a probability of
being good. Grouped sums of these (a labelled document counts with its label) give every host and every path of
a host a posterior rate:

    host = (sum over the host + a * global rate) / (rows of the host + a)
    path = (sum over the path + b * host) / (rows of the path + b)

a and b are the strengths of the priors, estimated from the data: the variance within groups over the variance of the
groups' rates that it does not explain. Sparse sites so stay near the global rate, sites without rows on it. A
document's quality is its own log-odds plus what its path's log-odds add to the global ones, with what the document
itself gave to its site's sums left out, be it its evidence or its label, so its evidence counts once and its label never.

Scale: texts pass through one function in place; what is shuffled are sums per (host, path) and, without the texts, ids
with their labels. `score` looks up each row's label at the end, so columns that its caller does not drop move once. `keep`
moves the texts of those rows alone whose fate hangs on their own label; the bounds of all labels decide the others, however
many labels there are. The fit reads at most `TRAIN_ROWS` labelled documents, those with the smallest hash of the id; the sums cover all.

Defined cases: null texts and texts without a word have evidence 0 and quality 0; a null host or path is one of its own;
without labels of both kinds every text has the rate of the labels as evidence (1 without any); of several labels of a document the
lowest counts; equal rows each count in the sums; labels without a document are ignored. Input columns are kept; the
added ones are `evidence`, `host_rate`, `path_rate` and `quality`, and `score` replaces input columns of these names; `keep`
returns the input's columns alone, whatever their names.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladetally.llm.batches import bounded
from cladetally.llm.columns import put_back, set_apart
from cladetally.session import materialize

TRAIN_ROWS = 20_000
FEATURES = ("log_words", "word_length", "distinct", "capitals", "digits", "signs", "stops", "line_words", "repeats", "top_word", "single", "pair_repeats", "exclaims", "bars")
STRONGEST, WEAKEST = 1e6, 1.0
MARGIN = 1e-9
ADDED = ("evidence", "host_rate", "path_rate", "quality")


def text_features(text: str | None) -> list[float] | None:
    """Statistics of a whole text; None if it has no word."""
    words = text.split() if text else []
    if not words:
        return None
    n, chars = len(words), len(text)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    follow = sum(1 for a, b in zip(words, words[1:]) if a == b)
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    upper = np.count_nonzero((codes >= 65) & (codes <= 90))
    digits = np.count_nonzero((codes >= 48) & (codes <= 57))
    letters = np.count_nonzero(((codes >= 97) & (codes <= 122)) | (codes >= 192)) + upper
    spaces = np.count_nonzero((codes <= 32))
    ends = np.count_nonzero((codes == 46) | (codes == 63))
    exclaims = np.count_nonzero(codes == 33)
    bars = np.count_nonzero((codes == 124) | (codes == 62) | (codes == 60))
    pairs = len(set(zip(words, words[1:])))
    return [float(np.log1p(n)), min((chars - spaces) / n, 30.0), len(counts) / n, upper / chars, digits / chars,
            (chars - letters - digits - spaces) / chars, ends / n, min(n / len(lines), 100.0), follow / n,
            max(counts.values()) / n, sum(1 for c in counts.values() if c == 1) / n, 1 - pairs / max(n - 1, 1) if n > 1 else 0.0,
            exclaims / n, bars / n]


@dataclass
class Classifier:
    mean: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, texts) -> np.ndarray:
        found = [text_features(t) for t in texts]
        if self.constant is not None:
            return np.array([0.0 if f is None else self.constant for f in found])
        x = np.array([self.mean if f is None else f for f in found], dtype=float).reshape(len(found), -1)
        # Summed row by row, so that a text's evidence does not depend on its batch.
        z = ((x - self.mean) * self.weights).sum(axis=1) + self.bias
        return np.where([f is None for f in found], 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def unique_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .groupBy("doc_id").agg(F.min(label).cast("double").alias("__label")))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on `unique_labels` of documents with text; the sample is `max_rows` at most, by hash of the id."""
    chosen = materialize(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def rows(batches):
        for batch in batches:
            found = [(text_features(t), y) for t, y in zip(batch["text"], batch["__label"])]
            yield pd.DataFrame([f for f in found if f[0] is not None], columns=["x", "label"])

    data = materialize(bounded(docs).join(chosen, "doc_id").select("text", "__label").mapInPandas(rows, "x array<double>, label double"))
    sides = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sides) < 2:
        return Classifier(np.zeros(len(FEATURES)), np.zeros(len(FEATURES)), 0.0, constant=float(next(iter(sides), 1.0)))
    mean = np.array(data.select(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(FEATURES))]).first())
    centred = data.select(array_to_vector(F.zip_with("x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)).alias("features"), "label")
    fitted = LogisticRegression(regParam=1e-4, maxIter=60).fit(centred)
    return Classifier(mean, fitted.coefficients.toArray(), float(fitted.intercept))


def with_evidence(docs: DataFrame, model: Classifier) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.array))

    return bounded(docs).withColumn("evidence", evidence("text"))


def _strength(groups: DataFrame, n: str, total: str, squares: Column) -> float:
    """Rows that the prior of a level is worth: one row reaches the driver."""
    row = groups.agg(F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(total).alias("s"), F.sum(squares).alias("q"),
                     F.sum(F.col(total) * F.col(total) / F.col(n)).alias("b"), F.sum(F.col(n).cast("double") * F.col(n)).alias("nn")).first()
    if not row["n"] or row["g"] < 2 or row["n"] <= row["g"]:
        return STRONGEST
    within = max((row["q"] - row["b"]) / (row["n"] - row["g"]), 1e-9)
    spread = row["b"] - row["s"] ** 2 / row["n"] - (row["g"] - 1) * within
    size = row["n"] - row["nn"] / row["n"]
    return float(min(max(within / max(spread / size, 1e-12), WEAKEST), STRONGEST)) if size > 0 else STRONGEST


def site_rates(evidence: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Sums per host and path, each with its host's sums; the global rate and the strengths of the two priors.

    `evidence` has columns host, path and value."""
    paths = materialize(evidence.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")))
    hosts = materialize(paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("q").alias("host_q")))
    row = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_s").alias("s")).first()
    prior = {"rate": float(row["s"] / row["n"]) if row["n"] else 1.0,
             "a": _strength(hosts, "host_n", "host_s", F.col("host_q")), "b": _strength(paths, "n", "s", F.col("q"))}
    joined = paths.join(hosts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    return materialize(joined.select("host", "path", "n", "s", "host_n", "host_s")), prior


def log_odds(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(bounded / (1 - bounded))


def _posterior(prior: dict[str, float], given: Column) -> tuple[Column, Column, Column]:
    """Host rate, path rate and quality of a row that gave `given` to its site's sums. Quality falls as `given` grows."""
    left = lambda total, n: (F.greatest(F.col(total) - given, F.lit(0.0)), F.greatest(F.col(n) - 1, F.lit(0)))
    host_s, host_n = left("__host_s", "__host_n")
    path_s, path_n = left("__s", "__n")
    host_rate = F.least((host_s + prior["a"] * prior["rate"]) / (host_n + prior["a"]), F.lit(1.0))
    path_rate = F.least((path_s + prior["b"] * host_rate) / (path_n + prior["b"]), F.lit(1.0))
    quality = 1 / (1 + F.exp(-(log_odds(F.col("evidence")) + log_odds(path_rate) - log_odds(F.lit(prior["rate"])))))
    return host_rate, path_rate, F.when(F.col("evidence") > 0, quality).otherwise(F.lit(0.0))


def _with_site(rows: DataFrame, sites: DataFrame, host: str, path: str) -> DataFrame:
    renamed = sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"),
                           *[F.col(c).alias(f"__{c}") for c in ("n", "s", "host_n", "host_s")])
    return rows.join(renamed, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")), "left")


def _with_label(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(known.withColumnRenamed("doc_id", "__labelled"), F.col("doc_id") == F.col("__labelled"), "left")


def _values(seen: DataFrame, known: DataFrame) -> DataFrame:
    return seen.join(known, "doc_id", "left").withColumn("value", F.coalesce("__label", "evidence"))


def _slim(rows: DataFrame, host: str, path: str) -> DataFrame:
    return rows.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "evidence")


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality",
          max_rows: int = TRAIN_ROWS) -> DataFrame:
    """`docs` with evidence, the posterior rates of host and path without the document, and quality."""
    plain, names = set_apart(docs, {"doc_id", "text", host, path})
    known = materialize(unique_labels(labels, label))
    model = train(plain.select("doc_id", "text"), known, max_rows)
    seen = materialize(_slim(with_evidence(plain, model), host, path))
    sites, prior = site_rates(_values(seen, known))
    rows = _with_site(_with_label(with_evidence(plain, model), known), sites, host, path)
    host_rate, path_rate, quality = _posterior(prior, F.coalesce("__label", "evidence"))
    scored = (rows.withColumn("__host_rate", host_rate).withColumn("__path_rate", path_rate).withColumn("__quality", quality)
              .withColumns({c: F.col(f"__{c}") for c in ADDED[1:]}))
    return put_back(scored, names, ADDED)


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5, host: str = "source", path: str = "lang", label: str = "quality",
         max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of `docs` whose quality is at least `least`."""
    plain, names = set_apart(docs, {"doc_id", "text", host, path})
    known = materialize(unique_labels(labels, label))
    model = train(plain.select("doc_id", "text"), known, max_rows)
    # Judged anew for the sums and for either kind of row: that costs less than storing all texts.
    judged = with_evidence(plain, model)
    sites, prior = site_rates(_values(materialize(_slim(judged, host, path)), known))
    low, high = known.agg(F.min("__label"), F.max("__label")).first()
    rows = _with_site(judged, sites, host, path)
    quality = lambda given: _posterior(prior, given)[2]
    bound = lambda value: F.lit(value).cast("double")
    stays = quality(F.greatest(F.col("evidence"), bound(high))) >= least + MARGIN
    may_stay = quality(F.least(F.col("evidence"), bound(low))) >= least - MARGIN
    looked_up = _with_label(rows.where(~stays & may_stay), known).where(quality(F.coalesce("__label", "evidence")) >= least)
    return put_back(rows.where(stays).select(*names).unionAll(looked_up.select(*names)), names)
