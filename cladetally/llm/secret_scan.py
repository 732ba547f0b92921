"""Secret scans with a random forest that removes false positives.

`find` lists candidates: values assigned to a name that holds one of `NAMES` as a word (`DB_PASSWORD=...`,
`"api_key": "..."`), passwords of `user:password@host`, published key formats, and other runs of at least `MIN_LENGTH`
characters that keys are made of, with a digit. A random forest scores each candidate by

* its length and the shares of digits, capitals and signs in it,
* its character transitions: changes of character class, and the mean log-odds of its letter pairs against the
  pairs of ordinary words,
* dictionary coverage: the share of its letters that known words cover,
* its path: the smoothed rate of secrets among the labelled findings of the same path,
* its neighbouring words: the smoothed rate of secrets among the labelled findings after the same word, and before
  the same word.

The forest is trained by Spark on labelled findings and handed to the tasks that scan as arrays. Of all different
findings of either label, those with the smallest hash are taken, at most `TRAIN_ROWS` / 2, and both labels weigh the
same in the fit: a score of 1/2 means the same however rare secrets are and however large the corpus is. Words and
letter pairs are counted in all texts; the `DICTIONARY_WORDS` most frequent words are the known ones. All texts are
labelled, counted and scanned whole, in a pass each and without a shuffle of texts.

Labelled findings are a table of (path, text, start, length, is_secret). `label_by_rule` makes one where no reviewed
findings exist: published key formats, passwords in URLs and values with a digit assigned to the names of credentials
count as secrets, the other candidates as false positives.

Defined cases: null and empty texts have no candidates; a null path is a path of its own; without labelled findings,
or with findings of one kind only, the score is the smoothed rate of secrets in them (1/2 without any); equal rows are scanned
one by one; other columns are ignored by `scan` and kept by `redact`.
"""

import hashlib
import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladetally.llm.batches import bounded
from cladetally.session import materialize

MIN_LENGTH = 16
TRAIN_ROWS = 20_000
DICTIONARY_WORDS = 20_000
TREES, DEPTH = 20, 6

# Key formats that their issuers publish, and names that credentials are assigned to.
FORMATS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"sk_live_[A-Za-z0-9]{24,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[0-9A-Za-z_-]{35}",
)
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential")

_FORMAT = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(FORMATS)})(?![A-Za-z0-9])")
# A name that something is assigned to, quoted or not. Possessive, and only from a name's start: linear in the text.
_ASSIGNED = re.compile(r"(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]++)[\"']?[ \t]{0,3}[=:]=?>?[ \t]{0,3}[\"']?")
# One of NAMES as a word of a name: `DB_PASSWORD_2`, `authToken`, `tokens`, but not `author` or `tokenizer`.
_NAME = re.compile(rf"(?i:{'|'.join(re.sub('[_-]', '[_.-]?', n) for n in NAMES)})(?:(?i:s)?(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))")
_VALUE = re.compile(r"[^\s\"']{6,}")
_ADDRESS = re.compile(
    r"(?P<scheme>://)[^\s:/@\"'<>]*+:(?P<value>[^\s/@\"'<>]++)@"
    r"|(?<![A-Za-z0-9._%+-])(?!(?i:mailto|e-?mail):)[A-Za-z0-9._%+-]++:(?P<bare>[^\s/@\"'<>]{6,128}+)@[A-Za-z0-9]")
# `=` is part of a run only as padding at its end.
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?")
URL, ADDRESS = "url", "user"
_WORD = re.compile(r"[^\W\d_]{3,}")
FEATURES = ("length", "digits", "capitals", "signs", "changes", "pairs", "coverage", "path_rate", "before_rate", "after_rate")


def _named(text: str):
    """Values assigned to names, then passwords of addresses."""
    end = 0
    for m in _ASSIGNED.finditer(text):
        if m.end() >= end and _NAME.search(m["name"]) and (value := _VALUE.match(text, m.end())):
            end = value.end()
            yield value.start(), end, m["name"].lower().strip(".-")
    if "@" in text:
        for m in _ADDRESS.finditer(text):
            kind = "value" if m["scheme"] else "bare"
            yield m.start(kind), m.end(kind), URL if m["scheme"] else ADDRESS


def _free(spans: list, start: int, end: int):
    """Stretches of [start, end) that no span of the sorted list covers."""
    for a, b, *_ in spans[max(bisect_right(spans, (start,)) - 1, 0):]:
        if a >= end:
            break
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def find(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, name it is assigned to or None) of the candidates of a text, in order, none within another.

    A password of an address has the name `URL`, or `ADDRESS` where no scheme precedes it."""
    spans, end = [], 0
    # Of overlapping ones that which starts first stays, and of those the longest.
    for span in sorted(_named(text), key=lambda s: (s[0], -s[1])):
        if span[0] >= end:
            spans.append(span)
            end = span[1]
    formats = [(a, b, None) for m in _FORMAT.finditer(text) for a, b in _free(spans, *m.span()) if (a, b) == m.span()]
    spans = sorted(spans + formats)
    runs = [(a, b, None) for m in _RUN.finditer(text) for a, b in _free(spans, *m.span())
            if b - a >= MIN_LENGTH and any(c.isdigit() for c in text[a:b])]
    return sorted(spans + runs)


def neighbours(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after, lower-cased, without signs. Each is looked for in 48 characters."""
    before = re.findall(r"[^\W\d_]+", text[max(0, start - 48):start])
    after = re.findall(r"[^\W\d_]+", text[end:end + 48])
    return (before[-1].lower() if before else "", after[0].lower() if after else "")


def rule_label(text: str, start: int, end: int, name: str | None) -> bool:
    value = text[start:end]
    return name == URL or _FORMAT.search(value) is not None or (name is not None and any(c.isdigit() for c in value))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@dataclass
class Words:
    """Ordinary words and the log-odds of their letter pairs."""

    known: frozenset = frozenset()
    pairs: dict = field(default_factory=dict)
    floor: float = 0.0

    @classmethod
    def of(cls, counts: dict[str, int]):
        pairs: dict = {}
        for word, n in counts.items():
            for pair in zip(word, word[1:]):
                pairs[pair] = pairs.get(pair, 0) + n
        total = sum(pairs.values())
        base = math.log(1 / 676)
        odds = {p: math.log((n + 1) / (total + 676)) - base for p, n in pairs.items()}
        return cls(frozenset(counts), odds, (math.log(1 / (total + 676)) - base) if total else 0.0)

    def coverage(self, value: str) -> float:
        """Share of the letters that known words cover, longest words first from the left."""
        letters = re.sub(r"[\W\d_]", " ", value.lower())
        covered = total = 0
        for part in letters.split():
            total += len(part)
            at = 0
            while at < len(part):
                for size in range(min(len(part) - at, 20), 2, -1):
                    if part[at:at + size] in self.known:
                        covered += size
                        at += size
                        break
                else:
                    at += 1
        return covered / total if total else 0.0


@dataclass
class Model:
    words: Words
    path_rates: dict
    before_rates: dict
    after_rates: dict
    base: float
    trees: list  # of (feature, threshold, left, right, secret share) arrays

    def features(self, path, text: str, start: int, end: int) -> list[float]:
        value = text[start:end]
        n = len(value)
        kinds = [_class(c) for c in value]
        lowered = value.lower()
        pairs = [self.words.pairs.get(p, self.words.floor) for p in zip(lowered, lowered[1:])]
        before, after = neighbours(text, start, end)
        return [float(n), kinds.count(2) / n, kinds.count(1) / n, kinds.count(3) / n,
                sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1), sum(pairs) / max(len(pairs), 1),
                self.words.coverage(value), self.path_rates.get(path, self.base),
                self.before_rates.get(before, self.base), self.after_rates.get(after, self.base)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.base)
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(low, left[node], right[node]), node)
            total += share[node]
        return total / len(self.trees)


FINDING = "path string, text string, start int, length int, is_secret boolean"
COLUMNS = ("path", "text", "start", "length", "is_secret")


def label_by_rule(docs: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """Labelled findings of all documents, with context enough to compute features: of each label the `max_rows` / 2
    different ones with the smallest hash. `docs` has columns path and text."""
    def rows(batches):
        # A task keeps its own smallest hashes: they hold all of its rows that can be among the smallest of all tasks.
        kept, bound = {True: {}, False: {}}, {}
        for batch in batches:
            for path, text in zip(batch["path"].array, batch["text"].array):
                for start, end, name in find(text):
                    at = max(0, start - 64)
                    label = rule_label(text, start, end, name)
                    row = (path, text[at:end + 64], start - at, end - start, label)
                    key = hashlib.blake2b(repr(row).encode("utf-8", "replace"), digest_size=8).hexdigest()
                    if key >= bound.get(label, "g"):
                        continue
                    kept[label][key] = row
                    if len(kept[label]) >= 2 * (max_rows // 2) + 2:
                        kept[label] = dict(sorted(kept[label].items())[:max_rows // 2])
                        bound[label] = max(kept[label], default="")
        for found in kept.values():
            yield pd.DataFrame([(key, *row) for key, row in sorted(found.items())[:max_rows // 2]], columns=["key", *COLUMNS])

    plain = docs.where(F.col("text").isNotNull()).select(F.col("path").cast("string").alias("path"), "text")
    found = materialize(bounded(plain).mapInPandas(rows, f"key string, {FINDING}"))
    return _of_both_labels(found, "key", max_rows)


def _of_both_labels(found: DataFrame, key: str, rows: int) -> DataFrame:
    """Of each label the `rows` / 2 different findings with the smallest key, in its order."""
    different = found.dropDuplicates([key, *COLUMNS])
    return _smallest(different.where("is_secret"), key, rows // 2).unionByName(_smallest(different.where("not is_secret"), key, rows // 2))


def _smallest(found: DataFrame, key: str, rows: int) -> DataFrame:
    return found.orderBy(key, *COLUMNS).limit(rows).select(*COLUMNS)


def _word_counts(docs: DataFrame, words: int) -> dict[str, int]:
    """The most frequent words of all texts and how often they stand there; words that stand once are none."""
    found = docs.select(F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}{3,20}', 0)")).alias("w"))
    top = found.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(words)
    return {r["w"]: r["n"] for r in top.collect()}


def _rates(values: list, labels: np.ndarray, base: float, weight: float = 4.0, least: int = 3) -> dict:
    """Smoothed rate of secrets by value; rare values keep the base rate."""
    table = pd.DataFrame({"v": pd.Series(values, dtype=object), "y": labels.astype(float)}).groupby("v", dropna=False)["y"].agg(["sum", "count"])
    table = table[table["count"] >= least]
    return {(None if v is None or v != v else v): (s + weight * base) / (n + weight) for v, s, n in zip(table.index, table["sum"], table["count"])}


def train(labelled: DataFrame, docs: DataFrame, max_rows: int = TRAIN_ROWS, seed: int = 7) -> Model:
    """Fit on labelled findings, up to `max_rows` / 2 different ones of each label; `docs` (path, text) gives the ordinary
    words. The driver holds `max_rows` findings."""
    spark = docs.sparkSession
    words = Words.of(_word_counts(docs, DICTIONARY_WORDS))
    plain = labelled.where("text is not null and length > 0 and is_secret is not null").select(*COLUMNS)
    found = _of_both_labels(plain.withColumn("__key", F.xxhash64(*COLUMNS)), "__key", max_rows).toPandas()
    labels = found["is_secret"].to_numpy(dtype=bool)
    base = (labels.sum() + 1.0) / (len(labels) + 2.0)
    if len(set(labels.tolist())) < 2:
        return Model(words, {}, {}, {}, float(base), [])
    spans = list(zip(found["path"], found["text"], found["start"], found["start"] + found["length"]))
    around = [neighbours(t, s, e) for _, t, s, e in spans]
    model = Model(words, _rates([p for p, *_ in spans], labels, base), _rates([b for b, _ in around], labels, base),
                  _rates([a for _, a in around], labels, base), float(base), [])
    # Both labels have the weight of the more frequent one.
    weight = {y: max(labels.sum(), (~labels).sum()) / (labels == y).sum() for y in (True, False)}
    rows = [([float(v) for v in model.features(p, t, int(s), int(e))], float(y), float(weight[y]))
            for (p, t, s, e), y in zip(spans, labels.tolist())]
    data = spark.createDataFrame(rows, "x array<double>, label double, weight double").select(
        array_to_vector("x").alias("features"), "label", "weight")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt", weightCol="weight").fit(data)
    model.trees = [_arrays(t._java_obj.rootNode()) for t in forest.trees]
    return model


def _arrays(root) -> tuple:
    """A tree of Spark's forest as arrays; feature -1 marks a leaf."""
    feature, threshold, left, right, share = [], [], [], [], []

    def add(node) -> int:
        at = len(feature)
        leaf = node.subtreeDepth() == 0
        stats = node.impurityStats().stats()
        shares = [float(v) for v in stats]
        feature.append(-1 if leaf else node.split().featureIndex())
        threshold.append(0.0 if leaf else node.split().threshold())
        left.append(0)
        right.append(0)
        share.append(shares[1] / max(sum(shares), 1e-12))
        if not leaf:
            left[at] = add(node.leftChild())
            right[at] = add(node.rightChild())
        return at

    add(root)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share)


def _scored(model: Model, path, text: str) -> list[tuple[int, int, str | None, float]]:
    spans = find(text)
    if not spans:
        return []
    scores = model.score(np.array([model.features(path, text, s, e) for s, e, _ in spans]))
    return [(s, e, name, float(p)) for (s, e, name), p in zip(spans, scores)]


def scan(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, start, length, the name it is assigned to, score, is_secret. `docs` has columns
    doc_id, path and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            found = [(doc_id, s, e - s, name, p, p >= threshold)
                     for doc_id, path, text in zip(batch["doc_id"].array, batch["path"].array, batch["text"].array)
                     for s, e, name, p in _scored(shared.value, path, text)]
            yield pd.DataFrame(found, columns=["doc_id", "start", "length", "name", "score", "is_secret"])

    out = bounded(docs).where(F.col("text").isNotNull()).select(F.col("doc_id").cast("string"), F.col("path").cast("string"), "text").mapInPandas(
        rows, "doc_id string, start long, length long, name string, score double, is_secret boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def redact(docs: DataFrame, model: Model, path: str = "source", threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in `text` replaced by `mark`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for text, place in zip(texts.array, paths.array):
            if text:
                for start, end, _, p in reversed(_scored(shared.value, place, text)):
                    if p >= threshold:
                        text = text[:start] + mark + text[end:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return bounded(docs).withColumn("text", clean("text", F.col(path).cast("string")))
