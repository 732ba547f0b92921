"""Language identification with a bit-sliced Bloom filter over character n-grams.

Training keeps, for every language, the n-grams that a share of its training documents hold, and sets bits in
one filter whose every position stores a bitmask of languages. A lookup ANDs the masks at the positions of an
n-gram and so returns all languages that contain it at once. A text's n-grams are counted per language by
popcount over these masks; the chance hits that a language's filling lets through are taken off, and the
language with most remaining n-grams wins.

n-grams are taken from lower-cased letters and the marks that combine with them; any run of other characters, and either end of the text, is one
space. Lengths are 1 to 4. An n-gram counts once for each place it is found at, so every letter of the whole text takes part.

Memory: the filter has at least `positions` words of 64 bits for each 64 languages, and at least POSITIONS_A_MEMBER
for each n-gram of the language that keeps most, a power of two. The n-grams of a language are those
found in at least `min_share` of its training documents and at least RELATIVE_SHARE of the share that any
language has, which keeps out passages in another language, `most` with the largest shares; the driver gets no more. Training reads at most `per_language` documents of each language, those with the smallest hash of the text;
prediction reads all.

Defined cases: null, empty and letterless texts get `und` with score 0; without any training rows all texts do;
ties go to the language with more training documents, then to the smaller name; repeated rows are rows of
their own; a null id is never held out (see `held_out`).
"""

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladetally.llm.batches import bounded
from cladetally.session import materialize

GRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 2000
MIN_SHARE = 0.01
RELATIVE_SHARE = 0.25
POSITIONS = 1 << 20
POSITIONS_A_MEMBER = 5
MOST_GRAMS = 400_000
HASHES = 3
UNKNOWN = "und"
SLICE_CHARS = 1 << 18

_KINDS = None


def _kinds() -> np.ndarray:
    """2 for code points that are letters, 1 for marks that combine with them, 0 for all others."""
    global _KINDS
    if _KINDS is None:
        kind = {"L": 2, "M": 1}
        _KINDS = np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), dtype=np.int8, count=0x110000)
    return _KINDS


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, any run of others than letters and their marks as one space, a space at both
    ends; nothing but that of a text without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds = _kinds()[codes]
    codes = np.where((kinds > 0) & (kinds.max(initial=0) == 2), codes, np.uint32(32))
    codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
    space = codes == 32
    return codes[~(space & np.concatenate([[False], space[:-1]]))]


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the n-grams of one length; n-grams are packed 21 bits a letter, longer ones folded."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    wide = codes.astype(np.uint64)
    h = np.full(n, size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(size):
        h = (h ^ wide[i:i + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    return h


def all_hashes(text: str) -> np.ndarray:
    codes = letter_codes(text)
    grams = [gram_hashes(codes, size) for size in GRAMS]
    # The space alone says nothing.
    grams[0] = grams[0][codes != 32]
    return np.concatenate(grams)


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray        # positions x words of 64 languages
    chance: np.ndarray       # per language, how often a foreign n-gram passes
    hashes: int

    @classmethod
    def build(cls, languages: list[str], members: dict[str, np.ndarray], positions: int = POSITIONS, hashes: int = HASHES):
        words = max(1, -(-len(languages) // 64))
        most = POSITIONS_A_MEMBER * max((len(members[language]) for language in languages), default=0)
        positions = max(positions, 1 << max(most - 1, 0).bit_length())
        masks = np.zeros((positions, words), dtype=np.uint64)
        filled = np.zeros(len(languages))
        for i, language in enumerate(languages):
            at = np.unique(cls.places(members[language], positions, hashes))
            masks[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
            filled[i] = len(at) / positions
        return cls(languages, masks, filled ** hashes, hashes)

    @staticmethod
    def places(h: np.ndarray, positions: int, hashes: int) -> np.ndarray:
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(low + np.uint64(i) * high) % np.uint64(positions) for i in range(hashes)])

    def languages_of(self, h: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram."""
        return np.bitwise_and.reduce(self.masks[self.places(h, len(self.masks), self.hashes).astype(np.int64)], axis=0)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """n-grams of the text found in each language, and all n-grams. Long texts go through in slices."""
        found, total = np.zeros(len(self.languages)), 0
        for at in range(0, max(len(text), 1), SLICE_CHARS):
            h = all_hashes(text[at:at + SLICE_CHARS])
            total += len(h)
            masks = self.languages_of(h)
            for i in range(len(self.languages)):
                found[i] += np.count_nonzero(masks[:, i // 64] & (np.uint64(1) << np.uint64(i % 64)))
        return found, total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        found, total = self.counts(text)
        if not total:
            return UNKNOWN, 0.0
        # A foreign n-gram passes with the probability that all its positions are filled.
        true = np.clip((found - total * self.chance) / (1.0 - np.minimum(self.chance, 0.999)), 0.0, None)
        best = int(np.argmax(true))
        return self.languages[best], float(min(1.0, true[best] / total))


def held_out(doc_id) -> Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, min_share: float = MIN_SHARE,
          positions: int = POSITIONS, hashes: int = HASHES, most: int = MOST_GRAMS) -> Filter:
    """Fit on columns text and lang. The driver gets the frequent n-grams' hashes, `most` for a language, and one row per language."""
    plain = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    # Hashes first, so that choosing the documents moves no text.
    key = F.xxhash64("text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = materialize(plain.select("lang", key.alias("key")).distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank"))
    sample = plain.withColumn("key", key).join(chosen, ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])

    def grams(batches):
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                seen: set = set()
                for at in range(0, max(len(text), 1), SLICE_CHARS):
                    seen.update(np.unique(all_hashes(text[at:at + SLICE_CHARS])).view(np.int64).tolist())
                yield pd.DataFrame({"lang": lang, "gram": np.fromiter(seen, dtype=np.int64, count=len(seen))})

    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes, key=lambda lang: (-sizes[lang], lang))
    counts = bounded(sample).select("lang", "text").mapInPandas(grams, "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("n"))
    if not languages:
        return Filter.build([], {}, positions, hashes)
    trained = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(sizes[lang]))])
    shares = counts.withColumn("share", F.col("n") / F.element_at(trained, F.col("lang")))
    # One row per language and n-gram, so a window holds as many rows as there are languages.
    shares = shares.withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    frequent = shares.where(F.col("share") >= F.greatest(F.lit(min_share), RELATIVE_SHARE * F.col("most")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("share"), "gram"))
    frequent = frequent.withColumn("place", place).where(F.col("place") <= most).select("lang", "gram").toPandas()
    members = {lang: frequent.loc[frequent["lang"] == lang, "gram"].to_numpy(dtype=np.int64).view(np.uint64) for lang in languages}
    return Filter.build(languages, members, positions, hashes)


def predict(docs: DataFrame, model: Filter, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs`, then lang_pred and score from the text alone. `keep` are columns of numbers or
    flags without nulls, or strings."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def rows(batches):
        filter_ = shared.value
        for batch in batches:
            pairs = [filter_.predict(t) for t in batch["__text"]]
            out = batch[keep].copy()
            out["lang_pred"] = [p[0] for p in pairs]
            out["score"] = [p[1] for p in pairs]
            yield out

    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "lang_pred string, score double"])
    return bounded(docs).select(*keep, F.col("text").alias("__text")).mapInPandas(rows, schema)


def identify(docs: DataFrame, **fit) -> DataFrame:
    """Train on the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    flagged = docs.select(F.col("doc_id").cast("string").alias("doc"), "text", "lang", held_out("doc_id").alias("held_out"))
    model = train(flagged.where(~F.col("held_out")), **fit)
    found = predict(flagged.select("doc", "held_out", "text"), model, ["doc", "held_out"])
    return found.select(F.col("doc").cast("long").alias("doc_id"), "held_out", "lang_pred", "score")
