"""The registered queries of the training-data operators, and SQL where it can state them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladetally.llm import (
    language, license_scan, mixing, order_minhash, packing, periodic_runs, preferences, secret_scan, sentence_spans, set_join, site_quality,
    token_alignment, vectors,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_order_minhash")
def op1(spark, folder):
    """Fingerprints of all documents and of their edited texts."""
    return order_minhash.with_edited(table(spark, folder, "documents"))


@query("op2_secret_scan")
def op2(spark, folder):
    """All candidates in all documents with their score."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("path"), "text")
    model = secret_scan.train(secret_scan.label_by_rule(docs), docs)
    return secret_scan.scan(docs, model)


# Sentences, and words: of scripts without blanks each character.
ENDS, CLOSING, GAP, UNSPACED = "。！？｡।॥؟۔", r"""\"''”’»)\]」』""", r" \t\n\r\x0B\x0C", r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
SENTENCE_SQL = (rf"(?:\.\p{{L}}\.|[.!?]+[^.!?{ENDS}{CLOSING}{GAP}]|[^.!?\n{ENDS}]+)+(?:(?:[.!?]+|[{ENDS}]+)[{CLOSING}]*[{GAP}]*|\n[{GAP}]*)?"
                rf"|(?:[.!?]+|[{ENDS}]+)[{CLOSING}]*[{GAP}]*|\n[{GAP}]*")


@query("op3_sentence_spans", r"""
WITH d AS (SELECT doc_id, text FROM documents),
u AS (SELECT DISTINCT doc_id, text FROM d WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, regexp_extract_all(text, '@SENTENCE@') s FROM u),
b AS (SELECT *, list_transform(s, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) k FROM l),
w AS (SELECT *, list_transform(k, lambda x: len(regexp_extract_all(x, '[@UNSPACED@]|[^\x20\x09-\x0D@UNSPACED@]+'))) w FROM b),
c AS (SELECT *, list_transform(range(0, len(w) + 1), lambda i: coalesce(list_sum(w[1:i]), 0)) c FROM w),
e AS (SELECT doc_id, text, k, unnest(list_distinct(list_filter(
   list_transform(range(1, len(k) + 1), lambda i: {'i': i, 'e': list_filter(range(i + 2, len(k) + 1), lambda e: c[e + 1] - c[i] >= 12)[1]})
   || list_transform(range(1, len(k) + 1), lambda e: {'i': list_filter(range(1, e - 1), lambda i: c[e + 1] - c[i] >= 12)[-1], 'e': e}),
   lambda r: r.i IS NOT NULL AND r.e IS NOT NULL))) r FROM c),
r AS (SELECT doc_id, text, r.i pos, r.e e, array_to_string(k[r.i:r.e], chr(10)) k FROM e),
f AS (SELECT k, min((doc_id, text, pos)) first FROM r GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT r.doc_id, r.text, unnest(range(r.pos, r.e + 1)) pos FROM r JOIN f USING (k) WHERE (r.doc_id, r.text, r.pos) <> f.first),
o AS (SELECT doc_id, text, list(pos) gone FROM g GROUP BY 1, 2)
SELECT d.doc_id, CASE WHEN o.gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(1, len(l.s) + 1), lambda i: NOT list_contains(o.gone, i)), lambda i: l.s[i]), '') END AS text,
       coalesce(len(l.s), 0) AS n_sentences, coalesce(len(o.gone), 0) AS n_removed
FROM d LEFT JOIN l ON d.doc_id = l.doc_id AND d.text = l.text LEFT JOIN o ON d.doc_id = o.doc_id AND d.text = o.text
""".replace("@SENTENCE@", SENTENCE_SQL).replace("@UNSPACED@", UNSPACED))
def op3(spark, folder):
    """All documents without the sentences of repeated runs."""
    return sentence_spans.remove_repeated(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_set_join", r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') words FROM documents),
s AS (SELECT id, doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
             WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END h FROM w),
e AS (SELECT id, len(h) n, unnest(h) t FROM s),
p AS (SELECT a.id a, b.id b FROM e a JOIN e b ON a.t = b.t AND a.id < b.id
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT id, id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.h) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT r.a, min(d.doc_id) component_id FROM r JOIN s d ON r.b = d.id GROUP BY r.a) c ON s.id = c.a
""")
def op4(spark, folder):
    """Component of every document under a Jaccard similarity of 0.8 of five-word shingles."""
    found = set_join.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op5_vector_packing")
def op5(spark, folder):
    """All documents as pieces of at most 1,024 ids, packed."""
    pieces = packing.tokenize_pieces(table(spark, folder, "documents"), ranks_path())
    return packing.pack(pieces)


@query("op6_block_join")
def op6(spark, folder):
    """The 20 nearest of all vectors for every vector whose id is divisible by 20."""
    rows = vectors.usable(table(spark, folder, "embeddings"))
    return vectors.nearest(rows, rows.where("vec_id % 20 = 0"))


@query("op7_source_mixing")
def op7(spark, folder):
    """Words that the mix takes of every document."""
    return mixing.taken_words(table(spark, folder, "documents"))


@query("op8_site_quality")
def op8(spark, folder):
    """Quality of all documents; a site's host is the source, its path the language section."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    scored = site_quality.score(docs, table(spark, folder, "labels"))
    return scored.drop("text").withColumn("keep", F.col("quality") >= 0.5)


@query("op9_language_filters")
def op9(spark, folder):
    """Language of all documents."""
    return language.identify(table(spark, folder, "documents"))


@query("op10_preference_pairs", r"""
WITH t AS (SELECT conv_id, turn, role, text, conv_id >> 1 couple, conv_id & 1 side FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, couple, side,
             list({'role': role, 'text': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) turns FROM t GROUP BY 1, 2, 3),
l AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) last FROM c),
p AS (SELECT a.conv_id, CASE WHEN a.last IS NULL THEN a.turns ELSE a.turns[1:a.last] END chosen,
             CASE WHEN a.last IS NOT NULL AND b.last IS NOT NULL THEN a.turns[1:a.last - 1] || [b.turns[b.last]] END rejected
      FROM l a LEFT JOIN l b ON a.couple = b.couple AND a.side <> b.side),
n AS (SELECT *, CASE WHEN rejected IS NULL THEN 0 ELSE coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1),
               lambda i: i > least(len(chosen), len(rejected)) OR chosen[i] IS DISTINCT FROM rejected[i])) - 1, len(chosen)) END n FROM p),
s AS (SELECT conv_id, n, chosen[1:n] prompt, chosen[n + 1:] c, CASE WHEN rejected IS NOT NULL THEN rejected[n + 1:] END r FROM n),
m AS (SELECT conv_id, n, prompt, c, r,
   list_transform(c, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10)) ch, list_transform(c, lambda x: coalesce(x.text, '') || '<|end|>') cb,
   list_transform(r, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10)) rh, list_transform(r, lambda x: coalesce(x.text, '') || '<|end|>') rb FROM s)
SELECT conv_id, CAST(n AS INTEGER) AS prompt_turns,
  coalesce(array_to_string(list_transform(prompt, lambda x: '<|' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || '<|end|>' || chr(10)), ''), '') AS prompt,
  array_to_string(list_transform(range(1, len(c) + 1), lambda i: ch[i] || cb[i] || chr(10)), '') AS chosen,
  array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(range(1, i), lambda j: len(ch[j]) + len(cb[j]) + 1)), 0) + len(ch[i]) AS BIGINT) || ':' || len(cb[i])), ',') AS chosen_mask,
  array_to_string(list_transform(range(1, len(r) + 1), lambda i: rh[i] || rb[i] || chr(10)), '') AS rejected,
  array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(range(1, i), lambda j: len(rh[j]) + len(rb[j]) + 1)), 0) + len(rh[i]) AS BIGINT) || ':' || len(rb[i])), ',') AS rejected_mask
FROM m
""")
def op10(spark, folder):
    """Prompt and masked completions of all conversations, the neighbour's answer as the rejected one."""
    return preferences.format_pairs(preferences.neighbour_pairs(table(spark, folder, "conversations")))


def _template_rows() -> str:
    """The phrases and notices as rows of a table: number, label, whether a phrase, words."""
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    return ", ".join(f"({i}, '{t.label}', {t.phrase}, {t.threshold}::DOUBLE, {quoted(t.words)})"
                     for i, t in enumerate((*license_scan.PHRASES, *license_scan.NOTICES)))


@query("op11_license_scan", r"""
WITH d AS (SELECT row_number() OVER () id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') words FROM documents),
w AS (SELECT id, unnest(words) word, unnest(range(0, len(words))) pos FROM d),
t(t, label, phrase, share, words) AS (VALUES @TEMPLATES@),
s AS (SELECT *, len(words) n, len(list_distinct(words)) size, greatest(1, ceil(share * len(list_distinct(words)) - 1e-9)) need FROM t),
o AS (SELECT DISTINCT w.id, s.t, s.n, w.word, w.pos FROM s JOIN w ON list_contains(s.words, w.word) WHERE NOT s.phrase),
b AS (SELECT o.id, o.t, g.start, count(DISTINCT o.word) held FROM o, LATERAL (SELECT unnest(range(o.pos - o.n + 1, o.pos + 1)) start) g GROUP BY 1, 2, 3),
f AS (SELECT b.*, b.start - row_number() OVER (PARTITION BY b.id, b.t ORDER BY b.start) stretch FROM b JOIN s USING (t) WHERE b.held >= s.need),
m AS (SELECT f.id, f.t, max(f.held) held, arg_min(f.start, (-f.held, f.start)) start FROM f GROUP BY f.id, f.t, f.stretch),
h AS (SELECT m.id, s.label, greatest(m.start, 0) start, least(s.n, len(d.words) - greatest(m.start, 0)) len, m.held::DOUBLE / s.size held
      FROM m JOIN s USING (t) JOIN d USING (id)),
p AS (SELECT w.id, s.label, w.pos start FROM s JOIN w ON w.word = s.words[1] JOIN d ON d.id = w.id
      WHERE s.phrase AND d.words[w.pos + 1:w.pos + s.n] = s.words),
k AS (SELECT id, label, held FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.id = h.id AND x.label <> h.label AND x.held > h.held
        AND x.start < h.start + h.len AND h.start < x.start + x.len)
      UNION ALL SELECT id, label, 1.0 FROM p),
l AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) labels, max(held) score FROM k GROUP BY id),
q AS (SELECT id, count(*) n_base, min(start) first_word, max(start) last_word, string_agg(DISTINCT label, ',' ORDER BY label) base_labels FROM p GROUP BY id)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(q.n_base, 0) AS n_base, q.first_word, q.last_word, coalesce(q.base_labels, '') AS base_labels,
       coalesce(l.labels, '') AS labels, coalesce(l.score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN q USING (id) LEFT JOIN l USING (id)
""".replace("@TEMPLATES@", _template_rows()))
def op11(spark, folder):
    """Places of licence phrases and notices in all documents."""
    found = license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", *license_digest(F.col("hits")))


def license_digest(hits: Column) -> list[Column]:
    """What the hits of a text add up to."""
    base = F.filter(hits, lambda h: h["phrase"])
    starts = F.transform(base, lambda h: h["start"])
    names = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda h: h["label"]))), ",")
    return [F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
            names(base).alias("base_labels"), names(hits).alias("labels"),
            F.coalesce(F.array_max(F.transform(hits, lambda h: h["containment"])), F.lit(0.0)).alias("score")]


@query("op12_token_alignment")
def op12(spark, folder):
    """Token groups of all documents between two tokenizers, and how common their links are."""
    aligned = token_alignment.align(table(spark, folder, "documents").select("doc_id", "text"), ranks_path(), pieces_path())
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    short = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "same", "pairs")
    counted = token_alignment.count_links(short, ranks_path(), pieces_path())
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_periodic_runs")
def op13(spark, folder):
    """Periodic runs of all documents, of which a tenth are made periodic."""
    found = periodic_runs.find_runs(made_periodic(table(spark, folder, "documents").select("doc_id", "text")))
    return found.select("doc_id", *runs_digest(F.col("runs"), F.col("collapsed")))


def made_periodic(docs: DataFrame) -> DataFrame:
    """`docs`; the words from a chosen one on repeat a period in those whose crc32 of the id ends in 0."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(set_join.WORD), F.lit(0))

    def repeated(w):
        g, n = F.floor(h / 10), F.size(w)
        return F.when(n > 0, order_minhash.let(F.struct(w.alias("w"), (g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p")), lambda s: F.array_join(
            F.transform(s["w"], lambda x, i: F.when(i >= s["a"], F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int"))).otherwise(x)), " "))).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, order_minhash.let(words, repeated)).otherwise(F.col("text")))


def runs_digest(runs: Column, collapsed: Column) -> list[Column]:
    """The number of runs, the one with most periods, and digests."""
    def order(x, y):
        more, less = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(more > less, -1).when(more < less, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))

    best = F.get(F.array_sort(runs, order), F.lit(0))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return [F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
            F.floor((1000 * best["length"] - (1000 * best["length"]) % best["period"]) / best["period"]).cast("long").alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(collapsed, 256).alias("collapsed_sha256")]
