"""Licence scans, token alignment and periodic runs against brute force, and their defined cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladetally.llm import license_scan as ls
from cladetally.llm import periodic_runs as pr
from cladetally.llm import queries
from cladetally.llm import token_alignment as ta


def save(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# --- licence scans -----------------------------------------------------------------------------------------
def blocks(templates, text):
    """Hits by trying every block."""
    w, out = ls.words_of(text), []
    for t, template in enumerate(templates):
        words = template.words
        n, wanted = len(words), set(words)
        if template.phrase:
            out += [(t, i, n, 1.0) for i in range(len(w) - n + 1) if w[i:i + n] == words]
            continue
        need = max(1, math.ceil(template.threshold * len(wanted) - 1e-9))
        held = {s: len(wanted & set(w[max(s, 0):s + n])) for s in range(1 - n, len(w))}
        stretch = []
        for s in range(1 - n, len(w) + 1):
            if held.get(s, 0) >= need:
                stretch.append(s)
            elif stretch:
                best = min(stretch, key=lambda s: (-held[s], s))
                start = max(best, 0)
                out.append((t, start, min(n, len(w) - start), held[best] / len(wanted)))
                stretch = []
    return sorted(out)


def noisy_notices(rng, n):
    templates = ls.PHRASES + ls.NOTICES
    known = [w.decode() for t in templates for w in t.words]
    texts = [None, "", "a", "CC-BY-NC", "cc by", "Under the MIT License; under the mit license"]
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                words += [rng.choice(known) for _ in range(rng.randint(1, 50))]
                continue
            part = [w.decode() for w in rng.choice(templates).words]
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(part) + 1)
                part[at:at + rng.randint(0, 1)] = rng.choice([["zz"], [], ["é", "x"]])
            words += part
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_brute_force(seed):
    templates = ls.PHRASES + ls.NOTICES + (ls.Template("one", "warranty", 1.0), ls.Template("low", "a b c d e f g h a", 0.3))
    texts = noisy_notices(random.Random(seed), 120)
    counts = Counter(w for t in texts for w in set(ls.words_of(t)))
    sizes, hits = ls.Index(templates, counts).search(texts)
    assert sizes.tolist() == [len(ls.words_of(t)) for t in texts]
    for i, text in enumerate(texts):
        assert [(h[1], h[2], h[3], round(h[4], 9)) for h in hits if h[0] == i] == [(*h[:3], round(h[3], 9)) for h in blocks(templates, text)], text


def test_license_query_equals_brute_force(spark, tmp_path):
    texts = noisy_notices(random.Random(9), 150)
    texts += ["x " * 30_000 + "under the MIT license " + "y " * 5, "This work is licensed under the GNU General Public License, version 3."] + texts[5:8]
    folder = save(spark, tmp_path, [(i if i else None, t) for i, t in enumerate(texts)])
    found = {r["doc_id"] or 0: r for r in queries.QUERIES["op11_license_scan"](spark, folder).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        w, r = ls.words_of(text), found[i]
        places = [(t.label, s) for t in ls.PHRASES for s in range(len(w) - len(t.words) + 1) if w[s:s + len(t.words)] == t.words]
        starts = [s for _, s in places]
        base = {label for label, _ in places}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted(base))
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and base <= set(labels)
        reached = {ls.NOTICES[h[0]].label for h in blocks(ls.NOTICES, text)}
        assert set(labels) - base <= reached and bool(labels) == bool(base | reached)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    assert found[len(texts) - 4]["labels"] == "gpl"


def test_nearest_notice_wins():
    lesser = "This work is licensed under the GNU Lesser General Public License, version 3"
    index = ls.Index(ls.NOTICES, {})
    labels = {ls.NOTICES[h[1]].label for h in ls.strongest(ls.NOTICES, index.search([lesser])[1])}
    assert labels == {"lgpl"}


def test_license_scan_defined_cases(spark, documents):
    rows = [(1, None), (1, ""), (None, "cc by nc"), (2, "CC-BY-NC cc.by.nc"), (2, "CC-BY-NC cc.by.nc"), (3, "été cc\tby\nnc")]
    docs = documents(rows).withColumn("hits", F.lit("mine"))
    found = ls.scan(docs)
    assert found.columns == [c for c in docs.columns if c != "hits"] + ["n_words", "hits"]
    got = sorted((r["n"], r["n_words"], len(r["hits"])) for r in found.collect())
    assert got == [("0", 0, 0), ("1", 0, 0), ("2", 3, 1), ("3", 6, 2), ("4", 6, 2), ("5", 4, 1)]
    assert ls.scan(docs.limit(0)).count() == 0
    # Text that a lambda expression makes.
    made = docs.withColumn("text", F.array_join(F.transform(F.split("text", " "), F.upper), " "))
    assert ls.scan(made).selectExpr("sum(size(hits))").first()[0] == 6
    with pytest.raises(ValueError):
        ls.scan(docs, notices=[ls.Template("x", "...")])


# --- token alignment -----------------------------------------------------------------------------------------
def byte_of_letter():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


@pytest.fixture(scope="module")
def tokenizers_of():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.pieces_path())


def aligned_by_hand(text, tokenizers_of):
    """Ids of both sides, groups and links, by comparing all tokens of a text with each other."""
    if not text:
        return None
    a, b = tokenizers_of
    letters = byte_of_letter()
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    pieces = [b.id_to_piece(i) for i in ids[1]]
    spelled = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]],
               [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], pieces)]]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return None
    spans = []
    for side in spelled:
        at, found = 0, []
        for token in side:
            found.append((at, at + len(token)))
            at += len(token)
        spans.append(found)
    links = [(x, y) for x, (s, e) in zip(ids[0], spans[0]) for y, (t, f) in zip(ids[1], spans[1]) if max(s, t) < min(e, f)]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = ";".join("|".join(",".join(str(i) for i, (s, e) in zip(ids[side], spans[side]) if low <= s and e <= high) for side in (0, 1))
                      for low, high in zip([0, *cuts], cuts))
    return len(ids[0]), len(ids[1]), groups, links


TEXTS = [None, "", " ", "a", "  b", "\x00a", "a<|endoftext|> b <s> </s> <unk>", "日本語 テキスト ﬁ é ▁ x", "\n\n\tx\r\n", "😀😀 ok", "àb", "½ x²",
         "<0x41> A", "Hello world, hello World", "Hello world, hello World", "aaa aaaa aaaaaaaa", "Привет, мир", "กาแฟ", "x" * 300, "the cat sat on the mat " * 40]


def test_token_alignment_query_equals_brute_force(spark, tmp_path, tokenizers_of):
    rng = random.Random(2)
    parts = ["token", "isation", "un", "believ", "able", " ", ", ", "ß", "мир", "42", "\n", "Ω"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    folder = save(spark, tmp_path, list(enumerate(texts)))
    by_hand = [aligned_by_hand(t, tokenizers_of) for t in texts]
    docs = Counter(pair for h in by_hand if h for pair in set(h[3]))
    best = Counter()
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    found = {r["doc_id"]: r for r in queries.QUERIES["op12_token_alignment"](spark, folder).collect()}
    assert len(found) == len(texts)
    for i, h in enumerate(by_hand):
        r = tuple(found[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
        if h is None:
            assert r == (0, 0, 0, 0, 0, 0, ""), texts[i]
            continue
        n_a, n_b, groups, links = h
        assert r == (n_a, n_b, groups.count(";") + 1, len(links), sum(docs[x] == best[x[0]] for x in links), sum(docs[x] for x in links),
                     hashlib.sha256(groups.encode()).hexdigest()), texts[i]


def test_rare_and_frequent_pairs_agree(spark, documents):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(None, "x y"), (None, "x y")]
    docs = documents(rows)
    aligned = ta.align(docs, queries.ranks_path(), queries.pieces_path())
    assert aligned.columns == [*docs.columns, *ta.ADDED]
    results = []
    for frequent in (1, 30, ta.FREQUENT):  # nearly all pairs by the join, some, none
        found = ta.count_links(aligned.drop("groups"), queries.ranks_path(), queries.pieces_path(), frequent)
        assert found.columns == [c for c in aligned.columns if c not in ("groups", "same", "pairs")] + ["n_best", "count_sum"]
        results.append(sorted((r["row_key"], r["n_best"], r["count_sum"]) for r in found.collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    assert ta.count_links(aligned.limit(0), queries.ranks_path(), queries.pieces_path()).count() == 0


def test_alignment_of_long_text_equals_its_parts():
    known = ta.vocabularies(queries.ranks_path(), queries.pieces_path())
    long = "The quick brown fox, unbelievably. " * 40_000  # 1.4 million characters: a portion and slices of its own
    done = ta.align_texts([long[:-1], "short one"], known)
    assert done.counts[0, 0] > 200_000 and done.counts[1, 0] > 0
    spelled = [int(x) for g in done.groups[0].decode().split(";") for x in g.split("|")[0].split(",")]
    assert spelled == known.a.encode_ordinary(" " + long[:-1])


# --- periodic runs ---------------------------------------------------------------------------------------------
def all_runs(words, least=24):
    """By trying every period."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            s = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, 3 * p):
                found.setdefault((s, i - s + p), p)
            i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def periodic_texts(rng, n):
    texts = []
    for _ in range(n):
        kinds, words = rng.choice([1, 2, 2, 3, 5, 50]), []
        size = rng.randint(0, 300)
        while len(words) < size:
            part = [rng.randrange(kinds) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.5:
                part = part * rng.randint(1, 4) + [rng.randrange(kinds) for _ in range(rng.randint(0, 3))]
            words += (part * rng.randint(1, 9))[:rng.randint(1, 200)] if rng.random() < 0.8 else words[-rng.randint(1, 60):]
        texts.append(" ".join(f"w{x}" for x in words))
    return texts


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    texts = periodic_texts(random.Random(seed), 60)
    words = [t.encode().split() for t in texts + texts[:5]]
    for w, found in zip(words, pr.search(words)):
        assert [tuple(r) for r in found.tolist()] == all_runs(w)


def test_runs_at_the_bounds():
    def runs(text):
        return [tuple(r) for r in pr.search([text.encode().split()])[0].tolist()]

    eight, nine = " ".join("abcdefgh"), " ".join("abcdefghi")
    assert runs("a " * 23) == [] and runs("a " * 24) == [(0, 24, 1)]
    assert runs(f"{eight} " * 3) == [(0, 24, 8)] and runs(f"z {eight} {eight} a b c d e f g z") == []
    assert runs(f"{nine} " * 3) == [(0, 27, 9)] and runs(f"{nine} {nine} a b c d e f g h") == []
    # A period that holds periodic stretches of its own.
    inner = "x " * 30 + "y " + "x " * 30 + "z "
    assert runs(inner * 3) == all_runs((inner * 3).split())


def test_runs_query_equals_brute_force(spark, tmp_path):
    texts = [None, "", "a", "a " * 24, "\x0ba\x0ca b  c " * 20] + periodic_texts(random.Random(11), 150)
    texts += ["Word sequence without any period " + " ".join(str(i) for i in range(20_000)), "x\ty\nz " * 10_000] + texts[5:8]
    folder = save(spark, tmp_path, list(enumerate(texts)))
    found = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, folder).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        w = [x.decode() for x in (text or "").encode().split()]
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        # Brute force is quadratic; of the two long texts only the first period can repeat.
        runs = all_runs(w) if n < 5000 else [(0, n, 3)] if w[0] == "x" and h % 10 else [] if h % 10 else None
        if runs is None:
            continue
        gone = {j for s, length, p in runs for j in range(s + p, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        r = found[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{x},{p}\n" for s, x, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()


def test_find_runs_defined_cases(documents):
    docs = documents([(1, None), (1, ""), (None, "a " * 30), (2, "a " * 30), (2, "a " * 30)]).withColumn("runs", F.lit(1))
    found = pr.find_runs(docs)
    assert found.columns == [c for c in docs.columns if c != "runs"] + ["runs", "collapsed"]
    assert sorted((r["n"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.collect()) == [
        ("0", [], ""), ("1", [], ""), ("2", [(0, 30, 1)], "a"), ("3", [(0, 30, 1)], "a"), ("4", [(0, 30, 1)], "a")]
    assert pr.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.find_runs(docs, least=10)


def test_license_sql_equals_query_on_planted_notices(spark, tmp_path):
    import duckdb

    from tools.check_oracles import compare

    folder = save(spark, tmp_path, [(i if i else None, t) for i, t in enumerate(noisy_notices(random.Random(21), 200))])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    problem, rows = compare(queries.QUERIES["op11_license_scan"](spark, folder), con, queries.ORACLES["op11_license_scan"])
    assert problem is None and rows == 206, problem


def test_ordinary_words_are_counted_in_all_texts(spark):
    from cladetally.llm import secret_scan

    docs = spark.range(5000).selectExpr("'p' as path", "concat('common word', if(id % 50 = 0, ' seldom', ''), ' n', id) as text")
    assert secret_scan._word_counts(docs, 10) == {"common": 5000, "word": 5000, "seldom": 100}
    assert secret_scan._word_counts(docs, 2) == {"common": 5000, "word": 5000}
