"""Operators 11 to 13: brute force, held-out accuracy, hot keys and odd input."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.llm import clusters, kernels, langid, phrases

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word string, id long, key string, a int, n int, g int"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(1, "ab cd ef", "en"), (1, "ab cd ef", "en"), (2, None, None), (3, "", "en"), (4, "wort " * 30_000, "de"), (None, "wort noch", "de"), (5, "12 !?…", "en"), (6, "x" * 5_000, None), (7, "Ünïcødé", "en")]
    return spark.createDataFrame([(*r, "w", 1, "k", 2, 3, 4) for r in rows], SCHEMA)


def vectors(spark, rows, partitions=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, cluster int").repartition(partitions)


# ---------------------------------------------------------------- 11


def all_cuts(word, chance):
    """The sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    return sum(chance[word[:i]] * all_cuts(word[i:], chance) for i in range(1, len(word) + 1) if word[:i] in chance)


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"bab", b"abab"]
    known = langid.Pieces(pieces)
    p = np.random.default_rng(1).random((len(pieces), 3))
    words = [b" ababab", b" bab", b" ab", b" a"]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    found = list(known.inside(raw, starts, ends))
    sums = langid.forward(found, ends - starts, p)
    for i, w in enumerate(words):
        for k in range(3):
            assert math.isclose(sums[len(w), i, k], all_cuts(w, dict(zip(pieces, p[:, k]))))


def test_expected_counts_by_enumeration():
    pieces = [b" ", b"a", b"b", b"ab", b" a"]
    known, p = langid.Pieces(pieces), np.array([[0.1], [0.2], [0.3], [0.25], [0.15]])
    word = np.frombuffer(b" aab", np.uint8)
    start, size = np.array([0]), np.array([4])
    found = list(known.inside(word, start, size))
    got = np.zeros(5)
    for _, piece, n in langid.expected(found, size, np.array([1000]), np.array([0]), p):
        np.add.at(got, piece, n / langid.UNIT)
    cuts = [[b" a", b"ab"], [b" a", b"a", b"b"], [b" ", b"a", b"ab"], [b" ", b"a", b"a", b"b"]]
    weight = [math.prod(p[pieces.index(x), 0] for x in c) for c in cuts]
    want = [1000 * sum(w * c.count(x) for w, c in zip(weight, cuts)) / sum(weight) for x in pieces]
    assert np.allclose(got, want, atol=0.01)


def test_words_of_spaced_texts(spark):
    texts = ["The CAT, the 2 dogs", None, "", "…", "x" * 70, "é" * 20]
    col = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(langid.spaced("t")).collect()]
    raw, offs = kernels.text_bytes(pa.array(col))
    starts, ends, text = langid._parts(raw, offs)
    got = [[raw[s:e].tobytes() for s, e, t in zip(starts, ends, text) if t == k] for k in range(len(texts))]
    assert got[0] == [b" the", b" cat", b" the", b" dogs"] and got[1] == got[2] == got[3] == []
    assert [len(p) for p in got[4]] == [32, 32, 7] and b"".join(got[5]) == (" " + "é" * 20).encode()


def test_languages_of_held_out_documents(spark):
    import public_tokenizers

    docs = table(spark, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = langid.identify(docs, path)
    both = got.join(docs, "doc_id").toPandas()
    assert len(both) == docs.count()
    assert (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (both[both["held_out"]]["lang_pred"] == both[both["held_out"]]["lang"]).mean() > 0.95
    assert both["score"].between(0, 1).all()
    # held-out languages are not read: other ones give the same result
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "xx").otherwise(F.col("lang")))
    assert sorted(langid.identify(other.repartition(5), path).collect()) == sorted(got.collect())


def test_languages_of_odd_rows(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = langid.identify(odd, path).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["lang_pred"] for k in (2, 3, 5)] == ["und"] * 3 and by[2]["score"] == 0
    assert {by[k]["lang_pred"] for k in (1, 4, 6, 7)} <= {"en", "de"}
    assert by[4]["lang_pred"] == "de" and by[None]["held_out"] is False
    assert langid.identify(odd.where("false"), path).count() == 0
    unlearned = langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), path).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlearned} == {("und", 0.0)}


# ---------------------------------------------------------------- 12


def lloyd(rows, k, rounds):
    """Plain scans with Python's whole numbers."""
    import hashlib

    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(r[1]) for r in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in rows]
        for j in range(len(cents)):
            own = [x for (_, x), c in zip(rows, at) if c == j]
            if own:
                cents[j] = [sum(v) // len(own) for v in zip(*own)]
    return sorted((i, near(x)[1], near(x)[0]) for i, x in rows), cents


@pytest.mark.parametrize("rounds", [1, 6])
def test_clusters_by_full_scans(spark, rounds):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 64))
    x = (middles[rng.integers(0, 12, 400)] + 0.2 * rng.normal(size=(400, 64))).astype(np.float32)
    x[50:60] = x[40]  # copies
    rows = [(int(i), v.tolist(), 0, "x", 1) for i, v in enumerate(x)]
    got = clusters.assign(vectors(spark, rows), rounds=rounds).toPandas()
    want, cents = lloyd([(i, np.floor(64.0 * np.array(v, float)).astype(int).tolist()) for i, v, *_ in rows], 16, rounds)
    assert sorted(zip(got["vec_id"], got["cluster"], got["distance"])) == want
    import hashlib

    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    assert all(digest[c] == h for c, h in zip(got["cluster"], got["centroid_sha256"]))
    assert set(got["inertia"]) == {sum(w[2] for w in want)}
    assert (got["cluster_inertia"] == got.groupby("cluster")["distance"].transform("sum")).all()
    if rounds == 6:  # clusters that stand apart: most distances are not evaluated
        assert got["evaluated"].mean() < 4


def test_equal_distances_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64, 0, "x", 1) for i in range(40)]
    got = clusters.assign(vectors(spark, rows), rounds=0).toPandas()
    assert got["cluster"].nunique() == 2 and set(got["distance"]) == {0}
    want, _ = lloyd([(i, [64 * (i % 2)] * 64) for i in range(40)], 16, 0)
    assert sorted(zip(got["vec_id"], got["cluster"], got["distance"])) == want


def test_clusters_of_odd_vectors(spark):
    fine = [0.5] * 64
    rows = [(1, fine, 0, "x", 1), (1, fine, 0, "x", 1), (None, fine, 0, "x", 1), (2, None, 0, "x", 1), (3, [], 0, "x", 1), (4, fine[:63], 0, "x", 1)]
    rows += [(5, [*fine[:63], None], 0, "x", 1), (6, [*fine[:63], math.inf], 0, "x", 1), (7, [*fine[:63], math.nan], 0, "x", 1), (8, [-0.01] * 64, None, None, None)]
    got = clusters.assign(vectors(spark, rows)).toPandas()
    assert sorted(got["vec_id"].fillna(-1)) == [-1, 1, 1, 8]
    assert set(got["distance"]) == {0}
    assert clusters.assign(vectors(spark, rows).where("false")).count() == 0
    with pytest.raises(Exception, match="too large"):
        clusters.assign(vectors(spark, [(1, [1e20] * 64, 0, "x", 1)]))


# ---------------------------------------------------------------- 13


def plain_phrases(rows, least, top):
    """Counts by enumeration, scores in Python's whole numbers."""
    import re
    from collections import Counter

    out = []
    small = {i: i + 32 for i in range(65, 91)}
    for lang in {r[1] or "und" for r in rows}:
        f = Counter()
        for text, own in rows:
            if (own or "und") == lang:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(small)):
                    w = re.findall(r"[^\x20\x09]+", piece)
                    f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        n = sum(v for p, v in f.items() if len(p) == 1)
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {(p[i : i + k]) for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * cand[p[i : i + k]]}
        got = []
        for p, a in cand.items():
            if p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                got.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(got)[:top])]
    return sorted(out)


@pytest.mark.parametrize("budget", [1 << 20, 50, 1])
def test_phrases_by_enumeration(spark, budget):
    """Also where prefixes of every length are above the budget, one of them with most suffixes of all."""
    rng = np.random.default_rng(2)
    words = ["a", "b", "c", "d", "É", "é", "B"]
    rows = [(" ".join(rng.choice(words, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05], size=30)) + rng.choice([".", "\n", "; ", " "]) + "hot pair of words that recur" * int(rng.integers(0, 3)), str(rng.choice(["en", "de"]))) for _ in range(60)]
    rows += [(None, "en"), ("", None), ("A a\ta,a a" * 9, None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = phrases.collocations(df, least=8, top=40, budget=budget)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 8, 40)


def test_products_beyond_64_bits(spark):
    row = spark.createDataFrame([("x", bytearray(range(16)), 10**12)], "lang string, key binary, a long")
    counts = spark.createDataFrame([(bytearray(range(8)), 3 * 10**12), (bytearray(range(8, 16)), 2 * 10**12 + 1)], "key binary, a long")
    totals = spark.createDataFrame([("x", 7 * 10**14)], "lang string, n long")
    got = phrases.scored(row, counts, totals).head()
    assert got["score"] == 1000 * 10**12 * 7 * 10**14 // (3 * 10**12 * (2 * 10**12 + 1))


def test_words_that_share_an_id_are_told(spark):
    rows = [("en", 1, "a", 2), ("en", 1, "a", 3), ("en", 2, "b", 1), ("de", 2, "b", 1), ("en", 3, "c", 1), ("en", 3, "d", 1)]
    got = phrases.by_id(spark.createDataFrame(rows, "lang string, id long, word string, f long")).collect()
    assert sorted((r["id"], r["f"], r["clash"]) for r in got) == [(1, 5, False), (2, 2, True), (3, 2, True)]


def test_blocks_of_suffixes_read_back():
    rows = np.array([[1, 2, 3, 4, 5], [1, 2, 0, 0, 0], [2**63, 1, 1, 0, 0]], np.uint64)
    for top in ([], [2**63, 5], [1, 2, 3, 4, 5, 2**63]):  # words without and with a short code
        known = phrases.Suffixes(0, np.zeros(1, np.uint64), np.array(top, np.uint64), 1, 1)
        back, n, depth = phrases._unbundle(phrases._bundle(rows, np.array([3, 10**12, 1]), np.array([1, 2, 1]), known), known)
        assert (back == rows).all() and n.tolist() == [3, 10**12, 1] and depth.tolist() == [1, 2, 1]


def test_words_with_short_codes_are_bounded(spark):
    df = spark.createDataFrame([(i, 100 + i // 10) for i in range(1000)], "id long, f long")
    assert len(phrases.most_frequent(df, 1000)) == 1000 and len(phrases.most_frequent(df, 0)) == 0
    some = phrases.most_frequent(df, 300).tolist()
    assert 0 < len(some) <= 300 and some == sorted(range(1000), key=lambda i: (-(100 + i // 10), i))[: len(some)]


def test_phrases_of_odd_rows(spark, odd):
    got = phrases.collocations(odd, least=2)
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 2, 2000)
    assert phrases.collocations(odd.where("false")).count() == 0


# ---------------------------------------------------------------- 10


def test_counts_of_more_than_32_bits_are_kept():
    from termweave.llm import lm

    keys, counts = np.array([3, 5], np.uint64), np.array([2**40, 7])
    back = lm._unbundle(lm._bundle(keys, counts, np.array([1, 2]), np.array([9, 1, 4], np.uint64), np.array([2**33, 1, 6])))
    assert [x.tolist() for x in back] == [[3, 5], [2**40, 7], [1, 2], [9, 1, 4], [2**33, 1, 6]]
