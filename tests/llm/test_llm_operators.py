"""Brute force, exact round trips, held-out accuracy, and the edge cases that every operator states."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.llm import chat, compact, kernels, licences, lm, mixing, neardup, packing, pii, quality, vectors
from termweave.llm.common import components

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
#: Null ids, texts, sources; empty and very long texts; repeated rows; names that operators use inside.
SCHEMA = "doc_id long, text string, source string, node string, sig string, bucket int, g int, _text string, _id long, draw double, copies int, spans string"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, None, None), (3, "", "s"), (4, LONG, "t"), (None, "a b c d e f", "t"), (5, "x", ""), (6, "mail a@b.co, +1 (743) 555-3824", "t")]
    return spark.createDataFrame([(*r, "n", "s", 1, 2, "t", 3, 0.5, 4, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


# ---------------------------------------------------------------- kernels


def test_word_hashes():
    texts = ["The the\tTHE  é", None, "", " a\x0b b ", "é"]
    h, at = kernels.words(*kernels.text_bytes(pa.array(texts)))
    assert np.diff(at).tolist() == [len(words(t)) for t in texts]
    assert h[0] == h[1] == h[2] and h[3] == h[6] and len(set(h.tolist())) == 4


def test_slices_give_the_same_words():
    texts = ["ab " * n for n in range(50)]
    raw, offs = kernels.text_bytes(pa.array(texts))
    whole, _ = kernels.words(raw, offs)
    parts = [kernels.words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0] for i, j in kernels.slices(offs, 100)]
    assert (np.concatenate(parts) == whole).all()


# ---------------------------------------------------------------- 1


def test_quality_on_held_out_labels(spark):
    labels = table(spark, "labels")
    got = quality.score(table(spark, "documents"), labels)
    both = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (both["predicted"] == both["quality"]).mean() > 0.85
    assert got.count() == table(spark, "documents").count()


def test_word_vectors_and_pooling_by_brute_force(spark):
    texts = ["the cat, the dog 12", "", "the the the cat", "dog cat", None, "rare"]
    runs = [re.findall(r"[a-z]+|[0-9]+|[^a-z0-9\s]+", t or "") for t in texts]
    count = Counter(w for t in runs for w in t)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    own = {w: quality._words(pa.array([w])) for w in count}
    code = {w: int(next(x)[0][0]) for w, x in own.items()}
    known = quality.vocabulary(df, 3)
    signed = lambda w: int(np.array([code[w]], np.uint64).view(np.int64)[0])
    top = sorted(count, key=lambda w: (-count[w], signed(w)))[:3]
    assert known.tolist() == sorted(code[w] for w in top)
    place, sign = (dict(zip(count, x)) for x in quality.index_vectors(np.array([code[w] for w in count], np.uint64)))
    want = {w: np.zeros(quality.DIM) for w in top}
    for t in runs:
        for i, w in enumerate(t):
            for j in range(max(0, i - quality.WINDOW), min(len(t), i + quality.WINDOW + 1)):
                if j != i and w in want:
                    np.add.at(want[w], place[t[j]], sign[t[j]])
    for w, v in want.items():
        v = np.sign(v) * np.log1p(np.abs(v))
        want[w] = v / max(np.linalg.norm(v), 1e-9)
    got = quality.word_vectors(df, known)
    assert np.allclose(got[:-1], [want[w] for w in sorted(top, key=code.get)], atol=1e-5) and not got[-1].any()
    for w in count:  # rarer words have their own index vectors
        if w not in want:
            want[w] = np.zeros(quality.DIM)
            np.add.at(want[w], place[w], sign[w])
            want[w] /= np.linalg.norm(want[w])
    pooled = quality._pooled(pa.array(texts), known, got)
    zero = np.zeros(quality.DIM)
    for t, row in zip(runs, pooled):
        v = [want[w] for w in t]
        n = max(1, len(t))
        lag = [sum(float(a @ b) for a, b in zip(v, v[k:])) / n for k in quality.LAGS]
        assert np.allclose(row, [*(sum(v, zero) / n), *np.sqrt(sum((x * x for x in v), zero) / n), *lag], atol=1e-5)


def test_word_vectors_are_the_same_however_parts_are_added(spark):
    df = table(spark, "documents").select("text").repartition(12)
    known = quality.vocabulary(df, 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in (8, 64):  # one level, and two
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(quality.word_vectors(df, known))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got[0] == got[1]).all() and np.abs(got[0]).max() > 0


def test_texts_of_rare_words_alone_have_features(spark):
    known = np.zeros(0, np.uint64)
    rows = quality._pooled(pa.array(["xqzv wrtk", "plmq", ""]), known, np.zeros((1, quality.DIM), np.float32))
    assert np.abs(rows[0]).max() > 0 and np.abs(rows[1]).max() > 0 and not rows[2].any()
    assert not np.allclose(rows[0], rows[1])


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, None), (4, 7), (99, 0)], "doc_id long, quality int")
    got = quality.score(odd, labels).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quality.score(odd, labels.where("false")).first()["score"] == 0.5
    assert quality.score(none, labels).count() == 0
    assert quality.score(odd, labels, keep_row=True).select("row.*").columns == odd.columns


def test_labels_of_the_held_out_fold_are_never_learnt(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, x).orderBy("doc_id").toPandas()["score"] for x in (labels, flipped))
    assert (a == b).all()


# ---------------------------------------------------------------- 2


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        share = {s: (goal - sum(full.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    docs = table(spark, "documents").withColumn("source", F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("source")))
    got = mixing.mix(docs).toPandas()
    by = got.groupby("source", dropna=False)
    sizes = {None if s != s else s: int(n) for s, n in by["size"].sum().items()}
    want = targets_by_hand(sizes)
    for s, rows in by:
        s = None if s != s else s
        assert rows["target"].iloc[0] == pytest.approx(want[s])
        assert abs(rows["taken"].sum() - want[s]) <= rows["size"].max() / 2 + 1
    assert (got["taken"] <= 2 * got["size"]).all() and (got["size"] == [len(words(t)) for t in docs.toPandas().set_index("doc_id").loc[got["doc_id"], "text"]]).all()
    again = mixing.mix(docs.repartition(3)).toPandas()
    assert dict(zip(got["doc_id"], got["taken"])) == dict(zip(again["doc_id"], again["taken"]))


def test_mix_keeps_expectations(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("w " * 5).alias("text"), F.when(F.col("id") < 30, "a").otherwise("b").alias("source"))
    taken = Counter()
    for seed in range(6):
        for r in mixing.mix(docs, seed=seed).collect():
            taken[r["doc_id"]] += r["copies"]
    assert len({v for v in taken.values()}) > 1  # not the same documents every time
    assert sum(taken.values()) == 6 * 90


def test_mix_edges(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 8 and {r["taken"] for r in got if r["size"] == 0} == {0}
    assert mixing.mix(none).count() == 0


# ---------------------------------------------------------------- 3


def exact_components(docs, size, share):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size, share", [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates_of_documents(spark, size, share):
    docs = table(spark, "documents").select("doc_id", "text")
    want = exact_components([tuple(r) for r in docs.collect()], size, share)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, size, share).collect()}
    assert got == want


def test_near_duplicates_in_a_crowd(spark):
    """A few hundred edits of one text around the threshold: a region far over its bound."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        t = list(base)
        for k in r.sample(range(120), r.choice([1, 2, 3, 4])):
            t[k] = f"x{i}-{k}"
        rows.append((i, " ".join(t)))
    want = exact_components(rows, 3, (85, 100))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(docs, 3, (85, 100)).collect()}
    assert got == want


def test_near_duplicate_edges(spark, odd, none):
    got = neardup.near_duplicates(odd, 3).collect()
    assert len(got) == 8
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(4, None, True)]
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] in (1, 2, 3, 5)} == {(1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True)}
    assert neardup.near_duplicates(none).count() == 0


def test_components_of_a_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components(chain).collect()} == {0}


# ---------------------------------------------------------------- 4


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizer(tokenizer):
    w = packing.WordIds(tokenizer)
    r = random.Random(1)
    alphabet = [chr(c) for c in range(0x260)] + ["́", "Σ", "ﬁ", "日", "🙂", " ", " "]
    texts = ["", "It's we'll I'M", "İstanbul", "<|endoftext|>", "a" * 3000] + ["".join(r.choices(alphabet, k=60)) for _ in range(500)]
    for t in texts:
        assert w.encode(t) == np.array(w.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing(spark, odd, tokenizer):
    docs = table(spark, "documents").select("doc_id", "text").unionByName(odd.where("doc_id = 4").select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = packing.pack(packing.token_pieces(docs, tokenizer)).toPandas()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    for i, t in docs.collect():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = got[got["doc_id"] == i].sort_values("piece")
        assert mine["length"].tolist() == [len(ids[k : k + 4096]) for k in range(0, len(ids), 4096)]
        assert mine["ids_crc32"].tolist() == [zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()) for k in range(0, len(ids), 4096)]
        assert mine["start"].tolist() == list(range(0, len(ids), 4096))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 4096 and (s["offset"] == s["length"].cumsum() - s["length"]).all()
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    r = np.random.default_rng(0)
    size = np.sort(r.integers(1, 400, 500))[::-1].astype(float)
    items, caps = np.stack([size, np.ones(500), size * size], 1), np.array([1000.0, 4, 500_000])
    bins, rest = packing.best_fit(items, caps, np.ones(3), rule)
    for b in range(bins.max() + 1):
        used = items[bins == b].sum(0)
        assert (used <= caps).all() and np.allclose(caps - used, rest[b])


def test_packing_edges(odd, none, tokenizer):
    got = packing.pack(packing.token_pieces(odd, tokenizer)).toPandas()
    assert got[got["doc_id"].isin([2, 3])]["length"].tolist() == [1, 1] and got["doc_id"].isna().sum() == 1
    assert packing.pack(packing.token_pieces(none, tokenizer)).count() == 0
    ids = packing.token_pieces(odd, tokenizer, with_ids=True).where("doc_id = 5").first()["ids"]
    assert ids[-1] == 1 and len(ids) > 1


# ---------------------------------------------------------------- 5


def test_licences(spark, none):
    mit = next(t for i, t in licences.KNOWN if i == "MIT" and len(t) > 500)
    other = mit.replace("MIT License", "mit  LICENCE\nCopyright (c) 2020 Someone").replace('"', "'").upper()
    rows = [(1, mit), (2, other), (3, "Text.\n  released under the MIT licence!\nMore"), (4, mit + " and more"), (5, None), (6, ""), (None, mit), (1, "Licensed under CC BY 4.0")]
    got = licences.scan(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, license_id string")).collect()
    docs = Counter((r["doc_id"], r["document_license"]) for r in got)
    assert docs == Counter([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (None, "MIT"), (1, "CC-BY-4.0")])
    assert {r["notice_licenses"] for r in got if r["doc_id"] == 3} == {"MIT"}
    assert sorted(r["notice_licenses"] for r in got if r["doc_id"] == 1) == ["", "CC-BY-4.0"]  # each row its own lines
    assert licences.scan(none).count() == 0


def test_lines_of_any_length_and_repeated_ids(spark):
    far = "Released under" + " " * 6000 + "the MIT License."
    rows = [(1, far), (2, "z"), (2, "x\nLicensed under CC BY 4.0.\nLicensed under CC BY 4.0."), (2, "z")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_notices"], r["notice_licenses"]) for r in got) == Counter([(1, 1, "MIT"), (2, 0, ""), (2, 2, "CC-BY-4.0"), (2, 0, "")])


def test_clauses_numbered_c_are_no_copyright_lines(spark):
    norm = lambda t: spark.createDataFrame([(t,)], "text string").selectExpr(licences.canonical_sql("text") + " AS n").first()["n"]
    assert norm("(c) You must retain all notices.\n(c) 2020 A\nCopyright (c) <year> B\nCopyright 1999 C\n All rights reserved.\nCopyright notices stay") == "you must retain all notices copyright notices stay"


def test_every_known_text_passes_the_shortcut_by_word():
    assert all(re.search(licences.WORDS, t) for _, t in licences.KNOWN)


def test_published_licence_texts(spark):
    """Texts of common licences where the system has them: re-wrapped and in capitals they are known."""
    import pathlib

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [(n, pathlib.Path("/usr/share/common-licenses", f)) for f, n in names.items()]
    found = [(n, p.read_text()) for n, p in found if p.exists()]
    if not found:
        pytest.skip("no licence texts here")
    docs = spark.createDataFrame([(i, t.upper().replace("\n", "  \n ")) for i, (_, t) in enumerate(found)], "doc_id long, text string")
    assert {r["doc_id"]: r["document_license"] for r in licences.scan(docs).collect()} == {i: n for i, (n, _) in enumerate(found)}


# ---------------------------------------------------------------- 6


def slow_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(v) <= 255 for v in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(s, e, k) for s, k, e in sorted(out)]


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for _ in range(8000):
        x = "".join(r.choices("0123456789@.+- ()ab%\n", k=r.randint(0, 40)))
        assert pii.base_spans(x) == slow_spans(x), x
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_tagger_learns_and_adds_only_what_is_valid():
    r = random.Random(5)
    texts = [" ".join(r.choice(["one", "two", "item", "see"]) for _ in range(12)) + r.choice([f" +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} ", f" u{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com ", f" {r.randint(1, 255)}.{r.randint(1, 255)}.7.9 ", " none "]) + "two see" for _ in range(160)]
    w = np.concatenate([pii.windowed(c, s) for t in texts if (s := pii.cut_windows(c := pii.classes(t), t))])
    y = np.array([np.pad(g := pii.tags_of(len(t), pii.base_spans(t))[s : s + pii.SPAN], (0, pii.SPAN - len(g))) for t in texts for s in pii.cut_windows(pii.classes(t), t)])
    tagger = pii.Tagger().fit(w, y, steps=120)
    tags, _ = tagger.decode(w)
    assert (tags == y).mean() > 0.97
    for t, spans in zip(texts, pii.all_spans(texts, tagger)):
        assert [s[:3] for s in spans if s[3]] == pii.base_spans(t)
        for s, e, k, base in spans:
            assert base or pii.valid(k, t[s:e])


def test_personal_data_of_documents_by_brute_force(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    tagger = pii.fit(docs)
    for r in pii.digest(pii.find(docs, tagger)).collect():
        want = slow_spans(texts[r["doc_id"]])
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == i for x in want) for i in range(4)]
        assert set(line.split(",")) <= set(r["spans"].split(","))


def test_added_spans_of_disguised_texts(spark):
    """Trained on some documents, held against disguises planted in others."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text rlike '[0-9]{3}|@' and doc_id % 3 <> 0").select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tagger = pii.fit(docs.where("doc_id % 3 <> 0"))
    made = [pii.disguised_text(t, np.random.default_rng(i)) for i, t in enumerate(texts) if i % 3 == 0]
    found = missed = wrong = 0
    for (t, planted), spans in zip(made, pii.all_spans([t for t, _ in made], tagger)):
        base = {x[:3] for x in spans if x[3]}
        added = {x[:3] for x in spans if not x[3]}
        want = {x for x in planted if pii.valid(x[2], t[x[0] : x[1]])} - base
        found, missed = found + len(want & added), missed + len(want - added)
        wrong += sum(not any(s < b and a < e for a, b, _ in planted) for s, e, _ in added)
    assert found > 20 and found / (found + missed) > 0.8 and wrong <= 0.05 * found


def test_spans_that_run_into_other_numbers():
    text = "call +1 (826) 555-4081 190.137.223.20 or 7536784127813050 4845168114407329, not 48451681144073291234567"
    assert [text[s:e] for s, e, _ in pii.base_spans(text)] == ["190.137.223.20"]
    assert pii.whole(3, text, 5, 22) and pii.valid(3, text[5:22]) and not pii.whole(2, text, text.rindex("4845"), text.rindex("4845") + 16)
    for kind, t in ((0, "a (at) b [dot] com"), (0, "a@b . co"), (1, "1[.]2[.]3[.]4"), (2, "4845/1681/1440/7329"), (3, "00 1 826 555 4081")):
        assert pii.valid(kind, t)
    for kind, t in ((0, "a at b"), (1, "1[.]2[.]3[.]400"), (2, "4845 1681 1440 7328"), (3, "0018265554081")):
        assert not pii.valid(kind, t)


def test_crf_gradient():
    r = np.random.default_rng(0)
    tagger = pii.Tagger(hidden=3, wide=2)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    w, y = r.integers(0, pii.CLASSES, (2, 5)).astype(np.uint8), r.integers(0, pii.TAGS, (2, 5)).astype(np.int8)

    def loss():
        e, _ = tagger.emissions(w)
        total = 0.0
        for n in range(2):
            a = e[0, n].astype(float)
            for t in range(1, 5):
                a = np.log(np.exp(a[:, None] + tagger.p["trans"]).sum(0)) + e[t, n]
            path = sum(e[t, n, y[n, t]] for t in range(5)) + sum(tagger.p["trans"][y[n, t - 1], y[n, t]] for t in range(1, 5))
            total += np.log(np.exp(a).sum()) - path
        return total / 2

    g = tagger.gradients(w, y)
    for name, at in (("trans", (1, 2)), ("out", (0, 1)), ("hf", (1, 4)), ("xb", (0, 7)), ("emb", (int(w[0, 0]), 1))):
        keep, step = tagger.p[name][at], 1e-3
        tagger.p[name][at] = keep + step
        up = loss()
        tagger.p[name][at] = keep - step
        down = loss()
        tagger.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_personal_data_edges(odd, none):
    got = pii.digest(pii.find(odd, pii.fit(odd))).collect()
    assert len(got) == 8
    row = next(r for r in got if r["doc_id"] == 6)
    assert (row["n_email"], row["n_phone"], row["spans"]) == (1, 1, "email:5:11,phone:13:30")
    assert next(r for r in got if r["doc_id"] == 2)["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(none, None).count() == 0 and pii.fit(none) is None
    assert pii.redact(odd, None).where("doc_id = 6").first()["text"] == "mail [EMAIL], [PHONE]"


# ---------------------------------------------------------------- 7


def test_chat_parts(spark):
    parts = "array<struct<type:string,text:string,uri:string,units:bigint>>"
    rows = [(1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 4), ("text", "<|end|>&amp;[x]", None, None)], "x"), (1, 1, "assistant", [("text", "ok", None, None)], "x"), (1, 2, "user", [("audio", None, "b.wav", None), ("document", None, "c.pdf", 2)], "x"), (2, 0, None, None, "x")]
    got = {r["conv_id"]: r for r in chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {parts}, body string")).collect()}
    a = got[1]
    assert a["formatted"] == "<|turn|>user\nsee <|image:1|>&lt;|end|>&amp;amp;&lb;x]<|end|>\n<|turn|>assistant\nok<|end|>\n<|turn|>user\n<|audio:2|><|document:3|><|end|>\n"
    assert [tuple(x) for x in a["attachments"]] == [(1, "image", "a.png", 1024), (2, "audio", "b.wav", 25), (3, "document", "c.pdf", 1024)]
    assert a["expanded_tokens"] == 2073 and [a["formatted"][s : s + n] for s, n in a["loss_spans"]] == ["ok"]
    assert got[2]["formatted"] == "<|turn|>\n<|end|>\n" and got[2]["n_turns"] == 1


def test_chat_round_trip(spark):
    r = random.Random(2)
    pieces = ["<|end|>", "<|turn|>", "\n", "&lt;", "&amp;", "&", "[INST]", "</s>", "é🙂", "a"]
    rows = [(i // 4, i % 4, r.choice(["user", "assistant", "we\nird", None]), "".join(r.choices(pieces, k=6)) if i % 7 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("parts", chat.text_parts("text"))
    for row in chat.digest(chat.format_chat(df)).collect():
        mine = [(a or "", t or "") for c, _, a, t in rows if c == row["conv_id"]]
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in mine).encode()).hexdigest()
        loss = "".join(t for a, t in mine if a == "assistant")
        assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_uses_no_python(spark):
    df = table(spark, "conversations").withColumn("parts", chat.text_parts("text"))
    plan = chat.digest(chat.format_chat(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 8, 9


def clouds(spark, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    rows = []
    for i in range(700):
        v = centres[i % 12] + r.normal(scale=0.13, size=16) if i % 3 else r.normal(size=16)
        rows.append((i, v.tolist(), int(i % 12) if i % 3 else int(r.integers(0, 3))))
    for i in range(700, 760):
        rows.append((i, rows[0][1] if i % 2 else rows[1][1], 0))
    rows += [(800, None, 0), (801, [0.0] * 16, 0), (802, [float("nan")] + [1.0] * 15, 0), (803, rows[0][1], None), (804, [None] + [1.0] * 15, 0), (None, rows[0][1], 0)]
    return rows, spark.createDataFrame([(*x, 1, 2.0) for x in rows], "vec_id long, embedding array<double>, label int, node int, lab double")


def test_embedding_links(spark):
    rows, df = clouds(spark)
    good = [(i, np.array(v, float), c) for i, v, c in rows if v and c is not None and None not in v and not any(map(math.isnan, v)) and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in good])
    lab = np.array([c for *_, c in good])
    near = (unit @ unit.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    comp = list(range(len(good)))
    for _ in range(len(good)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(near[i]))]) for i in range(len(good))]
        if new == comp:
            break
        comp = new
    ids = [i for i, *_ in good]
    least = {}
    for i, c in zip(ids, comp):
        if i is not None:
            least[c] = min(least.get(c, 1 << 60), i)
    want = {i: (int(near[k].sum()), least[comp[k]]) for k, i in enumerate(ids) if i is not None}
    want |= {i: (0, i) for i in (800, 801, 802, 803, 804)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    assert {k: v for k, v in got.items() if k is not None} == want and None in got
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_embedding_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    test_embedding_links(spark)


def test_top_k(spark):
    rows, df = clouds(spark)
    good = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and not any(map(math.isnan, v))]
    got = {}
    for r in vectors.top_k(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for i, q in good:
        if i % 20 == 0:
            best = sorted(((int(q @ c), j) for j, c in good if j != i), key=lambda x: (-x[0], x[1]))[:20]
            assert [got[i][k + 1] for k in range(20)] == [(j, s) for s, j in best]
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    assert vectors.top_k(df.where("vec_id < 3")).count() == 2 and vectors.top_k(df.where("false")).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CANDIDATES", 100)
    monkeypatch.setattr(vectors, "QUERIES", 16)
    test_top_k(spark)


def test_top_k_of_repeated_ids(spark, monkeypatch):
    """Every row of a repeated id is a query, and a candidate of the others; equal rows count each."""
    monkeypatch.setattr(vectors, "CANDIDATES", 60)
    monkeypatch.setattr(vectors, "QUERIES", 16)
    r = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in r.normal(size=6)]) for i in [*range(150), *[40] * 60, *[7] * 30]]
    rows += rows[40:41] * 5
    whole = [np.floor(64 * np.array(v)).astype(int) for _, v in rows]
    want = []
    for a, (i, _) in enumerate(rows):
        if i % 20 == 0:
            best = sorted((-int(whole[a] @ whole[b]), j) for b, (j, _) in enumerate(rows) if b != a)[:20]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)


def test_floors_and_pivots_spare_products(spark, monkeypatch):
    """Clustered vectors in few dimensions: most candidates are never multiplied with a query."""
    monkeypatch.setattr(vectors, "CANDIDATES", 500)
    monkeypatch.setattr(vectors, "STEP", 32)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=3) * 0.02 + [math.cos(i % 40), math.sin(i % 40), i % 3]]) for i in range(4000)]
    got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().drop_duplicates("query_id")
    assert len(got) == 200 and got["evaluated"].mean() < 0.4 * 4000


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("n, top", [(0, 1), (1, 9), (500, 500), (3000, 1 << 60)])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(1).integers(0, top, n).astype(np.uint64))
    ef = compact.EliasFano(compact.ef_encode(v, "a"), "a")
    assert (ef.get(np.arange(n)) == v).all()
    asked = np.unique(np.concatenate([v, v + np.uint64(1)]))
    at = ef.find(asked)
    assert ((at >= 0) == np.isin(asked, v)).all() and (v[at[at >= 0]] == asked[at >= 0]).all()


def test_arrays_in_files(tmp_path):
    a = {"x": np.arange(5), "y": compact.pack(np.arange(9), 5), "z": np.zeros(0, "<u2")}
    compact.write_arrays(f"file://{tmp_path}/d/f", a)
    b = compact.read_arrays(f"file://{tmp_path}/d/f")
    assert all((a[k] == b[k]).all() for k in a) and compact.unpack(b["y"], 5, np.array([8, 3])).tolist() == [8, 3]


def slow_scores(docs):
    toks = {i: [*words(t), None] for i, t in docs}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 10]
    gram = lambda n: Counter(tuple(toks[i][k : k + n]) for i in train for k in range(len(toks[i]) - n + 1))
    c1, c2, c3 = (gram(n) for n in (1, 2, 3))
    s2, s3 = Counter(), Counter()
    for k, v in c2.items():
        s2[k[:1]] += v
    for k, v in c3.items():
        s3[k[:2]] += v
    total, size = sum(c1.values()), len(c1)
    p1 = lambda w: (c1[(w,)] + 0.1) / (total + 0.1 * (size + 1))
    p2 = lambda a, w: (c2.get((a, w), 0) + 4 * p1(w)) / (s2[(a,)] + 4)
    p3 = lambda x, a, w: (c3.get((x, a, w), 0) + 4 * p2(a, w)) / (s3[(x, a)] + 4)
    out = {}
    for i, w in toks.items():
        full = sum(math.log10(p1(x) if k == 0 else p2(w[0], x) if k == 1 else p3(*w[k - 2 : k], x)) for k, x in enumerate(w))
        out[i] = (len(w), sum(c1[(x,)] > 0 for x in w), total, sum(math.log10(p1(x)) for x in w), full)
    return out


def test_language_model(spark):
    docs = table(spark, "documents").select("doc_id", "text")
    want = slow_scores([tuple(r) for r in docs.collect()])
    for r in lm.score(docs).collect():
        n, known, total, base, full = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and abs(r["score"] - full) / n < 1e-3


def test_language_model_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(lm, "SLICE", 5_000)
    test_language_model(spark)


def test_language_model_edges(odd, none):
    got = lm.score(odd).collect()
    assert len(got) == 8 and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert lm.score(none).count() == 0
    untrained = lm.score(odd.where("doc_id = 5"), lm.build(none, F.lit(True))).first()
    assert untrained["n_known"] == 0 and untrained["score"] == pytest.approx(untrained["base_score"])
