"""MinHash near-duplicates by an LSH forest.

Equal shingle sets collapse to one class first.  Every class has TREES signatures of DEPTH min-hashes;
in each tree the classes are sorted by signature (range partitions, so a crowded region spreads over
many tasks).  Two classes are candidates where the deepest prefix they share, of at least the least
depth, is shared by at most REGION classes: the depth adapts to how crowded a region is.  In addition
each class meets its NEAR next ones with that least prefix, whatever the region's size.  Rows at the
edges of partitions are scanned again together with their neighbours.  Candidates are confirmed on
full sets: first the three that most trees propose for each class, then all others whose ends are not
yet in one component, since a confirmed link inside a component changes nothing.  Where a region is so
crowded that its classes met only some of the others, those outside its main component are compared
with all members of it, in blocks, until no link is new, and then all of them with each other.

Cases: null and empty texts have an empty set and link with nothing; a text of fewer words than a
shingle is one shingle; texts of any length are taken whole; a null id keeps its row, with a null
component, kept; repeated rows and ids share their texts' classes; an empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import components, hot_join, keep, lean, least_members, save, scratch
from .kernels import U64, mix, slices, text_bytes, words

TREES, DEPTH, REGION, NEAR, PARTNERS = 20, 12, 24, 3, 3
#: Documents whose ids are broadcast at most; beyond it the texts are shuffled.
BROADCAST_ROWS = 1_000_000


def shingle_sets(col, size: int):
    """The sorted distinct shingle hashes of each text of a column, in order."""
    raw, offs = text_bytes(col)
    for i, j in slices(offs):
        w, at = words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        whole = np.zeros(max(0, len(w) - size + 1), U64)
        for k in range(size):
            whole = mix(whole + w[k : k + len(whole)] * U64(2 * k + 3))
        for s, e in zip(at[:-1], at[1:]):
            if e - s >= size:
                yield np.unique(whole[s : e - size + 1])
            elif e > s:  # the whole sequence as one, apart from all longer shingles
                x = np.zeros(1, U64)
                for k in range(s, e):
                    x = mix(x + w[k : k + 1] * U64(2 * (k - s) + 3))
                yield mix(x + U64(e - s))
            else:
                yield w[:0]


def multipliers(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def signature(shingles: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The least of each of many 32-bit hashes of the shingles."""
    x = (shingles >> U64(32)).astype(np.uint32)
    step = max(1, (1 << 17) // len(x))
    return np.concatenate([(a[k : k + step, None] * x).min(1) for k in range(0, len(a), step)])


def class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, size: int, seed: int, id_col: str, text_col: str, carry: tuple = ()) -> DataFrame:
    """doc_id, n (set size), node (class of equal sets, null if empty), sig, and columns to carry."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        a = multipliers(seed)
        for b in batches:
            n, node, sig = [], [], []
            for s in shingle_sets(b.column(1), size):
                n.append(len(s))
                node.append(class_id(s) if len(s) else None)
                sig.append(signature(s, a).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.binary()), *b.columns[2:]], ["doc_id", "n", "node", "sig", *carry])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry).mapInArrow(lean(run), f"doc_id {kind}, n long, node long, sig binary{more}")


def _pairs(g, key, n, least: int, share: tuple[int, int], first: int, last: int):
    """Candidate pairs (i, j) with first <= i < last among rows sorted by (g, key)."""
    same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])[:, None]
    near = np.logical_and.accumulate(same, axis=1).sum(1)  # shared prefix of rows i and i + 1
    crowd = np.empty((key.shape[1] + 1, len(g)), np.int32)
    for d in range(least, key.shape[1] + 1):
        run = np.concatenate([[0], np.cumsum(near < d)])
        crowd[d] = np.bincount(run)[run]
    lcp = near
    for far in range(1, min(REGION, len(g))):
        if far > 1:
            lcp = np.minimum(lcp[:-1], near[far - 1 :])
        i = np.flatnonzero(lcp >= least)
        if not len(i):
            return
        if far > NEAR:
            i = i[crowd[lcp[i], i] <= REGION]
        i = i[(i >= first) & (i < last)]
        j = i + far
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        fits = small * share[1] >= large * share[0]  # no more similar than their sizes allow
        yield i[fits], j[fits]


def _scan(least: int, share: tuple[int, int], edges: bool):
    """A function over sorted rows (g, key, node, n) of a partition: candidate pairs, and its edge rows."""
    halo = REGION + 1
    names = ["part", "g", "key", "a", "b", "n"]

    def out(part, g, key, a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(g, pa.int64()), pa.array(key, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names)

    def run(batches):
        part = TaskContext.get().partitionId()
        g, node, n = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = np.zeros((0, DEPTH), np.uint32)
        head, done, seen = None, 0, 0

        def emit(last):
            got = list(_pairs(g, key, n, least, share, done, last)) if len(g) > 1 else []
            a, b = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, int), np.zeros(0, int))
            lo, hi = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            return out([None] * len(lo), [None] * len(lo), [None] * len(lo), lo, hi, [None] * len(lo))

        def edge(lo, hi, boundary):
            return out(np.full(hi - lo, boundary), g[lo:hi], [k.astype(">u4").tobytes() for k in key[lo:hi]], node[lo:hi], [None] * (hi - lo), n[lo:hi])

        for b in batches:
            if not b.num_rows:
                continue
            g = np.concatenate([g, b.column(0).to_numpy(zero_copy_only=False)])
            key = np.concatenate([key, np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").astype(np.uint32).reshape(-1, DEPTH)])
            node = np.concatenate([node, b.column(2).to_numpy(zero_copy_only=False)])
            n = np.concatenate([n, b.column(3).to_numpy(zero_copy_only=False)])
            seen += b.num_rows
            if head is None and len(g) >= 2 * halo:
                head = edge(0, 2 * halo, part - 1)
            last = len(g) - halo
            if last > done:
                yield emit(last)
                cut = max(0, last - halo)
                g, key, node, n, done = g[cut:], key[cut:], node[cut:], n[cut:], last - cut
        if len(g):
            yield emit(len(g))
            if edges:
                yield head if head is not None else edge(0, len(g), part - 1)
                yield edge(max(0, len(g) - 2 * halo), len(g), part)

    return run


PAIR_ROWS = "part long, g long, key binary, a long, b long, n long"


def least_depth(share: tuple[int, int], miss: float = 5e-5) -> int:
    """The deepest prefix at which a pair of that similarity shares one in some tree, but for `miss`."""
    j, d = share[0] / share[1], DEPTH
    while d > 1 and (1 - j**d) ** TREES > miss:
        d -= 1
    return d


def candidates(reps: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b, trees: pairs of classes (node, n, sig), and how many times they met."""
    spark = reps.sparkSession
    least = least_depth(share)
    width = 4 * DEPTH
    rows = reps.select("node", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"))
    rows = rows.select(F.col("t").cast("long").alias("g"), F.expr(f"substring(sig, t * {width} + 1, {width})").alias("key"), "node", "n")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), TREES * reps.count() // 20_000))
    found = rows.repartitionByRange(parts, "g", "key", "node").sortWithinPartitions("g", "key", "node").mapInArrow(lean(_scan(least, share, True)), PAIR_ROWS)
    found = save(found, "forest")
    # a partition's last rows and the next one's first: a few rows for each partition
    seam = found.where("part is not null").select((F.col("part") * 64 + F.col("g")).alias("g"), "key", F.col("a").alias("node"), "n")
    seam = seam.repartition(parts, "g").sortWithinPartitions("g", "key", "node").mapInArrow(lean(_scan(least, share, False)), PAIR_ROWS)
    both = found.where("part is null").select("a", "b").unionByName(seam.select("a", "b"))
    return both.where("a < b").groupBy("a", "b").agg(F.count("*").alias("trees"))


def _confirm(share: tuple[int, int]):
    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = int(np.isin(x, y, assume_unique=True, kind="sort").sum()) if len(x) + len(y) < 64 else int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(share[1] * both >= share[0] * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def confirm(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(_confirm(share)), "a long, b long")


def crowds(reps: DataFrame, least: int) -> DataFrame:
    """region, t, node: the classes of every region of the least depth that holds more than REGION of them.

    Only there can two classes that share a prefix not have met.
    """
    width = 4 * DEPTH
    rows = reps.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"))
    rows = rows.select("t", "node", F.xxhash64("t", F.expr(f"substring(sig, t * {width} + 1, {4 * least})")).alias("region"))
    crowded = save(rows.groupBy("region").count().where(F.col("count") > REGION).select("region"), "crowded")
    return save(rows.join(crowded, "region").select("region", "t", "node"), "crowds")


def outside(crowd: DataFrame, comp: DataFrame) -> DataFrame:
    """region, t, node, c, component: classes of a crowded region outside its largest component (null unless over REGION)."""
    own = save(crowd.join(comp, "node", "left").select("region", "t", "node", F.coalesce("component", "node").alias("c")), "own")
    sizes = own.groupBy("region", "c").count().where(F.col("count") > REGION)
    top = sizes.groupBy("region").agg(F.max_by("c", F.struct("count", "c")).alias("component"))
    return own.join(top, "region", "left").where("component is null or c <> component")


ASKED_BLOCK, MEMBER_BLOCK = 64, 256


def _against(share: tuple[int, int]):
    """A function over one block of asked classes and one of a component's members: the links between them."""

    def run(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("ask").to_pylist(), bool)
        node = group.column("node").to_numpy()
        sets = [np.frombuffer(v.as_buffer(), "<u8") for v in group.column("shingles")]
        members = np.flatnonzero(~asks)
        a, b = [], []
        if len(members):
            sizes = np.array([len(sets[i]) for i in members])
            whole, starts = np.concatenate([sets[i] for i in members]), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for i in np.flatnonzero(asks):
                x = sets[i]
                hit = x[np.minimum(np.searchsorted(x, whole), len(x) - 1)] == whole
                both = np.add.reduceat(hit.astype(np.int64), starts)
                ok = share[1] * both >= share[0] * (len(x) + sizes - both)
                a += [node[i]] * int(ok.sum())
                b += node[members[ok]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def attach(asked: DataFrame, comp: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b: all links between asked classes (node, component) and the members of that component, block by block."""
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    per = asked.groupBy("component").agg(blocks(F.count("*"), ASKED_BLOCK).alias("na"))
    per = save(per.join(comp.groupBy("component").agg(blocks(F.count("*"), MEMBER_BLOCK).alias("nm")), "component"), "blocks")
    dealt = lambda c, n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int").alias(c)
    each = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    key = ["component", "ab", "mb"]
    left = asked.join(per, "component").select("node", "component", F.lit(True).alias("ask"), dealt("ab", "na"), each("mb", "nm"))
    right = comp.join(per, "component").select("node", "component", F.lit(False).alias("ask"), each("ab", "na"), dealt("mb", "nm"))
    rows = left.unionByName(right).join(sets, "node")
    return rows.select(*key, "ask", "node", "shingles").groupBy(*key).applyInArrow(_against(share), "a long, b long")


def _among(share: tuple[int, int]):
    """A function over two blocks of one region (or one block twice): the links between classes of different components."""

    def run(group: pa.Table) -> pa.Table:
        t, twice = group.column("t")[0].as_py(), group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        node, c, n = (group.column(x).to_numpy() for x in ("node", "c", "n"))
        own = group.column("own").to_numpy() == group.column("lo")[0].as_py()
        order = np.argsort(n, kind="stable")
        node, c, n, own = node[order], c[order], n[order], own[order]
        regions = np.stack(group.column("regions").to_pylist())[order]
        sets = group.column("shingles")
        sets = [np.frombuffer(sets[int(i)].as_buffer(), "<u8") for i in order]
        to = np.arange(len(node)) if twice else np.flatnonzero(~own)
        ends = np.concatenate([[0], np.cumsum(n[to])])
        whole = np.concatenate([sets[i] for i in to]) if len(to) else np.zeros(0, U64)
        a, b = [], []
        for i in np.flatnonzero(own):
            # sizes that allow a link: n * share of the larger at most
            first = np.searchsorted(n[to] * share[1], n[i] * share[0])
            last = np.searchsorted(n[to] * share[0], n[i] * share[1], "right")
            if twice:
                first = max(first, i + 1)
            if first >= last:
                continue
            some = to[first:last]
            ask = (c[some] != c[i]) & ~(regions[some, :t] == regions[i, :t]).any(1)  # a pair counts in its first region
            if not ask.any():
                continue
            x = sets[i]
            part = whole[ends[first] : ends[last]]
            hit = x[np.minimum(np.searchsorted(x, part), len(x) - 1)] == part
            both = np.add.reduceat(hit.astype(np.int64), ends[first:last] - ends[first])
            ok = ask & (share[1] * both >= share[0] * (len(x) + n[some] - both))
            a += [node[i]] * int(ok.sum())
            b += node[some[ok]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def among(rest: DataFrame, reps: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """a, b: all links between classes (region, t, node, c) of one region but different components, block by block."""
    least, width = least_depth(share), 4 * DEPTH
    per = rest.groupBy("region").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    per = save(per.select("region", F.ceil(F.col("m") / MEMBER_BLOCK).cast("int").alias("nb")), "blocks")
    own = rest.join(per, "region").select("region", "t", "node", "c", "nb", F.pmod(F.xxhash64("node", F.lit(7)), F.col("nb")).cast("int").alias("own"))
    rows = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "t", "node", "c", "own")
    named = F.array(*[F.xxhash64(F.lit(t), F.expr(f"substring(sig, {t * width + 1}, {4 * least})")) for t in range(TREES)])
    info = reps.select("node", "n", named.alias("regions")).join(rest.select("node").distinct(), "node", "left_semi").join(sets, "node")
    return rows.join(info, "node").groupBy("region", "lo", "hi").applyInArrow(_among(share), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), seed: int = 11, id_col: str = "doc_id", text_col: str = "text", carry: tuple = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs, and columns to carry; a written table."""
    with scratch(docs.sparkSession):
        return keep(_near_duplicates(docs, size, share, seed, id_col, text_col, carry), "near-duplicates")


def _near_duplicates(docs: DataFrame, size: int, share: tuple[int, int], seed: int, id_col: str, text_col: str, carry: tuple) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    sigs = save(signatures(docs, size, seed, id_col, text_col, carry), "signatures")
    # copies have equal signatures, so any one's will do, and partial sums leave few rows of a hot class
    nodes = sigs.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    whole = save(nodes, "classes")
    classes, reps = whole.select("node", "first"), whole.select("node", "n", "sig")
    pairs = save(candidates(reps, share), "candidates")

    crowd = crowds(reps, least_depth(share))
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowd.select("node")).distinct()
    asked = save(asked.join(classes, "node").select("node", F.col("first").alias("_id")), "asked")
    ids = asked.select("_id").distinct()
    if asked.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)

    def shingled(batches):
        for b in batches:
            rows = [(class_id(s), s.astype("<u8").tobytes()) for s in shingle_sets(b.column(0), size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, "_id", "left_semi")
    sets = save(texts.select("_text").mapInArrow(lean(shingled), "node long, shingles binary").dropDuplicates(["node"]), "sets")

    votes = [F.col("trees").desc(), F.xxhash64("a", "b")]
    ranked = pairs.withColumn("ra", F.row_number().over(W.partitionBy("a").orderBy(*votes))).withColumn("rb", F.row_number().over(W.partitionBy("b").orderBy(*votes)))
    first = (F.col("ra") <= PARTNERS) | (F.col("rb") <= PARTNERS)
    ranked = save(ranked.select("a", "b", first.alias("early")), "ranked")
    links = save(confirm(ranked.where("early").select("a", "b"), sets, share), "links")
    comp = components(links)
    near = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias("c" + x))
    rest = ranked.where("not early").join(near("a"), "a", "left").join(near("b"), "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    more = save(confirm(rest, sets, share), "links")
    if not more.isEmpty():
        comp = components(more.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    joined = lambda more: components(more.unionByName(comp.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    met = False
    while not crowd.isEmpty():  # what a crowded region may have hidden; a class that joins can bring others
        rest = save(outside(crowd, comp), "outside")
        asks = save(rest.where("component is not null").select("node", "component").distinct(), "asks")
        if not asks.isEmpty():
            more = save(attach(asks, comp, sets, share), "links")
            if not more.isEmpty():
                comp = joined(more)
                continue
        if met:
            break
        # all classes outside have met the main component; now they meet each other, once
        more, met = save(among(rest, reps, sets, share), "links"), True
        if more.isEmpty():
            break
        comp = joined(more)
    named = save(classes.join(least_members(comp, classes), "node", "left").select("node", F.coalesce("least", "first").alias("component_id")), "named")
    out = hot_join(sigs.select("doc_id", F.col("n").alias("n_shingles"), "node", *carry), named, "node")  # exact copies share a node, empty texts have none
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", *carry, F.when(F.col("doc_id").isNotNull(), own).cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
