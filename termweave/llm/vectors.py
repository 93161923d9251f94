"""Embedding near-duplicates by sign hashing, and exact top-k search by pivot-table elimination."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import components, hot_join, keep, lean, least_members, save, scratch

#: Vectors of one bucket that are compared in one group at most; larger buckets are split into blocks.
BLOCK = 1024
MISS = 1e-6


def usable(col: str) -> Column:
    """Not null and without null or non-finite components."""
    fine = F.forall(col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(F.col(col).isNotNull() & fine, F.lit(False))


def matrix(col, width: int | None = None) -> np.ndarray:
    """An Arrow list column as a double matrix, shorter rows padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False).astype(float)[offs[0] : offs[-1]] if len(col) else np.zeros(0)
    n = np.diff(offs) if len(col) else np.zeros(0, int)
    width = max(int(n.max()) if len(n) else 0, width or 0)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


# ---------------------------------------------------------------- near-duplicates


def table_sizes(n: int, least: float) -> tuple[int, int]:
    """Bits of a code and number of tables: buckets stay small as n grows, a link is missed once in 1/MISS."""
    bits = min(24, max(8, math.ceil(math.log2(max(1, n) / 64))))
    p = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - p))


def _codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], tables * bits))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _hashed(bits: int, tables: int, seed: int, with_vectors: bool):
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                x = matrix(part.column(3))
                width = np.diff(part.column(3).offsets.to_numpy())
                codes = np.empty((len(x), tables), np.int64)
                for w in np.unique(width):  # vectors of another length have planes of their own
                    codes[width == w] = _codes(x[width == w, :w], bits, tables, seed)
                at = np.repeat(np.arange(len(x)), tables)
                table = np.tile(np.arange(tables), len(x))
                cols = [pa.array(codes.ravel()), pa.array(table), pa.array(width[at].astype(np.int64))]
                idx = pa.array(at)
                cols += [part.column(k).take(idx) for k in ((0, 1, 2) if with_vectors else (1,))]
                names = ["code", "t", "width"] + (["node", "lab", "mult"] if with_vectors else ["lab"])
                if with_vectors:
                    raw = [r.tobytes() for r in x]
                    cols.append(pa.array([raw[i][: 8 * width[i]] for i in range(len(x))], pa.binary()).take(idx))
                    names.append("vec")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _compare(least: float, bits: int, tables: int, seed: int):
    """A function over rows sorted by bucket and block pair: each vector's new links and its least linked node."""

    def bucket(t, p, q, node, mult, blk, vec):
        x = np.frombuffer(b"".join(vec)).reshape(len(vec), -1)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        sides = (np.flatnonzero(blk == p), np.flatnonzero(blk == q))
        cos = unit[sides[0]] @ unit[sides[1]].T
        i, j = np.nonzero(cos >= least)
        i, j = sides[0][i], sides[1][j]
        if p == q:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return None
        links, label = np.zeros(len(node), np.int64), node.copy()
        codes = np.zeros((len(node), tables), np.int64)
        some = np.unique(np.concatenate([i, j]))
        codes[some] = _codes(x[some], bits, tables, seed)
        for lo in range(0, len(i), 1 << 16):  # a pair counts in the first table where it meets
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            new = (codes[a] == codes[b]).argmax(1) == t
            np.add.at(links, a[new], mult[b[new]])
            np.add.at(links, b[new], mult[a[new]])
        while True:
            before = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            if (before == label).all():
                break
        return node[some], links[some], label[some]

    def run(batches):
        held, key = [], None

        def close():
            if len(held) < 2:
                return None
            t, p, q = key[0], key[4], key[5]
            cols = list(zip(*held))
            return bucket(t, p, q, np.array(cols[0], np.int64), np.array(cols[1], np.int64), np.array(cols[2]), cols[3])

        for b in batches:
            out = []
            cols = [b.column(k).to_pylist() for k in range(10)]
            for row in zip(*cols):
                if row[:6] != key:
                    got = close()
                    if got is not None:
                        out.append(got)
                    held, key = [], row[:6]
                held.append(row[6:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links", "root"])
        got = close()
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["node", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, seed: int = 23, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links join equal labels with cosine >= least.

    Equal vectors of a label are one class with its number of rows, so copies are never expanded.
    Classes that share a code in one of several tables are compared exactly, in blocks; a pair counts
    in the first table where it meets, so only a count and one edge leave each bucket.

    Cases: a null label, a null or zero vector, or null or non-finite components link with nothing;
    vectors of different length neither; a null id keeps its row and counts as a partner, but is never
    a component's id unless alone (null then, kept); an empty table gives an empty result.
    """
    with scratch(vectors.sparkSession):
        return keep(_near_duplicates(vectors, least, seed, id_col, vec_col, label_col), "near-duplicates")


def _near_duplicates(vectors: DataFrame, least: float, seed: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    fine = usable("vec") & F.exists("vec", lambda x: x != 0) & F.col("label").isNotNull()
    node = F.when(fine, F.xxhash64(F.lit(seed), "label", F.transform("vec", lambda x: x.cast("double") + F.lit(0.0))))
    rows = rows.withColumn("node", node)
    classes = rows.where("node is not null").groupBy("node").agg(F.xxhash64(F.first("label")).alias("lab"), F.count("*").alias("mult"), F.first("vec").alias("vec"), F.min("vec_id").alias("first"))
    classes = save(classes, "classes")
    bits, tables = table_sizes(classes.count(), least)
    base = classes.select("node", "lab", "mult", "vec")
    codes = base.mapInArrow(lean(_hashed(bits, tables, seed, False)), "code long, t long, width long, lab long")
    key = ["t", "code", "lab", "width"]
    hot = save(codes.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key, F.ceil(F.col("count") / BLOCK).alias("blocks")), "hot")
    hashed = base.mapInArrow(lean(_hashed(bits, tables, seed, True)), "code long, t long, width long, node long, lab long, mult long, vec binary")
    dealt = hashed.join(hot, key, "left").withColumn("blk", F.pmod(F.xxhash64("node", F.lit(seed)), F.coalesce("blocks", F.lit(1))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select(*key, F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), "node", "mult", "blk", "vec")
    order = [*key, "p", "q"]
    spread = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = dealt.repartition(spread, *order).sortWithinPartitions(*order).mapInArrow(lean(_compare(least, bits, tables, seed)), "node long, links long, root long")
    found = save(found, "met")
    comp = components(found.select("node", "root"), "node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    low = least_members(comp, classes.select("node", "first"))
    per = classes.select("node", "first", "mult").join(counts, "node", "left").join(low, "node", "left")
    per = save(per.select("node", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("least", "first").alias("low")), "named")
    out = hot_join(save(rows.select("vec_id", "node"), "nodes"), per, "node")  # copies of one vector share a node, unusable ones have none
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


# ---------------------------------------------------------------- exact top-k


#: Pivots, those of the first sieve, queries and candidates of a block, and candidates evaluated at first.
PIVOTS, SIEVE, QUERIES, CANDIDATES, STEP = 32, 8, 2048, 8192, 256


def whole(col: str, scale: int) -> Column:
    return F.transform(col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rid, vec_id, x and d, the distances of every vector (rid, vec_id, x) to all pivots; shorter vectors count as padded."""

    def run(batches):
        for b in batches:
            m = matrix(b.column(2), pivots.shape[1])
            piv = np.zeros((len(pivots), m.shape[1]))
            piv[:, : pivots.shape[1]] = pivots
            d = np.sqrt(np.maximum(0, (m * m).sum(1)[:, None] + (piv * piv).sum(1) - 2 * m @ piv.T)).astype("<f4")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in d], pa.binary())], ["rid", "vec_id", "x", "d"])

    return rows.select("rid", "vec_id", "x").mapInArrow(lean(run), "rid long, vec_id long, x array<bigint>, d binary")


def _search(k: int, pivots: int):
    """A function over one block of candidates and queries: each query's best k in the block, and how many it evaluated.

    |q - c| is at least the largest difference of their distances to a pivot, which bounds the inner
    product from above.  Candidates whose bound by the first pivots falls below the query's floor (the
    k-th score it has elsewhere) go at once; the others are bounded by all pivots and evaluated in the
    order of that bound until it falls below the k-th score found.
    """

    def run(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("ask").to_pylist(), bool)
        ids, rids = group.column("vec_id").to_numpy(), group.column("rid").to_numpy()
        exact = matrix(group.column("x"))
        d = np.frombuffer(b"".join(group.column("d").to_pylist()), "<f4").reshape(len(ids), pivots)
        floor = group.column("floor").to_numpy(zero_copy_only=False).astype(float)[asks]
        c_id, c, q_id, q, c_rid, q_rid = ids[~asks], exact[~asks], ids[asks], exact[asks], rids[~asks], rids[asks]
        order = np.argsort(c_id, kind="stable")
        c_id, c, c_rid = c_id[order], c[order], c_rid[order]
        to_c, to_q = np.ascontiguousarray(d[~asks][order].T), d[asks].T
        most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1]
        c2, q2 = (c * c).sum(1), (q * q).sum(1)
        root_c, root_q = np.sqrt(c2), np.sqrt(q2)
        exact_kind = np.float32 if most < 2**24 else float if most < 2**53 else np.int64  # sums stay whole numbers
        c, q = c.astype(exact_kind), q.astype(exact_kind)

        def bounds(n, some, first, last, apart):
            """The largest distance to pivots first..last differs by, and the bound it gives."""
            for p in range(first, last):
                np.maximum(apart, np.abs(to_c[p][some] - to_q[p, n]), out=apart)
            low = np.maximum(0, apart - 1e-5 * (root_c[some] + root_q[n]) - 1e-5).astype(float)  # rounding of the distances
            return (c2[some] + q2[n] - low * low) / 2 + 1e-9 * (c2[some] + q2[n]) + 1e-6

        out: list[list] = [[], [], [], [], []]
        for n in range(len(q)):
            floor_n = floor[n] if floor[n] == floor[n] else -np.inf
            every = slice(None)
            apart = np.abs(to_c[0] - to_q[0, n])
            some = np.flatnonzero((bounds(n, every, 1, min(SIEVE, pivots), apart) >= floor_n) & (c_rid != q_rid[n]))
            bound = bounds(n, some, min(SIEVE, pivots), pivots, apart[some])
            best_s, best_i = np.zeros(0, exact_kind), np.zeros(0, np.int64)
            size, todo, seen = STEP, np.flatnonzero(bound >= floor_n), 0
            while len(todo):
                if len(todo) > size:  # the largest bounds come next
                    cut = np.argpartition(-bound[todo], size)
                    at, todo = todo[cut[:size]], todo[cut[size:]]
                else:
                    at, todo = todo, todo[:0]
                seen += len(at)
                at = some[at]
                s = c[at] @ q[n]
                if len(best_s) >= k:
                    at, s = at[s >= best_s[k - 1]], s[s >= best_s[k - 1]]
                best_s, best_i = np.concatenate([best_s, s]), np.concatenate([best_i, c_id[at]])
                top = np.lexsort((best_i, -best_s))[:k]
                best_s, best_i = best_s[top], best_i[top]
                if len(best_s) >= k:
                    todo = todo[bound[todo] >= best_s[k - 1]]  # none of the others can be among the best
                size *= 4
            out[0] += [q_id[n]] * (len(best_i) + 1)
            out[1] += [*best_i.tolist(), None]
            out[2] += [*(int(s) for s in best_s), None]
            out[3] += [0] * len(best_i) + [seen]  # one row tells the work
            out[4] += [q_rid[n]] * (len(best_i) + 1)
        return pa.table({"rid": pa.array(out[4], pa.int64()), "query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64()), "evaluated": pa.array(out[3], pa.int64())})

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product with each query; and evaluated,
    the number of candidates whose product with the query was formed.

    Queries are the rows whose id is divisible by `every`; candidates all rows but the query's own.
    Distances to pivots, the PIVOTS rows with the least hash of their id, are a table made once.  Both
    sides are dealt into blocks of bounded size.  Every query meets one block of candidates first; the
    k-th score found there is its floor in all other blocks, each pair of which is one group.

    Cases: a null vector, null or non-finite components, or a null id take no part; an id that several
    rows hold is asked once for each, and each finds the others; shorter vectors count as padded with zeros;
    equal scores go to the smaller id; an empty table gives an empty result.
    """
    with scratch(vectors.sparkSession):
        return keep(_top_k(vectors, k, every, scale, id_col, vec_col), "top-k")


def _top_k(vectors: DataFrame, k: int, every: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    # rows are told apart by a number that is written with them: ids may repeat
    rows = save(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", whole("v", scale).alias("x")), "whole")
    picked = [r["x"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()]
    width = max(map(len, picked), default=0)
    pivots = np.array([x + [0] * (width - len(x)) for x in picked], float).reshape(len(picked), width)
    table = save(pivot_table(rows, pivots), "pivots")
    asks = save(table.where(F.col("vec_id") % every == 0), "asks")
    c_blocks, q_blocks = max(1, -(-table.count() // CANDIDATES)), max(1, -(-asks.count() // QUERIES))
    block = lambda blocks: F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int")
    each = lambda first, last: F.explode(F.sequence(F.lit(first), F.lit(last - 1)))
    none = F.lit(None).cast("long").alias("floor")
    left = table.select("rid", "vec_id", "x", "d", F.lit(False).alias("ask"), none, block(c_blocks).alias("cb"), each(0, q_blocks).alias("qb"))

    def met(first: int, last: int, asked: DataFrame) -> DataFrame:
        right = asked.select("rid", "vec_id", "x", "d", F.lit(True).alias("ask"), "floor", each(first, last).alias("cb"), block(q_blocks).alias("qb"))
        own = left.where(F.col("cb").between(first, last - 1)).unionByName(right)
        return save(own.groupBy("cb", "qb").applyInArrow(_search(k, len(pivots)), "rid long, query_id long, vec_id long, score long, evaluated long"), "best")

    best = met(0, 1, asks.withColumn("floor", none))
    if c_blocks > 1:
        floors = best.where("vec_id is not null").groupBy("rid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
        told = asks.join(floors.select("rid", "floor"), "rid", "left")
        best = best.unionByName(met(1, c_blocks, told))
    work = best.groupBy("rid").agg(F.sum("evaluated").alias("evaluated"))
    ranked = best.where("vec_id is not null").withColumn("rank", F.row_number().over(W.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).drop("evaluated").join(work, "rid").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "evaluated")


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
