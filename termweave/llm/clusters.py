"""Centroid clustering with ns-bounds: exact rounds of Lloyd's algorithm that leave out most distances.

Every vector keeps, for each centroid, its last evaluated distance and the round of that evaluation;
the driver keeps the centroids of all rounds.  A bound is the kept distance loosened by the norm of the
whole way the centroid has gone since, from its place then to its place now, which the triangle
inequality allows and which is never more than the sum of its ways round by round.  Where the own
centroid's upper bound is not below another's lower bound, the own distance is evaluated anew, then
those that still fail.  Distances are whole numbers and compared as such; bounds carry a margin for
rounding, so no round differs from a full scan.  Sums move with the vectors that change their cluster.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out;
rows that repeat are clustered each; null ids are clustered but start no centroid unless ids run out;
equal distances go to the smaller number; with fewer vectors than centroids each is one; an empty table
gives an empty result; components of 2**27 or more after scaling, whose distances would not fit into 64
bits, raise an error.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, lean, save, scratch
from .vectors import matrix, usable, whole

#: Relative margin of bounds, far above the rounding of a square root and a sum.
MARGIN = 1e-9
STATE = "vec_id long, x array<int>, cluster int, before int, own long, evaluated int, seen binary, far binary"


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, whole numbers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _assigner(history: np.ndarray):
    """A function over batches of state rows that assigns them to the last of the centroids, history[round, centroid, component]."""
    t, k = len(history) - 1, history.shape[1]
    now = history[t]
    gone = np.sqrt(((history - now) ** 2).sum(2).astype(float)) * (1 + MARGIN)  # by round of evaluation and centroid

    def run(batches):
        each = np.arange(k)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1)).astype(np.int64)
            n = len(x)
            row = np.arange(n)
            before = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            if t == 0:
                d2 = np.stack([_distances(x, c) for c in now], 1)
                seen, work = np.zeros((n, k), np.uint8), np.full(n, k)
            else:
                seen = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(n, k).copy()
                d2 = np.frombuffer(b"".join(b.column(7).to_pylist()), "<i8").reshape(n, k).copy()
                work = np.zeros(n, np.int64)

                def evaluate(i, j):
                    d2[i, j] = _distances(x[i], now[j])
                    seen[i, j] = t
                    np.add.at(work, i, 1)

                # a distance evaluated this round is exact: it has gone no way
                low = np.sqrt(d2.astype(float)) * (1 - MARGIN) - gone[seen, each]
                up = np.sqrt(d2[row, before].astype(float)) * (1 + MARGIN) + gone[seen[row, before], before]
                other = each != before[:, None]
                i = np.flatnonzero(((low <= up[:, None]) & other).any(1))
                evaluate(i, before[i])
                up = np.sqrt(d2[i, before[i]].astype(float)) * (1 + MARGIN)
                a, j = np.nonzero((low[i] <= up[:, None]) & other[i])
                evaluate(i[a], j)
            exact = np.where(seen == t, d2, np.iinfo(np.int64).max)
            cluster = exact.argmin(1)  # the first of equal ones
            own = exact[row, cluster]
            same = np.flatnonzero(~(seen == t).any(1))  # every bound held, the own distance was not asked for
            cluster[same] = before[same]
            own[same] = -1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(own), pa.array(work.astype(np.int32)), pa.array([r.tobytes() for r in seen], pa.binary()), pa.array([r.tobytes() for r in d2], pa.binary())],
                ["vec_id", "x", "cluster", "before", "own", "evaluated", "seen", "far"],
            )

    return run


def _moves(k: int):
    """A function over batches (x, cluster, before): what the vectors that moved add to each cluster's count and sums."""

    def run(batches):
        for b in batches:
            x = matrix(b.column(0)).astype(np.int64)
            if not len(x):
                continue
            total = np.zeros((k, x.shape[1] + 1), np.int64)
            one = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)
            np.add.at(total, b.column(1).to_numpy(), one)
            before = b.column(2).to_numpy()
            np.subtract.at(total, before[before >= 0], one[before >= 0])
            c, d = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[c, d])], ["c", "d", "n"])

    return run


def _exact(history: np.ndarray):
    """A function over batches (vec_id, x, cluster, own): the distances that were not asked for are evaluated."""

    def run(batches):
        for b in batches:
            x, cluster = matrix(b.column(1)).astype(np.int64), b.column(2).to_numpy()
            d = _distances(x, history[-1][cluster]) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d), b.column(3)], ["vec_id", "cluster", "distance", "evaluated"])

    return run


def assign(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256; and evaluated, the number
    of distances that the last round evaluated for the vector, of k.

    Components are floor(scale * x).  Centroids start as the k vectors with the smallest sha256 of
    `seed:id` (of equal ones, the smaller vector); each round assigns all vectors and replaces every
    centroid that has some by the floor of their mean; then they are assigned once more.
    """
    with scratch(vectors.sparkSession):
        return keep(_assign(vectors, k, rounds, seed, width, scale, id_col, vec_col), "clusters")


def _assign(vectors: DataFrame, k: int, rounds: int, seed: int, width: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(usable("v") & (F.size("v") == width))
    small = F.forall(whole("v", scale), lambda x: F.abs(x) < 1 << 27)
    x = F.when(small, whole("v", scale).cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for exact 64-bit distances")))
    none = [F.lit(v).cast(t).alias(c) for c, t, v in (("cluster", "int", -1), ("before", "int", -1), ("own", "long", -1), ("evaluated", "int", 0), ("seen", "binary", b""), ("far", "binary", b""))]
    state = save(rows.select("vec_id", x.alias("x"), *none), "start")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.select("x", named.alias("h")).orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, evaluated int")
    history = np.array([[r["x"] for r in first]], np.int64)
    k = len(first)
    totals = [[0] * (width + 1) for _ in range(k)]
    for _ in range(rounds):
        state = save(state.mapInArrow(lean(_assigner(history)), STATE), "round")
        moved = state.where("cluster <> before").select("x", "cluster", "before").mapInArrow(lean(_moves(k)), "c int, d int, n long")
        for r in moved.groupBy("c", "d").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # k times width + 1 at most
            totals[r["c"]][r["d"]] += int(r["n"])
        last = history[-1].tolist()
        history = np.concatenate([history, [[[s // t[0] for s in t[1:]] if t[0] else own for t, own in zip(totals, last)]]])
    state = state.mapInArrow(lean(_assigner(history)), STATE).select("vec_id", "x", "cluster", "evaluated")
    done = save(state.mapInArrow(lean(_exact(history)), "vec_id long, cluster int, distance long, evaluated int"), "assigned")
    per = done.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(history[-1].tolist())]
    per = per.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    per = per.crossJoin(done.agg(F.sum("distance").alias("inertia")))  # one row
    return done.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "evaluated")


def _round_sql(n: int) -> str:
    """Assignment number n to the centroids c{n-1}, and the centroids after it."""
    return f"""
, d{n} AS (
  SELECT v.r, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{n - 1} AS c USING (i) GROUP BY v.r, c.c
), a{n} AS MATERIALIZED (
  SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
), m{n} AS (
  SELECT a.c, v.i, CAST(sum(v.x) AS HUGEINT) AS s, count(*) AS n FROM a{n} AS a JOIN v USING (r) GROUP BY a.c, v.i
), c{n} AS MATERIALIZED (
  SELECT c.c, c.i, coalesce(CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT), c.x) AS x FROM c{n - 1} AS c LEFT JOIN m{n} AS m ON m.c = c.c AND m.i = c.i
)"""


ASSIGN_SQL = (
    """
WITH e AS (
  SELECT vec_id, row_number() OVER () AS r, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS xs FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), v AS MATERIALIZED (
  SELECT r, unnest(range(1, 65)) AS i, unnest(xs) AS x FROM e
), s AS (
  SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, xs) - 1 AS c FROM e QUALIFY c < 16
), c0 AS MATERIALIZED (
  SELECT s.c, v.i, v.x FROM s JOIN v USING (r)
)"""
    + "".join(map(_round_sql, (1, 2, 3, 4)))
    + """
, h AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c
)
SELECT e.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a4 AS a JOIN e USING (r) JOIN h ON h.c = a.c
"""
)
