"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Every document has an expected number of copies, its source's target over its source's size.  The
whole part is kept; the fraction, as a mass of words, is settled in duels: two documents of a source
pass words to and fro at random, without changing either's expectation or their sum, until one is
taken wholly or not at all.  Duels run inside hash buckets of bounded size; each bucket leaves at most
one open document per source.  A source with one open document left is settled: it goes to the nearer
side.  Those of other sources meet in ever fewer buckets, a source's only as many as its own documents
ask for.  A source therefore misses its target by less than half a document.

Cases: null text has size 0; null source is a source of its own, ranked last; documents of size 0 are
never taken; repeated rows count each; a null id is an id like any other; rows equal in id, source and
size are dealt in parts of a bucket's size; an empty table gives an empty result; ties in the order of duels fall to the id.  Other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, keep, save, scratch

#: Documents settled in one bucket.
BUCKET = 4096


def word_count(text: str) -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share=(3, 2), most: int = 2) -> DataFrame:
    """source, source_size, target: weights repeat over sources in code-point order, null last.

    The targets add up to share of all sizes; what a source would get above `most` times its own size
    goes to the others by weight, until none is above.  Only sums come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(per, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = save(ranked.withColumn("w", weight), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    goal = Fraction(total * share[0], share[1])
    level, cap = None, F.col("source_size") * most
    while True:  # level only rises, so every round caps more sources or is the last
        full = F.lit(False) if level is None else cap <= F.col("w") * level
        got = ranked.agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not got["w"]:
            break
        new = float((goal - (got["full"] or 0)) / Fraction(got["w"]))
        if level is not None and new <= level:
            break
        level = new
    if level is None:
        level = 0.0
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.col("w") * level).alias("target"))


def settler():
    """A function of one bucket's rows."""
    return _settle


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Duels among the open documents of one bucket, large ones first, so that what stays open is small."""
    rows = rows.sort_values(["source", "size", "draw", "doc_id"], ascending=[True, False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    mass, size, draw = rows["mass"].tolist(), rows["size"].tolist(), rows["draw"].tolist()
    source = [None if x is None or x != x else x for x in rows["source"]]
    held = -1
    for j in range(len(rows)):
        if held >= 0 and source[held] != source[j]:
            held = -1
        if not 0 < mass[j] < size[j]:
            continue
        if held < 0:
            held = j
            continue
        up, down = min(size[held] - mass[held], mass[j]), min(mass[held], size[j] - mass[j])
        if draw[j] * (up + down) < down:
            full, none = up == size[held] - mass[held], up == mass[j]
            mass[held] = float(size[held]) if full else mass[held] + up
            mass[j] = 0.0 if none else mass[j] - up
        else:
            none, full = down == mass[held], down == size[j] - mass[j]
            mass[held] = 0.0 if none else mass[held] - down
            mass[j] = float(size[j]) if full else mass[j] + down
        if not 0 < mass[held] < size[held]:
            held = j if 0 < mass[j] < size[j] else -1
    rows["mass"] = mass
    return rows


def parts_of_copies(sizes: DataFrame) -> DataFrame:
    """sizes with `part`: 0, but rows equal in id, source and size are numbered in parts of BUCKET rows.

    Such rows are alike, so only how many there are in a part counts, and reruns agree.
    """
    same = ["doc_id", "source", "size"]
    many = save(sizes.groupBy(*same).agg(F.count("*").alias("_m")).where(F.col("_m") > BUCKET), "many")
    if many.isEmpty():
        return sizes.withColumn("part", F.lit(0).cast("long"))
    on = [sizes[c].eqNullSafe(many[c]) for c in same]
    rest = sizes.join(many, on, "left_anti").withColumn("part", F.lit(0).cast("long"))
    hot = sizes.join(many, on, "left_semi").withColumn("_r", F.rand(1))
    ranked = save(global_rank(hot, [*same, "_r"], "_at"), "ranked")  # the tie-breaker spreads a group over partitions
    least = ranked.groupBy(*same).agg(F.min("_at").alias("_from"))
    least = least.select(*[F.col(c).alias("_" + c) for c in same], "_from")
    told = ranked.join(least, [F.col(c).eqNullSafe(F.col("_" + c)) for c in same])
    return rest.unionByName(told.withColumn("part", F.floor((F.col("_at") - F.col("_from")) / BUCKET)).select(*sizes.columns, "part"))


def mix(docs: DataFrame, weights=(5, 2, 1), share=(3, 2), most: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken, and columns to carry; a written table."""
    with scratch(docs.sparkSession):
        return keep(_mix(docs, weights, share, most, seed, id_col, text_col, source_col, carry), "mixed")


def _mix(docs: DataFrame, weights, share, most: int, seed: int, id_col: str, text_col: str, source_col: str, carry: tuple) -> DataFrame:
    sizes = save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), *carry), "sizes")
    parted = parts_of_copies(sizes)
    targets = save(source_targets(sizes, weights, share, most), "targets")
    per = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    # sources are few beside documents; a hot one is split by AQE's skew join, or the small side is sent
    t = targets.withColumnRenamed("source", "_s")
    rows = parted.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_p", per)
    rows = rows.withColumn("base", F.floor("_p")).withColumn("mass", (F.col("_p") - F.floor("_p")) * F.col("size")).drop("_p")
    hashed = lambda level: F.xxhash64("doc_id", "size", "part", F.lit(seed), F.lit(level))
    n = sizes.count()
    buckets, level, done = max(1, -(-n // BUCKET)), 0, []
    fields = ["doc_id", "source", "size", "part", "source_size", "target", "base", "mass", *carry]
    dealt = rows.select(*fields).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "part", F.lit(seed)), F.lit(buckets)))
    closed = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
    nearer = F.when(2 * F.col("mass") < F.col("size"), 0.0).otherwise(F.col("size").cast("double"))
    while True:
        dealt = dealt.withColumn("draw", F.shiftrightunsigned(hashed(level), 11) / F.lit(float(1 << 53)))
        settled = dealt.groupBy("bucket").applyInPandas(settler(), dealt.schema)
        settled = save(settled.select(*fields), "settled")
        done.append(settled.where(closed))
        left = settled.where(~closed)
        per = left.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n"))
        left = save(left.join(per, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "open")
        done.append(left.where("_n = 1").select(*fields).withColumn("mass", nearer))
        left = left.where("_n > 1")
        n = left.count()
        if not n:
            break
        # a source's documents in as many parts as they fill buckets; parts of several sources share a bucket
        level += 1
        share_of = F.pmod(hashed(level), F.ceil(F.col("_n") / BUCKET))
        dealt = left.withColumn("bucket", F.pmod(F.xxhash64("source", share_of, F.lit(seed)), F.lit(-(-n // BUCKET)))).drop("_n")
    return _copies(done, carry)


def _copies(done: list[DataFrame], carry: tuple) -> DataFrame:
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = F.when(F.col("size") > 0, F.col("base") + (F.col("mass") > 0).cast("long")).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carry)
