"""Versions that are kept with digests (V03-V05, V07, V12): equal parts of two versions are not read to compare them.

`StoredLines` keeps the lines of files in blocks, with a digest of every block counted from the start and from
the end.  `StoredOntology` keeps the tables of ontologies in folders by the hash of the owning entity, with a digest
of every entity and of every folder.  A new version writes the folders it changes; a table that is written last
says which folders it consists of, so a reader sees the old version or the new one.  The driver learns folder
numbers only.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.model import SCHEMAS, Ontology
from termweave.operators.versions import HEADER, OWNER, entity_digests, region_of, tables
from termweave.plans.tables import save

#: Tables that are written at a time; most are small.
WRITERS = 6


def _summed(h: Column) -> Column:
    """A digest of a set of hashes, whatever their order."""
    return F.struct(F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.count("*").alias("n"))


def _numbers(d: DataFrame) -> list[int]:
    """The folders of rows: at most as many numbers as there are folders."""
    return sorted(r[0] for r in d.select("part").distinct().collect())


@dataclass(frozen=True)
class StoredLines:
    """One version of the lines of files; two versions compare if `block` (lines of a digest) is the same."""

    spark: SparkSession
    path: str
    folders: int = 64
    block: int = 1024

    def of(self) -> Column:
        return F.pmod(F.xxhash64("path", "block"), F.lit(self.folders)).cast("int").alias("part")

    def digests(self) -> DataFrame:
        """path, side, block, d, chars, head: blocks from the start (front) and from the end (back)."""
        return self.spark.read.parquet(f"{self.path}/digests")

    def lines(self, wanted: DataFrame) -> DataFrame:
        """path, line_no, text of the blocks (path, block) wanted; other folders are not read."""
        w = save(wanted.select("path", "block", self.of()).distinct(), "wanted")
        numbers = _numbers(w)
        if not numbers:
            return w.select("path", F.lit(0).cast("long").alias("line_no"), F.lit("").alias("text"))
        return self.spark.read.parquet(f"{self.path}/lines").where(F.col("part").isin(numbers)).join(w.drop("part"), ["path", "block"], "left_semi").select("path", "line_no", "text")


def write_lines(lines: DataFrame, store: StoredLines) -> StoredLines:
    """Keep lines (path, line_no from 0, text; a null text is an empty line) at store.path, which holds none yet."""
    of = lambda n: F.floor(n / F.lit(store.block)).alias("block")
    rows = lines.select("path", F.col("line_no").cast("long").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"), of(F.col("line_no"))).withColumn("part", store.of())
    # a file of any length is many blocks, and ranges split what is in a folder
    rows.repartitionByRange("part", "path", "line_no").sortWithinPartitions("part", "path", "line_no").write.partitionBy("part").parquet(f"{store.path}/lines")
    kept = store.spark.read.schema(rows.schema).parquet(f"{store.path}/lines")

    def digest(d: DataFrame, side: str, at: Column) -> DataFrame:
        told = [_summed(F.xxhash64(at, "text")).alias("d"), F.sum(F.length("text") + 1).alias("chars"), F.max(F.ltrim("text").rlike(HEADER)).alias("head")]
        return d.groupBy("path", F.lit(side).alias("side"), of(at)).agg(*told)

    front = save(digest(kept, "front", F.col("line_no")), "front")
    size = front.groupBy("path").agg(F.sum("d.n").alias("n"))
    back = digest(kept.join(size, "path"), "back", F.col("n") - F.col("line_no") - 1)
    front.unionByName(back).write.parquet(f"{store.path}/digests")
    return store


def _sizes(digests: DataFrame, out: str) -> DataFrame:
    return digests.where("side = 'front'").groupBy("path").agg(F.sum("d.n").alias(out))


def changed_region(old: StoredLines, new: StoredLines) -> DataFrame:
    """V03 of two kept versions, as versions.changed_region() gives it.

    Blocks are compared by digest; lines are read of the first block that differs from the start and
    the first from the end, so of equal files none are, and of others a few blocks.
    """
    if old.block != new.block:
        raise ValueError("digests of blocks of different sizes do not compare")
    a, b = old.digests(), new.digests()
    n = save(_sizes(a, "n_old").join(_sizes(b, "n_new"), "path", "full_outer").select("path", F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new")), "sizes")
    k = ["path", "side", "block"]
    j = a.select(*k, F.col("d").alias("a")).join(b.select(*k, F.col("d").alias("b")), k, "full_outer")
    at = save(j.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("path", "side").agg(F.min("block").alias("at")), "differing").join(n, "path")

    def read(store: StoredLines, size: str) -> DataFrame:
        """The lines of the blocks that differ first; a block from the end lies in one or two from the start."""
        low = F.when(F.col("side") == "front", F.col("at")).otherwise(F.floor(F.greatest(F.col(size) - (F.col("at") + 1) * store.block, F.lit(0)) / store.block))
        high = F.when(F.col("side") == "front", F.col("at")).otherwise(F.floor((F.col(size) - 1 - F.col("at") * store.block) / store.block))
        return store.lines(at.where(high >= low).select("path", F.explode(F.sequence(low, high)).alias("block")))

    return region_of(n, read(old, "n_old"), read(new, "n_new"))


def incremental_safe(old: StoredLines, new: StoredLines, region: DataFrame, ratio: float = 0.2, floor: int = 4096) -> DataFrame:
    """V05 of two kept versions: sizes come from digests; lines are read of the blocks at the two ends of a region."""

    def side(store: StoredLines, end: str) -> DataFrame:
        r = region.where("not identical").where(F.col(end) > F.col("start_line")).select("path", F.col("start_line").alias("_s"), F.col(end).alias("_e"))
        d = store.digests().where("side = 'front'")
        inner = d.join(r, "path").where((F.col("block") * store.block >= F.col("_s")) & ((F.col("block") + 1) * store.block <= F.col("_e"))).select("path", "chars", "head")
        first, last = F.floor(F.col("_s") / store.block), F.floor((F.col("_e") - 1) / store.block)
        ends = r.select("path", "_s", "_e", F.explode(F.array_distinct(F.array(first, last))).alias("block")).where((F.col("block") * store.block < F.col("_s")) | ((F.col("block") + 1) * store.block > F.col("_e")))
        edge = store.lines(ends).join(r, "path").where("line_no >= _s and line_no < _e").select("path", (F.length("text") + 1).alias("chars"), F.ltrim("text").rlike(HEADER).alias("head"))
        total = d.groupBy("path").agg(F.sum("chars").alias("all"))
        part = inner.unionByName(edge).groupBy("path").agg(F.sum("chars").alias("part"), F.max("head").alias("part_head"))
        j = region.select("path").join(total, "path", "left").join(part, "path", "left")
        large = (F.coalesce("part", F.lit(0)) > floor) & (F.coalesce("part", F.lit(0)) / F.greatest(F.coalesce("all", F.lit(1)), F.lit(1)) > ratio)
        return j.select("path", (large | F.coalesce("part_head", F.lit(False))).alias(end))

    j = region.select("path", "identical").join(side(old, "old_end"), "path").join(side(new, "new_end"), "path")
    return j.select("path", (F.col("identical") | ~(F.col("old_end") | F.col("new_end"))).alias("safe"))


@dataclass(frozen=True)
class StoredOntology:
    """A version of kept ontologies; versions of one `path` share the folders that did not change.

    One writer at a time.  A version that was cut short was never seen and is written again.
    """

    spark: SparkSession
    path: str
    folders: int = 64
    version: int = 0

    def of(self, owner: str) -> Column:
        return F.pmod(F.xxhash64("onto_id", owner), F.lit(self.folders)).cast("int")

    def where(self) -> dict[int, int]:
        """The version that wrote each folder: one row for each folder."""
        return {r["part"]: r["at"] for r in self.spark.read.schema("part int, at int").parquet(f"{self.path}/parts/{self.version}").collect()}

    def read(self, name: str, schema: str, numbers: list[int] | None = None) -> DataFrame:
        """A table's rows of this version with their folder, of some folders or of all."""
        by: dict[int, list[int]] = {}
        for part, at in self.where().items():
            if numbers is None or part in numbers:
                by.setdefault(at, []).append(part)
        if not by:
            return self.spark.createDataFrame([], schema + ", part int")
        base = f"{self.path}/{name}"
        mine = reduce(Column.__or__, [(F.col("at") == at) & F.col("part").isin(parts) for at, parts in by.items()])
        d = self.spark.read.schema(schema + ", at int, part int").option("basePath", base).parquet(*[f"{base}/at={at}" for at in by])
        return d.where(mine).drop("at")

    def write(self, name: str, rows: DataFrame, key: str) -> None:
        """Rows (with their folder) of the folders that this version changes."""
        # one entity may own most rows of a folder: ranges over all columns split them
        laid = rows.repartitionByRange("part", key, F.xxhash64(*rows.columns)).sortWithinPartitions("part", key)
        laid.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}/at={self.version}")

    def finish(self, where: dict[int, int]) -> StoredOntology:
        """Write what the version consists of: from here on it can be read."""
        self.spark.createDataFrame(list(where.items()), "part int, at int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts/{self.version}")
        return self

    def ontology(self) -> Ontology:
        return Ontology(**{n: self.read(n, s).drop("part") for n, s in SCHEMAS.items()})


_SUM = "struct<s: decimal(38,0), x: bigint, n: bigint>"
DIGESTS, SUMS = f"onto_id string, iri string, l {_SUM}, t {_SUM}", f"onto_id string, d {_SUM}"


def _typed(name: str, d: DataFrame) -> DataFrame:
    cols = [c.split() for c in SCHEMAS[name].split(", ")]
    return d.select(*[F.col(c).cast(t).alias(c) for c, t in cols])


def _write(store: StoredOntology, parts: dict[str, DataFrame], digests: DataFrame) -> None:
    """Tables and entity digests, with their folders, and the digests of these folders."""
    plain = digests.select("onto_id", "iri", *[F.struct(F.col(c)["s"].cast("decimal(38,0)").alias("s"), F.col(c)["x"].alias("x"), F.col(c)["n"].alias("n")).alias(c) for c in ("l", "t")], "part")
    with ThreadPoolExecutor(WRITERS) as pool:
        list(pool.map(lambda job: store.write(*job), [("digests", plain, "iri"), *((n, d, OWNER[n]) for n, d in parts.items())]))
    mine = store.spark.read.schema(DIGESTS + ", part int").parquet(f"{store.path}/digests/at={store.version}")
    store.write("sums", mine.groupBy("onto_id", "part").agg(_summed(F.xxhash64("iri", "l", "t")).alias("d")), "onto_id")


def write(x: Ontology, store: StoredOntology) -> StoredOntology:
    """Keep x as the first version of a store, all folders new."""
    x = Ontology(**{n: _typed(n, d) for n, d in tables(x).items()})
    _write(store, {n: d.withColumn("part", store.of(OWNER[n])) for n, d in tables(x).items()}, entity_digests(x).withColumn("part", store.of("iri")))
    return store.finish(dict.fromkeys(range(store.folders), store.version))


def changed_entities(old: StoredOntology, new: StoredOntology) -> DataFrame:
    """V04 of two kept versions, as versions.changed_entities() gives it.

    Folders that both share are passed over, then those whose digests agree for every ontology (V12);
    of the others entity digests are read.  No table of an ontology is.
    """
    if old.folders != new.folders:
        raise ValueError("versions in different numbers of folders do not compare")
    a, b = old.where(), new.where()
    apart = [p for p in b if old.path != new.path or a[p] != b[p]]
    k = ["onto_id", "part"]
    s = old.read("sums", SUMS, apart).withColumnRenamed("d", "a").join(new.read("sums", SUMS, apart).withColumnRenamed("d", "b"), k, "full_outer")
    differ = save(s.where(~F.col("a").eqNullSafe(F.col("b"))).select(*k), "differing")
    numbers = _numbers(differ)
    of = lambda x, *to: x.read("digests", DIGESTS, numbers).join(differ, k, "left_semi").select("onto_id", "iri", *[F.col(c).alias(t) for c, t in zip(("l", "t"), to, strict=True)])
    j = of(old, "l", "t").join(of(new, "l2", "t2"), ["onto_id", "iri"], "full_outer")
    told = j.select("onto_id", "iri", (~F.col("l").eqNullSafe(F.col("l2"))).alias("logical"), (~F.col("t").eqNullSafe(F.col("t2"))).alias("textual"))
    return told.where("logical or textual")


def merge(store: StoredOntology, new: Ontology, touched: DataFrame) -> StoredOntology:
    """The next version of a store, with the rows of touched entities (onto_id, iri) taken from new.

    Folders that hold none of them are not read and not written.  With nothing touched the version stays.
    """
    t = save(touched.select("onto_id", "iri").distinct().withColumn("part", store.of("iri")), "touched")
    numbers = _numbers(t)
    if not numbers:
        return store
    after = StoredOntology(store.spark, store.path, store.folders, store.version + 1)

    def mixed(name: str, schema: str, owner: str, fresh: DataFrame) -> DataFrame:
        on = ["onto_id", owner]
        keys = t.select("onto_id", F.col("iri").alias(owner))
        return store.read(name, schema, numbers).join(keys, on, "left_anti").unionByName(fresh.withColumn("part", store.of(owner)))

    def fresh_rows(name: str) -> DataFrame:
        mine = _typed(name, getattr(new, name))
        keys = t.select("onto_id", F.col("iri").alias(OWNER[name]))
        return save(mine.join(keys, ["onto_id", OWNER[name]], "left_semi").select(*mine.columns), "fresh")

    with ThreadPoolExecutor(WRITERS) as pool:
        part = Ontology(**dict(zip(OWNER, pool.map(fresh_rows, OWNER), strict=True)))
    parts = {n: mixed(n, SCHEMAS[n], OWNER[n], d).select(*d.columns, "part") for n, d in tables(part).items()}
    _write(after, parts, mixed("digests", DIGESTS, "iri", entity_digests(part)).select("onto_id", "iri", "l", "t", "part"))
    return after.finish(store.where() | dict.fromkeys(numbers, after.version))
