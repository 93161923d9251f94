"""Helpers shared by the operators: the shared folder, written tables, ranks, components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Keys of a join that are joined by broadcast at most: those that hold a thousandth of the rows each.
HOT = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset.

    Executors of a cluster don't see a folder of the driver's machine, so there the setting is asked for.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_to = sc._jsc.sc().getCheckpointDir()
        if set_to.isDefined():
            root = set_to.get()
        elif not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="termweave-")
            sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables saved inside go when the block ends; what it returns must have been saved by keep()."""
    path = shared_path(spark, "scratch")
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """save(), outside the scratch folder."""
    token = _scratch.set(None)
    try:
        return save(df, name)
    finally:
        _scratch.reset(token)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    inside = _scratch.get()
    path = f"{inside}/{name}-{uuid.uuid4().hex}" if inside else shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand free memory back to the system: a Python worker waits for its next task beside an executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """run, a function over batches, that gives memory back when a task ends."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys that hold a thousandth of a written table's rows or more: at most HOT of them, and `_hot`."""
    least = max(100, rows.count() // HOT)
    per = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    return save(per.where(F.col("count") >= least).select(key, F.lit(True).alias("_hot")), "hot")


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: DataFrame | None = None) -> DataFrame:
    """left, a written table, with the columns of right, which has one row for each key; with how="left" null where it has none.

    A key may hold a third of left's rows: hot ones meet their rows of right by broadcast (at most HOT
    rows); null keys are not shuffled at all.
    """
    hot = hot_keys(left, key) if hot is None else hot
    told = left.join(F.broadcast(hot), key, "left")
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    many = told.where(F.col("_hot").isNull() & F.col(key).isNotNull()).drop("_hot").join(right, key, how)
    out = told.where("_hot").drop("_hot").join(few, key, how).unionByName(many)
    if how != "left":
        return out
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
    return out.unionByName(left.where(F.col(key).isNull()).select("*", *none))


def global_rank(df: DataFrame, keys: list, name: str) -> DataFrame:
    """Number the rows 0, 1, ... in the order of keys without gathering them in one task.

    Rows are range-partitioned and written; only one count per partition comes to the driver.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id())
    parts = save(parts, "rank")
    before, offsets = 0, []
    for row in sorted(parts.groupBy("_part").count().collect()):
        offsets.append((row["_part"], before))
        before += row["count"]
    if not offsets:
        return parts.drop("_part").withColumn(name, F.lit(0).cast("long"))
    table = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    local = F.row_number().over(W.partitionBy("_part").orderBy(*keys)) - 1
    return parts.join(F.broadcast(table), "_part").withColumn(name, (F.col("_before") + local).cast("long")).drop("_part", "_before")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges as (node, component): component is the smallest node.

    Minimum-label hooking with pointer jumping: every round a node takes the smallest label among its
    neighbours' labels and then its label's label, so the rounds grow with the logarithm of the
    diameter.  Only equi-joins (hot keys by broadcast) and partial minima; labels stay in Spark and each round is written to
    the shared folder.  Null endpoints are ignored; an empty table gives an empty one.
    """
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = save(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "labels")
    hubs = hot_keys(both, "v")
    while True:
        near = hot_join(both, label.select(F.col("node").alias("v"), "component"), "v", "inner", hubs).groupBy("u").agg(F.min("component").alias("m"))
        hooked = label.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        # the old root follows too, else a chain of roots would move one step a round
        roots = hooked.where("c < old").groupBy(F.col("old").alias("node")).agg(F.min("c").alias("r"))
        hooked = hooked.join(roots, "node", "left").select("node", "old", F.least("c", F.coalesce("r", "c")).alias("c"))
        hooked = save(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("c"), F.col("c").alias("up"))
        # one label may hold most nodes
        stepped = hot_join(hooked, jump, "c").select("node", F.coalesce("up", "c").alias("component"), (F.coalesce("up", "c") != F.col("old")).alias("moved"))
        stepped = save(stepped, "labels")
        label = stepped.select("node", "component")
        if stepped.where("moved").isEmpty():
            return label


def least_members(comp: DataFrame, classes: DataFrame) -> DataFrame:
    """node, least: the least `first` among the classes (node, first) of each node's component, which may hold most nodes."""
    least = comp.join(classes, "node").groupBy("component").agg(F.min("first").alias("least"))
    return hot_join(save(comp, "components"), save(least, "least"), "component").select("node", "least")
