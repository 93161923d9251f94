"""Written tables in the folder that driver and executors share, and loops to a fixed point."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset (as in tests).

    Executors of a cluster don't see a folder of the driver's machine, so there the setting is asked for.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="termweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete every table written so far; results that read them must have been written elsewhere."""
    while _made:
        where = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's own setting: an action's shuffle files go when it ends, not when the driver's memory is next cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = {"lock": threading.Lock(), "now": 0, "before": None}


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind; the setting is as before when the last of them (there may be threads) ends."""
    with _writing["lock"]:
        if _writing["now"] == 0:
            _writing["before"] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing["now"] += 1
    try:
        yield
    finally:
        with _writing["lock"]:
            _writing["now"] -= 1
            if _writing["now"] == 0:
                spark.conf.unset(CLEANUP) if _writing["before"] is None else spark.conf.set(CLEANUP, _writing["before"])


def save(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, lost executors cost nothing, and shuffle files go."""
    path = shared_path(df.sparkSession, name)
    with shuffles_cleared(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of save() that nothing reads any more."""
    for t in tables:
        path = t._written_at
        _made.remove(path)
        where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Known rows that unknown() compares by broadcast at most.
FEW = 10_000
#: Rows that a join may send to all tasks at most, through the driver: names compress so well that Spark takes many for few.
SENT = 100_000
#: Rows of one partition, about, where a table is dealt by spread().
ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys for a join or grouping on them, in as many partitions as its number of rows asks for.

    So what a task holds does not grow with the table.  Where the session's own number is enough, df as it is.
    """
    n = rows // ROWS + 1
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def side(df: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """df, the lesser side of a join, shuffled if the written table that it is taken from has more than SENT rows."""
    return df.hint("merge") if (df if written is None else written).limit(SENT + 1).count() > SENT else df


def unknown(derived: DataFrame, known: DataFrame, keys: list[str], near: list[str], once: bool = False) -> DataFrame:
    """The distinct rows of derived that known lacks, written; once: no row of derived comes twice.

    near: those of the keys that have few values, as the upper ends of edges.  Only known rows that agree
    with a derived one in these are compared, so what is known is read and mostly not shuffled; where few or
    none agree, what is derived is not shuffled again.
    """
    derived = derived.select(*known.columns)
    derived = save(derived if once else derived.distinct(), "round")
    alike = known.join(derived.select(*near).distinct(), near, "left_semi").select(*keys)
    few = alike.limit(FEW + 1).count()
    if not few:
        return derived
    new = save(derived.join(F.broadcast(alike) if few <= FEW else alike, keys, "left_anti").select(*known.columns), "round")
    release(derived)
    return new


def fixpoint(known: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], near: list[str], first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """known and all that added() finds."""
    return reduce(DataFrame.unionByName, added(known, step, keys, near, first), known)


def added(known: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], keys: list[str], near: list[str], first: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
    """Semi-naive iteration: step(new, all) derives rows from the last round's; what is new joins all.

    known: distinct rows of written tables.  Each round is written once; the driver only asks whether it was
    empty.  first(known) is the first round's step, where that is simpler if all is new; near as in unknown().
    """
    everything = last = known
    rounds: list[DataFrame] = []
    while True:
        derived = step(last, everything) if first is None else first(everything)
        first = None
        last = unknown(derived, everything, keys, near)
        if last.isEmpty():
            return rounds
        rounds.append(last)
        if len(rounds) == 8:  # long chains: few parts to union and to join
            merged = save(reduce(DataFrame.unionByName, rounds[:-1]), "rounds")
            release(*rounds[:-1])
            rounds = [merged, last]
        everything = reduce(DataFrame.unionByName, rounds, known)
