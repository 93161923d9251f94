"""Event flows (T) over the events table: users are keys, event types are actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.catalogs import query
from termweave.catalogs.lifecycle import versions
from termweave.model import table
from termweave.operators import versions as V
from termweave.plans.tables import shared_path
from termweave.streaming import flows

ACTIONS = {"view": "push", "click": "push", "error": "undo", "purchase": "redo", "signup": "clear"}
DEBOUNCE = """
WITH e AS (SELECT user_id AS path, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
g AS (SELECT path, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY path, k"""


def changes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts")


def stream(spark, sf_dir):
    """The events table as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)


@query("t02_debounce", DEBOUNCE)
def t02(spark, sf_dir):
    """Quiet periods of 12 hours, as users' events are hours apart."""
    return flows.debounce(changes(spark, sf_dir), quiet="12 hours")


@query("t03_own_writes", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def t03(spark, sf_dir):
    """Every third event is a write of ours (50 ms off); of the others one has another size, one another time."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").cast("string").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long").alias("mtime_ms"), F.col("user_id").alias("size"))
    k = F.col("event_id") % 3
    own = e.select("path", F.when(k == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (F.col("mtime_ms") + F.when(k == 2, 100).otherwise(50)).alias("mtime_ms"))
    return flows.foreign(e, own).select("event_id")


def actions(spark, sf_dir, rows=None):
    e = table(spark, sf_dir, "events") if rows is None else rows
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"), action.alias("action"), F.get_json_object("props", "$.k").alias("value"))


#: The replay as recursion over each key's events, in order of time.
STEPS = """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' WHEN 'signup' THEN 'clear' ELSE 'push' END AS a, json_extract_string(props, '$.k') AS v FROM events),
"""
NAVIGATION = STEPS + """
r(key, n, seq, back, forward) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM e
  UNION ALL
  SELECT e.key, e.n, e.seq,
    CASE WHEN a = 'push' AND v <> '' AND (len(back) = 0 OR back[-1] <> v) THEN list_append(back, v)[-50:]
         WHEN a = 'undo' AND len(back) > 1 THEN back[:-2] WHEN a = 'redo' AND len(forward) > 0 THEN list_append(back, forward[-1])
         WHEN a = 'clear' THEN [] ELSE back END,
    CASE WHEN a = 'push' AND v <> '' AND (len(back) = 0 OR back[-1] <> v) THEN []
         WHEN a = 'undo' AND len(back) > 1 THEN list_append(forward, back[-1]) WHEN a = 'redo' AND len(forward) > 0 THEN forward[:-2]
         WHEN a = 'clear' THEN [] ELSE forward END
  FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, seq, back[-1] AS current, CAST(len(back) AS INTEGER) AS n_back, CAST(len(forward) AS INTEGER) AS n_forward FROM r WHERE n > 0"""
EDITS = STEPS + """
r(key, n, seq, undo, redo, cur) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM e
  UNION ALL
  SELECT e.key, e.n, e.seq,
    CASE WHEN a = 'push' THEN list_append(undo, cur)[-50:] WHEN a = 'undo' AND len(undo) > 0 THEN undo[:-2]
         WHEN a = 'redo' AND len(redo) > 0 THEN list_append(undo, cur) WHEN a = 'clear' THEN [] ELSE undo END,
    CASE WHEN a = 'push' THEN [] WHEN a = 'undo' AND len(undo) > 0 THEN list_append(redo, cur)
         WHEN a = 'redo' AND len(redo) > 0 THEN redo[:-2] WHEN a = 'clear' THEN [] ELSE redo END,
    CASE WHEN a IN ('push', 'clear') THEN v WHEN a = 'undo' AND len(undo) > 0 THEN undo[-1] WHEN a = 'redo' AND len(redo) > 0 THEN redo[-1] ELSE cur END
  FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, seq, cur AS current, CAST(len(undo) AS INTEGER) AS n_back, CAST(len(redo) AS INTEGER) AS n_forward FROM r WHERE n > 0"""


@query("t04_navigation_history", NAVIGATION)
def t04(spark, sf_dir):
    return flows.history(actions(spark, sf_dir))


@query("t04_edit_history", EDITS)
def t04_edit(spark, sf_dir):
    return flows.history(actions(spark, sf_dir), flows.edit)


@query("t04_history_counts", "SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def t04_counts(spark, sf_dir):
    """Every event of every key is replayed once."""
    return flows.history(actions(spark, sf_dir)).groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("last"))


@query("t04_history_stream", NAVIGATION)
def t04_stream(spark, sf_dir):
    """Histories kept as state of a streaming query."""
    rows = flows.history_stream(actions(spark, sf_dir, stream(spark, sf_dir)))
    return flows.drain(rows, shared_path(spark, "history"), shared_path(spark, "history-log"))


@query("t05_messages", "SELECT event_id, CASE event_type WHEN 'view' THEN 'focus' ELSE 'forward' END AS target, CASE event_type WHEN 'view' THEN 'http://snomed.info/id/' || user_id ELSE CAST(user_id AS VARCHAR) END AS value FROM events WHERE event_type IN ('view', 'click')")
def t05(spark, sf_dir):
    return flows.route(messages(table(spark, sf_dir, "events"))).drop("sctid")


def messages(e):
    cmd = F.when(F.col("event_type") == "view", "CONCEPT_FOCUS").when(F.col("event_type") == "click", "GRAPH_NODE_SELECT").otherwise("OTHER")
    return e.select("event_id", F.to_json(F.struct(cmd.alias("command"), F.struct(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("label")).alias("payload"))).alias("json"))


@query("t05_message_stream", "SELECT event_id, CASE event_type WHEN 'view' THEN 'focus' ELSE 'forward' END AS target, CASE event_type WHEN 'view' THEN 'http://snomed.info/id/' || user_id ELSE CAST(user_id AS VARCHAR) END AS value FROM events WHERE event_type IN ('view', 'click')")
def t05_stream(spark, sf_dir):
    """The same as a streaming query over the file."""
    routed = flows.route(messages(stream(spark, sf_dir))).drop("sctid")
    return flows.drain(routed, shared_path(spark, "routed"), shared_path(spark, "routed-log"))


@query("t01_change_feed", "SELECT 'http://b.example/customer/' || c_custkey AS iri, CASE WHEN c_custkey % 10 = 1 AND c_custkey IN (SELECT user_id FROM events) THEN c_name || ' new' ELSE c_name END AS label FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey NOT IN (SELECT user_id FROM events)")
def t01(spark, sf_dir):
    """A feed of changes (users of events are customers): what it names is merged from the second version, batch by batch."""
    old, new = versions(spark, sf_dir)
    touched = shared_path(spark, "touched")
    feed = stream(spark, sf_dir).select(F.lit("shop").alias("onto_id"), F.concat(F.lit("http://b.example/customer/"), F.col("user_id").cast("string")).alias("iri"))

    def apply(batch, _):
        batch.distinct().write.mode("append").parquet(touched)

    flows.merge_feed(feed, apply, shared_path(spark, "feed-log")).awaitTermination()
    seen = spark.read.schema("onto_id string, iri string").parquet(touched).distinct()
    merged = V.merge(old, new, V.changed_entities(old, new).select("onto_id", "iri").join(seen, ["onto_id", "iri"], "left_semi"))
    return merged.label.select("iri", F.col("text").alias("label"))
