"""Expressions with labels, and back: token rows joined to names, put together again in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions import expressions as X
from termweave.model import Ontology, is_named
from termweave.operators.search import resolve
from termweave.sources.scans import carried

BARE = r"((?:https?://|urn:|file:)[^\s(),{}<>]+)"


def expand(rows: DataFrame, prefixes: DataFrame, word: str) -> DataFrame:
    """Rows with iri: prefix:local by its prefix's expansion, the word itself if the prefix is unknown."""
    name, local = F.substring_index(word, ":", 1), F.expr(f"substr({word}, instr({word}, ':') + 1)")
    p = prefixes.select(F.col("name").alias("_n"), F.col("expansion").alias("_x"))
    out = rows.join(p, F.contains(word, F.lit(":")) & (name == F.col("_n")), "left")
    return out.withColumn("iri", F.coalesce(F.concat("_x", local), F.col(word))).drop("_n", "_x")


def abbreviate(rows: DataFrame, prefixes: DataFrame, iri: str) -> DataFrame:
    """Rows with curie: the longest expansion that begins the IRI; null if none.

    Each IRI meets only expansions equal to one of its beginnings of a length that some expansion has,
    so the join stays one by equality.
    """
    p = prefixes.groupBy(F.col("expansion").alias("_x")).agg(F.min("name").alias("_n"))
    sizes = p.agg(F.array_sort(F.collect_set(F.length("_x"))).alias("_sizes"))
    keyed = rows.withColumn("_id", F.xxhash64(iri)).crossJoin(F.broadcast(sizes))  # one row: the distinct lengths
    tries = keyed.select(iri, F.explode(F.filter("_sizes", lambda n: n <= F.length(iri))).alias("_len")).distinct().withColumn("_x", F.expr(f"left({iri}, _len)"))
    hits = tries.join(p, "_x").groupBy(iri).agg(F.max_by(F.struct("_n", "_len"), "_len").alias("_b"))
    out = rows.join(hits, iri, "left")
    return out.withColumn("curie", F.concat(F.col("_b._n"), F.lit(":"), F.expr(f"substr({iri}, _b._len + 1)"))).drop("_b")


def named(expr: Column) -> Column:
    """An expression that is one IRI."""
    return is_named(expr) & ~expr.rlike(r"\s")


def render(exprs: DataFrame, labels: DataFrame, style: str = "label", editing: bool = True, base: str | None = None) -> DataFrame:
    """Expr, text, refs (start, end, iri): IRIs as labels ('quoted' if spaced and editing), short or full.

    labels: iri, label, one row for each IRI.
    """
    e = exprs.select("expr").distinct()
    pieces = F.split(F.regexp_replace("expr", BARE, "\u0004$1\u0004"), "\u0004")
    rows = e.select("expr", F.posexplode(pieces).alias("pos", "piece")).where("piece <> ''")
    rows = rows.withColumn("iri", F.when(F.col("piece").rlike("^(https?://|urn:|file:)"), F.col("piece")))
    rows = rows.join(labels.select("iri", "label"), "iri", "left")
    short = X.short_iri(F.col("iri"), F.lit(base) if base else None)
    shown = F.when(F.col("label").rlike(r"\s") & F.lit(editing), F.concat(F.lit("'"), "label", F.lit("'"))).otherwise(F.col("label"))
    of_iri = {"label": F.coalesce(shown, short), "shortIri": short, "fullIri": F.concat(F.lit("<"), "iri", F.lit(">"))}[style]
    rows = rows.withColumn("out", F.when(F.col("iri").isNull(), F.col("piece")).otherwise(of_iri))
    before = W.partitionBy("expr").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("out")).over(before), F.lit(0)).cast("int"))
    ref = F.when(F.col("iri").isNotNull() & F.col("label").isNotNull(), F.struct("start", (F.col("start") + F.length("out")).cast("int").alias("end"), "iri"))
    parts = rows.groupBy("expr").agg(F.array_sort(F.collect_list(F.struct("pos", "out"))).alias("p"), F.array_sort(F.collect_list(ref)).alias("refs"))
    return parts.select("expr", F.array_join(F.col("p.out"), "").alias("text"), "refs")


def normalise(exprs: DataFrame, x: Ontology, base: str) -> DataFrame:
    """Expr, normal: every name as <IRI>; keywords, numbers, literals and unknown words stay."""
    e = exprs.select("expr").distinct()
    rows = e.select("expr", F.posexplode(X.tokens(F.col("expr"))).alias("pos", "token"))
    plain = F.col("token").rlike(r"^(\s+|[(){},<>\"]|\".*\"|\d+(\.\d+)?)$") | F.lower("token").isin(*X.KEYWORDS)
    found = resolve(rows.where(~plain), x, base)
    rows = rows.withColumn("plain", plain).join(found, "token", "left")
    out = F.when(F.col("plain") | F.col("iri").isNull(), F.when(~F.col("plain") & F.col("token").rlike("^https?://"), F.concat(F.lit("<"), "token", F.lit(">"))).otherwise(F.col("token"))).otherwise(F.concat(F.lit("<"), "iri", F.lit(">")))
    parts = rows.groupBy("expr").agg(F.array_sort(F.collect_list(F.struct("pos", out.alias("out")))).alias("p"))
    return parts.select("expr", F.array_join(F.col("p.out"), "").alias("normal"))


def logical_lines(lines: DataFrame) -> DataFrame:
    """Path, line_no, line: lines that begin with `and` join the one before; blanks and comments go."""
    t = F.trim("text")
    block = "block" if "block" in lines.columns else F.lit(0).alias("block")
    own = lines.select("path", "line_no", block, t.alias("t")).where((t != "") & ~t.startswith("#"))
    more = F.lower("t").startswith("and ")
    # the line that each belongs to: found inside blocks of a file, carried over by a row for each block
    parts = carried(own, F.when(~more, F.col("line_no")), "_g").groupBy("path", "_g").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("p"))
    return parts.select("path", "line_no", F.array_join(F.col("p.t"), " ").alias("line"))
