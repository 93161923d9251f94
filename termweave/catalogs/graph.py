"""Patterns and filters (Q, F), the triple store and statistics (S13, A, K07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.catalogs import query
from termweave.model import BASE, LABEL, OWL, SKOS, SUB, TYPE, Ontology, derive, iri_key, lang_of, local_name, term_key, value_of
from termweave.operators import patterns as P
from termweave.operators.patterns import Lit, Var
from termweave.plans.tables import save
from termweave.sources import store

B = BASE
X, Y, Z, N, L, V = map(Var, ("x", "y", "z", "n", "l", "v"))


def onto(spark: SparkSession, sf_dir: str, lines: bool = False) -> Ontology:
    return derive(spark, sf_dir, lines=lines)


def triples(spark: SparkSession, sf_dir: str, lines: bool = False) -> DataFrame:
    return store.triples(onto(spark, sf_dir, lines), distinct=False)


def names(df: DataFrame, *cols: str) -> DataFrame:
    """Values of key columns."""
    return df.select(*[value_of(F.col(c)).alias(c) for c in cols])


NATION = f"'{B}nation/' || n_nationkey"
CUSTOMER = f"'{B}customer/' || c_custkey"
BAL = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)"


@query("flagship", f"""
SELECT CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS INTEGER) AS rank, {CUSTOMER} AS customer, c_name AS label
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND c_acctbal > 5000 ORDER BY c_name, c_custkey LIMIT 100""")
def flagship(spark, sf_dir):
    """Customers of a region's nations with a balance above a bound, the first 100 by label."""
    t = triples(spark, sf_dir)
    rows = P.bgp(t, [(X, SUB, Y), (Y, SUB, Z), (Z, LABEL, Lit("ASIA", "en")), (X, B + "acctbal", V), (X, LABEL, L)])
    rows = P.keep(rows, P.compare(">", F.col("v"), term_key("lit", "5000")))
    top = P.page(P.order(rows, [("l", False)]), 100)
    rank = F.row_number().over(W.orderBy(*P.sort_keys([("l", False)])))  # over the page's 100 rows
    return top.select(rank.cast("int").alias("rank"), value_of(F.col("x")).alias("customer"), value_of(F.col("l")).alias("label"))


@query("q01_triple_pattern", f"SELECT {CUSTOMER} AS x, '{B}nation/' || c_nationkey AS y FROM customer UNION ALL SELECT {NATION}, '{B}region/' || n_regionkey FROM nation UNION ALL SELECT '{B}region/' || r_regionkey, '{OWL}Thing' FROM region UNION ALL SELECT '{B}order/' || o_orderkey, '{B}customer/' || o_custkey FROM orders")
def q01(spark, sf_dir):
    return names(P.match(triples(spark, sf_dir), X, SUB, Y), "x", "y")


@query("q01_same_variable_twice", "SELECT 'none' AS x WHERE false")
def q01_twice(spark, sf_dir):
    return names(P.match(triples(spark, sf_dir), X, SUB, X), "x")


@query("q02_pattern_join", f"SELECT {CUSTOMER} AS x, {NATION} AS y, '{B}region/' || n_regionkey AS z FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q02(spark, sf_dir):
    return names(P.bgp(triples(spark, sf_dir), [(X, SUB, Y), (Y, SUB, Z), (X, B + "acctbal", V)]), "x", "y", "z")


@query("q02_no_shared_variable", f"SELECT '{B}region/' || r_regionkey AS x, n_name AS l FROM region CROSS JOIN nation")
def q02_cross(spark, sf_dir):
    t = triples(spark, sf_dir)
    nations = P.bgp(t, [(Y, SUB, Z), (Z, SUB, OWL + "Thing"), (Y, LABEL, L)]).select("l")
    return names(P.join(P.match(t, X, SUB, OWL + "Thing"), nations), "x", "l")


@query("q03_optional", f"SELECT {NATION} AS y, CASE WHEN c_acctbal > 9000 THEN {CUSTOMER} END AS x FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 UNION ALL SELECT {NATION}, NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def q03(spark, sf_dir):
    t = triples(spark, sf_dir)
    outer = P.bgp(t, [(Y, SUB, Z), (Z, SUB, OWL + "Thing")]).select("y")
    inner = P.bgp(t, [(X, SUB, Y), (X, B + "acctbal", V)])
    return names(P.optional(outer, inner, P.compare(">", F.col("v"), term_key("lit", "9000"))), "y", "x")


ORDER = f"'{B}order/' || o_orderkey"


@query("q04_maybe_unbound_join", f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 2 = 0 THEN {ORDER} END AS x FROM orders)
SELECT '{B}customer/' || c AS y, k, coalesce(x, {ORDER}) AS x FROM o JOIN orders d ON d.o_custkey = c AND (x IS NULL OR x = {ORDER})""")
def q04(spark, sf_dir):
    """A row for every order: half have x, the others lack it and take every order of the customer."""
    t = triples(spark, sf_dir)
    edge = P.match(t, X, SUB, Y).where(value_of(F.col("x")).contains("/order/"))
    k = local_name(value_of(F.col("x"))).try_cast("long")
    left = edge.select("y", k.alias("k"), F.when(k % 2 == 0, F.col("x")).alias("x"))
    out = P.join(left, edge.select("x", "y"), {"x"})
    return out.select(value_of(F.col("y")).alias("y"), "k", value_of(F.col("x")).alias("x"))


@query("q05_filter", f"SELECT {CUSTOMER} AS x FROM customer WHERE c_acctbal < 0")
def q05(spark, sf_dir):
    rows = P.match(triples(spark, sf_dir), X, B + "acctbal", V)
    return names(P.keep(rows, P.compare("<", F.col("v"), term_key("lit", "0"))), "x")


@query("q06_union", f"SELECT n_name AS l, NULL AS v FROM nation UNION ALL SELECT NULL, {BAL} FROM customer UNION ALL SELECT r_name, NULL FROM region")
def q06(spark, sf_dir):
    t = triples(spark, sf_dir)
    nations = P.bgp(t, [(Y, SUB, Z), (Z, SUB, OWL + "Thing"), (Y, LABEL, L)]).select("l")
    regions = P.bgp(t, [(Z, SUB, OWL + "Thing"), (Z, LABEL, L)]).select("l")
    return names(P.union(nations, P.match(t, X, B + "acctbal", V).select("v"), regions), "l", "v")


@query("q07_group", f"SELECT {CUSTOMER} AS x, n_name AS l FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0 AND n_name <> 'x'")
def q07(spark, sf_dir):
    t = triples(spark, sf_dir)
    rows = P.group(P.match(t, X, B + "acctbal", V), lambda d: P.keep(d, P.compare(">=", F.col("v"), term_key("lit", "0"))), lambda d: P.bgp(t, [(X, SUB, Y), (Y, LABEL, L)], d))
    return names(rows, "x", "l")


@query("q08_project", f"SELECT '<' || {CUSTOMER} || '>' AS x, '\"' || {BAL} || '\"^^<http://www.w3.org/2001/XMLSchema#decimal>' AS v, CAST(NULL AS VARCHAR) AS missing FROM customer")
def q08(spark, sf_dir):
    return P.project(P.match(triples(spark, sf_dir), X, B + "acctbal", V), ["x", "v", "missing"])


@query("q09_distinct", "SELECT DISTINCT c_mktsegment AS l, 'en' AS lang FROM customer")
def q09(spark, sf_dir):
    rows = P.distinct(P.match(triples(spark, sf_dir), X, B + "segment", L), ["l"])
    return rows.select(value_of(F.col("l")).alias("l"), lang_of(F.col("l")).alias("lang"))


@query("q10_order_by", f"SELECT row_number() OVER (ORDER BY c_mktsegment DESC, {BAL}, c_custkey) - 1 AS rank, {CUSTOMER} AS x FROM customer")
def q10(spark, sf_dir):
    """Ranks by text; the order is global without gathering rows in one task."""
    t = triples(spark, sf_dir)
    rows = P.bgp(t, [(X, B + "segment", L), (X, B + "acctbal", V)]).withColumn("k", local_name(value_of(F.col("x"))).cast("long"))
    return ranked(rows, [value_of(F.col("l")).desc(), value_of(F.col("v")), F.col("k")]).select("rank", value_of(F.col("x")).alias("x"))


def ranked(rows: DataFrame, keys: list) -> DataFrame:
    """rows with rank 0, 1, ...: range partitions, written, and a count of each that comes to the driver."""
    parts = save(rows.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "ranked")
    before, table = 0, []
    for r in sorted(parts.groupBy("_p").count().collect()):
        table.append(f"({r['_p']}, {before}L)")
        before += r["count"]
    offsets = parts.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(table or ['(0, 0L)'])} AS t(_p, _before)")
    local = F.row_number().over(W.partitionBy("_p").orderBy(*keys)) - 1
    return parts.join(F.broadcast(offsets), "_p").withColumn("rank", (F.col("_before") + local).cast("long")).drop("_p", "_before")


@query("q11_page", f"SELECT {CUSTOMER} AS x FROM customer ORDER BY {CUSTOMER} LIMIT 25 OFFSET 10")
def q11(spark, sf_dir):
    rows = P.match(triples(spark, sf_dir), X, B + "acctbal", V).select("x")
    return names(P.page(P.order(rows, [("x", False)]), 25, 10), "x")


@query("q11_limit_zero", "SELECT 'none' AS x WHERE false")
def q11_zero(spark, sf_dir):
    return names(P.page(P.match(triples(spark, sf_dir), X, B + "acctbal", V).select("x"), 0), "x")


@query("q12_total", "SELECT count(*) AS total FROM customer")
def q12(spark, sf_dir):
    return P.match(triples(spark, sf_dir), X, B + "acctbal", V).agg(F.count("*").alias("total"))


# ---------------------------------------------------------------- F


def balances(spark, sf_dir):
    return P.match(triples(spark, sf_dir), X, B + "acctbal", V)


def labels(spark, sf_dir):
    return P.match(triples(spark, sf_dir), X, LABEL, L).where(value_of(F.col("x")).contains("/document/"))


def tested(rows: DataFrame, test, *cols: str) -> DataFrame:
    return rows.select(*[value_of(F.col(c)).alias(c) for c in cols], test.alias("test"))


@query("f01_equality", f"SELECT {CUSTOMER} AS x, c_mktsegment = 'BUILDING' AS test, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END = 'BUILDING', false) AS eq, NOT coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END = 'BUILDING', false) AS ne FROM customer")
def f01(spark, sf_dir):
    t = triples(spark, sf_dir)
    word = term_key("lit", "BUILDING", "en")
    rows = P.optional(P.match(t, X, B + "segment", L), P.match(t, X, B + "acctbal", V), P.compare(">", F.col("v"), term_key("lit", "0")))
    m = F.when(F.col("v").isNotNull(), F.col("l"))
    return rows.select(value_of(F.col("x")).alias("x"), P.equal(F.col("l"), word).alias("test"), P.equal(m, word).alias("eq"), P.unequal(m, word).alias("ne"))


@query("f02_compare", f"SELECT {CUSTOMER} AS x, c_acctbal < 1000 AS lt, c_acctbal > 1000 AS gt, c_acctbal <= 711.56 AS le, c_acctbal >= 711.56 AS ge, {BAL} < '5x' AS as_text, c_acctbal > 0 AS above_empty FROM customer")
def f02(spark, sf_dir):
    k = lambda v: term_key("lit", v)
    v = F.col("v")
    return balances(spark, sf_dir).select(value_of(F.col("x")).alias("x"), P.compare("<", v, k("1000")).alias("lt"), P.compare(">", v, k("1e3")).alias("gt"), P.compare("<=", v, k("711.56")).alias("le"), P.compare(">=", v, k("711.56")).alias("ge"), P.compare("<", v, k("5x")).alias("as_text"), P.compare(">", v, k("")).alias("above_empty"))


@query("f03_logic", f"SELECT {CUSTOMER} AS x, c_acctbal > 0 AND c_acctbal < 5000 AS test, c_acctbal > 0 OR c_acctbal < -500 AS either, NOT c_acctbal > 0 AS neg FROM customer")
def f03(spark, sf_dir):
    k = lambda v: term_key("lit", v)
    pos = P.compare(">", F.col("v"), k("0"))
    rows = balances(spark, sf_dir)
    return rows.select(value_of(F.col("x")).alias("x"), P.both(pos, P.compare("<", F.col("v"), k("5000"))).alias("test"), P.either(pos, P.compare("<", F.col("v"), k("-500"))).alias("either"), P.negate(pos).alias("neg"))


@query("f04_regex", f"SELECT '{B}document/' || doc_id AS x, regexp_matches(text, '(?i)(^| )THE ') AS test, false AS bad FROM documents")
def f04(spark, sf_dir):
    return labels(spark, sf_dir).select(value_of(F.col("x")).alias("x"), P.regex(F.col("l"), "(^| )THE ", "i").alias("test"), P.regex(F.col("l"), "(").alias("bad"))


@query("f05_substrings", f"SELECT '{B}document/' || doc_id AS x, contains(text, 'on') AS has, starts_with(text, 'The') AS first, suffix(text, '.') AS last FROM documents")
def f05(spark, sf_dir):
    return labels(spark, sf_dir).select(value_of(F.col("x")).alias("x"), P.contains(F.col("l"), "on").alias("has"), P.starts(F.col("l"), "The").alias("first"), P.ends(F.col("l"), ".").alias("last"))


@query("f06_lang", f"SELECT '{B}document/' || doc_id AS x, lang, lang <> '' AS tagged FROM documents")
def f06(spark, sf_dir):
    return labels(spark, sf_dir).select(value_of(F.col("x")).alias("x"), P.lang(F.col("l")).alias("lang"), P.has_lang(F.col("l")).alias("tagged"))


@query("f07_lang_matches", f"SELECT '{B}document/' || doc_id AS x, lower(lang) = 'en' OR lower(lang) LIKE 'en-%' AS en, lang <> '' AS any_lang FROM documents")
def f07(spark, sf_dir):
    tag = P.lang(F.col("l"))
    return labels(spark, sf_dir).select(value_of(F.col("x")).alias("x"), P.lang_matches(tag, "EN").alias("en"), P.lang_matches(tag, "*").alias("any_lang"))


@query("f08_kinds", f"SELECT {CUSTOMER} AS x, 'http://www.w3.org/2000/01/rdf-schema#subClassOf' AS y, true AS iri, false AS lit FROM customer UNION ALL SELECT {CUSTOMER}, '{B}acctbal', false, true FROM customer UNION ALL SELECT {CUSTOMER}, '{B}segment', false, true FROM customer UNION ALL SELECT {CUSTOMER}, '{LABEL}', false, true FROM customer UNION ALL SELECT {CUSTOMER}, '{TYPE}', true, false FROM customer")
def f08(spark, sf_dir):
    rows = P.match(triples(spark, sf_dir), X, Y, V)
    rows = P.keep(rows, P.both(P.bound(F.col("v")), F.contains(value_of(F.col("x")), F.lit("/customer/"))))
    return rows.select(value_of(F.col("x")).alias("x"), value_of(F.col("y")).alias("y"), P.is_iri(F.col("v")).alias("iri"), P.is_literal(F.col("v")).alias("lit"))


@query("f09_str", f"SELECT {CUSTOMER} AS x, {BAL} AS text, true AS test FROM customer")
def f09(spark, sf_dir):
    return balances(spark, sf_dir).select(value_of(F.col("x")).alias("x"), P.text(F.col("v")).alias("text"), (P.text(F.col("v")) != "").alias("test"))


@query("f10_strings", f"SELECT '{B}document/' || doc_id AS x, sha256(replace(upper(text), chr(7838), 'SS')) AS up, sha256(lower(text)) AS low, length(text) AS n, sha256(lang || '/' || text) AS both FROM documents")
def f10(spark, sf_dir):
    """Digests of whole texts in capitals, in small letters, and after their language."""
    label = F.col("l")
    digest = lambda c: F.sha2(c, 256)
    return labels(spark, sf_dir).select(value_of(F.col("x")).alias("x"), digest(P.upper(label)).alias("up"), digest(P.lower(label)).alias("low"), P.length(label).cast("long").alias("n"), digest(P.concat(term_key("lit", P.lang(label)), term_key("lit", "/"), label)).alias("both"))


@query("f11_truth", f"SELECT '{B}part/' || p_partkey AS x, p_size <> 0 AS test FROM part")
def f11(spark, sf_dir):
    rows = P.match(triples(spark, sf_dir), X, B + "size", V)
    return tested(rows, P.truth(F.col("v")), "x")


# ---------------------------------------------------------------- store, rendering, statistics


STORE_SQL = f"""
SELECT {CUSTOMER} AS s, '{SUB}' AS p, 'iri' AS o_kind, '{B}nation/' || c_nationkey AS o, '' AS o_lang FROM customer
UNION ALL SELECT {CUSTOMER}, '{TYPE}', 'iri', '{OWL}Class', '' FROM customer
UNION ALL SELECT {CUSTOMER}, '{LABEL}', 'lit', c_name, 'en' FROM customer
UNION ALL SELECT {CUSTOMER}, '{B}segment', 'lit', c_mktsegment, 'en' FROM customer
UNION ALL SELECT {CUSTOMER}, '{B}acctbal', 'lit', {BAL}, '' FROM customer
UNION ALL SELECT '{B}part/' || p_partkey, '{SKOS}altLabel', 'lit', p_brand, '' FROM part
UNION ALL SELECT '{B}part/' || p_partkey, '{LABEL}', 'lit', p_name, 'en' FROM part
UNION ALL SELECT '{B}part/' || p_partkey, '{TYPE}', 'iri', '{B}ptype/' || p_type, '' FROM part
UNION ALL SELECT '{B}part/' || p_partkey, '{TYPE}', 'iri', '{B}brand/' || p_brand, '' FROM part
UNION ALL SELECT '{B}part/' || p_partkey, '{B}size', 'lit', CAST(p_size AS VARCHAR), '' FROM part
UNION ALL SELECT '{B}supplier/' || s_suppkey, '{B}locatedIn', 'iri', '{B}nation/' || s_nationkey, '' FROM supplier"""


@query("s13_store_build", STORE_SQL)
def s13(spark, sf_dir):
    rows = store.triples(onto(spark, sf_dir))
    return rows.where("s like '%/customer/%' or s like '%/part/%' or s like '%/supplier/%'").select("s", "p", "o_kind", "o", "o_lang")


@query("s13_partitioned_store", f"SELECT '{B}part/' || p_partkey AS x, p_brand AS l FROM part")
def s13_written(spark, sf_dir):
    """Written by predicate and read back: the pattern reads one folder."""
    from termweave.plans.tables import shared_path

    path = shared_path(spark, "triples")
    store.write(triples(spark, sf_dir), path)
    return names(P.match(spark.read.parquet(path), X, SKOS + "altLabel", L), "x", "l")


@query("k07_term_text", f"SELECT s, CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN o_lang <> '' THEN '\"' || o || '\"@' || o_lang WHEN p = '{B}acctbal' THEN '\"' || o || '\"^^<http://www.w3.org/2001/XMLSchema#decimal>' WHEN p = '{B}size' THEN '\"' || o || '\"^^<http://www.w3.org/2001/XMLSchema#integer>' ELSE '\"' || o || '\"' END AS text FROM ({STORE_SQL})")
def k07(spark, sf_dir):
    rows = triples(spark, sf_dir).where("s like '%/customer/%' or s like '%/part/%' or s like '%/supplier/%'")
    return rows.select("s", P.term_text(F.col("o_key")).alias("text"))


@query("a01_statistics", "SELECT 'class' AS type, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) + (SELECT count(DISTINCT p_type) + count(DISTINCT p_brand) FROM part) AS n UNION ALL SELECT 'individual', count(*) FROM part UNION ALL SELECT 'objectProperty', 3 UNION ALL SELECT 'dataProperty', 2 UNION ALL SELECT 'annotationProperty', 1")
def a01(spark, sf_dir):
    return onto(spark, sf_dir, True).entity.groupBy("type").agg(F.count("*").alias("n"))


@query("a02_member_count", f"SELECT '{B}ptype/' || p_type AS class, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT '{B}brand/' || p_brand, count(*) FROM part GROUP BY 1")
def a02(spark, sf_dir):
    return onto(spark, sf_dir).type_assert.groupBy("class").agg(F.count("*").alias("n"))


@query("a04_first_of_each", "SELECT c_mktsegment AS key, min(c_custkey) AS first FROM customer GROUP BY 1")
def a04(spark, sf_dir):
    """Distinct values in the order they first occur."""
    ann = onto(spark, sf_dir).annotation.where(F.col("prop") == B + "segment")
    return first_of_each(ann.select(F.col("text").alias("key"), local_name(F.col("iri")).cast("long").alias("ord")), ["key"], "ord").select("key", F.col("ord").alias("first"))


def first_of_each(rows: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """One row for each key, the least by order."""
    return rows.groupBy(*keys).agg(F.min(ord_col).alias(ord_col))


@query("a05_adjacency", f"SELECT '{B}nation/' || c_nationkey AS parent, list(DISTINCT {CUSTOMER} ORDER BY {CUSTOMER}) AS children FROM customer GROUP BY 1")
def a05(spark, sf_dir):
    edges = onto(spark, sf_dir).class_edge.where("sup like '%/nation/%'")
    return edges.groupBy(F.col("sup").alias("parent")).agg(F.array_sort(F.collect_set("sub")).alias("children"))
