"""Hierarchies (H01-H06), labels and search (L), neighbourhoods (N), scalar functions (X) and checks (D)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.catalogs import query
from termweave.catalogs.graph import CUSTOMER, NATION, onto
from termweave.functions import expressions as E
from termweave.model import BASE, OWL, SKOS, THING, Ontology, local_name, table
from termweave.operators import hierarchy as H
from termweave.operators import labelindex as L
from termweave.operators import neighbourhood as N
from termweave.operators import quality as D
from termweave.operators import rendering as R
from termweave.operators import search as S
from termweave.plans.tables import shared_path

B = BASE
CHAIN = f"""(SELECT {CUSTOMER} AS sub, '{B}nation/' || c_nationkey AS sup FROM customer UNION ALL SELECT {NATION}, '{B}region/' || n_regionkey FROM nation
UNION ALL SELECT '{B}order/' || o_orderkey, '{B}customer/' || o_custkey FROM orders)"""
LINES = f"SELECT DISTINCT '{B}line/' || l_orderkey || '-' || l_linenumber AS sub, '{B}order/' || l_orderkey AS sup FROM lineitem"


def with_expressions(spark, sf_dir) -> Ontology:
    """Customers defined by an expression instead of an edge: a conjunction, or for every seventh a disjunction."""
    x = onto(spark, sf_dir)
    c = table(spark, sf_dir, "customer")
    nation = F.concat(F.lit(B + "nation/"), F.col("c_nationkey").cast("string"))
    expr = F.when(F.col("c_custkey") % 7 == 0, F.concat(nation, F.lit(f" or {B}region/0"))).otherwise(F.concat(nation, F.lit(f" and ({B}hasPart some ({B}region/1 and {B}region/2))")))
    rows = c.select(F.lit("shop").alias("onto_id"), F.concat(F.lit(B + "customer/"), F.col("c_custkey").cast("string")).alias("iri"), F.lit("equiv").alias("role"), F.lit(0).alias("ord"), expr.alias("expr"))
    return replace(x, class_edge=x.class_edge.where("sub not like '%/customer/%'"), class_expr=rows)


@query("h01_asserted_edges", f"SELECT sub, sup FROM (SELECT {CUSTOMER} AS sub, CASE WHEN c_custkey % 7 = 0 THEN '{THING}' ELSE '{B}nation/' || c_nationkey END AS sup FROM customer UNION ALL SELECT {NATION}, '{B}region/' || n_regionkey FROM nation UNION ALL SELECT '{B}order/' || o_orderkey, '{B}customer/' || o_custkey FROM orders UNION ALL SELECT '{B}region/' || r_regionkey, '{THING}' FROM region UNION ALL SELECT DISTINCT '{B}ptype/' || p_type, '{THING}' FROM part UNION ALL SELECT DISTINCT '{B}brand/' || p_brand, '{THING}' FROM part)")
def h01(spark, sf_dir):
    return H.asserted_edges(with_expressions(spark, sf_dir)).select("sub", "sup")


@query("h02_property_hierarchy", f"SELECT 'objectProperty' AS kind, '{B}of/' || p_brand AS sub, '{B}of/' || p_type AS sup FROM part UNION SELECT 'objectProperty', '{B}of/' || p_type, '{OWL}topObjectProperty' FROM part UNION SELECT 'dataProperty', '{B}in/' || c_mktsegment, '{OWL}topDataProperty' FROM customer UNION SELECT 'annotationProperty', '{B}note/' || lang, 'annotations' FROM documents")
def h02(spark, sf_dir):
    """Brands as properties below those of the types they occur with; segments and languages as properties without a super."""
    o = F.lit("shop").alias("onto_id")
    part, segment, lang = (table(spark, sf_dir, t).select(*c).distinct() for t, c in (("part", ("p_brand", "p_type")), ("customer", ("c_mktsegment",)), ("documents", ("lang",))))
    name = lambda kind, c: F.concat(F.lit(f"{B}{kind}/"), F.col(c))
    ent = lambda d, iri, kind: d.select(o, iri.alias("iri"), F.lit(kind).alias("type")).distinct()
    entity = ent(part, name("of", "p_brand"), "objectProperty").unionByName(ent(part, name("of", "p_type"), "objectProperty")).unionByName(ent(segment, name("in", "c_mktsegment"), "dataProperty")).unionByName(ent(lang, name("note", "lang"), "annotationProperty"))
    edges = part.select(o, name("of", "p_brand").alias("prop"), name("of", "p_type").alias("target"), F.lit("sub").alias("kind"))
    x = replace(onto(spark, sf_dir), entity=entity, prop_edge=edges)
    kinds = [H.property_edges(x, k).select(F.lit(k).alias("kind"), "sub", "sup") for k in H.TOP_PROPERTY]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("h03_closure", f"""
WITH e AS (SELECT * FROM {CHAIN} UNION ALL {LINES}), e2 AS (SELECT a.sub, b.sup FROM e a JOIN e b ON a.sup = b.sub), e3 AS (SELECT a.sub, b.sup FROM e2 a JOIN e b ON a.sup = b.sub), e4 AS (SELECT a.sub, b.sup FROM e3 a JOIN e b ON a.sup = b.sub)
SELECT sub, sup FROM e UNION SELECT * FROM e2 UNION SELECT * FROM e3 UNION SELECT * FROM e4""")
def h03(spark, sf_dir):
    return H.closure(onto(spark, sf_dir, True).class_edge).select("sub", "sup")


def view_sql(edges: str) -> str:
    return f"""
WITH e AS ({edges}), f AS (SELECT {NATION} AS focus FROM nation),
l AS (SELECT {CUSTOMER} AS iri, c_name AS label FROM customer UNION ALL SELECT {NATION}, n_name FROM nation UNION ALL SELECT '{B}region/' || r_regionkey, r_name FROM region),
r AS (SELECT focus, 0 AS level, sup AS iri FROM f JOIN e ON sub = focus UNION SELECT focus, 1, focus FROM f UNION SELECT focus, 2, sub FROM f JOIN e ON sup = focus)
SELECT focus, level, CAST(row_number() OVER (PARTITION BY focus, level ORDER BY lower(label), iri) AS INTEGER) AS pos, iri, label FROM r JOIN l USING (iri)"""


def nations(x: Ontology):
    return x.entity.where("iri like '%/nation/%'").select("onto_id", F.col("iri").alias("focus"))


@query("h04_local_view", view_sql(f"SELECT * FROM {CHAIN}"))
def h04(spark, sf_dir):
    x = onto(spark, sf_dir)
    return H.local_view(x.class_edge.where("kind = 'sub'"), x.label.select("onto_id", "iri", F.col("text").alias("label")), nations(x)).drop("onto_id")


@query("h06_individuals_by_class", f"SELECT '{B}ptype/' || p_type AS class, count(*) AS n, list('{B}part/' || p_partkey ORDER BY '{B}part/' || p_partkey) AS members FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT '_unclassified', count(*), list('{B}part/' || p_partkey ORDER BY '{B}part/' || p_partkey) FROM part WHERE p_partkey % 5 = 0")
def h06(spark, sf_dir):
    x = onto(spark, sf_dir)
    typed = x.type_assert.where("class like '%/ptype/%'").where(local_name(F.col("ind")).cast("long") % 5 != 0)
    return H.individuals_by_class(replace(x, type_assert=typed)).drop("onto_id")


# ---------------------------------------------------------------- L


@query("l01_preferred_label", f"SELECT {CUSTOMER} AS iri, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'x-' || c_name ELSE CAST(c_custkey AS VARCHAR) END AS label FROM customer")
def l01(spark, sf_dir):
    """A third of the customers with a German and an English label, a third with a SKOS label only, a third with none."""
    x = onto(spark, sf_dir)
    k = local_name(F.col("iri")).cast("long")
    own = x.label.where("iri like '%/customer/%'").withColumn("k", k)
    english = own.where("k % 3 = 0").drop("k")
    german = english.select("onto_id", "iri", F.lit("de").alias("lang"), "ord", F.concat(F.lit("d-"), "text").alias("text"))
    skos = own.where("k % 3 = 1").select("onto_id", "iri", F.lit(SKOS + "prefLabel").alias("prop"), "ord", F.concat(F.lit("x-"), "text").alias("raw"), F.concat(F.lit("x-"), "text").alias("text"), F.lit("").alias("lang"))
    y = replace(x, entity=x.entity.where("iri like '%/customer/%'"), label=english.unionByName(german), annotation=skos)
    return S.preferred(y).select("iri", "label")


@query("l02_search_text", f"SELECT '{B}part/' || p_partkey AS iri, lower(p_name) AS text FROM part UNION ALL SELECT '{B}part/' || p_partkey, lower(p_brand) FROM part")
def l02(spark, sf_dir):
    return S.search_text(onto(spark, sf_dir)).where("iri like '%/part/%'").select("iri", "text")


def part_words(spark, sf_dir):
    """The queries: every distinct two-word part name with its words swapped, one for each brand's beginning."""
    p = table(spark, sf_dir, "part")
    swapped = p.select(F.concat_ws(" ", F.split("p_name", " ")[1], F.split("p_name", " ")[0]).alias("query")).distinct()
    mixed = p.select(F.concat_ws(" ", F.split("p_name", " ")[0], "p_brand").alias("query")).distinct()
    return swapped.unionByName(mixed).distinct().select(F.col("query").alias("query_id"), "query")


SEARCH_SQL = f"""
WITH p AS (SELECT '{B}part/' || p_partkey AS iri, lower(p_name) AS a, lower(p_brand) AS b FROM part),
q AS (SELECT DISTINCT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS query_id FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || p_brand FROM part),
t AS (SELECT query_id, lower(query_id) AS q, lower(split_part(query_id, ' ', 1)) AS t1, lower(split_part(query_id, ' ', 2)) AS t2 FROM q),
m AS (SELECT query_id, iri, a, b, q, t1, t2, contains(a, t1) AND contains(a, t2) AS in_a, contains(b, t1) AND contains(b, t2) AS in_b FROM p JOIN t ON (contains(a, t1) OR contains(b, t1)) AND (contains(a, t2) OR contains(b, t2))),
w AS (SELECT *, list_max([CASE WHEN w = t1 THEN 4.0 WHEN starts_with(w, t1) THEN 3.0 WHEN contains(w, t1) THEN 1.0 ELSE 0.0 END FOR w IN string_split(a, ' ')]) AS a1, list_max([CASE WHEN w = t2 THEN 4.0 WHEN starts_with(w, t2) THEN 3.0 WHEN contains(w, t2) THEN 1.0 ELSE 0.0 END FOR w IN string_split(a, ' ')]) AS a2 FROM m),
s AS (SELECT query_id, iri, CASE WHEN in_a AND a = q THEN 100.0 WHEN in_a AND starts_with(a, q) THEN 50 - length(a) * 0.01 WHEN in_a THEN (a1 + a2) / 2 * 5 - length(a) * 0.01 WHEN in_b THEN 100.0 ELSE 1 - (length(a) + length(b)) / 2.0 * 0.001 END AS score FROM w),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, iri) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, iri, CAST(round(score, 6) AS DOUBLE) AS score FROM r WHERE rank <= 50"""


@query("l03_token_search", SEARCH_SQL)
def l03(spark, sf_dir):
    """Search, scores and top 50 (L03, L04, L05) for many queries at once."""
    x = onto(spark, sf_dir)
    parts = replace(x, entity=x.entity.where("iri like '%/part/%'"), label=x.label.where("iri like '%/part/%'"))
    return S.search(parts, part_words(spark, sf_dir)).select("query_id", "rank", "iri", F.round("score", 6).alias("score"))


@query("l03_written_index", SEARCH_SQL)
def l03_index(spark, sf_dir):
    """A written index of an earlier version, brought to the present one by the entities that changed, and searched.

    In the earlier version parts with keys ending in 0 are missing, those ending in 1 have another name,
    and there is a part more for each key ending in 2.
    """
    x = onto(spark, sf_dir)
    new = replace(x, entity=x.entity.where("iri like '%/part/%'"), label=x.label.where("iri like '%/part/%'"))
    last = F.right("iri", F.lit(1))
    more = lambda d: d.where(last != "0").unionByName(d.where(last == "2").withColumn("iri", F.concat("iri", F.lit("-old"))))
    old = replace(new, entity=more(new.entity), label=more(new.label).withColumn("text", F.when(last == "1", F.concat(F.lit("former "), "text")).otherwise(F.col("text"))))
    rows = lambda d: d.entity.unionByName(d.label.select("onto_id", "iri", F.concat("lang", F.lit(" "), "text").alias("type")))
    a, b = rows(old), rows(new)
    touched = a.exceptAll(b).unionByName(b.exceptAll(a)).select("onto_id", "iri")
    index = L.build(old, L.LabelIndex(spark, shared_path(spark, "labels")))
    L.update(index, old, new, touched)
    return L.search(index, part_words(spark, sf_dir)).select("query_id", "rank", "iri", F.round("score", 6).alias("score"))


@query("l05_top_k", f"SELECT * FROM ({SEARCH_SQL}) WHERE rank <= 3")
def l05(spark, sf_dir):
    x = onto(spark, sf_dir)
    parts = replace(x, entity=x.entity.where("iri like '%/part/%'"), label=x.label.where("iri like '%/part/%'"))
    return S.search(parts, part_words(spark, sf_dir), 3).select("query_id", "rank", "iri", F.round("score", 6).alias("score"))


@query("l06_exact_label", f"SELECT upper(p_name) AS label, '{B}part/' || p_partkey AS iri FROM part UNION SELECT upper(p_brand), '{B}part/' || p_partkey FROM part")
def l06(spark, sf_dir):
    x = onto(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    wanted = p.select(F.upper("p_name").alias("label")).unionByName(p.select(F.upper("p_brand").alias("label"))).distinct()
    return S.exact_label(replace(x, label=x.label.where("iri like '%/part/%'")), wanted)


@query("l07_exact_local_name", f"SELECT CAST(n_nationkey AS VARCHAR) AS name, {NATION} AS iri FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), {CUSTOMER} FROM nation JOIN customer ON c_custkey = n_nationkey")
def l07(spark, sf_dir):
    x = onto(spark, sf_dir)
    two = replace(x, entity=x.entity.where("iri like '%/nation/%' or iri like '%/customer/%'"))
    return S.exact_local(two, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name")))


@query("l08_resolve", f"SELECT ':' || CAST(c_custkey AS VARCHAR) AS token, {CUSTOMER} AS iri FROM customer UNION ALL SELECT '<' || {CUSTOMER} || '>', {CUSTOMER} FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), {CUSTOMER} FROM customer UNION ALL SELECT '''' || upper(c_name) || '''', {CUSTOMER} FROM customer UNION ALL SELECT 'no ' || c_name, NULL FROM customer")
def l08(spark, sf_dir):
    x = onto(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name")
    toks = c.select(F.explode(F.array(F.concat(F.lit(":"), "k"), F.concat(F.lit(f"<{B}customer/"), "k", F.lit(">")), F.col("k"), F.concat(F.lit("'"), F.upper("c_name"), F.lit("'")), F.concat(F.lit("no "), "c_name"))).alias("token"))
    return S.resolve(toks, replace(x, entity=x.entity.where("iri like '%/customer/%'"), label=x.label.where("iri like '%/customer/%'")), B + "customer/")


@query("l09_label_map", f"SELECT {CUSTOMER} AS iri, '{B}nation/' || c_nationkey AS ref, n_name AS label FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT {CUSTOMER}, '{B}acctbal', 'acctbal' FROM customer")
def l09(spark, sf_dir):
    x = onto(spark, sf_dir)
    rows = S.label_map(x, S.preferred(x)).where("iri like '%/customer/%'")
    return rows.select("iri", F.explode("labels").alias("ref", "label"))


@query("l10_entity_kind", f"SELECT '{B}part/' || p_partkey AS iri, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'individual' END AS type FROM part")
def l10(spark, sf_dir):
    """Half of the parts are declared as classes too."""
    x = onto(spark, sf_dir)
    parts = x.entity.where("iri like '%/part/%'")
    both = parts.unionByName(parts.where(local_name(F.col("iri")).cast("long") % 2 == 0).withColumn("type", F.lit("class")))
    return S.kinds(replace(x, entity=both)).select("iri", "type")


@query("l11_entity_document", f"SELECT {CUSTOMER} AS iri, 'class' AS type, c_name AS label, c_mktsegment AS annotation, '{B}nation/' || c_nationkey AS sup, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS value, n_name AS sup_label FROM customer JOIN nation ON n_nationkey = c_nationkey")
def l11(spark, sf_dir):
    x = onto(spark, sf_dir)
    d = S.documents(x, S.preferred(x)).where("iri like '%/customer/%'")
    return d.select("iri", "type", F.col("labels")[0]["text"].alias("label"), F.col("annotations")[0]["text"].alias("annotation"), F.col("edges")[0]["sup"].alias("sup"), F.col("values")[0]["value"].alias("value"), F.element_at("label_map", F.col("edges")[0]["sup"]).alias("sup_label"))


# ---------------------------------------------------------------- N


@query("n01_start_set", f"SELECT '{B}region/' || r_regionkey AS iri FROM region")
def n01(spark, sf_dir):
    return N.start_set(onto(spark, sf_dir)).select("iri")


STEP = f"(SELECT sub AS at, sup AS nxt, sub || '|sub|' || sup AS id FROM {CHAIN} UNION ALL SELECT sup, sub, sub || '|sub|' || sup FROM {CHAIN})"


@query("n02_two_hops", f"SELECT {NATION} AS focus, {NATION} AS iri, 0 AS hop FROM nation UNION SELECT {NATION}, nxt, 1 FROM nation JOIN {STEP} s ON s.at = {NATION} UNION SELECT {NATION}, b.nxt, 2 FROM nation JOIN {STEP} a ON a.at = {NATION} JOIN {STEP} b ON b.at = a.nxt WHERE b.nxt <> {NATION} AND b.nxt NOT IN (SELECT nxt FROM {STEP} z WHERE z.at = {NATION})")
def n02(spark, sf_dir):
    x = onto(spark, sf_dir)
    nodes, _ = N.expand(nations(x), N.steps(x), 2, 1_000_000)
    return nodes.select("focus", "iri", "hop")


@query("n02_node_cap", f"WITH r AS (SELECT {NATION} AS focus, {NATION} AS iri, 0 AS hop FROM nation UNION SELECT {NATION}, nxt, 1 FROM nation JOIN {STEP} s ON s.at = {NATION}) SELECT focus, iri, hop FROM (SELECT *, row_number() OVER (PARTITION BY focus ORDER BY hop, iri) AS n FROM r) WHERE n <= 10")
def n02_cap(spark, sf_dir):
    x = onto(spark, sf_dir)
    return N.expand(nations(x), N.steps(x), 1, 10)[0].select("focus", "iri", "hop")


@query("n03_edges", f"SELECT {NATION} AS focus, id FROM nation JOIN {STEP} s ON s.at = {NATION}")
def n03(spark, sf_dir):
    x = onto(spark, sf_dir)
    return N.expand(nations(x), N.steps(x), 1, 1_000_000)[1].select("focus", "id")


@query("n03_inferred_and_symmetric", f"SELECT {NATION} AS focus, n.id, n.type FROM nation JOIN (SELECT '{B}region/' || r_regionkey AS at, '{B}nation/' || n_nationkey || '|inf|{B}region/' || r_regionkey AS id, 'inferred' AS type FROM nation JOIN region ON n_regionkey <> r_regionkey AND n_nationkey % 5 = r_regionkey) n ON false UNION ALL SELECT '{B}region/' || r_regionkey, '{B}nation/' || n_nationkey || '|inf|{B}region/' || r_regionkey, 'inferred' FROM nation JOIN region ON n_regionkey <> r_regionkey AND n_nationkey % 5 = r_regionkey UNION ALL SELECT '{B}region/' || a.r_regionkey, '{B}region/' || least(a.r_regionkey, b.r_regionkey) || '|dis|{B}region/' || greatest(a.r_regionkey, b.r_regionkey), 'disjointWith' FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey UNION ALL SELECT '{B}region/' || n_regionkey, {NATION} || '|sub|{B}region/' || n_regionkey, 'subClassOf' FROM nation")
def n03_kinds(spark, sf_dir):
    """Regions disjoint from each other, nations inferred under a region that may be their own already."""
    x = onto(spark, sf_dir)
    r = table(spark, sf_dir, "region").select(F.concat(F.lit(B + "region/"), F.col("r_regionkey").cast("string")).alias("r"))
    pairs = r.withColumnRenamed("r", "sub").join(r.withColumnRenamed("r", "sup"), F.col("sub") != F.col("sup"))
    dis = pairs.select(F.lit("shop").alias("onto_id"), "sub", "sup", F.lit("disjoint").alias("kind"), F.lit(0).alias("ord"))
    y = replace(x, class_edge=x.class_edge.unionByName(dis))
    nation = table(spark, sf_dir, "nation")
    inferred = nation.select(F.lit("shop").alias("onto_id"), F.concat(F.lit(B + "region/"), (F.col("n_nationkey") % 5).cast("string")).alias("parent"), F.concat(F.lit(B + "nation/"), F.col("n_nationkey").cast("string")).alias("child"))
    foci = r.select(F.lit("shop").alias("onto_id"), F.col("r").alias("focus"))
    return N.expand(foci, N.steps(y, inferred, True), 1, 1_000_000)[1].select("focus", "id", "type")


@query("n04_graph", f"WITH nodes AS (SELECT {NATION} AS focus, {NATION} AS iri FROM nation UNION SELECT {NATION}, nxt FROM nation JOIN {STEP} s ON s.at = {NATION}) SELECT DISTINCT a.focus, e.id FROM nodes a JOIN {STEP} e ON e.at = a.iri JOIN nodes b ON b.focus = a.focus AND b.iri = e.nxt")
def n04(spark, sf_dir):
    """Edges of the neighbourhoods with those among their nodes (N04), none dangling."""
    x = onto(spark, sf_dir)
    return N.graph(nations(x), x, S.preferred(x), 1, 1_000_000)[1].select("focus", "id")


@query("n05_nodes", f"SELECT {NATION} AS focus, {NATION} AS iri, n_name AS label, 'class' AS type, true AS is_root FROM nation UNION ALL SELECT {NATION}, '{B}region/' || n_regionkey, r_name, 'class', false FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT {NATION}, {CUSTOMER}, c_name, 'class', false FROM nation JOIN customer ON c_nationkey = n_nationkey")
def n05(spark, sf_dir):
    x = onto(spark, sf_dir)
    return N.graph(nations(x), x, S.preferred(x), 1, 1_000_000)[0].select("focus", "iri", "label", "type", "is_root")


@query("n06_closed_edges", f"SELECT sub AS source, sup AS target FROM {CHAIN} WHERE sub LIKE '%/nation/%'")
def n06(spark, sf_dir):
    x = onto(spark, sf_dir)
    nodes = x.entity.where("iri like '%/nation/%' or iri like '%/region/%'").select("onto_id", F.lit("all").alias("focus"), "iri")
    edges = x.class_edge.select("onto_id", F.lit("all").alias("focus"), F.col("sub").alias("source"), F.col("sup").alias("target"))
    return N.closed(edges, nodes).select("source", "target")


# ---------------------------------------------------------------- X


def expressions(spark, sf_dir):
    """expr of every customer: a class, two restrictions and a nested conjunction."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    n = F.col("c_nationkey").cast("string")
    part = F.concat(F.lit(f"{B}nation/"), n, F.lit(" and 'Laterality' some "), F.lit(f"{B}region/1 and 'Regional part of' some ({B}region/2 and {B}region/3) and 'Proper part of' some {B}customer/"), k, F.lit(f" and {B}region/4"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("A or B and "), k)).otherwise(part).alias("expr"))


@query("x06_conjuncts", f"SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'A or B|' || c_custkey ELSE '{B}nation/' || c_nationkey || '|''Laterality'' some {B}region/1|''Regional part of'' some ({B}region/2 and {B}region/3)|''Proper part of'' some {B}customer/' || c_custkey || '|{B}region/4' END AS parts FROM customer")
def x06(spark, sf_dir):
    return expressions(spark, sf_dir).select("c_custkey", F.array_join(E.conjuncts(F.col("expr")), "|").alias("parts"))


@query("x08_sorted_conjuncts", f"SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'A or B and ' || c_custkey ELSE '{B}nation/' || c_nationkey || ' and {B}region/4 and ''Proper part of'' some {B}customer/' || c_custkey || ' and ''Regional part of'' some ({B}region/2 and {B}region/3) and ''Laterality'' some {B}region/1' END AS expr FROM customer")
def x08(spark, sf_dir):
    return expressions(spark, sf_dir).select("c_custkey", E.sorted_conjuncts(F.col("expr")).alias("expr"))


def prefixes(spark, sf_dir):
    """One prefix for each nation, one for all customers."""
    n = table(spark, sf_dir, "nation")
    own = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit(f"{B}customer/"), F.col("n_nationkey").cast("string")).alias("expansion"))
    return own.unionByName(n.select(F.lit("c").alias("name"), F.lit(f"{B}customer/").alias("expansion")).distinct())


@query("x01_expand_curie", f"SELECT 'c:' || c_custkey AS word, {CUSTOMER} AS iri FROM customer UNION ALL SELECT 'zz:' || c_custkey, 'zz:' || c_custkey FROM customer")
def x01(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.explode(F.array(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")), F.concat(F.lit("zz:"), F.col("c_custkey").cast("string")))).alias("word"))
    return R.expand(c, prefixes(spark, sf_dir), "word").select("word", "iri")


@query("x02_abbreviate", f"WITH p AS (SELECT 'n' || n_nationkey AS name, CAST(n_nationkey AS VARCHAR) AS x FROM nation UNION ALL SELECT 'c', ''), r AS (SELECT c_custkey, name || ':' || substr(CAST(c_custkey AS VARCHAR), length(x) + 1) AS curie, row_number() OVER (PARTITION BY c_custkey ORDER BY length(x) DESC) AS k FROM customer JOIN p ON starts_with(CAST(c_custkey AS VARCHAR), x)) SELECT {CUSTOMER} AS iri, curie FROM r WHERE k = 1")
def x02(spark, sf_dir):
    c = onto(spark, sf_dir).entity.where("iri like '%/customer/%'").select("iri")
    return R.abbreviate(c, prefixes(spark, sf_dir), "iri").select("iri", "curie")


@query("x03_short_iri", f"SELECT {CUSTOMER} AS iri, CASE WHEN c_custkey % 2 = 0 THEN ':customer/' || c_custkey ELSE ':' || c_custkey END AS short, CAST(c_custkey AS VARCHAR) AS local, 'rdfs:label' AS built_in FROM customer")
def x03(spark, sf_dir):
    c = onto(spark, sf_dir).entity.where("iri like '%/customer/%'")
    base = F.when(local_name(F.col("iri")).cast("long") % 2 == 0, "http://b.example").otherwise("http://c.example")
    return c.select("iri", E.short_iri(F.col("iri"), base).alias("short"), local_name(F.col("iri")).alias("local"), E.short_iri(F.lit("http://www.w3.org/2000/01/rdf-schema#label")).alias("built_in"))


LINE_EXPR = f"SELECT DISTINCT '{B}hasPart some {B}part/' || l_partkey AS expr, l_partkey FROM lineitem"


@query("x04_render", f"SELECT expr, 'hasPart some ''' || p_name || '''' AS text, '0-7,13-' || (15 + length(p_name)) AS refs FROM ({LINE_EXPR}) JOIN part ON p_partkey = l_partkey")
def x04(spark, sf_dir):
    """Every expression of the lines with labels in place of names, and where they stand."""
    x = onto(spark, sf_dir, True)
    rows = R.render(x.class_expr.select("expr").distinct(), S.preferred(x).select("iri", "label"))
    return rows.select("expr", "text", F.array_join(F.transform("refs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("refs"))


@query("x05_normalise", f"SELECT DISTINCT 'hasPart some ''' || p_name || ''' and ''no such'' and :' || p_partkey AS expr, '{B}hasPart some <' || min('{B}part/' || p_partkey) OVER (PARTITION BY p_name) || '> and ''no such'' and <{B}part/' || p_partkey || '>' AS normal FROM part".replace(f"'{B}hasPart some <'", f"'<{B}hasPart> some <'"))
def x05(spark, sf_dir):
    """Labels, local names and words back to IRIs; what is unknown stays."""
    x = onto(spark, sf_dir)
    y = replace(x, entity=x.entity.where("iri like '%/part/%' or type = 'objectProperty'"), label=x.label.where("iri like '%/part/%'").unionByName(x.entity.where("type = 'objectProperty'").select("onto_id", "iri", F.lit("").alias("lang"), F.lit(0).alias("ord"), local_name(F.col("iri")).alias("text"))))
    p = table(spark, sf_dir, "part")
    expr = p.select(F.concat(F.lit("hasPart some '"), "p_name", F.lit("' and 'no such' and :"), F.col("p_partkey").cast("string")).alias("expr")).distinct()
    return R.normalise(expr, y, B + "part/").select("expr", "normal")


@query("x09_named_or_complex", f"SELECT expr, named FROM (SELECT DISTINCT '{B}hasPart some {B}part/' || l_partkey AS expr, false AS named FROM lineitem UNION ALL SELECT DISTINCT '{B}order/' || l_orderkey, true FROM lineitem)")
def x09(spark, sf_dir):
    x = onto(spark, sf_dir, True)
    rows = x.class_expr.select("expr").unionByName(x.class_edge.where("sub like '%/line/%'").select(F.col("sup").alias("expr"))).distinct()
    return rows.select("expr", R.named(F.col("expr")).alias("named"))


@query("x10_validity", f"SELECT c_custkey, {CUSTOMER} AS built, true AS ok_iri, c_name LIKE '% %' AS spaced, regexp_full_match(c_name, '[A-Za-z0-9_.\\-]+') AS ok_local FROM customer")
def x10(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    built = E.build_iri(F.lit(B + "customer/"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", built.alias("built"), E.is_valid_iri(built).alias("ok_iri"), F.contains("c_name", F.lit(" ")).alias("spaced"), E.is_valid_local(F.col("c_name")).alias("ok_local"))


@query("x11_namespace", f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'http://cfg/' WHEN 1 THEN 'http://pre#' ELSE NULL END AS ns FROM customer")
def x11(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    cfg = F.when(F.col("c_custkey") % 3 == 0, "http://cfg/").otherwise("http://cfg")
    pre = F.when(F.col("c_custkey") % 3 == 1, "http://pre#")
    return c.select("c_custkey", E.namespace(cfg, pre, F.lit("http://onto")).alias("ns"))


@query("x12_annotation_parts", "SELECT doc_id, text, lang FROM documents")
def x12(spark, sf_dir):
    """Texts stored as text@lang, or quoted with escapes, come back with their language."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    quoted = F.concat(F.lit('"'), F.replace(E.escape(F.col("text")), F.lit("\n"), F.lit("\\n")), F.lit('"@'), F.col("lang"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("@"), "lang")).otherwise(quoted)
    return d.select("doc_id", E.annotation_parts(raw).alias("p")).select("doc_id", "p.text", "p.lang")


@query("x13_unescape", "SELECT doc_id, sha256(text) AS digest FROM documents")
def x13(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    back = E.unescape(F.replace(E.escape(F.col("text")), F.lit("\n"), F.lit("\\n")))
    return d.select("doc_id", F.sha2(back, 256).alias("digest"))


@query("x14_logical_lines", "SELECT l_orderkey AS path, string_agg(x, ' and ' ORDER BY l_linenumber) AS line FROM (SELECT DISTINCT l_orderkey, l_linenumber, 'L' || l_linenumber AS x FROM lineitem) GROUP BY 1")
def x14(spark, sf_dir):
    """Lines that begin with `and` join the line before; blank lines and comments go."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n = F.col("l_linenumber") * 3
    first = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber")) == 1
    text = F.concat(F.when(first, "").otherwise("  and "), F.lit("L"), F.col("l_linenumber").cast("string"))
    rows = own.select(F.col("l_orderkey").alias("path"), n.alias("line_no"), text.alias("text"))
    noise = rows.select("path", (F.col("line_no") + 1).alias("line_no"), F.lit("# note").alias("text")).unionByName(rows.select("path", (F.col("line_no") + 2).alias("line_no"), F.lit("  ").alias("text")))
    return R.logical_lines(rows.unionByName(noise)).select("path", "line")


@query("x16_sct_ids", "SELECT c_custkey, 'http://snomed.info/id/' || c_custkey AS iri, CAST(c_custkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS other FROM customer")
def x16(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    full = E.sct_iri(F.col("c_custkey").cast("string"))
    return c.select("c_custkey", full.alias("iri"), E.sctid(full).alias("id"), E.sctid(F.concat(full, F.lit("x"))).alias("other"))


# ---------------------------------------------------------------- D


@query("d01_incomplete", "SELECT c_custkey, c_custkey % 4 <> 0 AS bad FROM customer")
def d01(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    expr = F.when(k % 4 == 0, "(A and (B or C))").when(k % 4 == 1, "A and p some ").when(k % 4 == 2, "A) and (B").otherwise("(A and B")
    return c.select("c_custkey", E.incomplete(F.concat(F.col("c_custkey").cast("string"), F.lit(" and "), expr)).alias("bad"))


@query("d02_unresolved", "SELECT c_custkey, c_custkey % 3 <> 0 AS bad FROM customer")
def d02(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, 'and <http://x/p> value "a \\" b"').when(k % 3 == 1, "and 'lost label'").otherwise("or lost")
    return c.select("c_custkey", E.unresolved(F.concat(F.lit(f"<{B}customer/"), k.cast("string"), F.lit("> "), tail)).alias("bad"))


@query("d03_validation_report", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'Incomplete expression' ELSE 'Unknown entity reference' END AS message FROM customer WHERE c_custkey % 3 > 0")
def d03(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    expr = F.concat(F.lit(f"<{B}customer/"), k.cast("string"), F.lit("> "), F.when(k % 3 == 0, "and <http://x/q>").when(k % 3 == 1, "and lost some").otherwise("or lost"))
    return D.validation(c.select(k.alias("id"), expr.alias("expr")))


@query("d04_undeclared", f"SELECT DISTINCT '{B}order/' || l_orderkey AS iri FROM lineitem WHERE l_orderkey % 2 = 1 UNION SELECT '{B}acctbal2' FROM customer WHERE false")
def d04(spark, sf_dir):
    """Orders with odd keys are left undeclared."""
    x = onto(spark, sf_dir, True)
    odd = (F.col("iri").contains("/order/")) & (local_name(F.col("iri")).try_cast("long") % 2 == 1)
    y = replace(x, entity=x.entity.where(~F.coalesce(odd, F.lit(False))), class_edge=x.class_edge.where("sub like '%/line/%'"), class_expr=x.class_expr.where("false"), prop_edge=x.prop_edge.where("false"), obj_assert=x.obj_assert.where("false"))
    return D.undeclared(y).select("iri")


@query("d05_unlabelled", f"SELECT '{B}order/' || o_orderkey AS iri FROM orders UNION ALL SELECT DISTINCT '{B}ptype/' || p_type FROM part UNION ALL SELECT DISTINCT '{B}brand/' || p_brand FROM part UNION ALL SELECT unnest(['{B}hasPart', '{B}partOf', '{B}madeOf', '{B}acctbal', '{B}size', '{B}segment'])")
def d05(spark, sf_dir):
    return D.unlabelled(onto(spark, sf_dir)).select("iri")
