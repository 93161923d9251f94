"""Labels: the preferred one of an entity, token search with scores, exact lookup, entity documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.model import KIND_ORDER, SKOS, Ontology, local_name
from termweave.plans.tables import save

PREF, ALT = SKOS + "prefLabel", SKOS + "altLabel"


def preferred(x: Ontology, lang: str = "en") -> DataFrame:
    """onto_id, iri, label of every entity: rdfs:label in lang, English, untagged, any; SKOS; local name."""
    tag = F.coalesce("lang", F.lit(""))
    own = x.label.select("onto_id", "iri", F.struct(F.when(tag == lang, 0).when(tag == "en", 1).when(tag == "", 2).otherwise(3).alias("r"), F.when(tag.isin(lang, "en", ""), "").otherwise(tag).alias("t"), F.col("ord").alias("o"), F.col("text").alias("x")).alias("c"))
    skos = x.annotation.where(F.col("prop").isin(PREF, ALT))
    base = F.when(F.col("prop") == PREF, 10).otherwise(20)
    more = skos.select("onto_id", "iri", F.struct((base + F.when(tag == lang, 0).otherwise(1)).alias("r"), F.lit("").alias("t"), F.col("ord").alias("o"), F.col("text").alias("x")).alias("c"))
    best = own.unionByName(more).groupBy("onto_id", "iri").agg(F.min("c")["x"].alias("label"))
    every = x.entity.select("onto_id", "iri").distinct()
    return every.join(best, ["onto_id", "iri"], "left").select("onto_id", "iri", F.coalesce("label", local_name(F.col("iri"))).alias("label"))


def search_text(x: Ontology) -> DataFrame:
    """onto_id, iri, text: labels and SKOS labels, cut at the last @, lower-case; one row for each distinct text."""
    cut = lambda c: F.lower(F.regexp_replace(c, r"(?s)^(.+)@[^@]*$", "$1"))
    skos = x.annotation.where(F.col("prop").isin(PREF, ALT)).select("onto_id", "iri", cut(F.col("raw")).alias("text"))
    return x.label.select("onto_id", "iri", cut(F.col("text")).alias("text")).unionByName(skos)


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, q (trimmed, lower-case), tokens of a table (query_id, query); queries without tokens go."""
    low = F.lower("query")
    toks = F.filter(F.split(low, r"\s+"), lambda t: t != "")
    return queries.select("query_id", F.trim(low).alias("q"), toks.alias("tokens")).where(F.size("tokens") > 0)


def label_score(text: Column, q: Column, toks: Column) -> Column:
    """100 for the whole label, nearly 50 for its beginning, else how well its words fit the tokens."""
    words = F.split(text, r"\s+")
    best = lambda t: F.array_max(F.transform(words, lambda w: F.when(w == t, 4.0).when(F.startswith(w, t), 3.0).when(F.contains(w, t), 1.0).otherwise(0.0)))
    fit = F.aggregate(F.transform(toks, best), F.lit(0.0), lambda a, v: a + v)
    return F.when(text == q, F.lit(100.0)).when(F.startswith(text, q), 50 - F.length(text) * 0.01).otherwise(fit / F.size(toks) * 5 - F.length(text) * 0.01)


def words_with(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """word, token: the tokens inside distinct words, by equality of tokens and the words' parts of their lengths."""
    sizes = tokens.agg(F.array_sort(F.collect_set(F.length("token"))).alias("_sizes"))
    keyed = words.crossJoin(F.broadcast(sizes))  # one row: the distinct lengths of tokens
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substr("word", i, n))
    parts = F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length("word")), starts))
    return keyed.select("word", F.explode(F.array_distinct(parts)).alias("token")).join(tokens, "token").select("word", "token")


def met_by(q: DataFrame, entity: DataFrame) -> DataFrame:
    """onto_id, iri, query_id, score: entities (onto_id, iri, labels, held, others stay) that hold all tokens of a query.

    A query meets the entities that hold its rarest token; the score is null where no label holds all tokens.
    """
    each = entity.withColumn("token", F.explode("held"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    asked = q.withColumn("token", F.explode("want")).join(often, "token").groupBy("query_id", "q", "tokens", "want").agg(F.count("*").alias("found"), F.min(F.struct("n", "token"))["token"].alias("token"))
    met = each.join(asked.where(F.col("found") == F.size("want")), "token").where(F.forall("want", lambda t: F.array_contains("held", t)))
    whole = F.transform(F.filter("labels", lambda one: F.forall("want", lambda t: F.array_contains(one["held"], t))), lambda one: label_score(one["text"], F.col("q"), F.col("tokens")))
    return met.select(*[c for c in entity.columns if c not in ("labels", "held")], "query_id", F.array_max(whole).alias("score"))


def best_of(scored: DataFrame, names: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """query_id, rank, iri, score: the k best of scored rows and of names (onto_id, iri, q) equal to the query."""
    exact = names.join(q, "q").select("onto_id", "query_id", "iri", F.lit(200.0).alias("score"))
    best = scored.unionByName(exact).groupBy("onto_id", "query_id", "iri").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "iri"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "iri", "score")


def search(x: Ontology, queries: DataFrame, k: int = 50) -> DataFrame:
    """query_id, rank, iri, score: entities whose labels together hold every token, the best k of a query.

    A local name equal to the query scores 200.  No token spans words, so tokens are looked up in the
    distinct words of all labels once; a query then meets only the entities that hold its rarest token.
    Ties go to the smaller IRI.
    """
    q = query_tokens(queries).withColumn("want", F.array_distinct("tokens"))
    texts = save(search_text(x), "texts")
    tokens = q.select(F.explode("want").alias("token")).distinct()
    post = texts.select("onto_id", "iri", "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).where("word <> ''")
    hits = save(words_with(post.select("word").distinct(), tokens), "hits")
    labels = post.join(hits, "word").groupBy("onto_id", "iri", "text").agg(F.collect_set("token").alias("held"))
    entity = save(labels.groupBy("onto_id", "iri").agg(F.collect_list(F.struct("text", "held")).alias("labels"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held")), "held")
    per = met_by(q, entity)
    size = texts.groupBy("onto_id", "iri").agg(F.avg(F.length("text")).alias("n"))
    scored = per.join(size, ["onto_id", "iri"]).select("onto_id", "query_id", "iri", F.coalesce("score", 1 - F.col("n") * 0.001).alias("score"))
    names = x.entity.select("onto_id", "iri", F.lower(local_name(F.col("iri"))).alias("q"))
    return best_of(scored, names, q, k)


def exact_label(x: Ontology, wanted: DataFrame) -> DataFrame:
    """Label, iri: entities with exactly that label, whatever its case."""
    keys = wanted.select("label", F.lower("label").alias("text"))
    return search_text(x).join(keys, "text").select("label", "iri").distinct()


def exact_local(x: Ontology, wanted: DataFrame) -> DataFrame:
    """Name, iri: all entities with that local name."""
    keys = wanted.select("name", F.lower("name").alias("_k"))
    return x.entity.select("iri", F.lower(local_name(F.col("iri"))).alias("_k")).join(keys, "_k").select("name", "iri").distinct()


def resolve(tokens: DataFrame, x: Ontology, base: str) -> DataFrame:
    """Token, iri: an IRI itself, `:local`, a label, or a local name of the base; null if none is an entity."""
    t = tokens.select("token").distinct()
    known = x.entity.select(F.col("iri").alias("_i")).distinct()
    bare = F.regexp_extract("token", r"^<?(.*?)>?$", 1)
    label = search_text(x).groupBy(F.col("text").alias("_t")).agg(F.min("iri").alias("by_label"))
    word = F.lower(F.regexp_replace("token", r"^'(.*)'$", "$1"))
    out = t.join(known, bare == F.col("_i"), "left").withColumnRenamed("_i", "by_iri")
    for name, key in (("by_colon", F.when(F.col("token").startswith(":"), F.concat(F.lit(base), F.substr("token", F.lit(2))))), ("by_base", F.concat(F.lit(base), F.col("token")))):
        out = out.join(known.withColumnRenamed("_i", name), key == F.col(name), "left")
    out = out.join(label, word == F.col("_t"), "left")
    return out.select("token", F.coalesce("by_iri", "by_colon", "by_label", "by_base").alias("iri"))


def kinds(x: Ontology) -> DataFrame:
    """onto_id, iri, type: one kind for each IRI, classes before properties before individuals."""
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("type"))
    return x.entity.groupBy("onto_id", "iri").agg(F.min_by("type", rank).alias("type"))


def mentions(x: Ontology) -> DataFrame:
    """onto_id, iri, ref: every IRI that an entity's axioms mention."""
    e = F.regexp_extract_all("expr", F.lit(r"((?:https?://|urn:|file:)[^\s(),{}<>]+)"), F.lit(1))
    parts = [x.class_edge.select("onto_id", F.col("sub").alias("iri"), F.col("sup").alias("ref")), x.class_expr.select("onto_id", "iri", F.explode(e).alias("ref")), x.prop_edge.select("onto_id", F.col("prop").alias("iri"), F.col("target").alias("ref")), x.type_assert.select("onto_id", F.col("ind").alias("iri"), F.col("class").alias("ref")), x.obj_assert.select("onto_id", F.col("ind").alias("iri"), F.col("target").alias("ref")), x.obj_assert.select("onto_id", F.col("ind").alias("iri"), F.col("prop").alias("ref")), x.data_assert.select("onto_id", F.col("ind").alias("iri"), F.col("prop").alias("ref"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def label_map(x: Ontology, labels: DataFrame) -> DataFrame:
    """onto_id, iri, labels: the labels of all IRIs that an entity mentions, as a map."""
    named = mentions(x).join(labels.withColumnRenamed("iri", "ref"), ["onto_id", "ref"], "left")
    entry = F.struct("ref", F.coalesce("label", local_name(F.col("ref"))).alias("label"))
    return named.groupBy("onto_id", "iri").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("labels"))


def documents(x: Ontology, labels: DataFrame) -> DataFrame:
    """One nested record for each entity: kind, labels, annotations, edges, expressions, assertions, label map."""
    key = ["onto_id", "iri"]
    many = lambda df, name, *cols: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    ind = lambda df: df.withColumnRenamed("ind", "iri")
    out = kinds(x)
    for part in (many(x.label, "labels", "lang", "ord", "text"), many(x.annotation, "annotations", "prop", "ord", "text", "lang"), many(x.class_edge.withColumnRenamed("sub", "iri"), "edges", "kind", "sup"), many(x.class_expr, "expressions", "role", "ord", "expr"), many(x.prop_edge.withColumnRenamed("prop", "iri"), "properties", "kind", "target"), many(ind(x.type_assert), "types", "class"), many(ind(x.obj_assert), "objects", "prop", "target"), many(ind(x.data_assert), "values", "prop", "value", "datatype"), label_map(x, labels).withColumnRenamed("labels", "label_map")):
        out = out.join(part, key, "left")
    return out
