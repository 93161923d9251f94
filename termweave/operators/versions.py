"""Versions: differences of lines, axioms and annotations, incremental merge, renames, new entities."""

from __future__ import annotations

from dataclasses import fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.expressions import build_iri, is_valid_iri, is_valid_local
from termweave.model import Ontology

#: The column that names the entity of each table.
OWNER = {"entity": "iri", "label": "iri", "annotation": "iri", "class_edge": "sub", "class_expr": "iri", "prop_edge": "prop", "prop_flag": "prop", "prop_chain": "prop", "type_assert": "ind", "obj_assert": "ind", "data_assert": "ind"}
#: Columns that hold IRIs, for renames.
IRIS = {"entity": ["iri"], "label": ["iri"], "annotation": ["iri", "prop"], "class_edge": ["sub", "sup"], "class_expr": ["iri"], "prop_edge": ["prop", "target"], "prop_flag": ["prop"], "prop_chain": ["prop"], "type_assert": ["ind", "class"], "obj_assert": ["ind", "prop", "target"], "data_assert": ["ind", "prop"]}
TEXTUAL = ("label", "annotation")
#: Lines of a file's head (fixed pattern).
HEADER = r"^(Prefix|Ontology|Import)\("


def axiom_diff(file: DataFrame, model: DataFrame) -> DataFrame:
    """Iri, line, action, n: what turns the file's lines (iri, line; a multiset) into the model's (a set)."""
    f = file.groupBy("iri", "line").agg(F.count("*").alias("f"))
    m = model.select("iri", "line").distinct().withColumn("m", F.lit(1).cast("long"))
    d = f.join(m, ["iri", "line"], "full_outer").withColumn("d", F.coalesce("m", F.lit(0)) - F.coalesce("f", F.lit(0)))
    return d.where("d <> 0").select("iri", "line", F.when(F.col("d") > 0, "add").otherwise("remove").alias("action"), F.abs("d").alias("n"))


def annotation_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Iri, prop, text, lang, action by the set of (property, text, language)."""
    k = ["iri", "prop", "text", "lang"]
    o, n = old.select(*k).distinct(), new.select(*k).distinct()
    return o.join(n, k, "left_anti").withColumn("action", F.lit("remove")).unionByName(n.join(o, k, "left_anti").withColumn("action", F.lit("add")))


def changed_region(old: DataFrame, new: DataFrame) -> DataFrame:
    """Path, identical, start_line, old_end, new_end (ends not included) of two versions of files.

    Both are rows (path, line_no, text), numbered from 0.  Lines are compared from the start and from
    the end by number, so only counts leave the join; the two never overlap.
    """
    size = lambda d, n: d.groupBy("path").agg(F.count("*").alias(n))
    n = size(old, "n_old").join(size(new, "n_new"), "path", "full_outer").select("path", F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
    return region_of(n, old, new)


def region_of(n: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """V03 from the sizes of files (path, n_old, n_new) and lines that hold the first differing ones from both ends."""
    a, b = old.select("path", "line_no", F.col("text").alias("a")), new.select("path", "line_no", F.col("text").alias("b"))
    first = a.join(b, ["path", "line_no"]).where("a <> b").groupBy("path").agg(F.min("line_no").alias("first"))
    back = lambda d, c, t: d.join(n, "path").select("path", (F.col(c) - F.col("line_no") - 1).alias("k"), t)
    last = back(a, "n_old", "a").join(back(b, "n_new", "b"), ["path", "k"]).where("a <> b").groupBy("path").agg(F.min("k").alias("same_end"))
    r = n.join(first, "path", "left").join(last, "path", "left")
    r = r.withColumn("short", F.least("n_old", "n_new")).withColumn("start_line", F.coalesce("first", "short"))
    r = r.withColumn("tail", F.least(F.coalesce("same_end", "short"), F.col("short") - F.col("start_line")))
    same = (F.col("n_old") == F.col("n_new")) & F.col("first").isNull()
    zero = lambda c: F.when(same, 0).otherwise(c).cast("long")
    return r.select("path", same.alias("identical"), zero(F.col("start_line")).alias("start_line"), zero(F.col("n_old") - F.col("tail")).alias("old_end"), zero(F.col("n_new") - F.col("tail")).alias("new_end"))


def in_region(lines: DataFrame, region: DataFrame, end: str) -> DataFrame:
    """The lines of one side that lie in the changed region."""
    r = region.where("not identical").select("path", "start_line", F.col(end).alias("_e"))
    return lines.join(r, "path").where("line_no >= start_line and line_no < _e").drop("start_line", "_e")


def incremental_safe(old: DataFrame, new: DataFrame, region: DataFrame, ratio: float = 0.2, floor: int = 4096) -> DataFrame:
    """Path, safe: no header line in the region, and it is neither over floor characters nor over ratio of a side."""
    def side(lines, end):
        size = lambda d, c: d.groupBy("path").agg(F.sum(F.length("text") + 1).alias(c), F.max(F.ltrim("text").rlike(HEADER)).alias(c + "_head"))
        j = region.select("path").join(size(lines, "all"), "path", "left").join(size(in_region(lines, region, end), "part"), "path", "left")
        large = (F.coalesce("part", F.lit(0)) > floor) & (F.coalesce("part", F.lit(0)) / F.greatest(F.coalesce("all", F.lit(1)), F.lit(1)) > ratio)
        return j.select("path", (large | F.coalesce("part_head", F.lit(False))).alias(end))

    j = region.select("path", "identical").join(side(old, "old_end"), "path").join(side(new, "new_end"), "path")
    return j.select("path", (F.col("identical") | ~(F.col("old_end") | F.col("new_end"))).alias("safe"))


def affected(owners: DataFrame, region: DataFrame, end: str) -> DataFrame:
    """Path, iri of entities that own a line in the changed region."""
    return in_region(owners, region, end).select("path", "iri").distinct()


def tables(x: Ontology) -> dict[str, DataFrame]:
    return {f.name: getattr(x, f.name) for f in fields(x)}


def entity_digests(x: Ontology) -> DataFrame:
    """onto_id, iri, l, t: an entity's logical rows and its annotation rows, summed up as hashes (null: none).

    Order and table don't matter and no group is gathered.
    """
    def digest(names, out: str) -> DataFrame:
        parts = [d.select("onto_id", F.col(OWNER[n]).alias("iri"), F.xxhash64(F.lit(n), *[c for c in d.columns if c not in ("onto_id", "ord")]).alias("h")).distinct() for n, d in tables(x).items() if n in names]
        h = F.col("h")
        return reduce(DataFrame.unionByName, parts).groupBy("onto_id", "iri").agg(F.struct(F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"), F.count("*").alias("n")).alias(out))

    return digest([n for n in OWNER if n not in TEXTUAL], "l").join(digest(TEXTUAL, "t"), ["onto_id", "iri"], "full_outer")


def changed_entities(old: Ontology, new: Ontology) -> DataFrame:
    """onto_id, iri, logical, textual: entities whose logical or annotation rows differ, also new and lost ones."""
    k = ["onto_id", "iri"]
    b = entity_digests(new).withColumnsRenamed({"l": "l2", "t": "t2"})
    j = entity_digests(old).join(b, k, "full_outer").select(*k, (~F.col("l").eqNullSafe(F.col("l2"))).alias("logical"), (~F.col("t").eqNullSafe(F.col("t2"))).alias("textual"))
    return j.where("logical or textual")


def merge(old: Ontology, new: Ontology, touched: DataFrame) -> Ontology:
    """Old with the rows of touched entities (onto_id, iri) taken from new; those that new lacks vanish."""
    def one(name: str) -> DataFrame:
        k = touched.select("onto_id", F.col("iri").alias(OWNER[name])).distinct()
        on = ["onto_id", OWNER[name]]
        a, b = getattr(old, name), getattr(new, name)
        return a.join(k, on, "left_anti").select(*a.columns).unionByName(b.join(k, on, "left_semi").select(*a.columns))

    return Ontology(**{f.name: one(f.name) for f in fields(old)})


def rename(x: Ontology, pairs: DataFrame) -> tuple[Ontology, DataFrame]:
    """(x with IRIs renamed, rejected pairs with their reason) for pairs (old, new).

    A target must be a valid IRI, differ from the source, be free, and be asked for once.  IRIs are
    renamed in every column, in chains, and as whole tokens of expressions.
    """
    taken = x.entity.select(F.col("iri").alias("new"), F.lit(True).alias("_used")).distinct()
    many = pairs.groupBy("new").agg((F.count("*") > 1).alias("_many"))
    p = pairs.select("old", "new").distinct().join(taken, "new", "left").join(many, "new", "left")
    reason = F.when(~is_valid_iri(F.col("new")), "invalid").when(F.col("new") == F.col("old"), "same").when(F.coalesce("_used", F.lit(False)), "exists").when(F.coalesce("_many", F.lit(False)), "asked twice")
    p = p.withColumn("reason", reason)
    good = p.where("reason is null").select(F.col("old").alias("_o"), F.col("new").alias("_n"))

    def one(name: str) -> DataFrame:
        d = getattr(x, name)
        cols = d.columns
        for c in IRIS[name]:
            d = d.join(good, d[c] == F.col("_o"), "left").withColumn(c, F.coalesce("_n", c)).drop("_o", "_n")
        if name == "class_expr":
            d = d.withColumn("_id", F.xxhash64("onto_id", "iri", "role", "ord", "expr"))
            iri = r"((?:https?://|urn:|file:)[^\s(),{}<>]+)"
            toks = d.select("_id", F.posexplode(F.split(F.regexp_replace("expr", iri, "\u0004$1\u0004"), "\u0004")).alias("pos", "tok")).distinct()
            toks = toks.join(good, toks["tok"] == F.col("_o"), "left").select("_id", F.struct("pos", F.coalesce("_n", "tok").alias("t")).alias("p"))
            whole = toks.groupBy("_id").agg(F.array_join(F.array_sort(F.collect_list("p"))["t"], "").alias("_expr"))
            d = d.join(whole, "_id", "left").withColumn("expr", F.coalesce("_expr", "expr"))
        if name == "prop_chain":
            mapped = x.prop_chain.select(F.explode("members").alias("_m")).distinct().join(good, F.col("_m") == F.col("_o")).agg(F.map_from_entries(F.collect_list(F.struct("_o", "_n"))).alias("_map"))
            d = d.crossJoin(F.broadcast(mapped)).withColumn("members", F.transform("members", lambda m: F.coalesce(F.try_element_at("_map", m), m)))  # one row: renamed properties of chains
        return d.select(*cols)

    return Ontology(**{f.name: one(f.name) for f in fields(x)}), p.where("reason is not null").select("old", "new", "reason")


def create(x: Ontology, wanted: DataFrame) -> tuple[Ontology, DataFrame]:
    """(x with new entities, rejected rows) for (onto_id, namespace, local, type, parent)."""
    w = wanted.withColumn("iri", build_iri(F.col("namespace"), F.col("local")))
    known = x.entity.select("onto_id", "iri", F.lit(True).alias("_known")).distinct()
    first = w.groupBy("onto_id", "iri").agg((F.count("*") > 1).alias("_many"))
    w = w.join(known, ["onto_id", "iri"], "left").join(first, ["onto_id", "iri"], "left")
    reason = F.when(F.col("iri").isNull(), "namespace").when(~is_valid_local(F.col("local")), "local name").when(F.coalesce("_known", F.lit(False)), "exists").when(F.coalesce("_many", F.lit(False)), "asked twice")
    w = w.withColumn("reason", reason)
    good = w.where("reason is null")
    edge = good.where("type = 'class' and parent is not null").select("onto_id", F.col("iri").alias("sub"), F.col("parent").alias("sup"), F.lit("sub").alias("kind"), F.lit(0).alias("ord"))
    out = replace(x, entity=x.entity.unionByName(good.select("onto_id", "iri", "type")), class_edge=x.class_edge.unionByName(edge))
    return out, w.where("reason is not null").select("onto_id", "namespace", "local", "reason")


def unchanged_skipped(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, mtime_ms, size) that are not known with the same time and size."""
    return found.join(known.select("path", "mtime_ms", "size").distinct(), ["path", "mtime_ms", "size"], "left_anti")
