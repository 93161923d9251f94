"""Ingest of ontology texts: numbered lines, functional, Manchester and XML syntax, prefixes, formats, results.

Files of any size are read in blocks; what a line needs from lines before it (its number, the frame it
stands in, whether a quoted text is open) is computed inside blocks and carried over by one small row
for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions import expressions as X
from termweave.model import KIND_ORDER, OWL, RDF, RDFS, THING, TYPE, TYPE_IRI, is_named
from termweave.plans.tables import save

#: Keywords of functional syntax that are read (fixed values); all others are skipped.
READ = ["Annotation", "Import", "Declaration", "SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion", "AnnotationAssertion", "SubObjectPropertyOf", "SubDataPropertyOf", "SubAnnotationPropertyOf", "ObjectPropertyDomain", "ObjectPropertyRange", "DataPropertyDomain", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "TransitiveObjectProperty", "SymmetricObjectProperty", "ReflexiveObjectProperty", "IrreflexiveObjectProperty", "AsymmetricObjectProperty", "FunctionalDataProperty", "InverseObjectProperties", "EquivalentObjectProperties", "DisjointObjectProperties", "ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion"]
SKIPPED = ["DataPropertyRange", "EquivalentDataProperties", "DisjointDataProperties", "NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion", "SameIndividual", "DifferentIndividuals", "HasKey", "DatatypeDefinition", "SWRL"]
#: Types that are characteristics of a property (fixed values).
CHARACTERISTICS = [f"{OWL}{x}Property" for x in ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Reflexive", "Irreflexive", "Asymmetric")]
KINDS = {"Class": "class", "ObjectProperty": "objectProperty", "DataProperty": "dataProperty", "AnnotationProperty": "annotationProperty", "NamedIndividual": "individual"}


def lines(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """path, line_no (from 0), char_start, text, block of every line of all files under path.

    document: the files, in order of their names, are one document, whose path is the folder's; so a sink
    that writes a document in several files is read as it was written.
    """
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    at = (F.lit(path), F.struct(file.alias("file"), start.alias("start"))) if document else (file, start)
    raw = spark.read.text(path).select(at[0].alias("path"), at[1].alias("block"), F.monotonically_increasing_id().alias("_n"), F.col("value").alias("text"))
    raw = save(raw, "lines")
    size = F.length("text").cast("long") + 1
    blocks = raw.groupBy("path", "block").agg(F.count("*").alias("_c"), F.sum(size).alias("_s"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.select("path", "block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    own = W.partitionBy("path", "block").orderBy("_n")
    rows = raw.withColumn("_i", F.row_number().over(own) - 1).withColumn("_o", F.coalesce(F.sum(size).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(blocks, ["path", "block"])
    return rows.select("path", (F.col("_c") + F.col("_i")).cast("long").alias("line_no"), (F.col("_s") + F.col("_o")).cast("long").alias("char_start"), "text", "block")


def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with the last non-null value up to each line of its file."""
    rows = rows.withColumn("_v", value)
    last = rows.groupBy("path", "block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("line_no"))).alias("_l"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("path", "block", F.last("_l", ignorenulls=True).over(before).alias("_l"))
    here = F.last("_v", ignorenulls=True).over(W.partitionBy("path", "block").orderBy("line_no"))
    return rows.withColumn("_h", here).join(last, ["path", "block"]).withColumn(name, F.coalesce("_h", "_l")).drop("_v", "_h", "_l")


def joined_lines(rows: DataFrame) -> DataFrame:
    """Lines of an open quoted text go with the line that opened it: path, line_no, char_start, text, block."""
    # an escaped backslash counts as nothing and an escaped quote as two other characters
    quotes = F.length(F.regexp_replace(F.replace(F.replace("text", F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '[^"]', ""))
    rows = rows.withColumn("_q", quotes)
    per = rows.groupBy("path", "block").agg(F.sum("_q").alias("_b"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("path", "block", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b"))
    here = F.coalesce(F.sum("_q").over(W.partitionBy("path", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_h", here).join(per, ["path", "block"]).withColumn("_open", (F.col("_h") + F.col("_b")) % 2 == 1)
    rows = carried(rows, F.when(~F.col("_open"), F.col("line_no")), "_first")
    parts = rows.groupBy("path", "_first").agg(F.min("char_start").alias("char_start"), F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("p"))
    return parts.select("path", F.col("_first").alias("line_no"), "char_start", F.array_join("p.text", "\n").alias("text"), "block")


_AXIOM = r"(?s)^\s*([A-Z][A-Za-z]*)\s*\((.*)$"


def functional(rows: DataFrame) -> DataFrame:
    """Path, line_no, char_start, keyword, args of every axiom line, read or skipped alike."""
    body = F.regexp_replace(F.regexp_extract("text", _AXIOM, 2), r"\)\s*$", "")
    out = rows.select("path", "line_no", "char_start", F.regexp_extract("text", _AXIOM, 1).alias("keyword"), body.alias("args"))
    return out.where(F.col("keyword").isin(*READ, *SKIPPED))


def bad_lines(rows: DataFrame) -> DataFrame:
    """Path, line_no, message of lines that are no axiom, header, comment or closing parenthesis."""
    t = F.trim("text")
    known = F.regexp_extract("text", _AXIOM, 1).isin(*READ, *SKIPPED, "Prefix", "Ontology")
    bad = (t != "") & ~t.startswith("#") & (t != ")") & ~t.rlike(r"^<[^>]*>\s*$") & ~known
    return rows.where(bad).select("path", "line_no", F.left(F.concat(F.lit("Unexpected: "), t), F.lit(300)).alias("message"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Path, name, expansion, line_no of the lines Prefix(name:=<iri>), and of Prefix: name: <iri> in frames."""
    p = r"^\s*Prefix\s*(?:\(|:)\s*([^:=\s]*):\s*=?\s*<([^>]*)>"
    return rows.where(F.col("text").rlike(p)).select("path", F.regexp_extract("text", p, 1).alias("name"), F.regexp_extract("text", p, 2).alias("expansion"), "line_no")


#: Files whose prefixes are joined by broadcast at most; of more, the lines are shuffled.
BROADCAST_FILES = 10_000


def with_prefixes(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """rows with `prefixes`, a map of what their file declares; of a name declared again the last counts."""
    last = declared.groupBy("path", "name").agg(F.max_by("expansion", "line_no").alias("x"))
    maps = save(last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "x"))).alias("prefixes")), "prefixes")
    return rows.join(F.broadcast(maps) if maps.count() <= BROADCAST_FILES else maps, "path", "left")


def full_name(token: Column, known: Column) -> Column:
    """A token with its prefixed name (or that of a datatype) written out in brackets; unknown prefixes stay."""
    m = r"^(\^\^)?([^:\s^\"<]*):(.*)$"
    name = F.regexp_extract(token, m, 2)
    built_in = F.element_at(F.create_map(*[F.lit(x) for k, v in X.BUILTIN.items() for x in (k[:-1], v)]), name)
    base = F.coalesce(F.try_element_at(known, name), built_in)
    full = F.concat(F.regexp_extract(token, m, 1), F.lit("<"), base, F.regexp_extract(token, m, 3), F.lit(">"))
    return F.when(token.rlike(m) & base.isNotNull(), full).otherwise(token)


def resolved(axioms: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """axioms with names written out and without their annotations, so that an operand's place tells what it is.

    declared: S11's rows, or none for the built-in prefixes alone.  Names inside literals stay; white
    space between operands becomes one space, and goes before a parenthesis.
    """
    own = axioms.withColumn("prefixes", F.lit(None).cast("map<string,string>")) if declared is None else with_prefixes(axioms, declared)
    toks = X.tokens(F.regexp_replace("args", r"^\s+|\s+$", ""))
    word = lambda t: F.coalesce(t.rlike("^[A-Z][A-Za-z]*$"), F.lit(False))
    gap = lambda t, i: t.rlike(r"^\s+$") & (F.get("_t", i + 1) == "(") & word(F.get("_t", i - 1))
    said = F.transform("_t", lambda t, i: F.when(gap(t, i), "").when(t.rlike(r"^\s+$"), " ").otherwise(full_name(t, F.col("prefixes"))))
    own = own.withColumn("_t", toks).withColumn("_s", F.array_join(said, ""))
    kept = F.filter(operands(F.col("_s")), lambda o: ~o.startswith("Annotation("))
    # only axioms with annotations are taken apart
    bare = F.when(F.col("_s").startswith("Annotation(") & (F.col("keyword") != "Annotation"), F.array_join(kept, " ")).otherwise(F.col("_s"))
    return own.withColumn("args", bare).select(*axioms.columns)


def functional_axioms(spark: SparkSession, path: str) -> DataFrame:
    """The axiom lines of functional files with their names written out and without their annotations."""
    raw = lines(spark, path)
    return resolved(functional(joined_lines(raw)), prefixes(raw))


def operands(args: Column) -> Column:
    """The operands of an axiom: split at white space outside brackets, quotes and parentheses."""
    return F.filter(F.split(X.marked(X.tokens(args), lambda t: t.rlike(r"^\s+$")), "\u0002"), lambda p: p != "")


def plain(c: Column) -> Column:
    """The IRI of an operand in brackets, null for anything else."""
    return F.when(c.rlike("^<[^>]*>$"), F.regexp_replace(c, "[<>]", ""))


def subclass_routes(axioms: DataFrame) -> DataFrame:
    """Path, line_no, route, iri, other of SubClassOf axioms, by which sides are single names.

    named (iri below other), super (iri below the expression), gci (the expression below iri) or
    standalone (two expressions).
    """
    ops = operands(F.col("args"))
    a = axioms.where("keyword = 'SubClassOf'").select("path", "line_no", F.get(ops, F.lit(0)).alias("a"), F.get(ops, F.lit(1)).alias("b"))
    a = a.withColumn("x", plain(F.col("a"))).withColumn("y", plain(F.col("b")))
    has = F.col("x").isNotNull(), F.col("y").isNotNull()
    route = F.when(has[0] & has[1], "named").when(has[0], "super").when(has[1], "gci").otherwise("standalone")
    iri = F.when(has[0], F.col("x")).when(has[1], F.col("y"))
    other = F.when(has[0] & has[1], F.col("y")).when(has[0], F.col("b")).when(has[1], F.col("a")).otherwise(F.concat(F.lit("SubClassOf("), "a", F.lit(" "), "b", F.lit(")")))
    return a.select("path", "line_no", route.alias("route"), iri.alias("iri"), other.alias("other"))


def class_pairs(axioms: DataFrame) -> DataFrame:
    """Sub, sup, kind: ordered pairs of equivalent and disjoint classes; of a disjoint union the defined class with each member."""
    ops = axioms.where(F.col("keyword").isin("EquivalentClasses", "DisjointClasses", "DisjointUnion")).select("keyword", F.transform(operands(F.col("args")), plain).alias("o"))
    left = ops.select("keyword", "o", F.posexplode("o").alias("i", "sub"))
    both = left.select("keyword", "i", "sub", F.posexplode("o").alias("j", "sup")).where("sub is not null and sup is not null and i <> j and sub <> sup")
    both = both.where((F.col("keyword") != "DisjointUnion") | (F.col("i") == 0))
    return both.select("sub", "sup", F.when(F.col("keyword") == "EquivalentClasses", "equiv").otherwise("disjoint").alias("kind")).distinct()


def inverse_pairs(axioms: DataFrame) -> DataFrame:
    """Prop, target of inverse properties, set on both."""
    o = operands(F.col("args"))
    one = axioms.where("keyword = 'InverseObjectProperties'").select(plain(F.get(o, F.lit(0))).alias("prop"), plain(F.get(o, F.lit(1))).alias("target"))
    return one.unionByName(one.select(F.col("target").alias("prop"), F.col("prop").alias("target"))).distinct()


def declarations(axioms: DataFrame) -> DataFrame:
    """iri, type of the declared entities."""
    m = r"^\s*(\w+)\s*\(\s*<([^>]*)>"
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.regexp_extract("args", m, 1))
    return axioms.where("keyword = 'Declaration'").select(F.regexp_extract("args", m, 2).alias("iri"), kind.alias("type")).where("type is not null").distinct()


def annotations(axioms: DataFrame, entities: DataFrame) -> DataFrame:
    """Iri, prop, text, lang, dt, is_label of annotations whose subject is declared anywhere in the ontology."""
    m = r"(?s)^\s*(\S+)\s+<([^>]*)>\s+(.*)$"
    lit = F.regexp_extract("args", m, 3)
    prop = F.regexp_extract("args", m, 1)
    prop = F.when(prop.startswith("rdfs:"), F.concat(F.lit(X.BUILTIN["rdfs:"]), F.substr(prop, F.lit(6)))).otherwise(F.regexp_replace(prop, "[<>]", ""))
    end = F.regexp_extract(lit, r'"(@[A-Za-z][A-Za-z0-9-]*|\^\^\S+)?\s*$', 1)
    body = F.when(lit.startswith('"'), X.unescape(F.substr(F.rtrim(lit), F.lit(2), F.length(F.rtrim(lit)) - F.length(end) - 2))).otherwise(plain(lit))
    a = axioms.where("keyword = 'AnnotationAssertion'").select(F.regexp_extract("args", m, 2).alias("iri"), prop.alias("prop"), body.alias("text"), F.when(end.startswith("@"), F.substr(end, F.lit(2))).otherwise("").alias("lang"), F.when(end.startswith("^^"), F.regexp_replace(end, r"[\^<>]", "")).otherwise("").alias("dt"))
    a = a.withColumn("is_label", F.col("prop") == X.BUILTIN["rdfs:"] + "label")
    return a.join(entities.select("iri").distinct(), "iri", "left_semi")


def owners(axioms: DataFrame) -> DataFrame:
    """path, line_no, char_start, iri, map: which entity owns an axiom line (general axioms in a map of their own)."""
    names = F.regexp_replace("args", r'(?s)"(?:[^"\\]++|\\.)*+".*$', "")  # names before a literal, in brackets or with a prefix
    iris = F.transform(F.regexp_extract_all(names, F.lit(r"(<[^>]*>|[A-Za-z][\w-]*:[\w.-]+)"), F.lit(1)), lambda t: F.regexp_replace(t, "[<>]", ""))
    second = F.col("keyword").isin("AnnotationAssertion", "ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion")
    chain = (F.col("keyword") == "SubObjectPropertyOf") & F.col("args").startswith("ObjectPropertyChain(")
    gci = (F.col("keyword") == "SubClassOf") & F.col("args").rlike(r"^\s*[A-Z]")
    iri = F.when(second, F.try_element_at(iris, F.lit(2))).when(chain | gci, F.try_element_at(iris, F.lit(-1))).otherwise(F.try_element_at(iris, F.lit(1)))
    return axioms.select("path", "line_no", "char_start", iri.alias("iri"), F.when(gci, "gci").otherwise("entity").alias("map")).where("iri is not null")


def segments(axioms: DataFrame) -> DataFrame:
    """Path, iri, map, first_line, last_line, first_char, lines: the lines that an entity owns."""
    o = owners(axioms)
    return o.groupBy("path", "iri", "map").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min("char_start").alias("first_char"), F.array_sort(F.collect_list("line_no")).alias("lines"))


#: Words that open a frame, a list of classes or a header, and the sections of frames (fixed values).
FRAMES = ["Class", "ObjectProperty", "DataProperty", "AnnotationProperty", "Individual"]
LISTS = ["DisjointClasses", "EquivalentClasses"]
HEADERS = ["Prefix", "Ontology", "Import"]
SECTIONS = ["Annotations", "SubClassOf", "EquivalentTo", "DisjointWith", "SubPropertyOf", "Domain", "Range", "Characteristics", "InverseOf", "SubPropertyChain", "Types", "Facts", "SameAs", "DifferentFrom"]


def manchester(rows: DataFrame) -> DataFrame:
    """Path, line_no (where the section starts), frame, kind, section, item: the comma-separated items of sections.

    A frame's own row has an empty section and item.  Frames and sections may start anywhere in a line and
    go on over lines; comments go; commas inside parentheses, braces and quotes part nothing.  Lists of
    classes are frames of their kind, without a name and with their word as section.
    """
    toks = X.tokens(F.col("text"))
    note = F.array_position(F.transform(toks, lambda t: t.startswith("#")), True)
    toks = F.when(note > 0, F.slice(toks, F.lit(1), F.greatest(note - 1, F.lit(0)).cast("int"))).otherwise(toks)
    opens = F.transform(toks, lambda t: F.when(t.isin(*[w + ":" for w in (*FRAMES, *LISTS, *HEADERS, *SECTIONS)]), F.concat(F.lit("\u0003"), t)).otherwise(t))
    pieces = rows.select("path", "block", "line_no", F.posexplode(F.split(F.array_join(opens, ""), "\u0003")).alias("i", "piece")).where(F.trim("piece") != "")
    # places of pieces in a file take the line's number; there are fewer than 2**20 in a line
    pieces = pieces.withColumn("line_no", F.shiftleft("line_no", 20) + F.col("i"))
    word = F.regexp_extract("piece", r"^([A-Z][A-Za-z]*):", 1)
    pieces = save(pieces.select("path", "block", "line_no", "piece", F.when(word.isin(*FRAMES, *LISTS, *HEADERS, *SECTIONS), word).alias("word")), "pieces")
    said = F.trim(F.regexp_replace("piece", r"^[A-Za-z]*:", ""))
    name = F.regexp_replace(F.regexp_extract(said, r"^(<[^>]*>|\S+)", 1), "[<>]", "")
    frame = F.when(F.col("word").isin(*FRAMES), F.struct(F.col("word").alias("kind"), name.alias("iri"))).when(F.col("word").isin(*LISTS), F.struct(F.col("word").alias("kind"), F.lit("").alias("iri"))).when(F.col("word").isin(*HEADERS), F.struct(F.lit("").alias("kind"), F.lit("").alias("iri")))
    own = carried(carried(pieces, frame, "frame"), F.when(F.col("word").isNotNull(), F.struct("word", F.col("line_no").alias("start"))), "section")
    body = F.when(F.col("word").isNotNull(), said).otherwise(F.trim("piece"))
    own = own.where("frame.kind <> ''").groupBy("path", "frame", "section").agg(F.array_sort(F.collect_list(F.struct("line_no", body.alias("b")))).alias("p"))
    text = F.array_join("p.b", " ")
    items = F.filter(F.transform(F.split(X.marked(X.tokens(text), lambda t: t == ","), "\u0002"), lambda p: F.trim(p)), lambda p: p != "")
    is_frame = F.col("section.word").isin(*FRAMES)
    out = own.select("path", F.shiftright("section.start", 20).alias("line_no"), F.col("frame.iri").alias("frame"), F.col("frame.kind").alias("kind"), F.when(is_frame, "").otherwise(F.col("section.word")).alias("section"), F.explode(F.when(is_frame, F.array(F.lit(""))).otherwise(items)).alias("item"))
    return out


RDF_CLASS = "`_rdf:about` string, `_rdf:ID` string, `rdfs:label` array<struct<_VALUE:string,`_xml:lang`:string>>, `rdfs:subClassOf` array<struct<`_rdf:resource`:string,`owl:Restriction`:struct<`owl:onProperty`:struct<`_rdf:resource`:string>,`owl:someValuesFrom`:struct<`_rdf:resource`:string>,`owl:allValuesFrom`:struct<`_rdf:resource`:string>>>>"


def rdfxml_classes(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Iri, relation (label, super, expr), value, lang of the owl:Class elements of RDF/XML files."""
    c = spark.read.format("xml").option("rowTag", "owl:Class").schema(RDF_CLASS).load(path)
    iri = F.coalesce("`_rdf:about`", F.concat(F.lit(base), F.col("`_rdf:ID`")))
    c = c.select(iri.alias("iri"), F.col("`rdfs:label`").alias("labels"), F.col("`rdfs:subClassOf`").alias("supers"))
    lab = c.select("iri", F.explode("labels").alias("l")).select("iri", F.lit("label").alias("relation"), F.col("l._VALUE").alias("value"), F.coalesce(F.col("l.`_xml:lang`"), F.lit("")).alias("lang"))
    s = c.select("iri", F.explode("supers").alias("s"))
    named = s.select("iri", F.lit("super").alias("relation"), F.col("s.`_rdf:resource`").alias("value"), F.lit("").alias("lang")).where("value is not null")
    r = F.col("s.`owl:Restriction`")
    on = r["owl:onProperty"]["_rdf:resource"]
    expr = F.when(r["owl:someValuesFrom"].isNotNull(), F.concat(on, F.lit(" some "), r["owl:someValuesFrom"]["_rdf:resource"])).when(r["owl:allValuesFrom"].isNotNull(), F.concat(on, F.lit(" only "), r["owl:allValuesFrom"]["_rdf:resource"]))
    return lab.unionByName(named).unionByName(s.select("iri", F.lit("expr").alias("relation"), expr.alias("value"), F.lit("").alias("lang")).where("value is not null"))


def owlxml_subclasses(spark: SparkSession, path: str) -> DataFrame:
    """Sub, sup of SubClassOf elements of OWL/XML files with two named classes; composite ones are left out."""
    c = spark.read.format("xml").option("rowTag", "SubClassOf").schema("Class array<struct<_IRI:string>>").load(path)
    return c.where(F.size("Class") == 2).select(F.col("Class")[0]["_IRI"].alias("sub"), F.col("Class")[1]["_IRI"].alias("sup"))


def entities_from_triples(triples: DataFrame) -> DataFrame:
    """onto_id, iri, type of named subjects, by their rdf:type; class before property before individual.

    rdfs:Class is a class too; what has no other kind than a characteristic is an object property.  Any
    type outside the vocabulary makes an individual, as does owl:Thing; other words of the vocabulary
    make nothing, and an ontology is no entity whatever else it is.
    """
    back = {v: k for k, v in TYPE_IRI.items()} | {RDFS + "Class": "class", THING: "individual"} | dict.fromkeys(CHARACTERISTICS, "characteristic")
    t = triples.where((F.col("p") == TYPE) & is_named(F.col("s")))
    told = F.element_at(F.create_map(*[F.lit(x) for kv in back.items() for x in kv]), F.col("o"))
    word = F.exists(F.array(*map(F.lit, (OWL, RDF, RDFS))), lambda ns: F.startswith(F.col("o"), ns))
    kind = F.coalesce(told, F.when(F.col("o") == OWL + "Ontology", "ontology").when(~word, "individual"))
    order = ["ontology", *KIND_ORDER[:-1], "characteristic", "individual"]
    rank = F.array_position(F.array(*map(F.lit, order)), kind)
    # the least place is a number, so subjects are gathered by hash, not sorted
    found = t.where(kind.isNotNull()).groupBy("onto_id", F.col("s").alias("iri")).agg(F.min(rank).cast("int").alias("_k")).where("_k > 1")
    named = ["objectProperty" if k == "characteristic" else k for k in order]
    return found.select("onto_id", "iri", F.element_at(F.array(*map(F.lit, named)), F.col("_k")).alias("type"))


def assertions_from_triples(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """onto_id, ind, prop, value, kind (object or data) of individuals, by what the predicate is declared as."""
    e = entities.select("onto_id", F.col("iri").alias("p"), F.col("type").alias("_t")).where(F.col("_t").isin("objectProperty", "dataProperty"))
    i = entities.where("type = 'individual'").select("onto_id", F.col("iri").alias("s"))
    rows = triples.join(e, ["onto_id", "p"]).join(i, ["onto_id", "s"], "left_semi")
    return rows.select("onto_id", F.col("s").alias("ind"), F.col("p").alias("prop"), F.col("o").alias("value"), F.when(F.col("_t") == "objectProperty", "object").otherwise("data").alias("kind"))


def rdf_lists(first: DataFrame, rest: DataFrame, heads: DataFrame) -> DataFrame:
    """Head, pos, item: members of lists from first (node, item), rest (node, next) and heads (head, and node where it differs); a node met again ends it, unnamed members go."""
    # by doubling: after round k the first 2^k cells of every list are known, and where 2^k steps lead from any cell
    seen = save(heads.select("head", F.col("node" if "node" in heads.columns else "head").alias("node"), F.lit(0).alias("pos")), "cells")
    jump, step = save(rest.select("node", F.col("next").alias("to")).where("to is not null"), "jump"), 1
    while True:
        # a merge: cells are small when written, so Spark would send them all through the driver, each round anew
        far = seen.join(jump.hint("merge"), "node").select("head", F.col("to").alias("node"), (F.col("pos") + step).alias("pos"))
        new = far.groupBy("head", "node").agg(F.min("pos").alias("pos")).join(seen.hint("merge"), ["head", "node"], "left_anti")
        new = save(new, "cells")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        jump, step = save(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_far")).hint("merge"), "to").select("node", F.col("_far").alias("to")), "jump"), 2 * step
    return seen.join(first.hint("merge"), "node").where(is_named(F.col("item"))).select("head", "pos", "item")


def content_format(text: Column) -> Column:
    """The format of an ontology text, by its beginning."""
    t = F.ltrim(F.regexp_replace(text, "^﻿", ""))
    head, near = F.left(t, F.lit(16384)), F.left(t, F.lit(1024))
    return (
        F.when(t.startswith("<") & F.contains(head, F.lit("<Ontology")), "owl-xml")
        .when(t.startswith("<") & (F.contains(head, F.lit("<rdf:RDF")) | F.contains(head, F.lit("xmlns:rdf="))), "rdf-xml")
        .when(F.contains(head, F.lit("Ontology(")), "functional")
        .when(F.contains(head, F.lit("Ontology:")), "manchester")
        .when(near.rlike(r"(?m)^\s*(@prefix|@base|PREFIX|BASE)\b"), "turtle")
        .otherwise("unknown")
    )


def path_format(path: Column) -> Column:
    """The format by a file's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("ofn", "owf"), "functional").when(ext == "omn", "manchester").when(ext == "ttl", "turtle").when(ext == "rdf", "rdf-xml").otherwise("functional")


RESULTS = "head struct<vars:array<string>>, results struct<bindings:array<map<string,struct<type:string,value:string,`xml:lang`:string,datatype:string>>>>"


def sparql_results(docs: DataFrame, column: str = "json") -> DataFrame:
    """The columns of docs but the JSON, row_no, var, term: one row for each bound variable of a result."""
    j = docs.withColumn("_j", F.from_json(column, RESULTS))
    keep = [c for c in docs.columns if c != column]
    rows = j.select(*keep, F.posexplode("_j.results.bindings").alias("row_no", "_b")).select(*keep, "row_no", F.explode("_b").alias("var", "_t"))
    v, q = F.col("_t.value"), F.concat(F.lit('"'), F.col("_t.value"), F.lit('"'))
    string = "http://www.w3.org/2001/XMLSchema#string"
    term = F.when(F.col("_t.type") == "uri", F.concat(F.lit("<"), v, F.lit(">"))).when(F.col("_t.type") == "bnode", F.concat(F.lit("_:"), v)).when(F.col("_t.`xml:lang`").isNotNull(), F.concat(q, F.lit("@"), F.col("_t.`xml:lang`"))).when(F.col("_t.datatype").isNotNull() & (F.col("_t.datatype") != string), F.concat(q, F.lit("^^<"), F.col("_t.datatype"), F.lit(">"))).otherwise(q)
    return rows.select(*keep, "row_no", "var", term.alias("term"))

