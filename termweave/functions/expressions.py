"""Scalar functions on names and class expressions; built from columns, no Python per row.

Expressions are Manchester text with bare IRIs, e.g. `http://x/A and (http://x/p some http://x/B)`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from termweave.model import local_name

#: A token: an IRI in brackets, a quoted text, a parenthesis or brace, white space, or a run of anything else.
TOKEN = r"(<[^>]*>|'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\"|[(){},]|\s+|[^\s(){},<>'\"]+|[<>'\"])"
#: Built-in prefixes (fixed values).
BUILTIN = {"owl:": "http://www.w3.org/2002/07/owl#", "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs:": "http://www.w3.org/2000/01/rdf-schema#", "xsd:": "http://www.w3.org/2001/XMLSchema#"}
#: Words of the expression language, and those that need an argument after them (fixed values).
KEYWORDS = ["some", "only", "value", "min", "max", "exactly", "and", "or", "not", "that", "self"]
DANGLING = ["some", "only", "and", "or", "not", "min", "max", "exactly", "value"]
#: Role names in the order that conjuncts take (fixed values).
ROLES = ["all or part of", "proper part of", "constitutional part of", "regional part of", "lateral half of", "systemic part of"]


def tokens(expr: Column) -> Column:
    return F.regexp_extract_all(expr, F.lit(TOKEN), F.lit(1))


def depths(toks: Column) -> Column:
    """Array of (tok, depth): depth counts the parentheses and braces open before a token; a stray closing one is ignored."""
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<struct<tok:string,depth:int>>").alias("out"))
    return F.aggregate(toks, start, _counted(lambda out, t, d: F.concat(out, F.array(F.struct(t.alias("tok"), d.alias("depth"))))))["out"]


def marked(toks: Column, at) -> Column:
    """The tokens as one text again, in which U+0002 stands for those outside parentheses that at() is true of."""
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("out"))
    return F.aggregate(toks, start, _counted(lambda out, t, d: F.concat(out, F.when((d == 0) & at(t), F.lit("\u0002")).otherwise(t))))["out"]


def _counted(add):
    def step(a, t):
        d = F.when(t.isin(")", "}"), F.greatest(a["d"] - 1, F.lit(0))).otherwise(a["d"])
        return F.struct(F.when(t.isin("(", "{"), d + 1).otherwise(d).alias("d"), add(a["out"], t, d).alias("out"))

    return step


def let(value: Column, body) -> Column:
    """body(value), in which value is computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _top(expr: Column, *words: str) -> Column:
    """Whether a token outside parentheses is one of words; where the text holds none of them no token is looked at."""
    held = reduce(lambda a, b: a | b, [F.contains(expr, F.lit(w)) for w in words])
    return F.when(held, F.exists(depths(tokens(expr)), lambda t: (t["depth"] == 0) & t["tok"].isin(*words))).when(expr.isNotNull(), F.lit(False))


def has_top_or(expr: Column) -> Column:
    return _top(expr, "or")


def conjuncts(expr: Column) -> Column:
    """The parts between top-level 'and's; brackets, quotes and parentheses are opaque."""
    parts = F.transform(F.split(marked(tokens(expr), lambda t: t == "and"), "\u0002"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def role_of(part: Column) -> Column:
    """The lower-case text that a conjunct's role is recognised by."""
    quoted = F.regexp_extract(part, r"^\s*'([^']*)'", 1)
    return F.lower(F.when(part.rlike(r"^\s*'[^']*'"), quoted).otherwise(F.ltrim(part)))


def is_bare(part: Column) -> Column:
    """Whether a conjunct has no top-level restriction."""
    words = [w for w in DANGLING if w not in ("and", "or", "not")]
    return ~_top(part, *words)


def sorted_conjuncts(expr: Column) -> Column:
    """The head, bare classes, the known roles in order, other roles, laterality; unchanged with a top-level 'or'."""

    def rank(p, role):
        known = F.when(F.lit(False), 0)
        for i, r in enumerate(ROLES):
            known = known.when(role.startswith(r), 2 + i)
        return F.when(role.startswith("laterality"), 99).when(is_bare(p), 1).otherwise(F.coalesce(known, F.lit(50)))

    def ordered(parts):
        tail = F.array_sort(F.transform(F.slice(parts, 2, 100_000), lambda p, i: F.struct(let(role_of(p), lambda role: rank(p, role)).alias("r"), i.alias("i"), p.alias("p"))))
        joined = F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(tail, lambda t: t["p"])), " and ")
        return F.when(F.size(parts) <= 1, expr).otherwise(joined)

    return F.when(has_top_or(expr), expr).otherwise(let(conjuncts(expr), ordered))


def incomplete(expr: Column) -> Column:
    """Ends in a word that needs an argument, or its parentheses don't match."""
    last = F.lower(F.regexp_extract(F.rtrim(expr), r"(\S*)$", 1))
    signs = F.regexp_extract_all(expr, F.lit(r"([()])"), F.lit(1))
    run = F.aggregate(signs, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, s: F.struct((a["d"] + F.when(s == "(", 1).otherwise(-1)).alias("d"), F.least(a["low"], a["d"] + F.when(s == "(", 1).otherwise(-1)).alias("low")))
    return last.isin(*DANGLING) | (run["d"] != 0) | (run["low"] < 0)


def unresolved(normal: Column) -> Column:
    """A quoted label or a bare word is left that is no keyword, number or IRI."""
    word = lambda t: ~t.rlike(r"^(\s+|[(){},<>\"]|<.*>|\".*\"|\d+(\.\d+)?|https?://.*)$") & ~F.lower(t).isin(*KEYWORDS)
    return F.exists(tokens(normal), word)


def short_iri(iri: Column, base: Column | None = None) -> Column:
    """Built-in prefix, else what follows the ontology's IRI, else the local name after a colon."""
    w = F
    for prefix, full in BUILTIN.items():
        w = w.when(iri.startswith(full), F.concat(F.lit(prefix), F.substr(iri, F.lit(len(full) + 1))))
    if base is not None:
        w = w.when(F.startswith(iri, F.concat(base, F.lit("#"))) | F.startswith(iri, F.concat(base, F.lit("/"))), F.concat(F.lit(":"), F.substr(iri, F.length(base) + 2)))
    return w.when(iri.rlike("[#/]"), F.concat(F.lit(":"), local_name(iri))).otherwise(iri)


def is_valid_iri(c: Column) -> Column:
    """A scheme, and no white space."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+\-.]*:") & ~c.rlike(r"\s"), F.lit(False))


def is_valid_local(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.\-]+$"), F.lit(False))


def build_iri(namespace: Column, local: Column) -> Column:
    """Null unless the namespace ends in # or /."""
    return F.when(namespace.rlike("[#/]$"), F.concat(namespace, local))


def namespace(config: Column, prefix: Column, onto: Column) -> Column:
    """X11: the first of the three that ends in # or /."""
    return F.coalesce(*[F.when(c.rlike("[#/]$"), c) for c in (config, prefix, onto)])


def annotation_parts(raw: Column) -> Column:
    """(text, lang) of `text@lang` or `"text"@lang`; no language if what follows @ is none."""
    tail, plain = r'"@([A-Za-z][A-Za-z0-9-]*)$', r"(?s)^(.+)@([A-Za-z][A-Za-z0-9-]*)$"
    lang = F.regexp_extract(raw, plain, 2)
    inner = F.substr(raw, F.lit(2), F.length(raw) - F.length(lang) - 3)
    bare = F.replace(F.replace(inner, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    quoted = F.startswith(raw, F.lit('"')) & raw.rlike(tail) & ~F.contains(bare, F.lit('"'))
    text = F.when(quoted, unescape(inner)).when(raw.rlike(plain), F.regexp_extract(raw, plain, 1)).otherwise(raw)
    return F.struct(text.alias("text"), F.when(quoted | raw.rlike(plain), lang).otherwise("").alias("lang"))


def unescape(c: Column) -> Column:
    """Backslash, quote, line feed and tab escapes; an escaped backslash is never read twice."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\u0003"))
    for code, plain in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return F.replace(c, F.lit("\u0003"), F.lit("\\"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def literal(value: Column, lang: Column, dt: Column) -> Column:
    """A literal in functional syntax."""
    body = F.concat(F.lit('"'), escape(value), F.lit('"'))
    return F.when(F.coalesce(lang, F.lit("")) != "", F.concat(body, F.lit("@"), lang)).when(F.coalesce(dt, F.lit("")) != "", F.concat(body, F.lit("^^<"), dt, F.lit(">"))).otherwise(body)


#: Annotation properties written short (fixed values).
SHORT = {"http://www.w3.org/2000/01/rdf-schema#" + x: "rdfs:" + x for x in ("label", "comment", "seeAlso", "isDefinedBy")}


def written_iri(c: Column) -> Column:
    w = F
    for full, short in SHORT.items():
        w = w.when(c == full, short)
    return w.otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def sctid(iri: Column) -> Column:
    """The digits after /id/ at the end, null if none."""
    d = F.regexp_extract(iri, r"/id/(\d+)$", 1)
    return F.when(d != "", d)


def sct_iri(id_: Column, base: str = "http://snomed.info/id/") -> Column:
    return F.concat(F.lit(base), id_)
