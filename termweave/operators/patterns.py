"""Graph patterns over a triple table: patterns, joins, optional parts, unions, order and paging.

A binding is a row with one column per variable, holding a term key or NULL (unbound).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.model import iri_key, kind_of, term_key, value_of


class Var(str):
    """A variable's name."""


class Lit:
    def __init__(self, value: str, lang: str = "", dt: str = ""):
        self.value, self.lang, self.dt = value, lang, dt


def triple_row(s, p, o_kind, o, o_lang=None, o_dt=None) -> list[Column]:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    lang, dt = c(o_lang if o_lang is not None else ""), c(o_dt if o_dt is not None else "")
    return [c(s).alias("s"), c(p).alias("p"), c(o_kind).alias("o_kind"), c(o).alias("o"), lang.alias("o_lang"), dt.alias("o_dt"), term_key(c(o_kind), c(o), lang, dt).alias("o_key")]


def match(triples: DataFrame, s, p, o) -> DataFrame:
    """Q01: one triple pattern.  Constants filter the stored columns, variables become columns; a variable used twice must agree."""
    where, cols = [], {}
    for term, key, plain in ((s, iri_key(F.col("s")), "s"), (p, iri_key(F.col("p")), "p"), (o, F.col("o_key"), "o")):
        if isinstance(term, Var):
            cols.setdefault(str(term), []).append(key)
        elif isinstance(term, Lit):
            where += [F.col("o_kind") == "lit", F.col("o") == term.value, F.col("o_lang") == term.lang, F.col("o_dt") == term.dt]
        else:
            where.append(F.col(plain) == term)
            if plain == "o":
                where.append(F.col("o_kind") == "iri")
    for same in cols.values():
        where += [same[0] == k for k in same[1:]]
    found = triples.where(reduce(lambda a, b: a & b, where)) if where else triples
    return found.select(*[k[0].alias(v) for v, k in cols.items()])


def join(left: DataFrame, right: DataFrame, maybe: set[str] = frozenset()) -> DataFrame:
    """Q02 and Q04: join on all shared variables, or every pair if there is none.

    Variables of `left` in `maybe` can be unbound there: such rows match any value and take it.  Bound
    and unbound rows are joined apart, so both stay equi-joins.
    """
    shared = [c for c in left.columns if c in right.columns]
    loose = [c for c in shared if c in maybe]
    if not loose:
        return left.join(right, shared) if shared else left.crossJoin(right)
    v = loose[0]
    bound = join(left.where(F.col(v).isNotNull()), right, set(maybe) - {v})
    free = join(left.where(F.col(v).isNull()).drop(v), right, set(maybe) - {v})
    return bound.unionByName(free.select(*bound.columns))


def bgp(triples: DataFrame, patterns: list[tuple], start: DataFrame | None = None, maybe: set[str] = frozenset()) -> DataFrame:
    """Q02: all patterns hold."""
    rows = [match(triples, *x) for x in patterns]
    return reduce(lambda a, b: join(a, b, maybe), ([start] if start is not None else []) + rows)


def optional(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Q03: left outer join; a condition inside the optional part may see variables of both sides."""
    shared = [c for c in left.columns if c in right.columns]
    r = right.select(*[F.col(c).alias(f"_r_{c}" if c in shared else c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_r_{c}") for c in shared], F.lit(True))
    if condition is not None:
        on = on & F.coalesce(condition, F.lit(False))
    return left.join(r, on, "left").drop(*[f"_r_{c}" for c in shared])


def keep(rows: DataFrame, test: Column) -> DataFrame:
    """Q05: filter at this point of the pattern; an unknown result drops the row."""
    return rows.where(F.coalesce(test, F.lit(False)))


def union(*branches: DataFrame) -> DataFrame:
    """Q06: all rows of all branches; variables that a branch lacks are unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)


def group(rows: DataFrame, *steps) -> DataFrame:
    """Q07: steps one after another."""
    return reduce(lambda df, f: df.transform(f), steps, rows)


def project(rows: DataFrame, names: list[str] | None = None, render: bool = True) -> DataFrame:
    """Q08: named variables (missing ones unbound), or all; as text unless render is False."""
    names = names or rows.columns
    out = [F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names]
    return rows.select(*[term_text(c).alias(n) if render else c.alias(n) for n, c in zip(names, out)])


def distinct(rows: DataFrame, names: list[str]) -> DataFrame:
    """Q09: distinct whole terms of the projected variables."""
    return rows.select(*names).distinct()


def sort_keys(keys: list[tuple[str, bool]], numeric: bool = False) -> list[Column]:
    """Q10: values as text ('' if unbound), True for descending; the whole term settles ties."""
    out = []
    for name, down in keys:
        v = F.coalesce(value_of(F.col(name)), F.lit(""))
        for c in ([number(v)] if numeric else []) + [v]:
            out.append(c.desc() if down else c.asc())
    return out + [F.col(n).asc() for n, _ in keys]


def order(rows: DataFrame, keys: list[tuple[str, bool]], numeric: bool = False) -> DataFrame:
    return rows.orderBy(*sort_keys(keys, numeric))


def page(rows: DataFrame, limit: int | None = None, offset: int = 0, cap: int = 1000) -> DataFrame:
    """Q11: offset and limit, never more than cap; a limit of 0 gives no rows."""
    return rows.offset(offset).limit(cap if limit is None else min(limit, cap))


def with_total(rows: DataFrame) -> int:
    """Q12: number of rows before paging."""
    return rows.count()


def term_text(key: Column) -> Column:
    """A term as text: <iri>, _:id, "value"@lang, "value"^^<type>."""
    parts = F.split(key, "\u0001")
    body = F.concat(F.lit('"'), parts[1], F.lit('"'))
    lit = F.when(parts[2] != "", F.concat(body, F.lit("@"), parts[2])).when(parts[3] != "", F.concat(body, F.lit("^^<"), parts[3], F.lit(">"))).otherwise(body)
    return F.when(parts[0] == "iri", F.concat(F.lit("<"), parts[1], F.lit(">"))).when(parts[0] == "bnode", F.concat(F.lit("_:"), parts[1])).otherwise(lit)


def number(v: Column) -> Column:
    """The number that a text stands for; '' is 0; suffixes, NaN and hexadecimal are no numbers."""
    t = F.trim(v)
    plain = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(t == "", F.lit(0.0)).when(plain, t.try_cast("double")).when(t.rlike("^[+-]?Infinity$"), t.try_cast("double"))


# ---------------------------------------------------------------- filter functions


def equal(a: Column, b: Column) -> Column:
    """the same term; with an unbound side never."""
    return F.coalesce(a == b, F.lit(False))


def unequal(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def compare(op: str, a: Column, b: Column) -> Column:
    """by number if both values are numbers, else by text; unbound: false."""
    x, y = value_of(a), value_of(b)
    n, m = number(x), number(y)
    test = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
    return F.coalesce(F.when(n.isNotNull() & m.isNotNull(), test(n, m)).otherwise(test(x, y)), F.lit(False))


def both(a: Column, b: Column) -> Column:
    """F03."""
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


def either(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def negate(a: Column) -> Column:
    return ~F.coalesce(a, F.lit(False))


def regex(a: Column, pattern: str, flags: str = "") -> Column:
    """a match anywhere in the value; a pattern that Java cannot compile matches nothing."""
    from pyspark.sql import SparkSession

    own = "".join(f for f in flags if f in "imsx")
    full = f"(?{own}){pattern}" if own else pattern
    try:
        SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(full)
    except Exception:  # noqa: BLE001  py4j wraps PatternSyntaxException
        return F.lit(False)
    return F.coalesce(value_of(a).rlike(full), F.lit(False))


def contains(a: Column, text) -> Column:
    """F05."""
    return F.coalesce(F.contains(value_of(a), text if isinstance(text, Column) else F.lit(text)), F.lit(False))


def starts(a: Column, text: str) -> Column:
    return F.coalesce(value_of(a).startswith(text), F.lit(False))


def ends(a: Column, text: str) -> Column:
    return F.coalesce(value_of(a).endswith(text), F.lit(False))


def lang(a: Column) -> Column:
    """the language, '' if none; has_lang as a test."""
    from termweave.model import lang_of

    return F.coalesce(lang_of(a), F.lit(""))


def has_lang(a: Column) -> Column:
    return lang(a) != ""


def lang_matches(tag: Column, range_: str) -> Column:
    """* takes any language; else the tag itself or one that goes on after a hyphen."""
    if range_ == "*":
        return tag != ""
    t, r = F.lower(tag), range_.lower()
    return (t == r) | t.startswith(r + "-")


def is_iri(a: Column) -> Column:
    """F08."""
    return F.coalesce(kind_of(a) == "iri", F.lit(False))


def is_literal(a: Column) -> Column:
    return F.coalesce(kind_of(a) == "lit", F.lit(False))


def bound(a: Column) -> Column:
    return a.isNotNull()


def text(a: Column) -> Column:
    """the value; as a test, a value that is not empty."""
    return value_of(a)


def upper(a: Column) -> Column:
    """F10."""
    return F.upper(value_of(a))


def lower(a: Column) -> Column:
    return F.lower(value_of(a))


def concat(*terms: Column) -> Column:
    return F.concat(*[F.coalesce(value_of(t), F.lit("")) for t in terms])


def length(a: Column) -> Column:
    return F.length(value_of(a))


def truth(a: Column) -> Column:
    """unbound, 'false', '0' and '' are false."""
    return F.coalesce(~value_of(a).isin("false", "0", ""), F.lit(False))
