"""Turtle and N-Triples text as triples.

Files of any size are read in blocks.  A long string may run over lines and blocks: for each of the three
states that a line can start in (outside, in one of the two long quotes) its end state is found, these are
put together inside a block, and one row for each block carries the state over.  Statements are then
numbered by the full stops before them, their tokens gathered, names written out by the directives before
them, and each statement is read on its own by a small reader in Python.  A statement is as long as its
author made it; a file is never gathered.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions import expressions as X
from termweave.model import RDF, XSD
from termweave.operators.patterns import triple_row
from termweave.plans.tables import save
from termweave.sources import scans as S

#: What a long string holds up to its end, by its quote.
_INSIDE = {q: rf"(?:[^{q}\\]|\\.|{q}{{1,2}}(?!{q}))*+" for q in "\"'"}
_IRI = r"<(?:[^<>\s\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"
_CLOSED = "|".join([_IRI, *(rf"{q * 3}{_INSIDE[q]}{q * 3}" for q in "\"'")])
_OPEN = "|".join(rf"{q * 3}{_INSIDE[q]}\z" for q in "\"'")
_SHORT = "|".join(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}" for q in "\"'")
_WORD = r"(?:[^\s<>\"'()\[\];,.#^@\\]|\\.|\.+(?=[^\s<>\"'()\[\];,.#]))+"
#: A token: an IRI, a string, a comment, a language tag or directive, a sign, or a run of anything else.
TOKEN = rf"(?s)({_CLOSED}|{_OPEN}|{_SHORT}|#[^\n]*|@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^|[;,()\[\].]|{_WORD})"
_STATES = ["", '"""', "'''"]


def _state_after(text: Column, start: str) -> Column:
    """The state at the end of a line that starts in a state: 0 outside, 1 and 2 inside a long string."""
    if start:
        close = rf"(?s)^{_INSIDE[start[0]]}{start}"
        return F.when(text.rlike(close), _state_after(F.regexp_replace(text, close, ""), "")).otherwise(_STATES.index(start))
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))), -1)
    return F.when(last.rlike(rf"(?s)^\"\"\"{_INSIDE[chr(34)]}\z"), 1).when(last.rlike(rf"(?s)^'''{_INSIDE[chr(39)]}\z"), 2).otherwise(0)


def _followed(keys: list[str]):
    """A function over rows sorted by keys and n, each with its end states e0, e1, e2: the states s0, s1, s2 before it."""

    def run(batches):
        last, now = None, [0, 1, 2]
        for b in batches:
            before = []
            for row in b[[*keys, "e0", "e1", "e2"]].itertuples(index=False):
                if row[: len(keys)] != last:
                    last, now = row[: len(keys)], [0, 1, 2]
                before.append(now)
                now = [row[len(keys) + s] for s in now]
            told = pd.DataFrame(before, columns=["s0", "s1", "s2"], dtype="int32")
            yield pd.concat([b[[*keys, "n", "e0", "e1", "e2"]].reset_index(drop=True), told], axis=1)

    return run


def _before(rows: DataFrame, keys: list[str], key_types: str) -> DataFrame:
    """rows (keys, n, e0, e1, e2) with the states before each, for the three states before the first of its keys."""
    own = rows.repartition(*keys).sortWithinPartitions(*keys, "n")
    return own.mapInPandas(_followed(keys), f"{key_types}, n long, e0 int, e1 int, e2 int, s0 int, s1 int, s2 int")


def logical_lines(lines: DataFrame) -> DataFrame:
    """path, line_no, text, block: lines inside a long string go with the line that opened it."""
    ends = [_state_after(F.col("text"), s).cast("int").alias(f"e{i}") for i, s in enumerate(_STATES)]
    turns = save(lines.where(F.contains("text", F.lit('"""')) | F.contains("text", F.lit("'''"))).select("path", "block", F.col("line_no").alias("n"), *ends), "turns")
    if turns.isEmpty():
        return lines.select("path", "line_no", "text", "block")
    at = lambda states, i: F.get(F.array(*states), i)
    inside = save(_before(turns, ["path", "block"], "path string, block long"), "states")
    # a block's end states are those of its last turn for each state that the block can start in
    ends = inside.groupBy("path", F.col("block").alias("n")).agg(*[F.max_by(at(("e0", "e1", "e2"), F.col(f"s{i}")), "n").alias(f"e{i}") for i in range(3)])
    start = _before(ends, ["path"], "path string").select("path", F.col("n").alias("block"), F.col("s0").alias("first"))
    told = inside.join(start, ["path", "block"]).withColumn("before", at(("s0", "s1", "s2"), F.col("first")))
    told = told.select("path", "block", F.col("n").alias("line_no"), "before", at(("e0", "e1", "e2"), F.col("before")).alias("after"))
    rows = S.carried(lines.join(told, ["path", "block", "line_no"], "left"), F.col("after"), "state")
    # a line without a turn keeps the state of the last one; one with a turn has its own
    opens = F.coalesce(F.col("before"), F.col("state"), F.lit(0)) == 0
    rows = S.carried(rows.select("path", "line_no", "text", "block", opens.alias("opens")), F.when(F.col("opens"), F.col("line_no")), "first")
    alone = rows.groupBy("path", "first").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("p"))
    return alone.select("path", F.col("first").alias("line_no"), F.array_join("p.text", "\n").alias("text"), "block")


def statements(lines: DataFrame) -> DataFrame:
    """path, stmt, toks: the statements of each file, numbered from 0, as arrays of tokens."""
    rows = logical_lines(lines)
    toks = F.filter(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(1)), lambda t: ~t.startswith("#"))
    lower = lambda i: F.lower(F.coalesce(F.get("toks", i), F.lit("")))
    # directives without a full stop end with their IRI
    ends = lambda t, i: (t == ".") | (t.startswith("<") & ((lower(i - 2) == "prefix") | (lower(i - 1) == "base")))
    rows = rows.withColumn("toks", toks).where(F.size("toks") > 0)
    marked = F.transform("toks", lambda t, i: F.when(ends(t, i), F.concat(F.when(t == ".", "").otherwise(t), F.lit("\u0003"))).otherwise(F.concat(t, F.lit("\u0002"))))
    rows = rows.select("path", "block", "line_no", F.split(F.array_join(marked, ""), "\u0003").alias("parts"))
    rows = save(rows.withColumn("n", F.size("parts") - 1), "parts")
    per = rows.groupBy("path", "block").agg(F.sum("n").alias("b"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("path", "block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    here = F.coalesce(F.sum("n").over(W.partitionBy("path", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("h", here).join(per, ["path", "block"])
    each = rows.select("path", "line_no", (F.col("h") + F.col("b")).alias("s"), F.posexplode("parts").alias("i", "part")).where("part <> ''")
    whole = each.groupBy("path", (F.col("s") + F.col("i")).alias("stmt")).agg(F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("p"))
    split = F.filter(F.split(F.array_join("p.part", "\u0002"), "\u0002"), lambda t: t != "")
    return whole.select("path", "stmt", split.alias("toks"))


def against(base: Column, iri: Column) -> Column:
    """An IRI as it is meant where `base` holds; as it is without one."""
    whole = F.regexp_extract(base, r"^[^#]*", 0)
    joined = (
        F.when(iri == "", whole)
        .when(iri.startswith("#"), F.concat(whole, iri))
        .when(iri.startswith("//"), F.concat(F.regexp_extract(base, r"^[^:]*:", 0), iri))
        .when(iri.startswith("/"), F.concat(F.regexp_extract(base, r"^[^:]*:(//[^/?#]*)?", 0), iri))
        .otherwise(F.concat(F.regexp_extract(base, r"^[^?#]*/", 0), F.regexp_replace(iri, r"^(\./)+", "")))
    )
    return F.when(base.isNull() | iri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), iri).otherwise(joined)


def named_in_full(stmts: DataFrame) -> DataFrame:
    """The statements that are no directives, their names written out by the directives of the file before them."""
    word = F.lower(F.regexp_replace(F.get("toks", F.lit(0)), "^@", ""))
    is_prefix, is_base = (word == "prefix") & (F.size("toks") >= 3) & F.get("toks", F.lit(1)).endswith(":"), (word == "base") & (F.size("toks") == 2)
    stmts = save(stmts.withColumn("directive", is_prefix | is_base), "statements")
    name = F.when(is_prefix, F.regexp_replace(F.get("toks", F.lit(1)), ":$", ""))
    said = stmts.where("directive").select("path", "stmt", name.alias("name"), F.regexp_replace(F.element_at("toks", -1), "[<>]", "").alias("iri"))
    per = save(said.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("stmt", "name", "iri"))).alias("known")), "directives")
    own = stmts.where("not directive").join(F.broadcast(per) if per.count() <= S.BROADCAST_FILES else per, "path", "left")
    own = own.withColumn("known", F.filter("known", lambda d: d["stmt"] < F.col("stmt")))
    last = lambda test: F.try_element_at(F.filter("known", test), F.lit(-1))["iri"]
    own = own.withColumn("base", last(lambda d: d["name"].isNull()))
    form = r"(?s)^([^:<\"'^@(\[]*):(.*)$"
    prefix = lambda t: last(lambda d: d["name"] == F.regexp_extract(t, form, 1))
    local = lambda t: F.regexp_replace(F.regexp_extract(t, form, 2), r"\\(.)", "$1")
    closed = lambda c: F.concat(F.lit("<"), against(F.col("base"), c), F.lit(">"))
    full = lambda t: F.when(t.startswith("<"), closed(F.substr(t, F.lit(2), F.length(t) - 2))).when(t.rlike(form) & ~t.startswith("_:"), F.coalesce(closed(F.concat(prefix(t), local(t))), t)).otherwise(t)
    return own.select("path", "stmt", F.transform("toks", full).alias("toks"))


_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_NUMBERS = [(re.compile(r"[+-]?\d+"), XSD + "integer"), (re.compile(r"[+-]?\d*\.\d+"), XSD + "decimal"), (re.compile(r"[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+"), XSD + "double"), (re.compile("true|false"), XSD + "boolean")]


def _plain(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text) if "\\" in text else text


class _Statement:
    """One statement's triples: (s, p, kind, o, language, datatype); blank nodes are named by `node`."""

    def __init__(self, toks: list[str], node: str, number: int):
        self.toks, self.at, self.node, self.number, self.fresh, self.out = toks, 0, node, number, 0, []

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def blank(self) -> str:
        self.fresh += 1
        return f"_:{self.node}-{self.number}-{self.fresh}"

    def name(self):
        """The term at hand, if it is one token: (kind, value, language, datatype)."""
        t = self.peek()
        self.at += 1
        if t[:1] == "<":
            return ("iri", _plain(t[1:-1]), "", "")
        if t[:2] == "_:":
            return ("bnode", f"_:{self.node}-{t[2:]}", "", "")
        if t[:1] in ('"', "'"):
            cut = 3 if t[:3] in ('"""', "'''") and len(t) >= 6 else 1
            value, lang, kind = _plain(t[cut:-cut]), "", ""
            if self.peek()[:1] == "@":
                lang = self.peek()[1:]
                self.at += 1
            elif self.peek() == "^^":
                self.at += 1
                kind = self.name()[1]
            return ("lit", value, lang, kind)
        for form, kind in _NUMBERS:
            if form.fullmatch(t):
                return ("lit", t, "", kind)
        raise ValueError(f"unexpected {t or 'end'}")

    def read(self) -> list[tuple]:
        """What is open is kept in a list, so nesting of any depth is read: subject, predicate, kind, and the list's last cell."""
        open_: list[list] = []
        here = [None, None, "statement", None]

        def put(term) -> None:
            """A term in the place where the reader stands."""
            nonlocal here
            if here[2] == "list":
                cell = self.blank()
                if here[3] is None:
                    here[0] = cell
                else:
                    self.out.append((here[3], RDF + "rest", "bnode", cell, "", ""))
                self.out.append((cell, RDF + "first", *term))
                here[3] = cell
            elif here[0] is None:
                if term[0] == "lit":
                    raise ValueError("a literal as subject")
                here[0] = term[1]
            elif here[1] is None:
                if term[0] != "iri":
                    raise ValueError("a predicate that is no IRI")
                here[1] = term[1]
            else:
                self.out.append((here[0], here[1], *term))

        while self.at < len(self.toks):
            t = self.peek()
            if t == "[":
                self.at += 1
                open_.append(here)
                here = [self.blank(), None, "node", None]
            elif t == "(":
                self.at += 1
                open_.append(here)
                here = [None, None, "list", None]
            elif t in ("]", ")"):
                self.at += 1
                if here[2] != ("node" if t == "]" else "list"):
                    raise ValueError(f"unexpected {t}")
                if here[2] == "node":
                    term = ("bnode", here[0], "", "")
                else:
                    if here[3] is not None:
                        self.out.append((here[3], RDF + "rest", "iri", RDF + "nil", "", ""))
                    term = ("bnode", here[0], "", "") if here[0] else ("iri", RDF + "nil", "", "")
                here = open_.pop()
                put(term)
            elif t == ";":
                self.at += 1
                here[1] = None
            elif t == ",":
                self.at += 1
            elif t == "a" and here[0] is not None and here[1] is None and here[2] != "list":
                self.at += 1
                here[1] = RDF + "type"
            else:
                put(self.name())
        if open_:
            raise ValueError("a bracket is open")
        if not self.out:
            raise ValueError("no object")
        return self.out


_ROWS = "path string, stmt long, s string, p string, kind string, o string, lang string, dt string, error string"


def _read(batches):
    cols = [c.split()[0] for c in _ROWS.split(", ")]
    for b in batches:
        out = []
        for path, stmt, node, toks in zip(b["path"], b["stmt"], b["node"], b["toks"]):
            try:
                out += [(path, stmt, *t, None) for t in _Statement(list(toks), node, stmt).read()]
            except (ValueError, IndexError) as e:
                out.append((path, stmt, *[None] * 6, str(e)[:300]))
        yield pd.DataFrame(out, columns=cols)


def read_statements(stmts: DataFrame) -> DataFrame:
    """path, stmt, s, p, kind, o, lang, dt of all triples; one row with `error` for a statement that cannot be read."""
    node = F.lower(F.hex(F.xxhash64("path"))).alias("node")
    return named_in_full(stmts).select("path", "stmt", node, "toks").mapInPandas(_read, _ROWS)


def triples(spark: SparkSession, path: str, onto_id: Column | None = None) -> DataFrame:
    """onto_id, s, p, o_kind, o, o_lang, o_dt, o_key of Turtle and N-Triples files; an ontology is a path, or what onto_id says.

    Blank nodes are named by file (and statement, where they have no label), so those of two files are
    never one.  Statements that cannot be read are left out; bad_statements() tells them.
    """
    rows = read_statements(statements(S.lines(spark, path))).where("error is null")
    c = F.col
    return rows.select((c("path") if onto_id is None else onto_id).alias("onto_id"), *triple_row(c("s"), c("p"), c("kind"), c("o"), c("lang"), c("dt"))).distinct()


def bad_statements(spark: SparkSession, path: str) -> DataFrame:
    """Path, stmt, error of the statements that cannot be read."""
    return read_statements(statements(S.lines(spark, path))).where("error is not null").select("path", "stmt", "error")
