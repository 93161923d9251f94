"""Class expressions, in Manchester or functional syntax, as rows of nodes.

The one step that Python does: a small reader over distinct expressions, in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

NODES = "expr string, node_id int, parent_id int, pos int, op string, prop string, card int, iri string, text string"
_TOKEN = re.compile(r"<[^>]*>|\"(?:[^\"\\]|\\.)*\"(?:@[\w-]+|\^\^\S+)?|'[^']*'|[(){},]|[^\s(){},<>\"']+")
#: Functional names of the forms (fixed values): operator, and whether a property or a number comes first.
_FORMS = {"ObjectIntersectionOf": "and", "ObjectUnionOf": "or", "ObjectComplementOf": "not", "ObjectOneOf": "oneOf", "ObjectSomeValuesFrom": "some", "DataSomeValuesFrom": "some", "ObjectAllValuesFrom": "only", "DataAllValuesFrom": "only", "ObjectHasValue": "value", "DataHasValue": "value", "ObjectHasSelf": "self", "ObjectMinCardinality": "min", "ObjectMaxCardinality": "max", "ObjectExactCardinality": "exactly", "DataMinCardinality": "min", "DataMaxCardinality": "max", "DataExactCardinality": "exactly"}
_RESTRICTIONS = ("some", "only", "value", "min", "max", "exactly", "self")


class _Reader:
    """One expression: nested (op, prop, card, iri, children)."""

    def __init__(self, text: str):
        self.toks, self.at = _TOKEN.findall(text), 0

    def peek(self) -> str:
        return self.toks[self.at] if self.at < len(self.toks) else ""

    def take(self, want: str = "") -> str:
        t = self.peek()
        if not t or (want and t != want):
            raise ValueError(f"expected {want or 'more'} at {self.at}")
        self.at += 1
        return t

    def joined(self, word: str, part):
        items = [part()]
        while self.peek().lower() == word:
            self.take()
            items.append(part())
        return items[0] if len(items) == 1 else (word, None, None, None, items)

    def union(self):
        return self.joined("or", lambda: self.joined("and", self.primary))

    def primary(self):
        t = self.take()
        if t.lower() == "not":
            return ("not", None, None, None, [self.primary()])
        if t == "(":
            out = self.union()
            self.take(")")
            return out
        if t == "{":
            out = []
            while self.peek() != "}":
                if self.peek() == ",":
                    self.take()
                out.append(self.leaf(self.take()))
            self.take("}")
            return ("oneOf", None, None, None, out)
        if t in _FORMS and self.peek() == "(":
            return self.form(_FORMS[t])
        word = self.peek().lower()
        if word in _RESTRICTIONS:
            self.take()
            if word == "self":
                return ("self", t.strip("<>"), None, None, [])
            card = int(self.take()) if word in ("min", "max", "exactly") else None
            ends = self.peek().lower() in ("", ")", "and", "or", "}", ",")
            return (word, t.strip("<>"), card, None, [] if card is not None and ends else [self.primary()])
        return self.leaf(t)

    def form(self, op: str):
        self.take("(")
        card = int(self.take()) if op in ("min", "max", "exactly") else None
        prop = self.take().strip("<>") if op in _RESTRICTIONS else None
        items = []
        while self.peek() != ")":
            items.append(self.primary())
        self.take(")")
        return (op, prop, card, None, items)

    @staticmethod
    def leaf(t: str):
        if t in "(){},":
            raise ValueError(f"unexpected {t}")
        return ("class", None, None, t[1:-1] if t[0] == "<" else t, [])


def _rows(expr: str):
    """Nodes of an expression, parents first; one node of op `error` if it cannot be read."""
    try:
        r = _Reader(expr)
        tree = r.union()
        if r.peek():
            raise ValueError("text goes on")
    except (ValueError, IndexError, RecursionError) as e:
        return [(expr, 0, None, 0, "error", None, None, None, str(e)[:300])]
    out, todo = [], [(tree, None, 0)]
    while todo:
        (op, prop, card, iri, kids), parent, pos = todo.pop(0)
        me = len(out)
        out.append((expr, me, parent, pos, op, prop, card, iri, _text((op, prop, card, iri, kids))))
        todo += [(k, me, i) for i, k in enumerate(kids)]
    return out


def _text(node) -> str:
    """The canonical text, every nested part in parentheses."""
    op, prop, card, iri, kids = node
    if op == "class":
        return iri
    inner = [_text(k) if k[0] == "class" else f"({_text(k)})" for k in kids]
    if op in ("and", "or"):
        return f" {op} ".join(inner)
    if op == "oneOf":
        return "{" + ", ".join(inner) + "}"
    return " ".join(x for x in (prop, op, None if card is None else str(card), *inner) if x)


#: Names of the forms in functional syntax (fixed values), those of restrictions without Object or Data.
_FUNCTIONAL = {"and": "ObjectIntersectionOf", "or": "ObjectUnionOf", "not": "ObjectComplementOf", "oneOf": "ObjectOneOf", "some": "SomeValuesFrom", "only": "AllValuesFrom", "value": "HasValue", "self": "HasSelf", "min": "MinCardinality", "max": "MaxCardinality", "exactly": "ExactCardinality"}
_DATATYPE = re.compile(r'"|[+-]?\d|<?(http://www\.w3\.org/2001/XMLSchema#|xsd:|rdfs:Literal|http://www\.w3\.org/2000/01/rdf-schema#Literal)')
_WHOLE_IRI = re.compile("(https?://|urn:|file:)")


def _functional(node) -> str:
    """A tree in functional syntax; a restriction to a datatype or literal is one of a data property."""
    op, prop, card, iri, kids = node
    name = lambda x: f"<{x}>" if _WHOLE_IRI.match(x) else x
    if op == "class":
        return name(iri)
    inner = [_functional(k) for k in kids]
    if prop is None:
        return f"{_FUNCTIONAL[op]}({' '.join(inner)})"
    kind = "Data" if kids and kids[0][0] == "class" and _DATATYPE.match(kids[0][3]) else "Object"
    return f"{kind}{_FUNCTIONAL[op]}({' '.join([*([] if card is None else [str(card)]), name(prop), *inner])})"


def functional_text(exprs: DataFrame) -> DataFrame:
    """expr, functional: the distinct expressions of column expr in functional syntax; null if one cannot be read."""

    def read(batches):
        for pdf in batches:
            out = []
            for e in pdf["expr"]:
                try:
                    r = _Reader(e)
                    tree = r.union()
                    out.append(None if r.peek() else _functional(tree))
                except (ValueError, IndexError, RecursionError):
                    out.append(None)
            yield pd.DataFrame({"expr": pdf["expr"], "functional": out})

    return exprs.select("expr").where("expr is not null").distinct().mapInPandas(read, "expr string, functional string")


def manchester_text(exprs: DataFrame) -> DataFrame:
    """expr, manchester: the distinct expressions of column expr in canonical Manchester syntax; null if one cannot be read."""
    n = flatten(exprs)
    return n.where("node_id = 0").selectExpr("expr", "case when op <> 'error' then text end AS manchester")


def flatten(exprs: DataFrame) -> DataFrame:
    """Node rows of the distinct expressions of column expr; unreadable ones give one `error` node."""

    def read(batches):
        for pdf in batches:
            rows = [r for e in pdf["expr"] for r in _rows(e)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")])
            out["parent_id"] = out["parent_id"].astype("Int32")
            out["card"] = out["card"].astype("Int32")
            yield out

    return exprs.select("expr").where("expr is not null").distinct().mapInPandas(read, NODES)
