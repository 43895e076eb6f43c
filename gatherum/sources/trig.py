"""TriG (and so Turtle): quads as blocks of text, and a reader that says at which line and column a text fails."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatherum.operators.graph import RDF_TYPE, XSD

_QUAD = "g string, s string, p string, o string, o_kind string, o_datatype string, o_lang string"


def to_trig(quads: DataFrame) -> DataFrame:
    """(g, s, value): one block of TriG for each graph and subject, its predicates sorted. A text of blocks in any order is TriG, so files need no order.

    Blank nodes keep their labels; where those come from a hash of what the node states, equal graphs give equal texts.
    """
    escaped = F.col("o")
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull() & (F.col("o_datatype") != XSD + "string"), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), tail)).otherwise(node(F.col("o")))
    said = F.concat(F.when(F.col("p") == RDF_TYPE, "a").otherwise(node(F.col("p"))), F.lit(" "), o)
    body = F.array_join(F.sort_array(F.collect_set(said)), " ;\n    ")
    blocks = quads.groupBy("g", "s").agg(body.alias("body"))
    text = F.concat(node(F.col("s")), F.lit(" "), "body", F.lit(" ."))
    return blocks.select("g", "s", F.when(F.col("g").isNull(), text).otherwise(F.concat(node(F.col("g")), F.lit(" {\n  "), text, F.lit("\n}"))).alias("value"))


_TOKEN = re.compile(r"""(?P<skip>\s+|\#[^\n]*)|<(?P<iri>[^<>"{}|^`\\\s]*)>|(?P<blank>_:[\w.-]*\w)|"{3}(?P<long>(?:[^"\\]|\\.|"(?!""))*)"{3}|"(?P<str>(?:[^"\\\n]|\\.)*)"|@(?P<at>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<num>[+-]?(?:\d+\.\d+|\.?\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z][\w-]*)?:(?P<local>[\w.-]*\w|)|(?P<word>[A-Za-z]+)|(?P<mark>\^\^|[{}.;,])""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class TrigError(ValueError):
    def __init__(self, text: str, at: int, message: str):
        self.line, self.column, self.message = text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at), message
        super().__init__(f"line {self.line}, column {self.column}: {message}")


def _unescaped(value: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), value, flags=re.S)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at, self.prefixes, self.tokens, self.next = text, 0, {}, [], 0
        while self.at < len(text):
            m = _TOKEN.match(text, self.at)
            if not m:
                raise TrigError(text, self.at, f"unexpected {text[self.at]!r}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m, self.at))
            self.at = m.end()

    def fail(self, message: str):
        raise TrigError(self.text, self.tokens[self.next][2] if self.next < len(self.tokens) else len(self.text), message)

    def peek(self) -> str:
        return self.tokens[self.next][1].group() if self.next < len(self.tokens) else ""

    def has(self, mark: str) -> bool:
        if self.peek() == mark:
            self.next += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.has(mark):
            self.fail(f"expected {mark!r}, found {self.peek() or 'the end'!r}")

    def term(self) -> tuple:
        """(value, kind, datatype, language)"""
        if self.next >= len(self.tokens):
            self.fail("expected a term, found the end")
        kind, m, _ = self.tokens[self.next]
        if kind == "iri":
            out = (m["iri"], "iri", None, None)
        elif kind == "blank":
            out = (m["blank"], "blank", None, None)
        elif kind == "local":
            if (m["name"] or "") not in self.prefixes:
                self.fail(f"unknown prefix {m['name'] or ''!r}")
            out = (self.prefixes[m["name"] or ""] + m["local"], "iri", None, None)
        elif kind == "num":
            out = (m["num"], "literal", XSD + ("double" if "e" in m["num"].lower() else "decimal" if "." in m["num"] else "integer"), None)
        elif kind == "word" and m["word"] in ("true", "false"):
            out = (m["word"], "literal", XSD + "boolean", None)
        elif kind in ("str", "long"):
            value = _unescaped(m[kind])
            self.next += 1
            if self.has("^^"):
                return (value, "literal", self.term()[0], None)
            if self.next < len(self.tokens) and self.tokens[self.next][0] == "at":
                self.next += 1
                return (value, "literal", None, self.tokens[self.next - 1][1]["at"])
            return (value, "literal", XSD + "string", None)
        else:
            self.fail(f"expected a term, found {m.group()!r}")
        self.next += 1
        return out

    def statements(self, graph: str | None, subject: tuple) -> Iterator[tuple]:
        if subject[1] == "literal":
            self.fail("a literal can't be a subject")
        while True:
            p = (RDF_TYPE, "iri") if self.has("a") else self.term()
            if p[1] != "iri":
                self.fail("a predicate must be an IRI")
            while True:
                o = self.term()
                yield (graph, subject[0], p[0], *o)
                if not self.has(","):
                    break
            if not self.has(";") or self.peek() in (".", "}"):
                return

    def quads(self) -> Iterator[tuple]:
        while self.next < len(self.tokens):
            if self.peek().lower() in ("@prefix", "prefix"):
                sparql = self.peek().lower() == "prefix"
                self.next += 1
                if self.next >= len(self.tokens) or self.tokens[self.next][0] != "local":
                    self.fail("expected a prefix")
                name = self.tokens[self.next][1]["name"] or ""
                self.next += 1
                self.prefixes[name] = self.term()[0]
                if not sparql:
                    self.need(".")
                continue
            self.has("GRAPH")
            if self.peek() == "{":
                yield from self.block(None)
                continue
            first = self.term()
            if self.peek() == "{":
                yield from self.block(first[0])
            else:
                yield from self.statements(None, first)
                self.need(".")

    def block(self, graph: str | None) -> Iterator[tuple]:
        self.need("{")
        while not self.has("}"):
            yield from self.statements(graph, self.term())
            if self.peek() != "}":
                self.need(".")


def parse_trig(text: str) -> list[tuple]:
    """Quads (g, s, p, o, o_kind, o_datatype, o_lang) of a text; TrigError says where it fails."""
    return list(_Reader(text).quads())


def from_trig(texts: DataFrame, name: str, text: str) -> DataFrame:
    """(name, quad's columns, line, column, error): the quads of each text, or one row with the place of its error. A text is read whole by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [name, "g", "s", "p", "o", "o_kind", "o_datatype", "o_lang", "line", "column", "error"]
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(batch[name], batch[text]):
                try:
                    rows += [(key, *q, None, None, None) for q in parse_trig(value or "")]
                except TrigError as e:
                    rows.append((key, *[None] * 7, e.line, e.column, e.message))
            yield pd.DataFrame(rows, columns=names).astype({"line": "Int64", "column": "Int64"})

    kind = texts.schema[name].dataType.simpleString()
    return texts.select(name, text).mapInPandas(run, f"{name} {kind}, {_QUAD}, line long, `column` long, error string")
