"""A subset of SPARQL as DataFrame plans over a table of quads.

SELECT and ASK with basic graph patterns, paths (/, ^, |, and +, *, ? by ``graph.closure``), OPTIONAL, UNION, MINUS, GRAPH, VALUES, BIND, sub-selects,
FILTER (comparisons, &&, ||, !, STR, STRLEN, STRENDS, STRSTARTS, CONTAINS, DATATYPE, LANG, isLiteral, isIRI, BOUND), DISTINCT, COUNT
with GROUP BY and HAVING, ORDER BY and LIMIT. The default graph is the union of all graphs, as a bag: a triple in two graphs gives two
rows. Updates and the other forms are refused by name. A pattern becomes a filter on the quads, and patterns join on their common
variables. Patterns that are joined are taken in an order in which each shares a variable with those before, so a product arises only
where the query itself is one. A variable that may be unbound is compatible with any value: rows without it join on the others.
"""

from __future__ import annotations

import re
import threading
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.operators.graph import closure

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


class Refused(ValueError):
    """``code`` says why: syntax, update_refused, form_refused, evaluation."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<var>[?$]\w+)|(?P<num>[+-]?\d+(?:\.\d+)?)|(?P<pname>[A-Za-z][\w-]*)?:(?P<local>[\w-]*)|(?P<word>[A-Za-z]+)|(?P<op>&&|\|\||!=|<=|>=|\^\^|@[A-Za-z-]+|[{}().;,=<>!*/^|?+])""")


@dataclass
class Query:
    form: str = "select"
    variables: list[str] = field(default_factory=list)
    counts: list[tuple[str | None, bool, str]] = field(default_factory=list)
    distinct: bool = False
    where: list = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        self.prefixes: dict[str, str] = {}
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise Refused("syntax", f"at character {at}")
            at = m.end()
            if m.group("local") is not None:
                self.tokens.append(("pname", f"{m.group('pname') or ''}:{m.group('local')}"))
            elif m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
        self.at = 0
        self.fresh = count()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if kind == "end" or (value is not None and text.upper() != value.upper()):
            raise Refused("syntax", f"expected {value or 'more'}, found {text or 'the end'}")
        self.at += 1
        return kind, text

    def has(self, value: str) -> bool:
        if self.peek()[1].upper() == value.upper() and self.peek()[0] in ("word", "op"):
            self.at += 1
            return True
        return False

    def query(self, inner: bool = False) -> Query:
        while self.has("PREFIX"):
            name = self.take()[1]
            self.prefixes[name[:-1]] = self.take()[1][1:-1]
        word = self.peek()[1].upper()
        if word in ("INSERT", "DELETE", "CLEAR", "DROP", "LOAD", "CREATE", "COPY", "MOVE", "ADD"):
            raise Refused("update_refused", word)
        if word in ("CONSTRUCT", "DESCRIBE"):
            raise Refused("form_refused", word)
        q = Query()
        if self.has("ASK"):
            q.form = "ask"
        else:
            self.take("SELECT")
            q.distinct = self.has("DISTINCT")
            while True:
                if self.has("("):
                    self.take("COUNT")
                    self.take("(")
                    distinct = self.has("DISTINCT")
                    what = None if self.has("*") else self.take()[1][1:]
                    self.take(")")
                    self.take("AS")
                    q.counts.append((what, distinct, self.take()[1][1:]))
                    self.take(")")
                elif self.peek()[0] == "var":
                    q.variables.append(self.take()[1][1:])
                elif self.has("*"):
                    pass
                else:
                    break
        self.has("WHERE")
        q.where = self.group()
        if self.has("GROUP"):
            self.take("BY")
            while self.peek()[0] == "var":
                q.group.append(self.take()[1][1:])
        while self.has("HAVING"):
            self.take("(")
            q.having.append(self.either())
            self.take(")")
        if self.has("ORDER"):
            self.take("BY")
            while True:
                if self.peek()[0] == "var":
                    q.order.append((self.take()[1][1:], True))
                elif self.peek()[1].upper() in ("ASC", "DESC"):
                    up = self.take()[1].upper() == "ASC"
                    self.take("(")
                    q.order.append((self.take()[1][1:], up))
                    self.take(")")
                else:
                    break
        if self.has("LIMIT"):
            q.limit = int(self.take()[1])
        if self.peek()[0] != "end" and not inner:
            raise Refused("syntax", f"unexpected {self.peek()[1]}")
        return q

    def group(self) -> list:
        self.take("{")
        out: list = []
        if self.peek()[1].upper() == "SELECT":
            out.append(("select", self.query(inner=True)))
            self.take("}")
            return out
        while not self.has("}"):
            word = self.peek()[1].upper() if self.peek()[0] == "word" else ""
            if word == "OPTIONAL":
                self.take()
                out.append(("optional", self.group()))
            elif word == "GRAPH":
                self.take()
                name = self.term()
                out.append(("graph", name, self.group()))
            elif word == "FILTER":
                self.take()
                out.append(("filter", self.either()))
            elif word == "SERVICE":
                raise Refused("evaluation", "SERVICE")
            elif word == "MINUS":
                self.take()
                out.append(("minus", self.group()))
            elif word == "BIND":
                self.take()
                self.take("(")
                value = self.either()
                self.take("AS")
                out.append(("bind", value, self.take()[1][1:]))
                self.take(")")
            elif word == "VALUES":
                self.take()
                out.append(self.values())
            elif self.peek()[1] == "{":
                parts = [self.group()]
                while self.has("UNION"):
                    parts.append(self.group())
                out.append(("union", parts))
            else:
                self.triples(out)
            self.has(".")
        return out

    def values(self) -> tuple:
        """Rows of terms; UNDEF is an unbound cell."""
        many = self.has("(")
        names = []
        while self.peek()[0] == "var":
            names.append(self.take()[1][1:])
        if many:
            self.take(")")
        rows: list[list] = []
        self.take("{")
        while not self.has("}"):
            if many:
                self.take("(")
            rows.append([None if self.has("UNDEF") else self.term() for _ in names])
            if many:
                self.take(")")
        return ("values", names, rows)

    def triples(self, out: list) -> None:
        s = self.term()
        while True:
            path = self.path()
            while True:
                self.expand(out, s, path, self.term())
                if not self.has(","):
                    break
            if not self.has(";") or self.peek()[1] in (".", "}"):
                return

    def path(self) -> tuple:
        """("or", paths) of ("then", steps) of ("inverse", path), or a term."""
        options = [self.steps()]
        while self.has("|"):
            options.append(self.steps())
        return options[0] if len(options) == 1 else ("or", options)

    def steps(self) -> tuple:
        steps = [self.step()]
        while self.has("/"):
            steps.append(self.step())
        return steps[0] if len(steps) == 1 else ("then", steps)

    def step(self) -> tuple:
        if self.has("^"):
            return ("inverse", self.step())
        if self.has("("):
            step = self.path()
            self.take(")")
        else:
            step = ("iri", RDF_TYPE) if self.has("a") else self.term()
        mark = self.take()[1] if self.peek() in (("op", "*"), ("op", "+"), ("op", "?")) else None
        return ("closure", step, mark) if mark else step

    def expand(self, out: list, s: tuple, path: tuple, o: tuple) -> None:
        """A path as plain patterns; places between steps get variables that no query can name."""
        if path[0] == "inverse":
            self.expand(out, o, path[1], s)
        elif path[0] == "then":
            for k, step in enumerate(path[1]):
                after = o if k + 1 == len(path[1]) else ("var", f" {next(self.fresh)}")
                self.expand(out, s, step, after)
                s = after
        elif path[0] == "or":
            parts: list = []
            for option in path[1]:
                parts.append([])
                self.expand(parts[-1], s, option, o)
            out.append(("union", parts))
        elif path[0] == "closure":
            a, b = (("var", f" {next(self.fresh)}") for _ in range(2))
            inner: list = []
            self.expand(inner, a, path[1], b)
            out.append(("closure", s, o, path[2], inner, a[1], b[1]))
        else:
            out.append(("triple", s, path, o))

    def term(self) -> tuple:
        """("var", name), ("iri", value) or ("literal", value, datatype, language)."""
        kind, text = self.take()
        if kind == "var":
            return ("var", text[1:])
        if kind == "iri":
            return ("iri", text[1:-1])
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise Refused("syntax", f"unknown prefix {prefix}")
            return ("iri", self.prefixes[prefix] + local)
        if kind == "word" and text in ("true", "false"):
            return ("literal", text, XSD + "boolean", None)
        if kind == "num":
            return ("literal", text, XSD + ("decimal" if "." in text else "integer"), None)
        if kind == "str":
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])
            if self.has("^^"):
                return ("literal", value, self.term()[1], None)
            if self.peek()[0] == "op" and self.peek()[1].startswith("@"):
                return ("literal", value, None, self.take()[1][1:].lower())
            return ("literal", value, XSD + "string", None)
        raise Refused("syntax", f"unexpected {text}")

    def either(self) -> tuple:
        left = self.both()
        while self.has("||"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.compared()
        while self.has("&&"):
            left = ("and", left, self.compared())
        return left

    def compared(self) -> tuple:
        left = self.value()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.has(op):
                return ("cmp", op, left, self.value())
        return left

    def value(self) -> tuple:
        if self.has("!"):
            return ("not", self.value())
        if self.has("("):
            inner = self.either()
            self.take(")")
            return inner
        if self.peek()[0] == "word" and self.peek()[1] not in ("true", "false"):
            name = self.take()[1].upper()
            self.take("(")
            args = [self.either()]
            while self.has(","):
                args.append(self.either())
            self.take(")")
            return ("call", name, args)
        kind, text = self.peek()
        term = self.term()
        return ("number", float(text)) if kind == "num" else term


def parse(text: str) -> Query:
    return _Parser(text).query()


def _cell(prefix: str) -> Column:
    return F.struct(F.col("o_kind").alias("type"), F.col("o").alias("value"), F.col("o_datatype").alias("datatype"), F.col("o_lang").alias("lang")) if prefix == "o" else F.struct(F.when(F.col(prefix).startswith("_:"), "blank").otherwise("iri").alias("type"), F.col(prefix).alias("value"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


_CELL = "struct<type: string, value: string, datatype: string, lang: string>"


def _constant(term: tuple | None) -> Column:
    """A term of the query as a cell; an unbound one is null."""
    if term is None:
        return F.lit(None).cast(_CELL)
    datatype, lang = (term[2], term[3]) if term[0] == "literal" else (None, None)
    return F.struct(F.lit(term[0]).alias("type"), F.lit(term[1]).alias("value"), F.lit(datatype).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang"))


def _variables(item: tuple) -> set[str]:
    """Variables that an item of a group can bind."""
    if item[0] == "triple":
        return {t[1] for t in item[1:] if t[0] == "var"}
    if item[0] == "closure":
        return {t[1] for t in item[1:3] if t[0] == "var"}
    if item[0] == "graph":
        return ({item[1][1]} if item[1][0] == "var" else set()).union(*map(_variables, item[2]))
    if item[0] == "union":
        return set().union(*(_variables(x) for part in item[1] for x in part))
    if item[0] == "values":
        return set(item[1])
    if item[0] == "select":
        return {*item[1].variables, *(c[2] for c in item[1].counts)} or set().union(*map(_variables, item[1].where))
    return {item[2]} if item[0] == "bind" else set()


_JOINED = ("triple", "closure", "graph", "union", "values", "select")


def _connected(items: list, bound: set[str]) -> Iterator[tuple]:
    """Items that are joined in an order in which each shares a variable with those before it (and with ``bound``), where that can be."""
    while items:
        at = next((k for k, x in enumerate(items) if bound & _variables(x)), 0)
        bound |= _variables(items[at])
        yield items[at]
        items = items[:at] + items[at + 1 :]


#: Quads to a task of a join on subjects. Quads pack well, so the size of a shuffle says little about the memory that its rows take.
_QUADS_A_TASK = 1_000_000


class _Rows:
    """Solutions: a table with a column for each variable, and which of them may be unbound.

    ``keys`` are variables with few rows to a value, as subjects have; ``dealt`` is how the rows are dealt to tasks: (tasks, variables).
    """

    def __init__(self, df: DataFrame, maybe: set[str] = frozenset(), planner: _Planner | None = None, keys: set[str] = frozenset(), dealt: tuple = ()):
        self.df, self.maybe = df, set(maybe) & set(df.columns)
        self.planner, self.keys, self.dealt = planner, set(keys) & set(df.columns), dealt

    def kept(self, df: DataFrame) -> _Rows:
        """Some of the rows, with the same columns or with more."""
        return _Rows(df, self.maybe, self.planner, self.keys, self.dealt)

    @property
    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != "_"]

    def without(self, name: str) -> _Rows:
        """The rows in which a variable is unbound, without its column."""
        return _Rows(self.df.where(F.col(f"`{name}`").isNull()).drop(name), self.maybe - {name})

    def certain(self, name: str) -> _Rows:
        return _Rows(self.df.where(F.col(f"`{name}`").isNotNull()), self.maybe - {name}, self.planner, self.keys, self.dealt)


def _union(parts: list[_Rows]) -> _Rows:
    names = list(dict.fromkeys(n for p in parts for n in p.names))
    maybe = {n for n in names if any(n not in p.names or n in p.maybe for p in parts)}
    cells = lambda p: p.df.select(*[F.col(f"`{n}`") if n in p.names else F.lit(None).cast(_CELL).alias(n) for n in names]) if names else p.df
    return _Rows(reduce(DataFrame.unionAll, map(cells, parts)), maybe)


def _dealt(a: _Rows, b: _Rows, common: list[str]) -> tuple[_Rows, _Rows]:
    """Both sides of a join. On a variable that is a key of both they are dealt to tasks by the number of quads; other joins, in which a value may have any number of rows, are left to Spark."""
    tasks = a.planner.tasks if a.planner and a.keys & b.keys & set(common) else 1
    if tasks < 2:
        return a, b
    by = (tasks, *common)
    deal = lambda r: r if r.dealt == by else _Rows(r.df.repartition(tasks, *[F.col(f"`{n}`") for n in common]), r.maybe, r.planner, r.keys, by)
    return deal(a), deal(b)


def _keys(a: _Rows, b: _Rows, common: list[str]) -> set[str]:
    """Keys of the join: those of a side of which each row meets few of the other."""
    return (a.keys if b.keys & set(common) else set()) | (b.keys if a.keys & set(common) else set())


def _join(a: _Rows | None, b: _Rows) -> _Rows:
    """Compatible rows of both. Rows in which a common variable is unbound join on the variables that are left."""
    if a is None:
        return b
    common = [n for n in a.names if n in b.names]
    for name in common:
        if name in a.maybe:
            return _union([_join(a.certain(name), b), _join(a.without(name), b)])
        if name in b.maybe:
            return _union([_join(a, b.certain(name)), _join(a, b.without(name))])
    if common:
        a, b = _dealt(a, b, common)
        return _Rows(a.df.drop("_").join(b.df.drop("_"), common), a.maybe | b.maybe, a.planner or b.planner, _keys(a, b, common), a.dealt if a.dealt == b.dealt else ())
    left, right = a.df.drop("_"), b.df.drop("_")
    if not left.columns or not right.columns:  # a pattern without variables only says whether, and how often
        left, right = a.df.withColumnRenamed("_", "_a"), b.df.withColumnRenamed("_", "_b")
    else:
        warnings.warn("the query is a product of patterns without a common variable", stacklevel=2)
    out = left.crossJoin(right).drop("_a", "_b")
    return _Rows(out if out.columns else out.withColumn("_", F.lit(True)), a.maybe | b.maybe)


def _optional(a: _Rows, b: _Rows) -> _Rows:
    """All rows of ``a``, with the compatible ones of ``b`` where there are any."""
    common = [n for n in a.names if n in b.names]
    for name in common:
        if name in a.maybe:
            return _union([_optional(a.certain(name), b), _optional(a.without(name), b)])
    fresh = [n for n in b.names if n not in common]
    if not b.maybe & set(common):
        a, b = _dealt(a, b, common)
    right = b.df.select(*[F.col(f"`{n}`").alias(f"_r {n}") for n in b.names])
    same = [(F.col(f"`{n}`") == F.col(f"`_r {n}`")) | (F.col(f"`_r {n}`").isNull() if n in b.maybe else F.lit(False)) for n in common]
    joined = a.df.join(right, reduce(lambda x, y: x & y, same) if same else F.lit(True), "left")
    kept = [F.col(f"`{n}`") for n in a.df.columns] + [F.col(f"`_r {n}`").alias(n) for n in fresh]
    return _Rows(joined.select(*kept), a.maybe | set(fresh), a.planner, a.keys & _keys(a, b, common), a.dealt if a.dealt == b.dealt else ())


def _minus(a: _Rows, b: _Rows) -> _Rows:
    """Rows of ``a`` without those that a row of ``b`` is compatible with and shares a bound variable with."""
    common = [n for n in a.names if n in b.names]
    if not common:
        return a
    for name in common:
        if name in a.maybe:
            return _union([_minus(a.certain(name), b), _minus(a.without(name), b)])
        if name in b.maybe:
            return _minus(_minus(a, b.certain(name)), b.without(name))
    a, b = _dealt(a, b, common)
    return a.kept(a.df.join(b.df.select(*[f"`{n}`" for n in common]).distinct(), common, "left_anti"))


class _Planner:
    def __init__(self, quads: DataFrame):
        self.quads = quads

    @cached_property
    def tasks(self) -> int:
        """Tasks that joins on subjects are dealt to."""
        return -(-self.quads.count() // _QUADS_A_TASK)

    def group(self, items: list, graph: tuple | None = None) -> _Rows:
        rows: _Rows | None = None
        rest = [x for x in items if x[0] != "filter"]
        while rest:
            size = next((k for k, x in enumerate(rest) if x[0] not in _JOINED), len(rest))
            for item in _connected(rest[:size], set(rows.names) if rows else set()):
                rows = _join(rows, self.item(item, graph))
            for item in rest[size : size + 1]:
                if rows is None:
                    rows = _Rows(self.quads.sparkSession.range(1).select(F.lit(True).alias("_")))
                if item[0] == "optional":
                    rows = _optional(rows, self.group(item[1], graph))
                elif item[0] == "minus":
                    rows = _minus(rows, self.group(item[1], graph))
                else:  # bind
                    if item[2] in rows.names:
                        raise Refused("evaluation", f"?{item[2]} is bound")
                    rows = _Rows(rows.df.withColumn(item[2], self.cell(item[1], rows.names)), rows.maybe | {item[2]})
            rest = rest[size + 1 :]
        if rows is None:
            raise Refused("evaluation", "an empty pattern")
        for item in items:  # filters hold for the whole group
            if item[0] == "filter":
                rows = rows.kept(rows.df.where(self.truth(item[1], rows.names)))
        return rows

    def item(self, item: tuple, graph: tuple | None) -> _Rows:
        if item[0] == "triple":
            return self.triple(item[1:], graph)
        if item[0] == "closure":
            return self.closure(*item[1:], graph)
        if item[0] == "graph":
            return self.group(item[2], item[1])
        if item[0] == "union":
            return _union([self.group(part, graph) for part in item[1]])
        if item[0] == "select":
            rows = solutions(self.quads, item[1], graph)
            return _Rows(rows.select(*[F.when(F.col(f"`{n}`").isNotNull(), _number_cell(F.col(f"`{n}`"))).alias(n) if not t.startswith("struct") else F.col(f"`{n}`") for n, t in rows.dtypes]), set(rows.columns))
        names, values = item[1], item[2]
        row = lambda r: F.struct(*[_constant(t).alias(n) for n, t in zip(names, r)])
        table = self.quads.sparkSession.range(1).select(F.explode(F.array(*map(row, values))).alias("r")).select("r.*") if values else self.quads.sparkSession.createDataFrame([], ", ".join(f"`{n}` {_CELL}" for n in names))
        return _Rows(table, {n for k, n in enumerate(names) if any(r[k] is None for r in values)})

    def closure(self, s: tuple, o: tuple, mark: str, inner: list, a: str, b: str, graph: tuple | None) -> _Rows:
        """Pairs of nodes that a path joins in one step (?) or any number of them (+, *); ? and * join each node with itself, too. Pairs count once."""
        if graph and graph[0] == "var":
            raise Refused("evaluation", "paths of any length in a graph that isn't named")
        edges = self.group(inner, graph).df.select(F.col(f"`{a}`").alias("src"), F.col(f"`{b}`").alias("dst")).distinct()
        fixed = [None if t[0] == "var" else _constant(t) for t in (s, o)]
        one = self.quads.sparkSession.range(1)
        if mark == "?":
            pairs = edges
        elif fixed[0] is None and fixed[1] is not None:  # walk back from the end
            pairs = closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), one.select(fixed[1].alias("src"))).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        else:
            pairs = closure(edges, one.select(fixed[0].alias("src")) if fixed[0] is not None else None)
        if mark != "+":
            rows = self.quads if graph is None else self.quads.where(F.col("g") == graph[1])
            nodes = rows.select(F.explode(F.array(_cell("s"), _cell("o"))).alias("n"))
            for end in fixed:
                if end is not None:
                    nodes = one.select(end.alias("n"))
            pairs = pairs.unionByName(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"))).distinct()
        for place, end in zip(("src", "dst"), fixed):
            if end is not None:
                pairs = pairs.where(F.col(place) == end)
        if s == o:
            pairs = pairs.where("src = dst")
        names = {t[1]: place for place, t in (("src", s), ("dst", o)) if t[0] == "var"}
        return _Rows(pairs.select(*[F.col(place).alias(n) for n, place in names.items()] or [F.lit(True).alias("_")]))

    def triple(self, terms: tuple, graph: tuple | None) -> _Rows:
        rows, out, seen = self.quads, [], {}
        parts = [("s", terms[0]), ("p", terms[1]), ("o", terms[2])] + ([("g", graph)] if graph else [])
        if graph:
            rows = rows.where("g is not null")
        for place, term in parts:
            if term[0] == "var":
                if term[1] in seen:
                    rows = rows.where(_cell(place) == _cell(seen[term[1]]))
                else:
                    seen[term[1]] = place
                    out.append(_cell(place).alias(term[1]))
            else:
                rows = rows.where(F.col(place) == term[1])
                if place == "o":
                    rows = rows.where(F.col("o_kind") == term[0])
                    if term[0] == "literal":
                        rows = rows.where(F.lower("o_lang") == term[3] if term[3] else F.col("o_lang").isNull() & (F.coalesce("o_datatype", F.lit(XSD + "string")) == term[2]))
                elif term[0] == "literal":
                    rows = rows.where(F.lit(False))
        return _Rows(rows.select(*out) if out else rows.select(F.lit(True).alias("_")), planner=self, keys={t[1] for t in terms[:1] if t[0] == "var"})

    def cell(self, e: tuple, columns: list[str]) -> Column:
        """An expression as a cell."""
        if e[0] == "var":
            return F.col(f"`{e[1]}`") if e[1] in columns else _constant(None)
        if e[0] in ("iri", "literal"):
            return _constant(e)
        if e[0] == "number" or e[:2] == ("call", "STRLEN"):
            return _number_cell(self.string(e, columns))
        value, typed = self.string(e, columns), e[:2] == ("call", "DATATYPE")
        return F.when(value.isNotNull(), F.struct(F.lit("iri" if typed else "literal").alias("type"), value.alias("value"), F.lit(None if typed else XSD + "string").cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")))

    def string(self, e: tuple, columns: list[str]) -> Column:
        if e[0] == "var":
            return F.col(f"`{e[1]}`")["value"] if e[1] in columns else F.lit(None).cast("string")
        if e[0] == "call" and e[1] == "STR":
            return self.string(e[2][0], columns)
        if e[0] == "call" and e[1] == "STRLEN":
            return F.length(self.string(e[2][0], columns))
        if e[0] == "call" and e[1] in ("DATATYPE", "LANG"):
            cell = self.cell(e[2][0], columns)
            return F.when(cell["type"] == "literal", F.coalesce(cell["datatype"], F.lit(XSD + "string")) if e[1] == "DATATYPE" else F.coalesce(cell["lang"], F.lit("")))
        if e[0] in ("iri", "literal", "number"):
            return F.lit(e[1])
        raise Refused("evaluation", f"expression {e[:2]}")

    def truth(self, e: tuple, columns: list[str]) -> Column:
        if e[0] in ("and", "or"):
            a, b = self.truth(e[1], columns), self.truth(e[2], columns)
            return a & b if e[0] == "and" else a | b
        if e[0] == "not":
            return ~self.truth(e[1], columns)
        if e[0] == "cmp":
            return _compared(e[1], self.cell(e[2], columns), self.cell(e[3], columns))
        if e[0] == "call":
            name, args = e[1], e[2]
            if name in ("STRENDS", "STRSTARTS", "CONTAINS"):
                a, b = (self.string(x, columns) for x in args)
                return {"STRENDS": F.endswith, "STRSTARTS": F.startswith, "CONTAINS": F.contains}[name](a, b)
            if name in ("ISLITERAL", "ISIRI"):
                return self.cell(args[0], columns)["type"] == ("literal" if name == "ISLITERAL" else "iri")
            if name == "BOUND":
                return F.col(f"`{args[0][1]}`").isNotNull() if args[0][1] in columns else F.lit(False)
        raise Refused("evaluation", f"expression {e[:2]}")


_NUMBERS = [XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")]
_TIMES = [XSD + t for t in ("date", "dateTime")]


def _compared(op: str, a: Column, b: Column) -> Column:
    """A comparison of two cells by what they are: numbers by value, whole ones exactly; times, truth values and plain texts each among themselves.

    Other terms are only equal or not, and two unlike literals that can't be compared are an error, as is an order of theirs; an error
    and an unbound variable give null.
    """
    by = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    literal = lambda c: c["type"] == "literal"
    kind = lambda c: F.when(literal(c), F.when(c["lang"].isNotNull(), "lang").otherwise(F.coalesce(c["datatype"], F.lit(XSD + "string"))))
    ka, kb = kind(a), kind(b)
    both = lambda kinds: ka.isin(kinds) & kb.isin(kinds)
    cast = lambda t: by(a["value"].try_cast(t), b["value"].try_cast(t))
    known = F.when(both(_NUMBERS), F.coalesce(F.when(a["value"].rlike(r"^[+-]?\d{1,38}$") & b["value"].rlike(r"^[+-]?\d{1,38}$"), cast("decimal(38,0)")), cast("double")))
    known = known.when(both(_TIMES) & (ka == kb), cast("timestamp")).when(both([XSD + "boolean"]), cast("boolean")).when(both([XSD + "string"]), by(a["value"], b["value"]))
    if op not in ("=", "!="):
        return known
    term = lambda c: F.struct(c["type"], c["value"], F.coalesce(kind(c), F.lit("")), F.lower(F.coalesce(c["lang"], F.lit(""))))
    same = F.when(a.isNotNull() & b.isNotNull(), F.when(term(a) == term(b), F.lit(op == "=")).when(~literal(a) | ~literal(b), F.lit(op == "!=")))
    return F.when(ka.isNotNull() & kb.isNotNull() & (both(_NUMBERS) | (both(_TIMES) & (ka == kb)) | both([XSD + "boolean"]) | both([XSD + "string"])), known).otherwise(same)


def _number_cell(number: Column) -> Column:
    return F.struct(F.lit("literal").alias("type"), number.cast("string").alias("value"), F.lit(XSD + "integer").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def solutions(quads: DataFrame, q: Query, graph: tuple | None = None) -> DataFrame:
    """The rows of a SELECT: cells by variable, counts as numbers."""
    planner = _Planner(quads)
    found = planner.group(q.where, graph)
    rows = found.df
    if q.counts or q.group:
        col = lambda v: F.col(f"`{v}`") if v in found.names else F.lit(None).cast(_CELL)
        what = lambda v, d: F.count("*") if v is None else F.count_distinct(col(v)) if d else F.count(col(v))
        rows = rows.groupBy(*[col(v).alias(v) for v in q.group or q.variables]).agg(*[what(v, d).alias(name) for v, d, name in q.counts] or [F.count("*").alias("_")])
        for condition in q.having:
            cells = rows.select(*[_number_cell(F.col(f"`{n}`")).alias(n) if n in {c[2] for c in q.counts} else F.col(f"`{n}`") for n in rows.columns])
            kept = planner.truth(condition, cells.columns)
            rows = cells.where(kept).select(*[F.col(f"`{n}`")["value"].cast("long").alias(n) if n in {c[2] for c in q.counts} else F.col(f"`{n}`") for n in rows.columns])
    names = [*q.variables, *(c[2] for c in q.counts)] or [c for c in rows.columns if c != "_" and not c.startswith(" ")]
    counted = {c[2] for c in q.counts}

    def ordered(df: DataFrame) -> DataFrame:
        keys = []
        for v, up in q.order:
            if v in df.columns:
                k = F.col(f"`{v}`") if v in counted else F.col(f"`{v}`")["value"]
                number = k.try_cast("double") if v not in counted else k
                keys += [number.asc_nulls_first() if up else number.desc_nulls_last(), k.asc_nulls_first() if up else k.desc_nulls_last()]
        # Rows with equal keys are dealt to tasks by what else they hold; else each value of a key would be one task.
        return df.orderBy(*keys, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])) if keys else df

    chosen = [F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast(_CELL).alias(n) for n in names]
    rows = ordered(rows.select(*chosen).distinct()) if q.distinct else ordered(rows).select(*chosen)
    return rows if q.limit is None else rows.limit(q.limit)


def run(quads: DataFrame, text: str) -> DataFrame:
    """Rows of cells {type, value, datatype, lang} by variable; ASK gives one row (result)."""
    q = parse(text)
    if q.form == "ask":
        return _Planner(quads).group(q.where).df.limit(1).agg((F.count("*") > 0).alias("result"))
    return solutions(quads, q)


def flat(rows: DataFrame) -> DataFrame:
    """Cells as plain values."""
    return rows.select(*[F.col(n)["value"].alias(n) if t.startswith("struct") else F.col(n) for n, t in rows.dtypes])


def probe(rows: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """(at most ``cap`` rows, whether there are more). Exactly ``cap`` rows are not cut. No more than ``cap`` + 1 rows reach the driver."""
    got = rows.limit(cap + 1).collect()
    return rows.sparkSession.createDataFrame(got[:cap], rows.schema), len(got) > cap


def probe_in_time(rows: DataFrame, cap: int, seconds: float) -> tuple[DataFrame, bool, bool]:
    """(rows, truncated, timed_out): as ``probe``, but the jobs are cancelled after so many seconds; then there are no rows."""
    spark = rows.sparkSession
    context, group, fired = spark.sparkContext, f"probe-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        fired.set()
        while not done.wait(0.05):  # a job that starts later is cancelled too
            context.cancelJobGroup(group)

    done, timer = threading.Event(), threading.Timer(seconds, stop)
    context.setJobGroup(group, "a query with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        some, cut = probe(rows, cap)
        return some, cut, False
    except Exception:
        if not fired.is_set():
            raise
        return spark.createDataFrame([], rows.schema), False, True
    finally:
        done.set()
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
