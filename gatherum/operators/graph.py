"""Graphs as tables of quads: writing, checking, counting, and comparing them.

quad(g, s, p, o, o_kind, o_datatype, o_lang); o_kind is iri, blank or literal, a null g is the default graph.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gatherum.sources.scratch import own_shuffles, remove, shared_path

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_FIELDS = ("g", "s", "p", "o", "o_kind", "o_datatype", "o_lang")
_DATATYPES = {"string": "string", "bigint": "integer", "int": "integer", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime"}


def to_quads(df: DataFrame, graph: str, subject: Column, kind: str, slots: dict[str, str], links: dict[str, Column] | None = None) -> DataFrame:
    """One type quad per row and one quad per slot with a value.

    ``slots``: predicate to column, as literals of the column's type; ``links``: predicate to an expression, as IRIs.
    """
    types = dict(df.dtypes)
    cell = lambda p, o, k, d: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_kind"), F.lit(d).cast("string").alias("o_datatype"))
    cells = [cell(RDF_TYPE, F.lit(kind), "iri", None)]
    cells += [cell(p, F.col(c), "literal", XSD + _DATATYPES[types[c]]) for p, c in slots.items()]
    cells += [cell(p, e, "iri", None) for p, e in (links or {}).items()]
    rows = df.select(F.lit(graph).alias("g"), subject.alias("s"), F.explode(F.array(*cells)).alias("x")).where("x.o is not null")
    return rows.select("g", "s", "x.p", "x.o", "x.o_kind", "x.o_datatype", F.lit(None).cast("string").alias("o_lang"))


def to_nquads(quads: DataFrame) -> DataFrame:
    """One line of N-Quads per quad (column ``value``)."""
    escaped = F.col("o")
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(safe))
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull() & (F.col("o_datatype") != XSD + "string"), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escaped, F.lit('"'), tail)).otherwise(node(F.col("o")))
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), node(F.col("g")))).otherwise("")
    return quads.select(F.concat(node(F.col("s")), F.lit(" "), node(F.col("p")), F.lit(" "), o, g, F.lit(" .")).alias("value"))


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*$'


def from_nquads(lines: DataFrame) -> DataFrame:
    """Quads of N-Quads lines (column ``value``), and ``bad`` for lines that are none; empty lines and comments go."""
    part = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    name = lambda c: F.regexp_replace(c, r"^<(.*)>$", "$1")
    bare = F.regexp_extract("value", _LINE, 5)
    hold = F.replace(bare, F.lit("\\\\"), F.lit("\u0000"))
    for safe, raw in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\u0000", "\\")):
        hold = F.replace(hold, F.lit(safe), F.lit(raw))
    literal = part(3).isNull() & part(4).isNull()
    rows = lines.where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    return rows.select(
        name(part(8)).alias("g"), name(part(1)).alias("s"), part(2).alias("p"), F.coalesce(part(3), part(4), hold).alias("o"),
        F.when(part(3).isNotNull(), "iri").when(part(4).isNotNull(), "blank").otherwise("literal").alias("o_kind"),
        F.when(literal & part(6).isNull(), F.coalesce(part(7), F.lit(XSD + "string"))).alias("o_datatype"), part(6).alias("o_lang"), (~F.col("value").rlike(_LINE)).alias("bad"),
    )


def _triple() -> Column:
    return F.struct("s", "p", "o", "o_kind", F.coalesce("o_datatype", F.lit("")), F.coalesce("o_lang", F.lit("")))


def summary(quads: DataFrame) -> DataFrame:
    """One row: statements, distinct triples, subjects, named graphs."""
    distinct = quads.select("s", "p", "o", "o_kind", "o_datatype", "o_lang").distinct().agg(F.count("*").alias("triples"))
    return quads.agg(F.count("*").alias("statements"), F.count_distinct("s").alias("subjects"), F.count_distinct("g").alias("graphs")).join(F.broadcast(distinct))  # one row each


def reconcile(counted: DataFrame, recorded: DataFrame, key: str, n: str) -> DataFrame:
    """Differences between a count of files and a manifest: rows of one side only, or with unequal counts."""
    a, b = counted.select(key, F.col(n).alias("counted")), recorded.select(key, F.col(n).alias("recorded"))
    return a.join(b, key, "full_outer").where(~F.col("counted").eqNullSafe(F.col("recorded"))).withColumn("state", F.when(F.col("recorded").isNull(), "not_recorded").when(F.col("counted").isNull(), "not_found").otherwise("different"))


def stored(df: DataFrame, label: str = "quads") -> DataFrame:
    """Written to the shared folder and read back."""
    path = shared_path(df.sparkSession, label)
    with own_shuffles(df.sparkSession):
        df.write.parquet(path)
    return _over(df.sparkSession.read.schema(df.schema).parquet(path), path)


def _over(df: DataFrame, *paths: str) -> DataFrame:
    """Marks a table as one that reads these folders."""
    df._scratch = paths
    return df


def discard(*tables: DataFrame) -> None:
    """Delete what tables of ``stored``, ``connected_parts`` and ``statements`` read and nothing will read again."""
    for df in tables:
        for path in df._scratch:
            remove(df.sparkSession, path)


def closure(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, dst), each pair once: nodes that one step or more of ``edges`` (src, dst) lead to; from the nodes of ``start`` (src) only, if given.

    Semi-naive: a round joins only the pairs that are new since the last, and ends the search when there are none, so cycles end
    too. From fixed starts a round adds one step; between all nodes new pairs are joined with all known ones on both sides,
    so the lengths double and there are as many rounds as the longest path has binary digits.
    """
    edges = stored(edges.select("src", "dst").distinct(), "closure-edges")
    known = edges if start is None else stored(edges.join(start.select("src").distinct(), "src", "left_semi"), "closure-pairs")
    fresh = known
    step = lambda a, b: a.select("src", F.col("dst").alias("mid")).join(b.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
    while True:
        longer = step(fresh, edges) if start is not None else step(fresh, known).unionByName(step(known, fresh))
        fresh = stored(longer.distinct().join(known, ["src", "dst"], "left_anti"), "closure-new")
        if fresh.isEmpty():
            return known
        known = stored(known.unionByName(fresh), "closure-pairs")


def connected_parts(links: DataFrame) -> DataFrame:
    """(node, part) of nodes in links (src, dst), in any direction; ``part`` is the smallest node that can be reached.

    Each round every node takes the smallest part among its neighbours, and then the part of that part, so long chains shorten quickly.
    """
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = stored(both, "parts-links")
    parts = stored(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("part")).withColumnRenamed("src", "node"), "parts")
    while True:  # a round's table goes once the next one is there
        near = both.join(parts.select(F.col("node").alias("dst"), "part"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("part").alias("near"))
        moved = parts.join(near, "node").select("node", F.col("part").alias("was"), F.least("part", "near").alias("part"))
        jump = moved.select(F.col("node").alias("part"), F.col("part").alias("next"))
        after = stored(moved.join(jump, "part").select("node", F.least("part", "next").alias("part"), (F.least("part", "next") < F.col("was")).alias("moved")), "parts")
        discard(parts)
        parts = _over(after.drop("moved"), *after._scratch)
        if after.where("moved").isEmpty():
            discard(both)
            return parts


#: Blank nodes of one connected part that are named within one task; larger parts are refused unless what each states tells all apart.
PART_NODES = 20_000
#: Quads to a task in which nodes are gathered. Quads pack well, so the size of a shuffle says little about the memory that its rows take.
QUADS_A_TASK = 500_000
#: Blank nodes of one part that may be told apart by expressions, if what each states differs from node to node; parts with nodes alike, or larger, are searched in Python.
SMALL_PART = 32
#: Individualisations that one part may take before it is refused.
MOST_TRIES = 2_000


class NotNamed(ValueError):
    """A part of the graph that the bounds don't suffice for."""


def _digest(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def canonical_form(nodes: dict[str, str], links: list[tuple[str, str, str]], most: int = MOST_TRIES) -> tuple[str, list[str]]:
    """(form, nodes in canonical order) of a part: ``nodes`` by what they state in terms that aren't blank, links (node, predicate, node).

    Colours are refined by those of the neighbours until their number stays; of nodes that still look alike one after the other is
    singled out, and the smallest form counts. Forms are equal just for isomorphic parts. A node that looks like one tried before and
    swaps with it in a refined colouring of one form needs no try of its own, which keeps rings and stars cheap.
    """
    out: dict[str, list] = {n: [] for n in nodes}
    into: dict[str, list] = {n: [] for n in nodes}
    for s, p, o in links:
        out[s].append((p, o))
        into[o].append((p, s))
    tries = 0

    def refined(colour: dict[str, str]) -> dict[str, str]:
        kinds = len(set(colour.values()))
        while True:
            colour = {n: _digest(c, *sorted(f"{p}>{colour[o]}" for p, o in out[n]), "|", *sorted(f"{p}<{colour[s]}" for p, s in into[n])) for n, c in colour.items()}
            now = len(set(colour.values()))
            if now == kinds:
                return colour
            kinds = now

    def solved(colour: dict[str, str]) -> tuple[str, list[str]]:
        nonlocal tries
        groups: dict[str, list[str]] = {}
        for n, c in colour.items():
            groups.setdefault(c, []).append(n)
        tied = min((c for c, g in groups.items() if len(g) > 1), key=lambda c: (len(groups[c]), c), default=None)
        if tied is None:
            order = sorted(colour, key=colour.__getitem__)
            at = {n: k for k, n in enumerate(order)}
            return _digest(*[nodes[n] for n in order], *sorted(f"{at[s]:09d} {p} {at[o]:09d}" for s, p, o in links)), order
        best: tuple[str, list[str]] | None = None
        alike: set[str] = set()
        for n in groups[tied]:
            if n in alike:
                continue
            tries += 1
            if tries > most:
                raise NotNamed(f"over {most} tries for a part of {len(nodes)} blank nodes")
            found = solved(refined({**colour, n: _digest(colour[n], "singled out")}))
            if best is None or found[0] < best[0]:
                best, alike = found, {n}
            if found[0] == best[0]:  # an automorphism: what it maps onto nodes that were tried need not be tried
                step = dict(zip(best[1], found[1]))
                grown = True
                while grown:
                    grown = {m for m in map(step.get, alike) if colour[m] == tied} - alike
                    alike |= grown
        return best

    return solved(refined(dict(nodes)))


def _named_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, form, node, place) of rows (part, s, own, links) that are sorted by part. No more than a batch and one part are held."""

    def named(parts: list[list[dict]]) -> pa.RecordBatch:
        out = []
        for rows in parts:
            links = [(r["s"], link["said"], link["o"]) for r in rows for link in r["links"]]
            form, order = canonical_form({r["s"]: r["own"] for r in rows}, links)
            out += [(rows[0]["part"], form, node, place) for place, node in enumerate(order)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["part", "form", "node", "place"])

    held: list[dict] = []
    for batch in batches:
        parts = [list(g) for _, g in groupby(held + batch.to_pylist(), key=lambda r: r["part"])]
        held = parts.pop() if parts else []
        yield named(parts)
    if held:
        yield named([held])


def _bag(texts: Column) -> Column:
    """One text of a list of texts, whatever their order; different lists give different ones."""
    return F.array_join(F.sort_array(F.transform(texts, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x))), "")


def _short(text: Column) -> Column:
    """Texts that are shorter than a digest stay, as they pack better; others are digested."""
    return F.when(F.length(text) <= 100, text).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def _blank_nodes(quads: DataFrame, tasks: int, gather=F.collect_list) -> DataFrame:
    """(s, own, links, into) of the blank nodes: what a node states and is said of in terms that aren't blank, links to blank nodes (o, said) and from them.

    All of it is gathered in one shuffle.
    """
    graph = F.coalesce("g", F.lit(""))
    terms = F.concat_ws("|", "o_kind", "o", F.coalesce("o_datatype", F.lit("")), F.coalesce("o_lang", F.lit("")), graph)
    from_blank, to_blank = F.col("s").startswith("_:"), F.col("o_kind") == "blank"
    none = F.lit(None).cast("string")
    fact = lambda node, way, said, o=none: F.struct(F.col(node).alias("s"), F.struct(F.lit(way).alias("way"), said.alias("said"), o.alias("o")).alias("x"))
    facts = F.array(
        F.when(from_blank, F.when(to_blank, fact("s", "to", F.concat_ws(" ", "p", graph), F.col("o"))).otherwise(fact("s", "states", F.concat_ws(" ", "p", terms)))),
        F.when(to_blank, F.when(from_blank, fact("o", "from", F.concat_ws(" ", "p", graph), F.col("s"))).otherwise(fact("o", "of", F.concat_ws(" ", "s", "p", graph)))),
    )
    each = quads.where(from_blank | to_blank).select(F.explode(facts).alias("f")).where("f is not null").select("f.*")
    some = lambda way: F.filter("facts", lambda x: x["way"] == way)
    said = lambda way: F.transform(some(way), lambda x: x["said"])
    ends = lambda way: F.transform(some(way), lambda x: F.struct(x["o"].alias("o"), x["said"].alias("said")))
    own = _short(F.concat(_bag(said("states")), F.lit("of"), _bag(said("of"))))
    return each.repartition(tasks, "s").groupBy("s").agg(gather("x").alias("facts")).select("s", own.alias("own"), ends("to").alias("links"), ends("from").alias("into"))


def _folded(nodes: DataFrame, tasks: int) -> DataFrame:
    """(form, s, own, links): blank nodes that one link leads to and none from are made a part of what the node before them states.

    A node that has no links left is a part by itself and only its ``form`` is given; the others have no form yet.
    """
    leaf = (F.size("links") == 0) & (F.size("into") == 1)
    before = F.get("into", F.lit(0))
    sent = nodes.select(
        F.when(leaf, before["o"]).otherwise(F.col("s")).alias("s"), F.when(leaf, F.struct(F.col("s").alias("o"), before["said"].alias("said"), "own")).alias("leaf"),
        F.when(~leaf, F.struct("own", "links", (F.size("into") > 0).alias("held"))).alias("node"),
    )
    rows = sent.repartition(tasks, "s").groupBy("s").agg(F.collect_list("leaf").alias("leaves"), F.first("node", ignorenulls=True).alias("node"))
    rows = rows.select("s", "leaves", "node.own", "node.links", "node.held")
    name = lambda x: F.concat_ws("\x1f", x["o"], x["said"])
    part = lambda x, k: F.get(F.split(x, "\x1f"), F.lit(k))
    kept = F.transform(F.array_except(F.transform("links", name), F.transform("leaves", name)), lambda x: F.struct(part(x, 0).alias("o"), part(x, 1).alias("said")))
    links = F.when(F.size("leaves") == 0, F.col("links")).when(F.size("leaves") == F.size("links"), F.slice("links", 1, 0)).otherwise(kept)
    own = F.concat(F.col("own"), F.lit("with"), _bag(F.transform("leaves", lambda x: F.concat(F.length(x["said"]).cast("string"), F.lit(":"), x["said"], x["own"]))))
    rows = rows.select("s", own.alias("own"), links.alias("links"), "held")
    alone = (F.size("links") == 0) & ~F.col("held")
    return rows.select(F.when(alone, F.unhex(F.sha2(F.concat(F.lit("alone "), "own"), 256))).alias("form"), *[F.when(~alone, F.col(c)).alias(c) for c in ("s", "own", "links")])


def _blank_forms(nodes: DataFrame, most: int) -> DataFrame:
    """(part, form, node, place) of blank nodes (s, own, links): the form of the part that a node is in, equal just for isomorphic parts, and its place there.

    Where what they state tells all nodes of a small part apart, their order needs no search.
    """
    parts = connected_parts(nodes.select(F.col("s").alias("src"), F.explode("links.o").alias("dst")))
    rows = nodes.join(parts.withColumnRenamed("node", "s"), "s", "left").select(F.coalesce("part", "s").alias("part"), "s", F.sha2("own", 256).alias("own"), "links")
    rows = stored(rows, "blank-nodes")
    discard(parts)
    largest = rows.groupBy("part").count().agg(F.max("count")).first()[0]
    if largest is not None and largest > most:
        raise NotNamed(f"a part of {largest} blank nodes; {most} at most are named")
    whole = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("own", "s", "links"))).alias("nodes"))
    apart = F.when(F.size("nodes") <= SMALL_PART, F.size(F.array_distinct("nodes.own")) == F.size("nodes")).otherwise(False)
    whole = stored(whole.withColumn("apart", apart), "blank-parts")
    discard(rows)
    own_of = lambda s: F.get(F.filter("nodes", lambda n: n["s"] == s), F.lit(0))["own"]
    said = F.sort_array(F.flatten(F.transform("nodes", lambda n: F.transform(n["links"], lambda x: F.concat_ws(" ", n["own"], x["said"], own_of(x["o"]))))))
    form = F.sha2(F.concat_ws("\n", F.lit("apart"), "nodes.own", said), 256)
    easy = whole.where("apart").select("part", form.alias("form"), F.posexplode("nodes.s").alias("place", "node")).select("part", "form", "node", "place")
    hard = whole.where("not apart").select("part", F.explode("nodes").alias("n")).select("part", "n.s", "n.own", "n.links")
    searched = hard.repartition("part").sortWithinPartitions("part").mapInArrow(_named_parts, "part string, form string, node string, place int")
    return _over(easy.unionByName(searched), *whole._scratch)


def _tasks(quads: DataFrame) -> int:
    return max(1, -(-quads.count() // QUADS_A_TASK))


def canonical_blanks(quads: DataFrame, most: int = PART_NODES) -> DataFrame:
    """Quads whose blank nodes are named by what they state: two graphs are isomorphic if and only if these quads are the same bag.

    Blank nodes that name each other form a part. Parts of up to ``most`` nodes get a canonical form, each in a task of its own; nodes
    of parts with one form are told apart by a number of the copy, in any order, as such parts can be swapped. A part that is larger,
    or whose nodes look so much alike that the search would take too long, raises ``NotNamed``; nothing is named by guess.
    """
    nodes = stored(_blank_nodes(quads, _tasks(quads)), "blank-links")
    found = _blank_forms(nodes, most)
    forms = stored(found, "blank-forms")
    discard(nodes, found)
    copies = forms.where("place = 0").select("part", F.row_number().over(Window.partitionBy("form").orderBy("part")).alias("copy"))
    lookup = forms.join(copies, "part").select(F.col("node").alias("s"), F.concat(F.lit("_:"), F.sha2(F.concat_ws(" ", "form", "copy", "place").cast("binary"), 256)).alias("n"))
    out = quads.join(lookup.withColumnsRenamed({"s": "_s", "n": "_sn"}), F.col("s") == F.col("_s"), "left")
    out = out.join(lookup.withColumnsRenamed({"s": "_o", "n": "_on"}), (F.col("o_kind") == "blank") & (F.col("o") == F.col("_o")), "left")
    return out.select("g", F.coalesce("_sn", "s").alias("s"), "p", F.coalesce("_on", "o").alias("o"), "o_kind", "o_datatype", "o_lang")


#: Hex digits of a row's digest that are summed together: sums of 28 bits fit a long for 68 billion rows.
_SUMMED = 7


def bag_digest(df: DataFrame) -> DataFrame:
    """One row: how many rows a table of texts has, and sums of the pieces of their SHA-256, which are equal just for equal bags as far as digests tell. Nothing but sums is shuffled."""
    text = F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in df.columns])
    piece = lambda k: F.conv(F.substring("h", 1 + k, _SUMMED), 16, 10).cast("long")
    return df.select(F.sha2(text, 256).alias("h")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(piece(k)), F.lit(0)).alias(f"sum_{k}") for k in range(0, 64 - _SUMMED + 1, _SUMMED)])


def same_digests(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two rows of ``bag_digest`` are of the same bag."""
    return a.unionByName(b).agg((F.count_distinct(*a.columns) == 1).alias("isomorphic"))


def same_quads(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables of quads are the same bag; for graphs with blank nodes, of their canonical quads or their statements."""
    return same_digests(bag_digest(a), bag_digest(b.select(*a.columns)))


def statements(quads: DataFrame, most: int = PART_NODES) -> DataFrame:
    """Quads without blank nodes, and a row (its form as s, p null) for each part of blank nodes: two graphs are isomorphic if and only if these rows are the same bag. A quad that is there twice counts once.

    A form holds all quads that name a node of its part, so nothing has to be renamed and joined. Ends of trees are folded into the nodes before
    them; nodes that have no links then are parts by themselves. Only the others are searched for parts, within the bounds of ``canonical_blanks``.
    """
    ground = quads.where(~F.col("s").startswith("_:") & (F.col("o_kind") != "blank")).select(*_FIELDS).distinct()
    tasks = _tasks(quads)
    folded = stored(_folded(_blank_nodes(quads, tasks, F.collect_set), tasks), "blank-folded")
    forms, read = folded.where("form is not null").select("form"), folded._scratch
    linked = folded.where("form is null").select("s", "own", "links")
    if not linked.isEmpty():
        found = _blank_forms(linked, most)
        rest = stored(found.where("place = 0").select(F.unhex("form").alias("form")), "blank-forms")
        discard(found)
        forms, read = forms.unionByName(rest), read + rest._scratch
    none = F.lit(None).cast("string")
    return _over(ground.unionByName(forms.select(F.concat(F.lit("_:"), F.lower(F.hex("form"))).alias("s"), *[none.alias(c) for c in _FIELDS if c != "s"])), *read)


def graph_digest(quads: DataFrame, most: int = PART_NODES) -> DataFrame:
    """One row, the same just for isomorphic graphs: ``bag_digest`` of a graph's statements. Nothing else that was written on the way is kept."""
    found = statements(quads, most)
    out = stored(bag_digest(found), "graph-digest")
    discard(found)
    return out


def isomorphic(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two graphs are the same but for the names of blank nodes."""
    return same_digests(graph_digest(a), graph_digest(b))


def missing_leaves(leaves: DataFrame, quads: DataFrame, subject: str, predicate: str, value: str) -> DataFrame:
    """Values of an instance that the graph doesn't state."""
    said = quads.where("o_kind = 'literal'").select(F.col("s").alias(subject), F.col("p").alias(predicate), F.col("o").alias(value)).distinct()
    return leaves.join(said, [subject, predicate, value], "left_anti")


def missing_slots(df: DataFrame, item: str, required: list[str], gaps: DataFrame | None = None) -> DataFrame:
    """(item, slot) of required slots without a value; ``gaps`` (item, slot) are recorded and allowed."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("slot"), (F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias("missing")) for c in required])).alias("x")
    found = df.select(item, cells).where("x.missing").select(item, "x.slot")
    return found if gaps is None else found.join(gaps.select(item, "slot"), [item, "slot"], "left_anti")


def span_violations(claims: DataFrame, texts: DataFrame, doc: str, start: str, stop: str, value: str, text: str) -> DataFrame:
    """Claims whose value isn't what their span of the text holds: (claim's columns, reason)."""
    joined = claims.join(texts.select(doc, F.col(text).alias("_text")), doc, "left")
    held = F.substr("_text", F.col(start).cast("int") + 1, (F.col(stop) - F.col(start)).cast("int"))
    reason = F.when(F.col("_text").isNull(), "no_text").when((F.col(start) < 0) | (F.col(stop) > F.length("_text")) | (F.col(start) >= F.col(stop)), "bad_span").when(held != F.col(value), "other_text")
    return joined.withColumn("reason", reason).where("reason is not null").drop("_text")


def probability_violations(labels: DataFrame, p: str, status: str) -> DataFrame:
    """Labels whose probability is out of bounds or doesn't fit their status (certain: 0.9 or more; none below the floor of 0.5)."""
    reason = F.when(F.col(p).isNull(), "no_probability").when((F.col(p) < 0.005) | (F.col(p) > 0.995), "out_of_bounds").when((F.col(status) == "certain") & (F.col(p) < 0.9), "not_certain").when(F.col(p) < 0.5, "below_floor")
    return labels.withColumn("reason", reason).where("reason is not null")
