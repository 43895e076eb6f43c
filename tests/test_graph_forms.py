"""Isomorphism of graphs with rings and deep chains, closure of paths, comparisons by type."""

import itertools
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gatherum.operators import graph as G
from gatherum.plans import sparql

SCHEMA = "g string, s string, p string, o string, o_kind string, o_datatype string, o_lang string"


def graph(spark, links, facts=()):
    rows = [(None, f"_:{a}", "p", f"_:{b}", "blank", None, None) for a, b in links] + [(None, f"_:{a}", "v", str(v), "literal", None, None) for a, v in facts]
    return spark.createDataFrame(rows, SCHEMA)


def ring(*names):
    return list(zip(names, names[1:] + names[:1]))


def test_rings_aren_t_all_alike(spark):
    six, three = ring(*"abcdef"), ring(*"abc") + ring(*"xyz")
    same = lambda x, y: G.isomorphic(x, y).first()[0]
    assert not same(graph(spark, six), graph(spark, three))
    assert same(graph(spark, three), graph(spark, ring(*"pqr") + ring(*"uvw")))
    assert same(graph(spark, six), graph(spark, ring(*"fcadbe")))
    assert not same(graph(spark, six, [("a", 1)]), graph(spark, six))
    assert same(graph(spark, six, [("a", 1), ("d", 1)]), graph(spark, ring(*"uvwxyz"), [("v", 1), ("y", 1)]))
    assert not same(graph(spark, six, [("a", 1), ("d", 1)]), graph(spark, ring(*"uvwxyz"), [("v", 1), ("x", 1)]))


def test_a_chain_of_fifty(spark):
    chain = lambda tag, end: graph(spark, [(f"{tag}{k}", f"{tag}{k + 1}") for k in range(50)], [(f"{tag}50", end)])
    assert G.isomorphic(chain("a", 1), chain("b", 1)).first()[0] and not G.isomorphic(chain("a", 1), chain("b", 2)).first()[0]


def test_forms_are_those_of_exhaustive_search():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(2, 6)
        links = [(str(rng.randrange(n)), rng.choice("pq"), str(rng.randrange(n))) for _ in range(rng.randrange(1, 9))]
        nodes = {str(k): rng.choice("xy") for k in range(n)}
        other = links[:-1] + [(links[-1][2], links[-1][1], links[-1][0])] if rng.random() < 0.5 else links
        moved = dict(zip(nodes, rng.sample(sorted(nodes), n)))
        theirs = ({moved[k]: v for k, v in nodes.items()}, [(moved[a], p, moved[b]) for a, p, b in other])
        truth = any(
            all(theirs[0][m[k]] == nodes[k] for k in nodes) and sorted((m[a], p, m[b]) for a, p, b in links) == sorted(theirs[1])
            for m in (dict(zip(nodes, order)) for order in itertools.permutations(nodes))
        )
        assert (G.canonical_form(nodes, links)[0] == G.canonical_form(*theirs)[0]) == truth


def test_too_much_alike_is_refused(spark):
    with pytest.raises(G.NotNamed):
        G.canonical_blanks(graph(spark, ring(*map(str, range(12)))), most=10)
    nodes = [f"{k:02d}" for k in range(40)]
    with pytest.raises(G.NotNamed):
        G.canonical_form(dict.fromkeys(nodes, ""), [(a, "p", b) for a, b in zip(nodes, nodes[1:] + nodes[:1])] + [(b, "p", a) for a, b in zip(nodes, nodes[1:] + nodes[:1])], most=1)


def test_closure_of_a_tree_a_cycle_and_from_starts(spark):
    edges = [(k // 3, k) for k in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (102, 103)]
    reach = {(a, b) for a, b in edges}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if more == reach:
            break
        reach = more
    df = spark.createDataFrame(edges * 2, "src int, dst int")
    got = [tuple(r) for r in G.closure(df).collect()]
    assert set(got) == reach and len(got) == len(reach)
    some = [tuple(r) for r in G.closure(df, spark.createDataFrame([(1,), (101,), (7777,)], "src int")).collect()]
    assert sorted(some) == sorted(p for p in reach if p[0] in (1, 101))
    assert G.closure(df.limit(0)).count() == 0


def quads_of(spark, triples):
    kind = lambda o: ("iri", None) if isinstance(o, str) and o.startswith("u:") else ("literal", G.XSD + {int: "integer", float: "double", bool: "boolean"}.get(type(o), "string"))
    return spark.createDataFrame([(None, s, p, str(o).lower() if isinstance(o, bool) else str(o), *kind(o), None) for s, p, o in triples], SCHEMA)


def ask(q, text):
    return sorted(tuple(r) for r in sparql.flat(sparql.run(q, text)).collect())


def test_paths_of_any_length(spark):
    q = quads_of(spark, [("u:a", "u:p", "u:b"), ("u:b", "u:p", "u:c"), ("u:c", "u:p", "u:a"), ("u:c", "u:q", "u:d"), ("u:d", "u:n", "end")])
    assert ask(q, "SELECT ?x WHERE { <u:a> <u:p>+ ?x }") == [("u:a",), ("u:b",), ("u:c",)]
    assert ask(q, "SELECT ?x WHERE { ?x <u:p>*/<u:q> <u:d> }") == [("u:a",), ("u:b",), ("u:c",)]
    assert ask(q, "SELECT ?x WHERE { ?x (<u:p>|<u:q>)+ <u:d> }") == [("u:a",), ("u:b",), ("u:c",)]
    assert ask(q, "SELECT ?x WHERE { <u:b> <u:p>? ?x }") == [("u:b",), ("u:c",)]
    assert ask(q, "SELECT ?x WHERE { <u:zz> <u:p>* ?x }") == [("u:zz",)]
    assert ask(q, "SELECT ?x ?y WHERE { ?x <u:q>* ?y FILTER(?x != ?y) }") == [("u:c", "u:d")]
    assert ask(q, "SELECT ?x WHERE { ?x <u:p>+ ?x }") == [("u:a",), ("u:b",), ("u:c",)]
    assert ask(q, "SELECT ?n WHERE { <u:a> (<u:p>/<u:p>)*/<u:q>/<u:n> ?n }") == [("end",)]
    with pytest.raises(sparql.Refused):
        sparql.run(q, "SELECT ?x WHERE { GRAPH ?g { <u:a> <u:p>+ ?x } }")


def test_comparisons_by_type(spark):
    q = quads_of(spark, [("u:a", "u:x", 10), ("u:a", "u:y", 9), ("u:b", "u:x", 2), ("u:b", "u:y", 2.0), ("u:c", "u:x", "u:k"), ("u:c", "u:y", "k"), ("u:d", "u:x", "10"), ("u:d", "u:y", "9"), ("u:e", "u:x", "7"), ("u:e", "u:y", 7), ("u:f", "u:x", True), ("u:f", "u:y", False), ("u:g", "u:x", 9007199254740993), ("u:g", "u:y", 9007199254740992)])
    some = lambda op: [r[0][2:] for r in ask(q, f"SELECT ?s WHERE {{ ?s <u:x> ?x ; <u:y> ?y FILTER(?x {op} ?y) }}")]
    assert some("<") == ["d"] and some(">") == ["a", "f", "g"] and some("=") == ["b"] and some("!=") == ["a", "c", "d", "f", "g"]
    assert some("<=") == ["b", "d"] and some(">=") == ["a", "b", "f", "g"]
    same = quads_of(spark, [("u:a", "u:x", "u:k"), ("u:a", "u:y", "u:k"), ("u:b", "u:x", "u:k"), ("u:b", "u:y", "u:l")])
    assert ask(same, "SELECT ?s WHERE { ?s <u:x> ?x ; <u:y> ?y FILTER(?x = ?y) }") == [("u:a",)]
    assert ask(same, "SELECT ?s WHERE { ?s <u:x> ?x OPTIONAL { ?s <u:z> ?z } FILTER(!(?x = ?z)) }") == []


def test_parts_whose_nodes_differ_are_told_by_what_they_state(spark):
    """Neither a search nor a renaming of the quads; forms tell where a value stands and how often a tree occurs."""
    tree = lambda tag, values: [(None, f"_:{tag}{k}", "has", f"_:{tag}c{k}", "blank", None, None) for k in range(len(values))] + [(None, f"_:{tag}{n}{k}", n + "v", v, "literal", None, None) for k, pair in enumerate(values) for n, v in zip(("", "c"), pair)]
    graph_of = lambda tag, values: spark.createDataFrame(tree(tag, values), "g string, s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    base = graph_of("a", [("1", "2"), ("1", "2"), ("3", "4")])
    for values, same in (([("3", "4"), ("1", "2"), ("1", "2")], True), ([("3", "4"), ("3", "4"), ("1", "2")], False), ([("1", "4"), ("1", "2"), ("3", "2")], False)):
        found = G.same_quads(G.statements(base), G.statements(graph_of("b", values)))
        assert found.first()[0] == same and "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert G.same_quads(G.canonical_blanks(base), G.canonical_blanks(graph_of("b", values))).first()[0] == same


def test_a_comparison_leaves_two_rows_and_searches_no_trees(spark, tmp_path, monkeypatch):
    """Ends of trees are folded into the nodes before them, and what was written on the way is gone at the end."""
    monkeypatch.setattr(G, "shared_path", lambda _, label: f"{tmp_path}/{label}-{uuid.uuid4().hex}")
    tree = lambda tag, n: graph(spark, [(f"{tag}{k}", f"{tag}{k}c") for k in range(n)], [(f"{tag}{k}c", k) for k in range(n)])
    with monkeypatch.context() as m:
        m.setattr(G, "connected_parts", None)
        assert G.isomorphic(tree("a", 9), tree("b", 9)).first()[0] and not G.isomorphic(tree("a", 9), tree("b", 8)).first()[0]
    assert len(list(tmp_path.iterdir())) == 4 and all(p.name.startswith("graph-digest") for p in tmp_path.iterdir())
    assert G.isomorphic(graph(spark, ring(*"abc")), graph(spark, ring(*"xyz"))).first()[0]
    assert len(list(tmp_path.iterdir())) == 6 and all(p.name.startswith("graph-digest") for p in tmp_path.iterdir())


def test_folded_forms_are_those_of_exhaustive_search(spark):
    """Small connected graphs with loops, shared ends, two links between nodes and quads that are there twice: as many forms, each as often, as there are classes."""
    rng = random.Random(7)
    triples, classes, key = [], Counter(), itertools.count()
    while len(classes) < 120:
        n = rng.randrange(1, 5)
        links = {(rng.randrange(k), rng.choice("pq"), k)[:: rng.choice((1, -1))] for k in range(1, n)} | {(rng.randrange(n), rng.choice("pq"), rng.randrange(n)) for _ in range(rng.choice((0, 0, 1, 2)))}
        facts = {(rng.randrange(n), rng.choice("12")) for _ in range(rng.randrange(0, n + 2))}
        if not links and not facts:
            continue
        classes[min((sorted((m[a], p, m[b]) for a, p, b in links), sorted((m[a], v) for a, v in facts)).__repr__() + str(n) for m in itertools.permutations(range(n)))] += 1
        tag = next(key)
        mine = [(None, f"_:{tag}n{a}", p, f"_:{tag}n{b}", "blank", None, None) for a, p, b in links] + [(None, f"_:{tag}n{a}", "v", v, "literal", None, None) for a, v in facts]
        triples += mine + mine[:1]
    found = Counter(r["s"] for r in G.statements(spark.createDataFrame(triples, SCHEMA)).collect())
    assert sorted(found.values()) == sorted(classes.values())


def test_bags_are_told_by_their_digests(spark):
    table = lambda *rows: spark.createDataFrame(rows, "s string, p string")
    same = lambda a, b: G.same_quads(a, b).first()[0]
    assert same(table(("a", "b"), ("c", None)), table(("c", None), ("a", "b")))
    for other in ([("a", "b")], [("a", "b")] * 3, [("a", "b"), ("ab", "")], [("a", "b"), ("a", None)], [("a", "b"), ("b", "a")]):
        assert not same(table(("a", "b"), ("a", "b")), table(*other))
    assert same(table(("a", "b")).limit(0), table(("a", "b")).limit(0))


def test_joins_on_subjects_are_dealt_by_the_number_of_quads(spark, monkeypatch):
    rows = [(f"u:{k}", p, o, "iri" if p == "u:next" else "literal") for k in range(12) for p, o in (("u:a", str(k % 5)), ("u:b", str(k % 3)), ("u:c", "x"), ("u:next", f"u:{k % 4}")) if (k + ord(p[-1])) % 7]
    q = spark.createDataFrame(rows, "s string, p string, o string, o_kind string").select(F.lit(None).cast("string").alias("g"), "*", *[F.lit(None).cast("string").alias(c) for c in ("o_datatype", "o_lang")])
    texts = {
        "SELECT ?s ?x ?y ?z WHERE { ?s <u:a> ?x ; <u:b> ?y ; <u:c> ?z FILTER(?x <= ?y) }": 3, "SELECT ?s ?x ?y WHERE { ?s <u:a> ?x OPTIONAL { ?s <u:b> ?y } }": 2, "SELECT ?s ?x WHERE { ?s <u:a> ?x MINUS { ?s <u:b> ?y } }": 2,
        "SELECT ?s ?n ?x ?y WHERE { ?s <u:next> ?n . ?n <u:a> ?x . ?n <u:b> ?y }": 0, "SELECT ?s ?x ?t WHERE { ?s <u:a> ?x . ?t <u:b> ?x }": 0, "SELECT ?s ?x WHERE { ?s <u:a> ?x VALUES ?s { <u:1> <u:2> } }": 0,
    }
    before = {t: sorted(map(str, sparql.flat(sparql.run(q, t)).collect())) for t in texts}
    monkeypatch.setattr(sparql, "_QUADS_A_TASK", 2)
    tasks = -(-len(rows) // 2)
    for text, dealt in texts.items():
        found = sparql.flat(sparql.run(q, text))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(f", {tasks}") == plan.count("RepartitionByExpression") == dealt, text
        assert before[text] == sorted(map(str, found.collect())) and before[text]
