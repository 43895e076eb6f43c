"""Names, groups and marks in lines that say who submitted something."""

import pytest

from gatherum.operators import authors as A

NAMES = ["Anna", "Peter", "Jean", "Maria", "Hans", "Ursula", "Luca", "Rosa"]
CASES = [
    ("Von Anna Muster (SP, Bern)", [("Anna", "Muster", "SP", "Bern")], [], None),
    ("Anna Muster, SP und Peter von Gunten, FDP", [("Anna", "Muster", "SP", None), ("Peter", "von Gunten", "FDP", None)], [], None),
    ("Muster Anna, Bern", [("Anna", "Muster", None, "Bern")], [], None),
    ("SP-Fraktion (Sprecher: Hans Keller)", [("Hans", "Keller", None, None)], ["SP-Fraktion"], None),
    ("Fraktion SVP, Peter Meier", [("Peter", "Meier", None, None)], ["Fraktion SVP"], None),
    ("Frau Dr. Ursula B. Frei und 12 Mitunterzeichnende", [("Ursula", "Frei", None, None)], [], 12),
    ("Anna Maria Muster-Huber", [("Anna Maria", "Muster-Huber", None, None)], [], None),
    ("Anna Muster Peter Jann", [("Anna", "Muster", None, None), ("Peter", "Jann", None, None)], [], None),
    ("Par Jean-Luc Rochat, Luca De Rosa et 3 cosignataires", [("Jean-Luc", "Rochat", None, None), ("Luca", "De Rosa", None, None)], [], 3),
    ("Kommission für Bildung und Kultur", [], ["Kommission für Bildung und Kultur"], None), ("Grüne Fraktion und Anna Muster", [("Anna", "Muster", None, None)], ["Grüne Fraktion"], None),
    ("Zgraggen Beat (GLP)", [("Zgraggen", "Beat", "GLP", None)], [], None),
    ("Keller", [("", "Keller", None, None)], [], None),
    ("Peter Maria", [("Peter", "Maria", None, None)], [], None),
    ("die sache ist klar", [], [], None), ("", [], [], None), (None, [], [], None),
]


@pytest.mark.parametrize("small", [A.SMALL, 0])
def test_lines(spark, small):
    lines = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, line string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = {r["k"]: r for r in A.read_authors(lines, ["k"], "line", names, small).collect()}
    for k, (line, authors, groups, others) in enumerate(CASES):
        r = got[k]
        assert ([(a["first"], a["family"], a["party"], a["place"]) for a in r["authors"]], r["groups"], r["others"]) == (authors, groups, others), line
        for a in r["authors"]:
            assert line[a["start"] : a["stop"]] == a["name"] or " ".join(line[a["start"] : a["stop"]].split()) == a["name"]


def test_every_state_knows_every_class():
    table = A._table()
    states = {k.split("|")[0] for k in table}
    assert {s for s, _ in table.values()} <= states and all(f"{s}|{c}" in table for s in states for c in A._CLASSES)
