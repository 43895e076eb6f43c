"""Secret scan through a trigram inverted index.

Each rule's regular expression is parsed and turned into a Boolean query over trigrams of its lower-cased text: literals
give conjunctions, alternatives and small classes of characters disjunctions, everything else nothing. Each block of documents gets an index: for every
trigram that a query names, the posting list of the documents with it. Queries intersect and unite postings; only
candidates are verified with the expression itself. A rule without a mandatory trigram (a bare run of hex digits) scans all
documents. An index covers one block, so nothing is shuffled and a lost block is indexed anew.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:  # the parser of Python's own expressions
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover - older Python
    import sre_parse  # type: ignore[no-redef]


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; those are kept whose group ``group`` has ``least`` characters.

    A match goes on to the end of the next ``until``, if there is one before the next ``unless``. It begins as far before as the
    characters of ``before`` go, at the first lower-case letter among them; then there must be two of them at least. Both
    ways are walked once, so that no length is bounded and long runs cost no more than their length.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    until: str = ""
    unless: str = ""
    before: str = ""

    def span(self, m: re.Match) -> tuple[int, int] | None:
        """The whole match; None if it is none."""
        text, start, end = m.string, m.start(), m.end()
        if self.until:
            stop = text.find(self.unless, end)
            last = re.compile(self.until).search(text, end, len(text) if stop < 0 else stop)
            end = last.end() if last else end
        if self.before:
            at = start
            while at and text[at - 1] in self.before:
                at -= 1
            while at < start and not "a" <= text[at] <= "z":
                at += 1
            if start - at < 2:
                return None
            start = at
        return start, end


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The fixed kinds, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
#: Further shapes of credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", until=r"-----END [A-Z ]*PRIVATE KEY-----", unless="-----BEGIN"),
    Rule("url_login", r"://[^\s/:@]+:[^\s/:@]{3,}@", before="abcdefghijklmnopqrstuvwxyz0123456789+.-"),
)
RULES = BASE_RULES + MORE_RULES

#: A query: ("and" | "or", parts), a trigram, or None (says nothing).
Query = tuple | str | None


def _all_of(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts: list[Query]) -> Query:
    if any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _trigrams(text: str) -> Query:
    return _all_of([text[i : i + 3] for i in range(len(text) - 2)])


#: Most characters of a class that is spelt out, and most texts that a part of an expression is spelt out to.
_MOST_LETTERS, _MOST_TEXTS = 16, 64


def _ignores_case(items) -> bool:
    return any(str(op) == "SUBPATTERN" and (arg[1] & re.IGNORECASE or _ignores_case(arg[3])) or str(op) == "BRANCH" and any(map(_ignores_case, arg[1])) or str(op) in ("MAX_REPEAT", "MIN_REPEAT") and _ignores_case(arg[2]) for op, arg in items)


def trigram_query(pattern: str) -> Query:
    """The Boolean query that every text with a match satisfies; trigrams are of ASCII text in lower case.

    Neighbouring parts that stand for few texts are spelt out together, classes of characters among them; a part that stands for
    many ends such a run, and says what is mandatory within it.
    """
    parsed = sre_parse.parse(pattern)
    #: Letters that have forms beyond ASCII where case is ignored.
    loose = "iks" if parsed.state.flags & re.IGNORECASE or _ignores_case(parsed) else ""

    def letters(op: str, arg) -> list[str] | None:
        """The ASCII characters, in lower case, that an element stands for, if they are few."""
        out: set[str] = set()
        for kind, x in [(op, arg)] if op == "LITERAL" else arg if op == "IN" else [("ANY", None)]:
            low, high = (x, x) if str(kind) == "LITERAL" else x if str(kind) == "RANGE" else (0, 1 << 21)  # a category, or all but some
            if high >= 128 or high - low > 2 * _MOST_LETTERS:
                return None
            out |= {chr(c).lower() for c in range(low, high + 1)}
        return sorted(out) if len(out) <= _MOST_LETTERS and not out & set(loose) else None

    def spelt(items) -> list[str] | None:
        """All texts that a part can match, if they are few."""
        texts = [""]
        for op, arg in items:
            more = options(str(op), arg)
            if more is None or len(texts) * len(more) > _MOST_TEXTS:
                return None
            texts = [t + m for t in texts for m in more]
        return list(dict.fromkeys(texts))

    def options(op: str, arg) -> list[str] | None:
        """All texts that one element can match, if they are few."""
        if op == "BRANCH":
            each = [spelt(x) for x in arg[1]]
            return None if any(x is None for x in each) else [t for x in each for t in x]
        if op == "SUBPATTERN":
            return spelt(arg[3])
        if op in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 8:
            return options("BRANCH", (None, [list(arg[2]) * n for n in range(arg[0], arg[1] + 1)]))
        return letters(op, arg)

    def walk(items) -> Query:
        found, run = [], [""]
        for op, arg in items:
            more = options(str(op), arg)
            if more is not None and len(run) * len(more) <= _MOST_TEXTS:
                run = list(dict.fromkeys(t + m for t in run for m in more))
                continue
            found.append(_any_of([_trigrams(t) for t in run]))
            run = [""] if more is None or len(more) > _MOST_TEXTS else more
            if more is None:
                if str(op) == "SUBPATTERN":
                    found.append(walk(arg[3]))
                elif str(op) == "BRANCH":
                    found.append(_any_of([walk(x) for x in arg[1]]))
                elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                    found.append(walk(list(arg[2]) * min(arg[0], 3)))
        return _all_of([*found, _any_of([_trigrams(t) for t in run])])

    return walk(list(parsed))


def named(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(named, query[1]))


class BlockIndex:
    """Posting lists of one block of texts, for the trigrams that queries name."""

    def __init__(self, texts: list[str], trigrams: list[str], slot: np.ndarray):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\x00\x00".join(raw), dtype=np.uint8)
        low = _LOWER[data].astype(np.int32)
        starts = np.cumsum([0] + [len(r) + 2 for r in raw])
        self.postings: dict[str, np.ndarray] = {}
        if len(low) < 3:
            return
        hit = slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(hit)
        owner, which = np.searchsorted(starts, at, side="right") - 1, hit[at]
        order = np.lexsort((owner, which))
        owner, which = owner[order], which[order]
        edges = np.searchsorted(which, np.arange(1, len(trigrams) + 2))
        for k, t in enumerate(trigrams):
            self.postings[t] = np.unique(owner[edges[k] : edges[k + 1]])

    def candidates(self, query: Query) -> np.ndarray:
        if isinstance(query, str):
            return self.postings.get(query, np.zeros(0, dtype=np.int64))
        parts = sorted((self.candidates(p) for p in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOCK_CHARS = 1 << 21


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern if r.least == 0 or r.kind != "hex" else f"[0-9a-f]{{{r.least},}}"), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(named(q) for _, _, q in self.rules)))
        if len(self.trigrams) >= 1 << 16:
            raise ValueError("too many trigrams for one index")
        self.slot = np.zeros(1 << 24, dtype=np.uint8 if len(self.trigrams) < 256 else np.uint16)
        for k, t in enumerate(self.trigrams, 1):
            a, b, c = t.encode("ascii")
            self.slot[a << 16 | b << 8 | c] = k

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text, by start, then by the order of the rules."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        index = BlockIndex(texts, self.trigrams, self.slot)
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in range(len(texts)) if query is None else index.candidates(query).tolist():
                for m in expression.finditer(texts[i]):
                    start, end = m.span(rule.group)
                    span = rule.span(m) if end - start >= rule.least else None
                    if span:
                        found[i].append((span[0], k, span[1]))
        return [[(s, e, self.rules[k][0].kind) for s, k, e in sorted(x)] for x in found]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _BLOCK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind, start, stop>> (code points, stop exclusive).

    Matches of one rule don't overlap, those of different rules may; spans that start together come in the order of the rules.
    Null texts count as empty, texts without a secret have an empty array, texts of any length are read whole. Repeated rows stay,
    an empty table gives no rows, other columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.setdefault(rules, None) or Scanner(rules)
        _scanners[rules] = scanner
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans: list[list[dict]] = []
            for start, end in _blocks(texts):
                spans += [[{"kind": k, "start": s, "stop": e} for s, e, k in x] for x in scanner.scan(texts[start:end])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,stop:long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text, from ``scan_secrets``."""
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES]
    return scanned.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
