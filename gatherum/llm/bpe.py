"""Byte-level BPE as a monoid: encode halves, join neighbours, re-encode a growing window at each border.

Two levels use the same idea.

* Inside one pre-token the elements are canonical token lists. A list is the canonical encoding exactly when each
  adjacent pair of its tokens is canonical by itself, so a join re-encodes the two tokens at the border and grows the
  window by a token on a side while the pair at that side's edge is not canonical; all pairs outside are untouched.
* Over a text the elements are lists of pre-tokens. A match of the pattern depends on nothing before its start, so
  (1) matches of the left half that end three characters before its end can't change, and (2) once matching across the
  border meets a match start of the right half, all later matches are those of the right half. The window is what lies
  between.

Decoding concatenates byte strings up a tree of halves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches of the left side that end so many characters before its end are final: the pattern looks at two more at most.
_LOOKAHEAD = 3
#: Characters of a leaf; longer texts are halved.
LEAF_CHARS = 1024
#: Byte strings up to this length merge at once; longer ones are halved.
_LEAF_BYTES = 16
#: Longer byte strings find the next merge with a heap.
_SCAN_BYTES = 48
#: Remembered pre-tokens of a generation; there are two.
_MEMO_LIMIT = 250_000
_NO_RANK = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


#: Texts made only of these characters take a form of the pattern for Python's own regex engine, which is faster: ASCII
#: without the four separators on whose being white space engines differ, and the letters from U+00C0 to U+024F.
_NOT_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xc0-\\u024f]").search
_PLAIN_LETTERS = "a-zA-Z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"


def _plain_form(pattern: str) -> str | None:
    """The pattern for plain texts with its Unicode classes spelt out; None if it has parts this can't translate."""
    own = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_PLAIN_LETTERS}0-9]").replace(r"\p{L}", f"[{_PLAIN_LETTERS}]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in own else own


class TreeBpe:
    """Encoder and decoder for one vocabulary file and split pattern."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS):
        self.rank = load_ranks(path)
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.any_pattern = regex.compile(pattern)
        plain = _plain_form(pattern)
        self.plain_pattern = re.compile(plain) if plain else self.any_pattern
        self.leaf_chars = max(2, leaf_chars)
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # -- inside a pre-token

    def merged(self, data: bytes) -> list[int]:
        """The canonical encoding of a leaf or a border window: the pair with the lowest rank merges, the leftmost first, until none has a rank."""
        rank = self.rank.get
        parts = [data[i : i + 1] for i in range(len(data))]
        if len(parts) > _SCAN_BYTES:
            return self._merged_long(parts)
        while len(parts) > 1:
            least, at = _NO_RANK, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1], _NO_RANK)
                if r < least:
                    least, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def _merged_long(self, parts: list[bytes]) -> list[int]:
        """As ``merged``, with a heap of pairs over a doubly linked list; pairs that have changed since are passed over."""
        n, rank = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(both + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, both + parts[k]))
            if (h := before[i]) >= 0 and (r := rank(parts[h] + both)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + both))
        return [self.rank[p] for p in parts if p]

    def _canonical_pair(self, a: int, b: int) -> bool:
        got = self.pair_memo.get((a, b))
        if got is None:
            if len(self.pair_memo) > _MEMO_LIMIT:
                self.pair_memo.clear()
            got = self.pair_memo[(a, b)] = self._window([a, b]) == [a, b]
        return got

    def _window(self, ids: list[int]) -> list[int]:
        return self.merged(b"".join([self.token[i] for i in ids]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The canonical encoding of two neighbours from their canonical encodings."""
        if not left or not right or self._canonical_pair(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            window = self._window(left[i:] + right[:j])
            grow_left = i > 0 and not self._canonical_pair(left[i - 1], window[0])
            grow_right = j < len(right) and not self._canonical_pair(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + window + right[j:]
            i, j = i - grow_left, j + grow_right

    def _encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= _LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.join_tokens(self._encode_bytes(data[:half]), self._encode_bytes(data[half:]))

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers; short ones are remembered in two generations."""
        got = self.older.get(piece)
        if got is None:
            data = piece.encode("utf-8", "replace")
            whole = self.rank.get(data)  # a pre-token that is a token isn't merged
            got = np.array([whole] if whole is not None else self._encode_bytes(data), dtype="<u4").tobytes()
        if len(piece) < 100:
            if len(self.memo) >= _MEMO_LIMIT:
                self.older, self.memo = self.memo, {}
            self.memo[piece] = got
        return got

    # -- over a text

    def join_pieces(self, left: list[str], right: list[str], match: Callable) -> list[str]:
        """The pre-tokens of two neighbours from the pre-tokens of each; ``left`` is used up."""
        size, keep = 0, len(left)
        while keep and size < _LOOKAHEAD:
            keep -= 1
            size += len(left[keep])
        window, taken = "".join(left[keep:]), 0
        edge, at, tail = len(window), 0, []
        while True:
            # Match until a start of the right half is met; its text joins the window a piece at a time, two ahead.
            while taken < len(right) and len(window) < max(at, edge) + 64:
                window += right[taken]
                taken += 1
            m = match(window, at)
            while m is not None and taken < len(right) and m.end() + _LOOKAHEAD > len(window):
                grown = min(len(right), taken + max(8, taken))
                window += "".join(right[taken:grown])
                taken = grown
                m = match(window, at)
            if m is None:
                break
            tail.append(m.group())
            at = m.end()
            if at >= edge:
                start, k = edge, 0
                while start < at:
                    start += len(right[k])
                    k += 1
                if start == at:
                    del left[keep:]
                    left += tail
                    left += right[k:]
                    return left
        del left[keep:]
        return left + tail

    def pieces(self, text: str) -> list[str]:
        pattern = self.any_pattern if _NOT_PLAIN(text) else self.plain_pattern
        return self._pieces(text, pattern.findall, pattern.match)

    def _pieces(self, text: str, find: Callable, match: Callable) -> list[str]:
        if len(text) <= self.leaf_chars:
            return find(text)
        half = len(text) // 2
        return self.join_pieces(self._pieces(text[:half], find, match), self._pieces(text[half:], find, match), match)

    def encode_to_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.pieces(text or "")
        try:
            return b"".join(list(map(self.memo.__getitem__, pieces)))
        except KeyError:
            get, encode = self.memo.get, self.encode_piece
            return b"".join([get(p) or encode(p) for p in pieces])  # an encoding is never empty

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_to_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 512:
            return b"".join([self.token[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_coders: dict[tuple[str, str], TreeBpe] = {}


def coder(path: str, pattern: str) -> TreeBpe:
    """One coder for each Python worker."""
    if (path, pattern) not in _coders:
        _coders[(path, pattern)] = TreeBpe(path, pattern)
    return _coders[(path, pattern)]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, token_ids (unless ``ids`` is false), ids_sha256, decoded_sha256.

    Null counts as empty: no tokens, hashes of nothing. A text of any length is encoded whole. Special-token strings are ordinary
    text. Repeated rows stay, an empty table gives no rows, other columns are ignored. ``path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.frombuffer(tree.encode_to_bytes(t), dtype="<u4") for t in part.column(1).to_pylist()]
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in lists], pa.int64()),
                    *([pa.array([x.view("<i4") for x in lists], pa.list_(pa.int32()))] if ids else []),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in lists]),
                    pa.array([hashlib.sha256(tree.decode(x.tolist())).hexdigest() for x in lists]),
                ]
                names = ["doc_id", "n_tokens", *(["token_ids"] if ids else []), "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, " + "token_ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
