"""Byte-level BPE as a reduction over a tree.

Token sequences form a monoid whose product is "the encoding of both byte strings together".
`encode` splits a piece of text into halves, encodes them and joins the neighbours. A join first
looks at the seam only; if the tokens beside it would not stay as they are, it re-encodes a window
around the seam and widens it until both edges of the window are stable. That proves the rest: a
sequence of tokens is the encoding of its bytes if each two neighbours are the encoding of theirs
(the first merge across a border in the whole would be one in the pair as well, since merges below
its rank are the same in both). Decoding concatenates up the tree.

The split pattern's matches never merge with each other, so above them the join is concatenation.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import as_text, slices

#: Bytes encoded without halving; entries each table of a worker holds before it is emptied.
LEAF_BYTES = 4
MAX_CHUNKS = 800_000
MAX_PIECES = 300_000
MAX_PAIRS = 1_000_000

#: A space between two characters that are not white space starts a match in any text.
_BORDER = re.compile(r"(?<=\S) (?=\S)")


class TreeBpe:
    def __init__(self, path: str, pattern: str, chunks: int = MAX_CHUNKS):
        import regex

        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.limit = chunks
        self.decimals = {rank: str(rank) for rank in self.bytes_of}
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.stable_pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost of equal ranks, until no two neighbours make a token."""
        parts = [data[k : k + 1] for k in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            low = min((r for r in found if r is not None), default=None)
            if low is None:
                break
            at = found.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def stable(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.stable_pairs.get(pair)
        if known is None:
            if len(self.stable_pairs) >= MAX_PAIRS:
                self.stable_pairs.clear()
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == pair
            self.stable_pairs[pair] = known
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of both together."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        i, j, grow_left, grow_right, step = len(left), 0, True, True, 1
        while True:
            i = max(0, i - step * grow_left)
            j = min(len(right), j + step * grow_right)
            middle = self._window(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            grow_left = i > 0 and not self.stable(left[i - 1], middle[0])
            grow_right = j < len(right) and not self.stable(middle[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + middle + right[j:]
            step *= 2

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one match, by halves."""
        known = self.pieces.get(data)
        if known is None:
            if len(data) <= LEAF_BYTES:
                known = self.merged(data)
            else:
                half = len(data) // 2
                known = self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))
            self._keep(data, known)
        return known

    def _window(self, data: bytes) -> tuple[int, ...]:
        known = self.pieces.get(data)
        if known is None:
            known = self.merged(data)
            self._keep(data, known)
        return known

    def _keep(self, data: bytes, ids: tuple[int, ...]) -> None:
        if len(data) <= 32:
            if len(self.pieces) >= MAX_PIECES:
                self.pieces.clear()
            self.pieces[data] = ids

    def encode_matches(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.encode_piece(m.encode()) for m in self.matches(text)))

    def _chunk(self, chunk: str) -> bytes:
        known = self.chunks.get(chunk)  # it may have been met earlier in the same text
        if known is not None:
            return known
        entry = array("I", self.encode_matches(" " + chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self.chunks) >= self.limit:
                self.chunks.clear()
            self.chunks[chunk] = entry
        return entry

    def encode(self, text: str) -> array:
        """The ids of a text."""
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            first, *rest = _BORDER.split(text)
        found = list(map(self.chunks.get, rest))
        if None in found:
            if any(not c or c[0].isspace() or c[-1].isspace() for c, f in zip(rest, found) if f is None):
                first, *rest = _BORDER.split(text)
                found = list(map(self.chunks.get, rest))
            found = [self._chunk(c) if f is None else f for c, f in zip(rest, found)]
        ids = array("I", self.encode_matches(first))
        ids.frombytes(b"".join(found))
        return ids

    def as_decimals(self, ids) -> str:
        return " ".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids) -> bytes:
        """Halves decoded and concatenated; a leaf is a few hundred tokens."""
        if len(ids) <= 512:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_LOADED: dict[tuple[str, str], TreeBpe] = {}


def tree_bpe(path: str, pattern: str) -> TreeBpe:
    """One per worker process and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = TreeBpe(path, pattern)
    return _LOADED[path, pattern]


def _digester(path: str, pattern: str, keep_ids: bool):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, pattern)
        for part in slices(batches):
            n, sums, back, kept = [], [], [], []
            for text in as_text(part.column(1)):
                ids = bpe.encode(text)
                n.append(len(ids))
                sums.append(hashlib.sha256(bpe.as_decimals(ids).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids.tolist())
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return digest


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, and its ids if asked for.

    `ids_sha256` is over the decimal ids joined by one space, `decoded_sha256` over the bytes that
    the ids decode to. A NULL text is empty: no ids, digests of nothing. Repeated rows and NULL ids
    give a row each; other columns are not read; an empty table gives an empty result. Texts never
    leave the task that scans them.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_digester(ranks_path, pattern, keep_ids), schema)


def _decoder(path: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path, pattern)
        for part in slices(batches):
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return decode


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and text from doc_id and ids; NULL ids decode to an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(ranks_path, pattern), "doc_id long, text string")
