"""Best-fit packing of tokenized documents into fixed-length sequences, improved by swaps.

Texts are tokenized next to the scan; only piece lengths and checksums travel. Pieces are dealt to
shards of bounded size by a row number, so no key or group of copies gathers in one; each shard is
packed by best fit (longest first), then by local search over its underfull bins: moves, one-for-one
and two-for-one exchanges that fill a fuller bin from an emptier one. Each such step raises the sum
of squared fills, so the search ends; bins that become empty are gone. A shard wastes at most about
one bin in some thousands.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import as_bytes, slices
from sitegraph.llm.word_tokens import word_tokens
from sitegraph.session import cut

#: Pieces of a shard on average; a shard is one task's work.
SHARD_PIECES = 20_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(path: str, capacity: int, end_id: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(path).encode
        end = int(end_id).to_bytes(4, "little")
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                ids = encode(text) + end
                for k in range(0, len(ids), 4 * capacity):
                    piece = ids[k : k + 4 * capacity]
                    rows.append((doc, k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut_up


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of at most `capacity` tokens; only documents longer than that are cut."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_cutter(tokenizer_path, capacity, end_id), PIECE_SCHEMA)


class _Bins:
    """Bins of one shard: item numbers per bin, and the free space of each."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths = lengths
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that still takes it."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        spaces: list[int] = []  # sorted free spaces for which some bin exists
        for k in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            need = self.lengths[k]
            at = bisect_left(spaces, need)
            if at == len(spaces):
                b = len(self.items)
                self.items.append([])
                left = self.capacity - need
            else:
                space = spaces[at]
                b = by_free[space].pop()
                if not by_free[space]:
                    spaces.pop(at)
                left = space - need
            self.items[b].append(k)
            if left:
                if not by_free[left]:
                    insort(spaces, left)
                by_free[left].append(b)
        self.free = [self.capacity - sum(self.lengths[k] for k in own) for own in self.items]

    def least(self) -> int:
        """No packing has fewer bins."""
        return -(-sum(self.lengths) // self.capacity)

    def improve(self, donors: int, receivers: int) -> None:
        """Empty the emptiest bins into the others, as long as steps are found.

        Each round takes the `donors` emptiest bins; each tries the `receivers` fullest underfull
        bins. These two bound the time of a round, not the rows: what finds no place stays.
        """
        changed = True
        while changed and sum(map(bool, self.items)) > self.least():
            changed = False
            under = sorted((b for b, own in enumerate(self.items) if own and self.free[b]), key=lambda b: (self.free[b], b))
            for d in under[::-1][:donors]:
                for r in under[:receivers]:
                    if r == d or not self.items[r] or not self.items[d] or self.free[r] > self.free[d]:
                        continue
                    while self.free[r] and self.items[d] and self._step(d, r):
                        changed = True

    def _step(self, d: int, r: int) -> bool:
        """One move or exchange that makes the fuller bin r fuller by as much as possible."""
        size, space = self.lengths, self.free[r]
        given = sorted((size[k], k) for k in self.items[d])
        lengths = [s for s, _ in given]
        best: tuple[int, list[int], list[int]] = (0, [], [])

        def offer(gain: int, out: list[int], back: list[int]) -> None:
            nonlocal best
            if best[0] < gain <= space:
                best = (gain, out, back)

        at = bisect_right(lengths, space)
        if at:
            offer(lengths[at - 1], [given[at - 1][1]], [])
        for b in self.items[r]:
            most = size[b] + space
            at = bisect_right(lengths, most)
            if at:  # one for one
                offer(lengths[at - 1] - size[b], [given[at - 1][1]], [b])
            low, high = 0, len(given) - 1  # two for one: the pair with the largest sum within `most`
            while low < high:
                pair = lengths[low] + lengths[high]
                if pair <= most:
                    offer(pair - size[b], [given[low][1], given[high][1]], [b])
                    low += 1
                else:
                    high -= 1
            if best[0] == space:
                break
        gain, out, back = best
        if not gain:
            return False
        self.items[d] = [k for k in self.items[d] if k not in out] + back
        self.items[r] = [k for k in self.items[r] if k not in back] + out
        self.free[d] += gain
        self.free[r] -= gain
        return True


def pack(lengths: list[int], capacity: int, donors: int = 64, receivers: int = 512) -> list[list[int]]:
    """Item numbers per bin, no bin empty."""
    bins = _Bins(lengths, capacity)
    bins.best_fit()
    bins.improve(donors, receivers)
    return [own for own in bins.items if own]


def _packer(capacity: int):
    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        base = int(rows["_shard"].iloc[0]) << 32
        for number, own in enumerate(pack(lengths, capacity)):
            at = 0
            for k in own:
                sequence[k], offset[k] = base + number, at
                at += lengths[k]
        return rows.assign(sequence_id=sequence, offset=offset)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    return pack_shard


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `end_id`; a NULL or empty text is that id alone. Repeated rows
    and NULL or repeated ids are packed like others. Sequences have no gaps and hold at most
    `capacity` tokens. Other columns are not read; an empty table gives an empty result.
    """
    pieces = cut(pieces_of(docs, tokenizer_path, capacity, end_id))
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("_row", F.monotonically_increasing_id()).withColumn(
        "_shard", F.pmod(F.xxhash64("_row"), F.lit(shards))
    )
    return dealt.groupBy("_shard").applyInPandas(
        _packer(capacity), f"{PIECE_SCHEMA}, sequence_id long, offset long"
    )
