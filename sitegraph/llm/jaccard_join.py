"""N-gram Jaccard self-join by chosen paths.

Texts become sets of five-word shingles; equal sets are one class. A set is embedded as its MinHash
values in 128 coordinates. Each run samples coordinates (one and a half on average) and sends a set
down one path per sampled coordinate and its value there, so two sets stay together with a chance
that grows with their likeness. Buckets of more than `leaf` sets are split again the same way, with
coordinates sampled anew for each path; smaller ones, and those of the last level, are compared by
brute force, in blocks if they are large. Runs are repeated until a pair at the threshold is found
with the target probability.

Brute force on sketches only says which sets may be alike: each bucket reports one link per set
(to the smallest set of its group there), never all pairs. Groups that hang together are then
compared exactly, in blocks: links are counted where they are found, so no list of pairs exists. The
texts of candidates cross the network once; everything else that moves is narrow.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import ENTRY_BYTES, TABLE_BYTES, Scratch, as_text, slices
from sitegraph.session import cut

SHINGLE = 5
COORDINATES = 128

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Threshold and search parameters. Nothing here limits how many partners a set may have."""

    threshold: float = 0.8
    recall: float = 0.9999
    #: Likeness of sketches from which sets may be alike, and from which paths are sampled. Both leave
    #: room for the error of a likeness estimated from 128 coordinates (0.035 at 0.8).
    sketch: float = 0.65
    path: float = 0.7
    leaf: int = 64
    depth: int = 3
    block: int = 512

    @property
    def chance(self) -> float:
        """That a coordinate is sampled for a path."""
        return 1 / (self.path * COORDINATES)

    @property
    def runs(self) -> int:
        """Runs for the target recall, for a pair whose sketches agree as little as `path` on the deepest level."""
        together = 1.0
        for _ in range(self.depth):
            together = 1 - (1 - self.chance * together) ** (self.path * COORDINATES)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - together))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD
    return values ^ (values >> np.uint64(29))


class Shingler:
    """Shingle sets of texts as sorted arrays of 64-bit hashes; keeps the hashes of words."""

    def __init__(self, limit: int = 500_000):
        self.limit = limit
        self.words: dict[str, int] = {}
        self.size = 0

    def _hash(self, word: str) -> int:
        cost = ENTRY_BYTES + len(word)
        if len(self.words) >= self.limit or self.size + cost > TABLE_BYTES:
            self.words.clear()
            self.size = 0
        self.size += cost
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        self.words[word] = h
        return h

    def shingles(self, text: str) -> np.ndarray:
        """Distinct shingles; a text of one to four words has one, of all its words."""
        words = _WORD.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint64)
        found = list(map(self.words.get, words))
        if None in found:
            found = [self._hash(w) if h is None else h for w, h in zip(words, found)]
        hashes = np.array(found, np.uint64)
        size = min(SHINGLE, len(hashes))
        n = len(hashes) - size + 1
        h = np.full(n, size, np.uint64)
        for k in range(size):
            h = _mixed(h + hashes[k : k + n])
        return np.unique(h)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(128)
    odd = rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) | np.uint64(1)
    return odd, rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def embedded(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of non-empty sets, one row each."""
    odd, add = _seeds()
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat((values * odd[i] + add[i]) >> np.uint64(32), starts)
    return out


def sampled(paths: np.ndarray, chance: float) -> np.ndarray:
    """Which coordinates each path samples (paths x coordinates); a function of the path alone."""
    places = np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    drawn = _mixed(_mixed(paths[:, None] + places[None, :]))
    return drawn < np.uint64(int(chance * 2**64))


def children(paths: np.ndarray, values: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for paths and the values of their sets."""
    row, place = np.nonzero(sampled(paths, chance))
    mixed = _mixed(paths[row] * _ODD + place.astype(np.uint64))
    return row, _mixed(mixed + values[row, place].astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def _embed(plan: Plan):
    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        roots = _mixed(np.arange(1, plan.runs + 1, dtype=np.uint64) << np.uint64(32))
        chosen = sampled(roots, plan.chance)
        for part in slices(batches, 64):
            sets = [shingler.shingles(t) for t in as_text(part.column(1))]
            some = [k for k, s in enumerate(sets) if len(s)]
            ids: list[bytes | None] = [None] * len(sets)
            paths: list[np.ndarray | None] = [None] * len(sets)
            sketches: list[bytes | None] = [None] * len(sets)
            if some:
                mins = embedded([sets[k] for k in some])
                run, place = np.nonzero(chosen)
                mixed = _mixed(roots[run] * _ODD + place.astype(np.uint64))
                keys = _mixed(mixed[None, :] + mins[:, place] * np.uint64(0x94D049BB133111EB)).view(np.int64)
                low = mins.astype(np.uint16)
                for row, k in enumerate(some):
                    ids[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    paths[k] = keys[row]
                    sketches[k] = low[row].tobytes()
            made = [pa.array(ids, pa.binary()), pa.array(paths, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            columns = [part.column(0), part.column(2), *made]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_id", "set_id", "paths", "sketch"])

    return embed


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), COORDINATES)


def _split(plan: Plan):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            paths = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            row, child = children(paths, _values(part.column(2)), plan.chance)
            columns = [part.column(0).take(pa.array(row)), pa.array(child.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "path"])

    return split


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(k).to_pylist() for k in range(keys)]
        marks = list(zip(*names))
        begin = 0
        for k, mark in enumerate(marks):
            if mark != last:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], k, mark
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def linked(like: np.ndarray) -> np.ndarray:
    """The smallest position that each position hangs together with, by a symmetric matrix of likeness."""
    label = np.arange(len(like))
    while True:
        nearest = np.where(like, label[None, :], len(like)).min(axis=1, initial=len(like))
        new = np.minimum(label, nearest)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _agreeing(sketches: np.ndarray) -> np.ndarray:
    """Number of coordinates in which each two sketches agree."""
    if len(sketches) <= 64:
        return (sketches[:, None] == sketches[None]).sum(axis=2)
    out = np.zeros((len(sketches), len(sketches)), np.int16)
    for k in range(COORDINATES):
        out += sketches[:, k, None] == sketches[None, :, k]
    return out


def _sketch_links(plan: Plan):
    least = int(plan.sketch * COORDINATES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[bytes, bytes]] = []
        for group in _groups(batches, 2):
            if group.num_rows > 1:
                ids = np.array(group.column(2).to_pylist(), object)
                order = ids.argsort()
                ids = ids[order]
                sketches = np.frombuffer(b"".join(group.column(3).to_pylist()), np.uint8).reshape(len(ids), COORDINATES)[order]
                label = linked(_agreeing(sketches) >= least)
                pairs += [(ids[k], ids[n]) for k, n in enumerate(label) if n != k]
            if len(pairs) > 20_000:
                yield _pairs(pairs)
                pairs = []
        yield _pairs(pairs)

    return compare


def _pairs(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*pairs) if pairs else [[], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["set_id", "link"])


def in_blocks(df: DataFrame, key: str, n: str, block: int) -> DataFrame:
    """Rows with `pair`: 0 for keys of at most `block` rows; larger ones are cut into blocks by a hash
    of set_id, and each row goes to every pair of blocks that its own is in."""
    blocks = F.ceil(F.col(n) / block).cast("long")
    own = F.pmod(F.xxhash64("set_id", F.lit(block)), blocks)
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: F.least(b, own) * blocks + F.greatest(b, own)
    )
    placed = df.withColumn("_own", own).withColumn("pair", F.explode(pairs))
    return placed.withColumn("_blocks", blocks)


def components(edges: DataFrame) -> DataFrame:
    """set_id and label: the smallest set_id it hangs together with. `edges` has set_id and link.

    Labels spread along edges and along themselves (each set takes the label of its label), so a
    chain of n sets needs about log n rounds. The driver sees one number per round.
    """
    with Scratch(edges.sparkSession) as scratch:
        back = edges.select(F.col("link").alias("set_id"), F.col("set_id").alias("link"))
        both = scratch.keep(edges.select("set_id", "link").unionByName(back).distinct())
        labels = scratch.keep(both.groupBy("set_id").agg(F.least(F.min("link"), F.first("set_id")).alias("label")))
        while True:
            told = both.join(labels.select(F.col("set_id").alias("link"), "label"), "link").select("set_id", "label")
            own = labels.select("set_id", "label", F.col("label").alias("old"))
            spread = told.withColumn("old", F.lit(None).cast("binary")).unionByName(own)
            spread = spread.groupBy("set_id").agg(F.min("label").alias("near"), F.min("old").alias("old"))
            roots = labels.select(F.col("set_id").alias("near"), F.col("label").alias("root"))
            new = spread.join(roots, "near").select("set_id", F.least("near", "root").alias("label"), "old")
            labels = scratch.keep(new)
            if labels.where("label <> old").limit(1).count() == 0:
                return cut(labels.select("set_id", "label"))


def shared_paths(members: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id, path and n (sets on the path), for paths of two sets or more.

    The sizes are a table of their own, so that the join shuffles both sides for itself and a hot path can be split.
    """
    sizes = scratch.keep(members.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return members.join(sizes, "path").select("set_id", "path", "n")


def candidate_links(classes: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """set_id and link: sets that may be alike, one link per set and bucket."""
    level = scratch.keep(shared_paths(classes.select("set_id", F.explode("paths").alias("path")), scratch))
    busy = level.select("set_id").distinct()
    active = scratch.keep(classes.select("set_id", "sketch").join(busy, "set_id"))
    leaves = []
    for depth in range(1, plan.depth + 1):
        crowded = F.col("n") > plan.leaf
        if depth == plan.depth or level.where(crowded).limit(1).count() == 0:
            leaves.append(level)
            break
        leaves.append(level.where(~crowded))
        wide = level.where(crowded).join(active, "set_id").select("set_id", "path", "sketch")
        level = scratch.keep(shared_paths(wide.mapInArrow(_split(plan), "set_id binary, path long"), scratch))
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    rows = in_blocks(rows, "path", "n", plan.block).select("set_id", "path", "pair")
    # the low byte of each value is enough here
    low = active.select("set_id", "sketch").mapInArrow(_low_bytes, "set_id binary, low binary")
    held = rows.join(low, "set_id").select("path", "pair", "set_id", "low")
    dealt = held.repartition("path", "pair").sortWithinPartitions("path", "pair")
    return dealt.mapInArrow(_sketch_links(plan), "set_id binary, link binary").distinct()


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 2048):
        low = [row.astype(np.uint8).tobytes() for row in _values(part.column(1))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(low, pa.binary())], ["set_id", "low"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for part in slices(batches):
        sets = [shingler.shingles(t).tobytes() for t in as_text(part.column(1))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["set_id", "shingles"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets, by products over a few thousand shingles at a time."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    order = column.argsort(kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, len(values), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        held = np.zeros((len(sets), min(4096, len(values) - first)), np.float32)
        held[row[a:b], column[a:b] - first] = 1
        out += held @ held.T
    return out


def _exact_links(threshold: float):
    kinds = [("set_id", pa.binary()), ("link", pa.binary()), ("links", pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows) if rows else [[]] * 3, kinds)]
        return pa.RecordBatch.from_arrays(columns, [n for n, _ in kinds])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in _groups(slices(batches, 512), 2):
            if group.num_rows < 2:
                continue
            ids = np.array(group.column("set_id").to_pylist(), object)
            order = ids.argsort()
            ids = ids[order]
            docs, own = (group.column(c).to_numpy()[order] for c in ("n_docs", "_own"))
            blocks, pair = group.column("_blocks")[0].as_py(), group.column("pair")[0].as_py()
            held = group.column("shingles").to_pylist()
            sets = [np.frombuffer(held[k], np.uint64) for k in order]
            shared = intersections(sets)
            sizes = np.array(list(map(len, sets)), np.float64)
            union = sizes[:, None] + sizes[None, :] - shared
            like = shared >= threshold * union - 1e-9 * union
            np.fill_diagonal(like, False)
            if pair // blocks != pair % blocks:  # pairs inside a block are counted in its own group
                like &= own[:, None] != own[None, :]
            label = linked(like)
            counts = like @ docs
            rows += [(i, ids[n], int(c)) for i, n, c in zip(ids, label, counts) if c]
            if len(rows) > 20_000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    return compare


def exact_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """set_id, link (the smallest set it hangs together with in its block pair) and links (documents), to be summed.

    `classes` has set_id, n_docs and text_id, the digest of one text of the class; `groups` has set_id and label.
    """
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wanted = scratch.keep(groups.join(sizes, "label").join(classes.select("set_id", "n_docs", "text_id"), "set_id"))
    # copies of a text meet in the partial aggregate, so a hot one sends a row per map task
    texts = docs.select(_text_id().alias("text_id"), "text").groupBy("text_id").agg(F.first("text").alias("text"))
    found = texts.join(wanted.select("text_id", "set_id"), "text_id").select("set_id", "text")
    sets = found.mapInArrow(_shingle_rows, "set_id binary, shingles binary")
    rows = in_blocks(wanted.join(sets, "set_id"), "label", "n", plan.block)
    dealt = rows.select("label", "pair", "set_id", "n_docs", "_own", "_blocks", "shingles").repartition("label", "pair")
    return dealt.sortWithinPartitions("label", "pair").mapInArrow(
        _exact_links(plan.threshold), "set_id binary, link binary, links long"
    )


def _text_id():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def jaccard_classes(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, class_id, n_links, set_id, label and text_id, one row per row of `docs`.

    `n_links` is the number of other rows whose Jaccard with this one is at least the threshold, rows
    of the same set included; `class_id` is the smallest doc_id among the rows that hang together by
    such links. `set_id` is equal for equal shingle sets, `label` within a class, `text_id` (sha256)
    for equal texts. A text without words (NULL, empty) is alone:
    its own id, no links, NULL set_id. Texts of one to four words are alike only if equal as words.
    NULL ids are never the class_id unless there is no other. Repeated rows count as rows. Columns
    other than doc_id and text are not read; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, text_id binary, set_id binary, paths array<long>, sketch binary"
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(texts.withColumn("text_id", _text_id()).mapInArrow(_embed(plan), schema))
        classes = scratch.keep(
            rows.where("set_id IS NOT NULL")
            .groupBy("set_id")
            .agg(
                F.first("paths").alias("paths"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n_docs"),
                F.min("doc_id").alias("first_doc"), F.min("text_id").alias("text_id"),
            )
        )
        groups = components(candidate_links(classes, plan, scratch))
        links = scratch.keep(exact_links(texts, classes, groups, plan, scratch))
        labels = components(links.where("link <> set_id").select("set_id", "link"))
        counted = links.groupBy("set_id").agg(F.sum("links").alias("links"))
        own = classes.select("set_id", "n_docs", "first_doc").join(labels, "set_id", "left").join(counted, "set_id", "left")
        own = scratch.keep(own.withColumn("label", F.coalesce("label", "set_id")))
        firsts = own.groupBy("label").agg(F.min("first_doc").alias("class_id"))
        n_links = F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1
        known = scratch.keep(
            own.join(firsts, "label").select(F.col("set_id").alias("_set"), "label", "class_id", n_links.alias("n_links"))
        )
        joined = rows.select("doc_id", "text_id", "set_id").join(known, F.col("set_id") == F.col("_set"), "left")
        alone = F.col("_set").isNull()
        return cut(
            joined.select(
                "doc_id",
                F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                "set_id",
                "label",
                "text_id",
            )
        )


def one_of_each(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row of each class, with the columns of `docs`: the one with the smallest id, then the smallest text digest.

    Texts without words are in no class and stay. Rows that repeat both id and text are one row.
    """
    found = jaccard_classes(docs, plan)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    # a class is known by its smallest id and, since ids may repeat, by what hangs together under it
    first = found.where("set_id IS NOT NULL").groupBy("label").agg(F.min(row).alias("r")).select("r.doc_id", "r.text_id")
    alone = found.where("set_id IS NULL").select("doc_id", "text_id")
    kept = cut(first.unionByName(alone).distinct().select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text")))
    named = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    whole = docs.select(
        F.col("doc_id").cast("long").alias("_own"),
        _text_id().alias("_digest"),
        F.struct(*[F.col(c).alias(n) for c, n in named.items()]).alias("_row"),
    )
    distinct = whole.groupBy("_own", "_digest").agg(F.first("_row").alias("_row"))
    chosen = distinct.join(kept, distinct["_own"].eqNullSafe(kept["_id"]) & (distinct["_digest"] == kept["_text"]), "left_semi")
    return chosen.select([F.col(f"_row.{n}").alias(c) for c, n in named.items()])
