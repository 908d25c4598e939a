"""Product-quantisation codes of embeddings, with distances by limb-split exact GEMM.

Vectors become integers x = floor(1024 c), cut into `PARTS` equal consecutive parts. Each part position has a
codebook of `ENTRIES` entries, started as that part of the rows with the smallest vec_ids (ascending; ties by
the vector, NULL ids last). Each of `ROUNDS` rounds assigns every part to its nearest entry and replaces each
entry by the componentwise floor(sum / count) of the parts given to it; entries nobody chose stay.

Nearest entry: |x - c|^2 = |x|^2 - 2 x.c + |c|^2, with x.c from float64 BLAS made exact by limbs. Integers
are split into base-2^b limbs (low limbs unsigned, the top limb keeps the sign), b chosen so that a product
of limbs summed over a part stays below 2^53; the limb products are GEMMs in float64, each exact, and are
recombined with their shifts in int64. The first index of the smallest distance wins (ties: lower index).

Spark: the kept rows are written once to the shared folder. A round is one pass over them: each task assigns
its rows against the broadcast codebooks (PARTS x ENTRIES x part length integers, bounded by the parameters)
and folds them into one (part, entry, count, sums) row per used entry, so a shuffle moves at most
PARTS x ENTRIES rows per task however many rows share one vector; the driver takes those sums (bounded the
same way) and forms the next codebooks. The final pass writes code and error per row; label_error is a sum
per label (NULL labels together), joined back, broadcast only when the labels are few.

Cases: vectors null, empty, with null or non-finite entries, or of a minority length are dropped; a length
not divisible by PARTS raises ValueError. Fewer than ENTRIES rows: codebooks have as many entries. No rows:
an empty result. Repeated rows each get a row. NULL vec_id: kept, used for a codebook only after all others.
Extra input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch
from sitegraph.llm.vectors import integer_vectors
from sitegraph.session import cut

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Label counts up to which label sums are broadcast to the rows.
BROADCAST_LABELS = 100_000
_MANTISSA = 53


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """a = sum(limb_k * 2^(bits k)); low limbs in [0, 2^bits), the last one signed."""
    out, rest = [], a.astype(np.int64)
    mask = (1 << bits) - 1
    while True:
        top = (rest >= -(1 << (bits - 1))) & (rest < (1 << (bits - 1)))
        if top.all():
            out.append(rest)
            return out
        out.append(rest & mask)
        rest = rest >> bits


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T for int64 matrices, as int64, from float64 GEMMs over limbs."""
    length = max(1, x.shape[1])
    bits = max(1, (_MANTISSA - 1 - int(np.ceil(np.log2(length)))) // 2)
    xs, cs = limbs(x, bits), limbs(c, bits)
    total = np.zeros((x.shape[0], c.shape[0]), dtype=np.int64)
    for i, xl in enumerate(xs):
        for j, cl in enumerate(cs):
            part = np.rint(xl.astype(np.float64) @ cl.astype(np.float64).T).astype(np.int64)
            total += part << (bits * (i + j))
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row; ties to the lower index."""
    dist = (x * x).sum(axis=1)[:, None] - 2 * exact_products(x, book) + (book * book).sum(axis=1)[None, :]
    index = np.argmin(dist, axis=1)
    return index, dist[np.arange(len(x)), index]


def _split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    step = x.shape[1] // parts
    return [x[:, p * step : (p + 1) * step] for p in range(parts)]


def _round_sums(batches, books: list[np.ndarray]):
    """Per task: (part, entry, count, sums) of the parts assigned to each used entry."""
    parts = len(books)
    count = [np.zeros(len(b), dtype=np.int64) for b in books]
    sums = [np.zeros(b.shape, dtype=np.int64) for b in books]
    for batch in batches:
        if len(batch) == 0:
            continue
        x = np.stack(batch["x"].to_numpy()).astype(np.int64)
        for p, xp in enumerate(_split(x, parts)):
            index, _ = nearest(xp, books[p])
            count[p] += np.bincount(index, minlength=len(books[p]))
            np.add.at(sums[p], index, xp)
    rows = [(p, e, int(count[p][e]), sums[p][e].tolist()) for p in range(parts) for e in np.nonzero(count[p])[0].tolist()]
    yield pd.DataFrame(rows, columns=["part", "entry", "n", "sums"])


def _codes(batches, books: list[np.ndarray]):
    parts = len(books)
    for batch in batches:
        if len(batch) == 0:
            continue
        x = np.stack(batch["x"].to_numpy()).astype(np.int64)
        code = np.zeros((len(x), parts), dtype=np.int64)
        error = np.zeros(len(x), dtype=np.int64)
        for p, xp in enumerate(_split(x, parts)):
            code[:, p], dist = nearest(xp, books[p])
            error += dist
        text = ["".join(f"{v:02x}" for v in row) for row in code.tolist()]
        yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "code": text, "error": error})


def codebook_digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and position, `,`-joined in decimal."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Final codebooks (one int64 array of entries x part length per part) of `rows` (vec_id, x)."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), F.asc("x")).limit(entries).select("x").collect()
    if not first:
        return []
    start = np.array([r["x"] for r in first], dtype=np.int64)
    if start.shape[1] % parts:
        raise ValueError(f"vectors of length {start.shape[1]} cannot be cut into {parts} equal parts")
    books = _split(start, parts)
    for _ in range(rounds):
        current = [b.copy() for b in books]
        got = rows.select("x").mapInPandas(lambda it, bk=current: _round_sums(it, bk), "part int, entry int, n long, sums array<long>")
        got = got.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array_agg("sums").alias("all"))
        for r in got.collect():  # at most parts x entries rows
            total = np.array(r["all"], dtype=np.int64).sum(axis=0)
            books[r["part"]][r["entry"]] = total // int(r["n"])  # floor, also below zero
    return books


def encode(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, label) per kept row."""
    spark = embeddings.sparkSession
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string, label long"
    with Scratch(spark) as scratch:
        rows = scratch.keep(integer_vectors(embeddings, SCALE).select("vec_id", "label", "x"))
        books = train(rows, parts, entries, rounds)
        if not books:
            return spark.createDataFrame([], schema)
        coded = scratch.keep(rows.mapInPandas(lambda it, bk=books: _codes(it, bk), "vec_id long, label long, code string, error long"))
        per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "key")
        if per_label.count() <= BROADCAST_LABELS:
            per_label = F.broadcast(per_label)
        out = coded.join(per_label, coded["label"].eqNullSafe(per_label["key"]), "left").select(
            "vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"), "label"
        )
        return cut(out)
