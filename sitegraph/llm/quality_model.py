"""Quality scores: histogram gradient-boosted trees over document statistics.

Statistics are made once per text, next to the scan; from there on only narrow rows move. The trees
are fitted on the driver to a bounded sample of labelled rows, flattened into arrays, and walked by
all rows of a batch at once in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import as_bytes, crc_of_id, hash_bound, slices
from sitegraph.llm.trees import Bins, Trees
from sitegraph.session import cut

#: Labelled rows the trees are fitted to, at most (those of the smallest hashes of their ids).
SAMPLE_ROWS = 30_000

FEATURES = (
    "log_bytes", "log_words", "word_length", "long_word", "distinct_words", "top_word", "repeat_windows", "log_lines",
    "line_length", "repeat_lines", "short_lines", "letters", "upper", "digits", "space", "not_ascii", "stops", "commas",
    "hash_star", "dollar_percent", "ampersand", "pipes", "quotes", "brackets", "colons", "other_signs", "entropy",
    "words_with_signs", "title_words", "upper_words", "number_words", "sentence_words",
)

_CLASSES = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789", "space": b" \t\n\r\x0b\x0c", "stops": b".!?", "commas": b",;", "hash_star": b"#*",
    "dollar_percent": b"$%", "ampersand": b"&", "pipes": b"|", "quotes": b"\"'`", "brackets": b"()[]{}<>", "colons": b":=/",
    "other_signs": b"+-_~^@\\",
}
_SIGN_WORD = re.compile(rb"[#*$%&|<>~^]")


def statistics(data: bytes) -> list[float]:
    """The features of one text (UTF-8); a text without words has zeros for its ratios."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    words = data.split()
    n = len(words)
    some = max(1, n)
    lines = [line.strip() for line in data.split(b"\n")]
    lines = [line for line in lines if line]
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    windows = set(zip(words, words[1:], words[2:]))
    share = counts[counts > 0] / size
    part = {name: float(counts[list(chars)].sum()) / size for name, chars in _CLASSES.items()}
    starts = [w[0] for w in words]
    values = {
        "log_bytes": np.log1p(len(data)),
        "log_words": np.log1p(n),
        "word_length": (size - counts[32]) / some,
        "long_word": max(map(len, words), default=0),
        "distinct_words": len(distinct) / some,
        "top_word": max(distinct.values(), default=0) / some,
        "repeat_windows": 1 - len(windows) / max(1, n - 2) if n > 2 else 0.0,
        "log_lines": np.log1p(len(lines)),
        "line_length": len(data) / max(1, len(lines)),
        "repeat_lines": 1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        "short_lines": sum(len(line) < 30 for line in lines) / max(1, len(lines)),
        "not_ascii": float(counts[128:].sum()) / size,
        "entropy": float(-(share * np.log2(share)).sum()) if len(data) else 0.0,
        "words_with_signs": len(_SIGN_WORD.findall(data)) / some,
        "title_words": sum(65 <= c <= 90 for c in starts) / some,
        "upper_words": sum(map(bytes.isupper, distinct)) / max(1, len(distinct)),
        "number_words": sum(48 <= c <= 57 for c in starts) / some,
        "sentence_words": n / (1 + counts[46] + counts[33] + counts[63]),
        **part,
    }
    return [float(values[f]) for f in FEATURES]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = [statistics(text) for text in as_bytes(part.column(1))]
        column = pa.array(rows, pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([part.column(0), column], ["doc_id", "features"])


def measured(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_measure, "doc_id long, features array<float>")


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0
) -> Trees:
    """Boosting with logistic loss."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    grown = []
    if len(y) and y.min() != y.max():
        binned = Bins(x, bins)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            feature, limit, leaf, own = binned.grow(y - p, p * (1 - p), depth, ridge, least=20)
            grown.append((feature, limit, rate * leaf))
            margin += rate * leaf[own]
    feature, limit, leaf = zip(*grown) if grown else (np.zeros((0, 1)),) * 3
    return Trees(base, np.array(feature), np.array(limit), np.array(leaf))


def probabilities(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 per row."""
    return 1 / (1 + np.exp(-model.total(x)))


def labelled_sample(features: DataFrame, labels: DataFrame, held_out_of: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `rows` labelled documents outside the held-out part."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & (F.pmod(crc_of_id(), F.lit(held_out_of)) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    near = F.xxhash64("doc_id") <= hash_bound(known.count(), rows)
    joined = features.join(known.where(near), "doc_id").select("doc_id", "features", "quality")
    taken = joined.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    if not len(taken):
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    return np.stack(taken["features"].to_numpy()).astype(np.float32), taken["quality"].to_numpy(np.float64)


def _scorer(model: Trees, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            x = np.asarray(part.column(2).flatten(), np.float32).reshape(part.num_rows, len(FEATURES))
            scores = probabilities(model, x)
            predicted = pa.array((scores >= threshold).astype(np.int32))
            columns = [part.column(0), part.column(1), pa.array(scores), predicted]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return score


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out_of: int = 5, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every text.

    Only labels of documents whose crc32(doc_id as text) mod `held_out_of` is not 0 are learnt from;
    a NULL id is in neither part (held_out false). Labels that are NULL or not 0 or 1 are ignored; an
    id with both counts as 1. Without usable labels, or with one kind only, all scores are the same.
    NULL texts are empty. Repeated rows give a row each; other columns are not read.
    """
    features = cut(measured(docs))
    model = fit_trees(*labelled_sample(features, labels, held_out_of, sample_rows))
    held_out = F.coalesce(F.pmod(crc_of_id(), F.lit(held_out_of)) == 0, F.lit(False))
    rows = features.select("doc_id", held_out.alias("held_out"), "features")
    return rows.mapInArrow(_scorer(model, threshold), "doc_id long, held_out boolean, score double, predicted int")
