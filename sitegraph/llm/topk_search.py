"""Exact top-k inner-product search by MaxScore over dimension postings, in query blocks against candidate shards.

Vectors become integers x = floor(1024 c). Each dimension is a "term" whose posting holds every candidate's
entry; a query's weight on it is its own entry. Per (query block, shard) group:

* the bound of term j for query q is max over the shard of q_j * x_j (its maximum or minimum entry, by the
  sign of q_j); terms sorted by bound, the longest prefix whose bounds sum below the current k-th score
  (the threshold) is non-essential, the rest essential;
* candidates are traversed in order in chunks: scores over essential terms are computed for all of them;
  only those whose partial score plus the non-essential bounds can still reach the threshold are probed
  on the non-essential terms; the top list, the threshold and the split are updated after each chunk.

The bound is a true upper bound, so no candidate that could enter the top list is skipped: the result is
exact. Products are float64 BLAS sums, exact while max|q| * max|x| * d stays below 2^53 (checked; else
int64). Shards' top lists are merged per query row by one window over at most shards * k rows.

Data movement: queries (every vec_id divisible by 100) are dealt into blocks of at most `QUERY_BLOCK` rows
and candidates into shards of about `SHARD_ROWS`; each query is copied to every shard and each candidate to
every block, so no group holds more than one block and one shard, however hot an id or vector is.

Cases: vectors null, empty or with null/non-finite entries take no part; a query meets only candidates of
its own length; the query's own row (same vec_id) is left out, other rows with an equal vector are not;
fewer than k candidates: all are returned; ties go to the smaller vec_id (NULL vec_id last); repeated query
rows each get their list. Extra input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch
from sitegraph.llm.vectors import integer_vectors
from sitegraph.session import cut

SCALE = 1024
TOP = 10
QUERY_EVERY = 100
QUERY_BLOCK = 2048
SHARD_ROWS = 8192
CHUNK = 2048
_EXACT = 1 << 53
#: vec_id stand-in for NULL in tie-breaking, so that NULL sorts last.
_NULL_ID = np.iinfo(np.int64).max

OUT = "qkey long, query_id long, vec_id long, score long"


def _dot(a: np.ndarray, b: np.ndarray, exact_float: bool) -> np.ndarray:
    if exact_float:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def maxscore(query: np.ndarray, cands: np.ndarray, ids: np.ndarray, k: int, chunk: int = CHUNK) -> list[tuple[int, int]]:
    """(index, score) of the k best candidates for one query: score descending, then id ascending."""
    if len(cands) == 0:
        return []
    hi = cands.max(axis=0)
    lo = cands.min(axis=0)
    bound = np.where(query >= 0, query * hi, query * lo)
    order = np.argsort(bound, kind="stable")
    cum = np.cumsum(bound[order])
    big = int(np.abs(query).max(initial=0)) * int(max(np.abs(hi).max(initial=0), np.abs(lo).max(initial=0))) * len(query)
    exact_float = big < _EXACT
    best_s = np.empty(0, dtype=np.int64)
    best_i = np.empty(0, dtype=np.int64)
    threshold = None
    for at in range(0, len(cands), chunk):
        block = cands[at : at + chunk]
        idx = np.arange(at, at + len(block))
        if threshold is None:
            n_ne = 0
        else:
            n_ne = int(np.searchsorted(cum, threshold, side="left"))  # bounds summing below the threshold
        ess, ne = order[n_ne:], order[:n_ne]
        partial = _dot(block[:, ess], query[None, ess], exact_float)[:, 0] if len(ess) else np.zeros(len(block), dtype=np.int64)
        if n_ne:
            alive = partial + int(cum[n_ne - 1]) >= threshold
            block, idx, partial = block[alive], idx[alive], partial[alive]
            if len(block):
                partial = partial + _dot(block[:, ne], query[None, ne], exact_float)[:, 0]
        if len(idx) == 0:
            continue
        s = np.concatenate([best_s, partial])
        i = np.concatenate([best_i, idx])
        keep = np.lexsort((ids[i], -s))[:k]
        best_s, best_i = s[keep], i[keep]
        if len(best_s) == k:
            threshold = int(best_s[-1])
    return list(zip(best_i.tolist(), best_s.tolist()))


def _search(key, cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    if len(cands) == 0 or len(queries) == 0:
        return pd.DataFrame({"qkey": [], "query_id": [], "vec_id": [], "score": []})
    x = np.stack(cands["x"].to_numpy()).astype(np.int64)
    ids = cands["vec_id"].fillna(_NULL_ID).astype(np.int64).to_numpy()
    raw_ids = cands["vec_id"].to_numpy()
    out_q, out_id, out_v, out_s = [], [], [], []
    for qkey, qid, qx in zip(queries["qkey"], queries["q_id"], queries["qx"]):
        q = np.asarray(qx, dtype=np.int64)
        mask = ids != qid
        pick = np.nonzero(mask)[0]
        for j, score in maxscore(q, x[pick], ids[pick], TOP):
            out_q.append(qkey)
            out_id.append(qid)
            out_v.append(raw_ids[pick[j]])
            out_s.append(score)
    return pd.DataFrame({"qkey": out_q, "query_id": out_id, "vec_id": pd.array(out_v, dtype="Int64"), "score": out_s})


def top_k(embeddings: DataFrame, k: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row; `qkey` names the query row."""
    spark = embeddings.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.keep(
            integer_vectors(embeddings, SCALE, one_length=False).select(
                "vec_id", "x", F.size("x").alias("d"), F.monotonically_increasing_id().alias("row")
            )
        )
        counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
        shards = max(1, math.ceil(counts["n"] / SHARD_ROWS))
        blocks = max(1, math.ceil(counts["q"] / QUERY_BLOCK))
        # the two sides share no column name: the optimizer may otherwise prune a side's columns by the other's
        queries = rows.where(F.col("vec_id") % every == 0).select(
            F.col("row").alias("qkey"), F.col("vec_id").alias("q_id"), F.col("x").alias("qx"), F.col("d").alias("qd"),
            F.pmod(F.col("row"), F.lit(blocks)).cast("long").alias("qblock"),
        )
        # keys of both sides have equal types, or equal keys would hash to different partitions
        queries = queries.withColumn("qshard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        cands = rows.select("vec_id", "x", "d", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("long").alias("shard"))
        cands = cands.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        found = (
            cands.groupBy("d", "block", "shard")
            .cogroup(queries.groupBy("qd", "qblock", "qshard"))
            .applyInPandas(lambda key, c, q: _search(key, c, q), OUT)
        )
        order = Window.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return cut(ranked.select("qkey", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON len(q.x) = len(c.x) AND c.vec_id IS DISTINCT FROM q.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM s
) WHERE rank <= 10
"""
