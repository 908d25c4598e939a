"""Whitening, exact top-k search and vector codes against plain numpy versions, with odd rows."""

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from sitegraph.llm.queries import ORACLES, QUERIES
from sitegraph.llm.topk_search import maxscore, top_k
from sitegraph.llm.vector_codes import exact_products, limbs, nearest
from sitegraph.llm.whitening import charpoly_mod, largest_roots, roots_above, whiten
from sitegraph.llm.vector_codes import encode

EMB = "vec_id long, embedding array<float>, label int, component string, code string, score string"
SF = "/root/testdata/sf0.01"


def _table(spark, vectors, ids=None, labels=None):
    ids = list(range(len(vectors))) if ids is None else ids
    labels = [i % 3 for i in range(len(vectors))] if labels is None else labels
    rows = [(i, v, lab, "c", "d", "e") for i, v, lab in zip(ids, vectors, labels)]
    return spark.createDataFrame(rows, EMB).repartition(3)


def _random(n, d, seed=1, repeat=0):
    rng = np.random.default_rng(seed)
    base = (rng.standard_normal((n, d)) * 0.2).astype(np.float32)
    return [list(map(float, v)) for v in base] + [list(map(float, base[0]))] * repeat


ODD = [None, [], [1.0, None, 0.5, 0.5], [float("nan")] + [0.1] * 3, [float("inf")] + [0.1] * 3, [0.1] * 7]


# ---------------------------------------------------------------- op11


def _whiten_numpy(vectors, scale=256, k=4):
    x = np.array([np.floor(scale * np.asarray(v, dtype=np.float64)) for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / n
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w)[:k]
    return x, n, w[order], v[:, order], mean, np.trace(cov)


def test_charpoly_mod_matches_exact_small_matrix():
    a = np.array([[4, 1, 2], [1, 3, 0], [2, 0, 5]], dtype=np.int64)
    exact = [round(c) for c in np.poly(a.astype(float))[::-1]]  # constant first
    p = 2147483647
    assert charpoly_mod(a, p) == [c % p for c in exact]


def test_roots_are_counted_and_isolated():
    coeffs = [-36, 36, -11, 1]  # (t-1)(t-... ) roots 2, 3, 6 -> t^3 - 11 t^2 + 36 t - 36
    assert [roots_above(coeffs, m, 0) for m in (0, 2, 3, 5, 6)] == [3, 2, 1, 1, 0]
    got = largest_roots(coeffs, 3, [6.0, 3.0, 2.0])
    assert [float(r) for r, _ in got] == pytest.approx([6, 3, 2], rel=1e-15)
    double = [0, 0, 4, -4, 1]  # t^2 (t - 2)^2: a double root and two zeros
    got = largest_roots(double, 4, [2.0, 2.0, 0.0, 0.0])
    assert [(float(r), m) for r, m in got] == [(pytest.approx(2.0), 2)] * 2


def test_whitening_matches_eigh(spark):
    vectors = _random(300, 12, repeat=40)
    out = whiten(_table(spark, vectors + ODD)).toPandas()
    x, n, e, u, mean, trace = _whiten_numpy(vectors)
    assert set(out["n"]) == {n} and len(out) == 4 * len(vectors)
    assert out["identity_error"].max() <= 1e-4
    for k in range(4):
        got = out[out.component == k + 1]
        assert got["eigenvalue"].iloc[0] == pytest.approx(e[k], rel=1e-12)
        assert got["explained"].iloc[0] == pytest.approx(e[k] / trace, rel=1e-10)
        want = (x - mean) @ u[:, k] / math.sqrt(e[k])
        w = got.sort_values("vec_id", kind="stable")["whitened"].to_numpy()
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-9
    dev = ((n * x - x[np.unique(x, axis=0, return_index=True)[1]].sum(axis=0)) ** 2).sum(axis=1)
    got = out[out.component == 1].sort_values("vec_id", kind="stable")["deviation"].to_numpy()
    assert (got == dev).all()


def test_whitening_odd_tables(spark):
    assert whiten(_table(spark, ODD)).count() == 0  # only malformed vectors, and one 7-long
    assert whiten(_table(spark, [[0.5, 0.25]] * 5)).count() == 0  # one distinct vector: nothing varies
    two = whiten(_table(spark, [[0.5, 0.25], [0.25, 0.5]], ids=[None, 3])).toPandas()
    assert len(two) == 2 and two["vec_id"].isna().sum() == 1 and two["explained"].iloc[0] == pytest.approx(1.0)


def test_whitening_query_on_sf(spark):
    out = QUERIES["op11_embedding_whitening"](spark, SF)
    assert out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 4 * 500


# ---------------------------------------------------------------- op12


def _brute_top(vectors, ids, k=10, every=100):
    keep = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: np.floor(1024 * np.asarray(vectors[i], dtype=np.float64)).astype(np.int64) for i in keep}
    out = []
    for q in keep:
        if ids[q] is None or ids[q] % every:
            continue
        scored = [(int(x[q] @ x[c]), ids[c]) for c in keep if ids[c] != ids[q] and len(x[c]) == len(x[q])]
        scored.sort(key=lambda t: (-t[0], math.inf if t[1] is None else t[1]))
        out += [(ids[q], r + 1, v, s) for r, (s, v) in enumerate(scored[:k])]
    return sorted(out, key=lambda t: (t[0], t[1]))


def test_maxscore_equals_full_scan():
    rng = np.random.default_rng(3)
    cands = rng.integers(-300, 300, size=(5000, 16))
    ids = np.arange(5000)
    for _ in range(20):
        q = rng.integers(-300, 300, size=16)
        want = np.lexsort((ids, -(cands @ q)))[:10]
        got = maxscore(q, cands, ids, 10, chunk=256)
        assert [i for i, _ in got] == want.tolist()


def test_topk_with_ties_nulls_and_repeats(spark, many_partitions):
    vectors = _random(400, 8) + [[0.01] * 8] * 30 + ODD + [[0.5] * 8, [0.5] * 8]
    ids = list(range(0, 4 * 400, 4)) + [1000] * 30 + [7000 + i for i in range(len(ODD))] + [None, 1200]
    got = top_k(_table(spark, vectors, ids=ids), k=10).select("query_id", "rank", "vec_id", "score").collect()
    got = sorted([tuple(r) for r in got], key=lambda t: (t[0], t[1]))
    # the 30 rows of id 1000 are 30 query rows, each with its own list
    want = _brute_top(vectors, ids)
    key = lambda t: (t[0], t[1], t[3], math.inf if t[2] is None else t[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_topk_query_equals_its_sql(spark):
    got = QUERIES["op12_exact_topk"](spark, SF).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(ORACLES["op12_exact_topk"]).df().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert len(got) == len(want) == 50
    assert (got[["query_id", "rank", "vec_id", "score"]].to_numpy() == want[["query_id", "rank", "vec_id", "score"]].to_numpy()).all()


def test_topk_empty_and_small(spark):
    assert top_k(_table(spark, [])).count() == 0
    few = top_k(_table(spark, _random(3, 4), ids=[0, 1, 2])).collect()
    assert [r.vec_id for r in few] == sorted([r.vec_id for r in few], key=lambda v: -[x.score for x in few if x.vec_id == v][0]) and len(few) == 2


# ---------------------------------------------------------------- op13


def test_limbs_recombine_and_products_are_exact():
    rng = np.random.default_rng(5)
    a = rng.integers(-(1 << 40), 1 << 40, size=(30, 16))
    b = rng.integers(-(1 << 20), 1 << 20, size=(7, 16))
    for bits in (3, 8, 24):
        parts = limbs(a, bits)
        assert (sum(p << (bits * k) for k, p in enumerate(parts)) == a).all()
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a], dtype=object)
    assert (exact_products(a, b).astype(object) == want).all()


def test_nearest_ties_to_lower_index():
    book = np.array([[1, 0], [0, 1], [1, 0]])
    index, dist = nearest(np.array([[0, 0], [1, 1], [2, 0]]), book)
    assert index.tolist() == [0, 0, 0] and dist.tolist() == [1, 1, 1]


def _codes_numpy(vectors, ids, labels, parts=4, entries=256, rounds=4):
    order = sorted(range(len(vectors)), key=lambda i: (math.inf if ids[i] is None else ids[i], vectors[i]))
    x = np.array([np.floor(1024 * np.asarray(vectors[i], dtype=np.float64)) for i in order], dtype=np.int64)
    step = x.shape[1] // parts
    chunks = [x[:, p * step : (p + 1) * step] for p in range(parts)]
    books = [c[:entries].copy() for c in chunks]

    def assign(c, b):
        d = ((c[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        for p in range(parts):
            idx, _ = assign(chunks[p], books[p])
            for j in range(len(books[p])):
                if (idx == j).any():
                    books[p][j] = np.floor_divide(chunks[p][idx == j].sum(axis=0), (idx == j).sum())
    codes, err = [], np.zeros(len(x), dtype=np.int64)
    for p in range(parts):
        idx, d = assign(chunks[p], books[p])
        codes.append(idx)
        err += d
    text = ["".join(f"{c:02x}" for c in row) for row in np.array(codes).T]
    digest = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    lab = pd.Series([labels[i] for i in order], dtype="object").fillna("none")
    label_err = pd.Series(err).groupby(lab.values).transform("sum").to_numpy()
    return [ids[i] for i in order], text, err, label_err, digest


def test_codes_match_plain_kmeans(spark):
    vectors = _random(600, 16, seed=9) + [[0.3] * 16] * 50 + ODD
    ids = list(range(600, 0, -1)) + [5] * 50 + [None] * len(ODD)
    labels = [i % 4 if i % 7 else None for i in range(len(vectors))]
    got = encode(_table(spark, vectors, ids=ids, labels=labels)).toPandas()
    keep = list(range(650))
    want_ids, text, err, label_err, digest = _codes_numpy([vectors[i] for i in keep], [ids[i] for i in keep], [labels[i] for i in keep])
    assert len(got) == 650 and set(got["codebooks_sha256"]) == {digest}
    key = lambda df: sorted(zip(df[0], df[1], df[2], df[3]))
    assert key((got["vec_id"], got["code"], got["error"], got["label_error"])) == key((want_ids, text, err.tolist(), label_err.tolist()))


def test_codes_few_rows_and_empty(spark):
    got = encode(_table(spark, _random(5, 8))).toPandas()
    assert len(got) == 5 and (got["error"] == 0).all()  # each row is its own entry
    assert encode(_table(spark, ODD[:5])).count() == 0
    with pytest.raises(ValueError):
        encode(_table(spark, [[0.1] * 6] * 3)).count()


def test_codes_query_on_sf(spark):
    out = QUERIES["op13_vector_codes"](spark, SF)
    assert out.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert out.count() == 500
