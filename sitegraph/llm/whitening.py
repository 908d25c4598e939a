"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

Each well-formed vector becomes x = floor(256 c). The fit list holds each distinct x once (n of them, sums S).
Its integer scatter C = n * sum(x x^T) - S S^T equals n^2 times the covariance V (divisor n, centred), so
eigenvalues of V are those of C over n^2 and both share eigenvectors.

1. Spark sums n, S and sum(x x^T) over the distinct vectors; each task folds its rows into one d x d partial
   (float64 products are exact below 2^53, checked per chunk), and positions are summed by a shuffle of d^2
   keys per task. Only d^2 + d integers reach the driver, whatever the size of the table.
2. The characteristic polynomial of C is computed modulo enough 31-bit primes to cover the bound
   sum_k C(d,k) trace^k on its coefficients (C is positive semi-definite): one Spark task per group of primes
   reduces C mod p to Hessenberg form by similarity and runs the Hessenberg recurrence. The driver joins the
   residues by the Chinese remainder theorem into exact integer coefficients.
3. All roots are real, so the number of roots above t is the number of sign changes of the coefficients of
   p(t + y) (Descartes' rule is exact for real-rooted polynomials). Bisection over dyadic t isolates the
   largest roots to 2^-70 of their size, guided by a float estimate; multiple roots show as a count above one.
4. Each component is found by inverse iteration on C - lambda I from the refined root (a block of vectors for a
   multiple root), orthogonal to earlier ones, unit length, sign fixed so its largest entry is positive.
5. Spark projects every remaining row: whitened = sum((n x - S) u) / sqrt(lambda), which is (x - S/n).u / sqrt(e)
   without rounding S/n, and deviation = sum((n x - S)^2) in exact longs.

Cases: null, empty or non-finite vectors are dropped (and rows of a minority length, see `integer_vectors`).
No rows remain: an empty result. Repeated rows are all returned but counted once in the fit. Components with
eigenvalue 0 are not returned (one distinct vector: no component, so no rows). Null vec_id: kept as NULL.
Extra input columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch
from sitegraph.llm.vectors import integer_vectors
from sitegraph.session import cut

SCALE = 256
COMPONENTS = 4
#: Primes are taken downwards from this bound, so that two residues multiply inside int64.
PRIME_BOUND = 1 << 31
#: Bits of a root that bisection fixes, relative to the root.
ROOT_BITS = 70
#: Primes per Spark task.
PRIMES_PER_TASK = 8
_EXACT = 1 << 53


# ---------------------------------------------------------------- scatter


def _gram_partials(batches):
    """One row per task: count, per-dimension sums and the flattened sum of x x^T of its rows."""
    n, s, g = 0, None, None
    for batch in batches:
        if len(batch) == 0:
            continue
        x = np.stack(batch["x"].to_numpy()).astype(np.int64)
        big = int(np.abs(x).max()) if x.size else 0
        rows = max(1, _EXACT // max(1, big * big * x.shape[1])) if big else len(x)
        if s is None:
            s, g = np.zeros(x.shape[1], dtype=np.int64), np.zeros((x.shape[1], x.shape[1]), dtype=np.int64)
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            if big * big * x.shape[1] < _EXACT:
                f = part.astype(np.float64)
                g += np.rint(f.T @ f).astype(np.int64)
            else:
                g += part.T @ part
        n += len(x)
        s += x.sum(axis=0)
    if s is not None:
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, C) of the fit list, C = n * sum(x x^T) - S S^T as Python integers."""
    parts = fit.mapInPandas(_gram_partials, "n long, s array<long>, g array<long>")
    parts = parts.select("n", F.posexplode("s").alias("pos", "v"), F.lit("s").alias("what")).unionByName(
        parts.select("n", F.posexplode("g").alias("pos", "v"), F.lit("g").alias("what"))
    )
    sums = parts.groupBy("what", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    if not sums:
        return 0, [], []
    s = dict((r["pos"], int(r["v"])) for r in sums if r["what"] == "s")
    g = dict((r["pos"], int(r["v"])) for r in sums if r["what"] == "g")
    n = next(int(r["n"]) for r in sums if r["what"] == "s" and r["pos"] == 0)
    d = len(s)
    S = [s[i] for i in range(d)]
    C = [[n * g[i * d + j] - S[i] * S[j] for j in range(d)] for i in range(d)]
    return n, S, C


# ---------------------------------------------------------------- modular characteristic polynomial


def _is_prime(m: int) -> bool:
    if m < 2:
        return False
    for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        if m % q == 0:
            return m == q
    d, r = m - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13, 17):
        y = pow(a, d, m)
        if y in (1, m - 1):
            continue
        for _ in range(r - 1):
            y = y * y % m
            if y == m - 1:
                break
        else:
            return False
    return True


def primes(count: int, below: int = PRIME_BOUND) -> list[int]:
    out, m = [], below - 1
    while len(out) < count:
        if _is_prime(m):
            out.append(m)
        m -= 1
    return out


def charpoly_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first, monic) of det(t I - A) mod p, by Hessenberg reduction and its recurrence."""
    a = a.astype(np.int64) % p
    d = a.shape[0]
    for j in range(d - 2):
        nz = np.nonzero(a[j + 1 :, j])[0]
        if len(nz) == 0:
            continue
        i = j + 1 + nz[0]
        if i != j + 1:
            a[[i, j + 1], :] = a[[j + 1, i], :]
            a[:, [i, j + 1]] = a[:, [j + 1, i]]
        inv = pow(int(a[j + 1, j]), p - 2, p)
        below = np.arange(j + 2, d)
        u = a[below, j] * inv % p
        if not u.any():
            continue
        a[below, :] = (a[below, :] - (u[:, None] * a[j + 1, :][None, :]) % p) % p
        a[:, j + 1] = (a[:, j + 1] + ((a[:, below] * u[None, :]) % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)  # polys[m] = char. poly of the leading m x m block
    polys[0, 0] = 1
    for m in range(1, d + 1):
        h = a[m - 1, m - 1]
        cur = np.zeros(d + 1, dtype=np.int64)
        cur[1:] = polys[m - 1, :-1]
        cur = (cur - h * polys[m - 1] % p) % p
        prod = 1
        for i in range(m - 1, 0, -1):  # rows i (1-based) above the diagonal of column m
            prod = prod * int(a[i, i - 1]) % p
            if prod == 0:
                break
            coef = int(a[i - 1, m - 1]) * prod % p
            if coef:
                cur = (cur - coef * polys[i - 1] % p) % p
        polys[m] = cur
    return [int(v) for v in polys[d]]


def _residues(batches, matrix: list[list[int]]):
    for batch in batches:
        for p in batch["p"].tolist():
            a = np.array([[v % p for v in row] for row in matrix], dtype=np.int64)
            yield pd.DataFrame({"p": [p], "r": [charpoly_mod(a, p)]})


def charpoly(spark, matrix: list[list[int]]) -> list[int]:
    """Exact integer coefficients (constant first) of det(t I - C) for a positive semi-definite integer C."""
    d = len(matrix)
    trace = max(1, sum(matrix[i][i] for i in range(d)))
    bound = max(math.comb(d, k) * trace**k for k in range(d + 1))
    count = (2 * bound + 1).bit_length() // 30 + 1
    chosen = primes(count)
    while math.prod(chosen) <= 2 * bound + 1:
        chosen = primes(len(chosen) + 1)
    tasks = max(1, math.ceil(len(chosen) / PRIMES_PER_TASK))
    table = spark.createDataFrame([(p,) for p in chosen], "p long").repartition(tasks)
    got = table.mapInPandas(lambda b: _residues(b, matrix), "p long, r array<long>").collect()
    residues = {int(r["p"]): [int(v) for v in r["r"]] for r in got}
    coeffs, modulus = [0] * (d + 1), 1
    for p in chosen:
        r = residues[p]
        inv = pow(modulus % p, p - 2, p)
        for k in range(d + 1):
            step = (r[k] - coeffs[k]) * inv % p
            coeffs[k] += modulus * step
        modulus *= p
    return [c - modulus if c > modulus // 2 else c for c in coeffs]


# ---------------------------------------------------------------- real roots


def roots_above(coeffs: list[int], m: int, shift: int) -> int:
    """Roots (with multiplicity) above m / 2^shift of a real-rooted polynomial, by Descartes' rule after a shift."""
    d = len(coeffs) - 1
    r = [coeffs[d]]
    for k in range(d - 1, -1, -1):
        nxt = [0] * (len(r) + 1)
        for i, v in enumerate(r):
            nxt[i] += m * v
            nxt[i + 1] += v
        nxt[0] += coeffs[k] << (shift * (d - k))
        r = nxt
    signs = [v > 0 for v in r if v != 0]
    return sum(1 for a, b in zip(signs, signs[1:]) if a != b)


def largest_roots(coeffs: list[int], wanted: int, guides: list[float]) -> list[tuple[Fraction, int]]:
    """The `wanted` largest roots, each as (value, multiplicity), multiplicities repeated; roots at 0 left out."""
    d = len(coeffs) - 1
    trace = -coeffs[d - 1] if d else 0
    top = max(1, trace).bit_length() + 1
    shift = ROOT_BITS + 64
    out: list[tuple[Fraction, int]] = []
    j = 1
    while j <= min(wanted, d):
        if roots_above(coeffs, 0, shift) < j:
            break
        guide = guides[j - 1] if j - 1 < len(guides) else 0.0
        width = max(abs(guide) * 1e-9, 1.0)
        lo = int((guide - width) * 2**shift) if guide - width > 0 else 0
        hi = int((guide + width) * 2**shift) + 1
        while roots_above(coeffs, lo, shift) < j and lo > 0:
            lo = max(0, lo - (hi - lo) * 4)
        while roots_above(coeffs, hi, shift) >= j:
            hi = min(hi + (hi - lo) * 4, 1 << (top + shift))
        while hi - lo > max(1, hi >> ROOT_BITS):
            mid = (lo + hi) // 2
            if roots_above(coeffs, mid, shift) >= j:
                lo = mid
            else:
                hi = mid
        mult = roots_above(coeffs, lo, shift) - roots_above(coeffs, hi, shift)
        value = Fraction(lo + hi, 2 ** (shift + 1))
        mult = max(1, mult)
        out.extend([(value, mult)] * mult)
        j += mult
    return out[:wanted]


# ---------------------------------------------------------------- components


def components(matrix: list[list[int]], roots: list[tuple[Fraction, int]]) -> np.ndarray:
    """Unit eigenvectors (rows) for the given roots, by inverse iteration; a block for a multiple root."""
    c = np.array([[float(v) for v in row] for row in matrix])
    d = c.shape[0]
    rng = np.random.default_rng(7)
    found: list[np.ndarray] = []
    k = 0
    while k < len(roots):
        lam, mult = roots[k]
        shift = float(lam)
        a = c - shift * np.eye(d)
        block = rng.standard_normal((d, mult))
        for _ in range(4):
            try:
                block = np.linalg.solve(a, block)
            except np.linalg.LinAlgError:
                a = c - (shift * (1 + 1e-15) + 1e-300) * np.eye(d)
                block = np.linalg.solve(a, block)
            for f in found:
                block -= np.outer(f, f @ block)
            block, _ = np.linalg.qr(block)
        for i in range(mult):
            v = block[:, i]
            for f in found:
                v = v - f * (f @ v)
            v = v / np.linalg.norm(v)
            if v[np.argmax(np.abs(v))] < 0:
                v = -v
            found.append(v)
        k += mult
    return np.array(found).reshape(len(found), d)


# ---------------------------------------------------------------- Spark projection


def whiten(embeddings: DataFrame, components_wanted: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue) per kept row and component."""
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    with Scratch(spark) as scratch:
        rows = scratch.keep(integer_vectors(embeddings, scale).select("vec_id", "x"))
        fit = scratch.keep(rows.select("x").distinct())
        n, S, C = scatter(fit)
        if n == 0:
            return spark.createDataFrame([], schema)
        d = len(S)
        coeffs = charpoly(spark, C)
        guides = sorted(np.linalg.eigvalsh(np.array(C, dtype=float)).tolist(), reverse=True)
        roots = largest_roots(coeffs, components_wanted, guides)
        trace = -coeffs[d - 1]
        if not roots or trace == 0:
            return spark.createDataFrame([], schema)
        u = components(C, roots)
        lam = [float(r) for r, _ in roots]
        explained = [float(r / trace) for r, _ in roots]
        eig = [float(r / (n * n)) for r, _ in roots]

        centred = F.transform("x", lambda v, i: F.lit(n) * v - F.element_at(F.array(*[F.lit(s) for s in S]), i + 1))

        def projected(k: int):
            weights = F.array(*[F.lit(float(w)) for w in u[k]])
            dot = F.aggregate(F.zip_with(centred, weights, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)
            return dot / F.lit(math.sqrt(lam[k]))

        ks = range(len(roots))
        w = fit.select(*[projected(k).alias(f"w{k}") for k in ks])
        sums = w.agg(
            *[F.sum(f"w{k}").alias(f"m{k}") for k in ks],
            *[F.sum(F.col(f"w{k}") * F.col(f"w{m}")).alias(f"p{k}_{m}") for k in ks for m in ks],
        ).first()
        error = max(
            abs(sums[f"p{k}_{m}"] / n - (sums[f"m{k}"] / n) * (sums[f"m{m}"] / n) - (1.0 if k == m else 0.0)) for k in ks for m in ks
        )
        deviation = F.aggregate(F.transform(centred, lambda v: v * v), F.lit(0).cast("long"), lambda acc, v: acc + v)
        per = F.array(
            *[F.struct(F.lit(k + 1).alias("component"), projected(k).alias("whitened"), F.lit(explained[k]).alias("explained"), F.lit(eig[k]).alias("eigenvalue")) for k in ks]
        )
        out = rows.select("vec_id", deviation.alias("deviation"), F.explode(per).alias("c")).select(
            "vec_id",
            F.col("c.component").cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            F.col("c.whitened").alias("whitened"),
            F.col("c.explained").alias("explained"),
            F.lit(float(error)).alias("identity_error"),
            F.col("c.eigenvalue").alias("eigenvalue"),
        )
        return cut(out)  # computed before the scratch tables it reads go
