"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Entries become whole numbers, so sums and the scatter matrix are exact whatever the order of addition. The characteristic
polynomial of the scatter is computed modulo many primes, by reduction to Hessenberg form, one task a few primes, and put
together by Chinese remaindering. All its roots are real, so the sign changes of its shifted coefficients count the roots above a
point exactly; halving an interval gives each wanted root to any precision. Inverse iteration in long decimals turns a
root into unit vectors of its null space. Rows meet only sums of a task; the driver sees matrices and polynomials of the dimension.
The work besides the two passes over the rows grows with the fourth power of the dimension and hardly with the rows.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another length
than the commonest (of equally common lengths the greatest counts). Repeated rows and null identifiers count as rows. Entries
beyond the range of long count as its ends. Only components with a positive eigenvalue come, so equal vectors, or a single one,
give no rows, as an empty table does. Components of one repeated eigenvalue are an orthonormal basis of its space. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliowire.llm.common import materialise

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows of one exact product: digits of DIGIT bits keep its sums below 2^53.
BLOCK, DIGIT = 4096, 20
#: Sums travel as digits of this many bits, so that adding them never overflows.
PART_BITS = 40
#: Bits of a root beyond its first, and decimal places of the linear algebra.
ROOT_BITS, PLACES = 160, 100
_LONG = 2**63 - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, v) of the vectors that count, as doubles, and their dimension."""
    v = F.col("v")
    endless = F.lit(float("inf"))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == endless)))
    common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common.d if common else 0
    return good.where(F.size(v) == d), d


def _integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The whole numbers of a batch less SHIFT: floor(SCALE * c)."""
    scaled = np.floor(SCALE * batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    out = np.where(np.abs(scaled) < 2.0**62, scaled, 0.0).astype(np.int64)
    far = np.abs(scaled) >= 2.0**62
    if far.any():
        out[far] = [max(-_LONG - 1, min(_LONG - SHIFT, int(x) if math.isfinite(x) else int(math.copysign(_LONG, x)))) for x in scaled[far]]
    return out


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as signed digits of DIGIT bits, exact in double precision."""
    half, out = 1 << (DIGIT - 1), []
    while y.any() or not out:
        low = ((y & (2 * half - 1)) ^ half) - half  # the low bits, read as a signed number
        out.append(low.astype(np.float64))
        y = (y >> DIGIT) + (low < 0)
    return out


def _added(batches: Iterator[pa.RecordBatch], d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and sums of products of the rows of a task, as Python integers."""
    n, sums, products = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
    small, waiting = np.zeros((d, d), dtype=np.int64), 0
    for batch in batches:
        rows = _integers(batch, d)
        n += len(rows)
        for start in range(0, len(rows), BLOCK):
            digits = _digits(rows[start:start + BLOCK])
            for i, a in enumerate(digits):
                sums += a.sum(axis=0).astype(np.int64).astype(object) << (DIGIT * i)
                for j, b in enumerate(digits):
                    product = (a.T @ b).astype(np.int64)
                    if i or j:
                        products += product.astype(object) << (DIGIT * (i + j))
                    else:
                        small += product
                        waiting += 1
            if waiting > 1000:  # each is below 2^51
                products += small.astype(object)
                small[:], waiting = 0, 0
    return n, sums, products + small.astype(object)


def scatter(good: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums of floor(SCALE * c), and the scatter sum (n y - S)(n y - S)' / n as whole numbers.

    n sum yy' - SS' is the centred scatter exactly; the tasks send sums of d (d + 3) / 2 + 1 entries in digits.
    """
    upper = np.triu_indices(d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = _added(batches, d)
        out = []
        for k, value in enumerate([n, *s, *m[upper]]):
            value, sign, place = abs(int(value)), 1 if value >= 0 else -1, 0
            while value:
                out.append((k, place, sign * (value & ((1 << PART_BITS) - 1))))
                value, place = value >> PART_BITS, place + 1
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())],
                                         ["k", "place", "digit"])

    entries = [0] * (1 + d + len(upper[0]))
    for r in good.mapInArrow(sums, "k int, place int, digit long").groupBy("k", "place").agg(F.sum("digit").alias("digit")).collect():
        entries[r.k] += int(r.digit) << (PART_BITS * r.place)
    n, s = entries[0], entries[1:d + 1]
    out = np.zeros((d, d), dtype=object)
    for i, j, value in zip(*upper, entries[d + 1:], strict=True):
        out[i, j] = out[j, i] = n * value - s[i] * s[j]
    return n, s, out


def primes(count: int) -> list[int]:
    """The largest primes below 2^31."""
    def prime(q: int) -> bool:  # these three bases decide below 2^32
        odd, twos = q - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 7, 61):
            x = pow(base, odd, q)
            if x in (1, q - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % q
                if x == q - 1:
                    break
            else:
                return False
        return True

    out, q = [], 2**31 - 1
    while len(out) < count:
        if prime(q):
            out.append(q)
        q -= 2
    return out


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, constant first, of det(x - matrix) modulo a prime below 2^31."""
    h = np.array(matrix % p, dtype=np.int64)
    d = len(h)
    for k in range(d - 2):  # similarity steps empty the columns below the subdiagonal
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * factors % p).sum(axis=1)) % p
    polys = [np.ones(1, dtype=np.int64)]
    for k in range(d):  # the determinant of each leading block by its last column
        new = np.zeros(k + 2, dtype=np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - h[k, k] * polys[k]) % p
        path = 1
        for i in range(k - 1, -1, -1):
            path = path * int(h[i + 1, i]) % p
            if not path:
                break
            new[:i + 1] = (new[:i + 1] - path * int(h[i, k]) % p * polys[i]) % p
        polys.append(new)
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """The exact coefficients, constant first, of det(x - matrix) for a symmetric matrix without negative eigenvalues."""
    d, trace = len(matrix), int(np.trace(matrix))
    # coefficients are sums of products of eigenvalues, at most those of equal eigenvalues
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    wanted = primes((2 * bound).bit_length() // 30 + 1)
    entries = [[int(x) for x in row] for row in matrix]

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(entries, dtype=object).reshape(d, d)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"p": [p] * (d + 1), "k": list(range(d + 1)), "r": polynomial_modulo(whole, p).tolist()})

    def remaindered(table: pa.Table) -> pa.Table:
        value, modulus = 0, 1
        for p, r in zip(table.column("p").to_pylist(), table.column("r").to_pylist(), strict=True):
            value += modulus * ((r - value) * pow(modulus, -1, p) % p)
            modulus *= p
        return pa.table({"k": pa.array(table.column("k").to_pylist()[:1], pa.int64()), "c": [str(value - modulus if 2 * value > modulus else value)]})

    tasks = min(len(wanted), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.createDataFrame([(p,) for p in wanted], "p long").repartition(tasks).mapInArrow(residues, "p long, k long, r long")
    found = {r.k: int(r.c) for r in rows.groupBy("k").applyInArrow(remaindered, "k long, c string").collect()}
    return [found[k] for k in range(d + 1)]


def _roots_above(coefficients: list[int], at: int) -> int:
    """How many roots, all of them real, lie above a whole number: sign changes after the shift by it."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def isolated_root(coefficients: list[int], j: int) -> tuple[int, int]:
    """The j-th largest root, positive, as m / 2^s: m is its floor at that scale, with ROOT_BITS bits and more."""
    d = len(coefficients) - 1

    def scaled(s: int) -> list[int]:  # the polynomial whose roots are 2^s times as large
        return [c << (s * (d - k)) for k, c in enumerate(coefficients)]

    def value_sign(c: list[int], at: int) -> int:
        v = 0
        for x in reversed(c):
            v = v * at + x
        return (v > 0) - (v < 0)

    s, current = 0, coefficients
    while not _roots_above(current, 1) >= j:  # a root below one: finer scales until it is not
        s = 2 * s + 8
        current = scaled(s)
    low, high = 1, 2
    while _roots_above(current, high) >= j:
        low, high = high, 2 * high
    finer = max(0, ROOT_BITS - low.bit_length())
    s, low, high, current = s + finer, low << finer, high << finer, scaled(s + finer)
    alone = False
    above_high = _roots_above(current, high)
    while high - low > 1:  # root in (low, high]
        middle = (low + high) // 2
        if alone:
            inside = value_sign(current, middle) == sign_low
        else:
            inside = _roots_above(current, middle) >= j
        if inside:
            low = middle
        else:
            high = middle
        if not alone:
            above_low, above_high = _roots_above(current, low), _roots_above(current, high)
            alone = above_low - above_high == 1 and value_sign(current, low) != 0
            if alone:
                sign_low = value_sign(current, low)
    return (high, s) if value_sign(current, high) == 0 else (low, s)


def null_vectors(matrix: list[list[int]], root: Decimal, multiplicity: int) -> list[list[Decimal]]:
    """Orthonormal vectors that inverse iteration draws from the null space of matrix - root."""
    d = len(matrix)
    lu = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object).reshape(d, d)
    for i in range(d):
        lu[i, i] -= root
    tiny = max(max(abs(x) for x in row) for row in lu) * Decimal(10) ** (5 - PLACES) or Decimal(1)
    order = list(range(d))
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(lu[k:, k])))
        lu[[k, pivot]] = lu[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        if abs(lu[k, k]) < tiny:
            lu[k, k] = tiny
        if k + 1 < d:
            lu[k + 1:, k] /= lu[k, k]
            lu[k + 1:, k + 1:] -= np.outer(lu[k + 1:, k], lu[k, k + 1:])
    found: list[np.ndarray] = []
    for m in range(multiplicity):
        x = np.array([Decimal((i * 2654435761 + (m + 1) * 40503 * (i + 7)) % 65537 + 1) for i in range(d)], dtype=object)
        for _ in range(3):
            x = x[order]
            for i in range(1, d):
                x[i] -= lu[i, :i] @ x[:i]
            for i in range(d - 1, -1, -1):
                x[i] = (x[i] - (lu[i, i + 1:] @ x[i + 1:] if i + 1 < d else 0)) / lu[i, i]
            for v in found:
                x = x - (v @ x) * v
            x = x / (x @ x).sqrt()
        found.append(x)
    return [list(v) for v in found]


def components(spark: SparkSession, matrix: np.ndarray, count: int = COMPONENTS) -> tuple[list[Decimal], list[list[Decimal]]]:
    """The largest positive eigenvalues of a scatter matrix, falling, and unit eigenvectors; a task a root."""
    if not np.trace(matrix):
        return [], []
    polynomial = characteristic_polynomial(spark, matrix)
    zeros = next(k for k, c in enumerate(polynomial) if c)
    coefficients = [str(c) for c in polynomial[zeros:]]
    entries = [[str(x) for x in row] for row in matrix]
    wanted = min(count, len(matrix) - zeros)

    def isolated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [int(c) for c in coefficients]
        for batch in batches:
            for j in batch.column(0).to_pylist():
                m, s = isolated_root(exact, j)
                yield pa.RecordBatch.from_pydict({"j": [j], "m": [str(m)], "s": [s]})

    roots = sorted((r.j, int(r.m), r.s) for r in spark.range(1, wanted + 1, 1, wanted).mapInArrow(isolated, "j long, m string, s long").collect())
    distinct: dict[tuple[int, int], list[int]] = {}
    for j, m, s in roots:
        distinct.setdefault((m, s), []).append(j)

    def spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[int(x) for x in row] for row in entries]
        for batch in batches:
            for r in batch.to_pylist():
                with localcontext() as ctx:
                    ctx.prec = PLACES
                    vectors = null_vectors(whole, Decimal(int(r["m"])) / (1 << r["s"]), r["times"])
                yield pa.RecordBatch.from_pydict({"j": list(range(r["first"], r["first"] + r["times"])), "v": [[str(x) for x in v] for v in vectors]})

    groups = spark.createDataFrame([(js[0], len(js), str(m), s) for (m, s), js in distinct.items()], "first long, times int, m string, s long")
    found = {r.j: r.v for r in groups.repartition(len(distinct), "first").mapInArrow(spaces, "j long, v array<string>").collect()}
    with localcontext() as ctx:
        ctx.prec = PLACES
        values = [Decimal(m) / (1 << s) for _, m, s in roots]
        vectors: list[np.ndarray] = []
        for j in range(1, wanted + 1):
            v = np.array([Decimal(x) for x in found[j]], dtype=object)
            for u in vectors:
                v = v - (u @ v) * u
            vectors.append(v / (v @ v).sqrt())
    return values, [list(v) for v in vectors]


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n y - S)^2, null beyond 38 decimal digits."""
    reach = max(int(np.abs(rows).max(initial=0)), 1)
    widest = n * reach + max(abs(s) for s in sums)
    if widest * widest * len(sums) < _LONG:
        off = n * rows - np.array(sums, dtype=np.int64)
        return (off * off).sum(axis=1).tolist()
    off = rows.astype(object) * n - np.array(sums, dtype=object)
    return [x if x < 10**38 else None for x in (off * off).sum(axis=1).tolist()]


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> tuple[DataFrame, int, list[float]]:
    """A written table (id, deviation, w) of whitened vectors, the fit's n, and the share of the variance of each component."""
    spark = vectors.sparkSession
    good, d = usable(vectors, id_col, vector_col)
    schema = "id long, deviation decimal(38,0), w array<double>"
    n, sums, matrix = scatter(good, d) if d else (0, [], np.zeros((0, 0), dtype=object))
    values, axes = components(spark, matrix, count) if d else ([], [])
    if not values:
        return spark.createDataFrame([], schema), n, []
    with localcontext() as ctx:
        ctx.prec = PLACES
        # the covariance is the scatter over n^2
        weights = np.array([[float(x * n / e.sqrt()) for x in v] for v, e in zip(axes, values, strict=True)])
        shares = [float(e / int(np.trace(matrix))) for e in values]
    whole = [s // n for s in sums]
    rest = [(s - n * w) / n for s, w in zip(sums, whole, strict=True)]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, fraction = np.array(whole, dtype=object), np.array(rest)
        near = all(abs(x) < 2**40 for x in whole)
        for batch in batches:
            rows = _integers(batch, d)
            if near and len(rows) and np.abs(rows).max() < 2**52:
                centred = (rows - floor.astype(np.int64)).astype(np.float64) - fraction
            else:
                centred = (rows.astype(object) - floor).astype(np.float64) - fraction
            w = centred @ weights.T
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(_deviations(rows, n, sums), pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))], ["id", "deviation", "w"])

    return materialise(good.mapInArrow(projected, schema), "whitened"), n, shares


def identity_error(rows: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of w, centred before multiplying, less the identity."""
    w = F.col("w")
    means = rows.agg(*(F.avg(w[i]) for i in range(count))).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    entries = rows.agg(*(F.avg((w[i] - means[i]) * (w[j] - means[j])) for i, j in pairs)).first()
    return max(abs(e - (i == j)) for e, (i, j) in zip(entries, pairs, strict=True))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: (id, component, n, deviation, whitened, explained, identity_error)."""
    rows, n, shares = whitened_rows(vectors, id_col, vector_col, count)
    error = identity_error(rows, len(shares)) if shares else None
    share = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    return rows.select("id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
        F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
