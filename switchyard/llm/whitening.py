"""Whitening of embeddings: principal directions by a bidiagonal qd solver.

Entries are put on a grid (``floor(256 c)``), and each distinct grid vector is
fitted once.  Centred rows are reduced block by block to triangular factors
(QR), and these to one; Householder reflections make it bidiagonal; the dqds
algorithm finds its singular values, the small ones as accurately as the
large; a twisted factorisation at each wanted value gives its direction.  No
covariance matrix is formed on the way.

Null vectors and vectors with null or non-finite entries take no part, nor do
empty ones.  Vectors of another length are a space of their own.  Rows are
returned as often as they occur; a repeated vector counts once in the fit.
A direction without variance (rounding left out) has no whitened value: null,
as is ``identity_error`` where no direction has any.  ``deviation`` is null
where it exceeds a long.  An empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import hypot, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

GRID = 256
FAN_IN = 8  # triangular factors reduced to one at a time
EPS = np.finfo(float).eps
TINY = 1e-290
HELD = 1 << 24  # entries of factors that a task holds before it hands them on


# ------------------------------------------------------------------ small matrices

def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor V of ``a = U B V'`` (square), by Householder reflections."""
    a = np.array(a, dtype=float)
    n = len(a)
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        top = np.abs(x).max()
        if top == 0:
            return x, 0.0
        u = x / top
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        return u, 2.0 / (u @ u)

    for k in range(n):
        u, beta = reflector(a[k:, k])
        if beta:
            a[k:, k:] -= np.outer(beta * u, u @ a[k:, k:])
        if k < n - 2:
            u, beta = reflector(a[k, k + 1:])
            if beta:
                a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ u, beta * u)
                v[:, k + 1:] -= np.outer(v[:, k + 1:] @ u, beta * u)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds step; None if the shift exceeds the least value."""
    out_q, out_e = [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    least = d
    for k in range(len(e)):
        if d < 0:
            return None
        out_q[k] = d + e[k]
        ratio = q[k + 1] / out_q[k] if out_q[k] > TINY else 0.0
        out_e[k] = e[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    if d < 0:
        return None
    out_q[-1] = d
    return out_q, out_e, least


def qd_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an unreduced bidiagonal matrix, greatest first, by dqds."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    q, e = [(x / scale) ** 2 for x in diagonal], [(x / scale) ** 2 for x in above]
    found: list[float] = []
    total, shift = 0.0, 0.0  # ``total``: shifts so far, subtracted from every value still to come
    while q:
        n = len(q)
        if n == 1 or e[-1] <= EPS * EPS * (total + q[-1]):
            found.append(total + q.pop())
            e = e[:-1]
            shift = 0.0
            continue
        cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * total), None)
        if cut is not None:  # the matrix falls apart: each part by itself, from the shift on
            for part in (slice(cut + 1, n), slice(0, cut + 1)):
                found += [total + x for x in qd_values(np.sqrt(q[part]), np.sqrt(e[part.start:part.stop - 1]))]
            break
        if q[0] < 1.5 * q[-1] and q[0] < q[-1]:  # graded the wrong way: turned about, the values are the same
            q, e = q[::-1], e[::-1]
        while (got := _transformed(q, e, shift)) is None:
            shift = shift / 4 if shift > EPS * total * EPS else 0.0
        total += shift
        q, e, least = got
        # the smaller value of the last two rows, a little below
        mid, half = (q[-2] + q[-1] + e[-1]) / 2, hypot((q[-2] - q[-1] + e[-1]) / 2, sqrt(q[-1] * e[-1]))
        shift = max(0.0, min(least, q[-2] * q[-1] / (mid + half) if mid + half > 0 else 0.0)) * (1 - 4 * EPS)
    return np.sort(found)[::-1] * scale * scale


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of ``B'B - value``: top-down multipliers, bottom-up multipliers, and the pivot at each twist."""
    n = len(a)
    floor = EPS * EPS * max(value, TINY)
    down, up = np.zeros(n), np.zeros(n)  # multipliers between k and k + 1
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + a[k] * a[k]
        pivot = pivot if abs(pivot) > floor else -floor
        down[k] = a[k] * b[k] / pivot
        s[k + 1] = down[k] * (b[k] / a[k]) * s[k] - value
    p[-1] = a[-1] * a[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = b[k] * b[k] + p[k + 1]
        pivot = pivot if abs(pivot) > floor else -floor
        up[k] = a[k] * b[k] / pivot
        p[k] = p[k + 1] * (a[k] * a[k] / pivot) - value
    return down, up, s + p + value


def _from_twist(down: np.ndarray, up: np.ndarray, twist: int) -> np.ndarray:
    z = np.zeros(len(down))
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, len(z) - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def qd_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors (columns) of an unreduced bidiagonal matrix at squared singular ``values``, greatest first.

    The twist with the smallest pivot gives the vector.  Within a cluster of
    close values the next twists give further ones, made orthogonal to those
    before.
    """
    a = np.where(np.abs(a) > 1e-150, a, 1e-150)
    scale = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a, b, values = a / scale, b / scale, values / scale / scale
    out = np.zeros((len(a), len(values)))
    for j, value in enumerate(values):
        down, up, pivots = _twisted(a, b, value)
        near = [i for i in range(j) if values[i] - value <= 1e-3 * values[i]]
        best, kept = None, -1.0
        for twist in np.argsort(np.abs(pivots))[:1 + 2 * len(near)]:
            z = _from_twist(down, up, int(twist))
            for _ in range(2):  # twice is enough
                z = z - out[:, near] @ (out[:, near].T @ z)
                size = np.linalg.norm(z)
                if size < 1e-8:
                    break
                z /= size
            left = np.linalg.norm(_times(a, b, z) - value * z) if size >= 1e-8 else np.inf
            if best is None or left < kept:
                best, kept = z, left
            if left <= 64 * EPS * values[0]:
                break
        out[:, j] = best
    return out


def _times(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``B'B z``."""
    y = a * z
    y[:-1] += b * z[1:]
    out = a * y
    out[1:] += b * y[:-1]
    return out


def directions(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r``, greatest first, and the first ``wanted`` right singular vectors as rows."""
    n = r.shape[1]
    square = np.zeros((n, n))
    square[:len(r)] = r[:n]
    a, b, v = bidiagonal(square)
    negligible = np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:])) / 8
    edges = [0, *(np.flatnonzero(negligible) + 1), n]
    found: list[tuple[float, int, int, int]] = []
    for first, last in zip(edges, edges[1:]):
        values = qd_values(a[first:last], b[first:last - 1])
        found += [(float(x), first, last, k) for k, x in enumerate(values)]
    found.sort(key=lambda f: (-f[0], f[1], f[3]))
    rows = np.zeros((min(wanted, n), n))
    for first, last in {(f[1], f[2]) for f in found[:wanted]}:  # a part's vectors lie in the part
        mine = [(i, f[3], f[0]) for i, f in enumerate(found[:wanted]) if f[1] == first]
        upto = max(k for _, k, _ in mine) + 1
        values = np.array([f[0] for f in found if f[1] == first][:upto])
        z = qd_vectors(a[first:last], b[first:last - 1], values)
        for i, k, _ in mine:
            rows[i] = v[:, first:last] @ z[:, k]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), TINY)
    return np.array([f[0] for f in found]), rows


# ------------------------------------------------------------------ on Spark

def gridded(vector: Column) -> Column:
    """``floor(256 c)`` of every entry, as longs."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * float(GRID)))


def _usable(vector: Column) -> Column:
    good = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def _centred(x: Column, means: Column, n: Column) -> Column:
    """``x - S / n``, where a mean is ``whole + part / n``: the whole part is taken off exactly."""
    return F.zip_with(x, means, lambda a, m: F.coalesce(F.try_subtract(a, m["whole"]).cast("double"), a.cast("double") - m["whole"]) - m["part"] / n)


def _deviation(x: Column, means: Column, n: Column) -> Column:
    """The sum of ``(n x - S)^2``, exact; null beyond a long."""
    away = F.zip_with(x, means, lambda a, m: F.try_subtract(F.try_multiply(n, F.try_subtract(a, m["whole"])), m["part"]))
    return F.aggregate(away, F.lit(0).cast("long"), lambda done, a: F.try_add(done, F.try_multiply(a, a)))


def _projected(centred: Column, model_rows: Column, values: Column) -> Column:
    """The whitened values; null where a direction has no variance."""
    def dot(row: Column) -> Column:
        return F.aggregate(F.zip_with(centred, row, lambda a, b: a * b), F.lit(0.0), lambda done, a: done + a)
    return F.zip_with(model_rows, values, lambda row, value: dot(row) / F.sqrt(value))


def means_of(listed: DataFrame) -> DataFrame:
    """For each length of the vectors ``x``: ``size``, ``n`` and the ``means`` as (``whole``, ``part`` of ``n``), exact."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby(frame["x"].map(len)):
                x = np.array(part["x"].tolist(), dtype=np.int64)
                small = max(int(x.max()), -int(x.min())) < (1 << 62) // len(x)
                sums = (x if small else x.astype(object)).sum(axis=0)
                yield pd.DataFrame({"size": int(size), "rows": len(x), "place": np.arange(size), "part": [str(t) for t in sums]})

    parts = listed.select("x").mapInPandas(summed, "size int, rows long, place int, part string")
    totals = parts.groupBy("size", "place").agg(F.sum("rows").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    part = F.pmod("s", F.col("n").cast("decimal(38,0)"))
    split = totals.select("size", "place", "n", part.cast("long").alias("part"), F.expr("(s - pmod(s, cast(n as decimal(38,0)))) div n").alias("whole"))
    by_place = F.transform(F.array_sort(F.collect_list(F.struct("place", "whole", "part"))), lambda t: F.struct(t["whole"].alias("whole"), t["part"].alias("part")))
    return split.groupBy("size", "n").agg(by_place.alias("means"))


def factors_of(centred: DataFrame) -> DataFrame:
    """One triangular factor (``size``, ``row``, ``r``) for each length of the rows (``size``, ``c``)."""

    def factor(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for size, part in frame.groupby("size"):
                rows = np.array(part["c"].tolist())
                held[size] = np.linalg.qr(np.vstack([held[size], rows]) if size in held else rows, mode="r")
            if sum(r.size for r in held.values()) > HELD:
                yield from handed(held)
        yield from handed(held)

    def handed(held: dict[int, np.ndarray]) -> Iterator[pd.DataFrame]:
        while held:
            size, r = held.popitem()
            yield pd.DataFrame({"size": size, "row": range(len(r)), "r": list(r)})

    def merged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.array(frame["r"].tolist()), mode="r")
        return pd.DataFrame({"size": key[0], "part": key[1], "row": range(len(r)), "r": list(r)})

    out = centred.mapInPandas(factor, "size int, row int, r array<double>").withColumn("part", F.spark_partition_id().cast("long"))
    out = written(out, "whitening-factors")
    last = out.agg(F.max("part")).first()[0]
    while last is not None:
        out = out.groupBy("size", F.floor(F.col("part") / FAN_IN)).applyInPandas(merged, "size int, part long, row int, r array<double>")
        out, last = written(out, "whitening-factors"), last // FAN_IN or None
    return out


def fit(vectors: DataFrame, components: int) -> DataFrame:
    """For each length of the grid vectors ``x``: ``size``, ``n``, ``means``, ``trace``, ``values``, ``rows`` and ``identity_error``.

    ``rows`` are the unit directions, ``values`` their variances, null where
    there is none.  A length's factor is a square matrix of that length,
    whatever the number of rows.
    """
    listed = written(vectors.select("x").distinct().withColumn("size", F.size("x")), "whitening-list")  # every vector once
    means = written(means_of(listed), "whitening-means")
    centred = listed.join(means, "size").select("size", _centred(F.col("x"), F.col("means"), F.col("n")).alias("c"))

    def solved(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r, n = np.array(frame["r"].tolist()), int(frame["n"].iloc[0])
        values, rows = directions(r, components)
        rounding = 16 * (len(values) * EPS) ** 2 * values[0]
        return pd.DataFrame({"size": [key[0]], "trace": float((r * r).sum()) / n, "rows": [rows.tolist()],
                             "values": [[v / n if v > rounding else None for v in values[:components]]]})

    models = (factors_of(centred).join(means.select("size", "n"), "size").groupBy("size")
              .applyInPandas(solved, "size int, trace double, rows array<array<double>>, values array<double>"))
    models = written(models.join(means, "size"), "whitening-models")

    w = _projected(_centred(F.col("x"), F.col("means"), F.col("n")), F.col("rows"), F.col("values"))
    spread = listed.join(models, "size").select("size", "n", w.alias("w"))
    one = [F.get("w", F.lit(i)) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    sums = spread.groupBy("size", "n").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(one)], *[F.sum(one[i] * one[j]).alias(f"s{i}_{j}") for i, j in pairs])
    off = [F.abs(F.col(f"s{i}_{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * F.col(f"s{j}") / F.col("n") - float(i == j)) for i, j in pairs]
    return models.join(sums.select("size", F.array_max(F.array(*off)).alias("identity_error")), "size")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """Every vector on the first ``components`` principal directions, scaled to unit variance.

    Returns the id, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(_usable(F.col("v"))).select("id", gridded(F.col("v")).alias("x"))
    models = written(fit(rows, components), "whitening-fit")
    met = rows.withColumn("size", F.size("x")).join(models, "size")
    w = _projected(_centred(F.col("x"), F.col("means"), F.col("n")), F.col("rows"), F.col("values"))
    met = met.select("id", "n", _deviation(F.col("x"), F.col("means"), F.col("n")).alias("deviation"), "trace", "identity_error",
                     F.posexplode(F.arrays_zip(w.alias("w"), "values")).alias("place", "c"))
    return met.select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), "n", "deviation", F.col("c.w").alias("whitened"),
                      F.when(F.col("trace") > 0, F.coalesce("c.values", F.lit(0.0)) / F.col("trace")).alias("explained"), "identity_error")
