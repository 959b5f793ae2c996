"""Sequential fitting of outlines, one ring or line a row: grouped-map kernels over Arrow, heaviest work spread by key.

These have no relational form. A line is one unit of work; its points come together once, and results do not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    square = float(d @ d)
    t = np.clip((p - a) @ d / square, 0, 1) if square else np.zeros(len(p))
    return np.hypot(*(p - (a + t[:, None] * d)).T)


def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices that Ramer, Douglas and Peucker's method keeps; an explicit stack, so length is no limit."""
    keep = np.zeros(len(p), bool)
    if len(p):
        keep[[0, -1]] = True
    stack = [(0, len(p) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        d = _distance(p[i + 1 : j], p[i], p[j])
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.flatnonzero(keep)


def simplify(points: DataFrame, tolerance: float, key: str = "line_id") -> DataFrame:
    """key, seq, px, py of the kept points."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seq")
        return df.iloc[simplified(df[["px", "py"]].to_numpy(float), tolerance)]

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "seq", "px", "py").groupBy(key).applyInPandas(run, f"{key} {kind}, seq {points.schema['seq'].dataType.simpleString()}, px double, py double")


def walk_rings(edges: np.ndarray) -> list[np.ndarray]:
    """Closed rings of directed lattice steps (ax, ay, bx, by), each from its smallest corner; at a crossing the walk turns right, so diagonal ink stays apart."""
    after: dict[tuple, list] = {}
    for ax, ay, bx, by in sorted(map(tuple, edges.tolist())):
        after.setdefault((ax, ay), []).append((bx, by))
    rings = []
    for start in sorted(after):
        while after[start]:
            ring, at = [start], after[start].pop(0)
            before = start
            while at != start:
                ring.append(at)
                ways = after[at]
                dx, dy = at[0] - before[0], at[1] - before[1]
                right = (at[0] - dy, at[1] + dx)
                before, at = at, ways.pop(ways.index(right) if right in ways else 0)
            rings.append(np.array(ring, float))
    return rings


def rings(edges: DataFrame) -> DataFrame:
    """image_id, ring, area, length, points (x0, y0, x1, y1, ...; straight runs as one) from crack edges."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, ring in enumerate(walk_rings(df[["ax", "ay", "bx", "by"]].to_numpy())):
            x, y = ring.T
            area = float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)
            turn = (np.roll(x, 1) + np.roll(x, -1) != 2 * x) | (np.roll(y, 1) + np.roll(y, -1) != 2 * y)
            out.append((df["image_id"].iloc[0], i, area, len(ring), ring[turn].ravel()))
        return pd.DataFrame(out, columns=["image_id", "ring", "area", "length", "points"])

    return edges.groupBy("image_id").applyInPandas(run, "image_id long, ring int, area double, length long, points array<double>")


def fit_cubics(p: np.ndarray, tolerance: float) -> list[np.ndarray]:
    """Cubic Bezier pieces (4 x 2) through an open line, by least squares with end tangents (Schneider 1990); pieces split at their worst point."""

    def tangent(a: np.ndarray) -> np.ndarray:
        n = np.hypot(*a)
        return a / n if n else a

    out: list[np.ndarray] = []
    stack = [(0, len(p) - 1, tangent(p[1] - p[0]), tangent(p[-2] - p[-1]))] if len(p) > 1 else []
    while stack:
        i, j, t0, t1 = stack.pop()
        q = p[i : j + 1]
        u = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(q, axis=0).T))])
        chord = u[-1]
        if j - i < 2 or chord == 0:
            out.append(np.array([q[0], q[0] + t0 * chord / 3, q[-1] + t1 * chord / 3, q[-1]]))
            continue
        u = u / chord
        for _ in range(4):
            b = np.stack([(1 - u) ** 3, 3 * u * (1 - u) ** 2, 3 * u**2 * (1 - u), u**3], axis=1)
            a0, a1 = b[:, 1:2] * t0, b[:, 2:3] * t1
            rest = q - (b[:, :1] + b[:, 1:2]) * q[0] - (b[:, 2:3] + b[:, 3:]) * q[-1]
            m = np.array([[(a0 * a0).sum(), (a0 * a1).sum()], [(a0 * a1).sum(), (a1 * a1).sum()]])
            v = np.array([(a0 * rest).sum(), (a1 * rest).sum()])
            det = m[0, 0] * m[1, 1] - m[0, 1] ** 2
            s = np.array([v[0] * m[1, 1] - v[1] * m[0, 1], v[1] * m[0, 0] - v[0] * m[0, 1]]) / det if abs(det) > 1e-12 else np.full(2, chord / 3)
            s = np.where(s > 1e-6 * chord, s, chord / 3)
            c = np.array([q[0], q[0] + t0 * s[0], q[-1] + t1 * s[1], q[-1]])
            at = b @ c
            d1 = 3 * np.stack([(1 - u) ** 2, 2 * u * (1 - u), u**2], axis=1) @ np.diff(c, axis=0)
            d2 = 6 * np.stack([1 - u, u], axis=1) @ np.diff(c, 2, axis=0)
            top, low = ((at - q) * d1).sum(axis=1), (d1 * d1).sum(axis=1) + ((at - q) * d2).sum(axis=1)
            off = np.hypot(*(at - q).T)
            if off.max() <= tolerance:
                break
            u = np.clip(u - np.where(np.abs(low) > 1e-12, top / np.where(low == 0, 1, low), 0), 0, 1)
        if off.max() <= tolerance:
            out.append(c)
            continue
        k = i + min(max(1, int(np.argmax(off))), j - i - 1)
        mid = tangent(p[k - 1] - p[k + 1])
        stack += [(k, j, -mid, t1), (i, k, t0, mid)]
    return out


def fit_curves(points: DataFrame, tolerance: float, key: str = "line_id") -> DataFrame:
    """key, piece, c (eight numbers): cubic pieces of every line, in order."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seq")
        pieces = fit_cubics(df[["px", "py"]].to_numpy(float), tolerance)
        return pd.DataFrame({key: df[key].iloc[:1].repeat(len(pieces)).to_numpy(), "piece": range(len(pieces)), "c": [c.ravel() for c in pieces]})

    return points.select(key, "seq", "px", "py").groupBy(key).applyInPandas(run, f"{key} {points.schema[key].dataType.simpleString()}, piece int, c array<double>")


def linear_gradient(gray: DataFrame) -> DataFrame:
    """image_id, gx, gy, c, r2: least-squares plane through the values of each image; sums in one aggregation."""
    x, y, v = F.col("x"), F.col("y"), F.col("g")
    m = gray.groupBy("image_id").agg(
        F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), F.covar_pop(x, v).alias("xv"), F.covar_pop(y, v).alias("yv"), F.var_pop(v).alias("vv"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(v).alias("mv")
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    m = m.filter(F.abs(det) > 1e-9).withColumn("gx", (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / det).withColumn("gy", (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / det)
    r2 = F.when(F.col("vv") > 0, (F.col("gx") * F.col("xv") + F.col("gy") * F.col("yv")) / F.col("vv")).otherwise(1.0)
    return m.select("image_id", "gx", "gy", (F.col("mv") - F.col("gx") * F.col("mx") - F.col("gy") * F.col("my")).alias("c"), r2.alias("r2"))
