"""Points, polygons and transforms; sequences of points are (shape, pos, x, y) rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _edges(points: DataFrame, closed: bool = True) -> DataFrame:
    """(shape, pos, x, y, x2, y2): every point with the next one, the last with the first."""
    w = Window.partitionBy("shape").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    if closed:
        nx, ny = F.coalesce(nx, F.first("x").over(whole)), F.coalesce(ny, F.first("y").over(whole))
    return points.select("shape", "pos", "x", "y", nx.alias("x2"), ny.alias("y2"))


def polygon_measures(points: DataFrame) -> DataFrame:
    """(shape, signed_area, area, perimeter, open_length)."""
    e = _edges(points).withColumn("last", F.row_number().over(Window.partitionBy("shape").orderBy(F.desc("pos"))) == 1)
    length = F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2)
    cross = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2
    return e.groupBy("shape").agg(
        cross.alias("signed_area"), F.abs(cross).alias("area"), F.sum(length).alias("perimeter"), F.sum(F.when(~F.col("last"), length)).alias("open_length")
    )


def is_convex(points: DataFrame) -> DataFrame:
    """(shape, convex): all turns go one way."""
    w = Window.partitionBy("shape").orderBy("pos")
    e = _edges(points)
    turned = e.withColumn("dx", F.col("x2") - F.col("x")).withColumn("dy", F.col("y2") - F.col("y"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("dx").over(w), F.first("dx").over(whole)), F.coalesce(F.lead("dy").over(w), F.first("dy").over(whole))
    cross = turned.select("shape", (F.col("dx") * ny - F.col("dy") * nx).alias("c"))
    return cross.groupBy("shape").agg(((F.min("c") >= 0) | (F.max("c") <= 0)).alias("convex"))


#: Corners of all outlines that points may be held against at once.
MOST_CORNERS = 10_000


def point_in_polygon(points: DataFrame, polygon: DataFrame) -> DataFrame:
    """(point, shape, side, distance): 1 inside, -1 outside, 0 on the edge, and the signed
    distance to the nearest edge. Takes points (point, px, py), with a shape each or to be held
    against every polygon. An outline is packed into a row; outlines for all points are a
    query set of at most MOST_CORNERS corners, more are refused."""
    packed = _edges(polygon).groupBy("shape").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "x2", "y2"))).alias("edges"))
    if "shape" in points.columns:
        met = points.join(packed, "shape")
    else:
        if polygon.limit(MOST_CORNERS + 1).count() > MOST_CORNERS:
            raise ValueError("too many outlines for all points; give the points a shape each")
        corner = lambda e: F.struct(*[F.lit(e[c]).alias(c) for c in ("pos", "x", "y", "x2", "y2")])
        outlines = [F.struct(F.lit(r["shape"]).alias("shape"), F.array(*map(corner, r["edges"])).alias("edges")) for r in packed.collect()]
        met = points.select("*", F.explode(F.array(*outlines)).alias("_s")).select(*points.columns, "_s.*") if outlines else points.withColumn("shape", F.lit(0)).join(packed, "shape")
    px, py = F.col("px"), F.col("py")

    def squared(e: Column) -> Column:
        dx, dy = e["x2"] - e["x"], e["y2"] - e["y"]
        t = F.when(dx * dx + dy * dy > 0, ((px - e["x"]) * dx + (py - e["y"]) * dy) / (dx * dx + dy * dy)).otherwise(0.0)
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return (px - e["x"] - t * dx) ** 2 + (py - e["y"] - t * dy) ** 2

    def crosses(e: Column) -> Column:
        spans = (e["y"] > py) != (e["y2"] > py)
        at = e["x"] + (py - e["y"]) * (e["x2"] - e["x"]) / F.nullif(e["y2"] - e["y"], F.lit(0.0))
        return F.coalesce(spans & (px < at), F.lit(False))

    distance = F.sqrt(F.array_min(F.transform("edges", squared)))
    inside = F.size(F.filter("edges", crosses)) % 2 == 1
    side = F.when(distance < 1e-9, 0).when(inside, 1).otherwise(-1)
    return met.select("point", "shape", side.alias("side"), (distance * side).alias("distance"))


def fitted_line(px: DataFrame) -> DataFrame:
    """(image, vx, vy, x0, y0): the least-squares line through the non-zero pixels, from
    their sums; the direction has vx >= 0, and is null where no direction is best, as for one
    pixel or a square."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    s = px.filter("v <> 0").groupBy("image").agg(F.avg(x).alias("x0"), F.avg(y).alias("y0"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"))
    sxx, syy, sxy = F.col("xx") - F.col("x0") ** 2, F.col("yy") - F.col("y0") ** 2, F.col("xy") - F.col("x0") * F.col("y0")
    # Rounded, so that what is equal but for its sums' last digits has no direction; never -0.
    across, apart = F.round(2 * sxy, 9) + 0.0, F.round(sxx - syy, 9) + 0.0
    angle = F.when((across != 0) | (apart != 0), 0.5 * F.atan2(across, apart))
    return s.select("image", F.cos(angle).alias("vx"), F.sin(angle).alias("vy"), "x0", "y0")


def affine_from_points(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> np.ndarray:
    """The 2x3 matrix that takes three points to three others."""
    a = np.hstack([np.asarray(src, float), np.ones((3, 1))])
    return np.linalg.solve(a, np.asarray(dst, float)).T


def inverse_affine(m: np.ndarray) -> np.ndarray:
    inverse = np.linalg.inv(m[:, :2])
    return np.hstack([inverse, -inverse @ m[:, 2:]])


def rotation(centre: tuple[float, float], degrees: float, scale: float = 1.0) -> np.ndarray:
    """Rotation about a centre, counter-clockwise with y pointing down."""
    a, b = scale * np.cos(np.radians(degrees)), scale * np.sin(np.radians(degrees))
    cx, cy = centre
    return np.array([[a, b, (1 - a) * cx - b * cy], [-b, a, b * cx + (1 - a) * cy]])


def perspective_from_points(src: list[tuple[float, float]], dst: list[tuple[float, float]]) -> np.ndarray:
    """The 3x3 matrix that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def moved(df: DataFrame, matrix: np.ndarray, x: str = "x", y: str = "y") -> DataFrame:
    """Points under a 2x3 or 3x3 matrix, as new columns tx and ty."""
    m = [[float(v) for v in row] for row in matrix]

    def line(r: list[float]) -> Column:
        return r[0] * F.col(x) + r[1] * F.col(y) + r[2]

    w = line(m[2]) if len(m) == 3 else F.lit(1.0)
    return df.withColumn("tx", line(m[0]) / w).withColumn("ty", line(m[1]) / w)


def projected(df: DataFrame, camera: np.ndarray) -> DataFrame:
    """Pixels (u, v) of points (x, y, z) under a 3x4 camera matrix."""
    r = [sum((float(c) * F.col(k) for c, k in zip(row[:3], "xyz", strict=True)), F.lit(float(row[3]))) for row in camera]
    return df.withColumn("u", r[0] / r[2]).withColumn("v", r[1] / r[2])


def triangulated(df: DataFrame, camera1: np.ndarray, camera2: np.ndarray) -> DataFrame:
    """(point, x, y, z) from the pixels (u1, v1), (u2, v2) of two cameras, by the least
    singular vector of each point's equations, a batch at a time."""
    p, q = np.asarray(camera1, float), np.asarray(camera2, float)

    def solve(frames):
        for f in frames:
            if not len(f):
                continue
            a = np.stack(
                [
                    f["u1"].to_numpy()[:, None] * p[2] - p[0],
                    f["v1"].to_numpy()[:, None] * p[2] - p[1],
                    f["u2"].to_numpy()[:, None] * q[2] - q[0],
                    f["v2"].to_numpy()[:, None] * q[2] - q[1],
                ],
                axis=1,
            )
            x = np.linalg.svd(a)[2][:, -1, :]
            x = x[:, :3] / x[:, 3:]
            yield pd.DataFrame({"point": f["point"], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    kind = df.schema["point"].dataType.simpleString()
    return df.select("point", "u1", "v1", "u2", "v2").mapInPandas(solve, f"point {kind}, x double, y double, z double")


def _eight_points(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The matrix of rank two with q' F p least, from points brought to their mean and spread."""

    def brought(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = x.mean(axis=0)
        scale = np.sqrt(2) / max(np.hypot(*(x - centre).T).mean(), 1e-12)
        m = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
        return np.hstack([x, np.ones((len(x), 1))]) @ m.T, m

    (a, ma), (b, mb) = brought(p), brought(q)
    f = np.linalg.svd(np.einsum("ni,nj->nij", b, a).reshape(len(a), 9))[2][-1].reshape(3, 3)
    u, d, vt = np.linalg.svd(f)
    return mb.T @ (u * [d[0], d[1], 0]) @ vt @ ma


def fundamental(left: np.ndarray, right: np.ndarray, draws: int = 200, seed: int = 42) -> np.ndarray:
    """The fundamental matrix F, right' F left = 0, of eight or more point pairs.

    Of matrices through eight drawn pairs the one with the least median distance of points to
    their lines is taken; the pairs that are near to their lines then give the result.
    """
    p, q = np.asarray(left, float), np.asarray(right, float)
    if len(p) < 8:
        raise ValueError("eight point pairs are needed")
    ones = np.ones((len(p), 1))
    hp, hq = np.hstack([p, ones]), np.hstack([q, ones])

    def away(f: np.ndarray) -> np.ndarray:
        lines, back = hp @ f.T, hq @ f
        off = (hq * lines).sum(axis=1) ** 2
        return off / np.maximum((lines[:, :2] ** 2).sum(axis=1), 1e-12) + off / np.maximum((back[:, :2] ** 2).sum(axis=1), 1e-12)

    rng = np.random.default_rng(seed)
    found = [_eight_points(p[i], q[i]) for i in (rng.permutation(len(p))[:8] for _ in range(draws if len(p) > 8 else 1))]
    best = min(found, key=lambda f: np.median(away(f)))
    spread = 1.4826 * (1 + 5 / max(len(p) - 8, 1)) * np.sqrt(np.median(away(best)))
    near = away(best) <= max(2.5 * spread, 1e-9) ** 2
    f = _eight_points(p[near], q[near]) if near.sum() >= 8 else best
    return f / np.linalg.norm(f)


def rectifying(k_left: np.ndarray, k_right: np.ndarray, rotation_: np.ndarray, translation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 3x3 matrices under which two cameras' images have common rows; a point x of the
    left camera's space is R x + t in the right one's."""
    centre = -np.asarray(rotation_, float).T @ np.asarray(translation, float)
    x = centre / np.linalg.norm(centre)
    y = np.cross([0.0, 0.0, 1.0], x)
    y /= np.linalg.norm(y)
    common = np.stack([x, y, np.cross(x, y)])
    k = (np.asarray(k_left, float) + np.asarray(k_right, float)) / 2
    return k @ common @ np.linalg.inv(k_left), k @ common @ np.linalg.inv(np.asarray(k_right) @ rotation_)


def essential(fundamental: np.ndarray, k_left: np.ndarray, k_right: np.ndarray) -> np.ndarray:
    """The essential matrix of a fundamental matrix and two cameras' inner matrices."""
    return np.asarray(k_right).T @ np.asarray(fundamental) @ np.asarray(k_left)


def decomposed_essential(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two rotations and the direction of translation that an essential matrix allows."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return u @ w @ vt, u @ w.T @ vt, u[:, 2]


def even_frames(n: int, k: int = 6) -> list[int]:
    """k frame numbers evenly spread from the first to the last."""
    return [int(i) for i in np.linspace(0, n - 1, k)] if n else []


def convex_hull(points: DataFrame) -> DataFrame:
    """(shape, pos, x, y) of the hull, counter-clockwise from the least point.

    Each batch first gives the hull of its own points of a shape, so that a shape of any
    size comes down to a few points before one task joins them.
    """

    def chain(p: np.ndarray) -> np.ndarray:
        p = np.unique(p, axis=0)
        if len(p) < 3:
            return p

        def turn(a, b, c) -> float:
            return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

        def half(q):
            out: list = []
            for c in q:
                while len(out) > 1 and turn(out[-2], out[-1], c) <= 0:
                    out.pop()
                out.append(c)
            return out

        return np.array(half(p)[:-1] + half(p[::-1])[:-1])

    kind = points.schema["shape"].dataType.simpleString()

    def local(frames):
        for f in frames:
            for s, g in f.groupby("shape"):
                h = chain(g[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({"shape": s, "x": h[:, 0], "y": h[:, 1]})

    def join(f: pd.DataFrame) -> pd.DataFrame:
        h = chain(f[["x", "y"]].to_numpy(float))
        return pd.DataFrame({"shape": f["shape"].iloc[0], "pos": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    few = points.select("shape", "x", "y").mapInPandas(local, f"shape {kind}, x double, y double")
    return few.groupBy("shape").applyInPandas(join, f"shape {kind}, pos int, x double, y double")


def simplified_shapes(points: DataFrame, tolerance: float) -> DataFrame:
    """(shape, pos, x, y): the chains of all shapes, thinned as by ``simplified``."""
    kind = points.schema["shape"].dataType.simpleString()

    def thin(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        kept = simplified(list(zip(f["x"], f["y"], strict=True)), tolerance)
        return pd.DataFrame({"shape": f["shape"].iloc[0], "pos": range(len(kept)), "x": [x for x, _ in kept], "y": [y for _, y in kept]})

    return points.select("shape", "pos", "x", "y").groupBy("shape").applyInPandas(thin, f"shape {kind}, pos int, x double, y double")


def fitted_ellipses(points: DataFrame) -> DataFrame:
    """(shape, cx, cy, width, height, angle): the least-squares ellipse of every shape, null
    where its points determine none."""
    kind = points.schema["shape"].dataType.simpleString()

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        try:
            with np.errstate(invalid="raise", divide="raise"):
                e = fitted_ellipse(f[["x", "y"]].to_numpy(float)) if len(f) > 4 else (None,) * 5
        except (np.linalg.LinAlgError, FloatingPointError):
            e = (None,) * 5
        return pd.DataFrame([(f["shape"].iloc[0], *e)], columns=["shape", "cx", "cy", "width", "height", "angle"])

    return points.select("shape", "x", "y").groupBy("shape").applyInPandas(fit, f"shape {kind}, cx double, cy double, width double, height double, angle double")


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A chain of points thinned so that none left out is farther from it than the tolerance."""
    if len(points) < 3:
        return points
    p = np.asarray(points, float)
    a, b = p[0], p[-1]
    d = b - a
    length = np.hypot(*d)
    away = np.abs(d[0] * (a[1] - p[:, 1]) - (a[0] - p[:, 0]) * d[1]) / length if length else np.hypot(*(p - a).T)
    k = int(away.argmax())
    if away[k] <= tolerance:
        return [points[0], points[-1]]
    return simplified(points[: k + 1], tolerance)[:-1] + simplified(points[k:], tolerance)


def fitted_ellipse(points: np.ndarray) -> tuple[float, float, float, float, float]:
    """Centre, axes and angle in degrees of the least-squares ellipse through points."""
    x, y = points[:, 0] - points[:, 0].mean(), points[:, 1] - points[:, 1].mean()
    d = np.stack([x * x, x * y, y * y, x, y], axis=1)
    a, b, c, e, f = np.linalg.lstsq(d, np.ones(len(x)), rcond=None)[0]
    m = np.array([[a, b / 2], [b / 2, c]])
    centre = np.linalg.solve(-2 * m, [e, f])
    scale = 1 + centre @ m @ centre
    values, vectors = np.linalg.eigh(m / scale)
    angle = float(np.degrees(np.arctan2(vectors[1, 0], vectors[0, 0])) % 180)
    cx, cy = centre + [points[:, 0].mean(), points[:, 1].mean()]
    return float(cx), float(cy), float(2 / np.sqrt(values[0])), float(2 / np.sqrt(values[1])), angle
