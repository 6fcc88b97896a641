"""Operators on pixel grids held as rows (image, y, x, v) or, before they are spread out,
as rasters: one row (image, w, v) per image with the array of its pixels.

Stencils (filters, medians, gradients, morphology) work on rasters, many images of one size at
a time in numpy, since a neighbourhood never leaves its image: nothing is shuffled. Given pixel
rows, they first gather each image, which moves every pixel once. Missing neighbours at the
border are left out (``border="drop"``) or mirrored without repeating the edge
(``border="reflect"``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder

KEYS = ["image", "y", "x"]
SQUARE = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
SOBEL_X = {(dy, dx): float(dx * (2 - abs(dy))) for dy, dx in SQUARE}
SOBEL_Y = {(dy, dx): float(dy * (2 - abs(dx))) for dy, dx in SQUARE}


def grid(df: DataFrame, key: str, array: str, width: int = 8, levels: int | None = None) -> DataFrame:
    """An array column as a grid; with ``levels`` values from -1 to 1 become whole numbers."""
    v = F.col("v").cast("double")
    scaled = v if levels is None else F.least(F.greatest(F.floor((v + 1) / 2 * levels), F.lit(0)), F.lit(levels - 1)).cast("int")
    cells = df.select(F.col(key).alias("image"), F.posexplode(array).alias("pos", "v"))
    return cells.select("image", F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), scaled.alias("v"))


def shape(height: int, width: int, inside: Column) -> DataFrame:
    """A drawn shape: 1 where the predicate over y and x holds."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    cells = spark.range(height * width).select(F.lit(0).alias("image"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    return cells.withColumn("v", inside.cast("int"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value from 0 to 1, of channels from 0 to 1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == r, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    return F.when(hue < 0, hue + 360).otherwise(hue), F.when(top > 0, span / top).otherwise(0.0), top


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* of sRGB channels from 0 to 1, white point D65."""

    def linear(c: Column) -> Column:
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92)

    def bent(c: Column) -> Column:
        return F.when(c > 0.008856, F.pow(c, 1 / 3)).otherwise(7.787 * c + 16 / 116)

    lr, lg, lb = linear(r), linear(g), linear(b)
    fx = bent((0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456)
    fy = bent(0.212671 * lr + 0.715160 * lg + 0.072169 * lb)
    fz = bent((0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def equalised(px: DataFrame, top: int = 255) -> DataFrame:
    """Histogram equalisation: the running share of each value, from the least one used."""
    hist = px.groupBy("image", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image")
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cdf = hist.withColumn("cdf", F.sum("n").over(run)).withColumn("total", F.sum("n").over(w))
    cdf = cdf.withColumn("low", F.min("cdf").over(w))
    lut = cdf.select("image", "v", F.when(F.col("total") > F.col("low"), F.round(top * (F.col("cdf") - F.col("low")) / (F.col("total") - F.col("low")))).otherwise(F.col("v")).cast("int").alias("equalised"))
    return px.join(lut, ["image", "v"]).select(*KEYS, F.col("equalised").alias("v"))


def gamma(v: Column, exponent: float = 1.5, top: int = 255) -> Column:
    """Gamma curve, cut to whole numbers."""
    return F.floor(top * F.pow(v / top, exponent)).cast("int")


def min_max(px: DataFrame, top: float = 255.0) -> DataFrame:
    w = Window.partitionBy("image")
    low, high = F.min("v").over(w), F.max("v").over(w)
    return px.select(*KEYS, F.when(high > low, top * (F.col("v") - low) / (high - low)).otherwise(0.0).alias("v"))


def neighbours(px: DataFrame, offsets: Iterable[tuple[int, int]], border: str = "drop", size: tuple[int, int] = (8, 8)) -> DataFrame:
    """(image, y, x, dy, dx, v): for every place the values at its offsets.

    Each pixel is copied to the places it serves: one shuffle on (image, y, x) follows in
    whatever aggregates the result, and no join is needed.
    """
    offsets = list(offsets)
    h, w = size
    if border == "drop":
        out = px.withColumn("o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])))
        moved = out.select("image", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "o.dy", "o.dx", "v")
        return moved.filter(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    reach = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    places = px.select("image", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    # The mirrored copies of a pixel: itself and, near an edge, its images beyond it.
    ys = F.array_distinct(F.filter(F.array(F.col("sy"), -F.col("sy"), 2 * (h - 1) - F.col("sy")), lambda i: i.between(-reach, h - 1 + reach)))
    xs = F.array_distinct(F.filter(F.array(F.col("sx"), -F.col("sx"), 2 * (w - 1) - F.col("sx")), lambda i: i.between(-reach, w - 1 + reach)))
    wide = places.withColumn("py", F.explode(ys)).withColumn("px", F.explode(xs))
    out = wide.withColumn("o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])))
    moved = out.select("image", (F.col("py") - F.col("o.dy")).alias("y"), (F.col("px") - F.col("o.dx")).alias("x"), "o.dy", "o.dx", "v")
    return moved.filter(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))


def rasters(df: DataFrame, key: str, array: str, width: int = 8, levels: int | None = None) -> DataFrame:
    """An array column as rasters; values as in ``grid``."""
    scaled = lambda v: v.cast("double") if levels is None else F.least(F.greatest(F.floor((v.cast("double") + 1) / 2 * levels), F.lit(0)), F.lit(levels - 1)).cast("double")
    return df.select(F.col(key).alias("image"), F.lit(width).alias("w"), F.transform(array, scaled).alias("v"))


def gathered(px: DataFrame) -> DataFrame:
    """Pixel rows as rasters; an image is bounded by its size and has all its pixels."""
    cells = F.sort_array(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v"))))
    return px.groupBy("image").agg((F.max("x") + 1).cast("int").alias("w"), F.transform(cells, lambda c: c["v"]).alias("v"))


def pixel_rows(images: DataFrame, **kinds: str) -> DataFrame:
    """Rasters as pixel rows, with the named arrays and their types."""
    kinds = kinds or {"v": "double"}
    cells = images.select("image", "w", F.posexplode(F.arrays_zip(*kinds)).alias("pos", "c"))
    place = [F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x")]
    return cells.select("image", *place, *[F.col(f"c.{n}").cast(kind).alias(n) for n, kind in kinds.items()])


def stencil(images: DataFrame, work: Callable[[np.ndarray], dict[str, np.ndarray]], *names: str) -> DataFrame:
    """Rasters (image, w, names) of what ``work`` makes of stacks of images of one size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = frame["v"].map(len)
            for (w, n), part in frame.groupby(["w", lengths]):
                if n:
                    made = work(np.stack(part["v"].to_numpy()).reshape(len(part), n // w, w))
                    yield pd.DataFrame({"image": part["image"], "w": w, **{k: list(made[k].reshape(len(part), -1)) for k in names}})

    kind = images.schema["image"].dataType.simpleString()
    return images.filter("v is not null").mapInPandas(run, f"image {kind}, w int, " + ", ".join(f"{k} array<double>" for k in names))


def around(stack: np.ndarray, offsets: Iterable[tuple[int, int]], border: str = "drop") -> np.ndarray:
    """For every offset the stack of images moved by it; NaN beyond a border that drops."""
    offsets = list(offsets)
    ry, rx = max(abs(dy) for dy, _ in offsets), max(abs(dx) for _, dx in offsets)
    reach, (h, w) = ((0, 0), (ry, ry), (rx, rx)), stack.shape[1:]
    wide = np.pad(stack, reach, mode="reflect") if border == "reflect" else np.pad(stack, reach, constant_values=np.nan)
    return np.stack([wide[:, ry + dy : ry + dy + h, rx + dx : rx + dx + w] for dy, dx in offsets])


def _square(reach: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]


def _as_rasters(px: DataFrame) -> DataFrame:
    return px if "w" in px.columns else gathered(px)


def filtered(px: DataFrame, kernel: dict[tuple[int, int], float], border: str = "drop") -> DataFrame:
    """Correlation with a kernel given as weights by offset (not flipped)."""
    weights = np.array(list(kernel.values()))[:, None, None, None]
    return pixel_rows(stencil(_as_rasters(px), lambda g: {"v": np.nansum(around(g, kernel, border) * weights, axis=0)}, "v"))


def median(px: DataFrame, reach: int = 1, border: str = "drop") -> DataFrame:
    return pixel_rows(stencil(_as_rasters(px), lambda g: {"v": np.nanmedian(around(g, _square(reach), border), axis=0)}, "v"))


def gaussian_kernel(size: int = 5, sigma: float | None = None) -> dict[tuple[int, int], float]:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    half = size // 2
    line = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma**2))
    line /= line.sum()
    return {(y - half, x - half): float(line[y] * line[x]) for y in range(size) for x in range(size)}


def unsharp_kernel(size: int = 11, alpha: float = 2.0) -> dict[tuple[int, int], float]:
    """The image sharpened by its difference from a smoothed one; the weights add up to 1."""
    k = {o: -alpha * g for o, g in gaussian_kernel(size).items()}
    k[0, 0] += 1 + alpha
    return k


def gabor_kernel(size: int = 21, sigma: float = 5, theta: float = 1, wavelength: float = 10, aspect: float = 1, phase: float = 0) -> dict[tuple[int, int], float]:
    """A wave under a bell, divided by its length."""
    half = size // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    xr, yr = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
    g = np.exp(-(xr**2 + (aspect * yr) ** 2) / (2 * sigma**2)) * np.cos(2 * np.pi * xr / wavelength + phase)
    g /= np.linalg.norm(g)
    return {(i - half, j - half): float(g[i, j]) for i in range(size) for j in range(size)}


def sobel(px: DataFrame, border: str = "drop") -> DataFrame:
    """(image, y, x, gx, gy, magnitude) from one pass over the neighbours."""
    wx, wy = (np.array([k[o] for o in SQUARE])[:, None, None, None] for k in (SOBEL_X, SOBEL_Y))

    def work(g: np.ndarray) -> dict[str, np.ndarray]:
        near = around(g, SQUARE, border)
        gx, gy = np.nansum(near * wx, axis=0), np.nansum(near * wy, axis=0)
        return {"gx": gx, "gy": gy, "magnitude": np.hypot(gx, gy)}

    return pixel_rows(stencil(_as_rasters(px), work, "gx", "gy", "magnitude"), gx="double", gy="double", magnitude="double")


def bilateral(px: DataFrame, reach: int = 4, sigma_value: float = 75.0, sigma_space: float = 75.0, border: str = "drop") -> DataFrame:
    """Means weighted by nearness in place and in value."""
    disc = [(dy, dx) for dy, dx in _square(reach) if dy * dy + dx * dx <= reach * reach]
    apart = np.array([dy * dy + dx * dx for dy, dx in disc])[:, None, None, None]

    def work(g: np.ndarray) -> dict[str, np.ndarray]:
        near = around(g, disc, border)
        weight = np.exp(-apart / (2 * sigma_space**2) - (near - g) ** 2 / (2 * sigma_value**2))
        return {"v": np.nansum(weight * near, axis=0) / np.nansum(weight, axis=0)}

    return pixel_rows(stencil(_as_rasters(px), work, "v"))


def threshold(v: Column, above: float, high: int = 1) -> Column:
    return F.when(v > above, high).otherwise(0)


def adaptive_threshold(px: DataFrame, block: int = 11, minus: float = 10, high: int = 255, inverted: bool = True, border: str = "drop") -> DataFrame:
    """Above (or, inverted, not above) the mean of the block around less ``minus``."""

    def work(g: np.ndarray) -> dict[str, np.ndarray]:
        over = g > np.nanmean(around(g, _square(block // 2), border), axis=0) - minus
        return {"v": np.where(~over if inverted else over, float(high), 0.0)}

    return pixel_rows(stencil(_as_rasters(px), work, "v"), v="int")


def otsu(px: DataFrame) -> DataFrame:
    """(image, level): the level whose two classes differ most; of equal ones the least."""
    hist = px.groupBy("image", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image")
    run = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.select("image", "v", F.sum("n").over(run).alias("n0"), F.sum(F.col("n") * F.col("v")).over(run).alias("s0"), F.sum("n").over(w).alias("n"), F.sum(F.col("n") * F.col("v")).over(w).alias("s"))
    n1 = F.col("n") - F.col("n0")
    between = F.when(n1 > 0, F.col("n0") * n1 * (F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / n1) ** 2).otherwise(0.0)
    return h.withColumn("b", F.round(between, 6)).groupBy("image").agg(F.max_by("v", F.struct("b", -F.col("v"))).alias("level"))


def morphology(px: DataFrame, step: str, offsets: list[tuple[int, int]] | None = None, times: int = 1, kind: str = "int") -> DataFrame:
    """erode, dilate, open, close or gradient with a set of offsets; what lies beyond the
    border has no say."""
    offsets = offsets or SQUARE
    least = lambda g: np.nanmin(around(g, offsets), axis=0)
    most = lambda g: np.nanmax(around(g, offsets), axis=0)
    steps = {"erode": [least], "dilate": [most], "open": [least, most], "close": [most, least]}
    if step != "gradient" and step not in steps:
        raise ValueError(step)

    def work(g: np.ndarray) -> dict[str, np.ndarray]:
        out = []
        for way in [[most], [least]] if step == "gradient" else [steps[step]]:
            now = g
            for f in way:
                for _ in range(times):
                    now = f(now)
            out.append(now)
        return {"v": out[0] - out[1] if len(out) > 1 else out[0]}

    return pixel_rows(stencil(_as_rasters(px), work, "v"), v=kind)


CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def components(px: DataFrame, size: tuple[int, int] = (8, 8), most_rounds: int = 64, offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """(image, y, x, label): the connected set of a non-zero pixel, by its least position;
    8-connected, or connected by the given offsets.

    Labels spread to neighbours and jump to their label's label, so that long sets settle in
    few rounds; each round is written to the checkpoint folder.
    """
    checkpoint_folder(px.sparkSession)
    width = size[1]
    now = px.filter("v <> 0").select(*KEYS, (F.col("y") * width + F.col("x")).alias("v")).checkpoint()
    for _ in range(most_rounds):
        near = neighbours(now, [*(offsets or SQUARE), (0, 0)], "drop", size).groupBy(*KEYS).agg(F.min("v").alias("m"))
        spread = now.join(near, KEYS).select(*KEYS, F.col("v").alias("old"), F.least("v", "m").alias("v"))
        root = spread.select(F.col("image").alias("ri"), (F.col("y") * width + F.col("x")).alias("p"), F.col("v").alias("r"))
        met = spread.join(root, (F.col("image") == F.col("ri")) & (F.col("v") == F.col("p")))
        jumped = met.select(*KEYS, "old", F.least("v", "r").alias("v")).checkpoint()
        changed = not jumped.filter("old <> v").isEmpty()
        now = jumped.select(*KEYS, "v")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.withColumnRenamed("v", "label")


def component_stats(labels: DataFrame) -> DataFrame:
    """Box, area and centre of every component."""
    return labels.groupBy("image", "label").agg(
        F.min("x").alias("left"),
        F.min("y").alias("top"),
        (F.max("x") - F.min("x") + 1).alias("width"),
        (F.max("y") - F.min("y") + 1).alias("height"),
        F.count("*").alias("area"),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
    )


def boundary(px: DataFrame, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """Non-zero pixels with a zero neighbour, or at the border, in the four main directions."""
    near = neighbours(px, CROSS, "drop", size).groupBy(*KEYS).agg(F.min("v").alias("least"), F.count("*").alias("n"))
    return px.filter("v <> 0").join(near, KEYS).filter("least = 0 or n < 4").select(*KEYS)


def contours(px: DataFrame, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """(image, y, x, label, hole): the contour pixels of every component. ``hole`` is null on
    the outer contour, else the label of the enclosed background that the pixel borders."""
    h, w = size
    sets = components(px, size)
    ground = components(px.withColumn("v", F.when(F.col("v") == 0, 1).otherwise(0)), size, offsets=CROSS)
    outside = ground.filter(F.col("y").isin(0, h - 1) | F.col("x").isin(0, w - 1)).select("image", F.col("label").alias("v")).distinct()
    enclosed = ground.withColumnRenamed("label", "v").join(outside, ["image", "v"], "left_anti").select(*KEYS, "v")
    open_ground = ground.withColumnRenamed("label", "v").join(outside, ["image", "v"], "left_semi").select(*KEYS, "v")
    inner = neighbours(enclosed, CROSS, "drop", size).select(*KEYS, F.col("v").alias("hole"))
    outer = neighbours(open_ground, CROSS, "drop", size).select(*KEYS, F.lit(None).cast("int").alias("hole"))
    rim = sets.filter(F.col("y").isin(0, h - 1) | F.col("x").isin(0, w - 1)).select(*KEYS, F.lit(None).cast("int").alias("hole"))
    return sets.join(inner.union(outer).union(rim).distinct(), KEYS).select(*KEYS, "label", "hole")


def contour_tree(px: DataFrame, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """(image, label, hole, parent): every component with the hole it stands in, and every hole
    with the component around it; null where the open ground is around.

    The first pixel of a set in reading order has on its left a pixel of what is around it.
    """
    h, w = size
    sets = components(px, size).withColumn("hole", F.lit(False))
    ground = components(px.withColumn("v", F.when(F.col("v") == 0, 1).otherwise(0)), size, offsets=CROSS).withColumn("hole", F.lit(True))
    outside = ground.filter(F.col("y").isin(0, h - 1) | F.col("x").isin(0, w - 1)).select("image", "label").distinct()
    enclosed = ground.join(outside, ["image", "label"], "left_anti").select(*KEYS, "label", "hole")
    every = sets.unionByName(enclosed)
    first = every.groupBy("image", "label", "hole").agg(F.min(F.col("y") * w + F.col("x")).alias("p"))
    beside = first.select("image", "label", "hole", F.floor(F.col("p") / w).cast("int").alias("y"), (F.col("p") % w - 1).cast("int").alias("x"))
    around_it = every.select(*KEYS, F.col("label").alias("parent"))
    return beside.join(around_it, KEYS, "left").select("image", "label", "hole", "parent")


def traced(px: DataFrame) -> DataFrame:
    """(image, label, pos, y, x): the outer contour of every component as a closed path, from
    its first pixel in reading order, clockwise; a pixel on a spur comes more than once."""
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]

    def follow(inside: set, first: tuple[int, int]) -> list[tuple[int, int]]:
        path, at, back = [first], first, 0
        second = None
        while True:
            for turn in range(1, 9):
                k = (back + turn) % 8
                near = (at[0] + ring[k][0], at[1] + ring[k][1])
                if near in inside:
                    break
            else:
                return path
            if at == first and near == second:
                return path[:-1]
            second = second or near
            path.append(near)
            # The search goes on from the pixel that was looked at before this one.
            before = ring[(k - 1) % 8]
            back = ring.index((at[0] + before[0] - near[0], at[1] + before[1] - near[1]))
            at = near

    def trace(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, part in frame.groupby("label"):
            pixels = sorted(zip(part["y"].tolist(), part["x"].tolist(), strict=True))
            out += [(frame["image"].iloc[0], label, n, y, x) for n, (y, x) in enumerate(follow(set(pixels), pixels[0]))]
        return pd.DataFrame(out, columns=["image", "label", "pos", "y", "x"])

    return components(px).groupBy("image").applyInPandas(trace, "image long, label int, pos int, y int, x int")


def picked_components(stats: DataFrame, k: int, least_area: int, seed: int = 42) -> DataFrame:
    """Up to k components of each image with enough area, in a random order that the seed
    and the labels determine."""
    from .ranking import first_n

    hashed = stats.filter(F.col("area") >= least_area).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("image").cast("string"), F.col("label").cast("string"))))
    return first_n(hashed, ["image"], ["_h"], k).drop("_h", "pos")


def moments(px: DataFrame) -> DataFrame:
    """Raw moments to second order, the centre, and the slant mu11 / mu02 where it is defined."""
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col("v").cast("double")
    m = px.groupBy("image").agg(*[F.sum(v * F.pow(x, F.lit(p)) * F.pow(y, F.lit(q))).alias(f"m{p}{q}") for p, q in ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2))])
    mu11 = F.col("m11") - F.col("m10") * F.col("m01") / F.col("m00")
    mu02 = F.col("m02") - F.col("m01") ** 2 / F.col("m00")
    return m.withColumns({
        "cx": F.when(F.col("m00") != 0, F.col("m10") / F.col("m00")),
        "cy": F.when(F.col("m00") != 0, F.col("m01") / F.col("m00")),
        "skew": F.when((F.col("m00") != 0) & (F.abs(mu02) > 1e-3), mu11 / mu02).otherwise(0.0),
    })


def distance_transform(px: DataFrame) -> DataFrame:
    """Distance of every pixel to the nearest zero pixel of its image, by columns then rows.

    The nearest zero within each column is found first; a pixel then looks at one value per
    column, so an image costs its pixels times its width rather than its pixels squared.
    """
    up = Window.partitionBy("image", "x").orderBy("y")
    zero = F.when(F.col("v") == 0, F.col("y"))
    above = F.last(zero, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(zero, ignorenulls=True).over(up.rowsBetween(0, Window.unboundedFollowing))
    columns = px.select(*KEYS, F.least(F.col("y") - above, below - F.col("y")).alias("g")).filter("g is not null")
    other = columns.select("image", "y", F.col("x").alias("ox"), "g")
    near = px.join(other, ["image", "y"]).groupBy(*KEYS).agg(F.min((F.col("x") - F.col("ox")) ** 2 + F.col("g") ** 2).alias("d2"))
    return near.select(*KEYS, F.sqrt("d2").alias("distance"))


def resized(px: DataFrame, factor: int) -> DataFrame:
    """Means over squares of ``factor`` pixels."""
    return px.groupBy("image", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("v").alias("v"))


def resized_linear(px: DataFrame, height: int, width: int) -> DataFrame:
    """Images brought to a size by bilinear mixing between pixel centres; edges are repeated."""

    def work(g: np.ndarray) -> dict[str, np.ndarray]:
        def axis(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
            low = np.minimum(np.floor(at).astype(int), n - 1)
            return low, np.minimum(low + 1, n - 1), at - low

        y0, y1, fy = axis(g.shape[1], height)
        x0, x1, fx = axis(g.shape[2], width)
        rows = g[:, y0] * (1 - fy)[:, None] + g[:, y1] * fy[:, None]
        return {"v": rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx}

    return pixel_rows(stencil(_as_rasters(px), work, "v").withColumn("w", F.lit(width)))


def deskewed(px: DataFrame) -> DataFrame:
    """Images sheared upright by their slant mu11 / mu02 about the middle row; what comes from
    beyond the border is 0, an image without a slant stays as it is."""

    def work(stack: np.ndarray) -> dict[str, np.ndarray]:
        h, w = stack.shape[1:]
        y, x = np.indices((h, w))
        out = np.empty_like(stack)
        for i, g in enumerate(stack):
            total = g.sum()
            cx, cy = ((g * x).sum() / total, (g * y).sum() / total) if total else (0.0, 0.0)
            mu11, mu02 = (g * (x - cx) * (y - cy)).sum(), (g * (y - cy) ** 2).sum()
            if abs(mu02) <= 1e-3:
                out[i] = g
                continue
            skew = mu11 / mu02
            at = x + skew * (y - 0.5 * h)
            low = np.floor(at).astype(int)
            pick = lambda j, g=g: np.where((j >= 0) & (j < w), np.take_along_axis(g, np.clip(j, 0, w - 1), axis=1), 0.0)
            out[i] = pick(low) * (1 - at + low) + pick(low + 1) * (at - low)
        return {"v": out}

    return pixel_rows(stencil(_as_rasters(px), work, "v"))


def tiles(px: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel with the number of its tile and its place there."""
    return px.select("image", F.floor(F.col("y") / height).cast("int").alias("tile_y"), F.floor(F.col("x") / width).cast("int").alias("tile_x"), (F.col("y") % height).alias("y"), (F.col("x") % width).alias("x"), "v")


def _per_image(px: DataFrame, work, schema: str) -> DataFrame:
    """One numpy grid per image; an image is bounded by its size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((frame["y"].max() + 1, frame["x"].max() + 1))
        g[frame["y"], frame["x"]] = frame["v"]
        return work(frame["image"].iloc[0], g)

    return px.groupBy("image").applyInPandas(run, schema)


def _cells(image, *grids: np.ndarray, names: tuple[str, ...]) -> pd.DataFrame:
    y, x = np.indices(grids[0].shape)
    return pd.DataFrame({"image": image, "y": y.ravel(), "x": x.ravel(), **{n: g.ravel() for n, g in zip(names, grids, strict=True)}})


def dft(px: DataFrame, shifted: bool = True) -> DataFrame:
    """(image, y, x, re, im, log_magnitude) of the discrete Fourier transform."""

    def work(image, g: np.ndarray) -> pd.DataFrame:
        f = np.fft.fft2(g)
        f = np.fft.fftshift(f) if shifted else f
        return _cells(image, f.real, f.imag, np.log1p(np.abs(f)), names=("re", "im", "log_magnitude"))

    return _per_image(px, work, "image long, y int, x int, re double, im double, log_magnitude double")


def frequency_filtered(px: DataFrame, shape_: str = "circle", reach: float = 30, low: bool = True) -> DataFrame:
    """The image after keeping the frequencies within (or beyond) a square or circle."""

    def work(image, g: np.ndarray) -> pd.DataFrame:
        f = np.fft.fftshift(np.fft.fft2(g))
        y, x = np.indices(g.shape)
        dy, dx = y - g.shape[0] // 2, x - g.shape[1] // 2
        inside = dy**2 + dx**2 <= reach**2 if shape_ == "circle" else (abs(dy) <= reach) & (abs(dx) <= reach)
        kept = np.fft.ifft2(np.fft.ifftshift(f * (inside if low else ~inside)))
        return _cells(image, kept.real, names=("v",))

    return _per_image(px, work, "image long, y int, x int, v double")


def remapped(px: DataFrame, map_x: Column, map_y: Column, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """Values at computed places, by bilinear mixing of the four pixels around; beyond the
    border the edge is repeated."""
    h, w = size
    at = px.select(*KEYS, map_x.cast("double").alias("sx"), map_y.cast("double").alias("sy"))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = at.withColumn("c", corners)
    fy, fx = F.floor("sy"), F.floor("sx")
    part = at.select(
        *KEYS,
        F.least(F.greatest(fy + F.col("c.i"), F.lit(0)), F.lit(h - 1)).cast("int").alias("py"),
        F.least(F.greatest(fx + F.col("c.j"), F.lit(0)), F.lit(w - 1)).cast("int").alias("px"),
        (F.when(F.col("c.i") == 1, F.col("sy") - fy).otherwise(1 - F.col("sy") + fy) * F.when(F.col("c.j") == 1, F.col("sx") - fx).otherwise(1 - F.col("sx") + fx)).alias("k"),
    )
    source = px.select(F.col("image").alias("si"), F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    met = part.join(source, (F.col("image") == F.col("si")) & (F.col("py") == F.col("sy")) & (F.col("px") == F.col("sx")))
    return met.groupBy(*KEYS).agg(F.sum(F.col("k") * F.col("v")).alias("v"))


def hog(px: DataFrame, cell: int = 10, bins: int = 9, size: tuple[int, int] = (20, 20)) -> DataFrame:
    """(image, cell_y, cell_x, bin, weight): gradient magnitudes by unsigned direction,
    each image's vector divided by its length."""
    g = sobel(px, "reflect")
    angle = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0))
    b = F.least(F.floor(angle / (180 / bins)), F.lit(bins - 1)).cast("int")
    h = g.groupBy("image", F.floor(F.col("y") / cell).cast("int").alias("cell_y"), F.floor(F.col("x") / cell).cast("int").alias("cell_x"), b.alias("bin")).agg(F.sum("magnitude").alias("weight"))
    length = F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy("image")))
    return h.withColumn("weight", F.when(length > 0, F.col("weight") / length).otherwise(0.0))


def canny(px: DataFrame, high: float = 200, low: float = 100, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """Edge pixels: local gradient maxima above ``high``, or above ``low`` and linked to such."""
    g = sobel(px, "reflect").withColumn("v", F.col("magnitude"))
    sector = F.pmod(F.round(F.degrees(F.atan2("gy", "gx")) / 45), F.lit(4))
    near = neighbours(g.select(*KEYS, "v"), [o for o in SQUARE if o != (0, 0)], "drop", size)
    ahead = {0: (0, 1), 1: (1, 1), 2: (1, 0), 3: (1, -1)}
    mine = near.join(g.select(*KEYS, sector.cast("int").alias("s")), KEYS)
    along = F.lit(False)
    for s, (dy, dx) in ahead.items():
        on_line = ((F.col("dy") == dy) & (F.col("dx") == dx)) | ((F.col("dy") == -dy) & (F.col("dx") == -dx))
        along = along | ((F.col("s") == s) & on_line)
    best = mine.filter(along).groupBy(*KEYS).agg(F.max("v").alias("m"))
    thin = g.join(best, KEYS, "left").filter((F.col("v") >= F.coalesce("m", F.lit(0.0))) & (F.col("v") >= low)).select(*KEYS, F.col("magnitude"), F.lit(1).alias("v"))
    sets = components(thin.select(*KEYS, "v"), size)
    strong = thin.filter(F.col("magnitude") >= high).join(sets, KEYS).select("image", "label").distinct()
    return sets.join(strong, ["image", "label"], "left_semi").select(*KEYS)


def hough_lines(edges: DataFrame, angles: int = 180, least: int = 100) -> DataFrame:
    """(image, theta, rho, votes) of the lines with enough edge pixels."""
    theta = F.explode(F.transform(F.sequence(F.lit(0), F.lit(angles - 1)), lambda i: i * F.lit(np.pi / angles)))
    votes = edges.withColumn("theta", theta)
    rho = F.round(F.col("x") * F.cos("theta") + F.col("y") * F.sin("theta")).cast("int")
    return votes.groupBy("image", "theta", rho.alias("rho")).agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def hough_segments(edges: DataFrame, angles: int = 180, least: int = 10, length: float = 5, gap: float = 2) -> DataFrame:
    """(image, theta, rho, x1, y1, x2, y2): runs of edge pixels along the lines that enough of
    them vote for, no two of a run's neighbours farther apart than ``gap`` along the line, and
    the run at least ``length`` long."""
    theta = F.explode(F.transform(F.sequence(F.lit(0), F.lit(angles - 1)), lambda i: i * F.lit(np.pi / angles)))
    on = edges.select(*KEYS, theta.alias("theta"))
    rho = F.round(F.col("x") * F.cos("theta") + F.col("y") * F.sin("theta")).cast("int")
    along = F.col("y") * F.cos("theta") - F.col("x") * F.sin("theta")
    line = ["image", "theta", "rho"]
    on = on.withColumn("rho", rho).withColumn("t", along)
    voted = on.groupBy(*line).agg(F.count("*").alias("votes")).filter(F.col("votes") >= least).drop("votes")
    w = Window.partitionBy(*line).orderBy("t", "y", "x")
    runs = on.join(voted, line).withColumn("begins", F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0))
    runs = runs.withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.groupBy(*line, "run").agg(F.min(F.struct("t", "x", "y")).alias("a"), F.max(F.struct("t", "x", "y")).alias("b"))
    return ends.filter(F.col("b.t") - F.col("a.t") >= length).select(*line, *[F.col(f"{p}.{c}").alias(f"{c}{n}") for n, p in ((1, "a"), (2, "b")) for c in "xy"])


def hough_circles(edges: DataFrame, radii: list[int], angles: int = 72, least: int = 30) -> DataFrame:
    """(image, y, x, radius, votes) of the circle centres on which enough edge pixels agree;
    a pixel votes once for a centre."""
    steps = F.array(*[F.struct(F.lit(r).alias("radius"), F.lit(float(r * np.sin(2 * np.pi * i / angles))).alias("sy"), F.lit(float(r * np.cos(2 * np.pi * i / angles))).alias("sx")) for r in radii for i in range(angles)])
    voted = edges.withColumn("s", F.explode(steps)).select(
        "image", F.col("y").alias("ey"), F.col("x").alias("ex"), "s.radius", F.round(F.col("y") - F.col("s.sy")).cast("int").alias("y"), F.round(F.col("x") - F.col("s.sx")).cast("int").alias("x")
    )
    return voted.distinct().groupBy(*KEYS, "radius").agg(F.count("*").alias("votes")).filter(F.col("votes") >= least)


def disparity(left: DataFrame, right: DataFrame, most: int = 32, reach: int = 2, size: tuple[int, int] = (8, 8)) -> DataFrame:
    """(image, y, x, disparity): the shift whose blocks differ least, of equal ones the least."""
    shifted = right.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).select("image", "y", (F.col("x") + F.col("d")).alias("x"), "d", F.col("v").alias("w"))
    costs = left.join(shifted, KEYS).select(*KEYS, "d", F.abs(F.col("v") - F.col("w")).alias("v"))
    square = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    out = costs.withColumn("o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in square])))
    moved = out.select("image", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "d", "v")
    inside = moved.filter(F.col("y").between(0, size[0] - 1) & F.col("x").between(0, size[1] - 1))
    sad = inside.groupBy(*KEYS, "d").agg(F.avg("v").alias("c"))
    return sad.groupBy(*KEYS).agg(F.min_by("d", F.struct(F.round("c", 9), F.col("d"))).alias("disparity"))


def semi_global_disparity(left: DataFrame, right: DataFrame, most: int = 32, small: float = 8.0, large: float = 32.0) -> DataFrame:
    """(image, y, x, disparity) of rasters: the shifts that differ least along four ways through
    the image, where a step of one costs ``small`` and any other change ``large``."""

    def gone(cost: np.ndarray) -> np.ndarray:
        """Costs summed along the first axis from its start."""
        out = np.empty_like(cost)
        out[0] = cost[0]
        for i in range(1, len(cost)):
            before = out[i - 1]
            least = before.min(axis=-1, keepdims=True)
            up = np.pad(before[..., :-1], ((0, 0), (1, 0)), constant_values=np.inf) + small
            down = np.pad(before[..., 1:], ((0, 0), (0, 1)), constant_values=np.inf) + small
            out[i] = cost[i] + np.minimum.reduce([before, up, down, np.broadcast_to(least + large, before.shape)]) - least
        return out

    def match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h, w = a.shape
        cost = np.full((h, w, min(most, w)), 255.0)
        for d in range(cost.shape[2]):
            cost[:, d:, d] = np.abs(a[:, d:] - b[:, : w - d])
        across = cost.transpose(1, 0, 2)
        total = gone(cost) + gone(cost[::-1])[::-1] + (gone(across) + gone(across[::-1])[::-1]).transpose(1, 0, 2)
        return total.argmin(axis=2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            grids = [match(np.asarray(a).reshape(-1, w), np.asarray(b).reshape(-1, w)).ravel().astype(float) for w, a, b in zip(frame["w"], frame["v"], frame["other"], strict=True)]
            yield pd.DataFrame({"image": frame["image"], "w": frame["w"], "disparity": pd.Series(grids, index=frame.index, dtype=object)})

    kind = left.schema["image"].dataType.simpleString()
    both = _as_rasters(left).join(_as_rasters(right).select("image", F.col("v").alias("other")), "image")
    return pixel_rows(both.mapInPandas(run, f"image {kind}, w int, disparity array<double>"), disparity="int")
