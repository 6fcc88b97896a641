"""Ranking, search, metrics, pixels and shapes against plain statements."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import clustering, finetune, geometry, metrics, pixels, ranking, retrieval


def test_numbered_spreads_a_hot_group(spark):
    rows = [("hot" if i % 3 else None, i * 7 % 5003) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, id int")
    got = {(r["g"], r["id"]): r["pos"] for r in ranking.numbered(df, ["g"], "id", ranking.by_id("id", 64)).collect()}
    for g in ("hot", None):
        ids = sorted(i for x, i in rows if x == g)
        assert all(got[g, i] == n for n, i in enumerate(ids, 1))
    assert ranking.numbered(df.limit(0), ["g"], "id", ranking.by_id("id")).count() == 0


def test_percentages_of_nothing(spark):
    empty = spark.createDataFrame([], "c string")
    assert [(r["n"], r["pct"]) for r in ranking.percentages(empty, "c", ["a", "b"]).collect()] == [(0, 0.0), (0, 0.0)]


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_top_k(spark, metric):
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (200, 4)).astype(float)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(200)] + [(900, None)], "id int, v array<double>").repartition(5)
    queries = df.filter("id % 20 = 0")
    got = {}
    for r in retrieval.top_k(df, queries, "id", "v", 3, metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for q in range(0, 200, 20):
        score = -(m @ m[q]) if metric == "ip" else ((m - m[q]) ** 2).sum(1)
        assert [got[q][k] for k in (1, 2, 3)] == sorted(range(200), key=lambda i: (score[i], i))[:3]
    few = retrieval.top_k(df.filter("id < 2"), queries, "id", "v", 3, metric)
    assert few.filter("query_id = 0").count() == 2
    assert retrieval.top_k(df, queries.limit(0), "id", "v").count() == 0


def test_top_k_in_passes_and_by_words(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(-2, 3, (300, 5)).astype(float)
    df = spark.createDataFrame([(f"k{i:03d}", m[i].tolist()) for i in range(300)], "id string, v array<double>").repartition(3)
    whole = sorted(map(tuple, retrieval.top_k(df, df, "id", "v", 4, exclude_self=True).collect()))
    parts = sorted(map(tuple, retrieval.top_k(df, df, "id", "v", 4, exclude_self=True, pass_bytes=40 * 70).collect()))
    assert whole == parts and len(whole) == 1200
    for i in (0, 17, 299):
        score = m @ m[i]
        assert [r[1] for r in sorted((r for r in whole if r[0] == f"k{i:03d}"), key=lambda r: r[3])] == [f"k{j:03d}" for j in sorted((j for j in range(300) if j != i), key=lambda j: (-score[j], j))[:4]]


def test_lookup_and_leaks(spark):
    asked = spark.createDataFrame([(1, " 물음 "), (2, "모름"), (3, None)], "k int, q string")
    table = spark.createDataFrame([("물음", "a", 1), ("물음 ", "b", 2)], "q string, type string, pos int")
    got = {r["k"]: r["type_of"] for r in retrieval.lookup(asked, F.col("q"), table, "q", "type", "pos", "type_of").collect()}
    assert got == {1: "b", 2: "", 3: ""}
    long = "가" * 70
    chunks = spark.createDataFrame([(1, "  " + long + "나"), (2, "다른 글"), (3, "")], "k int, text string")
    held = spark.createDataFrame([(long,), (None,), ("짧음",)], "answer string")
    assert {r["k"] for r in retrieval.without_leaks(chunks, "text", held, {"answer": (100, 30)}).collect()} == {2, 3}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_rouge(spark):
    rng = random.Random(4)
    pairs = [(" ".join(rng.choices("abcdef", k=rng.randint(0, 12))), " ".join(rng.choices("abcdef", k=rng.randint(0, 12)))) for _ in range(80)] + [(None, "a"), ("", "")]
    df = spark.createDataFrame(pairs, "p string, g string")
    rows = df.select("p", "g", metrics.rouge_l(F.col("p"), F.col("g")).alias("x"), metrics.rouge_l_short(F.col("p"), F.col("g")).alias("y")).collect()
    for r in rows:
        a, b = (r["g"] or "").split(), (r["p"] or "").split()
        n = lcs(a, b)
        assert r["x"] == r["y"] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0, abs=6e-5)
    assert metrics.lcs_length(list("abcbdab") * 50, list("bdcaba") * 50) == lcs(list("abcbdab") * 50, list("bdcaba") * 50)


def test_null_aware_means(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", float("nan")), ("a", None), ("b", None)], "m string, x double")
    assert {r["m"]: (r["n"], r["x"]) for r in metrics.present_means(df, ["m"], ["x"]).collect()} == {"a": (3, 0.5), "b": (1, None)}
    assert metrics.present_means(df, ["m"], ["x"], only_with_values=True).count() == 1
    assert metrics.null_rates(df, ["x"]).first()["flagged"]


def test_splits_hold_in_any_layout(spark):
    df = spark.range(4000)
    part = lambda d: {r["id"]: r["s"] for r in d.select("id", finetune.split_by_hash(F.col("id")).alias("s")).collect()}
    a = part(df)
    assert a == part(df.repartition(7)) and 0.03 < sum(v == "valid" for v in a.values()) / 4000 < 0.07
    places = [r["place"] for r in finetune.permuted(df, "id").orderBy("id").collect()]
    assert sorted(places) == list(range(1, 4001)) and places != sorted(places)
    share = df.select(finetune.weighted_choice(F.col("id"), {"x": 3, "y": 1}).alias("c")).groupBy("c").count().collect()
    assert abs({r["c"]: r["count"] for r in share}["x"] / 4000 - 0.75) < 0.03


def image(spark, g):
    return spark.createDataFrame([(1, int(y), int(x), float(g[y, x])) for y in range(g.shape[0]) for x in range(g.shape[1])], "image long, y int, x int, v double")


def as_grid(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


def test_pixels_equal_numpy(spark):
    g = np.random.default_rng(5).integers(0, 255, (8, 8)).astype(float)
    px, padded = image(spark, g), np.pad(g, 1, mode="reflect")
    kernel = {o: float(i) for i, o in enumerate(pixels.SQUARE)}
    want = sum(k * padded[1 + dy : 9 + dy, 1 + dx : 9 + dx] for (dy, dx), k in kernel.items())
    assert np.allclose(as_grid(pixels.filtered(px, kernel, "reflect"), (8, 8)), want)
    s = pixels.sobel(px, "reflect")
    gx = sum(dx * (2 - abs(dy)) * padded[1 + dy : 9 + dy, 1 + dx : 9 + dx] for dy, dx in pixels.SQUARE)
    assert np.allclose(as_grid(s, (8, 8), "gx"), gx)
    f = np.fft.fftshift(np.fft.fft2(g))
    assert np.allclose(as_grid(pixels.dft(px), (8, 8), "re"), f.real) and np.allclose(as_grid(pixels.dft(px), (8, 8), "im"), f.imag)
    assert np.allclose(as_grid(pixels.frequency_filtered(px, reach=99), (8, 8)), g)
    assert np.isclose(sum(pixels.unsharp_kernel().values()), 1) and np.isclose(sum(v * v for v in pixels.gabor_kernel().values()), 1)
    shifted = pixels.remapped(px, F.col("x") + 0.5, F.col("y") * 1.0)
    want = (g + np.pad(g, ((0, 0), (0, 1)), mode="edge")[:, 1:]) / 2
    assert np.allclose(as_grid(shifted, (8, 8)), want)
    smooth = as_grid(pixels.bilateral(px, 2), (8, 8))
    assert smooth.min() >= g.min() and smooth.std() < g.std()


def test_distance_and_components(spark):
    g = np.ones((3, 3))
    g[1, 1] = 0
    d = as_grid(pixels.distance_transform(image(spark, g)), (3, 3), "distance")
    assert d[0, 0] == pytest.approx(2**0.5) and d[0, 1] == 1 and d[1, 1] == 0
    b = np.zeros((8, 8))
    b[0, :] = b[:, 7] = b[7, 1:] = 1
    b[3, 3] = b[4, 2] = 1
    stats = sorted((r["area"], r["left"], r["top"]) for r in pixels.component_stats(pixels.components(image(spark, b))).collect())
    assert stats == [(2, 2, 3), (21, 0, 0)]
    m = pixels.moments(image(spark, np.eye(1))).first()
    assert (m["m00"], m["cx"], m["cy"], m["skew"]) == (1.0, 0.0, 0.0, 0.0)


def test_more_pixels(spark):
    g = np.zeros((8, 8))
    g[:, 4:] = 255
    px = image(spark, g)
    assert pixels.otsu(px).first()["level"] == 0
    edges = pixels.canny(px)
    assert {r["x"] for r in edges.collect()} <= {3, 4} and edges.count() >= 8
    lines = pixels.hough_lines(edges.filter("x = 3"), 4, 8).collect()
    assert any(r["rho"] == 3 and r["theta"] == 0 for r in lines)
    right = np.roll(g + np.arange(8) * 3, -2, axis=1)
    disparity = as_grid(pixels.disparity(image(spark, g + np.arange(8) * 3), image(spark, right), 4, 1), (8, 8), "disparity")
    assert (disparity[1:7, 3:7] == 2).all()
    assert set(pixels.adaptive_threshold(px, 3, 10).select("v").distinct().toPandas()["v"]) <= {0, 255}
    h = pixels.hog(px, 4, 9, (8, 8)).agg(F.sum(F.col("weight") ** 2)).first()[0]
    assert h == pytest.approx(1.0)
    assert pixels.resized(px, 4).count() == 4
    white = spark.range(1).select(*[c.alias(n) for n, c in zip("hsvlab", [*pixels.hsv(F.lit(1.0), F.lit(1.0), F.lit(1.0)), *pixels.lab(F.lit(1.0), F.lit(1.0), F.lit(1.0))], strict=True)]).first()
    assert white["v"] == 1 and white["s"] == 0 and white["l"] == pytest.approx(100, abs=0.1) and abs(white["a"]) < 0.1


def test_contours_and_circles(spark):
    b = np.zeros((8, 8))
    b[1:6, 1:6] = 1
    b[3, 3] = 0
    rows = pixels.contours(image(spark, b)).collect()
    assert {(r["y"], r["x"]) for r in rows if r["hole"] is None} == {(y, x) for y in range(1, 6) for x in range(1, 6) if y in (1, 5) or x in (1, 5)}
    assert {(r["y"], r["x"]) for r in rows if r["hole"] == 27} == {(2, 3), (4, 3), (3, 2), (3, 4)}
    stats = pixels.component_stats(pixels.components(image(spark, b)))
    assert pixels.picked_components(stats, 3, 20).count() == 1 and pixels.picked_components(stats, 3, 80).count() == 0
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    ring = {(round(20 + 6 * np.sin(a)), round(20 + 6 * np.cos(a))) for a in t}
    edges = spark.createDataFrame([(1, int(y), int(x)) for y, x in ring], "image long, y int, x int")
    best = pixels.hough_circles(edges, [5, 6, 7], 90, 5).orderBy(F.desc("votes")).first()
    assert (best["radius"], abs(best["y"] - 20) <= 1, abs(best["x"] - 20) <= 1) == (6, True, True)


def test_contour_paths_and_tree(spark):
    b = np.zeros((8, 8))
    b[0:7, 0:7] = 1
    b[1:6, 1:6] = 0
    b[3, 3] = 1
    b[7, 7] = 0
    px = image(spark, b)
    tree = {(r["label"], r["hole"]): r["parent"] for r in pixels.contour_tree(px).collect()}
    assert tree == {(0, False): None, (9, True): 0, (27, False): 9}
    paths = {}
    for r in pixels.traced(px).orderBy("pos").collect():
        paths.setdefault(r["label"], []).append((r["y"], r["x"]))
    square = [(0, x) for x in range(7)] + [(y, 6) for y in range(1, 7)] + [(6, x) for x in range(5, -1, -1)] + [(y, 0) for y in range(5, 0, -1)]
    assert paths == {0: square, 27: [(3, 3)]}
    spur = np.zeros((8, 8))
    spur[2, 1:4] = 1
    assert [(r["y"], r["x"]) for r in pixels.traced(image(spark, spur)).orderBy("pos").collect()] == [(2, 1), (2, 2), (2, 3), (2, 2)]


def test_stencils_on_rasters(spark):
    g = np.random.default_rng(9).integers(0, 255, (3, 6, 10)).astype(float)
    df = spark.createDataFrame([(i, g[i].ravel().tolist()) for i in range(3)] + [(7, None)], "key long, v array<double>")
    images = pixels.rasters(df, "key", "v", 10)
    rows = spark.createDataFrame([(i, y, x, float(g[i, y, x])) for i in range(3) for y in range(6) for x in range(10)], "image long, y int, x int, v double").repartition(5)
    for f in (lambda p: pixels.median(p, 2), lambda p: pixels.morphology(p, "close"), lambda p: pixels.sobel(p, "reflect"), lambda p: pixels.bilateral(p, 2)):
        a, b = (sorted(map(tuple, f(p).collect())) for p in (images, rows))
        assert len(a) == 180 and np.allclose(np.array(a), np.array(b))
        plan = f(images)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    small = as_grid(pixels.resized_linear(images.filter("image = 1"), 3, 5), (3, 5))
    assert np.allclose(small, g[1].reshape(3, 2, 5, 2).mean((1, 3)))
    assert np.allclose(as_grid(pixels.resized_linear(images.filter("image = 1"), 6, 10), (6, 10)), g[1])
    slanted = np.zeros((9, 15))
    for y in range(9):
        slanted[y, 3 + y] = 1
    upright = as_grid(pixels.deskewed(image(spark, slanted)), (9, 15))
    assert (upright[1:8].argmax(axis=1) == upright[4].argmax()).all()
    assert pixels.median(images.limit(0)).count() == 0


def test_segments(spark):
    edges = [(1, 2, x) for x in [*range(0, 9), *range(14, 22)]] + [(1, 9, 3)]
    df = spark.createDataFrame(edges, "image long, y int, x int")
    rows = pixels.hough_segments(df, 4, 10, 5, 2).filter("theta > 1.5 and theta < 1.6").collect()
    assert {(r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows} == {(8, 2, 0, 2), (21, 2, 14, 2)}


def test_shapes_as_rows(spark):
    chain = [(s, i, float(x), float(y)) for s in (1, 2) for i, (x, y) in enumerate([(0, 0), (1, 0.01), (2, 0), (2, 2 * s)])]
    df = spark.createDataFrame(chain, "shape int, pos int, x double, y double")
    got = sorted(tuple(r) for r in geometry.simplified_shapes(df, 0.1).collect())
    assert got == [(s, i, *p) for s in (1, 2) for i, p in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0 * s)])]
    t = np.linspace(0, 2 * np.pi, 40)
    rows = [(1, i, float(5 + 3 * np.cos(a)), float(2 + np.sin(a))) for i, a in enumerate(t)] + [(2, 0, 0.0, 0.0)]
    e = {r["shape"]: r for r in geometry.fitted_ellipses(spark.createDataFrame(rows, df.schema)).collect()}
    assert (e[1]["cx"], e[1]["cy"]) == pytest.approx((5, 2)) and sorted((e[1]["width"], e[1]["height"])) == pytest.approx([2, 6]) and e[2]["cx"] is None
    points = spark.createDataFrame([(1, 1.0, 0.5)], "point int, px double, py double")
    assert geometry.point_in_polygon(points, df.limit(0)).count() == 0


def test_shapes(spark):
    square = [(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (1, 2, 2.0, 2.0), (1, 3, 0.0, 2.0)]
    df = spark.createDataFrame(square, "shape int, pos int, x double, y double")
    r = geometry.polygon_measures(df).first()
    assert (r["area"], r["signed_area"], r["perimeter"], r["open_length"]) == (4, 4, 8, 6)
    assert geometry.is_convex(df).first()["convex"]
    assert not geometry.is_convex(spark.createDataFrame([*square[:3], (1, 3, 1.5, 0.5)], df.schema)).first()["convex"]
    rng = np.random.default_rng(6)
    cloud = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((200, 2)) * 2)] + [(1, 900 + i, x, y) for _, i, x, y in square]
    hull = geometry.convex_hull(spark.createDataFrame(cloud, df.schema).repartition(4)).orderBy("pos").collect()
    assert [(r["x"], r["y"]) for r in hull] == [(0, 0), (2, 0), (2, 2), (0, 2)]
    assert geometry.simplified([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)]
    t = np.linspace(0, 2 * np.pi, 40)
    e = geometry.fitted_ellipse(np.stack([5 + 3 * np.cos(t), 2 + np.sin(t)], axis=1))
    assert e[:2] == pytest.approx((5, 2)) and sorted(e[2:4]) == pytest.approx([2, 6])


def test_cameras(spark):
    p1, p2 = np.eye(3, 4), np.eye(3, 4)
    p2[0, 3] = -1
    df = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 1.0, 2.0, 4.0)], "point int, x double, y double, z double")
    seen = geometry.projected(geometry.projected(df, p1).withColumnsRenamed({"u": "u1", "v": "v1"}), p2).withColumnsRenamed({"u": "u2", "v": "v2"})
    assert seen.first()["u2"] == pytest.approx(-0.2)
    back = {r["point"]: (r["x"], r["y"], r["z"]) for r in geometry.triangulated(seen, p1, p2).collect()}
    assert back[1] == pytest.approx((0, 0, 5)) and back[2] == pytest.approx((1, 2, 4))
    src, dst = [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (2, 0.5), (3, 2), (0, 1)]
    h = geometry.perspective_from_points(src, dst)
    out = geometry.moved(spark.createDataFrame([(float(x), float(y)) for x, y in src], "x double, y double"), h).collect()
    assert [(r["tx"], r["ty"]) for r in out] == [pytest.approx(d) for d in dst]
    m = geometry.rotation((1, 1), 90)
    assert np.allclose(m @ [2, 1, 1], [1, 0]) and np.allclose(geometry.inverse_affine(m) @ [1, 0, 1], [2, 1])
    angle = 0.3
    r = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 1]])
    cross = np.array([[0, 0, 0], [0, 0, -1], [0, 1, 0]], float)
    r1, r2, way = geometry.decomposed_essential(geometry.essential(cross @ r, np.eye(3), np.eye(3)))
    assert (np.allclose(r1, r) or np.allclose(r2, r)) and np.allclose(np.abs(way), [1, 0, 0])
    assert geometry.even_frames(100) == [0, 19, 39, 59, 79, 99] and geometry.even_frames(0) == []


def test_two_views():
    rng = np.random.default_rng(10)
    x = np.column_stack([rng.uniform(-2, 2, 60), rng.uniform(-2, 2, 60), rng.uniform(4, 9, 60)])
    k = np.array([[500.0, 0, 320], [0, 500, 240], [0, 0, 1]])
    a, b = 0.1, -0.05
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]) @ np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])
    t = np.array([-1.0, 0.1, 0.05])

    def seen(points):
        return points[:, :2] / points[:, 2:]

    left, right = seen(x @ k.T), seen((x @ r.T + t) @ k.T)
    wrong = right.copy()
    wrong[:12] += rng.uniform(20, 90, (12, 2))
    f = geometry.fundamental(left, wrong)
    ones = np.ones((60, 1))
    lines = np.hstack([left, ones]) @ f.T
    off = np.abs((np.hstack([right, ones]) * lines).sum(axis=1)) / np.hypot(lines[:, 0], lines[:, 1])
    assert off.max() < 0.01 and np.linalg.matrix_rank(f, 1e-9) == 2
    with pytest.raises(ValueError, match="eight"):
        geometry.fundamental(left[:7], right[:7])
    hl, hr = geometry.rectifying(k, k, r, t)
    rows = [seen(np.hstack([p, ones]) @ h.T)[:, 1] for p, h in ((left, hl), (right, hr))]
    assert np.allclose(*rows, atol=1e-6)


def test_semi_global_disparity(spark):
    rng = np.random.default_rng(11)
    scene = rng.integers(0, 255, (10, 24)).astype(float)
    left, right = scene[:, :20], np.where(np.arange(20) >= 0, scene[:, 3:23], 0)
    frames = [spark.createDataFrame([(1, g.ravel().tolist())], "key long, v array<double>") for g in (left, right)]
    a, b = (pixels.rasters(f, "key", "v", 20) for f in frames)
    assert (as_grid(pixels.semi_global_disparity(b, a, 8), (10, 20), "disparity") == 0).mean() < 0.2
    moved = as_grid(pixels.semi_global_disparity(a, pixels.rasters(spark.createDataFrame([(1, np.pad(left, ((0, 0), (0, 4)), mode="edge")[:, 4:].ravel().tolist())], "key long, v array<double>"), "key", "v", 20), 8), (10, 20), "disparity")
    assert (moved[:, 6:] == 4).mean() > 0.95
    assert pixels.semi_global_disparity(a.limit(0), b, 8).count() == 0


def test_clusters(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100, 0.0]) for i in range(20)], "id int, v array<double>")
    rows = clustering.kmeans(df, "id", "v", 2).collect()
    assert len({r["cluster"] for r in rows if r["id"] % 2}) == 1 and len({r["cluster"] for r in rows}) == 2


def test_components_that_do_not_settle_raise(spark):
    px = spark.createDataFrame([(1, 0, x, 1) for x in range(8)], "image long, y int, x int, v int")
    with pytest.raises(RuntimeError, match="settle"):
        pixels.components(px, most_rounds=1)
    assert {r["label"] for r in pixels.components(px).collect()} == {0}
