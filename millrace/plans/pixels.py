"""Queries on pixel grids, shapes and clusters; vectors of 64 stand as grids of 8 by 8."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import doubles
from ..operators import clustering, geometry
from ..operators import pixels as p
from ..operators.ranking import by_id, numbered
from .registry import Registry, read, values

R = Registry()
LEVELS = 256


def _grid(spark: SparkSession, d: str, levels: int | None = LEVELS) -> DataFrame:
    return p.grid(read(spark, d, "embeddings"), "vec_id", "embedding", 8, levels)


def _rasters(spark: SparkSession, d: str, levels: int | None = LEVELS) -> DataFrame:
    return p.rasters(read(spark, d, "embeddings"), "vec_id", "embedding", 8, levels)


def _binary_rasters(spark: SparkSession, d: str) -> DataFrame:
    return _rasters(spark, d).withColumn("v", F.transform("v", lambda v: p.threshold(v, 136).cast("double")))


_G = f"""g as (
  select vec_id as image, cast((i - 1) // 8 as integer) as y, cast((i - 1) % 8 as integer) as x,
         cast(least(greatest(floor((cast(embedding[i] as double) + 1) / 2 * {LEVELS}), 0), {LEVELS - 1}) as integer) as v
  from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)
)"""
_NEAR = "near as (select g.image, g.y - o.dy as y, g.x - o.dx as x, o.dy, o.dx, g.v from g, (select a.i as dy, b.i as dx from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i)) o where g.y - o.dy between 0 and 7 and g.x - o.dx between 0 and 7)"


@R.query(f"""with {_G}, h as (select image, v, count(*) as n from g group by 1, 2),
c as (select image, v, sum(n) over (partition by image order by v) as cdf, sum(n) over (partition by image) as total from h),
l as (select *, min(cdf) over (partition by image) as low from c)
select g.image, g.y, g.x, cast(case when l.total > l.low then round(255 * (l.cdf - l.low) / (l.total - l.low)) else g.v end as integer) as v from g join l using (image, v)""")
def pix_hist_eq(spark: SparkSession, d: str) -> DataFrame:
    return p.equalised(_grid(spark, d))


@R.query(f"with {_G} select image, y, x, cast(floor(255 * pow(v / 255.0::double, 1.5)) as integer) as v from g")
def pix_gamma(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select(*p.KEYS, p.gamma(F.col("v")).alias("v"))


@R.query(f"with {_G} select image, y, x, round(case when max(v) over w > min(v) over w then 255.0::double * (v - min(v) over w) / (max(v) over w - min(v) over w) else 0 end, 6) as v from g window w as (partition by image)")
def pix_minmax(spark: SparkSession, d: str) -> DataFrame:
    return p.min_max(_grid(spark, d)).withColumn("v", F.round("v", 6))


@R.query(f"with {_G}, {_NEAR} select image, y, x, cast(median(v) as double) as v from near group by 1, 2, 3")
def pix_median3(spark: SparkSession, d: str) -> DataFrame:
    return p.median(_rasters(spark, d))


@R.query(f"with {_G}, {_NEAR} select image, y, x, round(sum(v * case abs(dy) + abs(dx) when 0 then 4.0 when 1 then 2.0 else 1.0 end) / 16.0, 6) as v from near group by 1, 2, 3")
def pix_conv3(spark: SparkSession, d: str) -> DataFrame:
    kernel = {(dy, dx): (2 - abs(dy)) * (2 - abs(dx)) / 16.0 for dy, dx in p.SQUARE}
    return p.filtered(_rasters(spark, d), kernel).withColumn("v", F.round("v", 6))


@R.query(f"with {_G}, {_NEAR} select image, y, x, cast(sum(v * dx * (2 - abs(dy))) as double) as gx, cast(sum(v * dy * (2 - abs(dx))) as double) as gy from near group by 1, 2, 3")
def pix_sobel(spark: SparkSession, d: str) -> DataFrame:
    return p.sobel(_rasters(spark, d)).drop("magnitude")


def _mirrored(reach: int) -> str:
    """Every place beside its neighbours, mirrored at the border without repeating the edge."""
    at = lambda c: f"case when {c} < 0 then -({c}) when {c} > 7 then 14 - ({c}) else {c} end"
    steps = f"(select cast(i as integer) as dy, cast(j as integer) as dx from range(-{reach}, {reach + 1}) a(i), range(-{reach}, {reach + 1}) b(j)) o"
    return f"near as (select p.image, p.y, p.x, o.dy, o.dx, g.v, p.v as centre from g p cross join {steps} join g on g.image = p.image and g.y = {at('p.y + o.dy')} and g.x = {at('p.x + o.dx')})"


@R.query(f"with {_G}, {_mirrored(1)} select image, y, x, cast(sum(v * dx * (2 - abs(dy))) as double) as gx, cast(sum(v * dy * (2 - abs(dx))) as double) as gy from near group by 1, 2, 3")
def pix_sobel_reflect(spark: SparkSession, d: str) -> DataFrame:
    return p.sobel(_rasters(spark, d), "reflect").drop("magnitude")


@R.query(f"with {_G}, {_mirrored(2)}, k as (select *, exp(-(dy * dy + dx * dx) / (2 * 1.1::double * 1.1)) as w from near) select image, y, x, round(sum(v * w) / sum(w), 6) as v from k group by 1, 2, 3")
def pix_gauss5(spark: SparkSession, d: str) -> DataFrame:
    return p.filtered(_rasters(spark, d), p.gaussian_kernel(5), "reflect").withColumn("v", F.round("v", 6))


@R.query(f"with {_G}, {_mirrored(2)} select image, y, x, cast(median(v) as double) as v from near group by 1, 2, 3")
def pix_median5(spark: SparkSession, d: str) -> DataFrame:
    return p.median(_rasters(spark, d), 2, "reflect")


@R.query(f"""with {_G}, {_mirrored(2)}, k as (select *, exp(-(dy * dy + dx * dx) / (2 * 75.0::double * 75) - (v - centre) * (v - centre) / (2 * 75.0::double * 75)) as w from near where dy * dy + dx * dx <= 4)
select image, y, x, round(sum(v * w) / sum(w), 6) as v from k group by 1, 2, 3""")
def pix_bilateral(spark: SparkSession, d: str) -> DataFrame:
    return p.bilateral(_rasters(spark, d), 2, border="reflect").withColumn("v", F.round("v", 6))


@R.query(f"with {_G}, {_mirrored(1)} select image, y, x, case when centre > avg(v) - 10 then 0 else 255 end as v from near group by 1, 2, 3, centre")
def pix_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return p.adaptive_threshold(_rasters(spark, d), 3, border="reflect")


@R.query(f"""with {_G}, t as (select cast(i as integer) as y, cast(j as integer) as x, greatest((i + 0.5::double) * 8 / 12 - 0.5, 0) as fy, greatest((j + 0.5::double) * 8 / 12 - 0.5, 0) as fx from range(12) a(i), range(12) b(j)),
c as (select y, x, i, j, cast(least(floor(fy) + i, 7) as integer) as gy, cast(least(floor(fx) + j, 7) as integer) as gx,
             (case when i = 1 then fy - floor(fy) else 1 - fy + floor(fy) end) * (case when j = 1 then fx - floor(fx) else 1 - fx + floor(fx) end) as w from t, range(2) a(i), range(2) b(j))
select image, c.y, c.x, round(sum(w * g.v), 6) as v from c join g on g.y = c.gy and g.x = c.gx group by 1, 2, 3""")
def pix_resize_linear(spark: SparkSession, d: str) -> DataFrame:
    return p.resized_linear(_rasters(spark, d), 12, 12).withColumn("v", F.round("v", 6))


@R.query(f"""with {_G}, m as (select image, sum(v)::double as t, sum(v * x) / sum(v)::double as cx, sum(v * y) / sum(v)::double as cy from g group by 1),
s as (select image, sum(v * (x - cx) * (y - cy)) / sum(v * (y - cy) * (y - cy)) as s from g join m using (image) group by 1),
c as (select g.image, g.y, g.x, i, x + s * (y - 4) as sx, cast(floor(x + s * (y - 4)) + i as integer) as gx from g join s using (image), range(2) a(i))
select c.image, c.y, c.x, round(sum(case when i = 1 then sx - floor(sx) else 1 - sx + floor(sx) end * coalesce(g.v, 0)), 5) + 0.0 as v
from c left join g on g.image = c.image and g.y = c.y and g.x = c.gx group by 1, 2, 3""")
def pix_deskew(spark: SparkSession, d: str) -> DataFrame:
    return p.deskewed(_rasters(spark, d)).withColumn("v", F.round("v", 5) + 0.0)


@R.query("""
select vec_id as image, cast(u // 8 as integer) as y, cast(u % 8 as integer) as x,
       round(list_sum(list_transform(range(0, 64), lambda i: cast(embedding[i + 1] as double) * cos(2 * pi() * ((u // 8) * (i // 8) + (u % 8) * (i % 8)) / 8.0))), 5) + 0.0 as re
from embeddings, (select unnest(range(0, 64)) as u) f
""")
def pix_dft(spark: SparkSession, d: str) -> DataFrame:
    f = p.dft(_grid(spark, d, None), shifted=False)
    return f.select(*p.KEYS, (F.round("re", 5) + 0.0).alias("re"))


@R.query("""
with t as (select cast(k as integer) as k, cast(i as integer) as i, cos(2 * pi() * k * i / 8.0::double) as c, sin(2 * pi() * k * i / 8.0::double) as s from range(-4, 4) a(k), range(8) b(i)),
px as (select vec_id as image, cast((i - 1) // 8 as integer) as y, cast((i - 1) % 8 as integer) as x, cast(embedding[i] as double) as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)),
r as (select image, y, k as kx, sum(v * c) as re, -sum(v * s) as im from px join t on t.i = px.x group by 1, 2, 3),
f as (select image, k as ky, kx, sum(re * c + im * s) as re, sum(im * c - re * s) as im from r join t on t.i = r.y where k * k + kx * kx <= 4 group by 1, 2, 3),
b as (select image, i as y, kx, sum(re * c - im * s) as re, sum(re * s + im * c) as im from f join t on t.k = f.ky group by 1, 2, 3)
select image, y, i as x, round(sum(re * c - im * s) / 64, 6) + 0.0 as v from b join t on t.k = b.kx group by 1, 2, 3
""")
def pix_lowpass(spark: SparkSession, d: str) -> DataFrame:
    return p.frequency_filtered(_grid(spark, d, None), "circle", 2).withColumn("v", F.round("v", 6) + 0.0)


@R.query(f"""with {_G}, h as (select image, v, count(*) as n from g group by 1, 2),
c as (select image, v, sum(n) over r as n0, sum(n * v) over r as s0, sum(n) over (partition by image) as n, sum(n * v) over (partition by image) as s from h window r as (partition by image order by v)),
b as (select image, v, round(case when n > n0 then cast(n0 as double) * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2) else 0 end, 6) as b from c)
select image, v as level from (select *, row_number() over (partition by image order by b desc, v) as k from b) where k = 1""")
def pix_otsu(spark: SparkSession, d: str) -> DataFrame:
    return p.otsu(_grid(spark, d))


@R.query(f"with {_G}, b as (select image, y, x, case when v > 128 then 1 else 0 end as v from g) select * from b")
def pix_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select(*p.KEYS, p.threshold(F.col("v"), 128).alias("v"))


def _binary(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).select(*p.KEYS, p.threshold(F.col("v"), 136).alias("v"))


_B = _G.replace("g as (", "g0 as (") + ", g as (select image, y, x, case when v > 136 then 1 else 0 end as v from g0)"


@R.query(f"""with {_B}, {_NEAR}, e as (select image, y, x, min(v) as v from near group by 1, 2, 3),
n2 as (select e.image, e.y - o.dy as y, e.x - o.dx as x, e.v from e, (select a.i as dy, b.i as dx from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i)) o where e.y - o.dy between 0 and 7 and e.x - o.dx between 0 and 7)
select image, y, x, max(v) as v from n2 group by 1, 2, 3""")
def pix_morph_open(spark: SparkSession, d: str) -> DataFrame:
    return p.morphology(_binary_rasters(spark, d), "open")


@R.query(f"with {_B}, {_NEAR} select image, y, x, max(v) - min(v) as v from near group by 1, 2, 3")
def pix_morph_gradient(spark: SparkSession, d: str) -> DataFrame:
    return p.morphology(_binary_rasters(spark, d), "gradient")


_SETS = f"""{_B}, f as (select image, y, x, y * 8 + x as pos from g where v = 1),
e as (select a.image, a.pos as a, b.pos as b from f a join f b on a.image = b.image and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1),
r as (select image, pos as a, pos as b from f union select r.image, r.a, e.b from r join e on r.image = e.image and r.b = e.a),
cc as (select image, cast(a // 8 as integer) as y, cast(a % 8 as integer) as x, min(b) as label from r group by image, a),
cs as (select image, label, min(x) as "left", min(y) as top, max(x) - min(x) + 1 as width, max(y) - min(y) + 1 as height, count(*) as area, avg(x) as cx, avg(y) as cy from cc group by image, label)"""


@R.query(f"with recursive {_SETS} select * from cc")
def pix_cc(spark: SparkSession, d: str) -> DataFrame:
    return p.components(_binary(spark, d))


@R.query(f'with recursive {_SETS} select image, label, "left", top, width, height, area, round(cx, 6) as cx, round(cy, 6) as cy from cs')
def pix_cc_stats(spark: SparkSession, d: str) -> DataFrame:
    return p.component_stats(p.components(_binary(spark, d))).withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@R.query(f"""with recursive {_SETS}, z as (select image, y, x, y * 8 + x as pos from g where v = 0),
ez as (select a.image, a.pos as a, b.pos as b from z a join z b on a.image = b.image and abs(a.y - b.y) + abs(a.x - b.x) = 1),
rz as (select image, pos as a, pos as b from z union select rz.image, rz.a, ez.b from rz join ez on rz.image = ez.image and rz.b = ez.a),
ground as (select image, cast(a // 8 as integer) as y, cast(a % 8 as integer) as x, min(b) as label from rz group by image, a),
outside as (select distinct image, label from ground where y in (0, 7) or x in (0, 7))
select distinct cc.image, cc.y, cc.x, cc.label, case when o.label is null then n.label end as hole
from cc join ground n on n.image = cc.image and abs(n.y - cc.y) + abs(n.x - cc.x) = 1 left join outside o on o.image = n.image and o.label = n.label
union select image, y, x, label, null from cc where y in (0, 7) or x in (0, 7)""")
def pix_contours(spark: SparkSession, d: str) -> DataFrame:
    return p.contours(_binary(spark, d))


@R.query(f"with recursive {_SETS} select image, label, area from cs where area >= 4 qualify row_number() over (partition by image order by md5('42:' || cast(image as varchar) || ':' || cast(label as varchar))) <= 3")
def pix_pick(spark: SparkSession, d: str) -> DataFrame:
    return p.picked_components(p.component_stats(p.components(_binary(spark, d))), 3, 4).select("image", "label", "area")


@R.query(f"""with {_B}, near as (select g.image, g.y - o.dy as y, g.x - o.dx as x, g.v from g, (values (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) where g.y - o.dy between 0 and 7 and g.x - o.dx between 0 and 7),
n as (select image, y, x, min(v) as least, count(*) as n from near group by 1, 2, 3)
select image, y, x from g join n using (image, y, x) where g.v = 1 and (least = 0 or n < 4)""")
def pix_boundary(spark: SparkSession, d: str) -> DataFrame:
    return p.boundary(_binary(spark, d))


@R.query(f"with {_G}, m as (select image, cast(sum(v) as double) as m00, cast(sum(v * x) as double) as m10, cast(sum(v * y) as double) as m01 from g group by 1) select image, m00, m10, m01, round(m10 / m00, 6) as cx, round(m01 / m00, 6) as cy from m")
def pix_moments(spark: SparkSession, d: str) -> DataFrame:
    return p.moments(_grid(spark, d)).select("image", "m00", "m10", "m01", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@R.query(f"with {_B} select a.image, a.y, a.x, round(sqrt(min((a.y - z.y) * (a.y - z.y) + (a.x - z.x) * (a.x - z.x))), 6) as distance from g a join g z on a.image = z.image and z.v = 0 group by 1, 2, 3")
def pix_distance(spark: SparkSession, d: str) -> DataFrame:
    return p.distance_transform(_binary(spark, d)).withColumn("distance", F.round("distance", 6))


@R.query(f"""with {_B}, s as (select image, avg(x::double) as x0, avg(y::double) as y0, avg(x::double * x) as xx, avg(y::double * y) as yy, avg(x::double * y) as xy from g where v = 1 group by 1),
d as (select image, x0, y0, round(2 * (xy - x0 * y0), 9) + 0.0 as m, round((xx - x0 * x0) - (yy - y0 * y0), 9) + 0.0 as d from s),
a as (select *, case when m <> 0 or d <> 0 then 0.5 * atan2(m, d) end as t from d)
select image, round(cos(t), 4) + 0.0 as vx, round(sin(t), 4) + 0.0 as vy, round(x0, 6) as x0, round(y0, 6) as y0 from a""")
def pix_linefit(spark: SparkSession, d: str) -> DataFrame:
    lines = geometry.fitted_line(_binary(spark, d))
    return lines.select("image", (F.round("vx", 4) + 0.0).alias("vx"), (F.round("vy", 4) + 0.0).alias("vy"), F.round("x0", 6).alias("x0"), F.round("y0", 6).alias("y0"))


@R.query(f"with {_G} select image, cast(y // 2 as bigint) as y, cast(x // 2 as bigint) as x, round(avg(v), 6) as v from g group by 1, 2, 3")
def pix_resize(spark: SparkSession, d: str) -> DataFrame:
    return p.resized(_grid(spark, d), 2).select("image", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.round("v", 6).alias("v"))


@R.query(f"with {_G} select image, cast(y // 4 as bigint) as tile_y, cast(x // 4 as bigint) as tile_x, cast(sum(v) as bigint) as total from g group by 1, 2, 3")
def pix_tiles(spark: SparkSession, d: str) -> DataFrame:
    t = p.tiles(_grid(spark, d), 4, 4).groupBy("image", F.col("tile_y").cast("bigint").alias("tile_y"), F.col("tile_x").cast("bigint").alias("tile_x"))
    return t.agg(F.sum("v").alias("total"))


@R.query(f"with {_G} select image, y, x, v & 240 as masked, v | 15 as filled, abs(v - 128) as away, least(greatest(v - 100, 0), 50) as clipped from g")
def pix_bitwise(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return _grid(spark, d).select(
        *p.KEYS, v.bitwiseAND(240).alias("masked"), v.bitwiseOR(15).alias("filled"), F.abs(v - 128).alias("away"), F.least(F.greatest(v - 100, F.lit(0)), F.lit(50)).alias("clipped")
    )


@R.query(f"with {_G} select image, cast(sum(v) as bigint) as total, count(*) as n from g where (y - 4) * (y - 4) + (x - 4) * (x - 4) <= 9 group by 1")
def pix_circle(spark: SparkSession, d: str) -> DataFrame:
    """What lies under a drawn disc."""
    disc = p.shape(8, 8, (F.col("y") - 4) ** 2 + (F.col("x") - 4) ** 2 <= 9).filter("v = 1").select("y", "x")
    return _grid(spark, d).join(F.broadcast(disc), ["y", "x"]).groupBy("image").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@R.query("""
with s as (select vec_id as shape, cast(i as integer) as pos, cast(embedding[2 * i + 1] as double) as x, cast(embedding[2 * i + 2] as double) as y from embeddings, range(5) a(i)),
e as (select shape, pos, x, y, coalesce(lead(x) over w, first(x) over w) as x2, coalesce(lead(y) over w, first(y) over w) as y2 from s window w as (partition by shape order by pos rows between unbounded preceding and unbounded following))
select shape, round(abs(sum(x * y2 - x2 * y)) / 2, 6) as area, round(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 6) as perimeter from e group by 1
""")
def poly_measures(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of five corners, given by the first ten numbers of each vector."""
    corners = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(F.get("embedding", 2 * i).cast("double").alias("x"), F.get("embedding", 2 * i + 1).cast("double").alias("y"))))
    shapes = read(spark, d, "embeddings").select(F.col("vec_id").alias("shape"), corners.alias("pos", "c")).select("shape", "pos", "c.x", "c.y")
    return geometry.polygon_measures(shapes).select("shape", F.round("area", 6).alias("area"), F.round("perimeter", 6).alias("perimeter"))


_C = """c as (select vec_id, (cast(embedding[1] as double) + 1) / 2 as r, (cast(embedding[2] as double) + 1) / 2 as g, (cast(embedding[3] as double) + 1) / 2 as b from embeddings),
l as (select *, greatest(r, g, b) as top, greatest(r, g, b) - least(r, g, b) as span,
  case when r > 0.04045 then pow((r + 0.055) / 1.055, 2.4) else r / 12.92 end as lr, case when g > 0.04045 then pow((g + 0.055) / 1.055, 2.4) else g / 12.92 end as lg, case when b > 0.04045 then pow((b + 0.055) / 1.055, 2.4) else b / 12.92 end as lb from c),
t as (select *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 as tx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb as ty, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 as tz,
  case when span = 0 then 0 when top = r then 60 * (g - b) / span when top = g then 120 + 60 * (b - r) / span else 240 + 60 * (r - g) / span end as h0 from l),
f as (select *, case when tx > 0.008856 then pow(tx, 1 / 3.0) else 7.787 * tx + 16 / 116.0 end as fx, case when ty > 0.008856 then pow(ty, 1 / 3.0) else 7.787 * ty + 16 / 116.0 end as fy, case when tz > 0.008856 then pow(tz, 1 / 3.0) else 7.787 * tz + 16 / 116.0 end as fz from t)"""


@R.query(f"with {_C} select vec_id, round(0.299 * r + 0.587 * g + 0.114 * b, 6) as gray, round(case when h0 < 0 then h0 + 360 else h0 end, 5) + 0.0 as h, round(case when top > 0 then span / top else 0 end, 6) as s, round(top, 6) as v, round(116 * fy - 16, 4) as l, round(500 * (fx - fy), 4) + 0.0 as a, round(200 * (fy - fz), 4) + 0.0 as b2 from f")
def pix_colour(spark: SparkSession, d: str) -> DataFrame:
    """The first three numbers of each vector as red, green and blue, in other spaces."""
    r, g, b = [(F.get("embedding", F.lit(i)).cast("double") + 1) / 2 for i in range(3)]
    c = read(spark, d, "embeddings").select("vec_id", r.alias("r"), g.alias("g"), b.alias("b"))
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    h, s, v = p.hsv(r, g, b)
    l, a, b2 = p.lab(r, g, b)  # noqa: E741
    return c.select(
        "vec_id", F.round(p.gray(r, g, b), 6).alias("gray"), (F.round(h, 5) + 0.0).alias("h"), F.round(s, 6).alias("s"), F.round(v, 6).alias("v"),
        F.round(l, 4).alias("l"), (F.round(a, 4) + 0.0).alias("a"), (F.round(b2, 4) + 0.0).alias("b2"),
    )


@R.query(f"with {_G} select g.image, g.y, g.x, round(0.5::double * g.v + 0.5 * n.v, 6) as v from g join g n on n.image = g.image and n.y = g.y and n.x = least(g.x + 1, 7)")
def pix_remap(spark: SparkSession, d: str) -> DataFrame:
    """Images moved by half a pixel."""
    return p.remapped(_grid(spark, d), F.col("x") + 0.5, F.col("y") * 1.0).withColumn("v", F.round("v", 6))


@R.query("select vec_id as point, round(cast(embedding[1] as double), 5) + 0.0 as x, round(cast(embedding[2] as double), 5) + 0.0 as y, round(cast(embedding[3] as double) + 4, 5) as z, round(cast(embedding[1] as double) / (cast(embedding[3] as double) + 4), 5) + 0.0 as u1 from embeddings")
def points_triangulated(spark: SparkSession, d: str) -> DataFrame:
    """Points seen by two cameras, and where they are by what was seen."""
    one, two = np.eye(3, 4), np.eye(3, 4)
    two[0, 3] = -1
    place = [F.get("embedding", F.lit(i)).cast("double") for i in range(3)]
    points = read(spark, d, "embeddings").select(F.col("vec_id").alias("point"), place[0].alias("x"), place[1].alias("y"), (place[2] + 4).alias("z"))
    seen = geometry.projected(geometry.projected(points, one).withColumnsRenamed({"u": "u1", "v": "v1"}), two).withColumnsRenamed({"u": "u2", "v": "v2"})
    back = geometry.triangulated(seen, one, two).join(seen.select("point", "u1"), "point")
    return back.select("point", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"), F.round("z", 5).alias("z"), (F.round("u1", 5) + 0.0).alias("u1"))


#: A bent outline on the pixel grid: pixels lie inside, outside and on its edges.
_OUTLINE = [(1, 0, 1.0, 1.0), (1, 1, 6.0, 1.0), (1, 2, 6.0, 6.0), (1, 3, 3.5, 3.0), (1, 4, 1.0, 6.0)]


@R.query(f"""with {_G}, pts as (select image * 64 + y * 8 + x as point, x::double as px, y::double as py from g where v > 128),
s as (select * from {values(_OUTLINE, "shape, pos, x, y")}),
e as (select shape, pos, x::double as x, y::double as y, coalesce(lead(x) over w, first(x) over w)::double as x2, coalesce(lead(y) over w, first(y) over w)::double as y2 from s window w as (partition by shape order by pos rows between unbounded preceding and unbounded following)),
t as (select *, least(greatest(((px - x) * (x2 - x) + (py - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 0), 1) as t from pts, e),
m as (select point, shape, sqrt(min((px - x - t * (x2 - x)) * (px - x - t * (x2 - x)) + (py - y - t * (y2 - y)) * (py - y - t * (y2 - y)))) as dist,
             count(*) filter (where (y > py) <> (y2 > py) and px < x + (py - y) * (x2 - x) / nullif(y2 - y, 0)) as n from t group by 1, 2)
select point, shape, case when dist < 1e-9 then 0 when n % 2 = 1 then 1 else -1 end as side, round(dist * case when dist < 1e-9 then 0 when n % 2 = 1 then 1 else -1 end, 6) + 0.0 as distance from m""")
def point_in_poly(spark: SparkSession, d: str) -> DataFrame:
    """Bright pixels against an outline."""
    points = _grid(spark, d).filter("v > 128").select((F.col("image") * 64 + F.col("y") * 8 + F.col("x")).alias("point"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    outline = spark.createDataFrame(_OUTLINE, "shape int, pos int, x double, y double")
    return geometry.point_in_polygon(points, outline).withColumn("distance", F.round("distance", 6) + 0.0)


@R.query(f"with {_G} select image, y, x, round(1.5::double * x - 0.5::double * y + 2.0, 6) as tx, round(0.25::double * x + 1.25::double * y - 1.0, 6) as ty from g")
def affine_apply(spark: SparkSession, d: str) -> DataFrame:
    src = [(0, 0), (1, 0), (0, 1)]
    matrix = geometry.affine_from_points(src, [(2.0, -1.0), (3.5, -0.75), (1.5, 0.25)])
    return geometry.moved(_grid(spark, d), matrix).select(*p.KEYS, F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))


_CENTRES = [[float(np.cos(i * (k + 1))) / 8 for i in range(64)] for k in range(4)]


@R.query(f"""with e as (select vec_id, cast(embedding as double[]) as v from embeddings),
c as (select * from (values {", ".join(f"({k}, {c}::double[])" for k, c in enumerate(_CENTRES))}) t(cluster, m)),
s as (select vec_id, v, cluster, round(list_sum(list_transform(range(1, 65), lambda i: pow(v[i] - m[i], 2))), 9) as cost from e, c),
a as (select * from (select *, row_number() over (partition by vec_id order by cost, cluster) as k from s) where k = 1)
select cluster, cast(i - 1 as integer) as pos, round(avg(v[i]), 6) as x, count(*) as n from a, (select unnest(range(1, 65)) as i) group by 1, 2""")
def kmeans_assign_step(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"))
    return clustering.lloyd_step(e, "v", _CENTRES).withColumn("x", F.round("x", 6))


@R.query()
def kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    return clustering.kmeans(read(spark, d, "embeddings"), "vec_id", "embedding", 8)


@R.query("""
with n as (select count(*) as n from events), k as (select distinct cast(floor((n - 1) * i / 5.0::double) as bigint) as place from n, range(6) a(i) where n > 0)
select event_id from (select event_id, row_number() over (order by event_id) - 1 as place from events) join k using (place)
""")
def even_frames(spark: SparkSession, d: str) -> DataFrame:
    """Six events evenly spread over all of them."""
    events = read(spark, d, "events").select("event_id")
    wanted = spark.createDataFrame([(i + 1,) for i in geometry.even_frames(events.count())], "pos long")
    return numbered(events, [], "event_id", by_id("event_id")).join(F.broadcast(wanted.distinct()), "pos", "left_semi").select("event_id")
