"""Every operator over the driver tables, each with the SQL that gives the same rows.

The tables hold no buildings, so views derive points, footprints, faces and photos from them; the SQL repeats the
derivation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kawara.functions import geometry as g
from kawara.operators import graph, grouped, kernels, mesh, modeling, raster, spatial, texture
from kawara.plans import building, flat
from kawara.sources import citygml, obj

POINTS = """SELECT l_suppkey AS building_id,
 cast(l_orderkey % 80 as double) * 0.25e0 + cast(l_partkey % 7 as double) * 0.01e0 AS x,
 cast(l_partkey % 80 as double) * 0.25e0 + cast(l_orderkey % 11 as double) * 0.01e0 AS y,
 CASE WHEN l_linenumber <= 2 THEN (l_quantity % 10) * 0.1e0
 ELSE 6.0e0 + (l_suppkey % 3) * 3.0e0 + (l_quantity % 5) * 0.1e0 END AS z FROM lineitem"""
FOOTPRINTS = """SELECT s_suppkey AS building_id, cast(4 + s_suppkey % 4 as double) AS x0, cast(4 + s_suppkey % 5 as double) AS y0,
 cast(14 + s_suppkey % 3 as double) AS x1, cast(13 + s_suppkey % 6 as double) AS y1 FROM supplier"""
VECTORS = """SELECT p_partkey AS id, cast(p_size as double) AS ax, cast(p_partkey % 17 as double) - 8.0e0 AS ay, cast(p_partkey % 5 as double) + 1.0e0 AS az,
 cast(p_partkey % 11 as double) - 5.5e0 AS bx, cast(p_partkey % 23 as double) - 11.5e0 AS by_, cast(p_partkey % 3 as double) AS bz FROM part"""
INSIDE = f"""SELECT p.*, f.x0, f.y0, f.x1, f.y1 FROM ({POINTS}) p JOIN ({FOOTPRINTS}) f USING (building_id)
 WHERE x > x0 AND x < x1 AND y > y0 AND y < y1"""
RING = f"""SELECT p.building_id, z FROM ({POINTS}) p JOIN ({FOOTPRINTS}) f USING (building_id)
 WHERE x > x0 - 1 AND x < x1 + 1 AND y > y0 - 1 AND y < y1 + 1 AND NOT (x > x0 AND x < x1 AND y > y0 AND y < y1)"""
QUADS = """SELECT p_partkey AS id, cast(p_size as double) AS w, cast(p_partkey % 13 + 1 as double) AS h, cast(p_partkey % 4 as double) / 8 AS lift FROM part"""


#: Faces with a known fault each, by k % 7: none, a doubled corner, no area, a lifted corner (none if lift is 0), a
#: crossing, a touch, too few corners.
SHAPES = """SELECT p_partkey AS k, p_partkey % 7 AS kind, cast(p_size + 1 as double) AS w, cast(p_partkey % 13 + 2 as double) AS h, cast(p_partkey % 4 as double) / 4 AS lift FROM part"""
#: Boxes as solids: by k % 5 without a wall, without two walls that meet, without the top, without the bottom, whole.
BOXES = """SELECT p_partkey AS k, p_partkey % 5 AS kind, cast(p_size as double) AS w, cast(p_partkey % 13 + 1 as double) AS l, cast(p_partkey % 4 + 1 as double) AS h FROM part"""
#: Rectangles with a dent in the upper side.
DENTS = """SELECT p_partkey AS k, cast(p_size + 1 as double) AS w, cast(p_partkey % 13 + 2 as double) AS h, cast(p_partkey % 13 + 2 as double) - cast(p_partkey % 3 as double) * 0.5e0 AS y FROM part"""


def ring_of(*corners) -> Column:
    """Corners as (x, y) or (x, y, z), of numbers and columns."""
    own = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*(g.point(*map(own, c)) for c in corners))


class Tables:
    """The tables of a folder, and views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """A view's SQL over tables given by name."""
        return self.spark.sql(self._braced(text, names), **{n: getattr(self, n) for n in names})

    @staticmethod
    def _braced(text: str, names: tuple[str, ...]) -> str:
        for n in names:
            text = text.replace(f"FROM {n}", "FROM {" + n + "}")
        return text

    @property
    def points(self) -> DataFrame:
        return self.sql(POINTS, "lineitem")

    @property
    def footprints(self) -> DataFrame:
        return self.sql(FOOTPRINTS, "supplier")

    @property
    def rings(self) -> DataFrame:
        return self.footprints.withColumn("ring", building.box_ring("x0", "y0", "x1", "y1"))

    @property
    def vectors(self) -> DataFrame:
        v = self.sql(VECTORS, "part")
        a, b = g.point(F.col("ax"), F.col("ay"), F.col("az")), g.point(F.col("bx"), F.col("by_"), F.col("bz"))
        return v.select("id", a.alias("a"), b.alias("b"))

    @property
    def shapes(self) -> DataFrame:
        """Faces with one fault each."""
        w, h, lift = F.col("w"), F.col("h"), F.col("lift")
        rings = [
            ring_of((0, 0, 0), (w, 0, 0), (w, h, 0), (0, h, 0)), ring_of((0, 0, 0), (w, 0, 0), (w + 0.005, 0, 0), (w, h, 0), (0, h, 0)),
            ring_of((0, 0, 0), (w, 0, 0), (w * 2, 0, 0)), ring_of((0, 0, 0), (w, 0, 0), (w, h, lift), (0, h, 0)),
            ring_of((0, 0, 0), (w, h, 0), (w, 0, 0), (0, h * 2, 0)), ring_of((0, 0, 0), (w, 0, 0), (w, h, 0), (w / 2, 0, 0), (0, h, 0)),
            ring_of((0, 0, 0), (0, 0, 0), (w, 0, 0)),
        ]
        ring = F.lit(None).cast("array<struct<x:double,y:double,z:double>>")
        for kind, r in enumerate(rings):
            ring = F.when(F.col("kind") == kind, r).otherwise(ring)
        return self.sql(SHAPES, "part").select((F.col("k") % 100).alias("mesh_id"), F.col("k").alias("face_id"), F.lit("ROOF").alias("element"), ring.alias("ring"))

    @property
    def boxes(self) -> DataFrame:
        """Solids, some with openings; a face's element is what it looks like from outside."""
        w, l, h = F.col("w"), F.col("l"), F.col("h")  # noqa: E741
        sides = [
            ("GROUND", ring_of((0, 0, 0), (w, 0, 0), (w, l, 0), (0, l, 0))), ("ROOF", ring_of((0, 0, h), (0, l, h), (w, l, h), (w, 0, h))),
            ("WALL", ring_of((0, 0, 0), (0, 0, h), (w, 0, h), (w, 0, 0))), ("WALL", ring_of((w, 0, 0), (w, 0, h), (w, l, h), (w, l, 0))),
            ("WALL", ring_of((w, l, 0), (w, l, h), (0, l, h), (0, l, 0))), ("WALL", ring_of((0, l, 0), (0, l, h), (0, 0, h), (0, 0, 0))),
        ]
        all_ = F.array(*(F.struct(F.lit(i).cast("long").alias("face_id"), F.lit(e).alias("element"), r.alias("ring")) for i, (e, r) in enumerate(sides)))
        rows = self.sql(BOXES, "part").select(F.col("k").alias("mesh_id"), "kind", F.explode(all_).alias("f")).select("mesh_id", "kind", "f.*")
        gone = (F.col("kind") == 0) & (F.col("face_id") == 2) | (F.col("kind") == 1) & F.col("face_id").isin(2, 3) | (F.col("kind") == 2) & (F.col("face_id") == 1) | (F.col("kind") == 3) & (F.col("face_id") == 0)
        return rows.where(~gone).drop("kind")

    @property
    def dents(self) -> DataFrame:
        ring = ring_of((0, 0, 0), (F.col("w"), 0, 0), (F.col("w"), F.col("h"), 0), (F.col("w") / 2, F.col("y"), 0), (0, F.col("h"), 0))
        return self.sql(DENTS, "part").select((F.col("k") % 100).alias("mesh_id"), F.col("k").alias("face_id"), F.lit("ROOF").alias("element"), ring.alias("ring"))

    @property
    def quads(self) -> DataFrame:
        """Faces of four corners, the third one lifted."""
        z = F.lit(0.0)
        corners = [(z, z, z), (F.col("w"), z, z), (F.col("w"), F.col("h"), F.col("lift")), (z, F.col("h"), z)]
        ring = F.array(*(g.point(*c) for c in corners))
        return self.sql(QUADS, "part").select((F.col("id") % 100).alias("mesh_id"), F.col("id").alias("face_id"), F.lit("ROOF").alias("element"), ring.alias("ring"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


MODE = f"""WITH g AS ({RING}), a AS (SELECT building_id, min(z) AS low, (min(z) + max(z)) / 2 AS mid FROM g GROUP BY building_id),
 h AS (SELECT building_id, z, low FROM g JOIN a USING (building_id) WHERE z <= mid),
 t AS (SELECT *, max(z) OVER (PARTITION BY building_id) AS top FROM h),
 b AS (SELECT *, greatest(2, cast(floor(top - low + 0.5e0) AS int)) AS bins FROM t),
 w AS (SELECT *, (CASE WHEN top > low THEN top - low ELSE 1e0 END) / bins AS width FROM b),
 i AS (SELECT *, least(cast(floor((z - low) / width) AS int), bins - 1) AS bin FROM w),
 c AS (SELECT building_id, bin, count(*) AS n, min(low) AS low, min(width) AS width FROM i GROUP BY building_id, bin)"""


@query(
    MODE
    + f""", m AS (SELECT building_id, min(low) AS min_z, arg_max(low + (bin + 0.5e0) * width, n * 1000 - bin) AS mode_z FROM c GROUP BY building_id),
 n AS (SELECT building_id, count(*) AS n_points FROM ({INSIDE}) GROUP BY building_id)
 SELECT building_id, coalesce(n_points, 0) AS n_points, round(min_z, 6) AS min_z, round(mode_z, 6) AS mode_z
 FROM ({FOOTPRINTS}) f LEFT JOIN n USING (building_id) LEFT JOIN m USING (building_id)"""
)
def building_heights(t):
    rows = building.building_heights(t.points, t.footprints)
    return rows.select("building_id", "n_points", r6(F.col("min_z")).alias("min_z"), r6(F.col("mode_z")).alias("mode_z"))


@query(f"SELECT building_id, count(*) AS n_points FROM ({INSIDE}) GROUP BY building_id")
def points_in_footprint_count(t):
    found = spatial.points_in_polygons(t.points, t.rings.select("building_id", "ring"), 16.0, ("building_id",))
    return found.groupBy("building_id").agg(F.count("*").alias("n_points"))


@query(f"SELECT building_id, round(min(z), 6) AS min_z FROM ({RING}) GROUP BY building_id")
def ground_min_height(t):
    return building.ground_points(t.points, t.footprints).groupBy("building_id").agg(F.round(F.min("z"), 6).alias("min_z"))


@query(
    f"""WITH m AS (SELECT building_id, min(z) AS low FROM ({RING}) GROUP BY building_id)
 SELECT building_id, round(coalesce(quantile_cont(CASE WHEN z > low + 2 THEN z END, 0.25), quantile_cont(z, 0.25)), 6) AS p25,
 round(coalesce(quantile_cont(CASE WHEN z > low + 2 THEN z END, 0.9), quantile_cont(z, 0.9)), 6) AS p90
 FROM ({POINTS}) JOIN m USING (building_id) GROUP BY building_id"""
)
def roof_height_percentiles(t):
    low = building.ground_points(t.points, t.footprints).groupBy("building_id").agg(F.min("z").alias("min_z"))
    rows = building.roof_percentiles(t.points, low)
    return rows.select("building_id", r6(F.col("p25")).alias("p25"), r6(F.col("p90")).alias("p90"))


@query(f"""WITH b AS (SELECT building_id AS path, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM ({POINTS}) GROUP BY 1)
 SELECT * FROM b WHERE min_x <= 0.1 AND max_x >= 0.0 AND min_y <= 0.1 AND max_y >= 0.02""")
def tile_prune(t):
    box = [f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"]
    return spatial.tiles_overlapping(t.points.groupBy(F.col("building_id").alias("path")).agg(*box), 0.0, 0.02, 0.1, 0.1)


@query(f"""SELECT building_id, cast(round_even((x - 0.0e0) / 0.25e0, 0) AS int) AS px, cast(round_even((20.0e0 - y) / 0.25e0, 0) AS int) AS py, round(max(z), 6) AS z
 FROM ({POINTS}) GROUP BY ALL""")
def pixel_rasterize(t):
    p = g.to_pixel(F.col("x"), F.col("y"), F.lit(0.0), F.lit(20.0), 0.25)
    rows = t.points.select("building_id", p["col"].alias("px"), p["row"].alias("py"), "z")
    return rows.groupBy("building_id", "px", "py").agg(F.round(F.max("z"), 6).alias("z"))


@query("""SELECT cast(id AS bigint) AS id, round(sqrt(ax*ax+ay*ay+az*az), 6) AS len, round(degrees(acos(greatest(-1, least(1, (ax*bx+ay*by_+az*bz) / (sqrt(ax*ax+ay*ay+az*az) * sqrt(bx*bx+by_*by_+bz*bz)))))), 6) AS angle,
 round(degrees(atan2(ax*by_-ay*bx, ax*bx+ay*by_)), 6) AS signed_angle, round(ay*bz-az*by_, 6) AS cx, round(az*bx-ax*bz, 6) AS cy, round(ax*by_-ay*bx, 6) AS cz,
 round(ax / sqrt(ax*ax+ay*ay+az*az), 6) AS nx FROM (""" + VECTORS + ")")
def vector_scalars(t):
    a, b = F.col("a"), F.col("b")
    c = g.cross(a, b)
    out = {"len": g.length(a), "angle": g.angle(a, b), "signed_angle": g.signed_angle(a, b), "cx": c.x, "cy": c.y, "cz": c.z, "nx": g.normalized(a).x}
    return t.vectors.select("id", *(r6(v).alias(k) for k, v in out.items()))


@query("""WITH v AS (""" + VECTORS + """), w AS (SELECT *, bx*bx+by_*by_+bz*bz AS bb, (ax-1)*bx+(ay-2)*by_+(az-3)*bz AS ab FROM v)
 SELECT id, round(ab / bb, 6) AS t, round(sqrt(pow(ax-1-ab/bb*bx,2)+pow(ay-2-ab/bb*by_,2)+pow(az-3-ab/bb*bz,2)), 6) AS distance,
 round(abs(0.6e0*ax + 0.8e0*ay - 2), 6) AS plane_distance, round(-(0.6e0*ax+0.8e0*ay-2) / nullif(0.6e0*bx+0.8e0*by_, 0) * bz + az, 6) AS hit_z FROM w""")
def point_line_plane(t):
    q = g.point(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    e = F.struct(F.lit(0.6).alias("a"), F.lit(0.8).alias("b"), F.lit(0.0).alias("c"), F.lit(-2.0).alias("d"))
    own = g.point_to_line(F.col("a"), q, F.col("b"))
    hit = g.plane_hit(e, F.col("a"), F.col("b"))
    return t.vectors.select(
        "id", r6(own["t"]).alias("t"), r6(own["distance"]).alias("distance"), r6(g.plane_distance(e, F.col("a"))).alias("plane_distance"), r6(hit.z).alias("hit_z")
    )


@query("""WITH v AS (""" + VECTORS + """), w AS (SELECT *, ax*by_-ay*bx AS d FROM v)
 SELECT id, round(ax * (2*by_+3*bx) / nullif(d,0) + 0, 6) AS x, round(ay * (2*by_+3*bx) / nullif(d,0) + 0, 6) AS y, round((2*ay+3*ax) / nullif(d,0) + 0, 6) AS t FROM w""")
def line_crossing(t):
    zero, q = g.point(F.lit(0.0), F.lit(0.0)), g.point(F.lit(2.0), F.lit(-3.0))
    hit = g.crossing(zero, F.col("a"), q, F.col("b"))
    return t.vectors.select("id", r6(hit.x).alias("x"), r6(hit.y).alias("y"), r6(hit["t"]).alias("t"))


@query("""SELECT id, round((ax-1)*cos(0.5e0)-(ay-2)*sin(0.5e0)+1, 6) AS x, round((ax-1)*sin(0.5e0)+(ay-2)*cos(0.5e0)+2, 6) AS y,
 round(ax*cos(0.5e0)-ay*sin(0.5e0), 6) AS rx, round(az, 6) AS rz FROM (""" + VECTORS + ")")
def rotations(t):
    a, angle = F.col("a"), F.lit(0.5)
    p = g.rotated(a, angle, g.point(F.lit(1.0), F.lit(2.0)))
    q = g.rotated_about(a, g.point(F.lit(0.0), F.lit(0.0), F.lit(2.0)), angle)
    return t.vectors.select("id", r6(p.x).alias("x"), r6(p.y).alias("y"), r6(q.x).alias("rx"), r6(q.z).alias("rz"))


@query("""SELECT id, round(CASE WHEN bb = 0 THEN sqrt(ax*ax+ay*ay) ELSE sqrt(pow(ax-k*bx,2)+pow(ay-k*by_,2)) END, 6) AS distance FROM (
 SELECT *, greatest(0, least(1, (ax*bx+ay*by_)/nullif(bb,0))) AS k FROM (SELECT *, bx*bx+by_*by_ AS bb FROM (""" + VECTORS + ")))")
def segment_distance(t):
    zero = g.point(F.lit(0.0), F.lit(0.0))
    return t.vectors.select("id", r6(g.segment_distance(F.col("a"), zero, F.col("b"))).alias("distance"))


@query("""SELECT id % 100 AS mesh_id, id AS face_id, round(w * h, 6) AS area, round(2 * (w + h), 6) AS perimeter, round(2*sqrt(pow(h*lift,2)+pow(w*lift,2)+pow(2*w*h,2)), 6) AS normal_length,
 greatest(w, h) AS longest FROM (""" + QUADS + ")")
def polygon_area(t):
    ring = F.col("ring")
    out = {"area": g.area(ring), "perimeter": g.perimeter(ring), "normal_length": g.length(g.normal(ring))}
    rows = t.quads.select("mesh_id", "face_id", *(r6(v).alias(k) for k, v in out.items()), g.longest_edge(ring)["length"].alias("longest"))
    return rows.withColumn("normal_length", F.round(F.col("normal_length"), 6))


@query("SELECT k AS face_id, y >= h AS convex, round(w * h - w * (h - y) / 2, 6) AS area, w AS width, h AS height FROM (" + DENTS + ")")
def polygon_convex(t):
    ring, box = F.col("ring"), g.bounds(F.col("ring"))
    return t.dents.select("face_id", g.is_convex(ring).alias("convex"), r6(g.area(ring)).alias("area"), (box["max_x"] - box["min_x"]).alias("width"), (box["max_y"] - box["min_y"]).alias("height"))


@query(f"""SELECT building_id, greatest(x1 - x0, y1 - y0) AS length, CASE WHEN x1 - x0 >= y1 - y0 THEN 0.0e0 ELSE 90.0e0 END AS angle FROM ({FOOTPRINTS})""")
def longest_edge(t):
    e = g.longest_edge(F.col("ring"))
    return t.rings.select("building_id", e["length"].alias("length"), g.folded_angle(e["angle"]).alias("angle"))


@query(f"""WITH b AS ({FOOTPRINTS}), a AS (SELECT *, (x1 - x0) * (y1 - y0) AS area FROM b)
 SELECT c.building_id AS child, arg_min(p.building_id, p.area * 1000000 + p.building_id) AS parent FROM a c JOIN a p
 ON p.x0 <= c.x0 AND p.y0 <= c.y0 AND p.x1 >= c.x1 AND p.y1 >= c.y1 AND p.area > c.area GROUP BY 1""")
def parent_containment(t):
    return spatial.smallest_container(t.footprints.withColumnRenamed("building_id", "id"), 16.0)


@query("""WITH e AS (SELECT event_id, (event_id % 200) * 0.1e0 AS x, value % 20 AS y FROM events), s AS (SELECT s_suppkey AS sample_id, (s_suppkey % 20) * 1.0e0 AS sx, (s_suppkey * 7 % 20) * 1.0e0 AS sy FROM supplier),
 p AS (SELECT event_id, sample_id, sqrt(pow(x-sx,2)+pow(y-sy,2)) AS d FROM e JOIN s ON abs(x-sx) <= 0.5 AND abs(y-sy) <= 0.5 WHERE sqrt(pow(x-sx,2)+pow(y-sy,2)) < 0.5),
 k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, sample_id) AS n FROM p) SELECT event_id, sample_id, round(d, 6) AS distance FROM k WHERE n = 1""")
def nearest_footprint_sample(t):
    e = t.events.select("event_id", ((F.col("event_id") % 200) * F.lit(0.1)).alias("x"), (F.col("value") % 20).alias("y"))
    s = t.supplier.select(F.col("s_suppkey").alias("sample_id"), ((F.col("s_suppkey") % 20) * F.lit(1.0)).alias("x"), ((F.col("s_suppkey") * 7 % 20) * F.lit(1.0)).alias("y"))
    near = spatial.nearest_within(e, s, 0.5, "event_id", "sample_id")
    return near.select("event_id", "sample_id", r6(F.col("distance")).alias("distance"))


@query("""WITH s AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 0.5 THEN 1 ELSE 0 END AS st FROM events),
 c AS (SELECT user_id, sum(st) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS cl FROM s) SELECT user_id, cast(cl AS bigint) AS cluster, count(*) AS n FROM c GROUP BY 1, 2""")
def height_gap_cluster(t):
    rows = graph.gap_clusters(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", 0.5, "event_id")
    return rows.groupBy("user_id", "cluster").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_orderkey AS edge, o_custkey % 50 AS a, o_orderkey % 50 AS b FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY edge) AS k FROM e)
 SELECT x.edge, x.a, x.b FROM n x LEFT JOIN n y ON x.a = y.b AND x.b = y.a AND x.k = y.k WHERE y.edge IS NULL""")
def edge_pair_cancel(t):
    e = t.orders.select(F.col("o_orderkey").alias("edge"), (F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b"))
    return graph.opposite_pairs(e, []).select("edge", "a", "b")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate, coalesce(lead(l_quantity) OVER w, first_value(l_quantity) OVER w) AS next_q
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)""")
def cyclic_neighbors(t):
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    rows = t.lineitem.select("l_orderkey", *keys, "l_quantity").withColumn("place", F.struct(*keys))
    rows = mesh.neighbours(rows, ["l_orderkey"], "place", "l_quantity")
    return rows.select("l_orderkey", *keys, F.col("next_l_quantity").alias("next_q"))


@query("SELECT k AS face_id, cast(kind IN (1, 6) AS int) AS doubled, kind <> 6 AS repaired, kind = 2 AS zero_area, kind = 3 AND lift > 0 AS non_plane, cast(kind = 4 AS int) AS crossings,"
       " cast(kind = 5 AS int) AS touches, CASE WHEN kind = 6 THEN 'ERROR' WHEN kind IN (4, 5) THEN 'WARN' ELSE 'SUCCESS' END AS status FROM (" + SHAPES + ")")
def mesh_checks(t):
    return mesh.checked(t.shapes).drop("mesh_id", "element", "ring")


@query("""WITH q AS (SELECT p_partkey AS face_id, p_size % 4 AS d FROM part) SELECT face_id, cast(CASE WHEN d = 0 THEN 1 ELSE 0 END AS int) AS doubled, true AS repaired FROM q""")
def dup_vertex(t):
    z = F.lit(0.0)
    gap = (F.col("p_size") % 4).cast("double") * F.lit(0.25)
    ring = F.array(g.point(z, z, z), g.point(F.lit(2.0), z, z), g.point(F.lit(2.0) + gap, z, z), g.point(F.lit(1.0), F.lit(3.0), z))
    faces = t.part.select(F.lit(1).alias("mesh_id"), F.col("p_partkey").alias("face_id"), F.lit("ROOF").alias("element"), ring.alias("ring"))
    return mesh.without_double_points(faces).select("face_id", "doubled", "repaired")


@query("SELECT k AS mesh_id, CASE kind WHEN 1 THEN 6 ELSE 4 END::BIGINT AS n FROM (" + BOXES + ") WHERE kind < 4")
def open_edges(t):
    return mesh.open_edges(t.boxes).groupBy("mesh_id").agg(F.count("*").alias("n"))


# a roof looks straight up, and counts as a wall by the rule of angles
@query("SELECT k AS mesh_id, 6::BIGINT AS face_id, CASE kind WHEN 3 THEN 'GROUND' ELSE 'WALL' END AS element, 4 AS corners, w, CASE kind WHEN 0 THEN 0e0 ELSE l END AS l, CASE kind WHEN 0 THEN h ELSE 0e0 END AS h"
       " FROM (" + BOXES + ") WHERE kind IN (0, 2, 3)")
def solid_closed(t):
    new = mesh.closed(t.boxes.where("mesh_id % 5 <> 1")).where("repaired")
    b = g.bounds(F.col("ring"), "xyz")
    sides = {n: (b[f"max_{k}"] - b[f"min_{k}"]).alias(n) for n, k in (("w", "x"), ("l", "y"), ("h", "z"))}
    return new.select("mesh_id", "face_id", "element", F.size("ring").alias("corners"), *sides.values())


@query("SELECT k AS mesh_id, 0::BIGINT AS a, 1::BIGINT AS b FROM (SELECT p_partkey AS k, p_partkey % 7 AS px, p_partkey % 5 AS py FROM part) WHERE (px < 6 AND py < 3) OR px < 3")
def crossing_faces(t):
    x, y = F.col("p_partkey") % 7 + F.lit(0.5), F.col("p_partkey") % 5 + F.lit(0.5)
    # an L on the ground, a triangle through it or through its notch, one that stands on it, one that shares an edge
    rings = [
        ring_of((0, 0, 0), (6, 0, 0), (6, 3, 0), (3, 3, 0), (3, 6, 0), (0, 6, 0)), ring_of((x, y, -1), (x + 0.2, y, -1), (x + 0.1, y, 1)),
        ring_of((x, y + 0.25, 0), (x + 0.2, y + 0.25, 0), (x + 0.1, y + 0.25, 1)), ring_of((0, 0, 0), (6, 0, 0), (3, 0, 2)),
    ]
    all_ = F.array(*(F.struct(F.lit(i).cast("long").alias("face_id"), r.alias("ring")) for i, r in enumerate(rings)))
    faces = t.part.select(F.col("p_partkey").alias("mesh_id"), F.explode(all_).alias("f")).select("mesh_id", "f.*")
    return mesh.crossing_faces(faces, 4.0)


@query("SELECT cast(k AS bigint) AS face_id, count(*) AS parts, round(sum(area), 6) AS area FROM (SELECT k, unnest([w * h / 2, w * h / 2]) AS area FROM (" + SHAPES + ") WHERE kind = 3 AND lift > 0) GROUP BY 1"
       " UNION ALL SELECT k, 1, round(CASE kind WHEN 4 THEN w * h / 2 WHEN 5 THEN w * h / 2 ELSE w * h END, 6) FROM (" + SHAPES + ") WHERE kind IN (0, 1, 4, 5) OR kind = 3 AND lift = 0")
def planar_parts(t):
    parts = mesh.planar(t.shapes, mesh.checked(t.shapes))
    return parts.groupBy("face_id").agg(F.count("*").alias("parts"), r6(F.sum(g.area(F.col("ring")))).alias("area"))


@query("SELECT k % 100 AS mesh_id, 'double_point' AS \"check\", count(*) AS n FROM (" + SHAPES + ") WHERE kind IN (1, 6) GROUP BY 1 UNION ALL SELECT k % 100, 'zero_area', count(*) FROM (" + SHAPES
       + ") WHERE kind = 2 GROUP BY 1 UNION ALL SELECT k % 100, 'non_plane', count(*) FROM (" + SHAPES + ") WHERE kind = 3 AND lift > 0 GROUP BY 1 UNION ALL SELECT k % 100, 'self_intersection', count(*) FROM ("
       + SHAPES + ") WHERE kind IN (4, 5) GROUP BY 1")
def violation_counts(t):
    return mesh.violations(mesh.checked(t.shapes)).groupBy("mesh_id", "check").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'SKIP' WHEN 2 THEN 'WARN' ELSE 'SUCCESS' END AS tx, CASE WHEN o_orderstatus = 'P' THEN 'ERROR' ELSE 'SUCCESS' END AS a,
 CASE WHEN o_orderkey % 11 = 0 THEN 'WARN' ELSE 'SUCCESS' END AS b FROM orders)
 SELECT CASE WHEN tx IN ('ERROR','SKIP') THEN 'ERROR' WHEN tx = 'WARN' OR a <> 'SUCCESS' OR b <> 'SUCCESS' THEN 'WARN' ELSE 'SUCCESS' END AS status, count(*) AS n FROM s GROUP BY 1""")
def status_rollup(t):
    k = F.col("o_orderkey")
    tx = F.when(k % 7 == 0, "ERROR").when(k % 7 == 1, "SKIP").when(k % 7 == 2, "WARN").otherwise("SUCCESS")
    a = F.when(F.col("o_orderstatus") == "P", "ERROR").otherwise("SUCCESS")
    b = F.when(k % 11 == 0, "WARN").otherwise("SUCCESS")
    return t.orders.select(building.building_status(tx, a, b).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT m AS mesh, count(*) AS n FROM (SELECT cast((cast(floor(value/10*240) AS bigint) % 2) * 2 + (cast(floor((100 + (event_id % 100)/100.0e0 - 100)*160) AS bigint) % 2) + 1 AS int) AS m FROM events) GROUP BY 1""")
def mesh_quadrant(t):
    m = g.mesh_quadrant(F.col("value") / 10, F.lit(100) + (F.col("event_id") % 100) / F.lit(100.0))
    return t.events.select(m.alias("mesh")).groupBy("mesh").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, event_id, event_type AS v FROM events), l AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
 r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT user_id, cast(run AS bigint) AS run, v AS mesh, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def mesh_runs(t):
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = graph.runs(t.events.select("user_id", "event_id", F.col("event_type").alias("mesh")), by, F.col("mesh"))
    return rows.groupBy("user_id", F.col("run").cast("long").alias("run"), "mesh").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey % 40 AS k, (p_partkey * 37 % 101) AS x0, (p_partkey * 53 % 97) AS y0, (p_partkey * 37 % 101) + p_size AS x1, (p_partkey * 53 % 97) + p_size % 17 + 1 AS y1 FROM part)
 SELECT a.k, a.id AS a, c.id AS b FROM b a JOIN b c ON a.k = c.k AND a.id < c.id AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1""")
def rect_overlap_pairs(t):
    k = F.col("p_partkey")
    b = t.part.select(
        k.alias("id"), (k % 40).alias("k"), (k * 37 % 101).alias("x0"), (k * 53 % 97).alias("y0"),
        (k * 37 % 101 + F.col("p_size")).alias("x1"), (k * 53 % 97 + F.col("p_size") % 17 + 1).alias("y1"),
    )
    return spatial.box_pairs(b, 32.0, ("k",))


@query("""SELECT doc_id, cast(greatest(0, least(i * 120, n_chars - 120)) AS int) AS start FROM (SELECT doc_id, n_chars, unnest(range(0, cast(greatest(ceil(n_chars / 120.0e0), 1) AS bigint))) AS i FROM documents)""")
def tile_offsets(t):
    return t.documents.select("doc_id", F.explode(g.tile_offsets(F.col("n_chars"), 120)).alias("start"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT query_id, vec_id, sqrt(list_sum(list_transform(list_zip(q, embedding), lambda s: pow(s[1]::DOUBLE - s[2]::DOUBLE, 2)))) AS d FROM embeddings, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM p) SELECT query_id, vec_id, cast(rank AS int) AS rank, round(d, 4) AS distance FROM r WHERE rank <= 5""")
def knn_embedding(t):
    rows = t.embeddings
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = spatial.nearest_vectors(queries, rows, 5)
    return near.select("query_id", "vec_id", "rank", F.round("distance", 4).alias("distance"))


@query("""SELECT c_custkey AS build_id, CASE WHEN c_nationkey = 3 THEN 'ERROR' WHEN n IS NULL THEN 'WARN' ELSE 'SUCCESS' END AS status, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def mesh_join_status(t):
    status = F.when(F.col("c_nationkey") == 3, "ERROR").otherwise("SUCCESS")
    buildings = t.customer.select(F.col("c_custkey").alias("build_id"), status.alias("status"))
    meshes = t.orders.groupBy(F.col("o_custkey").alias("build_id")).agg(F.count("*").alias("n"))
    return citygml.with_meshes(buildings, meshes).select("build_id", "status", "n")


@query("""WITH v AS (SELECT p_partkey AS face_id, n_nationkey AS photo_no, (p_partkey + n_nationkey) % 3 > 0 AS visible, cast((p_size * (n_nationkey % 5 + 1)) % 17 AS double) AS area FROM part, nation),
 r AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY area DESC, photo_no DESC) AS k FROM v WHERE visible) SELECT face_id, photo_no, area FROM r WHERE k = 1""")
def photo_best_per_face(t):
    photos = t.nation.select(F.col("n_nationkey").alias("photo_no"))
    v = spatial.crossed(t.part, photos).select(
        F.col("p_partkey").alias("face_id"), "photo_no", ((F.col("p_partkey") + F.col("photo_no")) % 3 > 0).alias("visible"),
        ((F.col("p_size") * (F.col("photo_no") % 5 + 1)) % 17).cast("double").alias("area"),
    )
    return texture.best_photo(v)


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey % 41)::DOUBLE AS x, (p_partkey % 31)::DOUBLE AS y, (p_size + 10)::DOUBLE AS z FROM part)
 SELECT id, round(50 - 2.0e0 * (x - 20) / (z - 100) / 0.02e0, 4) AS u, round(50 + 2.0e0 * (y - 15) / (z - 100) / 0.02e0, 4) AS v FROM p""")
def project_points(t):
    k = F.col("p_partkey")
    p = g.point((k % 41).cast("double"), (k % 31).cast("double"), (F.col("p_size") + 10).cast("double"))
    m = g.rotation_matrix(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    camera = g.point(F.lit(20.0), F.lit(15.0), F.lit(100.0))
    s = g.projected(p, camera, m, F.lit(2.0), F.lit(0.02), F.lit(100.0), F.lit(100.0))
    return t.part.select(k.alias("id"), F.round(s["u"], 4).alias("u"), F.round(s["v"], 4).alias("v"))


@query()
def components_radius(t):
    k = F.col("c_custkey")
    p = t.customer.select(k.alias("id"), (k * 37 % 20011).cast("double").alias("x"), (F.col("c_nationkey") * 4).cast("double").alias("y"))
    return graph.radius_components(p, 4.0)


@query()
def dbscan_grid(t):
    """Points of all buildings, each on ground of its own; points that differ in nothing are one, by a number of their content."""
    rows = t.points.select("building_id", "x", (F.col("y") + F.col("building_id") * 100).alias("y"), "z").distinct()
    rows = rows.select(F.xxhash64("x", "y", "z").alias("id"), "x", "y", "z")
    return graph.dbscan(rows, 0.5, 5, 20, "xyz").groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def heights_clustered(t):
    return grouped.heights_clustered(t.points, 0.5)


@query()
def seed_greedy_merge(t):
    rows = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("value") / 10).alias("mean"))
    return grouped.seeds_merged(rows, 2.0).select("key", "seq", "grp")


@query()
def atlas_pack(t):
    k = F.col("p_partkey")
    rects = t.part.select((k % 20).alias("atlas"), k.alias("seq"), (k % 97).cast("string").alias("building"), F.col("p_size").cast("int").alias("w"), (F.col("p_size") % 17 + 1).cast("int").alias("h"))
    return grouped.packed(rects, 256).select("atlas", "seq", "page", "x", "y")


@query()
def shelf_pack(t):
    k = F.col("p_partkey")
    rects = t.part.select((k % 20).alias("atlas"), k.alias("seq"), F.col("p_size").cast("int").alias("w"), (F.col("p_size") % 17 + 1).cast("int").alias("h"))
    return grouped.shelved(rects, 256).select("atlas", "seq", "x", "y", "page_w", "page_h")


@query("SELECT k AS face_id, 3::BIGINT AS n, round(w * h - w * (h - y) / 2, 6) AS area, 3::BIGINT AS best_n, round(w * h - w * (h - y) / 2, 6) AS best_area FROM (" + DENTS + ")")
def ear_clip(t):
    rings = t.dents.select("face_id", "ring")
    p = lambda c: F.get("ring", F.col(c))
    own = g.area(F.array(p("a"), p("b"), p("c")))
    made = []
    for best, pre in ((False, ""), (True, "best_")):
        cut = grouped.triangulated(t.dents, best).join(rings, "face_id").withColumn("own", own)
        made.append(cut.groupBy("face_id").agg(F.count("*").alias(f"{pre}n"), r6(F.sum("own")).alias(f"{pre}area")))
    return made[0].join(made[1], "face_id")


@query("""SELECT least(a, b) AS a, greatest(a, b) AS b, max(label) AS label FROM (SELECT o_custkey % 60 AS a, o_orderkey % 60 AS b, cast(o_orderkey % 3 AS int) AS label FROM orders) GROUP BY 1, 2""")
def graph_simplify(t):
    e = t.orders.select((F.col("o_custkey") % 60).alias("a"), (F.col("o_orderkey") % 60).alias("b"), (F.col("o_orderkey") % 3).cast("int").alias("label"))
    return graph.merged_edges(e)


@query()
def leaf_pruning(t):
    e = t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 97 + 1_000_000_000).alias("b"))
    return graph.pruned_leaves(e)


@query()
def geodetic_round_trip(t):
    lat, lon = F.lit(35.0) + F.col("value") / 1000, F.lit(139.0) + (F.col("event_id") % 1000) / 1000
    rows = t.events.select("event_id", lat.alias("lat"), lon.alias("lon"), g.to_cartesian(lat, lon, 9).alias("p"))
    back = g.to_polar(F.col("p.x"), F.col("p.y"), 9)
    return rows.select("event_id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round(back["lat"] - F.col("lat"), 9).alias("dlat"), F.round(back["lon"] - F.col("lon"), 9).alias("dlon"))


@query(f"""WITH e AS (SELECT building_id, floor(min(x) / 0.25e0) * 0.25e0 AS l, ceil(max(y) / 0.25e0) * 0.25e0 AS t FROM ({POINTS}) GROUP BY 1),
 p AS (SELECT building_id, cast(round_even((x - l) / 0.25e0, 0) AS int) AS col, cast(round_even((y - t) / -0.25e0, 0) AS int) AS row, l, t FROM ({POINTS}) JOIN e USING (building_id))
 SELECT building_id, min(col) AS min_col, min(row) AS min_row, max(col) - min(col) + 1 AS width, max(row) - min(row) + 1 AS height, round(sum(cast(col * 0.25e0 + l AS double)), 3) AS gx, round(sum(cast(row * -0.25e0 + t AS double)), 3) AS gy FROM p GROUP BY 1""")
def ortho_raster(t):
    rows = raster.to_geo(raster.ortho_pixels(t.points, 0.25, ("building_id",)), 0.25)
    sums = rows.groupBy("building_id").agg(F.round(F.sum(F.col("gx").cast("double")), 3).alias("gx"), F.round(F.sum(F.col("gy").cast("double")), 3).alias("gy"))
    return raster.extent(rows, ("building_id",)).join(sums, "building_id")


@query("""WITH p AS (SELECT o_custkey % 40 AS building_id, cast(o_orderkey % 13 AS int) AS col, cast(o_custkey % 11 AS int) AS row, o_orderkey AS pid FROM orders)
 SELECT building_id, col, row, cast(arg_max(pid % 7, pid) AS double) AS value FROM p GROUP BY ALL""")
def pixel_last_write(t):
    k = F.col("o_orderkey")
    p = t.orders.select((F.col("o_custkey") % 40).alias("building_id"), (k % 13).cast("int").alias("col"), (F.col("o_custkey") % 11).cast("int").alias("row"), k.alias("pid"), (k % 7).cast("double").alias("value"))
    return raster.last_write(p, ("building_id",), "value", "pid")


@query("""WITH p AS (SELECT DISTINCT o_custkey % 40 AS building_id, cast(o_orderkey % 13 AS int) AS col, cast(o_custkey % 11 AS int) AS row FROM orders),
 n AS (SELECT a.building_id, a.col, a.row, count(*) AS n FROM p a JOIN p b ON a.building_id = b.building_id AND abs(a.col - b.col) <= 1 AND abs(a.row - b.row) <= 1 GROUP BY ALL)
 SELECT building_id, col, row FROM n WHERE n < 9""")
def outline_pixels(t):
    p = t.orders.select((F.col("o_custkey") % 40).alias("building_id"), (F.col("o_orderkey") % 13).cast("int").alias("col"), (F.col("o_custkey") % 11).cast("int").alias("row"))
    return raster.missing_neighbour(p, ("building_id",))


@query("""WITH p AS (SELECT s_suppkey AS building_id, unnest([0, 1, 2]) AS pid FROM supplier), q AS (SELECT building_id, pid, (building_id * 5 + pid * 7) % 19 AS col, (building_id * 3 + pid * 11) % 17 AS row FROM p),
 e AS (SELECT building_id, max(col) AS w, max(row) AS h FROM q GROUP BY 1), x AS (SELECT building_id, unnest(range(0, w + 1)) AS col, h FROM e), g AS (SELECT building_id, col, unnest(range(0, h + 1)) AS row FROM x),
 d AS (SELECT g.building_id, g.col, g.row, q.pid, (g.col - q.col) ** 2 + (g.row - q.row) ** 2 AS d FROM g JOIN q USING (building_id))
 SELECT building_id, cast(sum(pid + 1) AS double) AS total, count(*) AS n FROM (SELECT building_id, col, row, arg_min(pid, d * 10 + pid) AS pid FROM d GROUP BY ALL) GROUP BY 1""")
def raster_filled(t):
    b = F.col("s_suppkey")
    p = t.supplier.select(b.alias("building_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("pid"))
    p = p.select("building_id", "pid", ((F.col("building_id") * 5 + F.col("pid") * 7) % 19).alias("col"), ((F.col("building_id") * 3 + F.col("pid") * 11) % 17).alias("row"), (F.col("pid") + 1).alias("value"))
    return raster.filled(p).groupBy("building_id").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT s_suppkey AS id, s_suppkey % 5 + 4 AS w, s_suppkey % 3 + 4 AS h, s_suppkey % 2 + 1 AS d FROM supplier)
 SELECT id AS building_id, 0 AS seq, 0 AS x0, 0 AS y0, cast(w AS int) AS x1, cast(h AS int) AS y1 FROM b UNION ALL SELECT id, 1, cast(w - d AS int), cast(h - d AS int), cast(w AS int), cast(h AS int) FROM b""")
def rectangle_decomposition(t):
    b = F.col("s_suppkey")
    p = t.supplier.select(b.alias("building_id"), (b % 5 + 4).alias("w"), (b % 3 + 4).alias("h"), (b % 2 + 1).alias("d"))
    p = p.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)))
    return raster.decomposed(p.where("NOT (col >= w - d AND row >= h - d)"), 1)


@query("""SELECT s_suppkey AS building_id, cast(2 + s_suppkey % 3 AS bigint) AS parts, cast((2 + s_suppkey % 3) * 6 AS bigint) AS n FROM supplier""")
def mask_parts(t):
    b = F.col("s_suppkey")
    p = t.supplier.select(b.alias("building_id"), F.explode(F.sequence(F.lit(0).cast("long"), b % 3 + 1)).alias("k"))
    # blocks that touch at corners only
    p = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    p = p.select("building_id", (F.col("k") * 2 + F.col("i") % 2).alias("col"), (F.col("k") * 3 + F.floor(F.col("i") / 2)).alias("row"))
    return raster.mask_parts(p).groupBy("building_id").agg(F.max("part").cast("long").alias("parts"), F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, o_orderkey % 50 AS col, o_custkey % 40 AS row, true AS back FROM orders""")
def raster_turned(t):
    p = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9).alias("building_id"), (F.col("o_orderkey") % 50).alias("col"), (F.col("o_custkey") % 40).alias("row"))
    rows = raster.untwisted(raster.turned(p, 0.6, ("building_id",)), 0.6)
    near = (F.abs(F.col("bx") - F.col("col")) <= 0.75) & (F.abs(F.col("by") - F.col("row")) <= 0.75) & (F.col("tcol") >= 0) & (F.col("trow") >= 0)
    return rows.select("id", "col", "row", near.alias("back"))


@query("""WITH v AS (""" + VECTORS + """) SELECT id, round(abs(0.5e0*ax - 0.25e0*ay - az + 2) / sqrt(0.25e0 + 0.0625e0 + 1), 6) AS away,
 round(sqrt(3e0), 6) AS unit FROM v""")
def height_planes(t):
    a = F.col("a")
    away = g.height_plane_distance(a, F.lit(0.5), F.lit(-0.25), F.lit(2.0))
    e = g.plane(g.point(F.lit(0.0), F.lit(0.0), F.lit(1.0)), g.point(F.lit(1.0), F.lit(0.0), F.lit(0.0)), g.point(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    far = g.plane_distance(e, g.point(F.lit(4.0) / 3, F.lit(4.0) / 3, F.lit(4.0) / 3))
    return t.vectors.select("id", r6(away).alias("away"), r6(far).alias("unit"))


@query("SELECT k AS face_id, CASE WHEN k % 2 = 0 THEN 'ROOF' END AS element, CASE WHEN k % 2 = 0 THEN 'Roof' END AS title, CASE WHEN w * h > 40 THEN 2 ELSE 1 END AS parts FROM (" + DENTS + ")")
def element_names(t):
    ring = F.transform("ring", lambda p: g.point(p.x, p.y))
    box = g.bounds(F.col("ring"))
    whole = F.array(*(g.point(box[f"{a}_x"], box[f"{b}_y"]) for a, b in (("min", "min"), ("max", "min"), ("max", "max"), ("min", "max"))))
    unit = F.array(*(g.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (41.0, 0.0), (41.0, 1.0), (0.0, 1.0))))
    name = F.when(F.col("face_id") % 2 == 0, "Roof").otherwise("Other")
    element = g.element_named(name)
    found = g.parts(F.array(whole, unit, F.slice(ring, 1, 2)), 40.0)
    return t.dents.select("face_id", element.alias("element"), g.element_title(element).alias("title"), F.size(found).alias("parts"))


@query(f"""WITH b AS ({FOOTPRINTS}) SELECT building_id, unnest([0, 1, 2, 3]) AS edge, unnest([0e0, 1e0, 0e0, -1e0]) AS nx, unnest([-1e0, 0e0, 1e0, 0e0]) AS ny, true AS hole_flips, true AS outwards FROM b""")
def wall_directions(t):
    rows = t.rings.select("building_id", "ring", F.posexplode(g.edges(F.col("ring"))).alias("edge", "e"))
    p, q, ring = F.col("e.p"), F.col("e.q"), F.col("ring")
    n, h = g.wall_normal(p, q, ring, F.lit(False)), g.wall_normal(p, q, ring, F.lit(True))
    wall = F.array(*(g.point(c["x"], c["y"], F.lit(z)) for c, z in ((p, 0.0), (q, 0.0), (q, 3.0), (p, 3.0))))
    ok = (g.wound_outwards(wall, n) == wall) & (g.wound_outwards(F.reverse(wall), n) != F.reverse(wall))
    rows = rows.select("building_id", "edge", n.alias("n"), h.alias("h"), ok.alias("outwards"))
    return rows.select("building_id", "edge", (F.col("n.x") + 0.0).alias("nx"), (F.col("n.y") + 0.0).alias("ny"), ((F.col("h.x") == -F.col("n.x")) & (F.col("h.y") == -F.col("n.y"))).alias("hole_flips"), "outwards")


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey % 17) / 32e0 AS u0, (p_partkey % 13) / 32e0 AS v0, (p_partkey % 17) / 32e0 + 0.25e0 AS u1, (p_partkey % 13) / 32e0 + 0.375e0 AS v1, p_size * 8 AS w, p_size * 4 AS h FROM part)
 SELECT id, cast(floor((1 - v1) * h) AS int) AS r0, cast(floor(u0 * w) AS int) AS c0, cast(ceil((1 - v0) * h) AS int) AS r1, cast(ceil(u1 * w) AS int) AS c1,
 cast(greatest(1, floor(w * (128e0 / w))) AS int) AS fw, cast(CASE WHEN id % 3 = 0 THEN w * 0.125e0 / 0.25e0 ELSE w END AS int) AS dw,
 cast(greatest(0, least((id % 7 % greatest(ceil(w / 120e0), 1)) * 120, w - 120)) * 4 AS int) AS tx,
 cast(CASE WHEN floor(u0 * w) - 2 >= 0 THEN floor(u0 * w) - 2 ELSE floor(u0 * w) END AS int) AS bx0, cast(CASE WHEN ceil(u1 * w) + 2 <= w THEN ceil(u1 * w) + 2 ELSE ceil(u1 * w) END AS int) AS bx1 FROM p""")
def texture_pixels(t):
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("id"), ((k % 17) / 32).alias("u"), ((k % 13) / 32).alias("v"), (F.col("p_size") * 8).alias("w"), (F.col("p_size") * 4).alias("h"))
    us, vs, w, h = F.array("u", F.col("u") + 0.25), F.array("v", F.col("v") + 0.375), F.col("w"), F.col("h")
    a, b = g.uv_start(us, vs, w, h), g.uv_end(us, vs, w, h)
    fit, down = g.fitted_size(w, h, 128), g.downscaled(w, h, F.when(F.col("id") % 3 == 0, 0.125).otherwise(0.25))
    tile = g.tile_place((F.col("id") % 7).cast("int"), w, h, 120)
    box = g.texture_box(F.transform(us, lambda c: c * w), F.transform(vs, lambda c: c * h), w, h)
    return rows.select("id", a["row"].alias("r0"), a["col"].alias("c0"), b["row"].alias("r1"), b["col"].alias("c1"), fit["w"].alias("fw"), down["w"].alias("dw"), tile["x"].alias("tx"), box["x0"].alias("bx0"), box["x1"].alias("bx1"))


@query("""WITH v AS (""" + VECTORS + """), w AS (SELECT id, ax, ay, bx, by_, (ax * bx + ay * by_) / nullif(bx * bx + by_ * by_, 0) AS t FROM v),
 c AS (SELECT *, CASE WHEN t < 0 THEN -floor(abs(t) * 10000) / 10000 ELSE floor(abs(t) * 10000) / 10000 END AS k FROM w)
 SELECT id, round(k + 0, 6) AS t, round(sqrt(pow(ax - k * bx, 2) + pow(ay - k * by_, 2)), 6) AS distance FROM c""")
def truncated_foot(t):
    foot = g.truncated_foot(F.col("a"), g.point(F.lit(0.0), F.lit(0.0)), F.col("b"))
    return t.vectors.select("id", r6(foot["t"]).alias("t"), r6(foot["distance"]).alias("distance"))


@query("SELECT id % 100 AS mesh_id, id AS face_id, true AS plane_area, true AS upright FROM (" + QUADS + ") WHERE lift = 0")
def face_planes(t):
    import pyarrow as pa

    rows = t.quads.where("face_id % 4 = 0").withColumn("ring", F.transform("ring", lambda p: g.point(p.x, p.y * 0.6, p.y * 0.8 + F.col("face_id"))))

    def run(batches):
        for batch in batches:
            area, upright = [], []
            for ring in batch.column(2).to_pylist():
                p = np.array([(c["x"], c["y"], c["z"]) for c in ring])
                size = np.linalg.norm(p[1] - p[0]) * np.linalg.norm(p[3] - p[0])
                area.append(bool(abs(abs(kernels.signed_area(kernels.local_2d(p))) - size) < 1e-6 * size))
                q = kernels.turned_to_xz(p)
                upright.append(bool(np.ptp(q[:, 1]) < 1e-6 and abs(np.ptp(q[:, 0]) * np.ptp(q[:, 2]) - size) < 1e-6 * size))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(area), pa.array(upright)], names=["mesh_id", "face_id", "plane_area", "upright"])

    return rows.select("mesh_id", "face_id", "ring").mapInArrow(run, "mesh_id long, face_id long, plane_area boolean, upright boolean")


@query("""WITH s AS (SELECT s_suppkey AS building_id, o_orderkey AS sample_id, (o_orderkey % 60) * 0.5e0 AS x, (o_custkey % 40) * 0.5e0 AS y FROM orders JOIN supplier ON o_custkey % 10 = s_suppkey % 10 AND o_orderkey % 16 = 0 AND s_suppkey <= 20),
 p AS (SELECT s_suppkey AS building_id, unnest([0, 1, 2]) AS plane FROM supplier WHERE s_suppkey <= 20), b AS (SELECT building_id, plane, plane * 8e0 + building_id % 3 AS x0, plane * 4e0 AS y0, plane * 8e0 + building_id % 3 + 6 AS x1, plane * 4e0 + 5 AS y1 FROM p),
 d AS (SELECT s.building_id, sample_id, plane, CASE WHEN plane = 2 AND s.building_id % 2 = 0 THEN 999e0 WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 THEN least(x - x0, x1 - x, y - y0, y1 - y)
  ELSE sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) END AS d FROM s JOIN b USING (building_id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY building_id, sample_id ORDER BY round(d, 9), plane) AS k FROM d) SELECT building_id, sample_id, round(d, 6) AS distance FROM r WHERE k = 1""")
def nearest_plane(t):
    o = t.orders.where("o_orderkey % 16 = 0")
    s = o.join(t.supplier.where("s_suppkey <= 20"), F.col("o_custkey") % 10 == F.col("s_suppkey") % 10)
    s = s.select(F.col("s_suppkey").alias("building_id"), F.col("o_orderkey").alias("sample_id"), ((F.col("o_orderkey") % 60) * F.lit(0.5)).alias("x"), ((F.col("o_custkey") % 40) * F.lit(0.5)).alias("y"))
    p = t.supplier.where("s_suppkey <= 20").select(F.col("s_suppkey").alias("building_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("plane"))
    x, y = F.col("plane") * F.lit(8.0) + F.col("building_id") % 3, F.col("plane") * F.lit(4.0)
    ring = F.array(g.point(x, y), g.point(x + 6, y), g.point(x + 6, y + 5), g.point(x, y + 5))
    p = p.withColumn("ring", F.when((F.col("plane") != 2) | (F.col("building_id") % 2 != 0), ring))
    return modeling.nearest_plane(s, p).select("building_id", "sample_id", r6(F.col("distance")).alias("distance"))


RELATED = """SELECT p_partkey AS id, p_partkey % 40 AS k, cast(p_partkey * 37 % 101 as double) AS x0, cast(p_partkey * 53 % 97 as double) AS y0, cast(p_partkey * 37 % 101 + p_size as double) AS x1,
 cast(p_partkey * 53 % 97 + p_size % 17 + 1 as double) AS y1 FROM part"""
RELATIONS = f"""WITH b AS ({RELATED}), p AS (SELECT a.k, a.id AS a, c.id AS b, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS common,
 (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (c.x1 - c.x0) * (c.y1 - c.y0) AS sc, sqrt(pow(greatest(0, c.x0 - a.x1, a.x0 - c.x1), 2) + pow(greatest(0, c.y0 - a.y1, a.y0 - c.y1), 2)) AS d FROM b a JOIN b c ON a.k = c.k AND a.id <> c.id)
 SELECT k, a, b, CASE WHEN common / sc > 0.9 THEN 'CONTAINING' WHEN common / sa > 0.9 THEN 'CONTAINED' ELSE 'NEIGHBORING' END AS relation FROM p WHERE common / sc > 0.9 OR common / sa > 0.9 OR d < 0.5"""


@query(RELATIONS)
def box_relations(t):
    return spatial.box_relations(t.sql(RELATED, "part"), 32.0, ("k",))


@query(RELATIONS)
def polygon_relations(t):
    b = t.sql(RELATED, "part")
    ring = F.array(*(g.point(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    return modeling.polygon_relations(b.select("k", "id", ring.alias("ring")), 32.0, ("k",))


@query(f"""WITH r AS ({RELATIONS}), h AS (SELECT DISTINCT k, b AS id FROM r WHERE relation = 'CONTAINING'), c AS (SELECT b.k, b.id, (x1 - x0) * (y1 - y0) AS area, 2 * ((x1 - x0) + (y1 - y0)) AS per, b.id % 3 < 2 AS low, h.id IS NOT NULL AS held FROM ({RELATED}) b LEFT JOIN h ON b.k = h.k AND b.id = h.id),
 f AS (SELECT *, low AND (held OR area < 20 OR area / per < 1) AS gr FROM c), m AS (SELECT *, bool_and(gr) OVER (PARTITION BY k) AS none, row_number() OVER (PARTITION BY k ORDER BY area DESC, id) AS n FROM f)
 SELECT k AS building_id, id, CASE WHEN none AND n = 1 THEN false ELSE gr END AS is_ground FROM m""")
def ground_clusters(t):
    b = t.sql(RELATED, "part")
    held = spatial.boxes_held(b, 32.0, ("k",))
    relations = held.select(F.col("k").alias("building_id"), F.col("id").alias("b"), F.lit("CONTAINING").alias("relation"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    height = F.when(F.col("id") % 3 < 2, 1.0).otherwise(9.0)
    c = b.select(F.col("k").alias("building_id"), "id", height.alias("height"), F.lit(5.0).alias("ground"), (w * h).alias("area"), (2 * (w + h)).alias("perimeter"))
    return modeling.ground_clusters(c, relations).select("building_id", "id", "is_ground")


@query("""WITH c AS (SELECT user_id AS building_id, event_id AS cluster, cast(floor(value) AS bigint) % 9 AS n, value AS height FROM events)
 SELECT building_id, cluster, cast(row_number() OVER (PARTITION BY building_id ORDER BY n DESC, cluster) - 1 AS int) AS by_size, cast(row_number() OVER (PARTITION BY building_id ORDER BY height DESC, cluster DESC) - 1 AS int) AS by_height,
 cast(row_number() OVER (PARTITION BY building_id ORDER BY n, cluster % 5 DESC, cluster DESC) - 1 AS int) AS insertion, cast(row_number() OVER (PARTITION BY building_id ORDER BY n, cluster) - 1 AS int) AS by_mesh FROM c""")
def orderings(t):
    c = t.events.select(F.col("user_id").alias("building_id"), F.col("event_id").alias("cluster"), (F.floor("value") % 9).alias("n"), F.col("value").alias("height"))
    keys = ["building_id", "cluster"]
    size = modeling.clusters_by_size(c).select(*keys, F.col("rank").alias("by_size"))
    high = modeling.planes_by_height(c.withColumnRenamed("cluster", "plane")).select("building_id", F.col("plane").alias("cluster"), F.col("rank").alias("by_height"))
    put = c.select(*keys, F.col("n").alias("roof"), (F.col("cluster") % 5).alias("place"), F.col("cluster").alias("t"))
    put = modeling.insertions(put).select(*keys, F.col("rank").alias("insertion"))
    code = c.select(F.col("building_id").alias("file"), F.col("cluster").alias("seq"), F.col("n").alias("code"))
    code = modeling.by_mesh(code).select(F.col("file").alias("building_id"), F.col("seq").alias("cluster"), F.col("rank").alias("by_mesh"))
    return size.join(high, keys).join(put, keys).join(code, keys)


@query("SELECT mesh AS building_id, arg_max(k, area * 100000 - k) AS ring_id FROM (SELECT k % 100 AS mesh, k, round(w * h - w * (h - y) / 2, 6) AS area FROM (" + DENTS + ")) GROUP BY 1")
def outer_ring(t):
    return modeling.outer_ring(t.dents.select(F.col("mesh_id").alias("building_id"), F.col("face_id").alias("ring_id"), "ring"))


@query("SELECT parent, cast(count(*) AS bigint) AS n, min(child) AS first FROM (SELECT p_partkey AS child, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS parent FROM part) WHERE parent IS NOT NULL GROUP BY 1")
def sibling_roofs(t):
    p = t.part.select(F.col("p_partkey").alias("child"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).alias("parent"))
    return modeling.siblings(p).select("parent", F.size("children").cast("long").alias("n"), F.get("children", F.lit(0)).alias("first"))


@query("""SELECT 'a' AS name, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'b', o_orderpriority, count(*) FROM orders GROUP BY 2""")
def status_counts(t):
    return modeling.status_counts(t.orders.select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")), ["a", "b"])


@query(f"""WITH b AS ({FOOTPRINTS}), c AS (SELECT building_id, unnest([0, 1, 2, 3]) AS i, x0, y0, x1, y1 FROM b), p AS (SELECT *, CASE i WHEN 0 THEN x0 + 0.25e0 WHEN 1 THEN x1 - 0.125e0 * (building_id % 4) WHEN 2 THEN x1 + 1 ELSE x0 + 3 END AS px,
 CASE i WHEN 0 THEN y0 + 2 WHEN 1 THEN y0 + 3 WHEN 2 THEN y1 ELSE y0 + 3 END AS py FROM c), d AS (SELECT building_id, least(px - x0, x1 - px, py - y0, y1 - py) AS d FROM p) SELECT building_id AS id, max(CASE WHEN d > 0 AND d <= 0.5 THEN d ELSE 0 END) AS distance FROM d GROUP BY 1""")
def farthest_inside(t):
    x0, y0, x1, y1, b = (F.col(c) for c in ("x0", "y0", "x1", "y1", "building_id"))
    ring = F.array(g.point(x0 + 0.25, y0 + 2), g.point(x1 - F.lit(0.125) * (b % 4), y0 + 3), g.point(x1 + 1, y1), g.point(x0 + 3, y0 + 3))
    return modeling.farthest_inside(t.rings.select(b.alias("id"), ring.alias("ring"), F.col("ring").alias("outline")))


@query("""WITH e AS (SELECT o_custkey % 100 AS building_id, o_orderkey AS edge, cast(o_orderkey % 3 AS double) AS ax, 0e0 AS ay, cast(o_orderkey % 7 AS double) AS bx, cast(o_custkey % 5 AS double) AS by_ FROM orders WHERE o_orderkey % 4 = 0), n AS (SELECT *, sqrt(pow(bx-ax, 2)+pow(by_-ay, 2)) AS len FROM e),
 p AS (SELECT x.building_id, x.edge, x.len, x.ax, x.ay, x.bx, x.by_, y.len AS yl, degrees(atan2(y.by_ - y.ay, y.bx - y.ax) - atan2(x.by_ - y.ay, x.bx - y.ax)) + 720 AS a FROM n x JOIN n y USING (building_id) WHERE x.len > 0 AND y.len > 0),
 s AS (SELECT building_id, edge, len, ax, ay, bx, by_, sum(CASE WHEN least(a % 90, 90 - a % 90) <= 7 THEN yl ELSE 0 END) AS aligned FROM p GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY round(aligned, 9) DESC, len DESC, edge) AS k FROM s) SELECT building_id, edge, round(aligned, 6) AS aligned, round((ax - bx) / len + 0, 6) AS ux, round((ay - by_) / len + 0, 6) AS uy FROM r WHERE k = 1""")
def base_edge(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    e = t.orders.where("o_orderkey % 4 = 0").select((c % 100).alias("building_id"), k.alias("edge"), (k % 3).cast("double").alias("ax"), F.lit(0.0).alias("ay"), (k % 7).cast("double").alias("bx"), (c % 5).cast("double").alias("by"))
    return modeling.base_edge(e, 7.0).select("building_id", "edge", r6(F.col("aligned")).alias("aligned"), r6(F.col("ux")).alias("ux"), r6(F.col("uy")).alias("uy"))


CORNERS = """SELECT p_partkey AS id, cast(p_partkey % 50 as double) + (p_partkey % 3) * 0.03125e0 AS x, 0e0 AS y, cast(p_size % 4 as double) AS z FROM part"""


@query(f"""WITH c AS ({CORNERS}) SELECT id, round(avg(x) OVER (PARTITION BY id % 50), 6) AS x, y FROM c""")
def merged_corners(t):
    return modeling.merged_corners(t.sql(CORNERS, "part").drop("z"), 0.1).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(f"""WITH c AS ({CORNERS}), s AS (SELECT *, id % 50 AS stack, CASE WHEN z - lag(z) OVER (PARTITION BY id % 50 ORDER BY z, id) > 1 THEN 1 ELSE 0 END AS up FROM c), l AS (SELECT *, sum(up) OVER (PARTITION BY stack ORDER BY z, id ROWS UNBOUNDED PRECEDING) AS level FROM s)
 SELECT id, first_value(x) OVER (PARTITION BY stack ORDER BY id) AS x, y, max(z) OVER (PARTITION BY stack, level) AS z FROM l""")
def welded_corners(t):
    return modeling.welded_corners(t.sql(CORNERS, "part"), 0.1, 1.0)


@query("""SELECT o_custkey AS building_id, o_orderkey AS pid, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 9 < 3 THEN 'GROUND' ELSE 'ROOF' END AS kind FROM orders WHERE o_orderkey % 11 <> 0""")
def kept_apart(t):
    k = F.col("o_orderkey")
    p = t.orders.select(F.col("o_custkey").alias("building_id"), k.alias("pid"), (k % 9).cast("double").alias("z"), F.when(k % 5 != 0, k % 5).alias("label"))
    return modeling.kept_apart(p, p.where("pid % 11 = 0"), 3.0).select("building_id", "pid", "kind")


@query("""SELECT DISTINCT l_suppkey AS building_id, 0 AS level, cast(l_linenumber % 2 AS int) AS side, count(*) OVER (PARTITION BY l_suppkey, l_linenumber % 2) AS n FROM lineitem""")
def colours_clustered(t):
    side, k = F.col("l_linenumber") % 2, F.col("l_partkey")
    p = t.lineitem.select(F.col("l_suppkey").alias("building_id"), F.lit(0).alias("level"), ((side * 120 + k % 5 + 40) * 256).alias("red"), ((k % 4 + 90) * 256).alias("green"), ((k % 3 + 30) * 256).alias("blue"))
    rows = modeling.colours_clustered(p)
    return rows.groupBy("building_id", "level", (F.col("red") > 100).cast("int").alias("side"), "cluster").agg(F.sum("n").alias("n")).drop("cluster")


@query("""SELECT s_suppkey AS building_id, s_suppkey % 4 AS cluster, 1::BIGINT AS parts, cast((4 + s_suppkey % 3) * (3 + s_suppkey % 4) AS double) / 4 AS area FROM supplier""")
def contours(t):
    b = F.col("s_suppkey")
    p = t.supplier.select(b.alias("building_id"), (b % 4).alias("cluster"), F.explode(F.sequence(F.lit(0).cast("long"), b % 3 + 4)).alias("i"), (b % 4 + 3).alias("m"))
    p = p.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), "m")))
    p = p.select("building_id", "cluster", (F.col("i") * F.lit(0.5)).alias("x"), (F.col("j") * F.lit(0.5)).alias("y"))
    return modeling.contours(p).groupBy("building_id", "cluster").agg(F.count("*").alias("parts"), r6(F.sum(g.area(F.col("ring")))).alias("area"))


@query("SELECT k AS mesh_id, cast(n AS bigint) AS face_id, CASE n WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 5 END AS corners FROM (SELECT p_partkey AS k, unnest([0, 1, 2]) AS n FROM part)")
def missing_corners(t):
    k = F.col("p_partkey").cast("double")
    # a wall whose upper edge two others share; the ground sees the walls' corners, not the roof's
    rings = {
        "WALL": ring_of((0, k, 0), (4, k, 0), (4, k, 3), (0, k, 3)), "ROOF": ring_of((0, k, 3), (2, k, 3), (2, k + 2, 3), (0, k + 2, 3)), "GROUND": ring_of((0, k, 0), (0, k + 3, 0), (4, k + 3, 0), (4, k, 0)),
    }
    inner = ring_of((1, k, 0), (2, k - 1, 0), (1, k - 2, 0), (0, k - 1, 0))
    all_ = F.array(*(F.struct(F.lit(i).cast("long").alias("face_id"), F.lit(e).alias("element"), r.alias("ring")) for i, (e, r) in enumerate([*rings.items(), ("ROOF", inner)])))
    faces = t.part.select(F.col("p_partkey").alias("mesh_id"), F.explode(all_).alias("f")).select("mesh_id", "f.*").where("face_id < 3")
    more = faces.where("face_id = 0").select("mesh_id", F.lit(9).cast("long").alias("face_id"), F.lit("WALL").alias("element"), F.array(*(g.point(F.lit(x), F.lit(y) + F.col("mesh_id"), F.lit(0.0)) for x, y in ((3.0, 3.0), (3.5, 4.0), (2.5, 4.0)))).alias("ring"))
    done = modeling.with_missing_corners(faces.unionByName(more))
    return done.where("face_id < 3").select("mesh_id", "face_id", F.size("ring").alias("corners"))


@query("SELECT p_partkey AS mesh_id, cast(f AS bigint) AS face_id, cast(CASE WHEN f < 2 THEN 0 WHEN p_partkey % 20 < 5 THEN 0 ELSE 2 END AS bigint) AS grp FROM (SELECT p_partkey, unnest([0, 1, 2]) AS f FROM part)")
def coplanar_merged(t):
    rise = F.tan(F.radians(F.col("p_partkey") % 20 + F.lit(0.5)))
    rings = [ring_of((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)), ring_of((1, 0, 0), (2, 0, 0), (2, 1, 0), (1, 1, 0)), ring_of((2, 0, 0), (3, 0, rise), (3, 1, rise), (2, 1, 0))]
    all_ = F.array(*(F.struct(F.lit(i).cast("long").alias("face_id"), r.alias("ring")) for i, r in enumerate(rings)))
    faces = t.part.select(F.col("p_partkey").alias("mesh_id"), F.explode(all_).alias("f")).select("mesh_id", "f.*")
    return modeling.coplanar_merged(faces)


@query(f"""WITH b AS ({FOOTPRINTS}) SELECT building_id AS mesh_id, 'ROOF' AS element, 1::BIGINT AS n, (x1 - x0) * (y1 - y0) AS area FROM b UNION ALL SELECT building_id, 'GROUND', 1, (x1 - x0) * (y1 - y0) FROM b
 UNION ALL SELECT building_id, 'WALL', 4, 2 * ((x1 - x0) + (y1 - y0)) * 5 FROM b""")
def extruded_blocks(t):
    blocks = t.rings.select("building_id", "ring", F.lit(1.0).alias("bottom"), F.lit(6.0).alias("top"))
    faces = modeling.extruded(blocks)
    left = mesh.open_edges(faces).select("mesh_id").distinct()
    size = g.length(g.normal(F.col("ring"))) / 4  # of rectangles
    return faces.join(left, "mesh_id", "left_anti").groupBy("mesh_id", "element").agg(F.count("*").alias("n"), r6(F.sum(size)).alias("area"))


@query("""SELECT least(a, b) AS a, greatest(a, b) AS b, max(label) AS label FROM (SELECT o_custkey % 60 AS a, o_orderkey % 60 AS b, 1 AS label FROM orders UNION ALL SELECT o_orderkey % 60, o_custkey % 45, 2 FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1, 2""")
def graph_union(t):
    one = t.orders.select((F.col("o_custkey") % 60).alias("a"), (F.col("o_orderkey") % 60).alias("b"), F.lit(1).alias("label"))
    two = t.orders.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") % 60).alias("a"), (F.col("o_custkey") % 45).alias("b"), F.lit(2).alias("label"))
    return graph.united([one, two])


@query("""WITH e AS (SELECT DISTINCT least(o_custkey % 200, o_orderkey % 203) AS a, greatest(o_custkey % 200, o_orderkey % 203) AS b FROM orders), k AS (SELECT * FROM e WHERE (a + b) % 5 <> 0), d AS (SELECT a AS node, b AS near FROM k UNION SELECT b, a FROM k)
 SELECT node, count(*) AS degree, min(near) AS first FROM d WHERE node <> near GROUP BY 1""")
def graph_neighbours(t):
    e = graph.merged_edges(t.orders.select((F.col("o_custkey") % 200).alias("a"), (F.col("o_orderkey") % 203).alias("b"), F.lit(1).alias("label")))
    kept = graph.without_edges(e, e.where("(a + b) % 5 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))
    return graph.neighbours_of(kept).select("node", F.size("near").cast("long").alias("degree"), F.get("near", F.lit(0)).alias("first"))


@query("""SELECT node, label, count(*) AS degree FROM (SELECT o_custkey % 60 AS node, cast(o_orderkey % 3 AS int) AS label FROM orders UNION ALL SELECT o_orderkey % 60, cast(o_orderkey % 3 AS int) FROM orders) GROUP BY 1, 2""")
def graph_degrees(t):
    return graph.degrees(t.orders.select((F.col("o_custkey") % 60).alias("a"), (F.col("o_orderkey") % 60).alias("b"), (F.col("o_orderkey") % 3).cast("int").alias("label")))


@query("""SELECT p_partkey AS k, cast(n AS bigint) AS id, count(*) AS parts, round(sum(len), 6) AS length FROM (SELECT p_partkey, n, unnest(CASE n WHEN 0 THEN [2e0, 1e0, 1e0] WHEN 1 THEN [1e0, 2e0] WHEN 2 THEN [1e0] ELSE [4e0] END) AS len FROM (SELECT p_partkey, unnest([0, 1, 2, 3]) AS n FROM part)) GROUP BY 1, 2""")
def split_edges(t):
    k = F.col("p_partkey").cast("double")
    # one across, one through it, one that ends on it, one apart
    rows = [(0, 0, 0, 4, 0), (1, 2, -1, 2, 2), (2, 2, 0, 2, 1), (3, 0, 5, 4, 5)]
    own = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), (F.lit(float(a)) + k).alias("ax"), F.lit(float(b)).alias("ay"), (F.lit(float(c)) + k).alias("bx"), F.lit(float(d)).alias("by"), F.lit(1).alias("label")) for i, a, b, c, d in rows))
    s = t.part.select(F.col("p_partkey").alias("k"), F.explode(own).alias("s")).select("k", "s.*").where("id <> 2").unionByName(t.part.select(F.col("p_partkey").alias("k"), F.explode(own).alias("s")).select("k", "s.*").where("id = 2").withColumn("ay", F.lit(-1.0)).withColumn("ax", F.col("ax") + 1).withColumn("bx", F.col("bx") + 1).withColumn("by", F.lit(0.0)))
    parts = graph.split_edges(s, 4.0, keys=("k",))
    size = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    return parts.groupBy("k", "id").agg(F.count("*").alias("parts"), r6(F.sum(size)).alias("length"))


@query(f"""WITH b AS ({FOOTPRINTS}), n AS (SELECT b.*, unnest([0, 1, 2, 3]) AS i FROM b), p AS (SELECT *, CASE i WHEN 0 THEN x0 - 2 WHEN 1 THEN x1 + 1 WHEN 2 THEN x0 + 2 ELSE x1 - 1 END AS x, CASE i WHEN 0 THEN y0 + 3 WHEN 1 THEN y1 + 4 WHEN 2 THEN y0 + 2 ELSE y0 - 1 END AS y FROM n)
 SELECT building_id * 4 + i AS id, least(greatest(x, x0), x1) AS x, least(greatest(y, y0), y1) AS y FROM p""")
def moved_inside(t):
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    at = F.array(g.point(x0 - 2, y0 + 3), g.point(x1 + 1, y1 + 4), g.point(x0 + 2, y0 + 2), g.point(x1 - 1, y0 - 1))
    rows = t.rings.select("building_id", F.col("ring").alias("outline"), F.posexplode(at).alias("i", "p"))
    nodes = rows.select((F.col("building_id") * 4 + F.col("i")).alias("id"), "p.x", "p.y", "outline")
    return modeling.moved_inside(nodes).select("id", "x", "y")


@query("""SELECT p_partkey AS id, cast(abs(trunc((p_size * 0.25e0 + p_partkey % 7 + 1.5e0 - 3) * 1000)) AS bigint) AS key, true AS same FROM part""")
def edge_keys(t):
    p = g.point(F.col("p_size") * F.lit(0.25), F.lit(0.5), F.lit(-3.0))
    q = g.point((F.col("p_partkey") % 7).cast("double"), F.lit(1.0), F.lit(0.0))
    return t.part.select(F.col("p_partkey").alias("id"), g.edge_key(p, q).alias("key"), (g.edge_key(p, q) == g.edge_key(q, p)).alias("same"))


SEGMENTS = """SELECT o_custkey % 30 AS k, cast(o_orderkey % 9 AS double) AS ax, cast(o_orderkey % 7 AS double) + 0.001e0 AS ay, cast(o_custkey % 9 AS double) + 0.002e0 AS bx, cast(o_custkey % 7 AS double) AS by_, cast(o_orderkey % 3 AS int) AS label FROM orders WHERE o_orderkey % 4 = 0"""


@query(f"""WITH s AS ({SEGMENTS}), r AS (SELECT k, round(ax) AS ax, round(ay) AS ay, round(bx) AS bx, round(by_) AS by_, label FROM s), p AS (SELECT k, ax AS x, ay AS y FROM r UNION SELECT k, bx, by_ FROM r),
 n AS (SELECT k, x, y, row_number() OVER (PARTITION BY k ORDER BY x, y) - 1 AS node FROM p) SELECT r.k, cast(least(u.node, v.node) AS int) AS a, cast(greatest(u.node, v.node) AS int) AS b, max(label) AS label
 FROM r JOIN n u ON u.k = r.k AND u.x = ax AND u.y = ay JOIN n v ON v.k = r.k AND v.x = bx AND v.y = by_ WHERE u.node <> v.node GROUP BY 1, 2, 3""")
def graph_from_segments(t):
    s = t.sql(SEGMENTS, "orders").withColumnRenamed("by_", "by")
    return graph.from_segments(s, 0.01, ("k",))[1]


@query("""WITH c AS (SELECT c_custkey AS id, c_nationkey AS comp FROM customer) SELECT cast(min(id) AS bigint) AS comp, count(*) AS n, max(id) AS last FROM c GROUP BY comp""")
def component_groups(t):
    v = t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey")
    first = v.groupBy("c_nationkey").agg(F.min("id").alias("b"))
    labels = graph.connected(v.select("id"), v.join(first, "c_nationkey").select(F.col("id").alias("a"), "b"))
    return graph.groups(labels).select("comp", F.size("members").cast("long").alias("n"), F.array_max("members").alias("last"))


@query("""WITH e AS (SELECT o_custkey % 100 AS a, o_orderkey % 103 AS b, o_orderkey AS face FROM orders), u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, list_sort(list(face)) AS f FROM e GROUP BY 1, 2)
 SELECT a, b, f[1] AS "left", f[2] AS "right" FROM u WHERE len(f) = 2""")
def face_pairs(t):
    return graph.face_pairs(t.orders.select((F.col("o_custkey") % 100).alias("a"), (F.col("o_orderkey") % 103).alias("b"), F.col("o_orderkey").alias("face")))


@query("""WITH n AS (SELECT c_custkey AS node, cast(c_custkey % 10 AS double) AS x, cast(c_nationkey AS double) AS y FROM customer), e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 150 + 1 AS b FROM orders), j AS (SELECT e.a, e.b, degrees(atan2(v.y - u.y, v.x - u.x)) + 360 AS d FROM e JOIN n u ON u.node = e.a JOIN n v ON v.node = e.b),
 h AS (SELECT a, b, CASE WHEN least(d % 90, 90 - d % 90) <= 5 THEN 1 ELSE 0 END AS hit FROM j) SELECT node, cast(sum(hit) AS bigint) AS aligned FROM (SELECT a AS node, hit FROM h UNION ALL SELECT b, hit FROM h) GROUP BY 1""")
def aligned_edges(t):
    n = t.customer.select(F.col("c_custkey").alias("node"), (F.col("c_custkey") % 10).cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    e = t.orders.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 150 + 1).alias("b")).distinct()
    return graph.aligned_edges(n, e, 0.0, 5.0)


@query("""WITH p AS (SELECT s_suppkey AS building_id, unnest([0, 1, 2, 3, 4]) AS plane FROM supplier) SELECT building_id, plane, CASE plane WHEN 0 THEN 'NO_NEIGHBOR_LINE' WHEN 1 THEN 'ONE_NEIGHBOR_LINE' WHEN 2 THEN 'ORTHOGONAL_CROSSING' WHEN 3 THEN 'NOT_ORTHOGONAL_CROSSING' ELSE 'THREE_OR_MORE_NEIGHBOR_LINES' END AS type,
 CASE plane WHEN 0 THEN NULL WHEN 1 THEN 1e0 WHEN 2 THEN 90e0 WHEN 3 THEN 30e0 ELSE 90e0 END AS angle FROM p""")
def plane_types(t):
    b = F.col("s_suppkey").alias("building_id")
    angles, lengths = [0.0, 1.0, 30.0, 90.0], [5.0, 6.0, 7.0, 9.0]
    lines = F.array(*(F.struct(F.lit(i).cast("long").alias("line"), F.lit(a).alias("angle"), F.lit(n).alias("length")) for i, (a, n) in enumerate(zip(angles, lengths, strict=True))))
    lines = t.supplier.select(b, F.explode(lines).alias("l")).select("building_id", "l.*")
    pairs = [(0, None), (1, 0), (1, 1), (2, 0), (2, 3), (3, 1), (3, 2), (4, 0), (4, 2), (4, 3)]
    near = F.array(*(F.struct(F.lit(p).alias("plane"), F.lit(n).cast("long").alias("line")) for p, n in pairs))
    near = t.supplier.select(b, F.explode(near).alias("n")).select("building_id", "n.*")
    return modeling.plane_types(lines, near)


@query("""WITH v AS (SELECT p_partkey AS face_id, n_nationkey AS photo_no, (p_partkey + n_nationkey) % 3 > 0 AS visible, cast((p_size * (n_nationkey % 5 + 1)) % 17 AS double) AS area FROM part, nation),
 w AS (SELECT v.*, r.visible AS roof FROM v LEFT JOIN v r ON r.face_id = v.face_id * 2 AND r.photo_no = v.photo_no AND v.face_id % 2 = 0), x AS (SELECT max(p_partkey) AS m FROM part),
 k AS (SELECT *, row_number() OVER (PARTITION BY face_id ORDER BY area DESC, photo_no DESC) AS n FROM w, x WHERE visible AND (face_id % 2 = 1 OR coalesce(roof, false))) SELECT face_id, photo_no, area FROM k WHERE n = 1""")
def wall_photo(t):
    photos = t.nation.select(F.col("n_nationkey").alias("photo_no"))
    v = spatial.crossed(t.part, photos).select(
        F.col("p_partkey").alias("face_id"), "photo_no", ((F.col("p_partkey") + F.col("photo_no")) % 3 > 0).alias("visible"),
        ((F.col("p_size") * (F.col("photo_no") % 5 + 1)) % 17).cast("double").alias("area"),
    )
    roofs = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("wall"), (F.col("p_partkey") * 2).alias("roof"))
    return texture.best_wall_photo(v, roofs)


@query("""SELECT n_nationkey AS photo_no, 36e0 / (n_nationkey * 100 + 1000) AS pixel, n_nationkey = 8 AS fits FROM nation""")
def photo_cameras(t):
    photos = t.nation.select(F.col("n_nationkey").alias("photo_no"), (F.col("n_nationkey") * 100 + 1000).alias("width"), F.lit(1200).alias("height"))
    camera = t.spark.createDataFrame([(50.0, 36.0, 24.0, 0.02, 0.02)], "focal double, sensor_w double, sensor_h double, pixel_w double, pixel_h double")
    return texture.photo_cameras(photos, camera).select("photo_no", "pixel", "fits")


@query("SELECT k AS mesh_id, true AS head, 5::BIGINT AS v, 5::BIGINT AS vt, CASE WHEN k % 2 = 0 THEN 'f 1/1 2/2 3/3 4/4 5/5' ELSE 'f 1 2 3 4 5' END AS f FROM (" + DENTS + ")")
def textured_obj(t):
    uv = F.transform("ring", lambda p: F.struct((p.x / 100).alias("u"), (p.y / 100).alias("v")))
    faces = t.dents.select(F.col("face_id").alias("mesh_id"), "face_id", "element", F.lit("wall").alias("material"), "ring", F.when(F.col("face_id") % 2 == 0, uv).otherwise(F.slice(uv, 1, 2)).alias("uv"))
    lines = F.split("text", "\n")
    count = lambda start: F.size(F.filter(lines, lambda s: s.startswith(start))).cast("long")
    rows = obj.textured_obj(faces, "a.mtl")
    vt = F.when(F.col("mesh_id") % 2 == 0, count("vt ")).otherwise(count("vt ") + 5)
    return rows.select("mesh_id", (F.get(lines, F.lit(0)) == "mtllib a.mtl").alias("head"), count("v ").alias("v"), vt.alias("vt"), F.get(F.filter(lines, lambda s: s.startswith("f ")), F.lit(0)).alias("f"))


@query(
    MODE
    + f""", m AS (SELECT building_id, min(low) AS min_z, arg_max(low + (bin + 0.5e0) * width, n * 1000 - bin) AS mode_z FROM c GROUP BY building_id),
 q AS (SELECT building_id, coalesce(quantile_cont(CASE WHEN z > min_z + 2 THEN z END, 0.9), quantile_cont(z, 0.9)) AS top FROM ({POINTS}) JOIN m USING (building_id) GROUP BY building_id),
 f AS (SELECT b.*, mode_z IS NOT NULL AND top > mode_z AS good FROM ({FOOTPRINTS}) b LEFT JOIN m USING (building_id) LEFT JOIN q USING (building_id))
 SELECT building_id, CASE WHEN good THEN 'SUCCESS' ELSE 'ERROR' END AS status, CASE WHEN good THEN 6 ELSE 0 END::BIGINT AS faces, CASE WHEN good THEN (x1 - x0) * (y1 - y0) ELSE 0e0 END AS area FROM f"""
)
def block_models(t):
    made = flat.blocks(t.points, t.footprints)
    return flat.report(made, flat.models(made))


@query("""WITH v AS (""" + VECTORS + """), w AS (SELECT *, ax*by_-ay*bx AS d FROM v), c AS (SELECT *, (2*by_+3*bx) / nullif(d,0) AS s, (2*ay+3*ax) / nullif(d,0) AS t FROM w)
 SELECT id, ax >= 0 AND ay >= 0 AND ax * 10 + ay * 30 <= 300 AS in_triangle, d > 0 AS ccw, coalesce(s BETWEEN -0.000001e0 AND 1.000001e0 AND t BETWEEN -0.000001e0 AND 1.000001e0, false) AS meet,
 round(acos(greatest(-1, least(1, (ax*bx+ay*by_+az*bz) / (sqrt(ax*ax+ay*ay+az*az) * sqrt(bx*bx+by_*by_+bz*bz))))), 6) AS corner, abs(ax-bx) < 5 AND abs(ay-by_) < 5 AND abs(az-bz) < 5 AS same, id % 2 = 1 AS against FROM c""")
def plane_predicates(t):
    a, b, k = F.col("a"), F.col("b"), F.col("id")
    xy = lambda x, y: g.point(F.lit(float(x)), F.lit(float(y)))
    zero = g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    far, near = F.when(k % 2 == 1, 0.75).otherwise(0.25), F.when(k % 2 == 1, 0.25).otherwise(0.75)
    on = lambda s: g.point(a.x * s, a.y * s, a.z * s)
    return t.vectors.select(
        "id", g.in_triangle(a, xy(0, 0), xy(30, 0), xy(0, 10)).alias("in_triangle"), g.is_ccw(xy(0, 0), a, b).alias("ccw"),
        g.segments_meet(xy(0, 0), a, xy(2, -3), g.point(F.lit(2.0) + b.x, F.lit(-3.0) + b.y)).alias("meet"),
        r6(g.interior_angle(a, zero, b)).alias("corner"), g.same_point(a, b, 5.0).alias("same"), g.opposite_collinear(zero, a, on(far), on(near)).alias("against"),
    )


@query("""WITH p AS (SELECT p_partkey AS id, p_size, p_partkey % 4 AS k FROM part) SELECT id, CASE k WHEN 0 THEN 'GROUND' WHEN 1 THEN 'ROOF' ELSE 'WALL' END AS element, floor(id * 37 / 3600)::BIGINT || 'h ' || (floor(id * 37 / 60)::BIGINT % 60) || 'm ' || (id * 37 % 60) || 's' AS took,
 cast(greatest(0, floor(id % 17 / 32e0 * 100) - 3) AS int) AS u0, cast(least(100, ceil((id % 17 / 32e0 + 0.5e0) * 100) + 3) AS int) AS u1, 10 + p_size * 0.5e0 AS gx, 90 - k * 0.5e0 AS gy, cast(greatest(round_even(p_size / 4e0, 0), 2) AS int) AS samples, p_size * 1e0 AS last FROM p""")
def faces_and_pixels(t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    rise = F.when(k % 4 == 0, 0.01).when(k % 4 == 1, 1.0).otherwise(100.0)
    ring = F.array(*(g.point(F.lit(x), F.lit(y), z) for x, y, z in ((0.0, 0.0, F.lit(0.0)), (1.0, 0.0, rise), (1.0, 1.0, rise), (0.0, 1.0, F.lit(0.0)))))
    ring = F.when(k % 4 == 3, F.reverse(F.transform(ring, lambda p: g.point(p.x, p.y, F.lit(0.0))))).otherwise(ring)
    us, vs = F.array((k % 17) / 32, (k % 17) / 32 + 0.5), F.array(F.lit(0.25), F.lit(0.5))
    box = g.uv_box(us, vs, F.lit(100), F.lit(100), F.lit(3))
    geo = g.to_geo(F.col("p_size"), k % 4, F.lit(10.0), F.lit(90.0), 0.5)
    along = g.samples(g.point(F.lit(0.0), F.lit(0.0)), g.point(size, F.lit(0.0)), 4.0)
    rows = t.part.select("p_partkey", "p_size", ring.alias("ring"))
    return rows.select(
        k.alias("id"), g.element_type(F.col("ring")).alias("element"), g.elapsed(k * 37).alias("took"), box["x0"].cast("int").alias("u0"), box["x1"].cast("int").alias("u1"),
        geo.x.alias("gx"), geo.y.alias("gy"), F.size(along).alias("samples"), F.element_at(along, -1).x.alias("last"),
    )


@query("SELECT k AS face_id, CASE WHEN y = h THEN 4 ELSE 5 END AS corners, w * h - w * (h - y) / 2 AS area FROM (" + DENTS + ")")
def simplified_rings(t):
    rows = grouped.simplified(t.dents)
    return rows.select("face_id", F.size("ring").alias("corners"), g.area(F.col("ring")).alias("area"))


@query("SELECT p_partkey AS face_id, 4::BIGINT AS n, 2::BIGINT AS ridge, round(2 * p_size * sqrt(1 + pow(p_partkey % 5 + 1, 2)), 6) AS area FROM part")
def roof_triangles(t):
    w, h = F.col("p_size").cast("double"), (F.col("p_partkey") % 5 + 1).cast("double")
    ring = ring_of((0, 0, 0), (w, 0, 0), (w, 1, h), (w, 2, 0), (0, 2, 0), (0, 1, h))
    faces = t.part.select(F.lit(1).cast("long").alias("mesh_id"), F.col("p_partkey").alias("face_id"), ring.alias("ring"))
    rows = grouped.roofs_triangulated(faces).join(faces.select("face_id", "ring").hint("merge"), "face_id")
    p = [F.get("ring", F.col(c)) for c in "abc"]
    size = g.length(g.cross(g.minus(p[1], p[0]), g.minus(p[2], p[0]))) / 2
    ridge = sum((F.col(c).isin(2, 5).cast("int") for c in "bc"), F.col("a").isin(2, 5).cast("int")) == 2
    return rows.groupBy("face_id").agg(F.count("*").alias("n"), F.count_if(ridge).alias("ridge"), r6(F.sum(size)).alias("area"))


@query("SELECT s_suppkey AS building_id, s_suppkey % 4 + 3 AS faces, 1 AS outer, 2 * (s_suppkey % 4 + 3) AS outer_corners FROM supplier")
def plane_faces(t):
    b = F.col("s_suppkey")
    # a ladder
    rungs = t.supplier.select(b.alias("building_id"), (b % 4 + 3).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), b % 4 + 2)).alias("i"))
    nodes = rungs.select("building_id", F.explode(F.array(*(F.struct((F.col("i") * 2 + j).alias("node"), F.col("i").cast("double").alias("x"), F.lit(float(j)).alias("y")) for j in (0, 1)))).alias("p")).select("building_id", "p.*")
    links = [(F.col("i") * 2, F.col("i") * 2 + 1, F.lit(True)), *((F.col("i") * 2 + j, F.col("i") * 2 + 2 + j, F.col("i") < F.col("n") - 1) for j in (0, 1))]
    edges = rungs.select("building_id", F.explode(F.filter(F.array(*(F.struct(a.alias("a"), c.alias("b"), k.alias("k")) for a, c, k in links)), lambda e: e["k"])).alias("e")).select("building_id", "e.a", "e.b")
    rows = grouped.plane_faces(nodes, edges)
    return rows.groupBy("building_id").agg(F.count("*").alias("faces"), F.count_if("outer").alias("outer"), F.max(F.when(F.col("outer"), F.size("corners"))).alias("outer_corners"))


@query(f"SELECT building_id, unnest([1, 2, 3, 4]) AS wall, 0 AS roof FROM ({FOOTPRINTS})")
def roof_of_wall(t):
    faces = modeling.extruded(t.rings.select("building_id", "ring", F.lit(1.0).alias("bottom"), F.lit(6.0).alias("top")))
    corners = faces.select((F.col("mesh_id") * 10 + F.col("face_id")).alias("face_id"), "element", F.explode("ring").alias("p")).select("face_id", "element", "p.*")
    rows = texture.roof_of_wall(corners)
    return rows.select(F.floor(F.col("wall") / 10).alias("building_id"), (F.col("wall") % 10).alias("wall"), (F.col("roof") % 10).alias("roof"))


@query(f"SELECT 'b' || building_id || '_' || n AS gml_id, CASE n WHEN 0 THEN 'ROOF' WHEN 5 THEN 'GROUND' ELSE 'WALL' END AS element, 1 AS closed FROM (SELECT building_id, unnest([0, 1, 2, 3, 4, 5]) AS n FROM ({FOOTPRINTS}))")
def numbered_faces(t):
    faces = modeling.extruded(t.rings.select("building_id", "ring", F.lit(1.0).alias("bottom"), F.lit(6.0).alias("top")))
    rows = faces.select(F.concat(F.lit("b"), "mesh_id").alias("build_id"), (-F.col("face_id")).alias("face_no"), "element", F.transform("ring", lambda p: F.struct(p.x.alias("lat"), p.y.alias("lon"), p.z.alias("h"))).alias("ring"))
    text = F.split(citygml.ring_text(F.col("ring")), " ")
    closed = (F.slice(text, 1, 3) == F.slice(text, -3, 3)).cast("int")
    return citygml.numbered(rows).select("gml_id", "element", closed.alias("closed"))


@query("""SELECT s_suppkey AS id, round(1 - 1 / sqrt(1 + pow(s_suppkey % 5, 2)), 6) AS verticality, round(0e0, 6) AS rest FROM supplier""")
def verticality(t):
    k = (F.col("s_suppkey") % 5).cast("double")
    grid = F.flatten(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda i: F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda j: F.struct(i.cast("double").alias("nx"), j.cast("double").alias("ny")))))
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), k.alias("k"), F.explode(grid).alias("p")).select("id", "p.nx", "p.ny", (F.col("p.nx") * F.col("k")).alias("nz"))
    out = grouped.verticality(rows)
    return out.select("id", r6(F.col("verticality")).alias("verticality"), r6(1 - F.col("planarity") - F.col("linearity")).alias("rest"))


@query("""WITH p AS (SELECT p_partkey % 37 AS polygon_id, p_size > 20 + p_partkey % 11 AS b FROM part) SELECT polygon_id, avg(CASE WHEN b THEN 1 ELSE 0 END) >= 0.5 AS balcony FROM p GROUP BY 1""")
def balconies(t):
    k = F.col("p_partkey")
    return texture.balconies(t.part.select((k % 37).alias("polygon_id"), (F.col("p_size") > 20 + k % 11).alias("is_balcony")))


@query("""WITH e AS (SELECT event_id % 50 AS cluster, (event_id % 200) * 0.1e0 AS x, value % 20 AS y FROM events), s AS (SELECT (s_suppkey % 20) * 1.0e0 AS sx, (s_suppkey * 7 % 20) * 1.0e0 AS sy FROM supplier)
 SELECT DISTINCT cluster FROM e JOIN s ON sqrt(pow(x-sx,2)+pow(y-sy,2)) <= 0.25""")
def clusters_near(t):
    e = t.events.select((F.col("event_id") % 50).alias("cluster"), ((F.col("event_id") % 200) * F.lit(0.1)).alias("x"), (F.col("value") % 20).alias("y"))
    s = t.supplier.select(((F.col("s_suppkey") % 20) * F.lit(1.0)).alias("x"), ((F.col("s_suppkey") * 7 % 20) * F.lit(1.0)).alias("y"))
    return spatial.has_neighbor(e, s, 0.25, "cluster")


@query("""WITH e AS (SELECT event_id, user_id % 3 AS k, (event_id % 200) * 0.5e0 AS x, value AS y FROM events WHERE event_id % 10 = 0), s AS (SELECT s_suppkey AS sample_id, s_suppkey % 3 AS k, (s_suppkey % 20) * 5.0e0 AS sx, (s_suppkey * 7 % 20) * 20.0e0 AS sy FROM supplier),
 r AS (SELECT event_id, sample_id, sqrt(pow(x-sx,2)+pow(y-sy,2)) AS d FROM e JOIN s USING (k)) SELECT event_id, round(min(d), 6) AS distance FROM r GROUP BY 1""")
def nearest_roof_label(t):
    e = t.events.where("event_id % 10 = 0").select("event_id", (F.col("user_id") % 3).alias("k"), ((F.col("event_id") % 200) * F.lit(0.5)).alias("x"), F.col("value").alias("y"))
    s = t.supplier.select(F.col("s_suppkey").alias("sample_id"), (F.col("s_suppkey") % 3).alias("k"), ((F.col("s_suppkey") % 20) * F.lit(5.0)).alias("x"), ((F.col("s_suppkey") * 7 % 20) * F.lit(20.0)).alias("y"))
    return spatial.nearest(e, s, "event_id", "sample_id", 160.0, ("k",)).select("event_id", r6(F.col("distance")).alias("distance"))


@query("SELECT p_partkey AS mesh_id, 7::BIGINT AS edge, cast(CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 4 END AS bigint) AS vertex FROM part WHERE p_partkey % 3 < 2")
def corners_on_edges(t):
    k = F.col("p_partkey")
    z = lambda n: F.when(k % 3 <= n, 0.0).otherwise(1.0)
    points = [(1, 0.0, F.lit(0.0)), (2, 10.0, F.lit(0.0)), (3, 4.0, z(0)), (4, 6.0, z(1)), (5, 12.0, F.lit(0.0))]
    v = F.array(*(F.struct(F.lit(n).cast("long").alias("vertex"), F.lit(x).alias("x"), F.lit(0.0).alias("y"), h.alias("z")) for n, x, h in points))
    v = t.part.select(k.alias("mesh_id"), F.explode(v).alias("v")).select("mesh_id", "v.*")
    e = t.part.select(k.alias("mesh_id"), F.lit(7).cast("long").alias("edge"), F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b"))
    return modeling.corners_on_edges(v, e)


@query("""SELECT s_suppkey AS building_id, cast(e AS bigint) AS edge, cast(p AS bigint) AS point, t, s_suppkey + t * 10 AS x FROM (SELECT s_suppkey, 0 AS e, unnest([1, 2]) AS p, unnest([0.3333e0, 0.5e0]) AS t FROM supplier)""")
def missing_vertices(t):
    b = F.col("s_suppkey").alias("building_id")
    own = lambda rows, names: F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))
    e = t.supplier.select(b, F.explode(own([(0, 0.0, 1.0, 10.0, 1.0), (1, 0.0, 30.0, 10.0, 30.0)], ["edge", "ax", "ay", "bx", "by"])).alias("e")).select("building_id", F.col("e.edge").cast("long").alias("edge"), *((F.col(f"e.{c}") + F.when(F.lit(c[1] == "x"), F.col("building_id")).otherwise(0)).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")))
    p = t.supplier.select(b, F.explode(own([(1, 3.33333, 1.05), (2, 5.0, 0.95), (3, 7.0, 1.2), (4, 0.0, 1.0), (5, 11.0, 1.0)], ["point", "x", "y"])).alias("p")).select("building_id", F.col("p.point").cast("long").alias("point"), (F.col("p.x") + F.col("building_id")).alias("x"), "p.y")
    return modeling.missing_vertices(e, p, 4.0).select("building_id", "edge", "point", "t", "x")
