"""Spatial queries: points from embeddings, hexagons around suppliers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from relweave.functions import geometry as g
from relweave.operators import spatial as sp
from relweave.plans.registry import Data, query

SHAPE = [(0.05, 0.0), (0.02, 0.04), (-0.03, 0.04), (-0.05, 0.0), (-0.02, -0.03), (0.03, -0.04), (0.05, 0.0)]
CX, CY = "((s_suppkey * 37) % 101) / 150.0 - 0.33", "((s_suppkey * 53) % 97) / 150.0 - 0.32"
POLY = f"(SELECT s_suppkey AS id, {CX} AS cx, {CY} AS cy FROM supplier)"
PTS = "(SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"
RINGS = f"(SELECT id, cx, cy, i, cx + (['0.05','0.02','-0.03','-0.05','-0.02','0.03','0.05']::DOUBLE[])[i] AS x, cy + (['0','0.04','0.04','0','-0.03','-0.04','0']::DOUBLE[])[i] AS y FROM {POLY}, range(1, 8) r(i))"
SEGS = f"(SELECT a.id, a.i, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM {RINGS} a JOIN {RINGS} b ON a.id = b.id AND b.i = a.i + 1)"


def points(d: Data):
    e = F.col("embedding")
    return d.embeddings.select("vec_id", "label", g.point(e[0], e[1]).alias("p"))


def polygons(d: Data):
    k = F.col("s_suppkey")
    cx, cy = (k * 37) % 101 / 150.0 - 0.33, (k * 53) % 97 / 150.0 - 0.32
    c = d.supplier.select(k.alias("id"), cx.alias("cx"), cy.alias("cy"))
    ring = F.array(*[g.point(F.col("cx") + x, F.col("cy") + y) for x, y in SHAPE])
    return c.select("id", g.point(F.col("cx"), F.col("cy")).alias("center"), ring.alias("ring"))


_B = "xmin >= -0.1 AND xmax <= 0.3 AND ymin >= -0.2 AND ymax <= 0.2"


@query("bbox_relations", f"""
SELECT id, xmin <= -0.1 AND xmax >= 0.3 AND ymin <= -0.2 AND ymax >= 0.2 AS bbcontains, xmin <= 0.3 AND xmax >= -0.1 AND ymin <= 0.2 AND ymax >= -0.2 AS bboverlaps, {_B} AS contained,
 xmax < -0.1 AS "left", xmin > 0.3 AS "right", xmax <= 0.3 AS overlaps_left, xmin >= -0.1 AS overlaps_right, ymin >= -0.2 AS overlaps_above, ymax <= 0.2 AS overlaps_below, ymin > 0.2 AS strictly_above, ymax < -0.2 AS strictly_below
FROM (SELECT id, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM {RINGS} GROUP BY 1)""")
def bbox_relations(d: Data):
    b = F.struct(*[F.lit(v).alias(n) for n, v in (("xmin", -0.1), ("ymin", -0.2), ("xmax", 0.3), ("ymax", 0.2))])
    boxed = polygons(d).select("id", g.box(F.col("ring")).alias("b"))
    return boxed.select("id", *[f(F.col("b"), b).alias(n) for n, f in g.BOX_TESTS.items()])


INSIDE = f"""SELECT vec_id, id FROM {PTS} p JOIN {SEGS} s ON (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY vec_id, id HAVING count(*) % 2 = 1"""


@query("point_in_polygon_join", INSIDE)
def point_in_polygon_join(d: Data):
    return sp.point_in_polygon(points(d), polygons(d), "p", "ring", 0.1).select("vec_id", "id")


@query("point_covered_by_join", f"{INSIDE} UNION SELECT s_suppkey + 1000000, s_suppkey FROM supplier")
def point_covered_by_join(d: Data):
    """Boundary points count: each polygon's first vertex lies on its own edge."""
    corners = polygons(d).select((F.col("id") + 1000000).alias("vec_id"), F.get("ring", F.lit(0)).alias("p"), F.col("id").alias("own"))
    on = sp.point_in_polygon(corners, polygons(d), "p", "ring", 0.1, boundary=True, own=("own", "id")).select("vec_id", "id")
    return sp.point_in_polygon(points(d), polygons(d), "p", "ring", 0.1, boundary=True).select("vec_id", "id").union(on)


@query("polygons_intersect")
def polygons_intersect(d: Data):
    other = polygons(d).select(F.col("id").alias("other"), F.col("ring").alias("ring2"))
    pairs = sp.polygons_intersect(polygons(d).select("id", "ring"), other, "ring", "ring2", 0.1, F.col("id") < F.col("other"))
    return pairs.select("id", "other")


@query("polygons_disjoint_same", f"SELECT id, TRUE AS same FROM {POLY} WHERE id NOT IN (SELECT id FROM ({INSIDE}))")
def polygons_disjoint_same(d: Data):
    """Polygons that hold no point; vertex-wise equality with themselves."""
    hit = sp.point_in_polygon(points(d), polygons(d), "p", "ring", 0.1, holders=True).select("id")
    free = polygons(d).join(hit.hint("merge"), "id", "left_anti")
    return free.select("id", (F.col("ring") == g.from_wkt(g.as_wkt(F.col("ring")))).alias("same"))


@query("distance_join", f"SELECT id, vec_id, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 8) AS distance FROM {POLY} JOIN {PTS} ON (x - cx) ** 2 + (y - cy) ** 2 <= 0.03 ** 2")
def distance_join(d: Data):
    out = sp.within_distance(polygons(d).select("id", "center"), points(d), "center", "p", 0.03)
    return out.select("id", "vec_id", F.round("distance", 8).alias("distance"))


@query("sphere_distance", f"SELECT vec_id, round(2 * 6371008.8 * asin(sqrt(sin(radians(y * 200 - 10) / 2) ** 2 + cos(radians(10)) * cos(radians(y * 200)) * sin(radians(x * 400 - 20) / 2) ** 2)), 3) AS metres FROM {PTS}")
def sphere_distance(d: Data):
    p = F.col("p")
    here = g.point(p["x"] * 400, p["y"] * 200)
    return points(d).select("vec_id", F.round(g.sphere_distance(here, g.point(F.lit(20.0), F.lit(10.0))), 3).alias("metres"))


@query("nearest_neighbours", f"""
SELECT id, vec_id, rn AS position FROM (SELECT id, vec_id, row_number() OVER (PARTITION BY id ORDER BY sqrt((x - cx) ** 2 + (y - cy) ** 2), vec_id) AS rn FROM {POLY}, {PTS}) WHERE rn <= 3""")
def nearest_neighbours(d: Data):
    out = sp.nearest(polygons(d), points(d), "id", "vec_id", "center", "p", 3)
    return out.select("id", "vec_id", F.col("position").cast("bigint").alias("position"))


@query("measures", f"SELECT id, round(sum(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)), 6) AS perimeter, round(abs(sum(ax * by_ - bx * ay)) / 2, 8) AS area, round(sum(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)), 6) AS length FROM {SEGS} GROUP BY 1")
def measures(d: Data):
    r = F.col("ring")
    return polygons(d).select("id", F.round(g.perimeter(r), 6).alias("perimeter"), F.round(g.area(r), 8).alias("area"), F.round(g.length(r), 6).alias("length"))


@query("derived_points", f"""
SELECT id, round(sum((ax + bx) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)), 6) AS cx, round(sum((ay + by_) * (ax * by_ - bx * ay)) / (3 * sum(ax * by_ - bx * ay)), 6) AS cy,
 round(min(ax), 6) AS west, round(max(ay), 6) AS north FROM {SEGS} GROUP BY 1""")
def derived_points(d: Data):
    """Centroid and envelope."""
    shaped = polygons(d).select("id", g.centroid(F.col("ring")).alias("c"), g.envelope(F.col("ring")).alias("e"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return shaped.select("id", r(F.col("c.x"), "cx"), r(F.col("c.y"), "cy"), r(F.col("e")[0]["x"], "west"), r(F.col("e")[1]["y"], "north"))


@query("linear_points")
def linear_points(d: Data):
    """Bounding circle, point on surface, closest point, position and azimuth."""
    ring, far = F.col("ring"), g.point(F.lit(1.0), F.lit(1.0))
    out = polygons(d).select(
        "id", g.bounding_circle(ring).alias("b"), g.point_on_surface(ring).alias("s"), g.closest_point(ring, far).alias("c"),
        g.line_locate_point(ring, far).alias("at"), g.azimuth(F.col("center"), far).alias("az"), "ring")
    r = lambda c, n: F.round(c, 6).alias(n)
    return out.select("id", r(F.col("b.radius"), "radius"), g.within(F.col("s"), ring).alias("inside"), r(F.col("c.x"), "near_x"), r(F.col("at"), "at"), r(F.col("az"), "az"))


@query("affine_maps", f"""
SELECT id, round(max(x) + 1, 6) AS moved, round(max(x * 2), 6) AS scaled, round(max(-y), 6) AS turned, round(max(round_even(x / 0.01, 0) * 0.01), 6) AS snapped, TRUE AS clockwise FROM {RINGS} GROUP BY 1""")
def affine_maps(d: Data):
    r = F.col("ring")
    top = lambda ring, n: F.round(g.box(ring)["xmax"], 6).alias(n)
    return polygons(d).select(
        "id", top(g.translate(r, 1.0, 0.0), "moved"), top(g.scale(r, 2.0, 1.0), "scaled"), top(g.rotate(r, math.pi / 2), "turned"),
        top(g.snap_to_grid(r, 0.01), "snapped"), (g.signed_area(g.force_clockwise(g.reverse(r))) < 0).alias("clockwise"))


@query("geometry_facts", f"SELECT id, 7 AS n, 'POLYGON' AS kind, FALSE AS empty, TRUE AS valid, FALSE AS twisted FROM {POLY}")
def geometry_facts(d: Data):
    r = F.col("ring")
    twisted = F.array(*[F.get(r, F.lit(i)) for i in (0, 2, 1, 4, 0)])
    return polygons(d).select(
        "id", g.num_points(r).alias("n"), g.geometry_type(g.as_wkt(r)).alias("kind"), g.is_empty(r).alias("empty"), g.is_valid(r).alias("valid"), g.is_valid(twisted).alias("twisted"))


@query("geohash")
def geohash(d: Data):
    p = F.col("p")
    return points(d).select("vec_id", g.geohash(g.point(p["x"] * 400, p["y"] * 200), 7).alias("hash"))


@query("geometry_in_out", f"SELECT id, TRUE AS wkt, TRUE AS wkb, 'Polygon' AS kind, 4 AS box_size, round(cx + 0.05, 4) AS first_x FROM {POLY}")
def geometry_in_out(d: Data):
    r = F.col("ring")
    json = g.as_geojson(r, 4, bbox=True)
    return polygons(d).select(
        "id", (g.from_wkt(g.as_wkt(r)) == r).alias("wkt"), (g.from_wkb(g.as_wkb(r)) == r).alias("wkb"), F.get_json_object(json, "$.type").alias("kind"),
        F.json_array_length(F.get_json_object(json, "$.bbox")).alias("box_size"), F.get_json_object(json, "$.coordinates[0][0][0]").cast("double").alias("first_x"))


@query("extent", f"SELECT label, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, min(vec_id)::DOUBLE AS zmin, max(vec_id)::DOUBLE AS zmax FROM {PTS} GROUP BY 1")
def extent(d: Data):
    return sp.extent(points(d).withColumn("z", F.col("vec_id").cast("double")), ["label"], "p", "z")


@query("make_line", f"SELECT label, (rn - 1) // 1000 AS chunk, count(*) AS n, round(sum(x), 6) AS sx, first(x ORDER BY rn) AS x0 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM {PTS}) GROUP BY ALL")
def make_line(d: Data):
    lines = sp.make_lines(points(d), ["label"], [F.col("vec_id").asc()], "p")
    xs = F.transform("line", lambda p: p["x"])
    return lines.select("label", "chunk", F.size("line").cast("bigint").alias("n"), F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), 6).alias("sx"), F.get(xs, F.lit(0)).alias("x0"))
