"""Plane and sphere geometry on point structs and vertex arrays.

A point is struct<x,y>; a line or ring is array<struct<x,y>>. Rings repeat
their first vertex at the end.
"""

from __future__ import annotations

import math
import struct as _struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS = 6371008.8  # metres, mean
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed alphabet of geohashes


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(ring: Column) -> Column:
    """Bounding box (xmin, ymin, xmax, ymax)."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


# Box relations of a to b.
BOX_TESTS = {
    "bbcontains": lambda a, b: (a["xmin"] <= b["xmin"]) & (a["xmax"] >= b["xmax"]) & (a["ymin"] <= b["ymin"]) & (a["ymax"] >= b["ymax"]),
    "bboverlaps": lambda a, b: (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"]),
    "contained": lambda a, b: BOX_TESTS["bbcontains"](b, a),
    "left": lambda a, b: a["xmax"] < b["xmin"],
    "right": lambda a, b: a["xmin"] > b["xmax"],
    "overlaps_left": lambda a, b: a["xmax"] <= b["xmax"],
    "overlaps_right": lambda a, b: a["xmin"] >= b["xmin"],
    "overlaps_above": lambda a, b: a["ymin"] >= b["ymin"],
    "overlaps_below": lambda a, b: a["ymax"] <= b["ymax"],
    "strictly_above": lambda a, b: a["ymin"] > b["ymax"],
    "strictly_below": lambda a, b: a["ymax"] < b["ymin"],
}


def _segments(line: Column) -> Column:
    n = F.size(line)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(
        F.try_element_at(line, i).alias("a"), F.try_element_at(line, i + 1).alias("b")))


def covers_point(ring: Column, p: Column) -> Column:
    """Ray casting; ``on_edge`` tells boundary points apart."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return straddles & (p["x"] < at)

    return F.size(F.filter(_segments(ring), crosses)) % 2 == 1


def on_edge(ring: Column, p: Column) -> Column:
    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        flat = (b["x"] - a["x"]) * (p["y"] - a["y"]) == (b["y"] - a["y"]) * (p["x"] - a["x"])
        return flat & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(
            F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(_segments(ring), on)


def within(p: Column, ring: Column) -> Column:
    """Inside, not on the boundary (contains, seen from the ring)."""
    return covers_point(ring, p) & ~on_edge(ring, p)


def covered_by(p: Column, ring: Column) -> Column:
    """Inside or on the boundary (covers, seen from the ring)."""
    return covers_point(ring, p) | on_edge(ring, p)


def segments_cross(e: Column, f: Column) -> Column:
    """Two segments share a point."""
    def side(a, b, c):
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def spans(a, b, c):
        return c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(
            F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    a, b, c, d = e["a"], e["b"], f["a"], f["b"]
    s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    proper = (s1 != s2) & (s3 != s4)
    touch = ((s1 == 0) & spans(a, b, c)) | ((s2 == 0) & spans(a, b, d)) | ((s3 == 0) & spans(c, d, a)) | ((s4 == 0) & spans(c, d, b))
    return proper | touch


PLAIN = 1e100  # vertices of this size and beyond, NULL and NaN are left to the expressions
BLOCK = 1 << 18  # pairs of segments compared at once


def _vertices(rings: pa.Array) -> tuple[np.ndarray, ...]:
    """(x, y, first, count, plain) of rings; ``first`` and ``count`` place each ring in x and y."""
    count = pc.fill_null(rings.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (v.to_numpy(zero_copy_only=False).astype(float) for v in rings.flatten().flatten())
    first = np.cumsum(count) - count
    odd = np.concatenate([[0], np.cumsum(~((np.abs(x) < PLAIN) & (np.abs(y) < PLAIN)))])
    return x, y, first, count, (count >= 2) & (odd[first + count] == odd[first])


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of ``count`` places in a row from ``first`` on, for each owner."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def _covered(px, py, x, y, first, count) -> tuple[np.ndarray, np.ndarray]:
    """(inside, on edge) of one point for each ring, as ``covers_point`` and ``on_edge`` tell."""
    owner, at = _runs(first, count - 1)
    px, py, ax, ay, bx, by = px[owner], py[owner], x[at], y[at], x[at + 1], y[at + 1]
    straddles = (ay > py) != (by > py)
    cross = straddles & (px < (bx - ax) * (py - ay) / np.where(straddles, by - ay, 1.0) + ax)
    flat = (bx - ax) * (py - ay) == (by - ay) * (px - ax)
    on = flat & (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
    inside = np.bincount(owner[cross], minlength=len(count)) % 2 == 1
    return inside, np.bincount(owner[on], minlength=len(count)) > 0


def _crossing(r: tuple, s: tuple) -> np.ndarray:
    """Whether the rings of each pair have segments that share a point."""
    (rx, ry, r0, rn), (sx, sy, s0, sn) = r, s
    hit = np.zeros(len(rn), bool)
    pair, at = _runs(r0, rn - 1)
    block = np.cumsum(sn[pair] - 1) // BLOCK
    for k in np.unique(block):
        mine = np.flatnonzero(block == k)
        e, f = _runs(s0[pair[mine]], sn[pair[mine]] - 1)
        e = mine[e]
        a, c = at[e], f
        ax, ay, bx, by, cx, cy, dx, dy = rx[a], ry[a], rx[a + 1], ry[a + 1], sx[c], sy[c], sx[c + 1], sy[c + 1]
        side = lambda ax, ay, bx, by, cx, cy: np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        spans = lambda ax, ay, bx, by, cx, cy: (
            (cx >= np.minimum(ax, bx)) & (cx <= np.maximum(ax, bx)) & (cy >= np.minimum(ay, by)) & (cy <= np.maximum(ay, by)))
        s1, s2, s3, s4 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy), side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
        touch = ((s1 == 0) & spans(ax, ay, bx, by, cx, cy)) | ((s2 == 0) & spans(ax, ay, bx, by, dx, dy))
        touch |= ((s3 == 0) & spans(cx, cy, dx, dy, ax, ay)) | ((s4 == 0) & spans(cx, cy, dx, dy, bx, by))
        hit[pair[e[((s1 != s2) & (s3 != s4)) | touch]]] = True
    return hit


def _some(ok: np.ndarray, values: np.ndarray) -> pa.Array:
    """``values`` of the rows that are ok, NULL for the others."""
    out = np.zeros(len(ok), bool)
    out[ok] = values
    return pa.array(out, mask=~ok)


@F.arrow_udf(T.BooleanType())
def _plain_rings_intersect(r: pa.Array, s: pa.Array) -> pa.Array:
    (rx, ry, r0, rn, rok), (sx, sy, s0, sn, sok) = _vertices(r), _vertices(s)
    ok = rok & sok
    r0, rn, s0, sn = r0[ok], rn[ok], s0[ok], sn[ok]
    hit = _crossing((rx, ry, r0, rn), (sx, sy, s0, sn))
    for inside, on in (_covered(rx[r0], ry[r0], sx, sy, s0, sn), _covered(sx[s0], sy[s0], rx, ry, r0, rn)):
        hit |= inside | on
    return _some(ok, hit)


def _plain_test(with_edge: bool):
    def run(p: pa.Array, ring: pa.Array) -> pa.Array:
        px, py = (v.to_numpy(zero_copy_only=False).astype(float) for v in p.flatten())
        x, y, first, count, ok = _vertices(ring)
        ok &= (np.abs(px) < PLAIN) & (np.abs(py) < PLAIN)
        inside, on = _covered(px[ok], py[ok], x, y, first[ok], count[ok])
        return _some(ok, inside | on if with_edge else inside & ~on)

    run.__annotations__ = {"p": pa.Array, "ring": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.BooleanType())


def many_within(p: Column, ring: Column) -> Column:
    """``within`` for many pairs, a batch at a time."""
    return F.coalesce(_plain_test(False)(p, ring), within(p, ring))


def many_covered_by(p: Column, ring: Column) -> Column:
    """``covered_by`` for many pairs, a batch at a time."""
    return F.coalesce(_plain_test(True)(p, ring), covered_by(p, ring))


def many_rings_intersect(r: Column, s: Column) -> Column:
    """``rings_intersect`` for many pairs, a batch at a time."""
    return F.coalesce(_plain_rings_intersect(r, s), rings_intersect(r, s))


def rings_intersect(r: Column, s: Column) -> Column:
    crossing = F.exists(_segments(r), lambda e: F.exists(_segments(s), lambda f: segments_cross(e, f)))
    return crossing | covered_by(F.get(r, F.lit(0)), s) | covered_by(F.get(s, F.lit(0)), r)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def sphere_distance(a: Column, b: Column) -> Column:
    """Metres between lon/lat points on the sphere."""
    la, lb = F.radians(a["y"]), F.radians(b["y"])
    h = F.pow(F.sin((lb - la) / 2), F.lit(2)) + F.cos(la) * F.cos(lb) * F.pow(F.sin(F.radians(b["x"] - a["x"]) / 2), F.lit(2))
    return 2 * EARTH_RADIUS * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def length(line: Column) -> Column:
    return _sum(F.transform(_segments(line), lambda e: F.coalesce(distance(e["a"], e["b"]), F.lit(0.0))))


perimeter = length


def sphere_length(line: Column) -> Column:
    return _sum(F.transform(_segments(line), lambda e: F.coalesce(sphere_distance(e["a"], e["b"]), F.lit(0.0))))


def _cross(e: Column) -> Column:
    return F.coalesce(e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"], F.lit(0.0))


def signed_area(ring: Column) -> Column:
    return _sum(F.transform(_segments(ring), _cross)) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    def part(axis: str) -> Column:
        return _sum(F.transform(_segments(ring), lambda e: (e["a"][axis] + e["b"][axis]) * _cross(e))) / (6 * signed_area(ring))

    return point(part("x"), part("y"))


def envelope(ring: Column) -> Column:
    b = box(ring)
    corners = [("xmin", "ymin"), ("xmin", "ymax"), ("xmax", "ymax"), ("xmax", "ymin"), ("xmin", "ymin")]
    return F.array(*[point(b[x], b[y]) for x, y in corners])


def locate_on_segment(e: Column, p: Column) -> Column:
    """Fraction along the segment of the point nearest to p."""
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    t = ((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))


def _nearest(line: Column, p: Column) -> Column:
    """Struct (d, i, t): distance, segment number and fraction of the nearest point."""
    def look(e: Column, i: Column) -> Column:
        t = locate_on_segment(e, p)
        q = point(e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"]))
        return F.struct(distance(q, p).alias("d"), i.alias("i"), t.alias("t"), q.alias("q"))

    return F.array_min(F.transform(_segments(line), look))


def closest_point(line: Column, p: Column) -> Column:
    return _nearest(line, p)["q"]


def line_locate_point(line: Column, p: Column) -> Column:
    """Fraction of the line's length at the point nearest to p."""
    best = _nearest(line, p)
    done = F.transform(_segments(line), lambda e, i: F.when(i < best["i"], distance(e["a"], e["b"])).when(
        i == best["i"], distance(e["a"], e["b"]) * best["t"]).otherwise(0.0))
    return _sum(done) / length(line)


def azimuth(a: Column, b: Column) -> Column:
    """Angle from north, clockwise, in radians; NULL for equal points."""
    angle = F.atan2(b["x"] - a["x"], b["y"] - a["y"])
    same = (a["x"] == b["x"]) & (a["y"] == b["y"])
    return F.when(~same, F.when(angle < 0, angle + 2 * math.pi).otherwise(angle))


def translate(ring: Column, dx: float, dy: float) -> Column:
    return F.transform(ring, lambda p: point(p["x"] + dx, p["y"] + dy))


def scale(ring: Column, fx: float, fy: float) -> Column:
    return F.transform(ring, lambda p: point(p["x"] * fx, p["y"] * fy))


def rotate(ring: Column, angle: float, origin: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Counter-clockwise about the origin."""
    c, s, (ox, oy) = math.cos(angle), math.sin(angle), origin
    return F.transform(ring, lambda p: point((p["x"] - ox) * c - (p["y"] - oy) * s + ox, (p["x"] - ox) * s + (p["y"] - oy) * c + oy))


def snap_to_grid(ring: Column, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Vertices moved to the grid; repeats that arise are dropped."""
    ox, oy = origin
    moved = F.transform(ring, lambda p: point(F.rint((p["x"] - ox) / size) * size + ox, F.rint((p["y"] - oy) / size) * size + oy))
    return F.filter(moved, lambda p, i: (i == 0) | (p != F.get(moved, i - 1)))


def reverse(ring: Column) -> Column:
    return F.reverse(ring)


def force_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) > 0, F.reverse(ring)).otherwise(ring)


def num_points(ring: Column) -> Column:
    return F.size(ring)


def geometry_type(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(wkt, r"^\s*(\w+)", 1))


def is_empty(ring: Column) -> Column:
    return F.coalesce(F.size(ring), F.lit(0)) == 0


@F.pandas_udf(T.BooleanType())
def is_valid(rings: pd.Series) -> pd.Series:
    """Closed, at least four vertices, and no two edges cross or overlap."""
    def cross(a, b, c, d):
        def side(p, q, r):
            return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    def ok(r):
        if r is None:
            return None
        pts = [(p["x"], p["y"]) for p in r]
        if len(pts) < 4 or pts[0] != pts[-1] or len(set(pts[:-1])) != len(pts) - 1:
            return False
        segs = list(zip(pts, pts[1:]))
        return not any(cross(*segs[i], *segs[j]) for i in range(len(segs)) for j in range(i + 2, len(segs)))

    return rings.map(ok).astype("boolean")


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("radius", T.DoubleType())]))
def bounding_circle(rings: pd.Series) -> pd.DataFrame:
    """Smallest circle around the vertices, grown point by point."""
    def through(p, q):
        return (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, math.dist(p, q) / 2

    def around(p, q, r):
        d = 2 * (p[0] * (q[1] - r[1]) + q[0] * (r[1] - p[1]) + r[0] * (p[1] - q[1]))
        if d == 0:
            return max((through(*s) for s in ((p, q), (q, r), (p, r))), key=lambda c: c[2])
        sq = [v[0] ** 2 + v[1] ** 2 for v in (p, q, r)]
        x = (sq[0] * (q[1] - r[1]) + sq[1] * (r[1] - p[1]) + sq[2] * (p[1] - q[1])) / d
        y = (sq[0] * (r[0] - q[0]) + sq[1] * (p[0] - r[0]) + sq[2] * (q[0] - p[0])) / d
        return x, y, math.dist((x, y), p)

    def inside(c, p):
        return math.dist(c[:2], p) <= c[2] * (1 + 1e-12) + 1e-15

    def circle(r):
        pts = list(dict.fromkeys((p["x"], p["y"]) for p in r))
        c = (*pts[0], 0.0)
        for i, p in enumerate(pts):
            if inside(c, p):
                continue
            c = (*p, 0.0)
            for j, q in enumerate(pts[:i]):
                if inside(c, q):
                    continue
                c = through(p, q)
                for s in pts[:j]:
                    if not inside(c, s):
                        c = around(p, q, s)
        return c

    return pd.DataFrame([circle(r) for r in rings], columns=["x", "y", "radius"])


def point_on_surface(ring: Column) -> Column:
    """A point inside: middle of the widest stretch at half height."""
    b = box(ring)
    y = (b["ymin"] + b["ymax"]) / 2
    hits = F.filter(_segments(ring), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    xs = F.array_sort(F.transform(hits, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
    pairs = F.filter(F.transform(xs, lambda x, i: F.struct(
        (F.get(xs, i + 1) - x).alias("w"), ((F.get(xs, i + 1) + x) / 2).alias("m"), (i % 2).alias("odd"))), lambda s: (s["odd"] == 0) & s["w"].isNotNull())
    return point(F.array_max(pairs)["m"], y)


def geohash(p: Column, precision: int = 8) -> Column:
    """Bits of longitude and latitude, taken in turn, five per character."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2

    def cell(v: Column, lo: float, span: float, n: int) -> Column:
        return F.least(F.floor((v - lo) / span * 2**n), F.lit(2**n - 1)).cast("bigint")

    cells = F.struct(cell(p["x"], -180.0, 360.0, nx).alias("x"), cell(p["y"], -90.0, 180.0, ny).alias("y"))

    def letters(c: Column) -> Column:
        out = []
        for k in range(precision):
            value = F.lit(0).cast("bigint")
            for i in range(5 * k, 5 * k + 5):
                source, left = (c["x"], nx - 1 - i // 2) if i % 2 == 0 else (c["y"], ny - 1 - i // 2)
                value = value * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1).cast("bigint"))
            out.append(F.substring(F.lit(BASE32), value.cast("int") + 1, F.lit(1)))
        return F.concat(*out)

    return F.element_at(F.transform(F.array(cells), letters), 1)


def as_wkt(ring: Column) -> Column:
    body = F.array_join(F.transform(ring, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), ", ")
    return F.concat(F.lit("POLYGON (("), body, F.lit("))"))


def point_wkt(p: Column) -> Column:
    return F.concat(F.lit("POINT ("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))


def from_wkt(text: Column) -> Column:
    """Vertices of a POINT, LINESTRING or single-ring POLYGON."""
    body = F.regexp_extract(text, r"\(+([^()]*)\)+", 1)
    return F.transform(F.split(body, r"\s*,\s*"), lambda s: point(
        F.split(F.trim(s), r"\s+")[0].cast("double"), F.split(F.trim(s), r"\s+")[1].cast("double")))


@F.pandas_udf(T.BinaryType())
def as_wkb(rings: pd.Series) -> pd.Series:
    """Little-endian polygon of one ring."""
    def pack(r):
        if r is None:
            return None
        head = _struct.pack("<BIII", 1, 3, 1, len(r))
        return head + b"".join(_struct.pack("<dd", p["x"], p["y"]) for p in r)

    return rings.map(pack)


@F.pandas_udf(RING)
def from_wkb(blobs: pd.Series) -> pd.Series:
    """First ring of a polygon, either byte order."""
    def unpack(b):
        if b is None:
            return None
        order = "<" if b[0] == 1 else ">"
        n = _struct.unpack_from(order + "I", b, 9)[0]
        v = _struct.unpack_from(f"{order}{2 * n}d", b, 13)
        return [{"x": v[2 * i], "y": v[2 * i + 1]} for i in range(n)]

    return blobs.map(unpack)


def as_geojson(ring: Column, precision: int = 8, bbox: bool = False) -> Column:
    r = lambda c: F.round(c, precision)
    coords = F.array(F.transform(ring, lambda p: F.array(r(p["x"]), r(p["y"]))))
    b = box(ring)
    fields = [F.lit("Polygon").alias("type")]
    if bbox:
        fields.append(F.array(*[r(b[c]) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("bbox"))
    return F.to_json(F.struct(*fields, coords.alias("coordinates")))
