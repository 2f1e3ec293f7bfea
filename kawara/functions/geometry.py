"""Scalar geometry as column expressions: everything here stays in generated JVM code.

Points and vectors are structs with DOUBLE fields x, y (and z); rings are arrays of them. Tolerances differ from
operator to operator on purpose and are parameters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Origins of the 19 plane rectangular zones as (latitude, longitude) in degrees.
ZONES = [
    (33.0, 129.5), (33.0, 131.0), (36.0, 132.0 + 1 / 6), (33.0, 133.5), (36.0, 134.0 + 1 / 3), (36.0, 136.0),
    (36.0, 137.0 + 1 / 6), (36.0, 138.5), (36.0, 139.0 + 5 / 6), (40.0, 140.0 + 5 / 6), (44.0, 140.25),
    (44.0, 142.25), (44.0, 144.25), (26.0, 142.0), (26.0, 127.5), (26.0, 124.0), (26.0, 131.0), (20.0, 136.0),
    (26.0, 154.0),
]
#: Semi-major axis and inverse flattening of GRS 80, and the zones' scale factor.
AXIS, FLATTENING, SCALE = 6378137.0, 298.257222101, 0.9999

_N = 1 / (2 * FLATTENING - 1)
_A = [
    1 + _N**2 / 4 + _N**4 / 64,
    -3 / 2 * (_N - _N**3 / 8 - _N**5 / 64),
    15 / 16 * (_N**2 - _N**4 / 4),
    -35 / 48 * (_N**3 - 5 / 16 * _N**5),
    315 / 512 * _N**4,
    -693 / 1280 * _N**5,
]
_ALPHA = [
    _N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4 - 127 / 288 * _N**5,
    13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4 + 281 / 630 * _N**5,
    61 / 240 * _N**3 - 103 / 140 * _N**4 + 15061 / 26880 * _N**5,
    49561 / 161280 * _N**4 - 179 / 168 * _N**5,
    34729 / 80640 * _N**5,
]
_BETA = [
    _N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - _N**4 / 360 - 81 / 512 * _N**5,
    _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4 + 46 / 105 * _N**5,
    17 / 480 * _N**3 - 37 / 840 * _N**4 - 209 / 4480 * _N**5,
    4397 / 161280 * _N**4 - 11 / 504 * _N**5,
    4583 / 161280 * _N**5,
]
_DELTA = [
    2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4 + 26 / 45 * _N**5,
    7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4 + 2704 / 315 * _N**5,
    56 / 15 * _N**3 - 136 / 35 * _N**4 - 1262 / 105 * _N**5,
    4279 / 630 * _N**4 - 332 / 35 * _N**5,
    4174 / 315 * _N**5,
]


def _meridian(zone: int) -> float:
    lat = math.radians(ZONES[zone - 1][0])
    return SCALE * AXIS / (1 + _N) * (_A[0] * lat + sum(a * math.sin(2 * (k + 1) * lat) for k, a in enumerate(_A[1:])))


def to_cartesian(lat: Column, lon: Column, zone: int) -> Column:
    """Latitude and longitude in degrees to metres north (x) and east (y) of the zone's origin (Gauss-Krueger series)."""
    phi, gap = F.radians(lat), F.radians(lon - ZONES[zone - 1][1])
    k = 2 * math.sqrt(_N) / (1 + _N)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - k * atanh(k * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(gap)), atanh(F.sin(gap) / F.sqrt(1 + t * t))
    radius = SCALE * AXIS / (1 + _N) * _A[0]
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct((radius * north - _meridian(zone)).alias("x"), (radius * east).alias("y"))


def to_polar(x: Column, y: Column, zone: int) -> Column:
    """The inverse of to_cartesian: (lat, lon) in degrees."""
    radius = SCALE * AXIS / (1 + _N) * _A[0]
    xi, eta = (x + _meridian(zone)) / radius, y / radius
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.lit(ZONES[zone - 1][1]) + F.degrees(F.atan2(F.sinh(v), F.cos(u)))
    return F.struct(F.degrees(lat).alias("lat"), lon.alias("lon"))


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), *([] if z is None else [z.alias("z")]))


def minus(a: Column, b: Column, axes: str = "xyz") -> Column:
    return F.struct(*((a[k] - b[k]).alias(k) for k in axes))


def dot(a: Column, b: Column, axes: str = "xyz") -> Column:
    terms = [a[k] * b[k] for k in axes]
    return sum(terms[1:], terms[0])


def cross(a: Column, b: Column) -> Column:
    parts = {"x": a.y * b.z - a.z * b.y, "y": a.z * b.x - a.x * b.z, "z": a.x * b.y - a.y * b.x}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def cross2(a: Column, b: Column) -> Column:
    return a.x * b.y - a.y * b.x


def length(a: Column, axes: str = "xyz") -> Column:
    return F.sqrt(dot(a, a, axes))


def normalized(a: Column, axes: str = "xyz") -> Column:
    """Null components where the length is 0."""
    n = F.nullif(length(a, axes), F.lit(0.0))
    return F.struct(*((a[k] / n).alias(k) for k in axes))


def angle(a: Column, b: Column, axes: str = "xyz") -> Column:
    """Unsigned angle in degrees; the cosine is clamped."""
    c = dot(a, b, axes) / F.nullif(length(a, axes) * length(b, axes), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def signed_angle(a: Column, b: Column) -> Column:
    """Angle in degrees from a to b in the plane, counter-clockwise positive."""
    return F.degrees(F.atan2(cross2(a, b), dot(a, b, "xy")))


def point_to_line(p: Column, start: Column, direction: Column, axes: str = "xyz") -> Column:
    """(distance, t): t is the foot's parameter along the direction, not clamped."""
    gap = minus(p, start, axes)
    t = dot(gap, direction, axes) / F.nullif(dot(direction, direction, axes), F.lit(0.0))
    rest = F.struct(*((gap[k] - t * direction[k]).alias(k) for k in axes))
    return F.struct(length(rest, axes).alias("distance"), t.alias("t"))


def crossing(p: Column, u: Column, q: Column, v: Column) -> Column:
    """Where the lines p + s u and q + t v meet in the plane: (x, y, s, t); null where they are parallel."""
    d = F.nullif(cross2(u, v), F.lit(0.0))
    gap = minus(q, p, "xy")
    s, t = cross2(gap, v), cross2(gap, u) / d
    # divided last, so that a point on the grid stays there
    return F.struct((p.x + s * u.x / d).alias("x"), (p.y + s * u.y / d).alias("y"), (s / d).alias("s"), t.alias("t"))


def on_segment(t: Column, error: float = 0.0) -> Column:
    return t.between(-error, 1 + error)


def rotated(p: Column, radian: Column, centre: Column) -> Column:
    x, y = p.x - centre.x, p.y - centre.y
    return point(centre.x + x * F.cos(radian) - y * F.sin(radian), centre.y + x * F.sin(radian) + y * F.cos(radian))


def rotated_about(v: Column, axis: Column, radian: Column) -> Column:
    """v turned about an axis through the origin (Rodrigues)."""
    k = normalized(axis)
    side, along = cross(k, v), dot(k, v) * (1 - F.cos(radian))
    return F.struct(*((v[c] * F.cos(radian) + side[c] * F.sin(radian) + k[c] * along).alias(c) for c in "xyz"))


def plane(p: Column, q: Column, r: Column) -> Column:
    """a, b, c, d of the plane through three points, with a unit normal; null where they are collinear."""
    n = normalized(cross(minus(q, p), minus(r, p)))
    return F.struct(n.x.alias("a"), n.y.alias("b"), n.z.alias("c"), (-dot(n, p)).alias("d"))


def plane_distance(e: Column, p: Column) -> Column:
    return F.abs(e.a * p.x + e.b * p.y + e.c * p.z + e.d) / F.sqrt(e.a * e.a + e.b * e.b + e.c * e.c)


def plane_hit(e: Column, p: Column, v: Column) -> Column:
    """Where the line p + t v meets a plane; null where it is parallel."""
    t = -(e.a * p.x + e.b * p.y + e.c * p.z + e.d) / F.nullif(e.a * v.x + e.b * v.y + e.c * v.z, F.lit(0.0))
    return point(p.x + t * v.x, p.y + t * v.y, p.z + t * v.z)


def edges(ring: Column) -> Column:
    """The ring's edges (p, q), the last one back to the start."""
    n = F.size(ring)
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.struct(ring[i].alias("p"), ring[(i + 1) % n].alias("q"))
    )


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def signed_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + cross2(e["p"], e["q"])) / 2


def perimeter(ring: Column) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + length(minus(e["q"], e["p"], "xy"), "xy"))


def normal(ring: Column) -> Column:
    """Sum over the corners of cross(to the next but one, to the next): the reverse of the right-hand normal."""
    n = F.size(ring)
    zero = F.struct(*(F.lit(0.0).alias(k) for k in "xyz"))

    def add(s, i):
        a, b, c = ring[i], ring[(i + 1) % n], ring[(i + 2) % n]
        own = cross(minus(c, b), minus(b, a))
        return F.struct(*((s[k] + own[k]).alias(k) for k in "xyz"))

    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, add)


def interior_angle(p: Column, q: Column, r: Column) -> Column:
    """Radians at q; 0 where an arm has no length."""
    return F.coalesce(F.radians(angle(minus(p, q), minus(r, q))), F.lit(0.0))


def bounds(ring: Column, axes: str = "xy") -> Column:
    along = {k: F.transform(ring, lambda p: p[k]) for k in axes}  # noqa: B023
    return F.struct(*(f(along[k]).alias(f"{n}_{k}") for k in axes for n, f in (("min", F.array_min), ("max", F.array_max))))


def same_point(a: Column, b: Column, error: float, axes: str = "xyz") -> Column:
    parts = [F.abs(a[k] - b[k]) < error for k in axes]
    return _all(parts)


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def is_convex(ring: Column) -> Column:
    """All turns of a plane ring have one sign (0 aside)."""
    n = F.size(ring)
    turns = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.signum(cross2(minus(ring[(i + 1) % n], ring[i], "xy"), minus(ring[(i + 2) % n], ring[(i + 1) % n], "xy"))),
    )
    return ~(F.array_contains(turns, 1.0) & F.array_contains(turns, -1.0))


def in_triangle(p: Column, a: Column, b: Column, c: Column) -> Column:
    """In the plane, border included."""
    s = [cross2(minus(q, o, "xy"), minus(p, o, "xy")) for o, q in ((a, b), (b, c), (c, a))]
    return ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))


def opposite_collinear(p1: Column, p2: Column, q1: Column, q2: Column, error: float = 0.01) -> Column:
    """Two edges run against each other on one line."""
    u, v = minus(p2, p1), minus(q2, q1)
    near = (point_to_line(q1, p1, u)["distance"] < error) & (point_to_line(q2, p1, u)["distance"] < error)
    return near & (dot(u, v) < 0)


def nearest_on_segment(p: Column, a: Column, b: Column) -> Column:
    u = minus(b, a, "xy")
    t = F.coalesce(dot(minus(p, a, "xy"), u, "xy") / F.nullif(dot(u, u, "xy"), F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return point(a.x + t * u.x, a.y + t * u.y)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    return length(minus(p, nearest_on_segment(p, a, b), "xy"), "xy")


def segments_meet(a: Column, b: Column, c: Column, d: Column, error: float = 1e-6) -> Column:
    hit = crossing(a, minus(b, a, "xy"), c, minus(d, c, "xy"))
    return F.coalesce(on_segment(hit["s"], error) & on_segment(hit["t"], error), F.lit(False))


def is_ccw(a: Column, b: Column, c: Column) -> Column:
    return cross2(minus(b, a, "xy"), minus(c, a, "xy")) > 0


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Strictly inside a ring: even-odd rule, the border is outside."""
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("border"))

    def step(s, e):
        p, q = e["p"], e["q"]
        side = (q.x - p.x) * (y - p.y) - (q.y - p.y) * (x - p.x)
        over = ((p.y > y) != (q.y > y)) & (x < (q.x - p.x) * (y - p.y) / (q.y - p.y) + p.x)
        inside = x.between(F.least(p.x, q.x), F.greatest(p.x, q.x)) & y.between(F.least(p.y, q.y), F.greatest(p.y, q.y))
        return F.struct((s["n"] + F.coalesce(over, F.lit(False)).cast("int")).alias("n"), (s["border"] | ((side == 0) & inside)).alias("border"))

    return F.aggregate(edges(ring), state, step, lambda s: (s["n"] % 2 == 1) & ~s["border"])


def longest_edge(ring: Column) -> Column:
    """(length, angle in degrees) of the ring's longest edge, the first of equals."""
    own = F.transform(
        edges(ring),
        lambda e, i: F.struct(
            length(minus(e["q"], e["p"], "xy"), "xy").alias("length"), (-i).alias("order"),
            F.degrees(F.atan2(e["q"]["y"] - e["p"]["y"], e["q"]["x"] - e["p"]["x"])).alias("angle"),
        ),
    )
    best = F.array_max(own)
    return F.struct(best["length"].alias("length"), best["angle"].alias("angle"))


def folded_angle(degrees: Column) -> Column:
    """Into (-90, 90]."""
    return F.when(degrees > 90, degrees - 180).when(degrees <= -90, degrees + 180).otherwise(degrees)


def to_pixel(x: Column, y: Column, left: Column, top: Column, size: float) -> Column:
    """Row 0 is the largest y; halves round to even."""
    return F.struct(F.rint((x - left) / size).cast("int").alias("col"), F.rint((top - y) / size).cast("int").alias("row"))


def to_geo(col: Column, row: Column, left: Column, top: Column, size: float) -> Column:
    return point(left + col * size, top - row * size)


def samples(a: Column, b: Column, step: float) -> Column:
    """Points along a segment: n = round-half-even(length / step), spaced length / (n - 1)."""
    n = F.greatest(F.rint(length(minus(b, a, "xy"), "xy") / step).cast("int"), F.lit(2))
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: point(a.x + (b.x - a.x) * i / (n - 1), a.y + (b.y - a.y) * i / (n - 1))
    )


def rotation_matrix(omega: Column, phi: Column, kappa: Column, order: str = "xyz") -> list[Column]:
    """Nine columns of Rx Ry Rz (order xyz) or Rz Ry Rx (order zyx); angles in degrees."""
    o, p, k = F.radians(omega), F.radians(phi), F.radians(kappa)
    one, zero = F.lit(1.0), F.lit(0.0)
    rx = [[one, zero, zero], [zero, F.cos(o), -F.sin(o)], [zero, F.sin(o), F.cos(o)]]
    ry = [[F.cos(p), zero, F.sin(p)], [zero, one, zero], [-F.sin(p), zero, F.cos(p)]]
    rz = [[F.cos(k), -F.sin(k), zero], [F.sin(k), F.cos(k), zero], [zero, zero, one]]
    times = lambda a, b: [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]
    first, second, third = (rx, ry, rz) if order == "xyz" else (rz, ry, rx)
    return [c for row in times(times(first, second), third) for c in row]


def projected(p: Column, camera: Column, m: list[Column], focal: Column, pixel: Column, width: Column, height: Column) -> Column:
    """(u, v, visible) of a world point by the collinearity equations; the image's centre is the principal point."""
    d = minus(p, camera)
    a, b, c = (m[k] * d.x + m[3 + k] * d.y + m[6 + k] * d.z for k in range(3))
    c = F.nullif(c, F.lit(0.0))
    u = width / 2 - focal * a / c / pixel
    v = height / 2 + focal * b / c / pixel
    seen = (c < 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return F.struct(u.alias("u"), v.alias("v"), F.coalesce(seen, F.lit(False)).alias("visible"))


def mesh_quadrant(lat: Column, lon: Column) -> Column:
    """1 to 4: the quarter of a half mesh that a position lies in."""
    return (F.pmod(F.floor(lat * 240), F.lit(2)) * 2 + F.pmod(F.floor((lon - 100) * 160), F.lit(2)) + 1).cast("int")


def element_type(ring: Column, tolerance: float = 2.0) -> Column:
    """GROUND, WALL or ROOF from a face's angle to straight down."""
    down = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(-1.0).alias("z"))
    # each value is bound once, so that the expression does not grow with its uses
    tilt = F.transform(F.array(normal(ring)), lambda n: angle(n, down))
    kind = F.transform(tilt, lambda t: F.when(t < tolerance, "GROUND").when(90 - t < tolerance, "WALL").otherwise("ROOF"))
    return F.get(kind, F.lit(0))


def uv_box(us: Column, vs: Column, width: Column, height: Column, margin: Column) -> Column:
    """Pixel box of texture coordinates with a margin, clamped to the image; v runs upwards."""
    low = lambda c, size: F.greatest(F.lit(0), F.floor(F.array_min(c) * size) - margin)
    high = lambda c, size: F.least(size, F.ceil(F.array_max(c) * size) + margin)
    return F.struct(
        low(us, width).alias("x0"), high(us, width).alias("x1"),
        (height - high(vs, height)).alias("y0"), (height - low(vs, height)).alias("y1"),
    )


def elapsed(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def tile_offsets(size: Column, tile: int) -> Column:
    """Starts of tiles along an axis; the last one is moved inwards."""
    n = F.greatest(F.ceil(size / tile).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(0), F.least(i * tile, size - tile)).cast("int"))


def height_plane_distance(p: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Distance of a point from the plane z = alpha x + beta y + gamma."""
    return F.abs(alpha * p.x + beta * p.y - p.z + gamma) / F.sqrt(alpha * alpha + beta * beta + 1)


def parts(geometry: Column, least: float = 0.0) -> Column:
    """The rings of a multi-geometry (an array of rings; null is none) whose area is over the least."""
    return F.filter(F.coalesce(geometry, F.array().cast("array<array<struct<x:double,y:double>>>")), lambda r: area(r) > least)


#: Element names as files spell them.
ELEMENTS = {"Roof": "ROOF", "Wall": "WALL", "Ground": "GROUND"}


def element_named(name: Column) -> Column:
    """ROOF, WALL or GROUND from a section's name; null for any other."""
    out = F.lit(None).cast("string")
    for k, v in ELEMENTS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def element_title(element: Column) -> Column:
    """The inverse of element_named."""
    out = F.lit(None).cast("string")
    for k, v in ELEMENTS.items():
        out = F.when(element == v, k).otherwise(out)
    return out


def wall_normal(p: Column, q: Column, ring: Column, hole: Column, probe: float = 0.01) -> Column:
    """Unit vector (x, y) out of the building at the wall over the edge p-q of an outline, or of a hole in it.

    A point that far from the edge's middle tells which side is inside.
    """
    d = minus(q, p, "xy")
    n = F.nullif(length(d, "xy"), F.lit(0.0))
    nx, ny = d.y / n, -d.x / n
    inside = contains(ring, (p.x + q.x) / 2 + probe * nx, (p.y + q.y) / 2 + probe * ny)
    sign = F.when(inside == hole, F.lit(1.0)).otherwise(F.lit(-1.0))
    return point(sign * nx, sign * ny)


def wound_outwards(ring: Column, normal_xy: Column) -> Column:
    """A wall's ring, reversed where it does not run counter-clockwise as seen against its outward normal."""
    side = point(-normal_xy.y, normal_xy.x)
    flat = F.transform(ring, lambda p: point(p.x * side.x + p.y * side.y, p.z))
    return F.when(signed_area(flat) < 0, F.reverse(ring)).otherwise(ring)


def ground_ring(ring: Column, z: Column) -> Column:
    """An outline at a height, clockwise as seen from above."""
    flat = F.when(signed_area(ring) > 0, F.reverse(ring)).otherwise(ring)
    return F.transform(flat, lambda p: point(p.x, p.y, z))


def uv_start(us: Column, vs: Column, width: Column, height: Column) -> Column:
    """(row, col) of the first pixel of texture coordinates; v runs upwards."""
    return F.struct(F.floor((1 - F.array_max(vs)) * height).cast("int").alias("row"), F.floor(F.array_min(us) * width).cast("int").alias("col"))


def uv_end(us: Column, vs: Column, width: Column, height: Column) -> Column:
    """(row, col) behind the last pixel."""
    return F.struct(F.ceil((1 - F.array_min(vs)) * height).cast("int").alias("row"), F.ceil(F.array_max(us) * width).cast("int").alias("col"))


def truncated_foot(p: Column, start: Column, direction: Column) -> Column:
    """As point_to_line, with t cut to four decimals and the foot there: (distance, x, y, t)."""
    t = point_to_line(p, start, direction, "xy")["t"]
    cut = F.signum(t) * F.floor(F.abs(t) * 10000) / 10000
    x, y = start.x + cut * direction.x, start.y + cut * direction.y
    return F.struct(F.sqrt((p.x - x) ** 2 + (p.y - y) ** 2).alias("distance"), x.alias("x"), y.alias("y"), cut.alias("t"))


def ring_distance(p: Column, ring: Column) -> Column:
    """Distance of a point from a ring's line."""
    return F.array_min(F.transform(edges(ring), lambda e: segment_distance(p, e["p"], e["q"])))


def axis_aligned(degrees: Column, threshold: float) -> Column:
    """Whether an angle is within the threshold of a multiple of 90 degrees."""
    rest = F.pmod(degrees, F.lit(90.0))
    return F.least(rest, 90 - rest) <= threshold


def fitted_size(width: Column, height: Column, side: int) -> Column:
    """(w, h) of an image scaled so that its longer side is the given one."""
    scale = side / F.greatest(width, height)
    return F.struct(F.greatest(F.lit(1), F.floor(width * scale)).cast("int").alias("w"), F.greatest(F.lit(1), F.floor(height * scale)).cast("int").alias("h"))


def downscaled(width: Column, height: Column, gsd: Column, target: float = 0.25) -> Column:
    """(w, h) of an image of a ground sampling distance finer than the target, at the target; others stay as they are."""
    cut = lambda c: F.when(gsd < target, (c * gsd / target).cast("int")).otherwise(c.cast("int"))
    return F.struct(cut(width).alias("w"), cut(height).alias("h"))


def tile_place(number: Column, width: Column, height: Column, tile: int, scale: int = 4) -> Column:
    """(x, y) of a tile in the merged image, by its number in rows: edge tiles are moved inwards; all times scale."""
    across = F.greatest(F.ceil(width / tile).cast("int"), F.lit(1))
    x = F.greatest(F.lit(0), F.least((number % across) * tile, width - tile))
    y = F.greatest(F.lit(0), F.least(F.floor(number / across).cast("int") * tile, height - tile))
    return F.struct((x * scale).cast("int").alias("x"), (y * scale).cast("int").alias("y"))


def texture_box(us: Column, vs: Column, width: Column, height: Column, margin: int = 2) -> Column:
    """(x0, y0, x1, y1) of image coordinates, with the margin on each side on which the image has room for it."""
    low = lambda c: F.floor(F.array_min(c)).cast("int")
    high = lambda c: F.ceil(F.array_max(c)).cast("int")
    grown = lambda v: F.when(v - margin >= 0, v - margin).otherwise(v)
    wide = lambda v, size: F.when(v + margin <= size, v + margin).otherwise(v)
    return F.struct(
        grown(low(us)).alias("x0"), grown(low(vs)).alias("y0"), wide(high(us), width).alias("x1"), wide(high(vs), height).alias("y1")
    )


def nearest_on_ring(p: Column, ring: Column) -> Column:
    """The point of a ring's line that is nearest to p; the first edge of equals."""
    own = F.transform(
        edges(ring), lambda e, i: F.struct(segment_distance(p, e["p"], e["q"]).alias("away"), i.alias("i"), nearest_on_segment(p, e["p"], e["q"]).alias("at"))
    )
    return F.array_min(own)["at"]


def edge_key(p: Column, q: Column, scale: int = 1000) -> Column:
    """A key that an edge shares with its opposite: the whole part of the scaled sum of all coordinates, unsigned."""
    total = p.x + p.y + p.z + q.x + q.y + q.z
    return F.abs((total * scale).cast("long"))
