"""Column expressions for positions, rotations, poses, boxes, polygons and colours. Everything stays in the JVM.

Vectors are arrays of doubles, poses row-major arrays of 16, quaternions scalar-last arrays of 4, angles degrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def voxel(c, size: float) -> Column:
    """Voxel number of a coordinate: the floor, so negative coordinates fall into negative voxels."""
    return F.floor(col(c) / F.lit(float(size))).cast("long")


def voxel_key(*cells, bits: int = 21) -> Column:
    """Cells of up to three axes packed into one long, each offset to be positive."""
    out = F.lit(0).cast("long")
    for c in cells:
        out = F.shiftleft(out, bits).bitwiseOR((col(c).cast("long") + F.lit(1 << (bits - 1))).bitwiseAND(F.lit((1 << bits) - 1)))
    return out


def finite(*cs) -> Column:
    """True where no value is null, NaN or infinite."""
    out = F.lit(True)
    for c in cs:
        c = col(c)
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce(out, F.lit(False))


def half_even(c, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def clamp(c, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def wrap_degrees(c) -> Column:
    """Into (-180, 180]. A step that rounding puts just beyond half a turn back is half a turn ahead, as the rest is taken once more after a turn is added."""
    return F.lit(180.0) - ((F.lit(180.0) - col(c)) % F.lit(360.0) + F.lit(360.0)) % F.lit(360.0)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def distance(a, b) -> Column:
    d = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def angle_between(a, b) -> Column:
    """Degrees; the cosine is clipped, so equal directions give 0 and not null."""
    return F.degrees(F.acos(clamp(cosine(a, b), -1.0, 1.0)))


def rotation_from_quaternion(q) -> Column:
    """Nine entries, row-major; the quaternion is normalised first."""
    unit = let(col(q), lambda v: let(F.greatest(norm(v), F.lit(1e-300)), lambda n: F.transform(v, lambda x: x.cast("double") / n)))
    return let(unit, _rotation)


def _rotation(q: Column) -> Column:
    x, y, z, w = (q[k] for k in range(4))
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def quaternion_from_rotation(r) -> Column:
    """Scalar last, w not negative; the largest of the four squares decides the branch."""
    return let(col(r), _quaternion)


def _quaternion(r: Column) -> Column:
    m = lambda i, j: r[3 * i + j]
    squares = [1 + m(0, 0) - m(1, 1) - m(2, 2), 1 - m(0, 0) + m(1, 1) - m(2, 2), 1 - m(0, 0) - m(1, 1) + m(2, 2), 1 + m(0, 0) + m(1, 1) + m(2, 2)]
    rows = [
        [squares[0], m(0, 1) + m(1, 0), m(0, 2) + m(2, 0), m(2, 1) - m(1, 2)],
        [m(0, 1) + m(1, 0), squares[1], m(1, 2) + m(2, 1), m(0, 2) - m(2, 0)],
        [m(0, 2) + m(2, 0), m(1, 2) + m(2, 1), squares[2], m(1, 0) - m(0, 1)],
        [m(2, 1) - m(1, 2), m(0, 2) - m(2, 0), m(1, 0) - m(0, 1), squares[3]],
    ]
    best = F.greatest(*squares)
    picked = F.array(*rows[3])
    for s, row in list(zip(squares, rows, strict=True))[2::-1]:
        picked = F.when(s == best, F.array(*row)).otherwise(picked)
    return let(picked, lambda q: let(F.when(q[3] < 0, -1.0).otherwise(1.0) / norm(q), lambda s: F.transform(q, lambda v: v * s)))


def rotate(r, v) -> Column:
    r, v = col(r), col(v)
    return F.array(*[r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3)])


def compose(a, b) -> Column:
    """Product of two poses."""
    return let(col(a), lambda x: let(col(b), lambda y: _product(x, y)))


def _product(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def inverse(p) -> Column:
    """Inverse of a rigid pose."""
    return let(col(p), _inverse)


def _inverse(p: Column) -> Column:
    out = []
    for i in range(3):
        out += [p[4 * j + i] for j in range(3)]
        out.append(-(p[i] * p[3] + p[4 + i] * p[7] + p[8 + i] * p[11]))
    return F.array(*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def apply(p, v, scale=1.0) -> Column:
    """A point under a pose, after a similarity's scale."""
    p, v, s = col(p), col(v), scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.array(*[s * (p[4 * i] * v[0] + p[4 * i + 1] * v[1] + p[4 * i + 2] * v[2]) + p[4 * i + 3] for i in range(3)])


def rotation_angle(p) -> Column:
    """Degrees of a pose's rotation, from its trace."""
    p = col(p)
    return F.degrees(F.acos(clamp((p[0] + p[5] + p[10] - 1) / 2, -1.0, 1.0)))


def yaw(p) -> Column:
    """Degrees about the up axis."""
    return F.degrees(F.atan2(col(p)[4], col(p)[0]))


def tilt(p) -> Column:
    """Degrees between the pose's up axis and the map's."""
    return F.degrees(F.acos(clamp(col(p)[10], -1.0, 1.0)))


def project(v, fx, fy, cx, cy) -> Column:
    """Pixel of a point in camera axes; null behind the camera."""
    v = col(v)
    return F.when(v[2] > 0, F.struct((col(fx) * v[0] / v[2] + col(cx)).alias("u"), (col(fy) * v[1] / v[2] + col(cy)).alias("v")))


def unproject(u, v, z, fx, fy, cx, cy) -> Column:
    return F.array((col(u) - col(cx)) * col(z) / col(fx), (col(v) - col(cy)) * col(z) / col(fy), col(z))


def polygon_area(p) -> Column:
    """Shoelace area of an array of (x, y) structs."""
    p = col(p)
    n = F.size(p)
    terms = F.transform(p, lambda a, i: a["x"] * p[(i + 1) % n]["y"] - p[(i + 1) % n]["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)) / 2


def in_polygon(x, y, p) -> Column:
    """Even-odd rule over the edges of an array of (x, y) structs; a vertex on the scan line counts once."""
    x, y, p = col(x), col(y), col(p)
    n = F.size(p)

    def crosses(a, i):
        b = p[(i + 1) % n]
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(p, crosses), F.lit(0), lambda s, k: s + k) % 2 == 1


def segment_distance(x, y, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment; a segment of no length is its point."""
    x, y, ax, ay, bx, by = map(col, (x, y, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = clamp(F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), 0.0, 1.0)
    return F.hypot(x - ax - t * dx, y - ay - t * dy)


def in_oriented_box(x, y, z, cx, cy, cz, sx, sy, sz, yaw_deg, margin: float = 0.0) -> Column:
    x, y, z, cx, cy, cz, sx, sy, sz, a = map(col, (x, y, z, cx, cy, cz, sx, sy, sz, yaw_deg))
    c, s = F.cos(F.radians(a)), F.sin(F.radians(a))
    u, v = c * (x - cx) + s * (y - cy), -s * (x - cx) + c * (y - cy)
    return (F.abs(u) <= sx / 2 + margin) & (F.abs(v) <= sy / 2 + margin) & (F.abs(z - cz) <= sz / 2 + margin)


def box_iou(a: list, b: list) -> Column:
    """Intersection over union of boxes given as (x0, y0, x1, y1)."""
    a, b = [col(c) for c in a], [col(c) for c in b]
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return F.coalesce(w * h / F.nullif(area(a) + area(b) - w * h, F.lit(0.0)), F.lit(0.0))


def linear_light(c) -> Column:
    """sRGB value of 0 to 255 as linear light."""
    v = col(c) / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luminance(r, g, b) -> Column:
    return 0.2126 * linear_light(r) + 0.7152 * linear_light(g) + 0.0722 * linear_light(b)


def contrast(a: Column, b: Column) -> Column:
    """Ratio of two luminances, the lighter over the darker."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def oklab(r, g, b) -> Column:
    """Perceptual colour (l, a, b); the matrices are fixed values."""
    r, g, b = (linear_light(c) for c in (r, g, b))
    lms = [0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b, 0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b, 0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b]
    c = [F.cbrt(v) for v in lms]
    return F.struct(
        (0.2104542553 * c[0] + 0.7936177850 * c[1] - 0.0040720468 * c[2]).alias("l"),
        (1.9779984951 * c[0] - 2.4285922050 * c[1] + 0.4505937099 * c[2]).alias("a"),
        (0.0259040371 * c[0] + 0.7827717662 * c[1] - 0.8086757660 * c[2]).alias("b"),
    )


def nice_step(c) -> Column:
    """The smallest of 1, 2, 5 times a power of ten that is not below the value."""
    c = col(c)
    base = F.pow(F.lit(10.0), F.floor(F.log10(c)))
    return F.when(c <= base, base).when(c <= 2 * base, 2 * base).when(c <= 5 * base, 5 * base).otherwise(10 * base)
