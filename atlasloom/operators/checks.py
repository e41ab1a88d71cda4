"""Row-wise predicates, measures and small models of frames, depths, detections and cameras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasloom.functions.geometry import clamp, col, finite, let, norm

#: Valid depths in metres, scores that are asked for, floor bands, floor checks (fixed values).
DEPTH_RANGE = (0.05, 6.0)
TRUSTED_SCORE, LEAST_SCORE = 0.5, 0.05
FLOOR_BAND, FLOOR_SIGMAS = 0.06, 3.0
HEIGHT_SIGMA, DEPTH_SIGMA, OWN_SCALE_BOUND = 0.02, 0.01, 0.30
#: Turns from which the skew part of a rotation no longer gives its axis well.
HALF_TURN = 3.13
NAME = "^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def valid_depth(z) -> Column:
    return F.coalesce(finite(z) & col(z).between(*DEPTH_RANGE), F.lit(False))


def request_floor(least, trusted: float = TRUSTED_SCORE) -> Column:
    """Score from which detections are asked for: no lower floor changes what a higher one gives."""
    return F.when(col(least) >= trusted, F.lit(trusted)).otherwise(F.greatest(F.lit(0.0), F.least(col(least), F.lit(LEAST_SCORE))))


def sound_detections(rows: DataFrame, least: Column, background: list[str], size: float = 0.03) -> DataFrame:
    """Detections of enough score and size whose label is no background; a null score or size is not enough."""
    return rows.where((F.col("score") >= least) & (F.least("width", "height") >= size) & ~F.col("label").isin(background))


def below_floor(points: DataFrame, by: list[str], z: str, floor: Column, margin: float = 0.3, least: int = 10) -> DataFrame:
    """Objects of enough points whose 90th percentile of height lies under the floor by the margin."""
    g = points.groupBy(*by).agg(F.percentile(z, F.lit(0.9)).alias("top"), F.count(z).alias("points"))
    return g.where((F.col("points") >= least) & (F.col("top") < floor - margin))


def exp_so3(w) -> Column:
    """Rotation, row-major, of a rotation vector; the series of sine and cosine near zero."""

    def made(v: Column) -> Column:
        return let(norm(v), lambda a: let(F.when(a > 1e-8, F.sin(a) / a).otherwise(1 - a * a / 6), lambda s: let(F.when(a > 1e-8, (1 - F.cos(a)) / (a * a)).otherwise(0.5 - a * a / 24), lambda c: let(F.lit(1.0) - c * a * a, lambda d: F.array(
            d + c * v[0] * v[0], c * v[0] * v[1] - s * v[2], c * v[0] * v[2] + s * v[1],
            c * v[0] * v[1] + s * v[2], d + c * v[1] * v[1], c * v[1] * v[2] - s * v[0],
            c * v[0] * v[2] - s * v[1], c * v[1] * v[2] + s * v[0], d + c * v[2] * v[2],
        )))))

    return let(F.transform(col(w), lambda x: x.cast("double")), made)


def log_so3(r) -> Column:
    """Rotation vector of a rotation, of length pi at most; near half a turn its axis comes from the symmetric part."""

    def made(m: Column) -> Column:
        skew = F.array(m[7] - m[5], m[2] - m[6], m[3] - m[1])
        return let(skew, lambda s: let(F.atan2(norm(s) / 2, (m[0] + m[4] + m[8] - 1) / 2), lambda a: F.when(a < HALF_TURN, let(F.when(a > 1e-8, a / (2 * F.sin(a))).otherwise(0.5), lambda k: F.transform(s, lambda x: k * x))).otherwise(half(m, s, a))))

    def half(m: Column, s: Column, a: Column) -> Column:
        def about(k: int) -> Column:
            """From the largest component of the axis, whose sign is that of the skew part."""
            size = F.sqrt(F.greatest((m[4 * k] - F.cos(a)) / (1 - F.cos(a)), F.lit(0.0)))
            sign = F.when(s[k] < 0, -1.0).otherwise(1.0)
            return F.array(*[a * sign * (size if i == k else (m[3 * i + k] + m[3 * k + i]) / (2 * (1 - F.cos(a)) * size)) for i in range(3)])

        return F.when((m[0] >= m[4]) & (m[0] >= m[8]), about(0)).when(m[4] >= m[8], about(1)).otherwise(about(2))

    return let(col(r), made)


def yaw_tilt(a, b) -> Column:
    """How far two orientations are apart, in degrees: the least-squares turn about z between them (fixed formula), and the angle of their z rows."""
    a, b = col(a), col(b)
    m = lambda i, j: sum((b[3 * i + k] * a[3 * j + k] for k in range(1, 3)), b[3 * i] * a[3 * j])
    up = sum((a[6 + k] * b[6 + k] for k in range(1, 3)), a[6] * b[6])
    return F.struct(F.degrees(F.abs(F.atan2(m(0, 1) - m(1, 0), m(0, 0) + m(1, 1)))).alias("yaw"), F.degrees(F.acos(clamp(up, -1.0, 1.0))).alias("tilt"))


def lens_ray(u, v, fx, fy, cx, cy, k) -> Column:
    """Ray (x / z, y / z) that a pixel sees under the division model."""
    x, y = (col(u) - col(cx)) / col(fx), (col(v) - col(cy)) / col(fy)
    d = 1 + col(k) * (x * x + y * y)
    return F.struct((x / d).alias("x"), (y / d).alias("y"))


def lens_pixel(x, y, fx, fy, cx, cy, k) -> Column:
    """Pixel that shows a ray; null beyond the model's reach."""
    x, y = col(x), col(y)
    reach = 1 - 4 * col(k) * (x * x + y * y)
    f = F.when(reach > 0, 2 / (1 + F.sqrt(reach)))
    return F.struct((f * x * col(fx) + col(cx)).alias("u"), (f * y * col(fy) + col(cy)).alias("v"))


def floor_band(sigma) -> Column:
    return F.greatest(F.lit(FLOOR_BAND), FLOOR_SIGMAS * col(sigma))


def sound_name(name) -> Column:
    return F.coalesce(col(name).rlike(NAME), F.lit(False))


def same_camera(a: dict[str, Column], b: dict[str, Column], defaults: dict[str, Column]) -> Column:
    """Equal values of two descriptions, where absent is the default or equal to absent.

    A distortion (`distortion`, an array of coefficients) of zeros only is absent; the ignore mask (`ignore_mask`) does not count.
    """

    def plain(name: str, value: Column) -> Column:
        if name == "distortion":
            value = F.when(F.exists(value, lambda x: x != 0), value)
        return F.coalesce(value, defaults[name]) if name in defaults else value

    norm_ = lambda d: F.struct(*[plain(n, v).alias(n) for n, v in sorted(d.items()) if n != "ignore_mask"])
    return norm_(a).eqNullSafe(norm_(b))


def height_off(z, floor, height, height_sigma, sigma_pos) -> Column:
    """A camera farther from its sent height than three joint sigmas."""
    return F.coalesce(F.abs(col(z) - col(floor) - col(height)) > FLOOR_SIGMAS * F.sqrt(col(height_sigma) * col(height_sigma) + col(sigma_pos) * col(sigma_pos) / 3), F.lit(False))


def floor_verdict(kind, height, height_sigma, sigma_pos, own, relative) -> Column:
    """(content, factor, judged) from a frame's own floor height against the sent one.

    A sensor's depth off by more than its bound gives no content; a monocular depth takes its own scale, but one too
    far from the map's is not judged. Without a height, a depth or a floor nothing changes.
    """
    kind, height, own = col(kind), col(height), col(own)
    sigma = F.coalesce(F.nullif(col(height_sigma), F.lit(0.0)), F.lit(HEIGHT_SIGMA))
    bound = FLOOR_SIGMAS * F.sqrt(sigma * sigma + F.pow(DEPTH_SIGMA * height, F.lit(2.0)) + col(sigma_pos) * col(sigma_pos) / 3)
    made = lambda content, factor, judged: F.struct(F.lit(content).alias("content"), (factor if isinstance(factor, Column) else F.lit(factor).cast("double")).alias("factor"), F.lit(judged).alias("judged"))
    scale = height / own
    return (
        F.when(height.isNull() | (height <= 0) | (kind == "none") | own.isNull(), made(True, None, True))
        .when((kind == "sensor") & (F.abs(own - height) > bound), made(False, None, True))
        .when(kind == "sensor", made(True, None, True))
        .when(F.abs(col(relative) * scale - 1) > OWN_SCALE_BOUND, made(True, None, False))
        .otherwise(made(True, scale, True))
    )


def scaled_prior(x, origin, scale, same_epoch: Column) -> Column:
    """A horizontal coordinate of a prior under the scale in force, which holds in the origin's epoch only."""
    return F.when(same_epoch, col(origin) + col(scale) * (col(x) - col(origin))).otherwise(col(x))


def unignored(pixels: DataFrame, by: list[str], ignored: Column, most: float = 0.5) -> DataFrame:
    """Detections (by...) that lie on ignored pixels with at most that share of their own."""
    g = pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("pixels"), F.count(F.when(ignored, 1)).alias("ignored"))
    return g.where(F.col("ignored") <= most * F.col("pixels"))


def composed_sigma(references: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, variance): mean variance of a frame's references, weighted by inliers. `references`: frame, inliers, sigma."""
    return references.groupBy(frame).agg((F.sum(F.col("inliers") * F.col("sigma") * F.col("sigma")) / F.sum("inliers")).alias("variance"))
