"""Column functions for voxel keys, rigid transforms, cameras and rotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Voxel indices must lie in [-HALF, HALF): three of them fill the 63 bits of a key.
HALF, BITS, MASK = 1 << 20, 21, (1 << 21) - 1


def is_finite(*columns: str) -> Column:
    """All columns are numbers: not null, NaN or infinite."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns])


def voxel_index(x: Column, origin: float, size: float) -> Column:
    return F.floor((x - F.lit(origin)) / F.lit(size)).cast("long")


def pack_key(i: Column, j: Column, k: Column, check: bool = True) -> Column:
    """One 63-bit key of three indices; out-of-range indices raise an error unless check is off."""
    part = lambda c, at: F.shiftleft(c.cast("long") + HALF, at)
    key = part(i, 2 * BITS).bitwiseXOR(part(j, BITS)).bitwiseXOR(part(k, 0))
    if not check:
        return key
    inside = reduce(lambda a, b: a & b, [c.between(-HALF, HALF - 1) for c in (i, j, k)])
    return F.when(inside | i.isNull() | j.isNull() | k.isNull(), key).otherwise(F.raise_error(F.lit("voxel index out of range")).cast("long"))


def unpack_key(key: Column) -> list[Column]:
    return [F.shiftright(key, at).bitwiseAND(MASK) - HALF for at in (2 * BITS, BITS, 0)]


def voxel_centre(index: Column, origin: float, size: float) -> Column:
    return F.lit(origin) + (index + F.lit(0.5)) * F.lit(size)


def distance(p: list[Column], q: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(x - y) * (x - y) for x, y in zip(p, q, strict=True)]))


def yaw_sector(dx: Column, dy: Column, sectors: int = 8) -> Column:
    """The sector of a direction, counted from -pi."""
    return F.pmod(F.floor((F.atan2(dy, dx) + F.pi()) / (2 * F.pi()) * sectors), F.lit(sectors)).cast("int")


def yaw_bit(dx: Column, dy: Column, sectors: int = 8) -> Column:
    return F.expr("1").cast("int") * F.pow(F.lit(2), yaw_sector(dx, dy, sectors)).cast("int")


def linear(rows: list[list[float]], p: list[Column], t: list[float], scale: float = 1.0) -> list[Column]:
    """scale * (R p) + t, a column for each row of R."""
    return [F.lit(scale) * reduce(lambda a, b: a + b, [F.lit(r) * x for r, x in zip(row, p, strict=True)]) + F.lit(c) for row, c in zip(rows, t, strict=True)]


def projective(rows: list[list[float]], t: list[float], p_row: list[float], p: list[Column], least: float = 1e-3) -> list[Column]:
    """(A p + t) / (p_row p + 1), the divisor kept at least `least` from zero with its sign; zero counts as positive."""
    den = reduce(lambda a, b: a + b, [F.lit(r) * x for r, x in zip(p_row, p, strict=True)]) + F.lit(1.0)
    safe = F.when(den == 0, F.lit(least)).otherwise(F.signum(den) * F.greatest(F.abs(den), F.lit(least)))
    return [c / safe for c in linear(rows, p, t)]


def invert_rigid(r: list[list[Column]], t: list[Column]) -> tuple[list[list[Column]], list[Column]]:
    """Rotation transposed and -R^T t; also the camera centre of a world-to-camera pose."""
    back = [[r[j][i] for j in range(3)] for i in range(3)]
    return back, [-(row[0] * t[0] + row[1] * t[1] + row[2] * t[2]) for row in back]


def unproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    """Camera coordinates of a pixel with depth; null where the depth is not positive."""
    d = F.when(depth > 0, depth)
    return [(u - cx) / fx * d, (v - cy) / fy * d, d]


def project(p: list[Column], fx: Column, fy: Column, cx: Column, cy: Column, k1: float = 0.0, default: float = 0.0) -> list[Column]:
    """Pixel of a camera-space point with one radial coefficient; `default` where it cannot be seen."""
    x, y, z = p
    u, v = x / z, y / z
    radial = 1 + F.lit(k1) * (u * u + v * v)
    seen = (z > 0) & is_not_nan(u) & is_not_nan(v)
    return [F.when(seen, f * a * radial + c).otherwise(F.lit(default)) for f, a, c in ((fx, u, cx), (fy, v, cy))]


def undistort(x: Column, y: Column, k1: float, rounds: int = 20) -> list[Column]:
    """Ideal normalised coordinates of distorted ones, one radial coefficient, by fixed-point rounds.

    Converges where the distortion is mild (k1 r^2 well below 1).
    """
    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def step(s: Column, _: Column) -> Column:
        radial = 1 + F.lit(k1) * (s.x * s.x + s.y * s.y)
        return F.struct((x / radial).alias("x"), (y / radial).alias("y"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return [found.x, found.y]


def is_not_nan(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def quaternion_to_matrix(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    s = 2 / (x * x + y * y + z * z + w * w)
    return [
        [1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y)],
    ]


def matrix_to_quaternion(m: list[list[Column]]) -> list[Column]:
    """x, y, z, w with w >= 0, from the best conditioned of the four forms."""
    d = [m[0][0], m[1][1], m[2][2]]
    trace = d[0] + d[1] + d[2]
    squares = [1 + d[0] - d[1] - d[2], 1 - d[0] + d[1] - d[2], 1 - d[0] - d[1] + d[2], 1 + trace]
    sums = {(0, 1): m[0][1] + m[1][0], (0, 2): m[0][2] + m[2][0], (1, 2): m[1][2] + m[2][1]}
    gaps = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    most = F.greatest(*squares)
    forms = []
    for lead in range(4):
        q = F.sqrt(F.greatest(squares[lead], F.lit(0.0)))
        own = [q / 2 if k == lead else (gaps[min(k, lead)] if 3 in (k, lead) else sums[min(k, lead), max(k, lead)]) / (2 * q) for k in range(4)]
        forms.append(own)
    out = []
    for k in range(4):
        chosen = forms[3][k]
        for lead in (2, 1, 0):
            chosen = F.when(squares[lead] == most, forms[lead][k]).otherwise(chosen)
        out.append(chosen)
    sign = F.when(out[3] < 0, -1.0).otherwise(1.0)
    return [c * sign for c in out]


def field_of_view(size: Column, focal: Column) -> Column:
    return 2 * F.atan(size / 2 / focal)


def focal_length(size: Column, fov: Column) -> Column:
    return size / 2 / F.tan(fov / 2)


def rodrigues(w: list[Column]) -> list[list[Column]]:
    """Rotation of a rotation vector; the identity below 1e-8."""
    angle = F.sqrt(w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
    small = angle < 1e-8
    safe = F.when(small, F.lit(1.0)).otherwise(angle)
    x, y, z = (c / safe for c in w)
    c, s = F.cos(angle), F.sin(angle)
    full = [
        [c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s],
        [y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s],
        [z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)],
    ]
    return [[F.when(small, F.lit(float(i == j))).otherwise(full[i][j]) for j in range(3)] for i in range(3)]


def fourier(x: Column, bands: int) -> Column:
    """sin and cos of 2^k pi x for each band, as an array."""
    angles = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.pow(F.lit(2.0), k) * F.pi() * x)
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = 1e-5) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_expm1(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


def confidence(x: Column, mode: str) -> Column:
    """A confidence as log, sqrt, minus one, or as it is."""
    return {"log": F.log(x), "sqrt": F.sqrt(x), "m1": x - 1, "id": x}[mode]


def natural_key(name: Column, width: int = 12) -> Column:
    """A key by which frame2 comes before frame10: digits padded with zeros, letters in lower case."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, r"0*(\d{" + str(width) + r"})(?!\d)", "$1")
