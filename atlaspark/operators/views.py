"""Cameras, views and pairs of views: intrinsics, poses, pair tables, losses and overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered

#: Camera models that give one focal length before the principal point; all others give two.
ONE_FOCAL = ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")


def intrinsics(model: Column, params: Column) -> list[Column]:
    """fx, fy, cx, cy of a camera model's parameter list."""
    one = model.isin(*ONE_FOCAL)
    at = lambda i, j: F.when(one, F.get(params, i)).otherwise(F.get(params, j))
    return [F.get(params, 0), at(0, 1), at(1, 2), at(2, 3)]


def crop_and_scale(k: list[Column], left: Column, top: Column, ratio: Column) -> list[Column]:
    """Intrinsics after a crop at (left, top) and a resize, pixel centres at half numbers."""
    fx, fy, cx, cy = k
    return [fx * ratio, fy * ratio, (cx - left + 0.5) * ratio - 0.5, (cy - top + 0.5) * ratio - 0.5]


def from_ndc(focal: Column, px: Column, py: Column, width: Column, height: Column) -> list[Column]:
    """Pinhole intrinsics of normalised device coordinates, whose unit is half the shorter side and whose axes point left and up."""
    half = F.least(width, height) / 2
    return [focal * half, focal * half, width / 2 - px * half, height / 2 - py * half]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: list[Column]) -> list[Column]:
    n = F.sqrt(reduce(lambda x, y: x + y, [c * c for c in a]))
    return [c / n for c in a]


def look_at(eye: list[Column], target: list[Column], up: list[Column]) -> list[list[Column]]:
    """Right, down and forward axes of a camera at `eye` that looks at `target`."""
    forward = unit([t - e for e, t in zip(eye, target, strict=True)])
    right = unit(cross(forward, up))
    return [right, cross(forward, right), forward]


def ray_to_angles(x: Column, y: Column, z: Column) -> list[Column]:
    """Longitude and latitude of a direction, z ahead and y down."""
    return [F.atan2(x, z), F.asin(y / F.sqrt(x * x + y * y + z * z))]


def angles_to_ray(lon: Column, lat: Column) -> list[Column]:
    return [F.cos(lat) * F.sin(lon), F.sin(lat), F.cos(lat) * F.cos(lon)]


def equirectangular(lon: Column, lat: Column, width: float, height: float) -> list[Column]:
    """Pixel of a direction in a panorama."""
    return [(lon / (2 * F.pi()) + 0.5) * width, (lat / F.pi() + 0.5) * height]


def spiral(step: Column, n: int, radius: float, half_turns: float) -> list[Column]:
    """Point of a spiral that leaves the centre and comes back to it over n steps."""
    a = step / n
    r, theta = radius * F.abs(F.sin(F.pi() * a)), a * half_turns * F.pi()
    return [r * F.cos(theta), r * F.sin(theta)]


def fit_inside(width: Column, height: Column, to_width: float, to_height: float) -> list[Column]:
    """Scale and offsets of the resize and centre crop that fill a target: x' = scale * x - left, y' = scale * y - top."""
    scale = F.greatest(F.lit(to_width) / width, F.lit(to_height) / height)
    return [scale, (width * scale - to_width) / 2, (height * scale - to_height) / 2]


def facing(x: Column, y: Column) -> Column:
    """Which of UP, DOWN, LEFT and RIGHT a mean direction in the image plane is nearest to; ties go to the vertical."""
    return F.when(F.abs(y) >= F.abs(x), F.when(y >= 0, "UP").otherwise("DOWN")).otherwise(F.when(x >= 0, "RIGHT").otherwise("LEFT"))


def schedule(t: Column, start: float, end: float, warm: float = 0.0) -> list[Column]:
    """Cosine and linear rates at t from 0 to 1, rising straight from 0 over the first `warm` part."""
    rest = F.greatest(F.lit(0.0), (t - warm) / (1.0 - warm))
    shapes = [end + (start - end) * (1 + F.cos(F.pi() * rest)) / 2, start + (end - start) * rest]
    return [F.when(t < warm, start * t / warm).otherwise(s) for s in shapes] if warm else shapes


def over_edges(edges: DataFrame, keys: list[str], columns: dict[str, str], agg) -> DataFrame:
    """(image, keys.., value..): `agg` of each image's columns over all pairs that it is part of.

    columns: value name to the suffix pattern of the two sides, such as conf: "conf_{}" for conf_src and conf_dst.
    """
    sides = [edges.select(F.col(s).alias("image"), *keys, *[F.col(c.format(s)).alias(n) for n, c in columns.items()]) for s in ("src", "dst")]
    return sides[0].union(sides[1]).groupBy("image", *keys).agg(*[agg(n).alias(n) for n in columns])


def pair_scales(edges: DataFrame, scale: str, base: float) -> DataFrame:
    """Scales of pairs brought to the geometric mean `base`: one row says by what factor."""
    factor = edges.agg(F.exp(F.lit(base).cast("double") - F.avg(F.log(scale))).alias("factor"))
    return edges.crossJoin(F.broadcast(factor)).withColumn("scaled", F.col(scale) * F.col("factor"))


def pair_residuals(points: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(src, dst, loss, n): confidence-weighted mean distance of a pair's points (src, dst, keys.., x, y, z, conf) to the image's (keys.., px, py, pz)."""
    both = points.join(images, keys)
    far = F.sqrt(reduce(lambda a, b: a + b, [(F.col(a) - F.col(f"p{a}")) * (F.col(a) - F.col(f"p{a}")) for a in "xyz"]))
    return both.groupBy("src", "dst").agg((F.sum(F.col("conf") * far) / F.sum("conf")).alias("loss"), F.count("*").alias("n"))


def shape_check(views: DataFrame) -> DataFrame:
    """(image, shapes, consistent) of (image, h, w): how many shapes each image comes in."""
    return views.groupBy("image").agg(F.countDistinct(F.struct("h", "w")).alias("shapes")).withColumn("consistent", F.col("shapes") == 1)


def contiguous(views: DataFrame) -> DataFrame:
    """One row: whether image numbers are 0 to n - 1 without a gap."""
    return views.agg((F.countDistinct("image") == F.max("image") + 1).alias("contiguous"), F.countDistinct("image").alias("images"))


def merged_runs(pairs: DataFrame, runs: DataFrame, cache: DataFrame, value: str, filler: float) -> DataFrame:
    """Each pair with the value of its run, else the cached one, else a filler, and where it is from."""
    found = pairs.join(runs.select("src", "dst", F.col(value).alias("_run")), ["src", "dst"], "left").join(cache.select("src", "dst", F.col(value).alias("_old")), ["src", "dst"], "left")
    source = F.when(F.col("_run").isNotNull(), "run").when(F.col("_old").isNotNull(), "cache").otherwise("filler")
    return found.select("src", "dst", F.coalesce("_run", "_old", F.lit(filler)).alias(value), source.alias("source"))


def round_robin(items: DataFrame, pointers: DataFrame, place: str, score: str, least: float, n: int) -> DataFrame:
    """(pointer, place): for each pointer the first item of score `least` or more from there on, around the ring of n places."""
    good = items.where(F.col(score) >= least).select(place)
    # One row for each pointer; a ring has few places.
    step = F.pmod(F.col(place) - F.col("pointer"), F.lit(n))
    return good.crossJoin(F.broadcast(pointers)).groupBy("pointer").agg(F.min_by(place, step).alias(place))


def view_overlap(seen: DataFrame, least: float) -> DataFrame:
    """(src, dst, forth, back, accepted) of distinct (frame, cell): shares of either view's cells that the other one sees."""
    size = seen.groupBy("frame").agg(F.count("*").alias("n"))
    both = seen.withColumnRenamed("frame", "src").join(seen.withColumnRenamed("frame", "dst"), "cell").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("both"))
    both = both.join(size.select(F.col("frame").alias("src"), F.col("n").alias("ns")), "src").join(size.select(F.col("frame").alias("dst"), F.col("n").alias("nd")), "dst")
    forth, back = F.col("both") / F.col("ns"), F.col("both") / F.col("nd")
    return both.select("src", "dst", forth.alias("forth"), back.alias("back"), (F.least(forth, back) >= least).alias("accepted"))


def near_covisibility(cells: DataFrame, reach: int) -> DataFrame:
    """(src, dst, share) of distinct (frame, i, j): the share of a frame's cells that have a cell of another frame within `reach` steps.

    The right side is repeated for the cells around its own, and only distinct ones meet.
    """
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    around = cells.withColumn("s", F.explode(steps)).select(F.col("frame").alias("dst"), (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j")).distinct()
    size = cells.groupBy(F.col("frame").alias("src")).agg(F.count("*").alias("n"))
    hit = cells.withColumnRenamed("frame", "src").join(around, ["i", "j"]).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("both"))
    return hit.join(size, "src").select("src", "dst", (F.col("both") / F.col("n")).alias("share"))


def best_direction(pairs: DataFrame) -> DataFrame:
    """Of each two opposite pairs (src, dst, score) the better one; ties go to the smaller source."""
    key = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    return pairs.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("c"), "src", "dst")).alias("m")).select("m.src", "m.dst", (-F.col("m.c")).alias("score"))


def least_of_block(errors: DataFrame, value: str, side: int = 2) -> DataFrame:
    """(v, u, value): the least value of each block of pixels."""
    return errors.groupBy(F.floor(F.col("v") / side).cast("long").alias("v"), F.floor(F.col("u") / side).cast("long").alias("u")).agg(F.min(value).alias(value))


def consecutive(frames: DataFrame, by: list[str], at: str, stride: int = 1) -> DataFrame:
    """(by.., src, dst): each frame with the next one of its sequence and back, from every stride-th frame."""
    order = Window.partitionBy(*by).orderBy(at)
    ahead = frames.select(*by, F.col(at).alias("src"), F.lead(at).over(order).alias("dst"), (F.row_number().over(order) - 1).alias("_n")).where(F.col("dst").isNotNull() & (F.col("_n") % stride == 0)).drop("_n")
    return ahead.union(ahead.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst")))


def next_valid(frames: DataFrame, by: list[str], at: str, valid: Column) -> DataFrame:
    """Each frame with the first valid one at or after it, around the end; null where the sequence has none."""
    good = F.when(valid, F.col(at))
    # Backwards, as a frame up to the end is worked out anew for every row.
    ahead = F.last(good, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumn("found", F.coalesce(ahead, F.min(good).over(Window.partitionBy(*by))))


def paired_by_order(left: DataFrame, right: DataFrame, by: list[str], left_name: str, right_name: str, skip: int = 0) -> DataFrame:
    """(by.., place, left, right, matched): both sides' names by their place in order, the first `skip` left out; matched: both sides have as many."""
    rank = lambda df, c: df.select(*by, F.col(c), (F.row_number().over(Window.partitionBy(*by).orderBy(c)) - 1).alias("place"), F.count("*").over(Window.partitionBy(*by)).alias(f"_n_{c}"))
    both = rank(left, left_name).join(rank(right, right_name), [*by, "place"])
    return both.where(F.col("place") >= skip).select(*by, "place", left_name, right_name, (F.col(f"_n_{left_name}") == F.col(f"_n_{right_name}")).alias("matched"))


def occlusion_cleaned(points: DataFrame, depths: DataFrame, tolerance: float, bad: float) -> DataFrame:
    """Points (frame, u, v, z, conf, ..) in front of the depth that a view has at their pixel (frame, u, v, depth, seen) and less certain than it: their confidence falls to `bad`. One pass over the given confidences."""
    hidden = (F.col("z") > 0) & (F.col("z") < (1 - tolerance) * F.col("depth")) & (F.col("conf") < F.col("seen"))
    return points.join(depths, ["frame", "u", "v"], "left").withColumn("cleaned", F.when(hidden, F.least("conf", F.lit(bad))).otherwise(F.col("conf"))).drop("depth", "seen")


def bridges(edges: DataFrame, group: DataFrame, most: int) -> DataFrame:
    """The `most` frames outside a group (node) with the best mean score to it."""
    inside = group.select(F.col("node").alias("dst"))
    outside = edges.join(inside, "dst").join(group.select(F.col("node").alias("src")), "src", "left_anti").groupBy(F.col("src").alias("node")).agg(F.avg("score").alias("affinity"))
    return outside.orderBy(F.desc("affinity"), "node").limit(most)


def aligned_losses(df: DataFrame, p: Column, y: Column, by: list[str], beta: float = 1.0) -> DataFrame:
    """Mean binary cross-entropy and smooth L1 distance of p to y."""
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    d = F.abs(p - y)
    return df.groupBy(*by).agg(F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("bce"), F.avg(F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)).alias("smooth_l1"))


def locally_numbered(df: DataFrame, by: list[str], order: list[str], name: str = "local") -> DataFrame:
    """Rows numbered from 0 within their group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def split_by_group(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Add split: `val` for about a share of the groups, by an arithmetic hash of the group's number; a group is never divided."""
    mixed = F.pmod(F.col(group) * 2654435761 + seed, F.lit(4294967296))
    return df.withColumn("split", F.when(mixed < int(share * 4294967296), "val").otherwise("train"))


def rescaled_camera(params: list[Column], real: list[Column], width: Column, height: Column) -> list[Column]:
    """Focal lengths of a camera of a padded image for the real size, the principal point in the middle."""
    ratio = F.greatest(*real) / F.greatest(width, height)
    return [*[p * ratio for p in params], real[0] / 2, real[1] / 2]


def located(items: DataFrame, queries: DataFrame, group: str, order: str, index: str) -> DataFrame:
    """Queries by a place in all groups' items, one group after the other: with the group and the place within it."""
    placed = numbered(items.select(group, order), [F.col(group), F.col(order)], "_place")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    return queries.join(placed.select("_place", group), F.col(index) == F.col("_place")).join(first, group).withColumn("local", F.col("_place") - F.col("_first")).drop("_place", "_first")


def consolidated_pairs(images: DataFrame, pairs: DataFrame, scene: str, image: str) -> DataFrame:
    """Pairs (scene, src, dst) of images numbered within their scene, by numbers over all scenes in order."""
    placed = numbered(images.select(scene, image), [F.col(scene), F.col(image)], "_place")
    side = lambda c, n: placed.select(scene, F.col(image).alias(c), F.col("_place").alias(n))
    return pairs.join(side("src", "first"), [scene, "src"]).join(side("dst", "second"), [scene, "dst"]).select(scene, "first", "second")


def centred(df: DataFrame, coords: list[str]) -> DataFrame:
    """Coordinates less their mean over all rows, which is one row."""
    mean = df.agg(*[F.avg(c).alias(f"_{c}") for c in coords])
    return df.crossJoin(F.broadcast(mean)).withColumns({c: F.col(c) - F.col(f"_{c}") for c in coords}).drop(*[f"_{c}" for c in coords])
