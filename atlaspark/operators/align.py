"""Similarity and plane alignment: sums over the cluster, small matrices on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import is_finite, linear
from ..plans.storage import materialize
from .joins import nearest
from .windows import mixed

AXES = "xyz"


@dataclass(frozen=True)
class Similarity:
    """q = scale * R p + t."""

    scale: float
    rotation: np.ndarray
    shift: np.ndarray

    def apply(self, p: list[Column]) -> list[Column]:
        return linear(self.rotation.tolist(), p, self.shift.tolist(), self.scale)

    def after(self, first: Similarity) -> Similarity:
        return Similarity(self.scale * first.scale, self.rotation @ first.rotation, self.scale * self.rotation @ first.shift + self.shift)


def similarity(pairs: DataFrame, p: list[str], q: list[str], weight: Column | None = None, with_scale: bool = True, transposed: bool = False) -> Similarity:
    """The least-squares similarity that takes p to q, from one pass of sums over the pairs.

    transposed returns the rotation the other way round, as some tools do.
    """
    w = F.lit(1.0) if weight is None else weight
    terms = {"w": w, "pp": w * sum((F.col(c) * F.col(c) for c in p), F.lit(0.0))}
    terms |= {f"p{i}": w * F.col(c) for i, c in enumerate(p)} | {f"q{i}": w * F.col(c) for i, c in enumerate(q)}
    terms |= {f"c{i}{j}": w * F.col(a) * F.col(b) for i, a in enumerate(q) for j, b in enumerate(p)}
    s = pairs.agg(*[F.sum(c).alias(n) for n, c in terms.items()]).first()
    if not s.w:
        raise ValueError("no pairs to align")
    mp, mq = (np.array([s[f"{k}{i}"] for i in range(3)]) / s.w for k in "pq")
    cross = np.array([[s[f"c{i}{j}"] for j in range(3)] for i in range(3)]) / s.w - np.outer(mq, mp)
    u, d, vt = np.linalg.svd(cross)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = u @ flip @ vt
    spread = s.pp / s.w - mp @ mp
    scale = float((d * np.diag(flip)).sum() / spread) if with_scale and spread > 0 else 1.0
    rotation = rotation.T if transposed else rotation
    return Similarity(scale, rotation, mq - scale * rotation @ mp)


def spacing(poses: DataFrame, centre: list[str], pose_id: str = "pose_id", sample: int = 2000) -> float | None:
    """The median distance of two centres, over all pairs of up to `sample` poses (the first by hash, so always the same); null below two poses."""
    few = poses.select(pose_id, *[F.col(c).cast("double").alias(f"_{c}") for c in centre]).orderBy(F.xxhash64(pose_id), pose_id).limit(sample)
    a, b = few.alias("a"), F.broadcast(few.alias("b"))  # `sample` rows
    d = F.sqrt(sum(((F.col(f"a._{c}") - F.col(f"b._{c}")) ** 2 for c in centre), F.lit(0.0)))
    return a.join(b, F.col(f"a.{pose_id}") < F.col(f"b.{pose_id}")).agg(F.percentile(d, F.lit(0.5))).first()[0]


def pose_sets(source: DataFrame, target: DataFrame, pose_id: str = "pose_id", centre: tuple[str, ...] = ("x", "y", "z"), axis: tuple[str, ...] = ("zx", "zy", "zz")) -> Similarity:
    """The similarity that takes one set of poses to another of the same ids: over their centres and a point along each one's axis.

    The points lie a hundredth of the set's own median spacing ahead, so that
    axes only decide what centres leave open. One pose, or poses all in one
    place, have no spacing: their points lie one ahead, the turn comes from the
    axes, and the scale is 1. Poses that only one set has, and those with a null
    or non-finite number, take no part.
    """
    columns = [*centre, *axis]
    known = lambda df: df.select(pose_id, *[F.col(c).cast("double") for c in columns]).where(is_finite(*columns))
    both = known(source).join(known(target).toDF(pose_id, *[f"t_{c}" for c in columns]), pose_id)
    both = materialize(both)
    ahead = [spacing(both, [f"{p}{c}" for c in centre], pose_id) for p in ("", "t_")]
    flat = any(not d for d in ahead)
    steps = [1.0 if flat else d / 100 for d in ahead]
    at = lambda p, k: [F.col(f"{p}{c}") + k * F.col(f"{p}{a}") for c, a in zip(centre, axis, strict=True)]
    names = [*[f"_p{i}" for i in range(3)], *[f"_q{i}" for i in range(3)]]
    rows = [both.select(*[c.alias(n) for n, c in zip(names, [*at("", k * steps[0]), *at("t_", k * steps[1])], strict=True)]) for k in (0.0, 1.0)]
    return similarity(rows[0].unionByName(rows[1]), names[:3], names[3:], with_scale=not flat)


def icp(cloud: DataFrame, target: DataFrame, radius: float, size: float, rounds: int = 10, best: float = 1.0, tolerance: float = 1e-6, huber: float | None = None, conf: str | None = None) -> Similarity:
    """Align cloud (p, x, y, z) to target (q, qx, qy, qz): nearest pairs within the radius, the best share of them, again and again.

    With huber, pairs further apart than that weigh less, by huber / distance;
    with conf, a column of cloud, each pair weighs by its point's confidence
    (null, NaN and negative ones: 0). Stops when the root mean square distance
    settles or fewer than three pairs with any weight are left.
    """
    now, last = Similarity(1.0, np.eye(3), np.zeros(3)), np.inf
    own = F.lit(1.0) if conf is None else F.coalesce(F.greatest(F.when(~F.isnan(F.col(conf).cast("double")), F.col(conf).cast("double")), F.lit(0.0)), F.lit(0.0))
    source = materialize(cloud.select("p", *[F.col(a).alias(f"o{a}") for a in AXES], own.alias("_w")).where("_w > 0"))
    weight = F.col("_w") if huber is None else F.col("_w") * F.least(F.lit(1.0), huber / F.greatest(F.sqrt("d2"), F.lit(1e-300)))
    target = materialize(target)
    for _ in range(rounds):
        moved = source.select("p", *[c.alias(f"p{a}") for a, c in zip(AXES, now.apply([F.col(f"o{a}") for a in AXES]), strict=True)])
        pairs = nearest(moved, target, "p", "q", [f"p{a}" for a in AXES], [f"q{a}" for a in AXES], size).where(F.col("d2") <= radius * radius)
        cut = pairs.agg(F.percentile("d2", F.lit(best)).alias("c")).first().c if best < 1 else None
        pairs = materialize((pairs if cut is None else pairs.where(F.col("d2") <= cut)).join(source, "p").join(target, "q"))
        s = pairs.agg(F.count("*").alias("n"), F.sqrt(F.avg("d2")).alias("rms")).first()
        if s.n < 3 or abs(last - s.rms) < tolerance:
            break
        now, last = similarity(pairs, [f"o{a}" for a in AXES], [f"q{a}" for a in AXES], weight), s.rms
    return now


def floor_plane(points: DataFrame, id_col: str, distance: float, share: float = 0.3, triples: int = 200, upright: float = 0.8, seed: int = 7) -> tuple[np.ndarray, float]:
    """(unit normal with z >= 0, offset) of the plane n.x = offset that most low points lie near.

    The low points are the lowest share by z. Candidate planes come from a
    fixed number of hash-chosen triples; each point is counted for every
    candidate in one pass, and the winner is fitted again to its points.
    """
    cut = points.agg(F.percentile("z", F.lit(share)).alias("c")).first().c
    if cut is None:
        raise ValueError("no points")
    low = points.where(F.col("z") <= cut)
    chosen = low.orderBy(mixed(F.col(id_col), seed), id_col).limit(3 * triples).select(*AXES).collect()
    planes = []
    for a, b, c in zip(chosen[::3], chosen[1::3], chosen[2::3], strict=False):
        a, b, c = (np.array(tuple(r), float) for r in (a, b, c))
        n = np.cross(b - a, c - a)
        if (length := np.linalg.norm(n)) > 1e-12 and abs(n[2]) >= upright * length:
            n = n / length * np.sign(n[2])
            planes.append((*n.tolist(), float(n @ a)))
    if not planes:
        raise ValueError("no upright plane")
    candidates = F.array(*[F.struct(F.lit(i).alias("id"), *[F.lit(v).alias(k) for k, v in zip("abcd", p, strict=True)]) for i, p in enumerate(planes)])
    near = low.select(*AXES, F.explode(candidates).alias("n"))
    off = F.abs(F.col("n.a") * F.col("x") + F.col("n.b") * F.col("y") + F.col("n.c") * F.col("z") - F.col("n.d"))
    best = near.where(off < distance).groupBy("n.id").count().orderBy(F.desc("count"), "id").first()
    a, b, c, d = planes[best.id if best else 0]
    inside = low.where(F.abs(F.lit(a) * F.col("x") + F.lit(b) * F.col("y") + F.lit(c) * F.col("z") - F.lit(d)) < distance)
    s = inside.agg(F.count("*").alias("n"), *[F.avg(u).alias(u) for u in AXES], *[F.avg(F.col(u) * F.col(v)).alias(u + v) for u in AXES for v in AXES]).first()
    if s.n < 3:
        return np.array([a, b, c]), d
    mean = np.array([s[u] for u in AXES])
    cov = np.array([[s[u + v] for v in AXES] for u in AXES]) - np.outer(mean, mean)
    n = np.linalg.eigh(cov)[1][:, 0]
    n = n * (np.sign(n[2]) or 1.0)
    return n, float(n @ mean)


def upright_rotation(normal: np.ndarray) -> np.ndarray:
    """The smallest rotation that turns a normal to +z."""
    v, c = np.cross(normal, [0.0, 0.0, 1.0]), float(normal[2])
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c) if c > -1 + 1e-12 else np.diag([1.0, -1.0, -1.0])
