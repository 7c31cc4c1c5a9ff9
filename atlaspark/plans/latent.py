"""Queries of the vector map and of image parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images, latent
from ..sources import tables as T
from .storage import materialize

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    """Register a query under its function's name, with the SQL that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SIZE, RADIUS, TAU, MOST = 0.5, 0.5, 0.7, 6
W = latent.LatentWeights(
    gate=[[0.4, -0.2, 0.1, 0.3, 0.2, -0.1], [0.1, 0.5, -0.3, -0.2, 0.4, 0.2], [-0.1, 0.2, 0.6, 0.1, -0.3, 0.5]],
    gate_bias=[0.1, -0.2, 0.05],
    message={"reset": [[0.2, 0.1, 0.0], [0.0, 0.3, 0.1], [0.1, 0.0, 0.2]], "keep": [[-0.3, 0.2, 0.1], [0.1, -0.2, 0.3], [0.2, 0.1, -0.1]], "new": [[0.7, 0.1, -0.2], [0.2, 0.6, 0.1], [-0.1, 0.2, 0.8]]},
    state={"reset": [[0.1, -0.1, 0.2], [0.2, 0.1, -0.2], [0.0, 0.1, 0.3]], "keep": [[0.5, 0.0, 0.1], [0.1, 0.4, 0.0], [0.0, 0.2, 0.6]], "new": [[0.3, -0.2, 0.1], [0.1, 0.2, 0.2], [0.2, 0.1, -0.3]]},
    message_bias={"reset": [0.1, 0.0, -0.1], "keep": [0.2, 0.1, 0.0], "new": [0.0, 0.1, 0.2]},
    state_bias={"reset": [0.0, 0.1, 0.1], "keep": [-0.1, 0.0, 0.1], "new": [0.1, 0.0, 0.0]},
    offset=(0.3, -0.2, 0.5), bias=0.1, temperature=1.5,
)


def _list(x) -> str:
    return "[" + ", ".join(_list(v) if isinstance(v, (list, tuple)) else f"{v}::DOUBLE" for v in x) + "]"


def _mul(rows, x: str) -> str:
    return f"list_transform({_list(rows)}, lambda r: list_inner_product(r, {x}))"


def _add(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] + p[2])"


def _sig(a: str) -> str:
    return f"list_transform({a}, lambda q: 1 / (1 + exp(-q)))"


def _gate(g: str) -> str:
    return _sig(_add(_add(_mul(W.message[g], "x"), _list(W.message_bias[g])), _add(_mul(W.state[g], "z"), _list(W.state_bias[g]))))


LATENT_SQL = f"""WITH {T.V_POINTS}, p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, epoch, x, y, z, [conf / 8, z * 5, x / 5] AS f FROM v_points),
v AS (SELECT CAST(floor(x / {SIZE}) AS BIGINT) AS i, CAST(floor(y / {SIZE}) AS BIGINT) AS j, CAST(floor(z / {SIZE}) AS BIGINT) AS k, avg(f[1]) AS a, avg(f[2]) AS b, avg(f[3]) AS c FROM p WHERE epoch <= 3 GROUP BY ALL),
s AS (SELECT i * 1000000 + j * 1000 + k AS key, (i + 0.5::DOUBLE) * {SIZE} AS cx, (j + 0.5::DOUBLE) * {SIZE} AS cy, (k + 0.5::DOUBLE) * {SIZE} AS cz, [a, b, c] AS z FROM v),
o AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS point FROM p),
n AS (SELECT o.point, o.f, s.key, s.z AS zl, o.x - s.cx AS dx, o.y - s.cy AS dy, o.z - s.cz AS dz FROM o JOIN s ON s.cx BETWEEN o.x - {RADIUS} - 0.01 AND o.x + {RADIUS} + 0.01 AND s.cy BETWEEN o.y - {RADIUS} - 0.01 AND o.y + {RADIUS} + 0.01),
m AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM n WHERE dx * dx + dy * dy + dz * dz <= {RADIUS * RADIUS} QUALIFY row_number() OVER (PARTITION BY point ORDER BY dx * dx + dy * dy + dz * dz, key) <= {MOST}),
e AS (SELECT *, {W.temperature} * (list_inner_product(f, zl) / ((sqrt(list_inner_product(f, f)) + 1e-6) * (sqrt(list_inner_product(zl, zl)) + 1e-6)) + {W.offset[0]} * dx + {W.offset[1]} * dy + {W.offset[2]} * dz + {W.bias}) AS sim FROM m),
w AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY point)) / {TAU}) AS ex FROM e),
u AS (SELECT key, [sum(wt * f[1]), sum(wt * f[2]), sum(wt * f[3])] AS u FROM (SELECT *, ex / (sum(ex) OVER (PARTITION BY point) + 1e-8) AS wt FROM w) GROUP BY key),
g AS (SELECT s.key, s.z, u.u, {_sig(_add(_mul(W.gate, "list_concat(u.u, s.z)"), _list(W.gate_bias)))} AS gate FROM s LEFT JOIN u ON u.key = s.key),
t AS (SELECT key, z, u, list_transform(list_zip(u, gate), lambda p: p[1] * p[2]) AS x FROM g),
c AS (SELECT key, z, u, {_gate("keep")} AS keep, list_transform(list_zip({_add(_mul(W.message["new"], "x"), _list(W.message_bias["new"]))}, {_gate("reset")}, {_add(_mul(W.state["new"], "z"), _list(W.state_bias["new"]))}), lambda p: tanh(p[1] + p[2] * p[3])) AS new FROM t),
r AS (SELECT key, CASE WHEN u IS NULL THEN z ELSE list_transform(list_zip(keep, new, z), lambda p: (1 - p[1]) * p[2] + p[1] * p[3]) END AS z FROM c)
SELECT key, round(z[1], 5) AS z0, round(z[2], 5) AS z1, round(z[3], 5) AS z2 FROM r"""


@query(LATENT_SQL)
def latent_update(spark, d):
    """Vectors of the voxels of the first epochs after all points have sent them theirs."""
    p = T.points(spark, d).withColumn("f", F.array(F.col("conf") / 8, F.col("z") * 5, F.col("x") / 5))
    cell = [F.floor(F.col(c) / SIZE).cast("long").alias(k) for c, k in zip("xyz", "ijk", strict=True)]
    mean = F.array(*[F.avg(F.get("f", F.lit(i))) for i in range(3)])
    voxels = p.where("epoch <= 3").select(*cell, "f").groupBy("i", "j", "k").agg(mean.alias("z_latent"))
    state = voxels.select((F.col("i") * 1000000 + F.col("j") * 1000 + F.col("k")).alias("key"), *[((F.col(k) + 0.5) * SIZE).alias(f"c{c}") for c, k in zip("xyz", "ijk", strict=True)], "z_latent")
    new = latent.update(p.select("x", "y", "z", "f"), materialize(state), W, 3, RADIUS, TAU, MOST)
    return new.select("key", *[F.round(F.get("z_latent", F.lit(i)), 5).alias(f"z{i}") for i in range(3)])


@query(f"""WITH RECURSIVE {T.V_CELLS}, m AS (SELECT DISTINCT frame_id AS image, i AS v, j AS u FROM v_cells WHERE tax >= 0.08 AND k = 5),
r AS (SELECT image, v, u, v AS sv, u AS su FROM m UNION SELECT m.image, m.v, m.u, r.sv, r.su FROM r JOIN m ON m.image = r.image AND abs(m.v - r.v) <= 1 AND abs(m.u - r.u) <= 1),
p AS (SELECT image, v, u, min(sv * 2147483648 + su) AS part FROM r GROUP BY ALL), s AS (SELECT image, part, count(*) AS size FROM p GROUP BY ALL)
SELECT image, part, size FROM s QUALIFY size > max(size) OVER (PARTITION BY image) * 0.5""")
def image_parts(spark, d):
    """The large connected parts of each frame's mask of certain cells."""
    mask = T.cells(spark, d).where("tax >= 0.08 AND k = 5").select(F.col("frame_id").alias("image"), F.col("i").alias("v"), F.col("j").alias("u"))
    parts = images.connected_parts(mask, tile=8)
    return images.large_parts(parts).select(F.col("image").cast("int").alias("image"), "part", "size")
