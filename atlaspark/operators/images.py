"""Connected parts of image masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .graph import components


def _tile_labels(rows: pd.DataFrame, diagonal: bool) -> pd.DataFrame:
    """Each pixel of a tile with the first pixel of its part there: runs of a row are joined with runs of the row before that they touch."""
    rows = rows.drop_duplicates(["v", "u"]).sort_values(["v", "u"], ignore_index=True)
    v, u = rows.v.to_numpy(), rows.u.to_numpy()
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (u[1:] != u[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    up = list(range(len(first)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    reach, above = int(diagonal), 0
    for i in range(len(first)):
        while above < i and (v[first[above]] < v[first[i]] - 1 or v[first[above]] == v[first[i]] - 1 and u[last[above]] < u[first[i]] - reach):
            above += 1
        j = above
        while j < i and v[first[j]] == v[first[i]] - 1 and u[first[j]] <= u[last[i]] + reach:
            a, b = sorted((top(i), top(j)))
            up[b] = a
            j += 1
    own = np.array([first[top(i)] for i in range(len(first))])[np.cumsum(new) - 1]
    return rows.assign(lv=v[own], lu=u[own])


def connected_parts(mask: DataFrame, image: str = "image", tile: int = 64, diagonal: bool = True) -> DataFrame:
    """(image, v, u, part): pixels of masks, each with the number of its connected part: that of its first pixel, v * 2^31 + u.

    Tiles are labelled alone, by runs; parts that touch across a tile's border
    are links between labels, and only labels at borders go into the graph of
    links. v and u are from 0 to 2^31 - 1; null ones take no part, pixels that
    repeat count once.
    """
    rows = mask.select(F.col(image).cast("string").alias("image"), F.col("v").cast("long"), F.col("u").cast("long")).where("v IS NOT NULL AND u IS NOT NULL")
    tiled = rows.withColumn("tv", F.floor(F.col("v") / tile)).withColumn("tu", F.floor(F.col("u") / tile))
    schema = "image string, v long, u long, tv long, tu long, lv long, lu long"
    label = F.col("lv") * (1 << 31) + F.col("lu")
    labelled = materialize(tiled.groupBy("image", "tv", "tu").applyInPandas(lambda part: _tile_labels(part, diagonal), schema).select("image", "v", "u", "tv", "tu", label.alias("label")))
    at_border = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    border = labelled.where(at_border("v") | at_border("u"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dv"), F.lit(b).alias("du")) for a, b in steps]))
    beside = border.select("image", F.col("tv").alias("sv"), F.col("tu").alias("su"), F.col("label").alias("src"), "v", "u", around.alias("s")).select("image", "sv", "su", "src", (F.col("v") + F.col("s.dv")).alias("v"), (F.col("u") + F.col("s.du")).alias("u"))
    touching = beside.join(border, ["image", "v", "u"]).where("sv <> tv OR su <> tu").select("image", "src", F.col("label").alias("dst")).distinct()
    name = lambda c: F.concat_ws("/", F.lpad(F.col(c).cast("string"), 20, "0"), F.hex("image"))
    links = materialize(touching.select(name("src").alias("src"), name("dst").alias("dst")))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    joined = components(nodes, links).select("node", F.split("component", "/")[0].cast("long").alias("_part"))
    return labelled.withColumn("node", name("label")).join(joined, "node", "left").select(F.col("image").alias(image), "v", "u", F.coalesce("_part", "label").alias("part"))


def large_parts(parts: DataFrame, image: str = "image", share: float = 0.5) -> DataFrame:
    """(image, part, size) of the parts with more than `share` of the pixels of their image's largest."""
    sizes = parts.groupBy(image, "part").agg(F.count("*").alias("size"))
    most = sizes.groupBy(image).agg(F.max("size").alias("_most"))
    return sizes.join(most, image).where(F.col("size") > F.col("_most") * share).drop("_most")
