"""Byte-balanced sharding by histogram sort, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import count_at_or_below, materialize, table

LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Span:
    """Keys still searched for a splitter: hashes lo..hi, or ids lo..hi within one hash."""

    hash: int | None
    lo: int
    hi: int

    def shift(self, probes: int) -> int:
        """The finest cut into at most `probes` equal bins."""
        s = 0
        while (self.hi >> s) - (self.lo >> s) >= probes:
            s += 1
        return s

    def holds(self) -> Column:
        if self.hash is None:
            return F.col("k").between(self.lo, self.hi)
        return (F.col("k") == self.hash) & F.col("d").between(self.lo, self.hi)

    def edge(self, place: int) -> tuple[int, int]:
        """The smallest key (hash, id) at or above a place of this span."""
        if self.hash is None:
            return (place, LOW) if place <= HIGH else (HIGH, HIGH)
        return (self.hash, place) if place <= HIGH else (self.hash + 1, LOW)


def _histogram(keys: DataFrame, spans: list[Span], probes: int) -> dict[int, list]:
    """Exact bytes in each bin of each span: at most len(spans) * probes rows."""
    which = F.lit(None).cast("int")
    place = F.lit(None).cast("long")
    for i, span in reversed(list(enumerate(spans))):
        digits = F.shiftright("k" if span.hash is None else "d", span.shift(probes))
        which = F.when(span.holds(), F.lit(i)).otherwise(which)
        place = F.when(span.holds(), digits).otherwise(place)
    rows = (
        keys.select(which.alias("span"), place.alias("bin"), "k", "d", "size")
        .where("span IS NOT NULL")
        .groupBy("span", "bin")
        .agg(F.sum("size").alias("bytes"), *[f(c).alias(f"{c}_{f.__name__}") for c in "kd" for f in (F.min, F.max)])
        .collect()
    )
    out: dict[int, list] = {i: [] for i in range(len(spans))}
    for r in rows:
        out[r.span].append(r)
    return {i: sorted(v, key=lambda r: r.bin) for i, v in out.items()}


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.0005, probes: int = 1024) -> list[tuple[int, int]]:
    """Keys (hash, id) that cut the bytes of `keys` (k, d, size) into n_shards equal parts.

    Every round counts the exact bytes below `probes` candidate boundaries in
    each span that still holds an unsettled splitter and keeps the bin that the
    target falls in. A splitter is settled once it lies within `tolerance` of a
    shard's bytes from its target, or when its bin is a single key.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    allowed = tolerance * total / n_shards
    open_: dict[int, tuple[Span, int]] = {j: (Span(None, LOW, HIGH), 0) for j in range(1, n_shards)}
    found: dict[int, tuple[int, int]] = {}
    while open_:
        spans = list(dict.fromkeys(span for span, _ in open_.values()))
        histogram = _histogram(keys, spans, probes)
        left: dict[int, tuple[Span, int]] = {}
        for j, (span, below) in open_.items():
            target, s = total * j / n_shards, span.shift(probes)
            for r in histogram[spans.index(span)]:
                if below + r.bytes < target:
                    below += r.bytes
                    continue
                start, end = span.edge(r.bin << s), span.edge((r.bin + 1) << s)
                under, over = target - below, below + r.bytes - target
                one_hash = r.k_min == r.k_max
                if min(under, over) <= allowed or (one_hash and r.d_min == r.d_max):
                    found[j] = start if under <= over else end
                else:
                    left[j] = (Span(r.k_min, r.d_min, r.d_max) if one_hash else Span(None, r.k_min, r.k_max), below)
                break
        open_ = left
    return [found[j] for j in sorted(found)]


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0005, probes: int = 1024) -> DataFrame:
    """Place every row in one of n_shards shards whose UTF-8 bytes are nearly equal.

    Rows are ordered by (hash of the text, id), so equal texts lie side by side
    and a group is cut only where a shard must end; a group of any size can be
    cut between its ids. Size is the text's bytes plus 16. The splitters settle
    each row's shard, and one exchange by them sends it there: a shard's keys
    (not its texts) are sorted by one task, which spills where they are many.

    Returns id, size, text_crc32, shard, slot (place in the shard, gapless from
    0). Null and empty texts are one group of 16 bytes a row; null ids come
    first in their group; rows equal in text and id stay together, in adjacent
    slots; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = materialize(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("k"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)).alias("d"),
        )
    )
    cuts = splitters(keys, n_shards, tolerance, probes)
    bounds = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(d).cast("long").alias("d")) for k, d in cuts])
    placed = materialize(
        keys.withColumn("shard", count_at_or_below(bounds, len(cuts), F.struct("k", "d")).cast("int"))
        .repartitionById(n_shards, "shard")
        .sortWithinPartitions("k", "d", "text_crc32")
        # A partition is a shard: the low bits are the row's place in it.
        .withColumn("slot", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op3_histogram_sort(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op3_histogram_sort": op3_histogram_sort}
