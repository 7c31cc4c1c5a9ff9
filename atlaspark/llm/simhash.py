"""Near-duplicates by SimHash: exact tiled comparison of distinct fingerprints, and an exact check of shingle sets where asked for."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .graph import components

CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle of a text, A-Z lower-cased, in arrays of up to CHUNK."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(joined[s:e], seed) for s, e in spans], np.uint64)


def more_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of a shingle: its XXH64 for k = 0, else that one stirred by the k-th step of a fixed sequence."""
    if not k:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(hashes: Iterable[np.ndarray], size: int) -> np.ndarray:
    """size words of 64 bits: a bit is 1 if more than half of the hashes have it; 0 without hashes."""
    ones, n = np.zeros((size, 64), np.int64), 0
    for h in hashes:
        for k in range(size):
            bits = np.unpackbits(more_hashes(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: str | None, words: int = 3, seed: int = 42, size: int = 1) -> np.ndarray:
    """The majority of all shingles of a text, repeats included."""
    return majority(shingle_hashes(text, words, seed), size)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64) -> DataFrame:
    """(id, w0[, w1]): a fingerprint of 64 bits for each word column, signed."""
    size = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            out = np.empty((size, batch.num_rows), np.uint64)
            for i, text in enumerate(texts):
                out[:, i] = fingerprint(text.as_py(), words, size=size)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x.view(np.int64)) for x in out]], names=["id", *[f"w{k}" for k in range(size)]])

    schema = "id long, " + ", ".join(f"w{k} long" for k in range(size))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _parts(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) for the links u to v, nodes that are smallest left out."""
    nodes, place = np.unique(np.concatenate((u, v)), return_inverse=True)
    u, v = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[u], label[v]), label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if np.array_equal(new, label):
            moved = label != np.arange(len(nodes))
            return nodes[moved], nodes[label[moved]]
        label = new


def near(a: np.ndarray, b: np.ndarray, radius: int, block_pairs: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows r of a and c of b whose fingerprints (a column for each 64 bits) differ in at most radius bits, and by how many, in blocks."""
    left, right = ([np.ascontiguousarray(w) for w in x.T] for x in (a, b))
    block, kind = max(1, block_pairs // max(1, len(b))), np.uint8 if len(left) < 4 else np.uint16
    for at in range(0, len(a), block):
        far = np.zeros((len(left[0][at : at + block]), len(b)), kind)
        for u, v in zip(left, right, strict=True):
            far += np.bitwise_count(u[at : at + block, None] ^ v[None])
        r, c = np.nonzero(far <= min(radius, 64 * len(left)))
        yield at + r, c, far[r, c]


def local_links(
    a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, radius: int, block_pairs: int = 1 << 16, may: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within radius between two tiles (a row for each fingerprint), of rows that `may` link if given.

    As many links as joined nodes at most, however many pairs lie within the radius.
    """
    us, vs = [ids_a[:0]], [ids_a[:0]]
    for r, c, _ in near(a, b, radius, block_pairs):
        if may is not None and len(r):
            both = may(r, c)
            r, c = r[both], c[both]
        if len(r):
            u, v = _parts(ids_a[r], ids_b[c])
            us.append(u)
            vs.append(v)
    return _parts(np.concatenate(us), np.concatenate(vs))


def _cell(words: int, radius: int) -> tuple[list[Column], int]:
    """Population counts by which fingerprints are tiled, and how many differences of a count make one cell.

    For a small radius the counts of each quarter of the word, else the count of all bits, a quarter of the radius to a cell.
    """
    if words == 1 and radius <= 4:
        return [F.bit_count(F.shiftrightunsigned("w0", 16 * q).bitwiseAND(0xFFFF)) for q in range(4)], 1
    total = F.bit_count("w0")
    for w in range(1, words):
        total = total + F.bit_count(f"w{w}")
    width = max(1, radius // 4)
    return [F.floor(total / width)], width


def _steps(counts: int, radius: int, width: int) -> list[int]:
    """Differences of packed cells that fingerprints within the radius can have, one of each opposite pair."""
    found, reach = [], -(-radius // width)
    for step in itertools.product(range(-reach, reach + 1), repeat=counts):
        if sum(map(abs, step)) <= reach:
            packed = sum(x << (8 * i) for i, x in enumerate(step))
            if packed >= 0:
                found.append(packed)
    return found


#: Columns of sketches(): how many shingles fall into each of 16 parts of the hashes, a byte each, 255 for more.
COUNTS = ["c0", "c1"]


def may_share(sizes_a: np.ndarray, counts_a: np.ndarray, sizes_b: np.ndarray, counts_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two different sets can share `similarity` of their union; no for none that do.

    What their counts of any part differ by is in one of them only, and that is (1 - s) / (1 + s) of both sizes at most;
    different sets have one such shingle at least, those of one size two.
    """
    apart = np.maximum(np.abs(counts_a.astype(np.int16) - counts_b).sum(axis=1), 2 - (sizes_a + sizes_b) % 2)
    fits = np.minimum(sizes_a, sizes_b) >= similarity * np.maximum(sizes_a, sizes_b) - 1e-6
    return fits & (apart * (1 + similarity) <= (1 - similarity) * (sizes_a + sizes_b) + 1e-6)


#: Tiles into which sketches are dealt at least; a tile grows with the table until it has MOST_ROWS, so that tiles are sent in proportion to the rows.
TILES, MOST_ROWS = 200, 1 << 16


def links(distinct: DataFrame, words: int, radius: int, tile_rows: int, similarity: float | None = None) -> DataFrame:
    """Links (u, v) that connect all of `distinct` (node, w0..) whose fingerprints differ in at most `radius` bits.

    Fingerprints with the same population counts make a cell, dealt by hash into
    tiles of about tile_rows. A tile is compared with those of its own cell and
    of the cells whose counts differ by no more than the radius: what two
    fingerprints' counts differ by, their bits do too, so no other tile can hold
    a link. With `similarity` (and columns size and COUNTS) only pairs that can
    share so much are linked, and cells are made by size instead: four cells
    reach as far as sizes of such pairs do.
    """
    names = [f"w{w}" for w in range(words)]
    if similarity is None:
        counts, width = _cell(words, radius)
        packed = counts[0].cast("int")
        for i, c in enumerate(counts[1:], 1):
            packed = packed + F.shiftleft(c.cast("int"), 8 * i)
        columns, steps = names, _steps(len(counts), radius, width)
    else:
        # A little wider than a quarter, so that no rounding carries a pair over five cells.
        packed = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / (-math.log(similarity) / 4 * (1 + 1e-9))).cast("int")
        columns, steps = [*names, "size", *COUNTS], range(5)
        tile_rows = max(tile_rows, min(MOST_ROWS, -(-distinct.count() // TILES)))
    rows = distinct.where("node IS NOT NULL").select("node", *columns, packed.alias("cell"))
    # A row for each cell there can be: 17 ** 4 at most.
    sizes = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("n")))
    tiles = materialize(
        rows.join(sizes, "cell")
        .withColumn("sub", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .groupBy("cell", "sub")
        .agg(F.collect_list("node").alias("node"), *[F.collect_list(w).alias(w) for w in columns])
    )
    left = tiles.select(F.col("cell").alias("cell_a"), F.col("sub").alias("sub_a"), F.col("node").alias("node_a"), *[F.col(w).alias(f"{w}_a") for w in columns], F.explode(F.array(*[F.lit(s) for s in steps])).alias("step"))
    known = left.withColumn("cell", F.col("cell_a") + F.col("step")).join(sizes, "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = known.where("step > 0 OR sub_a <= sub").join(tiles, ["cell", "sub"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
                a, b = (np.stack([get(f"{w}{side}").view(np.uint64) for w in names], axis=1) for side in ("_a", ""))
                may = None
                if similarity is not None:
                    (m, x), (n, y) = ((get(f"size{side}"), np.stack([get(f"{c}{side}") for c in COUNTS], axis=1).view(np.uint8)) for side in ("_a", ""))
                    may = lambda r, c, m=m, x=x, n=n, y=y: may_share(m[r], x[r], n[c], y[c], similarity)
                u, v = local_links(a, b, get("node_a"), get("node"), radius, may=may)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return pairs.select("node_a", *[f"{w}_a" for w in columns], "node", *columns).mapInArrow(compare, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64, radius: int = 2, tile_rows: int = 2048) -> DataFrame:
    """Group documents linked by fingerprints that differ in at most `radius` bits.

    Returns id, fingerprint (hex digits of `bits` bits) and component_id, the
    smallest id reachable over links, itself included. Documents with one
    fingerprint count as one node, so that copies never make pairs. Null and
    empty texts have fingerprint zero and are linked like any other; fewer
    words than a shingle make one shingle of them all; rows that repeat are
    each returned; a null id has no component of its own and takes the one of
    its fingerprint; an empty table gives no rows; other columns are ignored.
    """
    names = [f"w{k}" for k in range(bits // 64)]
    prints = materialize(fingerprints(df, id_col, text_col, words, bits))
    distinct = materialize(prints.groupBy(*names).agg(F.min("id").alias("node")))
    found = components(links(distinct, len(names), radius, tile_rows))
    labels = distinct.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component_id"))
    return prints.join(labels, names, "left").select(
        F.col("id").alias(id_col),
        F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in names]).alias("fingerprint"),
        "component_id",
    )


def shingle_set(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """The distinct word shingles of a text as ascending hashes."""
    parts = list(shingle_hashes(text, words, seed))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def share(a: np.ndarray, b: np.ndarray) -> float:
    """What two sets share of their union; two empty ones: all."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def radius_of(similarity: float, bits: int) -> int:
    """Bits in which the fingerprints of two sets that share `similarity` of their union differ at most, but once in a million.

    A bit differs with the chance acos(2 s / (1 + s)) / pi for large sets and up
    to a quarter more for sets of a few shingles; five standard deviations are added.
    """
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(1.25 * chance * bits + 5 * math.sqrt(1.25 * chance * bits))


def sketches(df: DataFrame, words: int, bits: int) -> DataFrame:
    """(id, digest, key, size, w0.., c0, c1) of (id, text, digest): a digest of the distinct shingles, how many there are, their majority, and COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, out, counts = [], [], np.empty((bits // 64, batch.num_rows), np.uint64), np.empty((batch.num_rows, 16), np.uint8)
            for i, text in enumerate(batch.column("text")):
                h = shingle_set(text.as_py(), words)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                counts[i] = np.minimum(np.bincount((h >> np.uint64(60)).astype(np.int64), minlength=16), 255)
                out[:, i] = majority((h[at : at + CHUNK] for at in range(0, len(h), CHUNK)), bits // 64)
            columns = [batch.column("id"), batch.column("digest"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(x.view(np.int64)) for x in [*out, *np.ascontiguousarray(counts.view(np.int64).T)]]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "key", "size", *[f"w{k}" for k in range(bits // 64)], *COUNTS])

    return df.mapInArrow(run, "id long, digest binary, key binary, size long" + "".join(f", {c} long" for c in [*[f"w{k}" for k in range(bits // 64)], *COUNTS]))


def similar_links(prints: np.ndarray, sets: list[np.ndarray], first: int, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows that connect all of the first rows with the others (without others: with each other) that are within
    radius and share `similarity` or more; the nearest are tried first, and none that are connected already."""
    own = first == len(sets)
    parent = list(range(len(sets)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for r, c, far in near(prints[:first], prints if own else prints[first:], radius, 1 << 18):
        for k in np.argsort(far, kind="stable").tolist():
            i, j = int(r[k]), int(c[k]) + (0 if own else first)
            if i == j or own and i > j:
                continue
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= similarity * large - 1e-9 and (x := top(i)) != (y := top(j)) and share(sets[i], sets[j]) >= similarity - 1e-12:
                parent[max(x, y)] = min(x, y)
                found.append((i, j))
    return found


def checked(members: DataFrame, words: int, radius: int, similarity: float, tile_bytes: int = 4 << 20) -> DataFrame:
    """Links (u, v) that connect all of members (node, group, size, text, w0..) of one group that are within radius and share `similarity` or more.

    A group's sets are dealt by hash into tiles of about tile_bytes, and every
    two tiles of a group are compared; a tile is a row, so that no group of any
    size meets in one task.
    """
    names = [f"w{w}" for w in range(len([c for c in members.columns if c.startswith("w")]))]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                text = part.column("text")[0].as_py()
                yield part.drop_columns(["text"]).append_column("set", pa.array([shingle_set(text, words).tobytes()], pa.binary()))

    schema = "node long, group long, sub int, n int, " + "".join(f"{w} long, " for w in names) + "set binary"
    totals = members.groupBy("group").agg(F.ceil((F.sum("size") * 8 + 1) / tile_bytes).cast("int").alias("n"))
    dealt = members.join(totals, "group").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    packed = dealt.select("node", "group", "sub", "n", *names, "text").mapInArrow(sets, schema)
    tiles = materialize(packed.groupBy("group", "sub", "n").agg(F.collect_list(F.struct("node", *names, "set")).alias("rows")))
    none = F.slice("rows", 1, 0).alias("others")
    alone = tiles.select("rows", none)
    pairs = tiles.where("n > 1").select("group", F.col("sub").alias("a"), F.explode(F.sequence(F.col("sub"), F.col("n") - 1)).alias("b")).where("a < b")
    for side, name in (("a", "rows"), ("b", "others")):
        pairs = pairs.join(tiles.select("group", F.col("sub").alias(side), F.col("rows").alias(name)), ["group", side])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (batch.column(c)[i].values for c in ("rows", "others"))
                nodes = np.concatenate([x.field("node").to_numpy() for x in (left, right)])
                prints = np.stack([np.concatenate([x.field(w).to_numpy() for x in (left, right)]) for w in names], axis=1).view(np.uint64)
                found = similar_links(prints, [np.frombuffer(s.as_py(), np.uint64) for x in (left, right) for s in x.field("set")], len(left), radius, similarity)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[list(x)]) for x in zip(*found, strict=True)], names=["u", "v"])

    return alone.union(pairs.select("rows", "others")).mapInArrow(compare, "u long, v long")


def keep_one(df: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 256, tile_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest id, then digest of the text.

    Equal sets of distinct word shingles are one node. Nodes whose fingerprints
    differ in at most radius_of() bits, and whose sizes and counts by hash allow
    `similarity`, are found by tiles and joined to candidate groups; within these, nodes are linked if and only if they are so
    near and share `similarity` or more of their union, and documents are
    grouped over links. Null, empty and white texts are one group; a null id
    comes after all others; different texts with one id are different
    documents; of rows equal in id and text one stays, the first by a hash of
    all columns; an empty table gives no rows; other columns are kept as they
    are.
    """
    id_, text = F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    digest = F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))
    names, radius = [f"w{k}" for k in range(bits // 64)], radius_of(similarity, bits)
    prints = materialize(sketches(df.select(id_, text, digest.alias("digest")), words, bits))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    nodes = materialize(prints.groupBy("key", "size", *names, *COUNTS).agg(first).select("first.*", "size", *names, *COUNTS, F.monotonically_increasing_id().alias("node")))

    candidates = components(links(nodes, len(names), radius, tile_rows, similarity))
    groups = candidates.union(candidates.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "group")
    same = lambda left, right: left["id"].eqNullSafe(right["id"]) & left["digest"].eqNullSafe(right["digest"])
    wanted = nodes.drop(*COUNTS).join(groups, "node")
    texts = df.select(id_, digest.alias("digest"), text)
    found = texts.join(wanted, same(texts, wanted)).groupBy("node", "group", "size", *names).agg(F.first("text").alias("text"))
    parts = components(checked(found, words, radius, similarity))

    kept = nodes.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("part")).agg(F.min(F.struct("none", "id", "digest")).alias("first")).select("first.id", "first.digest")
    mine, own = F.col("own_").getField("id"), F.col("own_").getField("digest")
    out = df.withColumn("own_", F.struct(id_, digest.alias("digest")))
    out = out.join(kept.select(F.struct("id", "digest").alias("kept_")), (mine.eqNullSafe(F.col("kept_.id"))) & (own.eqNullSafe(F.col("kept_.digest"))), "left_semi")
    if prints.groupBy("id", "digest").count().where("count > 1").isEmpty():
        return out.select(df.columns)
    whole = F.struct(*df.columns)
    return out.groupBy("own_.id", "own_.digest").agg(F.min_by(whole, F.xxhash64(whole)).alias("row_")).select("row_.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
