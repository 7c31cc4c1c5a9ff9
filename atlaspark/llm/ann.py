"""Approximate nearest neighbours by additive quantisation and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table


class Quantiser:
    """Full-dimensional codebooks whose chosen codewords add up to a vector's direction."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.norms = (self.books * self.books).sum(axis=2)

    @classmethod
    def train(cls, x: np.ndarray, books: int, words: int, rounds: int = 8, seed: int = 7) -> Quantiser:
        """Codebooks by k-means on what the ones before leave over, for directions x."""
        rng, left, out = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        for _ in range(books):
            centre = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
            for _ in range(rounds):
                near = np.argmax(left @ centre.T - 0.5 * (centre * centre).sum(1), axis=1)
                n = np.bincount(near, minlength=words)
                total = np.zeros_like(centre)
                np.add.at(total, near, left)
                centre[n > 0] = total[n > 0] / n[n > 0, None]
                if (n == 0).any():
                    centre[n == 0] = left[rng.choice(len(left), int((n == 0).sum()))]
            near = np.argmax(left @ centre.T - 0.5 * (centre * centre).sum(1), axis=1)
            left -= centre[near]
            out.append(centre)
        return cls(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = 8, step: int = 1024) -> np.ndarray:
        """The codes (one byte a book) that beam search over the books finds for directions x."""
        m, k, d = self.books.shape
        out = [np.zeros((0, m), np.uint8)]
        for at in range(0, len(x), step):
            left = x[at : at + step].astype(np.float32)[:, None, :]
            n, rows = len(left), np.arange(len(left))[:, None]
            cost, codes = (left * left).sum(axis=2), np.zeros((n, 1, 0), np.uint8)
            for book in range(m):
                grown = (cost[:, :, None] + self.norms[book] - 2 * (left.reshape(-1, d) @ self.books[book].T).reshape(n, -1, k)).reshape(n, -1)
                keep = min(beam, grown.shape[1]) if book < m - 1 else 1
                best = np.argpartition(grown, keep - 1, axis=1)[:, :keep]
                parent, word = best // k, best % k
                left, cost = left[rows, parent] - self.books[book][word], grown[rows, best]
                codes = np.concatenate((codes[rows, parent], word[:, :, None].astype(np.uint8)), axis=2)
            out.append(codes[:, 0])
        return np.concatenate(out)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: (query, book, word)."""
        return np.einsum("qd,mkd->qmk", queries.astype(np.float32), self.books, optimize=True)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, norm) of the rows that can take part; the length is worked out by the largest component, so that no square is lost."""
    vector = F.col(vector_col)
    if df.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    most = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x).cast("double")))
    share = lambda x: x.cast("double") / F.col("most")
    norm = F.least(F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + share(x) * share(x))), F.lit(1e308))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    return rows.withColumn("most", most).where("most > 0").withColumn("norm", norm).select("vec_id", "v", "norm")


def train(rows: DataFrame, books: int, words: int, most_rows: int) -> Quantiser | None:
    """Codebooks for the directions of most_rows rows at most, the first by a hash of id and vector."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(most_rows).select("v", "norm").toPandas()
    if not len(sample):
        return None
    return Quantiser.train(np.stack(sample.v.to_numpy()).astype(np.float64) / sample.norm.to_numpy()[:, None], books, words)


def build_index(rows: DataFrame, quantiser: Quantiser, beam: int = 8) -> DataFrame:
    """rows (row, vec_id, v, norm) with codes: those of the direction, by beam search over the books."""
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)
    d = quantiser.books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().reshape(-1, d) / batch.column("norm").to_numpy()[:, None]
            codes = shared.value.encode(x, beam)
            yield batch.append_column("codes", pa.array([c.tobytes() for c in codes], pa.binary()))

    v = rows.schema["v"].dataType.simpleString()
    return materialize(rows.select("row", "vec_id", "v", "norm").mapInArrow(run, f"row long, vec_id long, v {v}, norm double, codes binary"))


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, component after component."""
    out = np.zeros(len(vectors))
    for q, column in zip(query, vectors.T, strict=True):
        out += q * column
    return out


def nearest(index: DataFrame, queries: DataFrame, quantiser: Quantiser, n_index: int, n_queries: int, k: int, size: int, index_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """(asked, query_id, best): for each query the k rows of the index with the largest inner product among those whose table score is large.

    Queries and index are dealt by hash into blocks; every pair of blocks is one
    group, which looks each code up in the query's table, scales by the stored
    norm, and scores the `size` best again on the original vectors. Only k rows
    a query leave a group.
    """
    shared = index.sparkSession.sparkContext.broadcast(quantiser)
    across, down = max(1, -(-n_index // index_block)), max(1, -(-n_queries // query_block))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("a", F.pmod(F.xxhash64("row"), F.lit(across))).withColumn("b", all_of(down))
    right = queries.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(down))).withColumn("a", all_of(across))
    cell = (F.col("a") * down + F.col("b")).alias("cell")

    def run(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(asked):
            return pd.DataFrame({"asked": [], "query_id": [], "ids": [], "costs": []})
        known, asked = known.sort_values(["vec_id", "row"]), asked.sort_values("row")
        rows, ids, norms = (known[c].to_numpy() for c in ("row", "vec_id", "norm"))
        vectors = np.stack(known.v.to_numpy()).astype(np.float64)
        m = shared.value.books.shape[0]
        word = np.frombuffer(b"".join(known.codes), np.uint8).reshape(-1, m).T.astype(np.intp)
        out_ids, out_costs = [], []
        x = np.stack(asked.v.to_numpy()).astype(np.float64)
        directions = x / asked.norm.to_numpy()[:, None]
        for at in range(0, len(x), 32):
            for q, row, tables in zip(x[at : at + 32], asked.row.to_numpy()[at : at + 32], shared.value.tables(directions[at : at + 32]), strict=True):
                score = tables[0][word[0]].astype(np.float64)
                for b in range(1, m):
                    score += tables[b][word[b]]
                score *= norms
                score[rows == row] = -np.inf
                least = np.partition(score, len(score) - size)[len(score) - size] if len(score) > size else -np.inf
                some = np.flatnonzero((score >= least) & (score > -np.inf))
                some = np.sort(some[np.argsort(-score[some], kind="stable")[:size]])
                found = exact(q, vectors[some])
                best = np.argsort(-found, kind="stable")[:k]
                out_ids.append(ids[some[best]])
                out_costs.append(-found[best])
        return pd.DataFrame({"asked": asked.row.to_numpy(), "query_id": asked.vec_id.to_numpy(), "ids": out_ids, "costs": out_costs})

    parts = left.select("row", "vec_id", "v", "norm", "codes", cell).groupBy("cell").cogroup(right.select("row", "vec_id", "v", "norm", cell).groupBy("cell"))
    parts = parts.applyInPandas(run, "asked long, query_id long, ids array<long>, costs array<double>")
    found = parts.select("asked", "query_id", F.arrays_zip(F.col("costs").alias("cost"), F.col("ids").alias("vec_id")).alias("found"))
    return found.groupBy("asked", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("best"))


def search(df: DataFrame, is_query, k: int = 20, books: int = 24, words: int = 256, train_rows: int = 32_768, beam: int = 8, size: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows with the largest inner product for each query row, the row itself left out.

    `is_query` is a condition on vec_id. Codebooks are fitted on train_rows rows
    at most; every row is indexed, and every query is scored against every
    row's codes; in each block of the index the `size` best are scored again on
    the original vectors in double precision. Ties go to the smaller id.
    Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do rows without an id. Vectors of different lengths have no inner
    product: each length is searched by itself. Rows that repeat an id are rows
    of their own, as queries and as candidates; fewer candidates than k are all
    returned; an empty table gives no rows; other columns are ignored.
    """
    every = materialize(usable(df, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    found = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in sorted(r.d for r in every.select(F.size("v").alias("d")).distinct().collect()):
        rows = every.where(F.size("v") == length)
        quantiser, queries = train(rows, books, words, train_rows), rows.where(is_query)
        best = nearest(build_index(rows, quantiser, beam), queries, quantiser, rows.count(), queries.count(), k, size)
        placed = best.select("query_id", F.posexplode("best"))
        found = found.union(placed.select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", (-F.col("col.cost")).alias("score")))
    return found


def op2_additive(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op2_additive": op2_additive}
