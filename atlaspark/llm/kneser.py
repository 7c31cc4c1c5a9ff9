"""An interpolated modified Kneser-Ney model of word pairs: counted in Spark, kept as sorted hash arrays that workers map into memory.

Three rounds over the cluster: words by hash, pairs of word numbers, and what
pairs say of their words. Each writes one file for a range of keys into the
shared folder, sorted, so that a worker finds a key by binary search in pages
that all workers of its machine share; only totals come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .runs import PART, SENT, Sender, arrays_folder, exchange, find_in, part_of_hash, read_array, slices, write_array
from .words import Texts, blocks, cut, hashes, mixed

BREAKS = bytes([32, *range(9, 14)])
PARTING = np.isin(np.arange(256), list(BREAKS))
#: What stands among the hashes of words for a text's start and end.
START, END = np.uint64(0x57A7), np.uint64(0xE0D)
#: Words are numbered from 1 in the order of their hashes; 0 is any word that training did not see.
LIMIT = 1 << 32


def tokens(texts: Texts, last: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's tokens and which of its texts each belongs to.

    Each text begins with what stands before its first token: its start, or in
    a later stretch of a long text the last word so far. A text that ends here
    has its end as last token.
    """
    starts, ends = cut(texts, PARTING)
    found, home = hashes(texts.data, starts, ends), np.searchsorted(texts.edges, starts, "right") - 1
    n = len(texts.edges) - 1
    if texts.closes:
        at = np.searchsorted(home, np.arange(n), "right")
        found, home = np.insert(found, at, END), np.insert(home, at, np.arange(n))
    at = np.searchsorted(home, np.arange(n), "left")
    return np.insert(found, at, START if texts.opens else last), np.insert(home, at, np.arange(n))


def token_blocks(column: pa.Array) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """Each block of a column of texts with its tokens and their texts."""
    last = START
    for block in blocks(column, BREAKS):
        found, home = tokens(block, last)
        last = found[-1]
        yield block, found, home


@dataclass
class Words:
    """The words of the training texts: files of sorted hashes and counts, one for each range of hashes."""

    folder: str
    edges: np.ndarray
    files: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": {}}

    def read(self, name: str, part: int) -> np.ndarray:
        if (name, part) not in self.files:
            self.files[name, part] = read_array(self.folder, name, part)
        return self.files[name, part]

    def numbers(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and the count of each of some ascending hashes (0 and 0 if unknown)."""
        ids, n = np.zeros(len(found), np.uint64), np.zeros(len(found), np.uint64)
        for part, own in slices(part_of_hash(len(self.edges) - 1)(found)):
            at, hit = find_in(self.read("hash", part), found[own])
            if hit.any():
                ids[own], n[own] = np.where(hit, at + self.edges[part] + 1, 0), np.where(hit, self.read("count", part)[at], 0)
        return ids, n

    def part_of(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, ids.astype(np.int64) - 1, "right") - 1


def count_words(texts: DataFrame, parts: int) -> tuple[Words, int]:
    """The tokens of a column of texts and their starts, counted; and how many there are in all."""
    folder = arrays_folder(texts.sparkSession, "words")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(lambda keys: part_of_hash(parts)(keys[:, 0]))
        for batch in batches:
            for block, found, _ in token_blocks(batch.column(0)):
                yield from sender.add(found[0 if block.opens else 1 :, None])
        yield from sender.send()

    def finish(part: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        write_array(folder, "hash", part, keys[:, 0])
        write_array(folder, "count", part, n[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, len(keys), int(n.sum()))], names=["part", "kinds", "n"])

    sizes, total = np.zeros(parts, np.int64), 0
    for r in exchange(texts.mapInArrow(send, SENT), parts, 1, finish, "part long, kinds long, n long").collect():  # one row a part
        sizes[r.part], total = r.kinds, total + r.n
    if sizes.sum() + 1 >= LIMIT:
        raise ValueError("a pair of words is one 64-bit number: training texts may have at most 4294967294 different words")
    return Words(folder, np.concatenate(([0], np.cumsum(sizes)))), total


@dataclass
class Pairs:
    """Files of sorted pairs (left number << 32 | right number) with counts.

    All pairs of a left word are in one file, so that what follows it can be
    counted there; those of words as frequent as a file has pairs are spread.
    """

    words: Words
    parts: int
    hot: np.ndarray

    def part_of(self, pairs: np.ndarray) -> np.ndarray:
        left = pairs >> np.uint64(32)
        spread = find_in(self.hot, left)[1]
        return part_of_hash(self.parts)(mixed(np.where(spread, pairs, left)))

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        n, parts = np.zeros(len(pairs)), self.part_of(pairs)
        order = np.argsort(parts, kind="stable")
        for part, own in slices(parts[order]):
            at, hit = find_in(self.words.read("pair", part), pairs[order[own]])
            if hit.any():
                n[order[own]] = np.where(hit, self.words.read("times", part)[at], 0)
        return n


def hot_words(words: Words, least: int) -> np.ndarray:
    """Numbers of the words that occur at least so often: at most all tokens / least."""
    found = [np.flatnonzero(words.read("count", p) >= least) + words.edges[p] + 1 for p in range(len(words.edges) - 1)]
    return np.concatenate(found).astype(np.uint64) if found else np.zeros(0, np.uint64)


#: What pairs say of a word, by its number: different words before it, different words after it once, twice and more
#: often; and of all words, how many pairs occur three and four times.
FOLLOW = ("before", "once", "twice", "more")


def count_pairs(texts: DataFrame, words: Words, total: int) -> tuple[Pairs, dict[str, int]]:
    """Neighbouring tokens counted; FOLLOW of every word written beside them, and totals over all words."""
    parts = max(1, -(-total // PART))
    pairs = Pairs(words, parts, hot_words(words, max(2, min(PART, total // 8))))
    last = len(words.edges) - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(lambda keys: pairs.part_of(keys[:, 0]))
        for batch in batches:
            for _, found, home in token_blocks(batch.column(0)):
                kinds, back = np.unique(found, return_inverse=True)
                ids = words.numbers(kinds)[0][back]
                yield from sender.add((ids[:-1] << np.uint64(32) | ids[1:])[home[1:] == home[:-1], None])
        yield from sender.send()

    def finish(part: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = keys[:, 0], n[:, 0]
        write_array(words.folder, "pair", part, keys)
        write_array(words.folder, "times", part, n.astype(np.uint32) if not len(n) or n.max() < LIMIT else n)
        sender = Sender(lambda ids: words.part_of(ids[:, 0]))
        left = np.column_stack([np.zeros_like(n), n == 1, n == 2, n >= 3, n == 3, n == 4]).astype(np.uint64)
        right = np.zeros_like(left)
        right[:, 0] = 1
        for ids, weights in ((keys >> np.uint64(32), left), (keys & np.uint64(LIMIT - 1), right)):
            yield from sender.add(ids[:, None], weights)
        yield from sender.send()

    def write(part: int, ids: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((int(words.edges[part + 1] - words.edges[part]), 6), np.uint32)
        if len(ids):
            rows[ids[:, 0].astype(np.int64) - 1 - words.edges[part]] = n
        write_array(words.folder, "follow", part, rows[:, :4])
        sums = [*rows.sum(axis=0, dtype=np.int64), *((rows[:, 0] == k).sum() for k in (1, 2, 3, 4)), (rows[:, 0] > 2).sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in sums], names=TOTALS)

    counted = exchange(texts.mapInArrow(send, SENT), parts, 1, finish, SENT)
    sums = exchange(counted, last, 1, write, ", ".join(f"{c} long" for c in TOTALS)).agg(*[F.sum(c).alias(c) for c in TOTALS]).first()
    return pairs, {c: int(sums[c] or 0) for c in TOTALS}


TOTALS = [*FOLLOW, "three", "four", "b1", "b2", "b3", "b4", "b_more"]


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 1, 2 and more (index 0: nothing), from how many grams occur once to four times; 0.5, 1 and 1.5 where these don't allow the formula."""
    if min(n) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        if all(0 < x < k for k, x in enumerate(d, 1)):
            return np.array([0.0, *d])
    return np.array([0.0, 0.5, 1.0, 1.5])


@dataclass
class Model:
    """Totals, discounts and the files.

    p(w | u) = (max(c(uw) - D, 0) + (D1 N1(u) + D2 N2(u) + D3 N3(u)) p(w)) / c(u), where N1, N2 and N3 different
    words follow u once, twice and more often. p(w) is the same of how many different words stand before w, the rest
    going in equal parts to the words of training and one for all others. After a word not seen in training: p(w).
    """

    words: Words
    pairs: Pairs
    tokens: int
    kinds: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    different: int
    left_over: float

    def log10(self, found: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token of a block but the first of each text: its count, log10 of its share among the counts, and log10 of its probability by the model."""
        kinds, back = np.unique(found, return_inverse=True)
        ids, c = self.words.numbers(kinds)
        base = np.log10((c + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))
        rows = np.zeros((len(kinds), len(FOLLOW)))
        known = np.flatnonzero(ids)
        for part, own in slices(self.words.part_of(ids[known])):
            rows[known[own]] = self.words.read("follow", part)[ids[known[own]].astype(np.int64) - 1 - self.words.edges[part]]
        one = np.full(len(kinds), 1 / (self.kinds + 1))
        if self.different:
            one = (np.maximum(rows[:, 0] - taken(self.word_discounts, rows[:, 0]), 0) + self.left_over * one) / self.different
        spread = rows[:, 1:] @ self.pair_discounts[1:]
        here = np.flatnonzero(home[1:] == home[:-1]) + 1
        u, w = back[here - 1], back[here]
        times, seen = np.zeros(len(here)), np.flatnonzero((ids[u] > 0) & (ids[w] > 0))
        asked, place = np.unique(ids[u[seen]] << np.uint64(32) | ids[w[seen]], return_inverse=True)
        times[seen] = self.pairs.counts(asked)[place]
        p = one[w]
        after = np.flatnonzero(c[u] > 0)
        p[after] = (np.maximum(times[after] - taken(self.pair_discounts, times[after]), 0) + spread[u[after]] * p[after]) / c[u[after]]
        return c[w], base[w], np.log10(p)


def taken(discount: np.ndarray, n: np.ndarray) -> np.ndarray:
    return discount[np.minimum(n, 3).astype(np.int64)]


def train(df: DataFrame, text_col: str = "text") -> Model:
    """A model of all texts of df (null: empty): every token and every pair of neighbouring tokens is counted, none dropped.

    Words are told apart by 64-bit hashes. Repeated rows count each; without
    rows all words are alike; other columns are ignored.
    """
    texts = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words, total = count_words(texts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    starts = int(words.numbers(np.array([START]))[1][0])
    pairs, n = count_pairs(texts, words, total)
    d = discounts([n["b1"], n["b2"], n["b3"], n["b4"]])
    left_over = float(d[1:] @ [n["b1"], n["b2"], n["b_more"]])
    kinds = int(words.edges[-1]) - (starts > 0)
    return Model(words, pairs, total - starts, kinds, discounts([n["once"], n["twice"], n["three"], n["four"]]), d, n["before"], left_over)


SCORED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score): log10 probabilities of each whole text, by counts of words alone and by the model.

    A text's tokens are its words, A-Z lower-cased, and its end, so that null
    and empty texts have one. 10 ** (-score / n_tokens) is its perplexity. Ids
    may be null or repeat; an empty table gives no rows; other columns are
    ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # totals and names of files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, 4))
            for block, found, home in token_blocks(batch.column(1)):
                c, base, own = shared.value.log10(found, home)
                row = block.rows[home[1:][home[1:] == home[:-1]]]
                for i, x in enumerate((np.ones(len(row)), c > 0, base, own)):
                    sums[:, i] += np.bincount(row, x, batch.num_rows)
            columns = [batch.column(0), *(pa.array(sums[:, i].astype(np.int64)) for i in (0, 1)), *(pa.array(sums[:, i]) for i in (2, 3))]
            yield pa.RecordBatch.from_arrays(columns, schema=SCORED)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")


def op11_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    model = train(docs.where(~held_out("doc_id")))
    return score(docs, model).select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op11_kneser_ney": op11_kneser_ney}
