"""Collocations: phrases of two to four words whose parts seldom stand apart.

Frequent words get 32-bit numbers, and phrases of them are fixed-width binary
keys: four words are two 64-bit columns, a shorter phrase ends in zeros. Tasks
sort keys by radix, count equal ones as runs, and send runs to the range of
mixed keys that they fall into, so that a common phrase is one record a run
and no range gets more than its share of different ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .runs import PART, SENT, Sender, arrays_folder, exchange, find_in, part_of_hash, read_array, slices, write_array
from .words import Texts, blocks, cut, hashes, mixed

SPACES, BREAKS = bytes([32, 9]), b".,;:!?" + bytes(range(10, 14))
PARTING = np.isin(np.arange(256), list(SPACES + BREAKS))
BREAKING = np.isin(np.arange(256), list(BREAKS))
LIMIT = 1 << 32
UNKNOWN = "und"


def _of_lang(found: np.ndarray, langs: np.ndarray) -> np.ndarray:
    return mixed(found ^ langs)


def _lang_hashes(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode(), 12) for x in langs], np.uint64)


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of docs (lang, text): every word of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            own = _lang_hashes(langs)
            for block in blocks(batch.column(1), SPACES + BREAKS):
                starts, ends = cut(block, PARTING)
                rows = block.rows[np.searchsorted(block.edges, starts, "right") - 1]
                _, first, n = np.unique(_of_lang(hashes(block.data, starts, ends), own[rows]), return_index=True, return_counts=True)
                data = block.data.tobytes()
                words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([langs[r] for r in rows[first].tolist()], pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Dictionary:
    """Frequent words in the order of their hashes, numbered from 1: files in the shared folder that workers map into memory."""

    folder: str
    edges: np.ndarray
    files: dict[tuple[str, int], np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"files": {}}

    def read(self, name: str, part: int) -> np.ndarray:
        if (name, part) not in self.files:
            self.files[name, part] = read_array(self.folder, name, part)
        return self.files[name, part]

    def numbers(self, found: np.ndarray) -> np.ndarray:
        """The number of each hash, 0 if the word isn't frequent."""
        kinds, back = np.unique(found, return_inverse=True)
        ids = np.zeros(len(kinds), np.uint64)
        for part, own in slices(part_of_hash(len(self.edges) - 1)(kinds)):
            at, hit = find_in(self.read("hash", part), kinds[own])
            ids[own] = np.where(hit, at + self.edges[part] + 1, 0)
        return ids[back]

    def text(self, number: int) -> tuple[str, str]:
        """The language and the word of a number."""
        part = int(np.searchsorted(self.edges, number - 1, "right")) - 1
        ends, at = self.read("ends", part), number - 1 - int(self.edges[part])
        text, start = self.read("text", part), int(ends[2 * at - 1]) if at else 0
        return tuple(text[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in ((start, ends[2 * at]), (ends[2 * at], ends[2 * at + 1])))


def write_dictionary(frequent: DataFrame, parts: int) -> Dictionary:
    """Number the rows of (lang, word): a file for each range of hashes."""
    folder = arrays_folder(frequent.sparkSession, "phrases")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            own = _of_lang(hashes(np.frombuffer(column.buffers()[2], np.uint8), edges[:-1], edges[1:]), _lang_hashes(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(part_of_hash(parts)(own).astype(np.int32)), pa.array(own.view(np.int64)), *batch.columns[:2]], names=["part", "hash", "lang", "word"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows = TaskContext.get().partitionId(), []
        for batch in batches:
            rows += zip(batch.column(1).to_numpy().view(np.uint64).tolist(), *(batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)), strict=True)
        rows.sort()
        write_array(folder, "hash", part, np.array([r[0] for r in rows], np.uint64))
        write_array(folder, "ends", part, np.cumsum([len(x) for r in rows for x in r[1:]], dtype=np.int64))
        write_array(folder, "text", part, np.frombuffer(b"".join(x for r in rows for x in r[1:]), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(rows)], pa.int64())], names=["part", "n"])

    rows = frequent.select("lang", "word").mapInArrow(keyed, "part int, hash long, lang string, word string")
    sizes = np.zeros(parts, np.int64)
    for r in rows.repartitionById(parts, "part").mapInArrow(write, "part long, n long").collect():  # one row a part
        sizes[r.part] = r.n
    if sizes.sum() >= LIMIT - 1:
        raise ValueError("words are numbered by 32 bits: at most 4294967294 may be frequent")
    return Dictionary(folder, np.concatenate(([0], np.cumsum(sizes))))


def encoded(column: pa.Array, langs: pa.Array, dictionary: Dictionary) -> Iterator[tuple[np.ndarray, int]]:
    """Numbers of the words of each block in order, 0 for other words and between pieces and texts.

    With a later stretch of a long text come the last three numbers before it;
    the second result says how many stand there again.
    """
    own, last = _lang_hashes(langs.to_pylist()), np.zeros(0, np.uint64)
    for block in blocks(column, SPACES + BREAKS):
        starts, ends = cut(block, PARTING)
        home = np.searchsorted(block.edges, starts, "right") - 1
        ids = dictionary.numbers(_of_lang(hashes(block.data, starts, ends), own[block.rows[home]]))
        breaks = np.concatenate(([0], np.cumsum(BREAKING[block.data], dtype=np.int64)))
        gap = np.diff(np.concatenate(([0], breaks[starts])), append=breaks[-1]) > 0
        gap[1:-1] |= home[1:] != home[:-1] if len(home) else False
        ids = np.insert(ids, np.flatnonzero(gap), np.uint64(0))
        known = np.zeros(0, np.uint64) if block.opens else last
        last = np.concatenate((known, ids))[-3:]
        yield np.concatenate((known, ids)), len(known)


@dataclass
class FrequentPairs:
    """Files of the sorted keys of pairs that are frequent."""

    dictionary: Dictionary
    parts: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        kinds, back = np.unique(keys, return_inverse=True)
        found, parts = np.zeros(len(kinds), bool), part_of_hash(self.parts)(mixed(kinds))
        order = np.argsort(parts, kind="stable")
        for part, own in slices(parts[order]):
            found[order[own]] = find_in(self.dictionary.read("pair", part), kinds[order[own]])[1]
        return found[back]


GRAM = "lang string, phrase string, words int, f long"


def _count(docs: DataFrame, dictionary: Dictionary, parts: int, width: int, keys_of: Callable, least: int, keep: Callable) -> DataFrame:
    """Phrases that occur `least` times or more, of the keys that keys_of makes of a block's numbers."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(lambda keys: part_of_hash(parts)(mixed(keys[:, 0] if width == 1 else mixed(keys[:, 0]) ^ keys[:, 1])))
        for batch in batches:
            for ids, known in encoded(batch.column(1), batch.column(0), dictionary):
                for keys in keys_of(ids, known):
                    yield from sender.add(keys)
        yield from sender.send()

    def finish(part: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        often = n[:, 0] >= least
        keys, n = keys[often], n[often, 0]
        keep(part, keys)
        halves = [x for c in range(width) for x in (keys[:, c] >> np.uint64(32), keys[:, c] & np.uint64(LIMIT - 1))]
        texts, out = {}, ([], [], [])
        for row in zip(*(h.tolist() for h in halves), strict=True):
            numbers = [x for x in row if x]
            for x in numbers:
                if x not in texts:
                    texts[x] = dictionary.text(x)
            for column, value in zip(out, (texts[numbers[0]][0], " ".join(texts[x][1] for x in numbers), len(numbers)), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()), pa.array(n.astype(np.int64))], names=["lang", "phrase", "words", "f"])

    return exchange(docs.mapInArrow(send, SENT), parts, width, finish, GRAM)


def frequent_phrases(docs: DataFrame, counted: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f): all phrases of one to four words that occur `least` times or more in pieces of docs (lang, text).

    A phrase can only be so frequent if its words are, and a longer one only if
    its pairs are: other words break pieces, and phrases of three and four are
    made of frequent pairs only.
    """
    spark = docs.sparkSession
    frequent = counted.where(F.col("n") >= least)
    dictionary = write_dictionary(frequent, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, -(-int(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // PART))
    pairs = FrequentPairs(dictionary, parts)

    def two(ids: np.ndarray, known: int) -> Iterator[np.ndarray]:
        left, right = ids[:-1], ids[1:]
        ok = (left > 0) & (right > 0)
        ok[: max(0, known - 1)] = False
        yield (left << np.uint64(32) | right)[ok, None]

    def more(ids: np.ndarray, known: int) -> Iterator[np.ndarray]:
        key = ids[:-1] << np.uint64(32) | ids[1:]
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        ok = np.zeros(len(key), bool)
        ok[both] = pairs.holds(key[both])
        for n in (3, 4):
            at = ok[: len(ok) - n + 2].copy()
            for k in range(1, n - 1):
                at &= ok[k : len(ok) - n + 2 + k]
            at[: max(0, known - n + 1)] = False
            at = np.flatnonzero(at)
            yield np.column_stack((key[at], key[at + 2] if n == 4 else ids[at + 2] << np.uint64(32)))

    of_two = materialize(_count(docs, dictionary, parts, 1, two, least, lambda part, keys: write_array(dictionary.folder, "pair", part, keys[:, 0])))
    of_more = _count(docs, dictionary, parts, 2, more, least, lambda part, keys: None)
    return materialize(frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f")).unionByName(of_two).unionByName(of_more))


def mine(df: DataFrame, least: int = 30, most: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` phrases that stand together best.

    A-Z are lower-cased; pieces end at . , ; : ! ? and line breaks, words at
    spaces and tabs. A phrase of two to four words that occurs a >= least times
    is cut where 2000000 a // (l + r) is lowest, l and r being how often its
    parts occur, the first such cut. It goes if a longer candidate that holds
    it occurs 4/5 as often or more. Ties go to the higher a, then to the phrase
    that is first by bytes. Null texts are empty, a null language is 'und';
    repeated rows count each; an empty table gives no rows; other columns are
    ignored.
    """
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = materialize(count_words(docs))
    grams = frequent_phrases(docs, counted, least)
    candidates = grams.where("words > 1").withColumn("w", F.split("phrase", " "))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    part = lambda name, n: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    places = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), s -> array_join(slice(w, s, m), ' '))))")
    inner = candidates.where("words > 2").select("lang", F.explode(places).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * 80))
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language may hold most phrases: the first of each of several parts of it, then of those.
    shares = kept.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    shares = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= most)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


QUERIES = {"op12_phrases": op12_phrases}

ORACLES = {
    "op12_phrases": """
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')), '[^ \\t]+') AS w FROM lowered
), grams AS (
  SELECT lang, m AS words, array_to_string(w[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m)
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE words = 1 GROUP BY lang
), f AS (
  SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY lang, words, phrase HAVING count(*) >= 30
), candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 :], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest(range(1, words - m + 2)) AS s FROM (SELECT *, unnest(range(2, words)) AS m FROM candidates)) GROUP BY 1, 2
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 80 * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
""",
}
