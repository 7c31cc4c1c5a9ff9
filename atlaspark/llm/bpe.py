"""Byte-level BPE as DuckDB queries inside Spark tasks.

A text is cut into chunks (white space and what follows it); the pre-token
pattern never matches across a chunk's edge, so a chunk's ids do not depend on
its neighbours and are worked out once for each worker and kept in a cache of
bounded bytes. Every word that is not a token itself, of whatever length, is
contracted by a recursive query over its token-position rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .text import PLAIN, ChunkBytes

#: Rows (turn, word, place, id), place being the word's number and the byte position of a token. Each turn holds all tokens
#: of the words that still had a pair: the leftmost one of least rank is contracted.
ENCODE = """
WITH RECURSIVE step(turn, word, place, id) AS (
    SELECT 0, place >> 32, place, id FROM places
  UNION ALL
    SELECT s.turn + 1, s.word, s.place, CASE WHEN s.place = b.place THEN b.merged ELSE s.id END
    FROM step s JOIN (
        SELECT word, arg_min(place, best) AS place, arg_min(next_place, best) AS next_place, (min(best) >> 32)::INT AS merged
        FROM (
            SELECT p.word, p.place, p.next_place, (m.merged::BIGINT << 32) | (p.place & 4294967295) AS best
            FROM (SELECT word, place, id, lead(id) OVER side AS next_id, lead(place) OVER side AS next_place FROM step WINDOW side AS (ORDER BY place)) p
            JOIN merges m ON m.l = p.id AND m.r = p.next_id
            WHERE p.word = p.next_place >> 32
        ) GROUP BY word
    ) b USING (word)
    WHERE s.place <> b.next_place
)
SELECT word, list(id ORDER BY place) AS ids FROM step JOIN (SELECT word, max(turn) AS turn FROM step GROUP BY word) USING (word, turn) GROUP BY word ORDER BY word
"""
#: The same for long words: one row (place, id) for a token, id -1 once it is merged into the one before.
_LONG = """
WITH RECURSIVE step(place, id) USING KEY (place) AS (
    SELECT place, id FROM places
  UNION
    SELECT unnest(CASE WHEN sound THEN [place, next_place] ELSE [(word << 32) | 4294967295] END) AS place,
           unnest(CASE WHEN sound THEN [merged, -1] ELSE [-2] END) AS id
    FROM (
        SELECT *, {sound} AS sound, row_number() OVER (PARTITION BY word, nr - nth ORDER BY place) AS turn
        FROM (
            SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS nth
            FROM (
                SELECT p.word, p.place, p.next_place, p.nr, m.merged, m.hidden, m.l = m.r AS twin, t.last, min(m.merged) OVER (PARTITION BY p.word) AS least
                FROM (
                    SELECT place >> 32 AS word, place, id, lead(id) OVER side AS next_id, lead(place) OVER side AS next_place, row_number() OVER side AS nr
                    FROM recurring.step WHERE id >= 0 WINDOW side AS (PARTITION BY place >> 32 ORDER BY place)
                ) p
                JOIN (SELECT place >> 32 AS word, max(id) AS last FROM step GROUP BY place >> 32 HAVING max(id) >= 0) t ON t.word = p.word
                JOIN merges m ON m.l = p.id AND m.r = p.next_id
            ) WHERE merged = least
        )
    ) WHERE {some}
)
SELECT place >> 32 AS word, list(id ORDER BY place) FILTER (id >= 0) AS ids, min(id) = -2 AS open FROM step GROUP BY word ORDER BY word
"""
#: A turn contracts all pairs of least rank of a word, overlapping ones from the left. That is what one at a time leads to as
#: long as the least rank rises from turn to turn and no pair in between has a lower one. A word for which this does not
#: hold is marked by a row with id -2 and stops.
ENCODE_LONG = _LONG.format(sound="least > last AND NOT hidden", some="NOT twin OR turn % 2 = 1")
#: A turn contracts the leftmost pair of least rank only.
ENCODE_OPEN = _LONG.format(sound="TRUE", some="nth = 1")
#: A token's bytes are kept as characters of the same numbers.
DECODE = """
SELECT doc, array_to_string(list(piece ORDER BY place), '') AS bytes
FROM ids JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


class Codec:
    """Ranks of a tiktoken file, with DuckDB tables of its merges and tokens."""

    def __init__(self, ranks_path: str, pattern: str, bytes_per_query: int = 100_000, long_word: int = 64, cache_bytes: int = 256 << 20):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.bytes_per_query, self.long_word = bytes_per_query, long_word
        self.chunks = ChunkBytes(self._learn, cache_bytes)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB"})
        self._table("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]}))
        # Every pair of tokens that make a token. hidden: contracting it before another one just after it can make a pair of lower rank.
        halves = [(left, right, rank) for token, rank in self.ranks.items() for cut in range(1, len(token)) if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None]
        ends = np.array(halves, np.int32).reshape(-1, 3)
        self._table("pairs", pa.table({"l": ends[:, 0], "r": ends[:, 1], "merged": ends[:, 2]}))
        self.db.execute("CREATE TABLE merges AS SELECT *, EXISTS (SELECT 1 FROM pairs n WHERE n.l = m.merged AND n.r = m.l AND n.merged < m.merged) AS hidden FROM pairs m")

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
        self.db.unregister("rows")

    def _query(self, sql: str, words: list[bytes]) -> pa.Table:
        """The result of a recursive query over words, ordered by their place in the list."""
        sizes = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.repeat((np.arange(len(words)) << 32) - starts, sizes) + np.arange(len(ids))
        self.db.register("places", pa.table({"place": place, "id": ids}))
        found = self.db.sql(sql).to_arrow_table()
        self.db.unregister("places")
        return found

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids (as 32-bit numbers) of distinct words, each contracted by its leftmost pair of least rank until no pair has a rank.

        A word that is itself a token stays whole, as in the library.
        """
        out = [None if (rank := self.ranks.get(w)) is None else np.int32(rank).tobytes() for w in words]
        for sql in (ENCODE, ENCODE_LONG, ENCODE_OPEN):
            left = [i for i, done in enumerate(out) if done is None and (sql is not ENCODE or len(words[i]) <= self.long_word)]
            part = np.cumsum([len(words[i]) for i in left]) // self.bytes_per_query
            for at, n in zip(*np.unique(part, return_index=True, return_counts=True)[1:], strict=True):
                own = left[at : at + n]
                found = self._query(sql, [words[i] for i in own])
                ids = found.column("ids").combine_chunks()
                flat, edge = memoryview(ids.values.to_numpy()).cast("B"), (4 * ids.offsets.to_numpy()).tolist()
                open_ = found.column("open").to_pylist() if sql is ENCODE_LONG else [False] * n
                for i, a, b, again in zip(own, edge[:-1], edge[1:], open_, strict=True):
                    out[i] = None if again else bytes(flat[a:b])
        return out

    def _learn(self, chunks: list[str]) -> list[bytes]:
        parts = [[c.encode("utf-8")] if PLAIN(c) else [m.encode("utf-8") for m in self.pattern.findall(c)] for c in chunks]
        words = list(dict.fromkeys(w for ws in parts for w in ws))
        ids = dict(zip(words, self.words(words), strict=True))
        return [b"".join([ids[w] for w in ws]) for ws in parts]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return (np.frombuffer(ids, np.int32) for ids in self.chunks.encode(texts))

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """Bytes of lists of ids, list i being ids[edges[i]:edges[i + 1]]."""
        sizes = np.diff(edges)
        rows = pa.table({"doc": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "place": np.arange(len(ids), dtype=np.int32), "id": ids})
        self.db.register("ids", rows)
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(sizes)
        for doc, text in zip(found.column("doc").to_pylist(), found.column("bytes"), strict=True):
            out[doc] = text.as_py().encode("latin-1")
        return out


@functools.lru_cache(maxsize=1)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(ranks_path, pattern)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*parts, np.empty(0, np.int32)]).astype(np.int32)))


def _decoded(own: Codec, lists: pa.ListArray, ids_per_step: int) -> list[bytes]:
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    step, out = np.cumsum(sizes) // ids_per_step, []
    for at, n in zip(*np.unique(step, return_index=True, return_counts=True)[1:], strict=True):
        part = lists.slice(at, n)
        out += own.decode(part.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes[at : at + n]))))
    return out


def _steps(texts: pa.Array, most_texts: int, most_chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """Stretches of the texts with their places, of most_chars at most but for single longer texts."""
    at, part, chars = 0, [], 0
    for text in texts:
        text = text.as_py()
        if part and (len(part) == most_texts or chars + len(text or "") > most_chars):
            yield at, part
            at, part, chars = at + len(part), [], 0
        part.append(text)
        chars += len(text or "")
    if part:
        yield at, part


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, most_texts: int = 512, most_chars: int = 1 << 21) -> DataFrame:
    """(id, ids): token ids of each whole text, special tokens being ordinary text; with `decoded` also the bytes they stand for.

    Null and empty texts have no ids; ids may be null or repeat; words of any
    length are contracted exactly; an empty table gives no rows; other columns
    are ignored. ranks_path must be readable on every executor. `decoded` does
    what decode() does, in the same task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            for at, part in _steps(batch.column(1), most_texts, most_chars):
                columns = [batch.column(0).slice(at, len(part)), _lists(list(own.encode(part)))]
                if decoded:
                    columns.append(pa.array(_decoded(own, columns[1], most_chars), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "bytes"][: len(columns)])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>" + ", bytes binary" * decoded)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_per_step: int = 1 << 19) -> DataFrame:
    """(id, ids, bytes): the bytes that lists of ids stand for.

    A null or empty list has none; null ids in a list and ids that are no token
    stand for nothing; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            lists = batch.column(1)
            known = _lists([np.array([i for i in x.as_py() or () if i is not None], np.int32) for x in lists]) if lists.flatten().null_count else lists
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(_decoded(own, known, ids_per_step), pa.binary())], names=["id", "ids", "bytes"])

    return df.select("id", "ids").mapInArrow(run, "id long, ids array<int>, bytes binary")


def op9_duckdb_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return encode(table(spark, sf_dir, "documents"), ranks, pattern, decoded=True).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {"op9_duckdb_bpe": op9_duckdb_bpe}
