"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ORDER = 3
PAD = b"\n" * ORDER
UNKNOWN = "und"
#: Bytes coded at a time; the tables of costs for them are what a worker's memory grows by.
BLOCK = 1 << 18
#: Costs a model keeps ready (grams times languages); those of other grams are worked out from the trees when met.
READY = 1 << 22


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of the texts with the three before it, as 32-bit numbers, and how many each text has."""
    data = np.frombuffer(b"".join(PAD + t for t in texts), np.uint8).astype(np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = data[3:] | data[2:-1] << 8 | data[1:-2] << 16 | data[:-3] << 24
    keep = np.ones(len(codes), bool)
    ends = np.cumsum(sizes + ORDER)[:-1]
    for k in range(ORDER):
        keep[ends - ORDER + k] = False
    return codes[keep], sizes


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def count_grams(df: DataFrame) -> DataFrame:
    """(lang, gram, n) over every byte of the texts of (lang, text): totals for the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {}

        def merge(lang: str) -> None:
            codes, n = (np.concatenate(x) for x in zip(*kept[lang], strict=True))
            codes, place = np.unique(codes, return_inverse=True)
            kept[lang] = [(codes, np.bincount(place, n).astype(np.int64))]

        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = texts.setdefault(lang, [])
                part.append(_bytes(text.as_py()))
                if sum(map(len, part[-64:])) > BLOCK or len(part) >= 512:
                    kept.setdefault(lang, []).append(np.unique(grams(texts.pop(lang))[0], return_counts=True))
            for lang, part in texts.items():
                kept.setdefault(lang, []).append(np.unique(grams(part)[0], return_counts=True))
            for lang in kept:
                merge(lang)
        for lang, [(codes, n)] in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return df.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of depth three, one for each language.

    A symbol seen after a context costs -log2(n / (N + d)), where the context
    occurred N times with d different symbols; one not seen costs the escape
    -log2(d / (N + d)) and what the next shorter context asks; below the empty
    context all 256 bytes are alike. A context never seen costs nothing itself.
    """

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self._fill(np.array([place[r[0]] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint32), np.array([r[2] for r in rows], np.float64))

    @classmethod
    def of(cls, packed: list[tuple[str, bytes, bytes]]) -> Model:
        """A model of blocks (lang, grams as 32-bit numbers, counts as 64-bit ones), without a Python object for each gram."""
        model = cls([])
        model.langs = sorted({lang for lang, _, _ in packed})
        if packed:
            grams_, n = (np.concatenate([np.frombuffer(row[i], kind) for row in packed]) for i, kind in ((1, np.uint32), (2, np.uint64)))
            own = np.concatenate([np.full(len(row[1]) // 4, model.langs.index(row[0])) for row in packed])
            model._fill(own, grams_, n.astype(np.float64))
        return model

    def _fill(self, own: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
        self.trees = [[self._order(codes[own == i], n[own == i], k) for k in range(ORDER + 1)] for i in range(len(self.langs))]
        known, home = np.unique(codes, return_inverse=True)
        most = max(1, READY // max(1, len(self.langs)))
        if len(known) > most:
            known = np.sort(known[np.argsort(-np.bincount(home, n, len(known)), kind="stable")[:most]])
        self.known, self.cost = known, self._cost(known)

    @staticmethod
    def _order(codes: np.ndarray, n: np.ndarray, k: int) -> tuple:
        """Sorted grams of a context of k bytes with their costs, sorted contexts with their escapes."""
        low = codes & np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else codes
        found, place = np.unique(low, return_inverse=True)
        count = np.bincount(place, n, len(found))
        contexts, home = np.unique(found >> 8, return_inverse=True)
        total, kinds = np.bincount(home, count, len(contexts)), np.bincount(home, minlength=len(contexts))
        return found, -np.log2(count / (total + kinds)[home]), contexts, -np.log2(kinds / (total + kinds))

    def _cost(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram for each language."""
        out = np.zeros((len(codes), len(self.langs)))
        for i, tree in enumerate(self.trees):
            open_ = np.ones(len(codes), bool)
            for k in range(ORDER, -1, -1):
                found, cost, contexts, escape = tree[k]
                if not len(found):
                    continue
                low = codes & np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else codes
                at = np.minimum(np.searchsorted(found, low), len(found) - 1)
                hit = open_ & (found[at] == low)
                out[hit, i] += cost[at[hit]]
                open_ &= ~hit
                up = np.minimum(np.searchsorted(contexts, low >> 8), len(contexts) - 1)
                gone = open_ & (contexts[up] == low >> 8)
                out[gone, i] += escape[up[gone]]
            out[open_, i] += 8
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Exact code length of each text for each language."""
        codes, sizes = grams(texts)
        total = np.zeros((len(texts), len(self.langs)))
        edges = np.concatenate(([0], np.cumsum(sizes)))
        for at in range(0, len(codes), BLOCK):
            part = codes[at : at + BLOCK]
            place = np.minimum(np.searchsorted(self.known, part), len(self.known) - 1)
            cost = self.cost[place]
            missing = np.flatnonzero(self.known[place] != part)
            if len(missing):
                rare, back = np.unique(part[missing], return_inverse=True)
                cost[missing] = self._cost(rare)[back]
            first, last = np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, at + len(part), "left")
            inner = np.clip(edges[first:last] - at, 0, None)
            some = sizes[first:last] > 0
            if some.any():
                total[first:last][some] += np.add.reduceat(cost, inner[some], axis=0)
        return total


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of every text of the rows that have a language and a text.

    Counts cover all rows and all are kept: one for each language and four bytes
    in sequence, which depends on the alphabets more than on the number of rows.
    They go to the driver as arrays of twelve bytes a count; where they are more
    than it may collect (spark.driver.maxResultSize), the job fails.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes, n = batch.column(1).to_numpy().astype(np.uint32), batch.column(2).to_numpy().astype(np.uint64)
            own = [langs.indices.to_numpy() == i for i in range(len(langs.dictionary))]
            yield pa.RecordBatch.from_arrays([langs.dictionary, *[pa.array([x[o].tobytes() for o in own], pa.binary()) for x in (codes, n)]], names=["lang", "grams", "n"])

    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    packed = count_grams(rows).mapInArrow(pack, "lang string, grams binary, n binary").collect()
    return Model.of([(r.lang, bytes(r.grams), bytes(r.n)) for r in packed])


def identify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, as predict() returns them."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if model.langs and t and any(map(str.isalpha, t))]
    if known:
        bits = model.bits([_bytes(texts[i]) for i in known])
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        for i, b, s in zip(known, best, share, strict=True):
            lang[i], score[i] = model.langs[b], s
    return lang, score


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", texts_per_step: int = 256) -> DataFrame:
    """(id, lang_pred, score): the language that codes the whole text in the fewest bits.

    The score is its share of 2 ** -bits over all languages; ties go to the
    first in order. A null text, one without a letter, and any text if nothing
    was learned get 'und' with score 0. Ids may be null or repeat; an empty
    table gives no rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, texts_per_step):
                part = batch.slice(at, texts_per_step)
                lang, score = identify(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")


def keep_known(df: DataFrame, model: Model, least: float = 0.5, lang_col: str = "lang", text_col: str = "text", texts_per_step: int = 256) -> DataFrame:
    """The rows whose language is found with a score of `least` or more, with all their columns; a null language is filled in.

    Null and empty texts and those without a letter go; if nothing was learned,
    all rows with a letter stay. Repeated rows are judged alike; an empty table
    gives no rows; without a column lang_col nothing is filled in.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    text, named = df.columns.index(text_col), df.columns.index(lang_col) if lang_col in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, texts_per_step):
                part = batch.slice(at, texts_per_step)
                texts = part.column(text).to_pylist()
                lang, score = identify(shared.value, texts)
                keep = score >= least if shared.value.langs else np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])
                if shared.value.langs and named is not None:
                    part = part.set_column(named, part.schema.field(named), pc.coalesce(part.column(named), pa.array(lang, part.schema.field(named).type)))
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def op7_ppm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, model).select(F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_ppm": op7_ppm}
