"""Tokenize documents and pack their pieces into sequences by bounded-space best fit."""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long"


class BestFit:
    """Online best fit over at most `most_open` open bins.

    Bit f of `free` is set while an open bin has exactly f free places; the
    lowest set bit at or above an item's length is the best fit. When an item
    fits nowhere and all bins are open, the fullest one closes.
    """

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free, self.open, self.bins = 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def _take(self, space: int) -> int:
        stack = self.at[space]
        found = stack.pop()
        if not stack:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin and offset for an item of 1 to capacity places."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            target = self._take(space)
        else:
            if self.open == self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
            space, target, self.bins = self.capacity, self.bins, self.bins + 1
        if left := space - length:
            self.at.setdefault(left, []).append(target)
            self.free |= 1 << left
            self.open += 1
        return target, self.capacity - space


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TextIds:
    """Ids of whole texts by a tokenizer file of the tokenizers library, special tokens only where a text spells them.

    A file of plain byte-level BPE whose merges stand in the order of their ids
    is run by the tiktoken library, which gives the same ids in a sixth of the
    time; any other file by the tokenizers library itself. So is a text that
    tiktoken's pattern gives up on: one with a million spaces in a row, say.
    """

    def __init__(self, tokenizer_path: str):
        self.path, self._library = tokenizer_path, None
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ranks = self._plain_ranks(spec)
        if self.ranks is not None:
            import public_tokenizers
            import tiktoken

            added = {t["content"]: t["id"] for t in spec["added_tokens"]}
            self.coding = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=added)

    @property
    def library(self):
        if self._library is None:
            # Tasks already use all cores; the library's own threads would each keep memory besides.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    @staticmethod
    def _plain_ranks(spec: dict) -> dict[bytes, int] | None:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain_added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        if model.get("type") != "BPE" or any(model.get(o) for o in options) or spec.get("normalizer") or not plain_added:
            return None
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        added, byte = {t["content"] for t in spec["added_tokens"]}, _byte_characters()
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            return None
        return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.ranks is None:
            for found in self.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False):
                yield np.array(found.ids, "<u4").tobytes()
            return
        for t in texts:
            try:
                yield self.coding.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes() if t else b""
            except ValueError as error:
                if "Regex error" not in str(error):
                    raise
                yield np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@functools.lru_cache(maxsize=1)
def text_ids(tokenizer_path: str) -> TextIds:
    """One tokenizer for each worker process."""
    return TextIds(tokenizer_path)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", texts_per_step: int = 256) -> DataFrame:
    """Token ids of each whole text and then the separator, cut into pieces of `capacity` (only the first may be shorter).

    Returns doc_id, piece, start, length, ids_crc32 (of the little-endian ids).
    A null or empty text is one piece holding the separator alone; null or
    repeated ids are kept; an empty table gives no rows; other columns are
    ignored.
    """
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_ids(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, texts_per_step):
                part, out = batch.slice(at, texts_per_step), ([], [], [], [], [])
                for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECE)


def pack(parts: DataFrame, capacity: int = 2048, most_open: int = 1024, sequences_per_part: int = 16_384) -> DataFrame:
    """Add sequence_id and offset to pieces (length from 1 to capacity).

    Pieces are written down, dealt out evenly by a hash of all they are to as
    many parts as their total length asks for, and packed in hash order: the
    result depends neither on how the input was split nor on the session's
    partitions, and a repeated task packs alike. Each part leaves at most the
    last of its open bins partly filled. Pieces that repeat are packed each; an
    empty table gives no rows; longer or empty pieces raise an error.
    """
    parts = materialize(parts)
    total = parts.agg(F.sum("length")).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, first = BestFit(capacity, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            if lengths and not 1 <= min(lengths) <= max(lengths) <= capacity:
                raise ValueError(f"pieces must have 1 to {capacity} tokens")
            places = [fit.place(n) for n in lengths]
            ids, offsets = pa.array([first + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, offsets], names=[*batch.schema.names, "sequence_id", "offset"])

    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = parts.repartition(max(1, -(-total // (capacity * sequences_per_part))), order).sortWithinPartitions(order, "doc_id", "piece", "length")
    return dealt.mapInArrow(run, PACKED)


def op1_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op1_best_fit": op1_best_fit}
