"""Cutting texts into chunks whose results can be kept for the next text."""

from __future__ import annotations

import contextlib
import gc
import re
from collections.abc import Callable, Iterator

WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space and the run of other characters after it; joined, the chunks are the text. Marks that end a plain
#: word are a chunk of their own, so that the word is met again without them: no token holds both.
CHUNKS = re.compile(
    f"[{WHITE_SPACE}]*[^\\W_]+(?<=[A-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff])(?=[.,;:!?|$%&*#]+(?:[{WHITE_SPACE}]|$))"
    f"|[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+"
)


#: A plain word, with or without the space before it: a chunk, and one match of the pre-token patterns.
PLAIN = re.compile("[ ]?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch
#: Marks of which one after a plain word is a chunk of its own.
ENDS = frozenset(".,;:!?|$%&*#")


@contextlib.contextmanager
def collector_paused() -> Iterator[None]:
    """Without Python's cycle collector, which would walk large tables without cycles again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class ChunkBytes:
    """Bytes for texts, put together from those of pieces (a space and what follows it), of which about most_bytes are kept.

    A piece is a chunk or is put together from chunks. A piece that is only a
    space or ends in white space may share a token with the next one; texts with
    such pieces are cut into chunks as a whole.

    Kept by: what follows the space; a text's first piece, and a chunk without a
    space before it, after a NUL; a chunk that is no piece (white space, or with
    a NUL in it) as a tuple.
    """

    #: Bytes of an entry besides its characters and its result: two objects and a place in the table.
    ENTRY = 200

    def __init__(self, learn: Callable[[list[str]], list[bytes]], most_bytes: int = 192 << 20, longest: int = 64):
        self.learn, self.most, self.longest = learn, most_bytes // 2, longest
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0
        self.passing: list = []

    def _parts(self, key: str | tuple) -> list | str | None:
        """The chunk that a key stands for, the keys of its chunks, or None for a piece that has to be seen with the next."""
        if isinstance(key, tuple):
            return key[0]
        piece = key[1:] if key[:1] == "\0" else " " + key
        if PLAIN(piece) or not piece:
            return piece
        if piece == " " or piece[-1].isspace():
            return None
        chunks = CHUNKS.findall(piece)
        return piece if len(chunks) == 1 else [c[1:] if c[0] == " " and len(c) > 1 else "\0" + c for c in chunks]

    @collector_paused()
    def look_up(self, keys: set) -> dict:
        """A mapping that holds at least the given keys, until the next call. What is not asked for goes first."""
        for k in self.passing:
            del self.young[k]
        if self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        found, atoms, joint = {}, {}, {}
        for k in keys.difference(young):
            if k in old:
                found[k] = old[k]
                continue
            if type(k) is str:
                piece = " " + k
                if PLAIN(piece):
                    atoms[k] = piece
                    continue
                if len(k) > 1 and k[-1] in ENDS and PLAIN(piece, 0, len(k)):
                    joint[k] = (k[:-1], "\0" + k[-1])
                    continue
            parts = self._parts(k)
            if isinstance(parts, list):
                joint[k] = parts
            elif parts is None:
                found[k] = None
            else:
                atoms[k] = parts
        for parts in joint.values():
            for k in parts:
                if k not in young and k not in atoms:
                    if k in old:
                        found[k] = old[k]
                    else:
                        atoms[k] = k[1:] if k[:1] == "\0" else " " + k
        found.update(zip(atoms, self.learn(list(atoms.values())), strict=True))
        young.update(found)
        get = young.__getitem__
        joined = {k: b"".join(map(get, parts)) for k, parts in joint.items()}
        young.update(joined)
        self.passing = []
        for part in (found, joined):
            self.passing += [k for k in part if len(k) > self.longest or type(k) is tuple and len(k[0]) > self.longest]
            self.held += len(part) * self.ENTRY + sum(map(len, part)) + sum(map(len, filter(None, part.values())))
        return young

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The bytes of each text."""
        cuts = []
        for t in texts:
            pieces = t.split(" ") if t and "\0" not in t else []
            if pieces:
                pieces[0] = "\0" + pieces[0]
            cuts.append(pieces)
        known = self.look_up(set().union(*cuts))
        parts = [[known[p] for p in pieces] for pieces in cuts]
        whole = {i: [(c,) for c in CHUNKS.findall(t)] for i, t in enumerate(texts) if t and (not parts[i] or None in parts[i])}
        known = self.look_up(set().union(*whole.values())) if whole else known
        for i, part in enumerate(parts):
            yield b"".join([known[c] for c in whole[i]] if i in whole else part)
