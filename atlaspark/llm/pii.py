"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. A document's tokens that hold a digit or an @
form a graph: neighbours are joined by chain links, mentions that may be of the
same thing by skip links, however far apart: repeated, written otherwise, cut
short or masked. Tokens of base spans are evidence; loopy message passing gives
the others the label that their form, their neighbours and their other mentions
call for. A number that fails its check digit, or one that is mostly masked, is
found because of a mention that a pattern has found, and not by its form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts: any later start fails as the first does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
EDGE = "\"'.,;:!?<>[]{}|*&%$#=“”«»"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' valid matches, leftmost and not overlapping within a kind."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            found.append((0, start, free))
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found.append((3, m.start(), m.end()))
    return found


#: Signs that stand for characters left out, two or more in a row (one after the last point of an address).
MASK = re.compile("[*•#]{2,}|[xX]{2,}|[.][*•#xX]$")
MASKED_GROUPS = re.compile("(?:[*•#xX]{2,}[\\x20-]?)+$")
FLAGS = ["@", "+", "(", ")", "-", ".", "=", "/", ":", "letters", "hex", "luhn", "four parts", "long", "mask"]
SIZES = (0, 1, 2, 3, 4, 6, 7, 9, 11, 15, 19)
FEATURES = 1 + len(SIZES) + 1 + len(FLAGS)


def features(token: str) -> int:
    """A token's form as a bit for each feature that holds."""
    digits = _digits(token)
    letters = any(c.isalpha() for c in token)
    holds = [c in token for c in "@+()-.=/:"] + [
        letters,
        letters and len(token) >= 8 and all(c in "0123456789abcdefABCDEF" for c in token),
        len(digits) >= 12 and luhn(digits),
        token.count(".") == 3 and not letters,
        len(token) > 24,
        MASK.search(token) is not None,
    ]
    size = next((i for i, n in enumerate(SIZES) if len(digits) <= n), len(SIZES))
    return 1 | 1 << (1 + size) | sum(1 << (2 + len(SIZES) + i) for i, h in enumerate(holds) if h)


GROUPS = re.compile("[0-9]+")


def mention_keys(token: str, whole: bool = True) -> tuple[set[str], set[str], set[str]]:
    """Under what a mention is met again: keys that any two mentions may share; keys of what it is in full, and keys of what it is a part or a masked form of.

    Shared: all of it; its digits, and the last seven. In full and in part: the
    first eight digits and a number of eight to eleven; the last four and a
    masked number; an address and one with a masked name or without its domain;
    the first three parts of an address of four and those before a masked one.
    Some of a row of numbers (not whole) is met again as it is only.
    """
    if not whole:
        digits = _digits(token)
        return {x for x in (token.lower(), digits) if len(x) >= 6 and len(digits) * 2 >= len(token)}, set(), set()
    low, digits, mask = token.lower(), _digits(token), MASK.search(token)
    same, full, part = {low} if len(low) >= 6 and not mask else set(), set(), set()
    if "@" in low[1:]:
        local, _, domain = low.partition("@")
        (part if mask else full).add(f"{local[0]}@{domain}")
        full.add(f"{local}@")
    elif mask:
        groups = GROUPS.findall(token)
        if len(groups) == 3 and MASK.search(token).group()[0] == ".":
            part.add(".".join(groups))
        elif len(digits) >= 4:
            part.add(f"*{digits[-4:]}")
    else:
        groups = GROUPS.findall(token)
        if len(groups) == 4 and all(len(g) <= 3 for g in groups):
            same.add(".".join(groups))
            full.add(".".join(groups[:3]))
        if len(digits) >= 6 and len(digits) * 2 >= len(token):
            same |= {digits, digits[-7:]}
            if len(digits) >= 8:
                full.add(f"*{digits[-4:]}")
                (full if len(digits) > 11 else part).add(f"{digits[:8]}*")
        if len(low) >= 4:
            part.add(f"{low}@")
    return same, full, part


#: Tokens in a row that may be one number written in groups.
MOST_GROUPS = 6


@dataclass
class Graph:
    """Tokens of one text with their forms and evidence (label 0: other, -1: open), and the links between them."""

    spans: list[tuple[int, int]]
    form: np.ndarray
    known: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def of(cls, text: str, base: list[tuple[int, int, int]]) -> Graph:
        spans, form, known, chain, skip = [], [], [], [], []
        cover: list[int] = []
        covers = sorted((a, b, k) for k, a, b in base)
        c, reach, m = 0, 0, MARK.search(text)
        while m:
            start = m.start()
            while start > reach and not text[start - 1].isspace():
                start -= 1
            gap = SPACE.search(text, m.end())
            stop = gap.start() if gap else len(text)
            a, b = start, stop
            while a < b and text[a] in EDGE:
                a += 1
            while b > a and (text[b - 1] in EDGE or (text[b - 1] == ")" and "(" not in text[a:b])):
                b -= 1
            if a > start + 1 and set(text[start:a]) <= {"*", "#"}:
                a = start
            if text[b : b + 2] in (".*", ".#"):
                b += 2
            while c < len(covers) and covers[c][1] <= a:
                c += 1
            at = next((x for x in range(c, min(c + 4, len(covers))) if covers[x][0] < b and covers[x][1] > a), -1)
            if at < 0 and b - a <= 6 and (before := MASKED_GROUPS.search(text, max(reach, a - 40), a)):
                a = before.start()
            i = len(spans)
            if i and start - reach <= 2 and not text[reach:start].strip():
                chain.append((i - 1, i))
            spans.append((a, b))
            form.append(features(text[a:b]))
            cover.append(at)
            known.append(covers[at][2] + 1 if at >= 0 else -1)
            reach = stop
            m = MARK.search(text, stop)
        skip = cls._repetitions(text, spans, cover, covers, {i for _, i in chain})
        pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
        return cls(spans, np.array(form, np.int64), np.array(known, np.int64), pairs(chain), pairs(skip))

    @staticmethod
    def _repetitions(text: str, spans: list, cover: list[int], covers: list, chained: set[int]) -> list[tuple[int, int]]:
        """Links between mentions that share a key: of others to the last base span and the last mention before, of a base span to all mentions since the last.

        Mentions are base spans, other tokens, and up to MOST_GROUPS of those in
        a row.
        """
        last: tuple[dict[str, list[int]], ...] = ({}, {}, {})
        links: set[tuple[int, int]] = set()
        i = 0
        while i < len(spans):
            j, is_base = i + 1, cover[i] >= 0
            while j < len(spans) and (cover[j] == cover[i] if is_base else cover[j] < 0 and j in chained):
                j += 1
            if is_base:
                mentions = [(i, j, mention_keys(text[covers[cover[i]][0] : covers[cover[i]][1]]))]
            else:
                rows = [(x, y) for x in range(i, j) for y in range(x + 1, min(j, x + MOST_GROUPS) + 1)]
                mentions = [(x, y, mention_keys(text[spans[x][0] : spans[y - 1][1]], (x, y) == (i, j))) for x, y in rows]
            for first, stop, found in mentions:
                for own, others in ((found[0], last[0]), (found[1], last[2]), (found[2], last[1])):
                    # By key: the last base span (-1: none), then other mentions since.
                    for before in filter(None, map(others.get, own)):
                        for t in before if is_base else {before[0], before[-1]}:
                            links.update((t, x) for x in range(first, stop) if t >= 0)
            for _, stop, found in mentions:
                for own, others in zip(found, last, strict=True):
                    for key in own:
                        if is_base:
                            others[key] = [stop - 1]
                        else:
                            others.setdefault(key, [-1]).append(stop - 1)
            i = j
        return sorted(links)


def _onehot(form: np.ndarray) -> np.ndarray:
    return (form[:, None] >> np.arange(FEATURES) & 1).astype(float)


def _parts(n: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connected part of each of n tokens, and how many tokens each part has."""
    label = np.arange(n)
    while len(ends):
        low, new = np.minimum(label[ends[:, 0]], label[ends[:, 1]]), label.copy()
        for side in (ends[:, 0], ends[:, 1], label[ends[:, 0]], label[ends[:, 1]]):
            np.minimum.at(new, side, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label, np.bincount(label, minlength=n)


@dataclass
class Field:
    """Log-potentials: of a form with a label, of two neighbours' labels, and of repetitions that agree."""

    form: np.ndarray
    chain: np.ndarray
    skip: float

    def marginals(self, g: Graph, rounds: int | None = None, damping: float = 0.3) -> np.ndarray:
        """Each token's label distribution by loopy message passing, until it settles.

        A connected part of the graph may take as many rounds as evidence needs to
        cross it several times; a part that has settled leaves the next rounds.
        """
        own = _onehot(g.form) @ self.form
        fixed = g.known >= 0
        own[fixed] = -60.0
        own[fixed, g.known[fixed]] = 0.0
        n_chain, ends = len(g.chain), np.concatenate((g.chain, g.skip))
        agree = self.skip * np.eye(LABELS)
        forward = np.concatenate((np.tile(self.chain, (n_chain, 1, 1)), np.tile(agree, (len(g.skip), 1, 1))))
        source = np.concatenate((ends[:, 0], ends[:, 1]))
        target = np.concatenate((ends[:, 1], ends[:, 0]))
        links = np.concatenate((forward, forward.transpose(0, 2, 1)))
        back = np.roll(np.arange(len(source)), len(ends))
        part, size = _parts(len(own), ends)
        most = (60 + 4 * size if rounds is None else np.full(len(size), rounds))[part[source]]
        message = np.zeros((len(source), LABELS))
        open_, done = np.arange(len(source)), 0
        while len(open_ := open_[most[open_] > done]):
            belief = own.copy()
            np.add.at(belief, target, message)
            sent = (belief[source[open_]] - message[back[open_]])[:, :, None] + links[open_]
            top = sent.max(axis=1, keepdims=True)
            new = np.log(np.exp(sent - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.zeros(len(size))
            np.maximum.at(moved, part[source[open_]], np.abs(new - message[open_]).max(axis=1))
            message[open_] = damping * message[open_] + (1 - damping) * new
            open_, done = open_[moved[part[source[open_]]] >= 1e-4], done + 1
        belief = own.copy()
        np.add.at(belief, target, message)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def _grouped(digits: str, sign: str) -> str:
    return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def second_mentions(kind: int, text: str) -> list[str]:
    """Other ways to write what a pattern has found, that no pattern finds."""
    digits = _digits(text)
    if kind == 0:
        local, _, domain = text.partition("@")
        return [f"{local[0]}***@{domain}", *[x for x in [local] if len(x) >= 4 and _digits(x)]]
    if kind == 1:
        parts = text.split(".")
        return ["-".join(parts), ".".join([*parts[:3], "x"]), ".".join([*parts[:3], "*"])]
    if kind == 2:
        hidden = len(digits) - 4
        return [_grouped(digits, "."), _grouped(digits, "/"), digits[:8], digits[:10], "*" * hidden + digits[-4:], _grouped("x" * hidden + digits[-4:], "-"), "xxxx " + digits[-4:]]
    own = digits[-10:]
    return [own, f"{own[:-7]}-{own[-7:-4]}-{own[-4:]}", f"{own[:-7]}.{own[-7:-4]}.{own[-4:]}", f"***-***-{digits[-4:]}"]


LUHN = 1 << (2 + len(SIZES) + FLAGS.index("luhn"))


def _examples(texts: Iterator[str]) -> Counter:
    """How often a token's label goes with its form, its neighbours' labels and its repetitions' labels.

    What a pattern found also counts in the ways that no pattern finds (and, if
    it passes a check digit, as one that fails it): with its own label beside a
    mention of that label, and as nothing by itself. Tokens beside a found
    mention of theirs that are not found themselves are left out, as their label
    is not known.
    """
    seen: Counter = Counter()
    for text in texts:
        if not MARK.search(text):
            continue
        base = base_spans(text)
        g = Graph.of(text, base)
        label = np.maximum(g.known, 0)
        left, right = np.full(len(label), -1), np.full(len(label), -1)
        left[g.chain[:, 1]], right[g.chain[:, 0]] = label[g.chain[:, 0]], label[g.chain[:, 1]]
        near = np.zeros((len(label), LABELS), np.int64)
        np.add.at(near, (g.skip[:, 1], label[g.skip[:, 0]]), 1)
        np.add.at(near, (g.skip[:, 0], label[g.skip[:, 1]]), 1)
        sure = (g.known >= 0) | (near[:, 1:].sum(axis=1) == 0)
        rows = zip(label.tolist(), g.form.tolist(), left.tolist(), right.tolist(), map(tuple, np.minimum(near, 3).tolist()), strict=True)
        seen.update(row for row, ok in zip(rows, sure.tolist(), strict=True) if ok)
        own = {(k, f) for k, f in zip(label.tolist(), g.form.tolist(), strict=True) if k}
        none = (0,) * LABELS
        for kind, a, b in base:
            forms = {features(x) for x in second_mentions(kind, text[a:b])}
            if kind == 2:
                forms.add(features(_digits(text[a:b])) & ~LUHN)
            beside = tuple(int(x == kind + 1) for x in range(LABELS))
            for f in forms:
                if (kind + 1, f) not in own:
                    seen[kind + 1, f, -1, -1, beside] += 1
                    seen[0, f, -1, -1, none] += 1
    return seen


#: Counted examples whose features are held at a time while fitting.
EXAMPLES = 1 << 11
#: Parameters: of a form with a label, of two neighbours' labels, of agreement.
SIZE = FEATURES * LABELS + LABELS * LABELS + 1


def slope(examples: list[tuple], theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Pseudo-log-likelihood of counted examples, its gradient and (negative) curvature."""
    value, first, second = 0.0, np.zeros(SIZE), np.zeros((SIZE, SIZE))
    for at in range(0, len(examples), EXAMPLES):
        part = examples[at : at + EXAMPLES]
        y, form, left, right = (np.array([e[i] for e in part], np.int64) for i in range(4))
        near, n, rows = np.array([e[4] for e in part], float), np.array([e[5] for e in part], float), np.arange(len(part))
        x = np.zeros((len(part), LABELS, SIZE))
        for k in range(LABELS):
            x[:, k, k : FEATURES * LABELS : LABELS] = _onehot(form)
            has = left >= 0
            x[rows[has], k, FEATURES * LABELS + left[has] * LABELS + k] += 1
            has = right >= 0
            x[rows[has], k, FEATURES * LABELS + k * LABELS + right[has]] += 1
        x[:, :, -1] = near
        logits = x @ theta
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        value += float(n @ (logits[rows, y] - np.log(p.sum(axis=1))))
        p /= p.sum(axis=1, keepdims=True)
        mean = np.einsum("nk,nks->ns", p, x)
        first += n @ (x[rows, y] - mean)
        spread, mean = (np.sqrt(n[:, None] * p)[:, :, None] * x).reshape(-1, SIZE), np.sqrt(n)[:, None] * mean
        second += spread.T @ spread - mean.T @ mean
    return value, first, second


def fit(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], rounds: int = 60, ridge: float = 1.0, skip: float = 3.0) -> Field:
    """Potentials by pseudo-likelihood with a ridge around 0 (for repetitions: around `skip`), from what slope() sums over all examples, by Newton's steps."""
    start = np.zeros(SIZE)
    start[-1] = skip
    theta = best = start
    before, step = -np.inf, start
    for _ in range(rounds):
        value, first, second = sums(theta)
        value -= ridge / 2 * float(((theta - start) ** 2).sum())
        if value < before - 1e-9 * abs(before):
            step = step / 2
            theta = best + step
            continue
        best, before = theta, value
        step = np.linalg.solve(second + ridge * np.eye(SIZE), first - ridge * (theta - start))
        if np.abs(step).max() < 1e-5:
            break
        theta = best + step
    form, chain = best[: FEATURES * LABELS].reshape(FEATURES, LABELS).copy(), best[FEATURES * LABELS : -1].reshape(LABELS, LABELS)
    if not before:
        form[0, 0] = 5.0  # nothing to learn from: everything is other
    return Field(form, chain, float(best[-1]))


EXAMPLE = "y int, form long, l int, r int, near array<int>, n long"


def train(df: DataFrame, text_col: str = "text") -> Field:
    """Potentials from the tokens of all texts, labelled by the base spans.

    Tokens are counted by form and surroundings; all that occur go into the fit.
    The counts stay in Spark: each step of the fit sums a gradient and a
    curvature (SIZE and SIZE * SIZE numbers) over them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen += _examples(t.as_py() for t in batch.column(0) if t.is_valid)
        if seen:
            rows = [[*k[:4], list(k[4]), n] for k, n in seen.items()]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["y", "form", "l", "r", "near", "n"])

    found = df.select(F.col(text_col).cast("string")).mapInArrow(run, EXAMPLE)
    counted = materialize(found.groupBy("y", "form", "l", "r", "near").agg(F.sum("n").alias("n")))
    counted = counted.coalesce(1 + counted.count() // (EXAMPLES * 16))

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + SIZE + SIZE * SIZE)
            for batch in batches:
                examples = [(y, form, left, right, tuple(near), n) for y, form, left, right, near, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                total += np.concatenate([np.ravel(x) for x in slope(examples, theta)])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        # A row of fixed size for each of the counts' partitions.
        total = sum((np.frombuffer(r.sums) for r in counted.mapInArrow(add, "sums binary").toLocalIterator()), np.zeros(1 + SIZE + SIZE * SIZE))
        return float(total[0]), total[1 : 1 + SIZE], total[1 + SIZE :].reshape(SIZE, SIZE)

    return fit(sums)


def find_spans(text: str, field: Field, least: float = 0.5) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind, then start. Added spans overlap no base span."""
    if not MARK.search(text):
        return []
    base = base_spans(text)
    out = [(*s, True) for s in base]
    g = Graph.of(text, base)
    if (g.known < 0).any():
        share = field.marginals(g)
        label = share.argmax(axis=1)
        label[(share.max(axis=1) < least) | (g.known >= 0)] = 0
        joined = set(map(tuple, g.chain.tolist()))
        i = 0
        while i < len(label):
            j = i + 1
            if label[i]:
                while j < len(label) and label[j] == label[i] and (j - 1, j) in joined:
                    j += 1
                out.append((int(label[i]) - 1, g.spans[i][0], g.spans[j - 1][1], False))
            i = j
    return sorted(out)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def find(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): personal data of each whole text, in code points, the end exclusive.

    Null and empty texts have no spans; ids may be null or repeat; an empty
    table gives no rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": x} for k, a, b, x in find_spans(t.as_py() or "", shared.value)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, spans {SPANS}")


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span (of overlapping ones the whole stretch) replaced by its kind in brackets."""
    out, at = [], 0
    stretches: list[list] = []
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if stretches and a < stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], b)
        else:
            stretches.append([a, b, kind])
    for a, b, kind in stretches:
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(df: DataFrame, field: Field, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, personal data in the text replaced by its kind; length_col (if there is one) is the new text's length.

    Null and empty texts stay as they are; rows that repeat are all returned; an
    empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t, find_spans(t, shared.value)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = df.mapInArrow(run, df.schema)
    return out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType)) if length_col in df.columns else out


def op4_skip_chain(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, train(docs))
    base = F.filter("spans", lambda s: s.base)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op4_skip_chain": op4_skip_chain}
