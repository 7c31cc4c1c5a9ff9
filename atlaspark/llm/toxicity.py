"""Toxicity by a learned lexicon, Levenshtein automata and the words around a hit.

The lexicon is learned from labelled documents: words and stems that hardly any
clean document has. Its words form a trie; a text's words run against it as
bit-parallel Levenshtein automata, so that misspelled terms are found as well.
Hits that stand within quotation marks, or after a mark that announces a
quotation, only enter a count of their own. A logistic model of the counts,
fitted on the same labelled documents, gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .langid import fold

WORD = re.compile(r"\w+(?:[*@$!#]+\w+)*")
QUOTES = re.compile("[\"“”«»„‟]|(?<!\\w)['‘’]|['‘’](?!\\w)")
#: Letters of the shortest word, the shortest and the longest stem; words of a quotation that no second mark ends.
SHORTEST, STEM, LONGEST_STEM, WINDOW = 3, 4, 16, 6
#: Words from a form to those by which its surroundings are told apart.
APART = 5
#: Signs that stand for letters in disguised words; as those letters they cost no edit.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: The score from which a document counts as toxic.
TOXIC = 0.3
PRIOR = [2.0, 2.0, 1.5, 0.0, 0.5, 0.5]
FEATURES = ["exact", "stem", "fuzzy", "quoted", "kinds", "density"]


def counts(df: DataFrame) -> DataFrame:
    """(form, stem, toxic, clean): documents that hold a word, or a word longer than the stem that begins with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = {w for w in WORD.findall((text.as_py() or "").lower()) if len(w) >= SHORTEST}
                seen[toxic].update((w, False) for w in words)
                seen[toxic].update({(w[:n], True) for w in words for n in range(STEM, min(len(w), LONGEST_STEM) + 1)})
        forms = sorted(set(seen[0]) | set(seen[1]))
        for at in range(0, len(forms), 50_000):
            part = forms[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in part], pa.string()), pa.array([s for _, s in part], pa.bool_()), pa.array([seen[1][f] for f in part], pa.int64()), pa.array([seen[0][f] for f in part], pa.int64())],
                names=["form", "stem", "toxic", "clean"],
            )

    return df.select("text", "toxic").mapInArrow(run, "form string, stem boolean, toxic long, clean long").groupBy("form", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def surroundings(toxic_texts: DataFrame, forms: set[tuple[str, bool]]) -> dict[tuple[str, bool], int]:
    """Between how many different pairs of words, APART words off, each (form, stem) stands where a text of (text) first has it."""
    shared = toxic_texts.sparkSession.sparkContext.broadcast(forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            found = []
            for text in batch.column(0):
                seen = set()
                words = [""] * APART + WORD.findall((text.as_py() or "").lower()) + [""] * APART
                for i in range(APART, len(words) - APART):
                    w = words[i]
                    for form in [(w, False), *((w[:n], True) for n in range(STEM, min(len(w), LONGEST_STEM) + 1))]:
                        if form in wanted and form not in seen:
                            seen.add(form)
                            found.append((*form, f"{words[i - APART]} {words[i + APART]}"))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["form", "stem", "sides"])

    rows = toxic_texts.select("text").mapInArrow(run, "form string, stem boolean, sides string")
    return {(r.form, r.stem): r.n for r in rows.groupBy("form", "stem").agg(F.countDistinct("sides").alias("n")).collect()}


class Trie:
    """Words by letters: children of a node, and the word that ends there."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[str | None] = [None]
        for word in words:
            node = 0
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                node = self.next[node][c]
            self.end[node] = word

    def near(self, word: str, most: int) -> tuple[str, int] | None:
        """The closest word within `most` edits (ties: first in order), by the automaton of `word` run over the trie.

        Bit i of state d: the first i letters are matched with at most d edits.
        An edit is a letter more, less or other, or two neighbours swapped; a
        sign that looks like a letter is that letter.
        """
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            for looks in c + LOOKS.get(c, ""):
                masks[looks] = masks.get(looks, 0) | 1 << i
        limit, accept = (1 << (len(word) + 1)) - 1, 1 << len(word)
        best: tuple[int, str] | None = None
        start = tuple(((1 << (d + 1)) - 1) & limit for d in range(most + 1))
        stack = [(0, start, (0,) * (most + 1), 0)]
        while stack:
            node, states, before, mask_before = stack.pop()
            ended = self.end[node]
            if ended is not None:
                for d, state in enumerate(states):
                    if state & accept:
                        if best is None or (d, ended) < best:
                            best = (d, ended)
                        break
            for c, child in self.next[node].items():
                mask, last, out = masks.get(c, 0), 0, []
                for d, state in enumerate(states):
                    new = (state & mask) << 1
                    if d:
                        new |= states[d - 1] | states[d - 1] << 1 | last << 1 | ((before[d - 1] & mask) << 1 & mask_before) << 1
                    last = new & limit
                    out.append(last)
                if last:
                    stack.append((child, tuple(out), states, mask))
        return (best[1], best[0]) if best else None


def edits(length: int) -> int:
    """Misspellings allowed in a word of so many letters."""
    return 0 if length < 4 else 1 if length < 12 else 2


@dataclass
class Lexicon:
    """Words and stems of toxic documents, and the ordinary words that are never taken for misspellings."""

    words: set[str]
    stems: set[str]
    ordinary: set[str]

    def __post_init__(self):
        self.tries: dict[int, Trie] = {}
        # One edit leaves the first or the last third of a word as it is, two leave the first, the last or some letters between.
        self.ends = ({w[: len(w) // 3] for w in self.words if edits(len(w)) == 1}, {w[len(w) - len(w) // 3 :] for w in self.words if edits(len(w)) == 1})
        self.sizes = tuple(sorted({len(x) for x in ends}) for ends in self.ends)
        self.reach = [(len(w) - edits(len(w)), len(w) + edits(len(w)), edits(len(w))) for w in self.words]
        self.hits: dict[str, tuple[str, str]] = {}
        self.clean: set[str] = set()

    def _look_up(self, words: set[str], most: int = 200_000) -> None:
        """Sort words into hits and clean ones; what is known is kept for the next texts, up to a bound."""
        if len(self.clean) > most:
            self.clean = set()
        if len(self.hits) > most:
            self.hits = {}
        for w in (words - self.clean).difference(self.hits):
            if found := self.match(w):
                self.hits[w] = found
            else:
                self.clean.add(w)

    def _keeps_end(self, word: str) -> bool:
        """Whether an end of the word, read with its signs as letters, is that of an entry that allows one edit."""
        first, last = self.ends
        return any(word[:n] in first for n in self.sizes[0]) or any(word[len(word) - n :] in last for n in self.sizes[1])

    def match(self, word: str) -> tuple[str, str] | None:
        """What kind of hit a lower-case word is, and of which entry."""
        if word in self.words:
            return ("exact", word)
        for n in range(STEM, min(len(word), LONGEST_STEM) + 1):
            if word[:n] in self.stems:
                return ("stem", word[:n])
        if word in self.ordinary or not self._trie(len(word)).next[0]:
            return None
        disguised = not word.isalpha()
        most = max(e for low, high, e in self.reach if low <= len(word) <= high)
        if most == 1 and not disguised and not self._keeps_end(word):
            return None
        found = self._trie(len(word)).near(word, most)
        return ("fuzzy", found[0]) if found and found[1] <= edits(len(found[0])) else None

    def _trie(self, length: int) -> Trie:
        """The words that a word of this length may be a misspelling of."""
        if length not in self.tries:
            self.tries[length] = Trie(sorted(w for w in self.words if abs(len(w) - length) <= edits(len(w))))
        return self.tries[length]

    def features(self, text: str | None) -> list[float]:
        """Counts of a whole text's hits, as logarithms; quoted hits have no part in the kinds and the density."""
        text = (text or "").lower()
        words = WORD.findall(text)
        n, kinds, distinct = Counter(), set(), set(words)
        self._look_up(distinct)
        if not distinct.isdisjoint(self.hits):
            quoted = Quotes(text)
            for m in WORD.finditer(text):
                hit = self.hits.get(m.group())
                if hit and quoted.around(m.start(), m.end()):
                    n["quoted"] += 1
                elif hit:
                    kinds.add(hit[1])
                    n[hit[0]] += 1
        total = n.total() - n["quoted"]
        n["kinds"] = len(kinds)
        return [float(np.log1p(n[f])) for f in FEATURES[:-1]] + [float(np.log1p(1000 * total / max(1, len(words))))]


class Quotes:
    """Where a text quotes: between two quotation marks of one line, or up to WINDOW words after a mark that has no partner."""

    def __init__(self, text: str):
        spans = []
        for line in re.finditer(r"[^\n]+", text):
            marks = [line.start() + m.start() for m in QUOTES.finditer(line.group())]
            spans += list(zip(marks[::2], marks[1::2], strict=False))
            if len(marks) % 2:
                tail = list(WORD.finditer(text, marks[-1], line.end()))[:WINDOW]
                spans.append((marks[-1], tail[-1].end() if tail else marks[-1]))
        self.starts = np.array([a for a, _ in spans], np.int64)
        self.ends = np.array([b for _, b in spans], np.int64)

    def around(self, start: int, end: int) -> bool:
        i = int(np.searchsorted(self.starts, start, "right")) - 1
        return i >= 0 and end <= int(self.ends[i])


def strong_forms(rows: list, toxic: int, clean: int, least: int = 6, odds: float = 30.0) -> list:
    """Forms that at least `least` toxic documents have, at `odds` times the rate of clean ones."""
    return [r for r in rows if r.toxic >= least and (r.toxic + 0.5) / (toxic + 1) >= odds * (r.clean + 0.5) / (clean + 1)]


def build_lexicon(rows: list, strong: list, varied: dict[tuple[str, bool], int], least: int = 6, ordinary_least: int = 2) -> Lexicon:
    """The strong forms that stand in at least `least` different surroundings: copies of one document count once.

    A stem must be shared: half as many documents again must have it as have its
    commonest word. Of stems within each other the shortest is kept. Words of
    ordinary_least or more clean documents are never taken for misspellings.
    """
    strong = [r for r in strong if varied.get((r.form, r.stem), 0) >= least]
    commonest: Counter = Counter()
    for r in rows:
        if not r.stem and r.toxic >= least:
            for n in range(STEM, min(len(r.form), LONGEST_STEM) + 1):
                commonest[r.form[:n]] = max(commonest[r.form[:n]], r.toxic)
    stems: set[str] = set()
    for r in sorted((r for r in strong if r.stem), key=lambda r: (len(r.form), r.form)):
        if r.toxic >= 1.5 * commonest[r.form] and not any(r.form[:n] in stems for n in range(STEM, len(r.form))):
            stems.add(r.form)
    words = {r.form for r in strong if not r.stem}
    ordinary = {r.form for r in rows if not r.stem and r.clean >= ordinary_least and r.form not in words}
    return Lexicon(words, stems, ordinary)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (constant first) of a logistic model, by Newton's method with a ridge around PRIOR.

    What the labelled rows hardly show (misspelled or quoted terms) keeps its prior weight.
    """
    z = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    keep[0, 0], prior = 1e-6, np.array([0.0, *PRIOR])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        """The chance of label 1. Quotation never adds: quoted hits enter one count, and its weight is 0 or less."""
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1:] @ np.array(self.lexicon.features(text)), -30, 30))))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labelled documents, or of the most_rows that come first by a hash of their id.

    Rows without a label, an id or a text teach nothing; a label that repeats
    counts once, the largest; without toxic or without clean rows the score is
    the share of toxic ones (half without any).
    """
    wanted = labels.where("toxic IN (0, 1)").groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    text = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    # At most most_rows ids; their documents are written down, so that the table is read once.
    sample = materialize(text.join(F.broadcast(wanted), id_col).select("text", "toxic"))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    prior = (n1 + 0.5) / (n1 + n0 + 1)
    none = Model(Lexicon(set(), set(), set()), np.array([np.log(prior / (1 - prior))] + [0.0] * len(FEATURES)))
    if not n1 or not n0:
        return none
    # Forms of the labelled sample only: most_rows documents.
    forms = counts(sample).where("toxic >= 5 OR NOT stem AND clean >= 2").collect()
    strong = strong_forms(forms, n1, n0)
    lexicon = build_lexicon(forms, strong, surroundings(sample.where("toxic = 1"), {(r.form, r.stem) for r in strong}))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([shared.value.features(t.as_py()) for t in batch.column(0)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in x.T], batch.column(1)], names=[*FEATURES, "toxic"])

    rows = np.array(sample.mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").collect(), float)
    weights = fit(rows[:, :-1], rows[:, -1])
    quoted = FEATURES.index("quoted") + 1
    weights[quoted] = min(weights[quoted], 0.0)
    return Model(lexicon, weights)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): how likely each whole text is toxic, from 0 to 1.

    Null and empty texts have no hit and get the score of such; ids may be null
    or repeat; an empty table gives no rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["id", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def keep_clean(df: DataFrame, model: Model, least: float = TOXIC, text_col: str = "text") -> DataFrame:
    """The rows whose whole text scores below `least`, with all their columns.

    Null and empty texts have no hit and stay as such texts score; rows that
    repeat are judged alike; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < least for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op10_levenshtein(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    return score(docs, model).select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


QUERIES = {"op10_levenshtein": op10_levenshtein}
