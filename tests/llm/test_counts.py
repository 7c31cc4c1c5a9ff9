"""Word hashes, sorted runs, the word-pair model, phrases and the filter audit against plain Python."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atlaspark.llm import audit, kneser, phrases, registry, runs, words

from .test_llm import ODD, prose
from .test_queries import run, tables  # noqa: F401

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("most", [1 << 22, 40])
def test_hashes_are_of_whole_words_however_texts_are_cut(most):
    texts = ["Hello World", "", "x" * 100 + " yy", "a\tb  c ", None, "é ü\x0b\x0c", "ab", "cd", "Ab", "b" * 63 + " " + "b" * 64 + " " + "b" * 65, "long Text here " * 50, "a\0 a"] * 3
    for column in (pa.array(texts), pa.array(["skipped", *texts]).slice(1)):
        found, kinds = defaultdict(list), {}
        for block in words.blocks(column, kneser.BREAKS, most):
            starts, ends = words.cut(block, kneser.PARTING)
            rows = block.rows[np.searchsorted(block.edges, starts, "right") - 1]
            for row, a, b, h in zip(rows.tolist(), starts, ends, words.hashes(block.data, starts, ends).tolist(), strict=True):
                found[row].append(block.data[a:b].tobytes().decode())
                assert kinds.setdefault(found[row][-1], h) == h
        assert [found[i] for i in range(len(texts))] == [re.findall(SPACE, lower(t)) for t in texts]
        assert len(set(kinds.values())) == len(kinds)


@pytest.mark.parametrize("width", [1, 2])
def test_runs_are_sorted_counts(width):
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, (5000, width)).astype(np.uint64) * np.uint64(2)
    keys[::3] = keys[0]
    keys[:, 0] %= np.uint64(300)
    found, n = runs.run_lengths(keys)
    want = Counter(map(tuple, keys.tolist()))
    assert [tuple(k) for k in found.tolist()] == sorted(want) and n[:, 0].tolist() == [want[k] for k in sorted(want)]
    back, m = runs.unpack(len(found), runs.pack(found, n), width)
    assert (back == found).all() and (m == n).all()
    none = runs.run_lengths(np.zeros((0, width), np.uint64))
    assert len(none[0]) == len(none[1]) == 0
    with pytest.raises(ValueError, match="mounted"):
        runs.local_path("hdfs://host/shared")


def plain_model(texts):
    """log10 probability of a text's tokens by words alone and by the model, and the counts."""
    uni, pair = Counter(), Counter()
    for t in texts:
        w = ["<", *re.findall(SPACE, lower(t)), ">"]
        uni.update(w)
        pair.update(itertools.pairwise(w))
    starts = uni.pop("<", 0)
    total, kinds = sum(uni.values()), len(uni)

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if min(n) > 0:
            y = n[0] / (n[0] + 2 * n[1])
            d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
            if all(0 < x < k for k, x in enumerate(d, 1)):
                return [0, *d]
        return [0, 0.5, 1, 1.5]

    ahead = Counter(w for _, w in pair)
    d2, d1 = discounts(pair.values()), discounts(ahead.values())
    left, spread = sum(d1[min(c, 3)] for c in ahead.values()), Counter()
    for (u, _), c in pair.items():
        spread[u] += d2[min(c, 3)]
    context = Counter(uni) + Counter({"<": starts})

    def one(w):
        rest = 1 / (kinds + 1)
        return (max(ahead[w] - d1[min(ahead[w], 3)], 0) + left * rest) / len(pair) if pair else rest

    def two(u, w):
        return (max(pair[u, w] - d2[min(pair[u, w], 3)], 0) + spread[u] * one(w)) / context[u] if context[u] else one(w)

    def score(t):
        w = ["<", *re.findall(SPACE, lower(t)), ">"]
        base = sum(math.log10((uni[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w[1:])
        return len(w) - 1, sum(uni[x] > 0 for x in w[1:]), base, sum(math.log10(two(u, x)) for u, x in itertools.pairwise(w))

    return score, total, [*uni, "never seen"], two


def test_op11_is_the_plain_model(spark, tables, monkeypatch):  # noqa: F811
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    score, total, *_ = plain_model(t for i, t, *_ in tables[1] if not held(i))
    found = run(spark, tables, "op11_").collect()
    want = sorted((str(i), held(i), *score(t)) for i, t, *_ in tables[1])
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in found)
    assert len(want) == len(got) and {r.train_tokens for r in found} == {total}
    for a, b in zip(want, got, strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)


def test_the_model_adds_up_to_one_and_hot_words_are_spread(spark, monkeypatch):
    r = random.Random(2)
    texts = [" ".join(r.choice("the the the of a b c d e".split()) for _ in range(r.randint(0, 30))) for _ in range(60)] + ["the " * 500, "", None]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, id int, score int")
    monkeypatch.setattr(kneser, "PART", 300)
    model = kneser.train(df)
    score, _, kinds, two = plain_model(texts)
    assert len(model.pairs.hot) and model.pairs.parts > 3
    for u in ("<", "the", "a", "never seen"):
        assert math.isclose(sum(two(u, w) for w in kinds), 1, rel_tol=1e-9)
    for row in kneser.score(df, model).collect():
        assert np.allclose((row.n_tokens, row.n_known, row.base_score, row.score), score(texts[row.id]))
    other = spark.createDataFrame([(1, "unknown words of the"), (None, None)], "doc_id int, text string")
    assert sorted(round(x.score, 6) for x in kneser.score(other, model).collect()) == sorted(round(score(t)[3], 6) for t in ("unknown words of the", ""))
    nothing = kneser.train(df.limit(0))
    assert [x.score for x in kneser.score(other.limit(1), nothing).collect()] == [0.0]


def test_a_text_in_stretches_scores_as_one(spark, monkeypatch):
    texts = [prose(i, 300) for i in range(3)] + ["word " * 40 + "x" * 900 + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = kneser.train(df)
    whole = {r.id: (r.n_tokens, r.score) for r in kneser.score(df, model).collect()}
    column = pa.array(texts)
    for i, t in enumerate(texts):
        tokens = 0
        last = kneser.START
        for block in words.blocks(column.slice(i, 1), kneser.BREAKS, 64):
            found, home = kneser.tokens(block, last)
            last = found[-1]
            tokens += len(found) - 1
        assert tokens == whole[i][0] == len(t.split()) + 1


def plain_phrases(rows, least, most=2000):
    n, f = Counter(), Counter()
    for lang, text in (("und" if x is None else x, t) for x, t in rows):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    f = {k: c for k, c in f.items() if c >= least}
    out = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1:
            s, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(g == lang and len(q) > len(p) and 100 * c >= 80 * a and inside(q) for (g, q), c in f.items()):
                out[lang].append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:most]))  # noqa: E741


def test_phrases_are_the_plain_ones(spark, monkeypatch):
    r = random.Random(6)
    pool = ["New York", "the", "of", "a b", "c d e f", "Ünï", "x" * 70, "q,", "w.", "\t", "c d\ne", "York"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(200)] + ODD + ["new york " * 300]
    rows = [(i, t, r.choice(["en", "de", None, "", "en"]), "s", i) for i, t in enumerate(texts)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, n long")
    fields = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for least, most, block in ((5, 2000, 1 << 22), (12, 7, 64)):
        monkeypatch.setattr(words, "BLOCK", block)
        got = sorted(tuple(x[c] for c in fields) for x in phrases.mine(df, least, most).collect())
        assert got == plain_phrases([(x[2], x[1]) for x in rows], least, most)
    assert phrases.mine(df.limit(0)).count() == 0


def test_phrases_cross_the_stretches_of_a_long_text():
    class Numbers:
        def numbers(self, found):
            return found

    text = " ".join(random.Random(3).choice(["a", "b", "cc", "d,", "e. "]) for _ in range(400))
    column, langs = pa.array([text, "tail end"]), pa.array(["en", "en"])
    whole = [ids for ids, _ in phrases.encoded(column, langs, Numbers())]
    grams = lambda parts, k: Counter(tuple(ids[i : i + k].tolist()) for ids, known in parts for i in range(max(0, known - k + 1), len(ids) - k + 1) if ids[i : i + k].all())
    old = phrases.blocks
    try:
        phrases.blocks = lambda column, breaks: old(column, breaks, 16)
        parts = list(phrases.encoded(column, langs, Numbers()))
    finally:
        phrases.blocks = old
    assert len(whole) == 1 and len(parts) > 20
    for k in (1, 2, 3, 4):
        assert grams(parts, k) == grams([(whole[0], 0)], k)


def plain_audit(docs, labels):
    least, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        fails = (len(w) < 200) * "A" + (100 * len(set(w)) < 50 * len(w)) * "B" + (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) * "C" + bool(re.search("[#$%&*|]", t)) * "D"
        parts[lang or ""].append((fails + (i is not None and i > least[t]) * "E", i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        steps, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                here = [r for r in rows if x in r[0] and not set(order[:k]) & set(r[0])]
                shapley[x] += len(here)
                kept = sum(not set(order[: k + 1]) & set(f) for f, *_ in rows)
                steps.append((part, order, k + 1, kept, len(here), sum(x in f for f, *_ in rows) - len(here), sum(f == x for f, *_ in rows), sum(g for _, g, _ in here), sum(t for *_, t in here), x))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def test_audit_is_the_plain_one(spark):
    r = random.Random(11)
    texts = [None, "", "a # b", "SHOUTING", prose(1, 250), prose(1, 250), "w " * 250, " ".join(f"w{i}" for i in range(300)), "É|\x1f\xa0x"] + [prose(i, r.randint(1, 260)) for i in range(30)]
    docs = [(i if i % 13 else None, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(200)] + [(5, texts[4], "en"), (5, texts[4], "de"), (5, texts[4], "en"), (900, texts[4], None)]
    labels = [(r.randint(0, 210), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(150)] + [(None, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id int, text string, lang string, mask string, n int")
    marks = spark.createDataFrame(labels, "doc_id int, quality int, toxic int")
    found = audit.audit(df, marks)
    fields = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(tuple(x[c] for c in fields) for x in found.collect()) == plain_audit(docs, labels)
    assert audit.audit(df.limit(0), marks).count() == 0 and audit.audit(df, marks.limit(0)).where("good_lost > 0").count() == 0


def test_survivors_of_every_subset(spark):
    counts = [random.Random(k).randint(0, 9) for k in range(16)]
    got = spark.range(1).select(audit.survivors(F.array(*[F.lit(c).cast("long") for c in counts]), 4).alias("s")).first().s
    assert got == [sum(c for m, c in enumerate(counts) if not m & s) for s in range(16)]


@pytest.mark.parametrize("start", ["op11_", "op12_", "op13_"])
def test_empty_tables(spark, tables, tmp_path, start):  # noqa: F811
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    found = run(spark, (str(tmp_path),), start)
    assert found.count() == 0 and found.columns == run(spark, tables, start).columns
    assert any(n.startswith(start) for n in registry.queries())
