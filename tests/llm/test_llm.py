"""The training-data operators against brute force, round trips and planted cases, on small fixtures."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from atlaspark.llm import ann, bpe, graph, langid, merkle, packing, pii, sharding, simhash, toxicity, warc
from atlaspark.llm.common import new_folder

WORDS = "the of and to in is it that was for on are as with his they at be this have from".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed", "er"]) for _ in range(n))


def documents(spark, texts, first=0):
    """doc_id, text and columns whose names clash with what the operators use inside."""
    rows = [(first + i, t, 1, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, spans string, norm double")


ODD = [None, "", " ", "a", "  two  spaces \n\n", "x" * 5000, prose(1, 3000), prose(2, 40), prose(2, 40), "émigré 中文 🦆"]


# Packing


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 8, 4, 2)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 8)]


def test_best_fit_is_the_plain_best_fit_while_bins_last():
    r = random.Random(4)
    items, fit, plain = [r.randint(1, 50) for _ in range(400)], packing.BestFit(50, 1000), []
    for n in items:
        fit.place(n)
        fits = [i for i, used in enumerate(plain) if used + n <= 50]
        if fits:
            plain[max(fits, key=lambda i: plain[i])] += n
        else:
            plain.append(n)
    assert fit.bins == len(plain)


def test_packing_covers_every_token_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(packing.pieces(documents(spark, ODD), path)).collect()
    own = Tokenizer.from_file(path)
    for i, text in enumerate(ODD):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 2048 for r in mine[1:])
        at = 0
        for r in mine:
            import zlib

            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for part in by.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(packing.pieces(documents(spark, ODD).limit(0), path)).count() == 0


@pytest.mark.parametrize("text", [" " * 2_000_000, "\t" * 2_000_000, "\n" * 2_000_000, "z" * 2_000_000, "a b" + " " * 1_200_000 + "c <|endoftext|>"])
def test_ids_of_long_runs_are_the_tokenizers(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = np.frombuffer(next(packing.TextIds(path).encode([text])), "<u4")
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# Search


@pytest.mark.parametrize("n", [0, 1, 15, 700])
def test_search_recall(spark, n):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 16))
    rows = [(i, [float(v) for v in x[i]], 5) for i in range(n)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0, None] * 8, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm int")
    got = {}
    for q in ann.search(df, F.col("vec_id") % 20 == 0, k=10, books=6, words=32, size=100).collect():
        got.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    hits = total = 0
    for i in range(0, n, 20):
        near = sorted(((-float(x[i] @ x[j]), j) for j in range(n) if j != i))[:10]
        mine = sorted(got.get(i, []))
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert np.allclose([m[2] for m in mine], [float(x[i] @ x[m[1]]) for m in mine])
        hits, total = hits + len({j for _, j in near} & {m[1] for m in mine}), total + len(near)
    assert hits >= 0.9 * total


def test_search_keeps_tiny_huge_repeated_and_odd_vectors(spark):
    tiny = [(i, [1e-170 * (i + 1), 1e-170]) for i in range(40)]
    found = ann.search(spark.createDataFrame(tiny, "vec_id long, embedding array<double>"), "vec_id % 20 = 0", k=3, books=2, words=4, size=40)
    assert found.count() == 6
    huge = [(i, [1e200, 1e200 * i]) for i in range(3)]
    found = ann.search(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), "vec_id = 0", k=3, books=2, words=4, size=8)
    assert sorted(r.vec_id for r in found.collect()) == [1, 2]
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (20, [3.0]), (21, [1.0]), (40, [1.0, 1.0]), (0, [4.0, 0.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 20 = 0", k=9, books=2, words=4, size=8).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found if r.query_id == 20) == [(20, 1, 21, 3.0)]
    assert sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == 40) == [(1, 0, 4.0), (2, 1, 2.0), (3, 0, 1.0), (4, 1, 1.0)]
    assert sum(r.query_id == 0 for r in found) == 8


def test_search_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<double>")
    found = ann.search(df, "vec_id = 40", k=5, books=2, words=4, size=8).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [0, 1, 2, 3, 4]


# Sharding


@pytest.mark.parametrize("texts", [[], ODD, [prose(9, 30)] * 300 + [prose(i, i % 50) for i in range(200)]])
def test_shards_have_equal_bytes_and_gapless_slots(spark, texts):
    rows = sharding.shard(documents(spark, texts), 4).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    order = [(r.shard, r.slot) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    if len(texts) > 100:
        total = sum(r.size for r in rows)
        assert all(abs(sum(r.size for r in part) - total / 4) <= 400 for part in by.values()) and len(by) == 4


# Personal data


def naive_base(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice("0123456789..@@ab +-() 1234_%é\n") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == naive_base(text)
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]


def test_message_passing_is_exact_on_a_tree():
    g = pii.Graph([(0, 1)] * 3, np.array([1, 3, 1]), np.array([-1, -1, 2]), np.array([[0, 1]]), np.array([[1, 2]]))
    r = np.random.default_rng(0)
    field = pii.Field(r.normal(size=(pii.FEATURES, 5)), r.normal(size=(5, 5)), 1.3)
    own = pii._onehot(g.form) @ field.form
    table = np.zeros((5, 5, 5))
    for a, b, c in np.ndindex(5, 5, 5):
        table[a, b, c] = (c == 2) * np.exp(own[0, a] + own[1, b] + field.chain[a, b] + field.skip * (b == c))
    table /= table.sum()
    got = field.marginals(g, rounds=60)
    assert np.allclose(got[0], table.sum(axis=(1, 2)), atol=1e-3) and np.allclose(got[1], table.sum(axis=(0, 2)), atol=1e-3)


def test_evidence_travels_along_a_long_skip_chain():
    n = 40
    g = pii.Graph([(0, 1)] * n, np.array([1] * n), np.array([2] + [-1] * (n - 1)), np.empty((0, 2), np.int64), np.array([(i, i + 1) for i in range(n - 1)]))
    field = pii.Field(np.zeros((pii.FEATURES, 5)), np.zeros((5, 5)), 5.0)
    agree, exact = np.exp(5.0 * np.eye(5)), np.eye(5)[2]
    for at, got in enumerate(field.marginals(g)):
        assert np.allclose(got, exact / exact.sum(), atol=1e-3), at
        exact = exact @ agree / (exact @ agree).sum()


def test_the_fit_sums_all_examples_in_blocks_and_tasks(spark, monkeypatch):
    few = [(i % 5, 1 + 2 * (i % 64), i % 6 - 1, i % 4 - 1, (i % 2, 0, 1, 0, 0), 1 + i % 7) for i in range(300)]
    counted = pii.Counter({e[:5]: 0 for e in few})
    for e in few:
        counted[e[:5]] += e[5]
    whole = pii.fit(lambda theta: pii.slope(few, theta))
    monkeypatch.setattr(pii, "EXAMPLES", 64)
    parts = pii.fit(lambda theta: pii.slope(few, theta))
    monkeypatch.setattr(pii, "_examples", lambda texts: pii.Counter(counted) if list(texts) else pii.Counter())
    tasks = pii.train(documents(spark, ["x 1"]).coalesce(1))
    for other in (parts, tasks):
        assert np.allclose(whole.form, other.form) and np.allclose(whole.chain, other.chain) and np.isclose(whole.skip, other.skip)
    theta = np.concatenate((whole.form.ravel(), whole.chain.ravel(), [whole.skip]))
    _, first, second = pii.slope(few, theta)
    start = np.append(np.zeros(pii.SIZE - 1), 3.0)
    assert np.abs(first - (theta - start)).max() < 1e-3
    move = np.random.default_rng(1).normal(size=pii.SIZE) * 1e-4
    assert np.allclose(pii.slope(few, theta + move)[1] - first, -second @ move, rtol=1e-2, atol=1e-4)


def test_repeated_personal_data_is_found_and_redacted(spark):
    texts = [f"call +1 (36{i % 10}) 555-98{i:02d} or mail a{i}@b.example.com from 10.0.0.{i}" for i in range(60)]
    texts += ["Call +1 (366) 555-9807 now. Then (366) 555-9807 again.", None, "", "Version 2.0."]
    df = documents(spark, texts)
    field = pii.train(df)
    found = {r.id: r.spans for r in pii.find(df, field).collect()}
    assert [(s.kind, s.base) for s in found[60]] == [("phone", True), ("phone", False)]
    assert found[61] == found[62] == found[63] == []
    text = {r.doc_id: r.text for r in pii.redacted(df, field).collect()}
    assert text[60] == "Call [PHONE] now. Then [PHONE] again." and text[61] is None and text[63] == texts[63]
    assert pii.find(df.limit(0), field).count() == 0 and pii.train(df.limit(0)).skip > 0


def test_mentions_that_the_patterns_miss_are_found(spark):
    r = random.Random(9)
    number = lambda: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
    texts = [f"{prose(i, 6)} +1 {number()} {prose(i, 4)}" for i in range(300)] + [f"{prose(i, 5)} version 2.{i % 9}" for i in range(100)]
    field = pii.train(documents(spark, texts))
    missed = [number() for _ in range(40)]
    found = [pii.find_spans(f"write to {m} soon", field) for m in missed]
    assert sum(f == [(3, 9, 9 + len(m), False)] for f, m in zip(found, missed, strict=True)) >= 36
    assert all(pii.find_spans(f"see version 2.{i} there", field) == [] for i in range(9))


def planted_mentions(n):
    """Texts with a found mention, other ways to write it, and look-alikes that belong to nothing: (text, wanted spans)."""
    r, out = random.Random(12), []
    number = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))

    def card(valid):
        while True:
            x = "4" + number(15)
            if pii.luhn(x) == valid:
                return x

    for i in range(n):
        own = card(True)
        phone = f"+1 ({number(3)}) {r.randint(200, 999)}-{number(4)}"
        host, mail = f"{r.randint(11, 250)}.{r.randint(11, 250)}.{r.randint(11, 250)}.{r.randint(11, 250)}", f"jo.{number(3)}@mail{i}.example.com"
        first = [(2, " ".join(own[j : j + 4] for j in range(0, 16, 4))), (3, phone), (1, host), (0, mail)]
        kind, found = first[i % 4]
        second = r.choice([x for x in pii.second_mentions(kind, found) if not x.isalpha()])
        strays = [card(False), "*" * 12 + number(4), f"{r.randint(251, 255)}.{number(2)}.9.x", f"k***@mail{i + 1000}.example.com", f"version 2.{i}", str(r.randint(1900, 2030))]
        r.shuffle(strays)
        parts = [found, second] if i % 3 else [second, found]
        out.append((f"{prose(i, 5)} {parts[0]} {prose(i + 1, 6)} {strays[0]} {prose(i + 2, 4)} {parts[1]} {prose(i + 3, 5)} {strays[1]} of", kind, found, second))
    return out


def test_only_links_find_other_ways_to_write_what_a_pattern_found(spark):
    planted = planted_mentions(400)
    strays = [f"{prose(i, 8)} {4 * 10**15 + 7919 * i} {prose(i, 5)}" for i in range(200)]
    field = pii.train(documents(spark, [*(p[0] for p in planted[:200]), *strays]))
    off = pii.Field(field.form, field.chain, 0.0)
    right = found = 0
    for text, kind, first, second in planted[200:]:
        added = [(k, text[a:b]) for k, a, b, base in pii.find_spans(text, field) if not base]
        found += len(added)
        right += sum(k == kind and x.strip("*x- ") in second for k, x in added)
        assert [x for *x, base in pii.find_spans(text, field) if base] == [list(x) for x in sorted(pii.base_spans(text))]
        assert not [x for x in pii.find_spans(text, off) if not x[3]]
    assert right >= 190 and right >= 0.97 * found
    assert not any(pii.find_spans(x, field) for x in strays[::2] if not pii.base_spans(x))


# WARC


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\n" * 10, "<p>a</p>"]
    rows = [(i, None if i == 1 else f"http://h/{i} \r\n", h, "x") for i, h in enumerate(html)] + [(None, "u", "solo", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    root = new_folder(spark, "warc")
    index = warc.write_archives(pages, root, segment_bytes=400)
    got = {r.page_id: r for r in warc.read_records(index, root).collect()}
    for i, h in enumerate(html):
        body = (h or "").encode()
        same = max(j for j, other in enumerate(html) if (other or "") == (h or ""))
        r = got[i]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if same == i else ("revisit", same))
        if same == i:
            assert bytes(r.payload) == body
    assert got[None].record_type == "response"
    import gzip
    import glob

    for path in glob.glob(root.removeprefix("file://") + "/*.warc.gz"):
        with gzip.open(path) as f:
            assert f.read().count(b"WARC-Date: 20") >= 1
    some = warc.read_records(index.where("page_id IN (1, 5)"), root).collect()
    assert sorted(r.page_id for r in some) == [1, 5]
    assert warc.write_archives(pages.limit(0), new_folder(spark, "warc")).count() == 0


def test_a_repeated_and_a_null_page_share_one_payload(spark):
    rows = [(7, "u", "same"), (7, "v", "same"), (None, "w", "same"), (3, "x", "same"), (7, "y", "other")]
    root = new_folder(spark, "warc")
    got = warc.read_records(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), root), root).collect()
    assert {r.url: (r.record_type, r.refers_to) for r in got} == {"u": ("response", None), "v": ("response", None), "w": ("revisit", 7), "x": ("revisit", 7), "y": ("response", None)}


# Merkle trees


def naive_root(text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    node = lambda kids: sha("1" + "".join(kids))
    paragraphs = [node([sha("0" + g) for g in re.findall(r"[^\n ]*(?: [^\n ]*){0,3}[ \n]?", p) if g]) for p in re.findall(r"[^\n]*\n|[^\n]+", text)]
    return node([node(paragraphs[i : i + 16]) for i in range(0, max(1, len(paragraphs)), 16)])


def test_merkle_roots_and_next_texts(spark):
    texts = [*ODD, "\n".join(prose(i, 5) for i in range(40))]
    df = documents(spark, texts)
    roots = {r.doc_id: r.root for r in merkle.with_tree(df).collect()}
    assert roots == {i: naive_root(t or "") for i, t in enumerate(texts)}
    for per in (1000, 2):
        following = {r.doc_id: r.next_text for r in merkle.with_next_text(df, rows_per_range=per).collect()}
        assert following == {i: texts[(i + 1) % len(texts)] or "" for i in range(len(texts))}
    assert merkle.with_next_text(df.limit(0)).count() == 0


def test_edits_are_located_by_differing_branches(spark):
    lines = [f"line {i} has words" for i in range(50)]
    changed = [*lines[:20], "line twenty is new", *lines[21:]]
    inserted = ["first of all", *lines]
    cases = [(lines, lines, [], []), (lines, changed, [20], [20]), (lines, inserted, [], [0]), (lines, lines[5:], [0, 1, 2, 3, 4], []), ([], lines[:2], [], [0, 1]), ([], [], [], [])]
    df = spark.createDataFrame([(i, "\n".join([*a, ""]) if a else None, "\n".join([*b, ""]) if b else "") for i, (a, b, _, _) in enumerate(cases)], "n int, text string, other string")
    trees = merkle.with_tree(merkle.with_tree(df), "other", "other_")
    got = trees.select("n", merkle.edited_paragraphs("", "other_").alias("gone"), merkle.edited_paragraphs("other_", "").alias("come")).orderBy("n").collect()
    assert [(r.gone, r.come) for r in got] == [(gone, come) for _, _, gone, come in cases]


# Language


def test_code_lengths_are_those_of_the_trees(monkeypatch):
    import math

    rows = [("a", int.from_bytes(b"\n\n\na", "big"), 3), ("a", int.from_bytes(b"\n\nab", "big"), 2), ("b", int.from_bytes(b"\n\n\nb", "big"), 1)]
    model = langid.Model(rows)

    def plain(lang, text):
        seen = {}
        for own, g, n in rows:
            if own == lang:
                g = g.to_bytes(4, "big")
                for k in range(4):
                    c = seen.setdefault(g[3 - k : 3], {})
                    c[g[3]] = c.get(g[3], 0) + n
        s, bits = b"\n\n\n" + text, 0.0
        for i in range(3, len(s)):
            for k in (3, 2, 1, 0):
                c = seen.get(s[i - k : i])
                if c is None:
                    continue
                n, kinds = sum(c.values()), len(c)
                if s[i] in c:
                    bits -= math.log2(c[s[i]] / (n + kinds))
                    break
                bits -= math.log2(kinds / (n + kinds))
            else:
                bits += 8
        return bits

    texts = [b"abab", b"b", b"", b"zz\xff" * 5, b"aab"]
    expected = np.array([[plain(lang, t) for lang in model.langs] for t in texts])
    assert np.allclose(model.bits(texts), expected)
    monkeypatch.setattr(langid, "BLOCK", 3)
    assert np.allclose(model.bits(texts), expected)


def test_languages_are_told_apart(spark):
    rows = [(i, prose(i, 30), "en") for i in range(20)] + [(100 + i, prose(i, 30).translate(str.maketrans("aeiothn", "ouäüßzk")), "xx") for i in range(20)] + [(200, None, "en"), (201, "12 34", None), (202, prose(7, 9), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert all(got[i] == ("en" if i < 100 else "xx") for i in got if i < 200) and got[200] == got[201] == "und" and got[202] == "en"
    kept = {r.doc_id: r.lang for r in langid.keep_known(df, model).collect()}
    assert 200 not in kept and 201 not in kept and kept[202] == "en"
    assert langid.predict(df, langid.train(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_many_grams_leave_a_rare_language_whole(spark):
    noise = np.random.default_rng(4).integers(33, 127, 2_300_000).astype(np.uint8).tobytes().decode()
    rows = [(i, noise[i * 100_000 : (i + 1) * 100_000], "aa") for i in range(23)] + [(100, prose(3, 40), "zz")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = langid.grams([prose(3, 40).encode()])[0]
    assert model.langs == ["aa", "zz"] and np.array_equal(model.trees[1][3][0], np.unique(own))
    assert len(model.trees[0][3][0]) > 2_000_000 and len(model.known) <= langid.READY // 2
    texts = [prose(3, 40).encode(), noise[-5000:].encode()]
    bits = model.bits(texts)
    assert bits[0].argmin() == 1 and bits[1].argmin() == 0
    codes, sizes = langid.grams(texts)
    plain = model._cost(codes)
    assert np.allclose(bits, [plain[: sizes[0]].sum(axis=0), plain[sizes[0] :].sum(axis=0)])


# Near-duplicates


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def union_find(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups_are_exact(spark):
    texts = [*ODD, *[prose(i % 9, 12 + i // 9) for i in range(90)]]
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts), tile_rows=8).collect()}
    prints = [plain_print(t) for t in texts]
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert {i: r.component_id for i, r in rows.items()} == union_find(range(len(texts)), near)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_links_of_long_fingerprints_are_exact():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, (1, 8)).astype(np.uint64)
    a = np.repeat(base, 30, axis=0)
    for row in a:
        for bit in r.integers(0, 512, 60):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    # Sixty differences, all within the first two words.
    close = np.concatenate((base, base))
    close[1, 0] ^= np.uint64((1 << 60) - 1)
    ids = np.arange(30)
    near = [(i, j) for i in range(30) for j in range(i) if int(np.bitwise_count(a[i] ^ a[j]).sum()) <= 95]
    u, v = simhash.local_links(a, a, ids, ids, 95, block_pairs=64)
    assert union_find(range(30), zip(u.tolist(), v.tolist(), strict=True)) == union_find(range(30), near)
    assert [x.tolist() for x in simhash.local_links(close, close, ids[:2], ids[:2], 77)] == [[1], [0]]
    opposite = np.stack((base[0, :4], ~base[0, :4]))
    assert len(simhash.local_links(opposite, opposite, ids[:2], ids[:2], 80)[0]) == 0


def test_one_of_each_group_stays(spark):
    long = prose(5, 400).split()
    near = list(long)
    near[100] = near[250] = "changed"
    texts = [" ".join(long), " ".join(near), " ".join(long), prose(6, 300), None, ""]
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert kept == {0, 3, 4}
    repeated = documents(spark, texts).union(documents(spark, texts))
    assert simhash.keep_one(repeated).count() == 3
    shared = spark.createDataFrame([(1, texts[0], "a"), (1, texts[3], "b"), (None, texts[3], "c"), (None, prose(8, 30), "d"), (2, texts[1], "e")], "doc_id long, text string, key string")
    assert sorted(r.key for r in simhash.keep_one(shared).collect()) == ["a", "b", "d"]
    assert simhash.keep_one(shared.limit(0)).count() == 0


def test_unrelated_short_texts_make_no_candidate_group(spark, monkeypatch):
    """Majorities of few shingles are near each other by chance; sizes and counts tell that they cannot share enough."""
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[(7 * i + 11 * j * j) % 3000] for j in range(6 + i % 3 * 2)) for i in range(300)]
    texts += ["a b c d e f g h i j k l m n", "a b c d e f g h i j k l m"]
    seen = []
    own = simhash.checked
    monkeypatch.setattr(simhash, "checked", lambda members, *rest: seen.append(members.count()) or own(members, *rest))
    assert simhash.keep_one(documents(spark, texts), tile_rows=64).count() == 301
    assert seen == [2]


def test_a_group_of_many_tiles_is_checked_as_a_whole(spark):
    texts = [f"{prose(7, 60)} copy {i} of many" for i in range(40)] + [prose(30 + i, 60) for i in range(10)]
    rows = [(i, 0, len(simhash.shingle_set(t, 5)), t, *simhash.majority([simhash.shingle_set(t, 5)], 2).view(np.int64).tolist()) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "node long, group long, size long, text string, w0 long, w1 long")
    found = {r.node: r.component for r in graph.components(simhash.checked(members, 5, simhash.radius_of(0.8, 128), 0.8, tile_bytes=2000)).collect()}
    assert found == dict.fromkeys(range(1, 40), 0)


def test_kept_documents_are_those_of_all_pairs(spark):
    r, texts = random.Random(8), []
    for i in range(60):
        words = prose(100 + i, r.choice([6, 9, 14, 25, 60, 200])).split()
        texts.append(" ".join(words))
        for _ in range(5):
            near = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 22))):
                near[r.randrange(len(near))] = f"w{r.randrange(9)}"
            texts.append(" ".join(near + [texts[0]] * r.randint(0, 1)))
    texts += [f"{prose(7, 40)} copy {i} of many" for i in range(50)]

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    groups = union_find(range(len(sets)), near)
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, texts)).collect()}
    assert kept == {i for i, g in groups.items() if i == g}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 99}


# Byte-level BPE


def test_duckdb_bpe_is_the_library(spark):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "\x1c\x1d x\x1c y", "don't I'LL 'sx ''s", "é́🦆🦆" * 100, "x\r\n\r\n y", "\x85 \x85z\0 \0", "1234 ½ ²a  ٣", "ab" * 700 + " 中文", "word, word. (word). a.\tb", prose(4, 900).replace(" ", ""), "a \0b\0 \0", "\1\n x", " " * 70 + "y" * 70 + "\n" * 70, "word " * 3]
    rows = bpe.decode(bpe.encode(documents(spark, texts), path, pattern), path, pattern).collect()
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.id] or "") and bytes(r.bytes).decode() == (texts[r.id] or "")
    assert len(rows) == len(texts)
    own = bpe.codec(path, pattern)
    words = [w.encode() for w in ("x" * 3000, "ab" * 300, prose(3, 200).replace(" ", ""), "中文" * 100, "aaab" * 80)]
    expected = [library.encode_ordinary(w.decode()) for w in words]
    for sql in (bpe.ENCODE, bpe.ENCODE_LONG, bpe.ENCODE_OPEN):
        part = slice(0, 5) if sql is bpe.ENCODE_LONG else slice(1, 5)
        assert own._query(sql, words[part]).column("ids").to_pylist() == expected[part]
    assert bpe.encode(documents(spark, []), path, pattern, decoded=True).count() == 0


def test_a_word_whose_least_rank_falls_is_done_one_pair_at_a_time(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"cab", b"abcab"]
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own = bpe.Codec(str(path), r"[a-z]+")
    words = [b"abcab" * 30 + b"x", b"ababc" * 40, b"cabab" * 40]
    assert any(own._query(bpe.ENCODE_LONG, words).column("open").to_pylist())

    def plain(word):
        ids = [bytes([b]) for b in word]
        while True:
            ranked = [(own.ranks[ids[i] + ids[i + 1]], i) for i in range(len(ids) - 1) if ids[i] + ids[i + 1] in own.ranks]
            if not ranked:
                return [own.ranks[x] for x in ids]
            _, i = min(ranked)
            ids[i : i + 2] = [ids[i] + ids[i + 1]]

    assert [np.frombuffer(x, np.int32).tolist() for x in own.words(words)] == [plain(w) for w in words]


def test_kept_chunks_are_bounded():
    from atlaspark.llm.text import ChunkBytes

    asked = []

    def learn(chunks):
        asked.extend(chunks)
        return [c.encode() for c in chunks]

    own = ChunkBytes(learn, most_bytes=40_000, longest=10)
    texts = [f"w{i} w{i}, common {'long' * 9}" for i in range(500)]
    for t in [*texts, "a  b", "\n c"]:
        assert b"".join(own.encode([t])) == t.encode()
    assert own.held < 40_000 and len(own.young) + len(own.old) < 300
    assert asked.count(" common") == 1 and asked.count(f" {'long' * 9}") == 500


# Toxicity


def edit_distance(a, b):
    """Letters more, less or other, and swaps of two neighbours, each once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j] + 1, new[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[-1] = min(new[-1], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1][-1]


def test_automaton_finds_the_nearest_word():
    words, r = ["moron", "pathetic", "worthless", "idiot", "abc"], random.Random(1)
    trie = toxicity.Trie(sorted(words))
    for _ in range(2000):
        w = list(r.choice(words))
        for _ in range(r.randint(0, 3)):
            w.insert(r.randint(0, len(w)), r.choice("abcmoi"))
            del w[r.randrange(len(w))]
        if r.random() < 0.5 and len(w) > 1:
            at = r.randrange(len(w) - 1)
            w[at : at + 2] = w[at + 1], w[at]
        w = "".join(w)
        d, word = min((edit_distance(w, x), x) for x in words)
        assert trie.near(w, 2) == ((word, d) if d <= 2 else None)


def test_misspelled_and_quoted_terms(spark):
    clean = [prose(i, 60) for i in range(150)]
    toxic = [prose(i, 50) + " worthless idiot and scumbag, you worthless scumbag idiot" for i in range(60)]
    df = documents(spark, clean + toxic + [None])
    labels = spark.createDataFrame([(i, int(i >= 150)) for i in range(210)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    score = model.score
    assert score(toxic[0]) > 0.9 and score(clean[0]) < 0.1 and score(None) == score("") < 0.3
    assert score(prose(1, 20) + " worthles idi0t scumbaag, wortless") > 0.5
    quoted = prose(1, 20) + ' he said "worthless idiot" and '
    assert score(quoted) < score(quoted.replace('"', ""))
    for quotation in ('"idiot"', 'he said "scumbag" to me', '"worthless idiot scumbag, idiot"'):
        assert score(prose(1, 60) + quotation) < min(toxicity.TOXIC, score(prose(1, 60) + " " + quotation.replace('"', "")))
    for disguised in ("idoit", "1d1ot", "idi0t", "wothless", "worthelss"):
        assert model.lexicon.match(disguised)[0] == "fuzzy", disguised
    assert toxicity.score(df.limit(0), model).count() == 0
    kept = {r.doc_id for r in toxicity.keep_clean(df, model).collect()}
    assert kept == {*range(150), 210}
    assert 0 < toxicity.train(df, labels.limit(0)).score("x") < 1


def test_a_document_predicted_toxic_does_not_stay(spark):
    lexicon = toxicity.Lexicon({"scumbag"}, set(), set())
    for chance, stays in ((0.2, True), (0.4, False), (0.6, False)):
        model = toxicity.Model(lexicon, np.array([np.log(chance / (1 - chance))] + [0.0] * len(toxicity.FEATURES)))
        assert (toxicity.keep_clean(documents(spark, ["a b"]), model).count() == 1) == stays


# The whole pipeline


def test_pipeline_on_planted_documents(spark, tmp_path):
    import corpus_pipeline

    clean = [prose(i, 80) for i in range(120)]
    toxic = [prose(500 + i, 50) + " worthless idiot and scumbag, you worthless scumbag idiot" for i in range(40)]
    planted = [clean[3], clean[3] + " again", "12 34", clean[5] + " call +1 (366) 555-9807"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + toxic + planted)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(120 <= i < 160)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert kept == set(range(120))
