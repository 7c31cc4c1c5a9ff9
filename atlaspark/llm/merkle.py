"""Merkle-tree fingerprints of documents, with DataFrame operations only.

The tree: word groups of four words, paragraphs (lines), sections of sixteen
paragraphs, root. A parent's digest is the SHA-256 of its children's digests,
with a tag that tells leaves from inner nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_at_or_below, table

PARAGRAPH = r"[^\n]*\n|[^\n]+"
WORD_GROUP = r"[^\n ]*(?: [^\n ]*){0,3}[ \n]?"
SECTION = 16


def _node(children: Column) -> Column:
    return F.sha2(F.concat(F.lit("1"), F.array_join(children, "")), 256)


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x != "")


def leaves(text: Column) -> Column:
    """Digests of the word groups of each paragraph: array<array<string>>. Together they cover every code point."""
    groups = lambda paragraph: F.transform(_pieces(paragraph, WORD_GROUP), lambda x: F.sha2(F.concat(F.lit("0"), x), 256))
    return F.transform(_pieces(text, PARAGRAPH), groups)


def paragraphs(leaf_digests: Column) -> Column:
    return F.transform(leaf_digests, _node)


def sections(paragraph_digests: Column) -> Column:
    last = F.greatest(F.floor((F.size(paragraph_digests) - 1) / SECTION), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: _node(F.slice(paragraph_digests, i * SECTION + 1, SECTION)))


def root(section_digests: Column) -> Column:
    return _node(section_digests)


def likeness(left: Column, right: Column) -> Column:
    """Shared leaves over the larger tree's, counting each distinct leaf once; two empty trees: 1."""
    a, b = F.array_distinct(F.flatten(left)), F.array_distinct(F.flatten(right))
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def edited_paragraphs(left: str = "", right: str = "other_") -> Column:
    """Places (from 0) of the paragraphs of one tree that the other one does not have, by the columns that with_tree() adds under two prefixes.

    Descends only where digests differ: equal roots have no edit, sections that
    the other tree has as they are are left out, and of the others' paragraphs
    those whose digest is nowhere in the other tree are the edits. Paragraphs are
    matched by digest and not by place, so an inserted line is one edit of the
    tree that has it and none of the other. A paragraph that occurs more often
    in one tree than in the other is no edit.
    """
    own, other = (lambda c: F.col(f"{left}{c}")), (lambda c: F.col(f"{right}{c}"))
    n = F.size(own("paragraphs"))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    open_ = F.filter(upto(F.lit(0), F.size(own("sections")) - 1), lambda i: ~F.array_contains(other("sections"), F.get(own("sections"), i)))
    lost = F.array_except(own("paragraphs"), other("paragraphs"))
    within = lambda i: F.filter(upto(i * SECTION, F.least(i * SECTION + SECTION, n) - 1), lambda p: F.array_contains(lost, F.get(own("paragraphs"), p)))
    return F.when(own("root") == other("root"), F.array().cast("array<int>")).otherwise(F.flatten(F.transform(open_, within)))


def with_tree(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add leaves, paragraphs, sections and root of a text column (null: empty text).

    Equal texts have equal roots and different texts different ones; an empty
    text has no paragraph, one section of nothing and a root; long texts only
    make longer arrays. Columns of the same names are replaced.
    """
    leaf, par, sec, top = (f"{prefix}{x}" for x in ("leaves", "paragraphs", "sections", "root"))
    return (
        df.withColumn(leaf, leaves(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
        .withColumn(par, paragraphs(F.col(leaf)))
        .withColumn(sec, sections(F.col(par)))
        .withColumn(top, root(F.col(sec)))
    )


def with_next_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1000, most_ranges: int = 4096) -> DataFrame:
    """Add next_text: the text of the row with the next larger id (after the last, the first).

    Ids are cut into ranges by quantiles. A range's rows are numbered together
    with a copy of the first row of the range after it, so that no window holds
    more than a range. Null texts count as empty; rows with equal ids follow
    each other by a hash of the text; null ids come first, but the row after
    the last is the first one that has an id (the empty text if none has);
    returns id, text, next_text.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = min(most_ranges, max(1, rows.count() // rows_per_range))
    quantiles = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n).alias("q")).first().q if n > 1 else []
    cuts = sorted(set(quantiles or []))
    ranged = rows.withColumn("range", count_at_or_below(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), len(cuts), F.col("id")))
    # At most most_ranges + 1 rows.
    firsts = sorted((r.range, r.id) for r in ranged.groupBy("range").agg(F.min("id").alias("id")).where("id IS NOT NULL").collect())
    copies = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    if not copies:
        copies = [(None, -1)]
    copies = F.broadcast(df.sparkSession.createDataFrame(copies, "first_id long, before int"))
    places = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(1).alias("copy"))))
    spread = (
        ranged.join(copies, ranged["id"] == copies["first_id"], "left")
        .select("id", "text", F.explode(F.array_compact(places)).alias("place"))
        .select("id", "text", "place.range", "place.copy")
    )
    order = Window.partitionBy("range").orderBy("copy", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return (
        spread.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
        .where("copy = 0")
        .select(F.col("id").alias(id_col), F.col("text").alias(text_col), "next_text")
    )


def op6_merkle(spark, sf_dir: str) -> DataFrame:
    pairs = with_next_text(table(spark, sf_dir, "documents"))
    n, m = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - m), F.substring("next_text", F.lit(1), m)))
    trees = with_tree(with_tree(edited), "edited", "edited_").withColumn("next_leaves", leaves(F.col("next_text")))
    return trees.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


_LEAVES = (
    "list_transform(list_filter(regexp_extract_all({t}, '[^\\n]*\\n|[^\\n]+'), lambda p: p <> ''), lambda p: "
    "list_transform(list_filter(regexp_extract_all(p, '[^\\n ]*(?: [^\\n ]*){{0,3}}[ \\n]?'), lambda g: g <> ''), lambda g: sha256('0' || g)))"
)
_ROOT = (
    "sha256('1' || array_to_string(list_transform(range(greatest((len({p}) + 15) // 16, 1)), "
    "lambda i: sha256('1' || coalesce(array_to_string(list_slice({p}, i * 16 + 1, i * 16 + 16), ''), ''))), ''))"
)
_PARAGRAPHS = "list_transform({l}, lambda x: sha256('1' || coalesce(array_to_string(x, ''), '')))"
_LIKENESS = (
    "CASE WHEN greatest(len(list_distinct(flatten({a}))), len(list_distinct(flatten({b})))) = 0 THEN 1.0::DOUBLE ELSE "
    "len(list_intersect(flatten({a}), flatten({b})))::DOUBLE / greatest(len(list_distinct(flatten({a}))), len(list_distinct(flatten({b})))) END"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
nx AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d),
e AS (SELECT *, left(t, length(t) - length(t) // 4) || left(x, length(t) // 4) AS e FROM nx),
l AS (SELECT *, {_LEAVES.format(t="t")} AS tl, {_LEAVES.format(t="e")} AS el, {_LEAVES.format(t="x")} AS xl FROM e),
p AS (SELECT *, {_PARAGRAPHS.format(l="tl")} AS tp, {_PARAGRAPHS.format(l="el")} AS ep FROM l)
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, {_ROOT.format(p="tp")} AS fingerprint,
       {_ROOT.format(p="ep")} AS edited_fingerprint, {_LIKENESS.format(a="tl", b="el")} AS near_edited,
       {_LIKENESS.format(a="tl", b="xl")} AS near_next
FROM p
"""

QUERIES = {"op6_merkle": op6_merkle}
ORACLES = {"op6_merkle": ORACLE}
