"""How filters of documents interact: what each removes in every order.

A document's failures are a mask of bits. Per part, counts of masks become
counts of survivors for every subset of filters by the subset-zeta transform;
a step of an order is the difference between two neighbouring subsets.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Word separators, and what is counted or looked for.
SPACE, CAPITAL, MARKS = "[\\x20\\x09-\\x0D]+", "[A-Z]", "[#$%&*|]"
NAMES = "ABCDE"
REPEAT = 1 << NAMES.index("E")


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text: under 200 words; under half of them different; over 3 % capitals; holds a mark."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    fails = [
        n < 200,
        F.size(F.array_distinct(words)) * F.lit(100) < n * F.lit(50),
        F.regexp_count(text, F.lit(CAPITAL)) * F.lit(100) > F.length(text) * F.lit(3),
        text.rlike(MARKS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of docs (doc_id, text, lang) and labels (doc_id, quality, toxic).

    Only the digest of a text goes through the exchanges. Equal texts of a part
    and with equal labels are counted together before they meet, so that a text
    with very many copies is a few rows; all of them but those with the smallest
    id fail as repeats. Rows without an id come before none and after none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), own_failures(text).alias("mask"))
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    keys = ["digest", "mask", "part", "quality", "toxic"]
    marked = rows.join(marks, "doc_id", "left").na.fill(0, ["quality", "toxic"])
    by_id = marked.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    alike = by_id.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"), least)
    # Of a text there is a row for each part and label at most.
    of_text = F.collect_list(F.struct("part", "quality", "toxic", "n", "without", "least"))
    texts = alike.groupBy("digest", "mask").agg(of_text.alias("rows"), F.min("least.doc_id").alias("first"))
    each = texts.select("mask", "first", F.inline("rows"))
    stay = F.col("without") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    sides = F.explode(F.array(F.struct(F.col("mask"), stay.alias("n")), F.struct((F.col("mask") + REPEAT).alias("mask"), (F.col("n") - stay).alias("n")))).alias("m")
    split = each.select("part", "quality", "toxic", sides).where("m.n > 0")
    n = F.col("m.n")
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("quality")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def survivors(counts: Column, filters: int) -> Column:
    """For every subset of filters (by its bits) how many pass all of them, from an array of counts by mask.

    The zeta transform adds, bit after bit, to each mask the count without that
    bit; then a mask's entry counts all masks within it, and what survives a
    subset is the entry of the other filters.
    """
    within = F.aggregate(
        F.array(*[F.lit(1 << b) for b in range(filters)]),
        counts,
        lambda done, bit: F.transform(done, lambda x, i: x + F.when(i.bitwiseAND(bit) > 0, F.get(done, i.bitwiseXOR(bit))).otherwise(0)),
    )
    return F.reverse(within)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (a language; null: empty), order of the filters and step; see op13_filter_audit for the columns.

    Null texts are empty. Labels that repeat count if any of them is 1; null
    labels and documents without one are neither good nor toxic. Rows that
    repeat count each; an empty table gives no rows; other columns are ignored.
    """
    k = len(NAMES)
    counts = mask_counts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")), labels.select(F.col("doc_id").cast("long"), "quality", "toxic"))
    entries = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))  # 32 at most
    parts = counts.groupBy("part").agg(entries.alias("by"))
    array = lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda m: F.coalesce(F.try_element_at("by", m.cast("int"))[c], F.lit(0).cast("long")))
    parts = parts.select("part", *[survivors(array(c), k).alias(c) for c in ("n", "good", "toxic")])
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(NAMES)])
    steps = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bits = F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.ascii(x) - ord("A")).cast("int"))
    steps = steps.withColumn("bits", bits)
    steps = steps.withColumn("own", F.get("bits", F.col("step") - 1)).withColumn("now", F.aggregate(F.slice("bits", F.lit(1), F.col("step")), F.lit(0), lambda a, b: a + b))
    was, full = F.col("now") - F.col("own"), (1 << k) - 1
    lost = lambda c: F.get(c, was) - F.get(c, "now")
    steps = steps.select(
        "part", "filter_order", "step", "own",
        F.get("n", "now").alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", "own") - lost("n")).alias("redundant"),
        (F.get("n", full - F.col("own")) - F.get("n", F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
    )
    steps = steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own")))
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Per part, order and step: documents kept after the step and removed by it, those failing its filter that went earlier
    (redundant), failing only its filter (unique_fails), good and toxic ones removed, and its filter's removals over all orders (shapley)."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLES = {
    "op13_filter_audit": """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic, MAP {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) } AS fails
  FROM docs d LEFT JOIN marks m ON m.doc_id = d.doc_id
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), steps AS (SELECT filter_order, step, filter_order[step] AS own FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), walked AS (
  SELECT part, filter_order, step, own, good, toxic, fails[own] AS fails, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) AS many,
    len(list_filter(string_split(left(filter_order, step - 1), ''), lambda x: coalesce(fails[x], false))) > 0 AS earlier
  FROM masks, steps
), counted AS (
  SELECT part, filter_order, step, own, count(*) FILTER (NOT earlier AND NOT fails) AS kept, count(*) FILTER (NOT earlier AND fails) AS removed,
    count(*) FILTER (earlier AND fails) AS redundant, count(*) FILTER (fails AND many = 1) AS unique_fails,
    count(*) FILTER (NOT earlier AND fails AND good = 1) AS good_lost, count(*) FILTER (NOT earlier AND fails AND toxic = 1) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
""",
}
