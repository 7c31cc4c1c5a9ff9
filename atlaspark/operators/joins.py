"""Joins by key, by place and by order."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import is_finite
from ..plans.storage import materialize


def upsert(state: DataFrame, update: DataFrame, key: str, defaults: dict) -> DataFrame:
    """All keys of both tables: kept state, and defaults for keys that are new."""
    keys = update.select(key).distinct()
    joined = keys.join(state.withColumn("_old", F.lit(True)), key, "full")
    return joined.select(key, *[F.when(F.col("_old").isNull(), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in defaults.items()])


def with_default(left: DataFrame, right: DataFrame, key: str, values: dict) -> DataFrame:
    """left with right's columns by key, a default where right has no such key."""
    found = left.join(right.select(key, *values, F.lit(True).alias("_hit")), key, "left")
    return found.withColumns({c: F.when(F.col("_hit").isNull(), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit")


def synchronised(frames: DataFrame, cam: str = "cam", idx: str = "idx") -> DataFrame:
    """Indices that every camera has."""
    seen = frames.select(cam, idx).distinct()
    n = seen.agg(F.countDistinct(cam).alias("_n"))
    return seen.groupBy(idx).agg(F.count("*").alias("_c")).crossJoin(F.broadcast(n)).where("_c = _n").select(idx)


def frame_pairs(frames: DataFrame, scheme: str, size: int = 3, cyclic: bool = True, symmetric: bool = False) -> DataFrame:
    """Pairs (src, dst) of frames 0..n-1 in a column `idx`.

    complete: all; swin: each with the next `size`; logwin: with those 1, 2, 4..
    further, `size` steps; oneref: with frame `size`. Windows wrap if cyclic.
    """
    n = frames.agg((F.max("idx") + 1).alias("n"))
    one = frames.select(F.col("idx").alias("src")).distinct().crossJoin(F.broadcast(n))
    if scheme == "complete":
        pairs = one.select("src", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("dst")).where("dst < src")
    elif scheme == "oneref":
        pairs = one.where(F.col("src") != size).select(F.lit(size).alias("src"), F.col("src").alias("dst"))
    else:
        steps = [1 << k for k in range(size)] if scheme == "logwin" else list(range(1, size + 1))
        ahead = one.select("src", "n", F.explode(F.array(*map(F.lit, steps))).alias("step")).select("src", (F.col("src") + F.col("step")).alias("dst"), "n")
        ahead = ahead.withColumn("dst", F.col("dst") % F.col("n")) if cyclic else ahead.where("dst < n")
        pairs = ahead.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    if symmetric:
        pairs = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return pairs


def frame_combinations(frames: DataFrame, step: int, most: int, by: str = "cam", idx: str = "idx") -> DataFrame:
    """(by, src, dst): pairs of a group's frames that are a multiple of `step` and at most `most` apart, both ways."""
    i = frames.select(by, F.col(idx).alias("src")).distinct()
    ahead = i.select(by, "src", F.explode(F.array(*[F.col("src") + s for s in range(step, most + 1, step)])).alias("dst"))
    found = ahead.join(i.withColumnRenamed("src", "dst"), [by, "dst"]).select(by, "src", "dst")
    return found.unionByName(found.select(by, F.col("dst").alias("src"), F.col("src").alias("dst")))


#: Cells further out count as these, so that they are numbers of 64 bits; equal cells only make candidates.
FARTHEST = float(1 << 61)

#: Cells are this much wider than the radius, so that no rounding hides a pair exactly that far apart.
WIDER = 1 + 1e-6


def _cell(c: Column, size: float) -> Column:
    return F.floor(F.greatest(F.least(c / size, F.lit(FARTHEST)), F.lit(-FARTHEST))).cast("long")


def _near_cells(df: DataFrame, coords: list[str], size: float, reach: int) -> DataFrame:
    """Rows repeated for each cell within reach of their own."""
    steps = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"s{a}") for a, s in enumerate(step)]) for step in itertools.product(range(-reach, reach + 1), repeat=len(coords))])
    spread = df.withColumn("_s", F.explode(steps))
    return spread.withColumns({f"_c{a}": _cell(F.col(c), size) + F.col(f"_s.s{a}") for a, c in enumerate(coords)}).drop("_s")


def _own_cell(df: DataFrame, coords: list[str], size: float) -> DataFrame:
    return df.withColumns({f"_c{a}": _cell(F.col(c), size) for a, c in enumerate(coords)})


def _place_lists(df: DataFrame, coords: list[str], name: str) -> DataFrame:
    """(coords.., _cut, name): the other columns of rows in one place, as lists of 8 * LIST_ROWS rows or so at most, numbered by _cut.

    Only places of more rows are cut, by hash, so that a list is bounded however many copies there are.
    """
    other = F.struct(*[c for c in df.columns if c not in coords])
    full = materialize(df.groupBy(*coords).agg(F.ceil(F.count("*") / (8 * LIST_ROWS)).alias("_cuts")).where("_cuts > 1"))
    cut = F.when(F.col("_cuts").isNotNull(), F.pmod(F.xxhash64(other), F.col("_cuts"))).otherwise(F.lit(0))
    # Few of them meet the rows where these are, so that rows are exchanged as lists only.
    full = F.broadcast(full) if full.count() <= FEW_PLACES else full
    return df.join(full, coords, "left").groupBy(*coords, cut.alias("_cut")).agg(F.collect_list(other).alias(name))


def _crowded(df: DataFrame, coords: list[str], size: float, reach: int, name: str) -> DataFrame:
    """(cell.., name): cells with more than TASK_ROWS rows within reach, and how many times TASK_ROWS these are."""
    keys = [f"_c{a}" for a in range(len(coords))]
    found = _own_cell(df, coords, size).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * (2 * reach + 1) ** len(keys) > TASK_ROWS)
    for k in keys:
        found = found.withColumn(k, F.explode(F.sequence(F.col(k) - reach, F.col(k) + reach)))
    return found.groupBy(*keys).agg(F.ceil(F.sum("_n") / TASK_ROWS).alias(name)).where(F.col(name) > 1)


def _even_lists(rows: Column) -> Column:
    """A list as lists of LIST_ROWS rows, the rest as whole eights and what is left over; short ones stay as they are.

    Runs and repeated stretches of eights are what parquet's run-length encoding packs best.
    """
    n, most = F.size(rows), max(LIST_ROWS // 8 * 8, 8)
    whole = n - n % 8
    cut = F.transform(F.sequence(F.lit(0), whole - 1, F.lit(most)), lambda at: F.slice(rows, at + 1, F.least(F.lit(most), whole - at)))
    return F.when(n < 32, F.array(rows)).when(n == whole, cut).otherwise(F.concat(cut, F.array(F.slice(rows, whole + 1, 8))))


def near_places(left: DataFrame, right: DataFrame, left_coords: list[str], right_coords: list[str], radius: float) -> DataFrame:
    """Lists _left and _right of rows in one place each, at most `radius` apart, with both places and column d2.

    Both sides are bucketed into cells twice as wide as the radius; the right
    side is repeated for the cells that a ball around it touches, two an axis,
    so that the join is by equal keys. Copies of a place are joined, and their
    distance is worked out, as one. Cells are dealt over as many tasks as make
    TASK_ROWS rows each, and where more are in one cell, both sides are cut and
    each part meets each. So a task holds few different rows however large the
    tables are, and the columns that it writes stay encoded by dictionary.
    """
    keys, size, context = [f"_c{a}" for a in range(len(left_coords))], radius * WIDER, left.sparkSession.sparkContext
    left, right = left.where(is_finite(*left_coords)), right.where(is_finite(*right_coords))
    tasks = max(-(-max(left.count(), right.count()) // TASK_ROWS), context.defaultParallelism)
    # As many rows as cells are crowded: at most 3 ** axes for every TASK_ROWS rows.
    crowded = F.broadcast(materialize(_crowded(left, left_coords, 2 * size, 0, "_lefts").join(_crowded(right, right_coords, 2 * size, 1, "_rights"), keys, "full")))

    def dealt(lists: DataFrame, coords: list[str], name: str, own: str, other: str) -> DataFrame:
        parts = lambda c: F.coalesce(F.col(c), F.lit(1))
        # By place and cut, as the order of a list may be another when a task is tried again.
        found = lists.join(crowded, keys, "left").withColumn(f"{own}_part", F.pmod(F.xxhash64(*coords, "_cut"), parts(own)))
        found = found.withColumn(f"{other}_part", F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1))).drop(own, other, "_cut")
        # Values of a column side by side take fewer bytes than rows.
        fields = lists.schema[name].dataType.elementType.names
        flat = F.struct(*[F.col(name)[c].alias(c) for c in fields]) if fields else F.col(name)
        return found.withColumn(name, flat).repartition(tasks, *keys, "_lefts_part", "_rights_part")

    own = dealt(_own_cell(_place_lists(left, left_coords, "_left"), left_coords, 2 * size), left_coords, "_left", "_lefts", "_rights")
    near = dealt(_ball_cells(_place_lists(right, right_coords, "_right"), right_coords, size), right_coords, "_right", "_rights", "_lefts")
    d2 = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(left_coords, right_coords, strict=True)), F.lit(0.0))
    pairs = own.join(near, [*keys, "_lefts_part", "_rights_part"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    rows = lambda name: F.arrays_zip(*[F.col(name)[c] for c in fields]) if (fields := getattr(pairs.schema[name].dataType, "names", [])) else F.col(name)
    pairs = pairs.select(*left_coords, rows("_left").alias("_left"), *right_coords, rows("_right").alias("_right"), "d2")
    return pairs.withColumn("_right", F.explode(_even_lists(F.col("_right"))))


def place_rows(pairs: DataFrame) -> DataFrame:
    """All pairs of rows of the lists _left and _right, with the other columns: a left row's pairs stand together, with the right rows in the same order."""
    sides = {side: pairs.schema[side].dataType.elementType.names for side in ("_left", "_right")}
    # A list's only column is expanded as bare values, taken out of its rows once a list.
    bare = {side: names[0] for side, names in sides.items() if len(names) == 1}
    pairs = pairs.select(*[F.col(c)[bare[c]].alias(c) if c in bare else c for c in pairs.columns])
    for side in sides:
        rest = [c for c in pairs.columns if c != side]
        pairs = pairs.select(*rest, F.explode(side).alias(bare[side])) if side in bare else pairs.select(*rest, F.inline(side))
    return pairs


def radius_join(left: DataFrame, right: DataFrame, left_coords: list[str], right_coords: list[str], radius: float) -> DataFrame:
    """Pairs of rows at most `radius` apart, with column d2."""
    pairs = place_rows(near_places(left, right, left_coords, right_coords, radius))
    return pairs.select(*left.columns, *right.columns, "d2")


#: Rows that nearest() compares with all others; open rows whose cells it broadcasts; right rows that a cell is to hold where the search starts.
FEW, FEW_OPEN, CELL_ROWS = 256, 50_000, 8

#: Rows of one place list; places that need more lists which are broadcast; rows of each side that a task of pairs is to hold.
LIST_ROWS, FEW_PLACES, TASK_ROWS = 256, 250_000, 20_000


def _ball_cells(df: DataFrame, coords: list[str], radius: float) -> DataFrame:
    """Rows repeated for each cell, twice as wide as the radius, that lies within it: two an axis."""
    for a, c in enumerate(coords):
        df = df.withColumn(f"_c{a}", F.explode(F.sequence(_cell(F.col(c) - radius, 2 * radius), _cell(F.col(c) + radius, 2 * radius))))
    return df


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_coords: list[str], right_coords: list[str], size: float) -> DataFrame:
    """(left id, right id, d2): the nearest row of right for each row of left, ties to the smaller right id.

    Of right rows in one place only that with the smallest id can be found, so
    that copies count once. The search starts with cells of `size`, or smaller
    ones where these hold more than CELL_ROWS on average, and looks in the
    cells that a ball around each point touches, twice as wide in each round
    (four times once few rows are open), until the best found is nearer than anything outside can be; only rows not
    settled go into the next round. A cell's right rows are lists, so that a
    round passes on one row for each point and list. A round that settles none
    goes on at the gap between both tables' extents. The last FEW rows meet all
    of right at once. Rows with a coordinate that is no finite number take no
    part; without any right row there is no result.
    """
    finite = lambda coords: is_finite(*coords)
    open_, found = materialize(left.where(finite(left_coords)).select(left_id, *left_coords)), None
    right = materialize(right.where(finite(right_coords)).groupBy(*right_coords).agg(F.min(right_id).alias(right_id)))
    keys, radius = [f"_c{a}" for a in range(len(left_coords))], size / 2
    far = lambda get: sum(((F.col(a) - get(b)) * (F.col(a) - get(b)) for a, b in zip(left_coords, right_coords, strict=True)), F.lit(0.0))
    none = open_.crossJoin(right.limit(0)).select(left_id, right_id, far(F.col).alias("d2"))
    extent = lambda df, coords: df.agg(*[f(c).cast("double") for c in coords for f in (F.min, F.max)]).first()
    around = extent(right, right_coords)
    if around[0] is None:
        return none
    loads = lambda cells: cells.groupBy(*keys).count().agg(F.max("count"), F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()
    n, most, mean = open_.count(), None, None
    while n > FEW:
        most, mean = loads(_own_cell(right, right_coords, 2 * radius))
        if mean <= CELL_ROWS:
            break
        smaller = radius * max((CELL_ROWS / 2 / mean) ** (1 / len(keys)), 1e-3)
        if 2 * smaller < 1e-12 * max(map(abs, around)) or smaller == 0:
            break
        radius = smaller
    # Squares of larger ones are no numbers.
    while n > FEW and radius < 1e150:
        asked, cells = _ball_cells(open_, left_coords, radius), _own_cell(right, right_coords, 2 * radius)
        if n <= FEW_OPEN:
            cells = cells.join(F.broadcast(asked.select(*keys).distinct()), keys, "left_semi")
        if most is None:
            most = loads(cells)[0] or 1
        # Lists of a cell by hash, so that the fullest one's have about LIST_ROWS.
        lists = cells.groupBy(*keys, F.pmod(F.xxhash64(right_id), F.lit(-(-most // LIST_ROWS))).alias("_l")).agg(F.collect_list(F.struct(right_id, *right_coords)).alias("_near"))
        nearest_of = F.array_min(F.transform("_near", lambda r: F.struct(far(lambda c: r[c]).alias("d2"), r[right_id].alias(right_id))))
        # A little less than the radius, so that no rounding of cells hides a nearer one.
        best = asked.join(lists, keys).select(left_id, nearest_of.alias("b")).where(F.col("b.d2") <= (radius * (1 - 1e-6)) ** 2)
        best = materialize(best.groupBy(left_id).agg(F.min("b").alias("b")).select(left_id, F.col(f"b.{right_id}").alias(right_id), F.col("b.d2").alias("d2")))
        found = best if found is None else found.unionByName(best)
        open_ = materialize(open_.join(best, left_id, "left_anti"))
        before, n = n, open_.count()
        radius, most = radius * (4 if n <= FEW_OPEN else 2), None
        if n == before:
            own = extent(open_, left_coords)
            radius = max(radius, *(max(own[a] - around[a + 1], around[a] - own[a + 1]) for a in range(0, len(own), 2)))
    if n:
        # FEW rows at most, unless they lie beyond any square: first the least distance, then the smallest id at it, as sums by hash.
        few = F.broadcast if n <= FEW else lambda df: df
        least = materialize(right.crossJoin(few(open_)).withColumn("d2", far(F.col)).groupBy(left_id).agg(F.min("d2").alias("_least")))
        last = right.crossJoin(few(open_.join(least, left_id))).withColumn("d2", far(F.col)).where("d2 = _least").groupBy(left_id).agg(F.min(right_id).alias(right_id), F.min("d2").alias("d2"))
        found = last if found is None else found.unionByName(last)
    return found if found is not None else none


def reciprocal(forth: DataFrame, back: DataFrame, p: str, q: str) -> DataFrame:
    """Pairs that are each other's nearest: forth (p, q) and back (q, p)."""
    return forth.select(p, q, "d2").join(back.select(p, q), [p, q])


def last_of_each(forth: DataFrame, p: str, q: str) -> DataFrame:
    """For each q the last p whose nearest it is: a one-sided stand-in for reciprocity, kept for comparison."""
    return forth.groupBy(q).agg(F.max(p).alias(p))


def nearest_in_order(left: DataFrame, right: DataFrame, left_id: str, at: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Each left row with the value of the right row nearest in `at` (a tie goes to the lower), within groups `by`.

    Both tables are put in one order; the last right row at or before, and the
    first at or after, come from two window frames.
    """
    by = by or []
    l = left.select(*by, F.col(left_id).alias("_id"), F.col(at).alias("_t"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[at].dataType).alias("_rt"), F.lit(1).alias("_left"))  # noqa: E741
    r = right.select(*by, F.lit(None).cast(left.schema[left_id].dataType).alias("_id"), F.col(at).alias("_t"), F.col(value).alias("_v"), F.col(at).alias("_rt"), F.lit(0).alias("_left"))
    own = [F.col(c) for c in by]
    before = Window.partitionBy(*own).orderBy("_t", "_left", "_v").rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, as a frame up to the end is worked out anew for every row.
    after = Window.partitionBy(*own).orderBy(F.desc("_t"), "_left", F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    right_row = F.when(F.col("_left") == 0, F.struct("_rt", "_v"))
    both = l.unionByName(r).withColumn("_a", F.last(right_row, ignorenulls=True).over(before)).withColumn("_b", F.last(right_row, ignorenulls=True).over(after)).where("_left = 1")
    pick: Column = F.when(F.col("_b").isNull() | ((F.col("_t") - F.col("_a._rt")) <= (F.col("_b._rt") - F.col("_t"))), F.col("_a")).otherwise(F.col("_b"))
    return both.withColumn("_p", pick).select(*by, F.col("_id").alias(left_id), F.col("_t").alias(at), F.col("_p._rt").alias(f"{at}_found"), F.col("_p._v").alias(value))
