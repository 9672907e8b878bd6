"""Ways to keep one hot key from landing in one task.

A hot key is one with more than ``limit`` rows. At most ``rows / limit`` keys can be hot, so the
table of hot keys is small by arithmetic; Spark decides how to join it. When no key is hot that table is
empty and the plain plan is used.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

HOT_ROWS = 1_000_000
TASK_ROWS = 1_000_000  # of a task that sorts or hashes them
STEP = 128  # cuts are searched coarse first, then within one step


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than ``limit`` rows, with their row counts (map-side combined)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot_n")).filter(F.col("_hot_n") > limit)


BOUNDED = "bounded"  # passed as ``hot`` where a cap or a contract already bounds every group


def find_hot(df: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame | str:
    """The table of hot keys, or ``BOUNDED`` when there are none.

    One counting pass over the key columns runs here, so that the usual plan stays a plain window
    or join; only the largest count comes back.
    """
    largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot_n")).agg(F.max("_hot_n")).collect()[0][0]
    if largest is None or largest <= limit:
        return BOUNDED
    ensure_checkpoint_dir(df.sparkSession)
    return hot_keys(df, keys, limit).checkpoint()


def dealt(df: DataFrame, keys: list[str], rows: int | None = None, most: int = TASK_ROWS) -> DataFrame:
    """``df`` hashed by ``keys`` into as many partitions as keep about ``most`` rows in one, so that a task's share does not grow.

    ``rows``: how many there are; counted here if not given. Never fewer partitions than the session's.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), *keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: Column, right_id: Column,
                limit: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join in which both sides of a hot key are spread over a salt grid.

    A key with ``nl`` left slices and ``nr`` right slices becomes ``nl * nr`` cells; each pair
    meets in exactly one of them. Without hot keys this is the plain join. Other columns of the
    two sides must have different names.
    """
    both = (left.select(F.lit(0).alias("_side"), *keys).unionByName(right.select(F.lit(1).alias("_side"), *keys))
            .groupBy("_side", *keys).agg(F.count(F.lit(1)).alias("_hot_n")).groupBy("_side").agg(F.max("_hot_n")))
    largest = dict(map(tuple, both.collect()))  # two numbers
    hot_left = find_hot(left, keys, limit) if largest.get(0, 0) > limit else BOUNDED
    hot_right = find_hot(right, keys, limit) if largest.get(1, 0) > limit else BOUNDED
    if hot_left is BOUNDED and hot_right is BOUNDED:
        return left.join(right, keys)

    def slices(hot: DataFrame | str, side: DataFrame, name: str) -> DataFrame:
        if hot is BOUNDED:
            hot = side.select(*keys).limit(0).withColumn("_hot_n", F.lit(0))
        return hot.select(*keys, F.ceil(F.col("_hot_n") / limit).cast("int").alias(name))

    grid = (slices(hot_left, left, "_nl").join(slices(hot_right, right, "_nr"), keys, "full_outer")
            .select(*keys, F.coalesce("_nl", F.lit(1)).alias("_nl"), F.coalesce("_nr", F.lit(1)).alias("_nr")))

    def spread(df: DataFrame, own: str, other: str, ident: Column, own_salt: str, other_salt: str) -> DataFrame:
        df = df.join(grid, keys, "left")
        df = df.withColumn(own_salt, F.when(F.col(own) > 1, F.pmod(F.xxhash64(ident), F.col(own)))
                           .otherwise(F.lit(0)).cast("int"))
        return df.withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
                             ).drop("_nl", "_nr")

    cells_left = spread(left, "_nl", "_nr", left_id, "_ls", "_rs")
    cells_right = spread(right, "_nr", "_nl", right_id, "_rs", "_ls")
    return cells_left.join(cells_right, [*keys, "_ls", "_rs"]).drop("_ls", "_rs")


def group_stats(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """``df`` with whole-group aggregates attached, whatever the group sizes.

    Partial aggregation runs before the shuffle and the join back can be split by adaptive skew
    handling; a whole-partition window would pull each group into one task.
    """
    stats = df.groupBy(*keys).agg(*aggregates)
    return df.join(stats, keys)


def with_stats(df: DataFrame, keys: list[str], stats: dict[str, Column], hot: DataFrame | str) -> DataFrame:
    """Whole-group aggregates by window where groups are bounded, by aggregate and join otherwise."""
    if hot is BOUNDED:
        window = Window.partitionBy(*keys)
        return df.select("*", *[c.over(window).alias(name) for name, c in stats.items()])
    return group_stats(df, keys, *[c.alias(name) for name, c in stats.items()])


def _slice_of(cuts: str, coarse: str, value: Column) -> Column:
    """How many cuts are at or before ``value``: a search over every ``STEP``-th cut, then over one step."""
    steps = F.size(F.filter(coarse, lambda c: c <= value))
    inside = F.size(F.filter(F.slice(F.col(cuts), (steps - 1) * STEP + 1, F.lit(STEP)), lambda c: c <= value))
    return F.when(steps == 0, F.lit(0)).otherwise((steps - 1) * STEP + inside)


def _sliced(hot_rows: DataFrame, keys: list[str], orders: dict[str, list[Column]], limit: int) -> DataFrame:
    """Number the rows of hot groups slice by slice, one column per order.

    Slice boundaries come from a hash-chosen subset of the sort keys, so they depend on the data
    alone and a re-run task sees the same slices. The subset only places the cuts: every row is
    numbered, and each slice is shifted by the sizes of those before it.
    """
    names = list(orders)
    keyed = hot_rows.withColumns({f"_ord_{n}": F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(orders[n])]) for n in names})
    wanted = F.ceil(F.col("_hot_n") * 2 / limit)
    stride = F.greatest(F.lit(1), F.floor(F.col("_hot_n") / wanted))
    cuts = keyed.groupBy(*keys).agg(*[
        F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64(f"_ord_{n}"), stride) == 0, F.col(f"_ord_{n}")))).alias(f"_cuts_{n}")
        for n in names])
    cuts = cuts.withColumns({f"_coarse_{n}": F.filter(f"_cuts_{n}", lambda c, i: i % STEP == 0) for n in names})
    sliced = keyed.join(cuts, keys)  # 2 * rows / limit entries per hot key and order
    sliced = sliced.withColumns({f"_slice_{n}": _slice_of(f"_cuts_{n}", f"_coarse_{n}", F.col(f"_ord_{n}")) for n in names})
    sliced = sliced.drop(*[f"_{kind}_{n}" for n in names for kind in ("cuts", "coarse")])
    # the widest input of this plan, used once per order below
    ensure_checkpoint_dir(hot_rows.sparkSession)
    sliced = sliced.checkpoint()
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    out = sliced
    for n in names:
        sizes = sliced.groupBy(*keys, F.col(f"_slice_{n}").alias("_slice")).agg(F.count(F.lit(1)).alias("_size"))
        shifts = sizes.select(*keys, F.col("_slice").alias(f"_slice_{n}"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
        inner = Window.partitionBy(*keys, f"_slice_{n}").orderBy(f"_ord_{n}")
        out = (out.join(shifts, [*keys, f"_slice_{n}"])
               .withColumn(n, (F.row_number().over(inner) + F.col("_shift")).cast("bigint"))
               .drop("_shift", f"_slice_{n}", f"_ord_{n}"))
    return out


def numbered_many(df: DataFrame, keys: list[str], orders: dict[str, list[Column]], limit: int = HOT_ROWS,
                  hot: DataFrame | str | None = None) -> DataFrame:
    """1-based positions of every row inside its group, one column per named order.

    An order holds ascending sort expressions and must be total; negate a number to sort it
    descending. Ordinary groups share one shuffle for all orders; hot groups are sliced.
    """
    hot = find_hot(df, keys, limit) if hot is None else hot
    window = Window.partitionBy(*keys)
    positions = [F.row_number().over(window.orderBy(*order)).cast("bigint").alias(name) for name, order in orders.items()]
    if hot is BOUNDED:
        return df.select("*", *positions)
    few = hot  # at most rows / limit keys; whether that is small enough to broadcast is for Spark to tell
    ordinary = df.join(few.drop("_hot_n"), keys, "left_anti").select("*", *positions)
    placed = _sliced(df.join(few, keys), keys, orders, limit)
    return ordinary.unionByName(placed.select(*ordinary.columns))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", limit: int = HOT_ROWS,
             hot: DataFrame | str | None = None) -> DataFrame:
    """``numbered_many`` with a single order."""
    return numbered_many(df, keys, {name: order}, limit, hot)


def block_offsets(df: DataFrame, row: str, length: Column, name: str, block: int = HOT_ROWS) -> DataFrame:
    """Exclusive running sum of ``length`` in the order of the integer column ``row``.

    Rows are cut into blocks of consecutive positions; only one total per block crosses blocks.
    """
    cut = df.withColumn("_block", F.floor(F.col(row) / block))
    inner = Window.partitionBy("_block").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_block").agg(F.sum(length).alias("_total"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    return (cut.join(shifts, "_block")
            .withColumn(name, F.coalesce(F.sum(length).over(inner), F.lit(0)) + F.col("_shift")).drop("_block", "_shift"))


def bucketed_running_total(df: DataFrame, bucket: str, order: list[Column], value: Column, name: str,
                           limit: int = HOT_ROWS) -> DataFrame:
    """Inclusive running sum over a whole table whose integer ``bucket`` follows the sort order.

    Buckets are summed apart, so a table-wide order needs no single task; only one total per
    bucket crosses buckets, and a bucket that is itself hot is sliced.
    """
    inside = running_total(df, [bucket], order, value, "_inside", limit)
    totals = df.groupBy(bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    return inside.join(shifts, bucket).withColumn(name, F.col("_inside") + F.col("_shift")).drop("_inside", "_shift")


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str,
                  limit: int = HOT_ROWS, hot: DataFrame | str | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order``; group sizes are handled as in ``numbered_many``."""
    hot = find_hot(df, keys, limit) if hot is None else hot
    if hot is BOUNDED:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value).over(window))
    spaced = numbered(df, keys, order, "_rn", limit, hot).withColumn("_block", F.floor((F.col("_rn") - 1) / limit))
    inner = Window.partitionBy(*keys, "_block").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    sums = spaced.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    return (spaced.join(shifts, [*keys, "_block"])
            .withColumn(name, F.sum(value).over(inner) + F.col("_shift"))
            .drop("_rn", "_block", "_shift"))


def tie_ranks(df: DataFrame, keys: list[str], score: str, limit: int = HOT_ROWS,
              hot: DataFrame | str | None = None) -> DataFrame:
    """Attach ``n`` (group size), ``above`` (rows with a higher score) and ``tied`` (equal rows, self included).

    With a hot group, exact ties are first folded into one run per (group, score), so a huge tie
    costs one row.
    """
    hot = find_hot(df, keys, limit) if hot is None else hot
    if hot is BOUNDED:
        group = Window.partitionBy(*keys)
        return df.select("*", F.count(F.lit(1)).over(group).alias("n"),
                         (F.rank().over(group.orderBy(F.desc(score))) - 1).cast("bigint").alias("above"),
                         F.count(F.lit(1)).over(Window.partitionBy(*keys, score)).alias("tied"))
    runs = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("tied"))
    totals = running_total(runs, keys, [-F.col(score)], F.col("tied"), "_upto", limit)
    sizes = runs.groupBy(*keys).agg(F.sum("tied").alias("n"))
    placed = totals.join(sizes, keys).withColumn("above", F.col("_upto") - F.col("tied")).drop("_upto")
    return df.join(placed, [*keys, score])
