"""Contract audits: each recomputes what was published and reports how often it differs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking


def total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("bigint")), F.lit(0))


def bank_report(df: DataFrame, row: str, mass: str, ident: str, padding_ok: Column, expected_rows: Column | None = None) -> DataFrame:
    """One row of violation counts: mass, padding, repeated ids and order."""
    m = F.col(mass)
    # one pass folded by id, so repeated ids come out of the same aggregation
    per_id = df.groupBy(ident).agg(F.count(F.lit(1)).alias("_n"), total(m.isNull() | F.isnan(m) | (F.abs(m) == float("inf"))).alias("_bad"),
                                   total(m <= 0).alias("_neg"), total(~padding_ok).alias("_pad"))
    sums = per_id.agg(F.sum("_n").alias("n_rows"), F.sum("_bad").alias("nonfinite_mass"), F.sum("_neg").alias("nonpositive_mass"),
                      F.sum("_pad").alias("dirty_padding"), total(F.col("_n") > 1).alias("repeated_ids"))
    order = ranking.order_report(df, row, mass).select(F.col("falls").alias("order_falls"))
    out = sums.join(F.broadcast(order))  # one row each
    clean = F.lit(True)
    for c in ("nonfinite_mass", "nonpositive_mass", "dirty_padding", "repeated_ids", "order_falls"):
        clean = clean & (F.col(c) == 0)
    return out.withColumn("valid", clean)


def contract_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Fields declared by one contract and not, or differently, by the other; empty means they match."""
    keys = left.columns
    a = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0))
    b = right.select(*keys).withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    sides = a.unionByName(b).groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.filter("_l <> _r").select(*keys, F.when(F.col("_l") == 1, "left_only").otherwise("right_only").alias("side"))


def formula_mismatches(df: DataFrame, group: str, stored: Column, formula: Column) -> DataFrame:
    """Rows per group whose stored value is not exactly the formula's."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), total(~stored.eqNullSafe(formula)).alias("mismatches"))


def column_alignment(left: DataFrame, right: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """One row: unmatched positions of either side and disagreements per column."""
    a = left.select(row, *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(True).alias("_l"))
    b = right.select(row, *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_r"))
    j = a.join(b, row, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.agg(total(both).alias("matched_rows"), total(F.col("_r").isNull()).alias("left_only"), total(F.col("_l").isNull()).alias("right_only"),
                 *[total(both & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))).alias(f"differs_{c}") for c in columns])


def monotone_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how often a wider window counts fewer rows than a narrower one."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[
        total(F.col(a) > F.col(b)).alias(f"{a}_above_{b}") for a, b in zip(columns, columns[1:])])


def protected_order_codes(df: DataFrame, gate: float) -> Column:
    """Failure codes of one audit record: gate and firing flags, submitted lists, and complete order where the gate is closed."""
    open_ = F.col("lib_max") < gate
    bad_list = lambda c: F.col(c).isNull() | (F.size(c) == 0) | (F.size(c) > 25) | F.exists(c, lambda x: x.isNull())
    usable = ~bad_list("output") & ~bad_list("counterfactual")
    known = F.col("lib_max").isNotNull() & ~F.isnan("lib_max")
    # fixed values: the codes and their order
    rules = [
        ("finite_library_gate_evidence", ~known),
        ("recorded_gate_disagrees", known & ~F.col("gate_open").eqNullSafe(open_)),
        ("fired_outside_open_gate", known & F.col("fired") & ~open_),
        ("complete_output_or_counterfactual_missing", known & ~usable),
        ("audit_output_disagrees_with_submission", known & usable & ~F.col("output").eqNullSafe(F.col("submitted"))),
        ("protected_complete_order_changed", known & usable & ~open_ & (F.col("output") != F.col("counterfactual"))),
        ("protected_historical_complete_order_changed", known & usable & ~open_ & ~F.col("output").eqNullSafe(F.col("historical"))),
    ]
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))


def slot_changes(positions: DataFrame, query: str, group: str, control: str, treatment: str, head: int) -> DataFrame:
    """Per query: changed slots, head rank distance, top-1 change, tail changes and slots holding another group than before.

    ``positions`` has one row per item with its place in both lists; a group may permute its own
    slots only.
    """
    c, t = F.col(control), F.col(treatment)
    slots_c = positions.select(query, c.alias("_slot"), F.col(group).alias("_gc"))
    slots_t = positions.select(query, t.alias("_slot"), F.col(group).alias("_gt"))
    moved = slots_c.join(slots_t, [query, "_slot"], "full_outer").groupBy(query).agg(total(~F.col("_gc").eqNullSafe(F.col("_gt"))).alias("foreign_group_slots"))
    per = positions.groupBy(query).agg(
        total(~c.eqNullSafe(t)).alias("changed_slots"), F.sum(F.when(t <= head, F.abs(t - c)).otherwise(0)).alias("head_rank_distance"),
        F.max(((c == 1) & (t != 1)).cast("int")).alias("top1_changed"), total((c > head) & (c != t)).alias("tail_changes"))
    return per.join(moved, query)


def submission_problems(roster: DataFrame, submission: DataFrame, ident: str, position: str, items: str, size: int = 25) -> DataFrame:
    """Every submission problem by kind with its count: missing, extra, order, empty list, too many, blank item."""
    a = roster.select(ident, F.col(position).alias("_want"))
    b = submission.select(ident, F.col(position).alias("_got"), F.split(items, ";").alias("_items"), F.col(items).alias("_raw"))
    j = a.join(b, ident, "full_outer")
    there = F.col("_got").isNotNull()
    empty = there & (F.coalesce(F.col("_raw"), F.lit("")) == "")
    rules = [("missing", ~there), ("extra", F.col("_want").isNull()), ("order", there & (F.col("_want") != F.col("_got"))), ("empty_list", empty),
             ("too_many", there & (F.size("_items") > size)), ("blank_item", there & ~empty & F.exists("_items", lambda x: F.trim(x) == ""))]
    codes = F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
    return j.select(F.explode(codes).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n_rows"))


def duplicate_slots(df: DataFrame, query: str, item: str) -> DataFrame:
    """Queries whose list repeats an identity, with the number of wasted slots."""
    runs = df.groupBy(query, item).agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(query).agg(F.sum("_n").alias("slots"), F.sum(F.col("_n") - 1).alias("duplicate_slots")).filter("duplicate_slots > 0")


def release_differences(recomputed: DataFrame, published: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per published column, how many keys the recomputation contradicts, plus keys on one side only."""
    r = column_alignment(recomputed, published, key, columns)
    names = ["left_only", "right_only", *[f"differs_{c}" for c in columns]]
    return r.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n_keys")) for n in names])).alias("p")).select("p.check", "p.n_keys")


def novelty(df: DataFrame, bank: DataFrame, key: str, row: str, mass: str, lo: float, hi: float) -> DataFrame:
    """Why a catalogue row is not new, first reason wins, or ``eligible``."""
    first = df.groupBy(key).agg(F.min(row).alias("_first"))
    held = bank.select(key).distinct().withColumn("_held", F.lit(True))
    j = df.join(first, key).join(held, key, "left")
    reason = (F.when(F.col("_held"), "in_old_bank").when(F.col(row) != F.col("_first"), "duplicate")
              .when(~F.col(mass).between(lo, hi), "outside_range").otherwise("eligible"))
    return j.withColumn("reason", reason).drop("_first", "_held")


def list_differences(a: DataFrame, b: DataFrame, query: str, item: str, rank: str) -> DataFrame:
    """Per query whose two ranked lists differ: the first differing rank and whether the top item agrees.

    Positions are joined one by one, so no list is collected.
    """
    x = a.select(query, rank, F.col(item).alias("_a")).join(b.select(query, rank, F.col(item).alias("_b")), [query, rank], "full_outer")
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    per = x.groupBy(query).agg(F.min(F.when(differs, F.col(rank))).alias("first_difference"), total(differs).alias("differing_ranks"),
                               F.max(((F.col(rank) == 1) & ~differs).cast("int")).alias("top_agrees"))
    return per.filter("differing_ranks > 0")
