"""Audit of how filters interact: what every filter removes at every step of every order of application.

Each document is reduced to a mask, one bit for each filter that it fails. A table of cells (part, mask) holds how many
documents have it, how many of them are labelled good, and how many toxic; all that follows needs the cells alone. A
recursive query starts from the empty prefix on every mask that occurs, extends each prefix by every letter not yet
applied and carries the applied bits; each level of the recursion tells for a mask what the new step does with it. There
are at most 32 masks and 325 prefixes, whatever the size of the table, so the walk is a bounded table that the cells are
joined to. Metrics are summed once for each prefix; the 120 orders read those of their own prefixes.

Filters (a failing document has the bit): ``A`` few words, ``B`` few different words, ``C`` many capitals, ``D`` holds a
mark, ``E`` has the text of a document with a smaller doc_id. Equal texts are found by their SHA-256. Copies are counted
before they meet: by (text, part, labels) with the smallest doc_id, so a text that a third of all rows have is one row.

Defined results: a null text is empty, a null source is the part ''; a row without doc_id has no labels, fails ``E`` never
and makes nobody else fail it; rows repeated whole share a doc_id, so none of them has a smaller one; a document with
several labels is good (toxic) if one of them says so; an empty table gives no rows. Other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

LETTERS = "ABCDE"
BLANK = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

WALK_SQL = """
WITH RECURSIVE walk (mask, prefix, applied, bit, step) AS (
  SELECT mask, '' AS prefix, 0 AS applied, 0 AS bit, 0 AS step FROM {masks}
  UNION ALL
  SELECT w.mask, concat(w.prefix, f.letter), w.applied | f.bit, f.bit, w.step + 1
  FROM walk w JOIN (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(letter, bit) ON (w.applied & f.bit) = 0
)
SELECT mask, prefix, step,
  (mask & applied) = 0 AS kept,
  (mask & bit) <> 0 AND (mask & (applied ^ bit)) = 0 AS removed,
  (mask & bit) <> 0 AND (mask & (applied ^ bit)) <> 0 AS redundant,
  mask = bit AS only
FROM walk WHERE step > 0
"""


def failures(text: Column) -> Column:
    """The bits of the filters that look at the text alone."""
    words = F.array_remove(F.split(text, BLANK), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    tests = (n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents with each mask, and how many of them are labelled good or toxic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       failures(text).alias("bits"), F.sha2(text, 256).alias("digest"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality").cast("int").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").cast("int").eqNullSafe(1)).alias("toxic"))
    keys = ["digest", "part", "bits", "good", "toxic"]
    # joined by doc_id, then counted by it: one shuffle serves both
    each = rows.join(marks.hint("merge"), "doc_id", "left").na.fill(False, ["good", "toxic"]).groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    copies = each.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(known).alias("low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("loose"))
    # at most (parts x 4) rows have a text by now
    first = F.col("low.doc_id") == F.min("low.doc_id").over(Window.partitionBy("digest"))
    late = F.col("n") - F.col("loose") - F.when(first, F.col("low.n")).otherwise(0)
    split = copies.withColumn("late", late).select("part", "bits", "good", "toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("bit"), (F.col("n") - F.col("late")).alias("n")), F.struct(F.lit(16).alias("bit"), F.col("late").alias("n")))).alias("x"))
    n = F.col("x.n")
    return split.filter("x.n > 0").groupBy("part", (F.col("bits") + F.col("x.bit")).alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def interactions(cells: DataFrame) -> DataFrame:
    """A row for each part, order and step, from a small table of cells (read once a recursion level)."""
    walk = cells.sparkSession.sql(WALK_SQL, masks=cells.select("mask").distinct())
    walk = stored(walk)

    def total(flag: str, of: str = "n") -> Column:
        return F.sum(F.when(F.col(flag), F.col(of)).otherwise(0))

    steps = cells.join(F.broadcast(walk), "mask").groupBy("part", "prefix").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("only").alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"))
    orders = walk.filter(f"step = {len(LETTERS)}").select(F.col("prefix").alias("filter_order")).distinct().select(
        "filter_order", F.explode(F.array(*[F.lit(k) for k in range(1, len(LETTERS) + 1)])).alias("step"))
    orders = orders.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    letter = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))  # one row for each order
    return steps.join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", F.sum("removed").over(letter).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the five filters, for each part of the documents."""
    return interactions(stored(mask_cells(docs, labels)))
