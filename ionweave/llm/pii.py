"""Personal data by weak supervision, in DataFrame expressions only.

Base spans come from four patterns with their checks and always count. A looser pattern proposes further spans (written
out mail addresses, local telephone numbers, identity and account numbers, named persons). Labelers vote yes, no or
abstain on every candidate: pattern labelers by its shape, gazetteers by what it contains, context labelers by what
stands around it. Expectation-maximisation over the table of vote patterns (bounded: votes and shapes, not rows)
estimates each labeler's reliability and each pattern's probability; those train the final classifier, naive Bayes on
a span's kind, shape and votes, which admits the further spans. Texts are never shuffled: one pass counts patterns,
one applies the small model.

Defined results: a null text has no spans; positions are code points, end exclusive; per kind matches are leftmost and
do not overlap; a further span that overlaps a base span is left out; rows are judged alone, so repeats get equal
results. Other columns pass untouched, whatever their names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, the four base ones first.
KINDS = ("email", "ip", "card", "phone", "mail_words", "local_phone", "account", "identity", "person")
BASE = 4
# Possessive parts and the look-behinds give the same matches as the plain patterns, in linear time on any text.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_MAIL_WORDS = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}+(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{2,40}+(?: ?[\[(]dot[\])] ?| dot )[A-Za-z]{2,10}"
_LOCAL_PHONE = r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
_ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])"
_IDENTITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: Frequent given names, the gazetteer of persons.
GIVEN_NAMES = ("Anna", "Carlos", "Claire", "David", "Elena", "Emma", "Hans", "James", "Jean", "John", "Jose", "Juan", "Julia", "Karl", "Laura",
               "Lucas", "Maria", "Marie", "Martin", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sofia", "Thomas", "William")
_PERSON = rf"(?=[{''.join(sorted({x[0] for x in GIVEN_NAMES}))}])(?<![\p{{L}}])(?:{'|'.join(GIVEN_NAMES)}) [A-Z][a-z]{{2,20}}(?![\p{{L}}])"
_BYTE = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
_BEFORE = r"(?i)(?:mail|contact|write|call|tel|phone|mobile|fax|card|visa|account|iban|ssn|id|name|mr|mrs|ms|dr|from|by|host|ip|address)\W{0,6}$"
_AFTER = r"(?i)^\W{0,2}(?:%|percent|euro|eur|usd|dollar|km|kg|cm|mm|items|points)"
_LISTED = r"(?i)\b(?:mail[0-9]*|example|gmail|com|org|net|555|" + "|".join(GIVEN_NAMES) + r")\b"
LABELERS = ("checked pattern", "strict shape", "gazetteer", "context before", "context after", "part of a number")
ROUNDS = 25


def _matches(text: Column, pattern: str, kind: int, needs: Column) -> Column:
    """array<struct<start, kind, end, value, before>> of the pattern's leftmost matches; ``needs`` is a cheap test first."""
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, v: F.struct(g.alias("g"), v.alias("v")))
    empty = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string,before:string>>)")

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["g"])
        end = start + F.length(part["v"])
        row = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["v"].alias("value"), F.right(part["g"], F.lit(24)).alias("before"))
        return F.when(part["v"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["rows"], F.array(row)).alias("rows")))

    rows = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("rows")), add, lambda s: s["rows"])
    return F.when(needs & text.rlike(pattern), rows).otherwise(empty)


def _luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 20, "0")

    def step(total: Column, i: Column) -> Column:
        d = F.substr(padded, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """The checked matches of the four base patterns, by start and kind."""
    digits = lambda c: F.regexp_replace(c["value"], "[^0-9]", "")
    ip = F.filter(_matches(text, _IP, 1, text.rlike(r"[0-9]\.[0-9]")), lambda c: F.forall(F.split(c["value"], r"\."), lambda part: part.rlike(_BYTE)))
    card = F.filter(_matches(text, _CARD, 2, text.rlike(r"[0-9][\x20-]?[0-9]")), lambda c: F.when(F.length(digits(c)).between(14, 19), _luhn(digits(c))).otherwise(False))
    phone = F.filter(_matches(text, _PHONE, 3, F.contains(text, F.lit("+"))), lambda c: F.length(digits(c)).between(10, 15))
    return F.array_sort(F.concat(_matches(text, _EMAIL, 0, F.contains(text, F.lit("@"))), ip, card, phone))


def loose_spans(text: Column, base: Column) -> Column:
    """Further candidates that touch no base span."""
    digits, words = text.rlike("[0-9]{3}"), F.contains(text, F.lit("dot")) & (F.contains(text, F.lit(" at ")) | text.rlike(r"[\[(]at[\])]"))
    tests = (("mail_words", _MAIL_WORDS, words), ("local_phone", _LOCAL_PHONE, digits), ("account", _ACCOUNT, digits), ("identity", _IDENTITY, digits), ("person", _PERSON, F.lit(True)))
    every = F.concat(*[_matches(text, pattern, KINDS.index(kind), needs) for kind, pattern, needs in tests])
    return F.filter(every, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def votes(text: Column, c: Column) -> Column:
    """Each labeler's vote on a candidate: 1 yes, -1 no, 0 abstains."""
    after = F.substring(text, c["end"] + 1, F.lit(16))
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    return F.array(
        vote(c["kind"] < BASE),
        vote(c["value"].rlike(r"[@()\[\]+]|\bdot\b|^[0-9]{3}-[0-9]{2}-"), c["value"].rlike(r"^[0-9 .]+$")),
        vote(c["value"].rlike(_LISTED)),
        vote(c["before"].rlike(_BEFORE)),
        vote(F.lit(False), after.rlike(_AFTER)),
        vote(F.lit(False), c["before"].rlike(r"[0-9][ .,/-]?$") | after.rlike(r"^[.,/-]?[0-9]")))


def shape(c: Column) -> Column:
    """Shape features of a candidate: its kind, length class and share of digits."""
    size = F.length(c["value"])
    share = 4 * F.length(F.regexp_replace(c["value"], "[^0-9]", "")) / size
    return F.array(c["kind"], F.least(size / 6, F.lit(6)).cast("int"), share.cast("int"))


def _candidates(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # apart, so that no name can clash
    out = docs.select(row.alias("_row"), text.alias("_text")).withColumn("_base", base_spans(F.col("_text")))
    return out.withColumn("_loose", loose_spans(F.col("_text"), F.col("_base")))


def _posterior(vote: Column, model: Column) -> Column:
    """The probability that a candidate with these votes is private, under prior and reliabilities."""
    weights = F.zip_with(vote, model["sure"], lambda v, r: v * F.log(r / (1 - r)))
    odds = F.log(model["prior"] / (1 - model["prior"])) + F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def train(candidates: DataFrame) -> DataFrame:
    """One row: ``weights``, a map from feature to log-odds, and ``bias``."""
    text = F.col("_text")
    rows = candidates.select(F.explode(F.transform(F.concat("_base", "_loose"), lambda c: F.struct(votes(text, c).alias("v"), shape(c).alias("s")))).alias("c"))
    patterns = rows.groupBy("c.v", "c.s").agg(F.count(F.lit(1)).alias("n"))
    table = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "s", "n"))).alias("rows"))  # bounded by votes and shapes
    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.8), len(LABELERS)).alias("sure"))

    def improve(model: Column, _: Column) -> Column:
        judged = F.transform("rows", lambda r: F.struct(r["v"].alias("v"), r["n"].cast("double").alias("n"), _posterior(r["v"], model).alias("p")))
        total = lambda f: F.aggregate(judged, F.lit(0.0), lambda a, r: a + f(r))
        clip = lambda x, low, high: F.greatest(F.least(x, F.lit(high)), F.lit(low))
        sure = [clip((total(lambda r: r["n"] * F.when(r["v"][k] == 1, r["p"]).when(r["v"][k] == -1, 1 - r["p"]).otherwise(0.0)) + 4)
                     / (total(lambda r: r["n"] * F.abs(r["v"][k])) + 5), 0.55, 0.99) for k in range(len(LABELERS))]
        return F.struct(clip(total(lambda r: r["n"] * r["p"]) / F.greatest(total(lambda r: r["n"]), F.lit(1.0)), 0.01, 0.99).alias("prior"), F.array(*sure).alias("sure"))

    fitted = table.withColumn("model", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, improve))
    labelled = fitted.select(F.explode("rows").alias("r"), "model").select("r.s", "r.v", "r.n", _posterior(F.col("r.v"), F.col("model")).alias("p"))
    features = F.concat(F.transform("s", lambda x, i: F.concat_ws(":", F.lit("s"), i, x)), F.transform(F.slice("v", 2, 99), lambda x, i: F.concat_ws(":", F.lit("v"), i, x)))
    counts = labelled.select(F.explode(features).alias("feature"), (F.col("n") * F.col("p")).alias("yes"), (F.col("n") * (1 - F.col("p"))).alias("no"))
    whole = labelled.agg(F.coalesce(F.sum(F.col("n") * F.col("p")), F.lit(0.0)).alias("yes"), F.coalesce(F.sum(F.col("n") * (1 - F.col("p"))), F.lit(0.0)).alias("no"))
    each = counts.groupBy("feature").agg(F.sum("yes").alias("fy"), F.sum("no").alias("fn")).crossJoin(F.broadcast(whole))
    # lift over the prior, smoothed towards it, so that a rare feature says little
    share = F.greatest(F.least(F.col("yes") / F.greatest(F.col("yes") + F.col("no"), F.lit(1.0)), F.lit(0.99)), F.lit(0.01))
    weight = F.round(F.log((F.col("fy") + 2 * share) / (F.col("fn") + 2 * (1 - share))) - F.log(share / (1 - share)), 6)
    weights = each.agg(F.map_from_entries(F.collect_list(F.struct("feature", weight))).alias("weights"))
    return weights.crossJoin(F.broadcast(whole.select(F.round(F.log((F.col("yes") + 1) / (F.col("no") + 1)), 6).alias("bias"))))


def find(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``_row``, its ``_text``, ``_base`` and ``_spans``, arrays of (start, kind, end, ...) in order."""
    seen = _candidates(docs)
    scored = seen.crossJoin(F.broadcast(train(seen)))  # the model is one row
    text = F.col("_text")

    def admitted(c: Column) -> Column:
        features = F.concat(F.transform(shape(c), lambda x, i: F.concat_ws(":", F.lit("s"), i, x)), F.transform(F.slice(votes(text, c), 2, 99), lambda x, i: F.concat_ws(":", F.lit("v"), i, x)))
        return F.aggregate(features, F.col("bias"), lambda a, f: a + F.coalesce(F.col("weights")[f], F.lit(0.0))) > 0

    return scored.withColumn("_spans", F.array_sort(F.concat("_base", F.filter("_loose", admitted)))).drop("_loose", "weights", "bias")


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])))


def report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans, a row for each document."""
    found = find(docs.select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(BASE)]
    return found.select("_row.doc_id", *counts, F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; columns stay, and n_chars follows the text."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(state: Column, c: Column) -> Column:
        gap = F.substr(F.col("_text"), state["at"] + 1, c["start"] - state["at"])
        return F.when(c["start"] < state["at"], F.struct(F.greatest(state["at"], c["end"]).alias("at"), state["out"].alias("out"))).otherwise(
            F.struct(c["end"].alias("at"), F.concat(state["out"], F.array(gap, F.get(names, c["kind"]))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    last = lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col("_text"), s["at"] + 1))
    touched = F.size("_spans") > 0
    text = F.when(touched, F.aggregate("_spans", start, step, last)).otherwise(F.col("_row.text"))
    out = find(docs).select("_row", "_spans", text.alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(touched, F.length("_text")).otherwise(F.col("_row.n_chars"))
    return out.select(*[new[c].cast(t).alias(c) if c in new else F.col(f"_row.`{c}`") for c, t in docs.dtypes])
