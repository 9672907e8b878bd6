"""Fingerprints as arrays of 64-bit words: packing, counts, similarities and logit scores."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_bits(bits: Column, big_endian: bool = False) -> Column:
    """0/1 list to one word; element 0 is the lowest bit, or the highest when ``big_endian``."""
    size = F.size(bits)
    place = lambda i: (size - 1 - i) if big_endian else i
    placed = F.transform(bits, lambda b, i: F.call_function("shiftleft", b.cast("bigint"), place(i).cast("int")))
    return F.aggregate(placed, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


def pack_words(bits: Column, n_bits: int) -> Column:
    """0/1 list of ``n_bits`` to an array of 64-bit words; the unused tail of the last word stays zero."""
    starts = range(0, n_bits, 64)
    return F.array(*[pack_bits(F.slice(bits, s + 1, min(64, n_bits - s))) for s in starts])


def unpack_bits(word: Column, n_bits: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)),
                       lambda i: F.call_function("shiftright", word, i).bitwiseAND(F.lit(1).cast("bigint")).cast("int"))


def padding_clean(words: Column, n_bits: int) -> Column:
    """No bit above the declared width is set."""
    used = n_bits % 64
    if used == 0:
        return F.lit(True)
    return F.call_function("shiftrightunsigned", F.element_at(words, -1), F.lit(used)) == 0


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def intersection(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, n: acc + n)


def union(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda acc, n: acc + n)


def tanimoto(inter: Column, uni: Column, empty: float | None = None) -> Column:
    """Intersection over union; two empty sets give ``empty`` (NULL: undefined)."""
    return F.when(uni == 0, F.lit(empty).cast("double")).otherwise(inter / uni)


def binary_cosine(inter: Column, on_a: Column, on_b: Column) -> Column:
    product = on_a.cast("double") * on_b.cast("double")
    return F.when(product > 0, inter / F.sqrt(product))


def hamming(inter: Column, on_a: Column, on_b: Column) -> Column:
    return on_a + on_b - 2 * inter


def expected_overlap(probabilities: Column, bits: Column) -> Column:
    """``p.b / (sum p + sum b - p.b)``; 0 when nothing is expected or set."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(probabilities, bits, lambda p, b: p * b.cast("double")), F.lit(0.0), add)
    p_sum = F.aggregate(probabilities, F.lit(0.0), add)
    b_sum = F.aggregate(bits, F.lit(0), add).cast("double")
    denominator = p_sum + b_sum - dot
    return F.when(denominator > 0, dot / denominator).otherwise(F.lit(0.0))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def dot_set_bits(logits: Column, bits: Column) -> Column:
    """Sum of the logits at set bits."""
    return F.aggregate(F.zip_with(logits, bits, lambda z, b: z * b), F.lit(0.0), lambda acc, x: acc + x)
