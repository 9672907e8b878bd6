"""Scalar column functions over spectra metadata, masses, keys and hashes."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import (ADDUCT_INDEX, AMBIGUOUS_ADDUCTS, FRAGMENT_FAMILIES, H, INSTRUMENT_LADDER,
                        INSTRUMENT_OTHER, PROTON_CHANNELS, PROTON_CODATA, adduct_dimension)


def finite(c: Column) -> Column:
    """True for a non-null double that is neither NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def with_adduct(df: DataFrame, adduct: str = "adduct") -> DataFrame:
    """Attach molecule count, charge, shift and polarity of the adduct; unknown labels keep NULLs."""
    dim = adduct_dimension(df.sparkSession).withColumnRenamed("adduct", "_adduct")
    return df.join(F.broadcast(dim), F.col(adduct) == F.col("_adduct"), "left").drop("_adduct")


def neutral_mass(mz: Column) -> Column:
    """``(mz * z - shift) / n`` on a frame from ``with_adduct``."""
    return (mz * F.col("abs_charge") - F.col("shift_da")) / F.col("n_mol")


def precursor_mz(mass: Column) -> Column:
    """``(n * mass + shift) / z`` on a frame from ``with_adduct``."""
    return (F.col("n_mol") * mass + F.col("shift_da")) / F.col("abs_charge")


def polarity_hold(adduct: Column, mode: Column, mz: Column) -> Column:
    """Why a precursor cannot be converted, or NULL; first reason wins."""
    # fixed values: the reasons and their order
    return (F.when(adduct.isin(AMBIGUOUS_ADDUCTS), "ambiguous_charge")
            .when(F.col("n_mol").isNull(), "unsupported_adduct")
            .when(~mode.isin("positive", "negative") | mode.isNull(), "unknown_mode")
            .when(mode != F.col("polarity"), "polarity_disagreement")
            .when(~finite(mz) | (mz <= 0), "bad_precursor_mz")
            .when(neutral_mass(mz) <= 0, "nonpositive_neutral_mass"))


def fragment_ions(masses: Column, family: str, h_shifts: tuple[int, ...] = (-2, -1, 0, 1, 2)) -> Column:
    """Distinct ascending ``m + h*H + shift`` over neutral fragment masses and hydrogen shifts."""
    shift = next(s for name, _, s, _ in FRAGMENT_FAMILIES if name == family)
    ions = F.flatten(F.transform(masses, lambda m: F.array(*[m + F.lit(h * H) + F.lit(shift) for h in h_shifts])))
    return F.array_sort(F.array_distinct(ions))


def family_allowed(family: str, adduct: Column, mode: Column) -> Column:
    """Family polarity equals the mode, and a retained cation or anion needs a precursor carrying it."""
    _, polarity, _, carriers = next(f for f in FRAGMENT_FAMILIES if f[0] == family)
    allowed = mode == polarity
    return allowed if carriers is None else allowed & adduct.isin(carriers)


def signed_ppm(query: Column, candidate: Column) -> Column:
    return (candidate - query) / query * F.lit(1e6)


def with_channels(df: DataFrame) -> DataFrame:
    """Every row once per proton channel, with the channel's count, charge and shift; a map-side fan-out."""
    rows = [F.struct(F.lit(label).alias("channel"), F.lit(n).alias("n_mol"), F.lit(abs(z)).alias("abs_charge"),
                     F.lit(protons * PROTON_CODATA).alias("shift_da")) for label, n, protons, z in PROTON_CHANNELS]
    return df.select("*", F.explode(F.array(*rows)).alias("_ch")).select(*df.columns, "_ch.*")


def interpretation_windows(value: Column, channel: Column, ppm: float) -> Column:
    """Array of three (basis, status, center, lower, upper) readings of one supplied scalar."""
    half = value * F.lit(ppm / 1_000_000.0)
    raw_lo, raw_hi = value - half, value + half

    def per_channel(pick):
        return functools.reduce(lambda acc, row: acc.when(channel == row[0], F.lit(pick(row))),
                                PROTON_CHANNELS[1:], F.when(channel == PROTON_CHANNELS[0][0],
                                                            F.lit(pick(PROTON_CHANNELS[0]))))

    n, z, shift = per_channel(lambda r: r[1]), per_channel(lambda r: abs(r[3])), per_channel(lambda r: r[2] * PROTON_CODATA)

    def reading(basis: str, convert) -> Column:
        center, lo, hi = convert(value), convert(raw_lo), convert(raw_hi)
        held = (center <= 0) | (lo > center) | (center > hi)
        return F.struct(F.lit(basis).alias("basis"),
                        F.when(held, "HOLD_NONPOSITIVE_OR_INVALID_CENTER")
                        .otherwise("CONDITIONAL_NUMERICAL_WINDOW").alias("status"),
                        center.alias("center_da"), lo.alias("lower_da"), hi.alias("upper_da"))

    return F.array(reading("neutral_monomer_mass", lambda x: x),
                   reading("ion_total_mass", lambda x: (x - shift) / n),
                   reading("precursor_mz", lambda x: (z * x - shift) / n))


def instrument_family(name: Column) -> Column:
    """Substring ladder on the lower-cased name, in order."""
    low = F.lower(name)
    first, *rest = INSTRUMENT_LADDER
    ladder = functools.reduce(lambda acc, r: acc.when(low.contains(r[0]), r[1]), rest,
                              F.when(low.contains(first[0]), first[1]))
    return ladder.otherwise(INSTRUMENT_OTHER)


def adduct_index(adduct: Column) -> Column:
    """Dictionary position of the label; unknown or NULL labels get the last entry."""
    known = F.array(*[F.lit(a) for a in ADDUCT_INDEX[:-1]])
    position = F.coalesce(F.array_position(known, adduct), F.lit(0))
    return F.when(position > 0, position - 1).otherwise(len(ADDUCT_INDEX) - 1).cast("int")


def mean_energy(values: Column) -> Column:
    """Mean of the list, -1 when it is null or empty."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, total / F.size(values)).otherwise(F.lit(-1.0))


def energy_bucket(energy: Column, step: float = 5.0) -> Column:
    """Half-even rounding to ``step``, at least one step."""
    return F.greatest(F.lit(step), F.bround(energy / step).cast("double") * step)


def shortest_number(text: Column) -> Column:
    """A numeric token at six significant digits without padding zeros, as ``%g`` prints it."""
    value = text.try_cast("double")
    exponent = F.floor(F.log10(F.abs(value)))
    scientific = F.format_string("%.5e", value)
    # rounding may carry into the next power of ten, so read the exponent back from the rounded form
    exponent = F.when(value == 0, 0).otherwise(
        F.regexp_extract(scientific, "e([+-][0-9]+)$", 1).try_cast("int"))
    mantissa = F.regexp_replace(F.regexp_extract(scientific, "^(-?[0-9.]+)e", 1), r"\.?0+$", "")
    sign_digits = F.regexp_extract(scientific, "(e[+-][0-9]+)$", 1)
    fixed = (F.when(exponent >= 5, F.format_string("%.0f", value)).when(exponent == 4, F.format_string("%.1f", value))
             .when(exponent == 3, F.format_string("%.2f", value)).when(exponent == 2, F.format_string("%.3f", value))
             .when(exponent == 1, F.format_string("%.4f", value)).when(exponent == 0, F.format_string("%.5f", value))
             .when(exponent == -1, F.format_string("%.6f", value)).when(exponent == -2, F.format_string("%.7f", value))
             .when(exponent == -3, F.format_string("%.8f", value)).otherwise(F.format_string("%.9f", value)))
    trimmed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return (F.when(value.isNull(), text)
            .when((exponent < -4) | (exponent >= 6), F.concat(mantissa, sign_digits))
            .otherwise(trimmed))


def energy_signature(text: Column) -> Column:
    """Comma-joined tokens, blanks and unknown markers dropped, numbers printed shortest."""
    tokens = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t))
    kept = F.filter(tokens, lambda t: (t != "") & ~F.lower(t).isin("none", "nan", "unknown"))
    return F.array_join(F.transform(kept, shortest_number), ",")


def energy_unit(unit: Column) -> Column:
    return F.coalesce(F.lower(F.trim(unit)), F.lit("unknown"))


def identity_group_id(composition: Column, key: Column) -> Column:
    """sha256 of compact JSON ``[[[symbol,count],...],key]`` over (symbol, count) structs."""
    atoms = F.transform(F.array_sort(composition),
                        lambda a: F.concat(F.lit('["'), a["symbol"], F.lit('",'), a["count"].cast("string"), F.lit("]")))
    return F.sha2(F.concat(F.lit("[["), F.array_join(atoms, ","), F.lit('],"'), key, F.lit('"]')), 256)


def hash_bucket(text: Column, modulus: int) -> Column:
    """First 64 bits of sha256, big-endian, modulo ``modulus``."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(modulus)).cast("int")


def hash_modulus(text: Column, n: Column) -> Column:
    """The whole 256-bit sha256 modulo ``n`` (below 2^31), by eight 32-bit steps."""
    digest = F.sha2(text, 256)
    starts = F.array(*[F.lit(1 + 8 * i) for i in range(8)])
    chunks = F.transform(starts, lambda s: F.conv(F.substring(digest, s, F.lit(8)), 16, 10).cast("bigint"))
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda r, c: (r * F.lit(4294967296) + c) % n.cast("bigint"))


def mass_bin(mass: Column, bins: int = 64, lo: float = 80.0, hi: float = 1400.0) -> Column:
    """Equal-width bin, the last one closed; NULL outside the range."""
    index = F.least(F.floor((mass - lo) * bins / (hi - lo)), F.lit(bins - 1))
    return F.when(mass.between(lo, hi), index).cast("int")


# Key patterns.
FULL_KEY = "^[A-Z]{14}-[A-Z]{10}-[A-Z]$"
BLOCK_KEY = "^[A-Z]{14}$"
DIGEST_KEY = "^[0-9a-f]{64}$"


def clean_key(*candidates: Column) -> Column:
    """First candidate that is neither NULL, blank nor the text ``nan``, trimmed; else empty."""
    usable = [F.when(~F.lower(F.trim(c)).isin("", "nan"), F.trim(c)) for c in candidates]
    return F.coalesce(*usable, F.lit(""))


def log_popularity(sid: Column, pmid: Column) -> Column:
    return F.log1p(F.coalesce(sid, F.lit(0)).cast("double")) + F.log1p(F.coalesce(pmid, F.lit(0)).cast("double"))


def canonical_json_digest(*columns: str) -> Column:
    """sha256 of compact JSON with keys in sorted order; NULL fields are written as ``null``."""
    parts = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.sha2(parts, 256)


def usable_spectrum(mz: Column, intensity: Column, mode: Column, energy: Column) -> Column:
    """Aligned nonempty lists, finite positive m/z, finite non-negative intensity, known mode and energy."""
    return ((F.size(mz) > 0) & (F.size(mz) == F.size(intensity))
            & F.forall(mz, lambda x: finite(x) & (x > 0)) & F.forall(intensity, lambda x: finite(x) & (x >= 0))
            & F.exists(intensity, lambda x: x > 0) & mode.isin(-1.0, 1.0) & finite(energy))


def quality_filter(precursor: Column, n_peaks: Column, error_ppm: Column, known: Column,
                   min_peaks: int = 3, max_ppm: float = 20.0) -> Column:
    """Keep rows with a missing mass error; only a finite error above the limit drops a row."""
    too_far = finite(error_ppm) & (F.abs(error_ppm) > max_ppm)
    return finite(precursor) & (n_peaks >= min_peaks) & ~too_far & known
