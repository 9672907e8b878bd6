"""Masses, adduct channels and fragment families the results depend on."""

from pyspark.sql import DataFrame, SparkSession

# Monoisotopic masses in dalton.
C, H, N, O = 12.0, 1.00782503207, 14.0030740048, 15.9949146196
NA, K, CL = 22.9897692809, 38.96370668, 34.96885268
ELECTRON = 0.00054857990
PROTON = H - ELECTRON
PROTON_CODATA = 1.0072764665789
WATER = 2 * H + O
AMMONIUM = N + 4 * H - ELECTRON
FORMIC = C + 2 * H + 2 * O
ACETIC = 2 * C + 4 * H + 2 * O

# Adduct label, molecules, absolute charge, mass shift, polarity.
ADDUCTS = [
    ("[M+H]+", 1, 1, PROTON, "positive"),
    ("[M+NH4]+", 1, 1, AMMONIUM, "positive"),
    ("[M+Na]+", 1, 1, NA - ELECTRON, "positive"),
    ("[M+K]+", 1, 1, K - ELECTRON, "positive"),
    ("[M-H2O+H]+", 1, 1, PROTON - WATER, "positive"),
    ("[M+H-H2O]+", 1, 1, PROTON - WATER, "positive"),
    ("[M-2H2O+H]+", 1, 1, PROTON - 2 * WATER, "positive"),
    ("[M+2H]2+", 1, 2, 2 * PROTON, "positive"),
    ("[M]+", 1, 1, -ELECTRON, "positive"),
    ("[M-H2O]+", 1, 1, -ELECTRON - WATER, "positive"),
    ("[M+CH3OH+H]+", 1, 1, PROTON + C + 4 * H + O, "positive"),
    ("[M+CH3CN+H]+", 1, 1, PROTON + 2 * C + 3 * H + N, "positive"),
    ("[M-H]-", 1, 1, -PROTON, "negative"),
    ("[M-H2O-H]-", 1, 1, -PROTON - WATER, "negative"),
    ("[M+CH2O2-H]-", 1, 1, FORMIC - PROTON, "negative"),
    ("[M+C2H4O2-H]-", 1, 1, ACETIC - PROTON, "negative"),
    ("[M+Cl]-", 1, 1, CL + ELECTRON, "negative"),
    ("[M]-", 1, 1, ELECTRON, "negative"),
    ("[M-2H]-", 1, 2, -2 * PROTON, "negative"),
    ("[M-2H]2-", 1, 2, -2 * PROTON, "negative"),
    ("[M+Na-2H]-", 1, 1, NA - 2 * PROTON, "negative"),
    ("[2M+H]+", 2, 1, PROTON, "positive"),
    ("[2M+Na]+", 2, 1, NA - ELECTRON, "positive"),
    ("[2M+NH4]+", 2, 1, AMMONIUM, "positive"),
    ("[2M+K]+", 2, 1, K - ELECTRON, "positive"),
    ("[2M-H]-", 2, 1, -PROTON, "negative"),
    ("[2M+CH2O2-H]-", 2, 1, FORMIC - PROTON, "negative"),
    ("[2M+C2H4O2-H]-", 2, 1, ACETIC - PROTON, "negative"),
    ("[2M+Na-2H]-", 2, 1, NA - 2 * PROTON, "negative"),
    ("[3M+H]+", 3, 1, PROTON, "positive"),
    ("[3M-H]-", 3, 1, -PROTON, "negative"),
]

# Labels whose charge cannot be read from the label.
AMBIGUOUS_ADDUCTS = ["[M-2H]-"]

# Fragment family, polarity, mass shift, precursor labels that can carry it (none: any).
FRAGMENT_FAMILIES = [
    ("protonated", "positive", PROTON, None),
    ("deprotonated", "negative", -PROTON, None),
    ("sodium_retained", "positive", NA - ELECTRON, ["[M+Na]+", "[2M+Na]+"]),
    ("potassium_retained", "positive", K - ELECTRON, ["[M+K]+", "[2M+K]+"]),
    ("radical_cation", "positive", -ELECTRON, None),
    ("radical_anion", "negative", ELECTRON, None),
    ("chloride_retained", "negative", CL + ELECTRON, ["[M+Cl]-"]),
]

# Proton-only ion channels, label, molecules, signed protons, signed charge.
PROTON_CHANNELS = [
    ("[M+H]+", 1, 1, 1), ("[M-H]-", 1, -1, -1), ("[M+2H]2+", 1, 2, 2), ("[M-2H]2-", 1, -2, -2),
    ("[M+3H]3+", 1, 3, 3), ("[M-3H]3-", 1, -3, -3), ("[2M+H]+", 2, 1, 1), ("[2M-H]-", 2, -1, -1),
]

# Adduct dictionary order of the prepared spectra; anything else is the last entry.
ADDUCT_INDEX = [
    "[M+H]+", "[M+NH4]+", "[M+Na]+", "[M+K]+", "[M-H2O+H]+", "[M-2H2O+H]+", "[M]+", "[M-H]-", "[M-H2O-H]-",
    "[M+CH2O2-H]-", "[M+C2H4O2-H]-", "[M+Cl]-", "[M]-", "[M+2H]2+", "[M-2H]-", "[2M+H]+", "[2M+Na]+",
    "[2M+NH4]+", "[2M-H]-", "[2M+K]+", "[2M+CH2O2-H]-", "[2M+C2H4O2-H]-", "[2M+Na-2H]-", "[M+Na-2H]-",
    "[M-H2O]+", "<unk>",
]

# Lower-case fragments of instrument names and the family each marks, first match wins.
INSTRUMENT_LADDER = [
    ("timstof", 0),
    ("orbitrap", 1), ("qft", 1), ("ftms", 1), ("hybrid ft", 1), ("itft", 1), ("exactive", 1),
    ("tof", 2),
    ("trap", 3), ("qq", 3),
]
INSTRUMENT_OTHER = 4


def adduct_dimension(spark: SparkSession) -> DataFrame:
    """The adduct table; a few dozen fixed rows, so joins against it may broadcast."""
    return spark.createDataFrame(
        ADDUCTS, "adduct string, n_mol int, abs_charge int, shift_da double, polarity string")


def channel_dimension(spark: SparkSession) -> DataFrame:
    """The eight proton channels with their mass shift."""
    rows = [(label, n, abs(z), protons * PROTON_CODATA, "positive" if z > 0 else "negative")
            for label, n, protons, z in PROTON_CHANNELS]
    return spark.createDataFrame(
        rows, "channel string, n_mol int, abs_charge int, shift_da double, polarity string")
