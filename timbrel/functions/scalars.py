"""Scalar column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.functions import fixed


def lit(v) -> Column:
    return F.lit(v)


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within low..high; null stays null (greatest and least would skip it)."""
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def half_even(x: Column, digits: int = 0) -> Column:
    """Round half to even at ``digits`` decimals."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def half_up(x: Column) -> Column:
    """Round to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def fixed_text(x: Column, digits: int, suffix: str = "") -> Column:
    """``x`` with ``digits`` decimals as text (ties to even) and a suffix."""
    return F.concat(F.format_string(f"%.{digits}f", half_even(x, digits)), lit(suffix))


def subject_id(name: Column) -> Column:
    """Recording name without its trailing ``_<number>``."""
    pattern = r"^(.+?)_\d+$"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(name)


def stars(score: Column, out_of: int = 5) -> Column:
    full = F.rint(score.cast("double")).cast("int")
    return F.concat(F.repeat(lit("★"), full), F.repeat(lit("☆"), lit(out_of) - full))


def report_id(url: Column) -> Column:
    """Hex id of ``report_<id>.pdf``; null when the address does not carry one."""
    found = F.regexp_extract(url, r"report_([a-f0-9]+)\.pdf", 1)
    return F.when(found != "", found)


def reference_code(url: Column) -> Column:
    """``VV-<ID>`` from the second underscore part up to its first dot."""
    part = F.get(F.split(F.get(F.split(url, "_"), lit(1)), r"\."), lit(0))
    return F.concat(
        lit("VV-"), F.coalesce(F.upper(F.nullif(part, lit(""))), lit("UNKNOWN"))
    )


def present(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda v: v.isNotNull())


def english_list(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c`` (up to three items)."""
    a, b, c = (F.get(items, lit(i)) for i in range(3))
    return (
        F.when(F.size(items) == 1, a)
        .when(F.size(items) == 2, F.concat(a, lit(" and "), b))
        .when(F.size(items) >= 3, F.concat(a, lit(", "), b, lit(", and "), c))
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None):
    """Cosine similarity of two array<double> columns, each length raised by 1e-10."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    return dot(a, b) / ((na + 1e-10) * (nb + 1e-10))


def two_way_share(sim_a: Column, sim_b: Column, temperature: float = 0.05) -> Column:
    """Percentage of ``a`` in a two-way softmax, in its overflow-free form."""
    return 100.0 / (1.0 + F.exp((sim_b - sim_a) / temperature))


def quadratic_form(diff: Column, rows: Column) -> Column:
    """d' M d for an array and a matrix given as an array of rows."""
    return dot(F.transform(rows, lambda r: dot(r, diff)), diff)


def certainty(p: Column) -> Column:
    return 2.0 * F.abs(p - 0.5)


def decibel(x: Column) -> Column:
    """20 log10(x), -100 at or below zero."""
    return F.when(x > 0, 20.0 * F.log10(F.when(x > 0, x))).otherwise(-100.0)


def meter(db: Column) -> Column:
    return clamp((db + 50.0) / 50.0 * 100.0, 0.0, 100.0)


def range_percent(v: Column, low: Column, high: Column) -> Column:
    width = high - low
    return (v - low) / F.when(width == 0, lit(1.0)).otherwise(width) * 100.0


def shown_snr(noise: Column) -> Column:
    """Displayed signal-to-noise estimate; missing or zero noise counts as 5."""
    n = F.when(noise.isNull() | (noise == 0), 5.0).otherwise(noise)
    return F.greatest(lit(10), half_up(32 - n * 0.6)).cast("long")


def shown_snr_meter(noise: Column) -> Column:
    return F.least(lit(100.0), shown_snr(noise) / 30.0 * 100.0)


def age_seconds(as_of_us: Column | int, us: Column) -> Column:
    return (as_of_us - us) / 1e6


def _has(label: Column, words: tuple[str, ...]) -> Column:
    out = label.contains(words[0])
    for w in words[1:]:
        out = out | label.contains(w)
    return out


def first_phrase(label: Column, table, otherwise: Column, slot: int = 1) -> Column:
    """Text of the first table row whose keywords occur in the lower-cased label."""
    low = F.lower(label)
    out = None
    for row in table:
        cond = _has(low, row[0])
        out = F.when(cond, row[slot]) if out is None else out.when(cond, row[slot])
    return out.otherwise(otherwise)


def descriptor(label: Column, value: Column) -> Column:
    return F.when(
        value > 0,
        first_phrase(label, fixed.DESCRIPTORS, F.concat(lit("Elevated "), label), 1),
    ).otherwise(first_phrase(label, fixed.DESCRIPTORS, F.concat(lit("Reduced "), label), 2))


def explanation_phrase(label: Column, value: Column) -> Column:
    low = F.lower(label)
    return F.when(
        value > 0, first_phrase(label, fixed.RAISED_PHRASES, F.concat(lit("altered "), low))
    ).otherwise(first_phrase(label, fixed.LOWERED_PHRASES, F.concat(lit("reduced "), low)))


def drawing(file_name: Column, collection: Column) -> Column:
    """struct(kind, subject) of a drawing from its file name and collection.

    ``coded``     V<id><P|H><E|O>...: E spiral, O wave, id zero-padded to three
    ``numbered``  <id>-<n>: usable for both kinds
    ``tagged``    sp.. spiral, mea.. wave, circA.. spiral, <4 digits>-<n> both
    """
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    up = F.upper(stem)
    coded, numbered = collection == "coded", collection == "numbered"

    # fixed values: name patterns of the collections
    spiral_code = r"^V\d+[A-Z]E"
    wave_code = r"^V\d+[A-Z](O|[A-Z]\d)"
    spiral_tag = r"^(sp\d+|(?i:circA))-[HP]\d+$"
    wave_tag = r"^mea\d+-[HP]\d+$"

    kind = (
        F.when(coded & up.rlike(spiral_code), "spiral")
        .when(coded & up.rlike(wave_code), "wave")
        .when(coded, "unknown")
        .when(numbered, "both")
        .when(stem.rlike(spiral_tag), "spiral")
        .when(stem.rlike(wave_tag), "wave")
        .otherwise("both")
    )
    digits = F.regexp_extract(up, r"^V(\d+)", 1)
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    group = F.when(F.substring(up, F.length(digits) + 2, F.lit(1)) == "P", "PD_").otherwise("H_")
    plain = F.regexp_replace(stem, r"^(\d+)-\d+$", "$1")
    tagged = F.regexp_replace(stem, r"^((?:sp|mea)\d+)-[HP](\d+)$|^(\d{4})-\d+$", "$1$3_$2")
    tagged = F.regexp_replace(tagged, r"^(\d{4})_$", "$1")
    tagged = F.regexp_replace(tagged, r"^(?i:circA)-[HP](\d+)$", "circA_$1")
    subject = (
        F.when(coded & (kind == "unknown"), F.concat(lit("UNK_"), up))
        .when(coded, F.concat(group, padded))
        .when(numbered, F.concat(F.when(plain == stem, "HPD_UNK_").otherwise("HPD_"), plain))
        .otherwise(F.concat(F.when(tagged == stem, "NHPD_UNK_").otherwise("NHPD_"), tagged))
    )
    return F.struct(kind.alias("kind"), subject.alias("subject"))


def drawing_pools(kind: Column) -> Column:
    """Pools a drawing belongs to; empty for unknown kinds."""
    return (
        F.when(kind == "both", F.array(lit("spiral"), lit("wave")))
        .when(kind.isin("spiral", "wave"), F.array(kind))
        .otherwise(F.array().cast("array<string>"))
    )
