"""Ordered rules as column expressions: the first matching rule wins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.functions import fixed
from timbrel.functions.scalars import (
    certainty,
    clamp,
    descriptor,
    english_list,
    explanation_phrase,
    fixed_text,
    half_even,
    half_up,
    lit,
    present,
    stars,
)


def steps(x: Column, rungs: Iterable[tuple[float, object]], otherwise) -> Column:
    """Value of the first rung with ``x >= bound``."""
    out = None
    for bound, value in rungs:
        out = F.when(x >= bound, value) if out is None else out.when(x >= bound, value)
    return out.otherwise(otherwise)


def band(risk: Column) -> Column:
    """1 elevated, 0 low (bounds included), 2 between."""
    return F.when(risk >= fixed.HIGH_BAND, 1).when(risk <= fixed.LOW_BAND, 0).otherwise(2)


def advice_band(risk: Column) -> Column:
    """As ``band`` with both lower bounds exclusive: below 0.35 low, below 0.65 between."""
    return F.when(risk < fixed.LOW_BAND, 0).when(risk < fixed.HIGH_BAND, 2).otherwise(1)


def by_value(x: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        value = lit(v) if not isinstance(v, (tuple, list)) else F.array(*[lit(i) for i in v])
        out = F.when(x == k, value) if out is None else out.when(x == k, value)
    return out


# --- recording quality -------------------------------------------------------------------


def quality_points(
    snr: Column, coverage: Column, duration: Column, noise: Column, clipped: Column
) -> Column:
    return (
        steps(snr, [(25, 30), (15, 20), (8, 10)], 2)
        + steps(coverage, [(60, 25), (40, 18), (20, 10)], 2)
        + steps(duration, [(10, 20), (5, 12), (2, 6)], 1)
        + F.when(noise <= 10, 15).when(noise <= 25, 10).when(noise <= 50, 5).otherwise(1)
        + F.when(clipped, 0).otherwise(10)
    )


def recording_quality(
    snr: Column, coverage: Column, duration: Column, noise: Column, clipped: Column
) -> Column:
    """struct(score 1-5, stars, suitable, warning); the unreadable default on null input."""
    points = quality_points(snr, coverage, duration, noise, clipped)
    score = steps(points, [(85, 5), (65, 4), (45, 3), (25, 2)], 1)
    read = snr.isNotNull() & coverage.isNotNull() & duration.isNotNull() & noise.isNotNull()
    score = F.when(read, score).otherwise(1)
    return F.struct(
        score.cast("long").alias("score"),
        stars(score).alias("stars"),
        (read & (score >= 2)).alias("suitable"),
        F.when(~read, fixed.QUALITY_UNREADABLE)
        .when(score <= 2, fixed.QUALITY_WARNING)
        .alias("warning"),
    )


def microphone_status(peak: Column, clipped: Column, snr: Column) -> Column:
    return (
        F.when(peak < 0.001, "No Signal")
        .when(clipped, "Clipping Detected")
        .when(snr < 10, "Noisy")
        .otherwise("Good")
    )


def capture_quality(noise: Column, clipped: Column) -> Column:
    noise = F.coalesce(noise, lit(0.002))
    score = clamp(100 - noise * 800, 30.0, 100.0) - F.when(clipped, 20).otherwise(0)
    return half_up(score).cast("long")


# --- audits --------------------------------------------------------------------------------


def authenticity(
    clip_ratio: Column,
    bandwidth: Column,
    rolloff: Column,
    flatness: Column,
    f0_std: Column,
    n_voiced: Column,
    silent: Column | None = None,
) -> Column:
    """struct(score, confidence, warnings, is_authentic)."""
    silent = lit(False) if silent is None else silent
    clipped = clip_ratio > 0.001
    narrow = bandwidth < 1500
    replay = (rolloff < 2500) & (flatness < 0.0005)
    enough = n_voiced > 10
    monotone = enough & (f0_std < 4.0)
    unstable = enough & (f0_std > 120.0)
    penalty = (
        F.when(clipped, F.least(lit(40.0), clip_ratio * 1000.0)).otherwise(0.0)
        + F.when(narrow, 25.0).otherwise(0.0)
        + F.when(replay, 30.0).otherwise(0.0)
        + F.when(monotone, 45.0).when(unstable, 20.0).otherwise(0.0)
    )
    score = F.when(silent, 0.0).otherwise(clamp(100.0 - penalty, 0.0, 100.0))
    warnings = F.when(silent, F.array(lit(fixed.AUTH_SILENT))).otherwise(
        present(
            F.when(
                clipped,
                F.concat(
                    lit("Digital saturation clipping detected ("),
                    fixed_text(clip_ratio * 100, 2, "% clipped)."),
                ),
            ),
            F.when(narrow, fixed.AUTH_NARROW),
            F.when(replay, fixed.AUTH_REPLAY),
            F.when(monotone, fixed.AUTH_MONOTONE).when(unstable, fixed.AUTH_UNSTABLE),
        )
    )
    return F.struct(
        half_even(score, 1).alias("score"),
        F.when((score > 85) | (score < 40), "High").otherwise("Moderate").alias("confidence"),
        warnings.alias("warnings"),
        (score >= 65).alias("is_authentic"),
    )


def quality_audit(
    snr: Column,
    noise: Column,
    clipped: Column,
    coverage: Column,
    duration: Column,
    similarity: Column,
) -> Column:
    """struct(score, stars, reliability, re_record, message, reasons)."""
    noisy = (snr < 12) | (noise > 35)
    short = (coverage < 30) | (duration < 5)
    far = similarity < 0.72
    odd_mic = (similarity < 0.78) & ~(noisy | clipped | short)
    findings = [(noisy, 1.5), (clipped, 2.0), (short, 1.5), (far, 1.5), (odd_mic, 1.0)]
    score = lit(5.0)
    for cond, cost in findings:
        score = score - F.when(cond, cost).otherwise(0.0)
    score = clamp(score, 1.0, 5.0)
    reasons = present(
        *[F.when(c, text) for (c, _), text in zip(findings, fixed.QUALITY_REASONS)]
    )
    re_record = score < 3.0
    return F.struct(
        half_even(score, 1).alias("score"),
        stars(score).alias("stars"),
        steps(score, [(4.0, "High"), (2.5, "Moderate")], "Low").alias("reliability"),
        re_record.alias("re_record"),
        F.when(
            re_record,
            F.concat(
                lit(fixed.RE_RECORD),
                F.when(
                    F.size(reasons) > 0,
                    F.concat(
                        lit(" Reasons identified: "), F.array_join(reasons, ", "), lit(".")
                    ),
                ).otherwise(""),
            ),
        )
        .otherwise(fixed.QUALITY_OK)
        .alias("message"),
        reasons.alias("reasons"),
    )


def out_of_distribution(raw: Column, threshold: Column) -> Column:
    """struct(is_ood, probability, raw, reason); the not-loaded default on a null score."""
    inside = raw >= threshold
    above = F.greatest(lit(1e-5), raw - threshold)
    p = F.when(inside, clamp(50.0 - above / 2.0 * 50.0, 0.0, 50.0)).otherwise(
        F.least(lit(100.0), 50.0 + (threshold - raw) / 0.5 * 50.0)
    )
    missing = raw.isNull() | threshold.isNull()
    return F.struct(
        F.when(missing, False).otherwise(~inside).alias("is_ood"),
        F.when(missing, 0.0).otherwise(half_even(p, 1)).alias("probability"),
        F.when(missing, 0.0).otherwise(half_even(raw, 4)).alias("raw"),
        F.when(missing, fixed.OOD_NOT_LOADED)
        .when(inside, fixed.OOD_INSIDE)
        .when(p > 85, fixed.OOD_CRITICAL)
        .otherwise(fixed.OOD_MODERATE)
        .alias("reason"),
    )


def trust(
    risk: Column, quality: Column, ood: Column, similarity: Column, auth: Column
) -> Column:
    """struct(score, level, reasons)."""
    split = (risk >= 0.5) != (similarity >= 50)
    low_quality, low_auth, off = quality < 4, auth < 85, ood > 25
    bad_quality, spoof, outside = quality < 2.5, auth < 65, ood > 75
    score = (
        50.0
        + certainty(risk) * 45.0
        - F.when(split, 15.0).otherwise(0.0)
        - F.when(low_quality, (4.0 - quality) * 12.0).otherwise(0.0)
        - F.when(low_auth, (85.0 - auth) * 0.6).otherwise(0.0)
        - F.when(off, (ood - 25.0) * 0.5).otherwise(0.0)
    )
    for cond, cap in ((bad_quality, 30.0), (spoof, 25.0), (outside, 35.0)):
        score = F.least(score, F.when(cond, cap).otherwise(99.0))
    score = clamp(score, 10.0, 99.0)
    return F.struct(
        half_even(score, 1).alias("score"),
        steps(score, [(75, "High"), (45, "Medium")], "Low").alias("level"),
        present(
            F.when(split, fixed.TRUST_DIVERGENCE),
            F.when(
                low_quality,
                F.concat(
                    lit("reduced recording quality (Audit Score: "),
                    fixed_text(quality, 1, " Stars)"),
                ),
            ),
            F.when(low_auth, fixed.TRUST_AUTH),
            F.when(off, fixed.TRUST_OOD),
            F.when(bad_quality, fixed.TRUST_BAD_QUALITY),
            F.when(spoof, fixed.TRUST_SPOOF),
            F.when(outside, fixed.TRUST_OUTSIDE),
        ).alias("reasons"),
    )


def cohort_match(sim_pd: Column, sim_healthy: Column) -> Column:
    """struct(nearest, confidence) from two cosine similarities."""
    return F.struct(
        F.when(sim_pd > sim_healthy, fixed.CLUSTERS[1])
        .otherwise(fixed.CLUSTERS[0])
        .alias("nearest"),
        steps(F.abs(sim_pd - sim_healthy), [(0.04, "High"), (0.015, "Moderate")], "Low").alias(
            "confidence"
        ),
    )


def drift_status(drift: Column) -> Column:
    """struct(drift, shifted, status); a null drift means there is no baseline yet."""
    d = F.coalesce(drift, lit(0.0))
    shifted = d > fixed.DRIFT_LIMIT
    return F.struct(
        half_even(d, 4).alias("drift"),
        shifted.alias("shifted"),
        F.when(shifted, fixed.DRIFT_SHIFT).otherwise(fixed.DRIFT_STABLE).alias("status"),
    )


# --- fusion --------------------------------------------------------------------------------


def _filled(text: Column, fills: dict[str, Column]) -> Column:
    for name, value in fills.items():
        text = F.replace(text, lit("{" + name + "}"), value)
    return text


def fuse(
    df: DataFrame,
    *,
    risk: Column,
    trust_score: Column,
    trust_level: Column,
    quality: Column,
    re_record: Column,
    reasons: Column,
    ood: Column,
    is_ood: Column,
    sim_pd: Column,
    sim_healthy: Column,
    nearest: Column,
    auth: Column,
    is_authentic: Column,
    drift: Column,
) -> DataFrame:
    """Attach rule, status, status_label, final_trust, final_level, reasoning, advice."""
    b = F.col("_band")
    rule = (
        F.when(~is_authentic | (auth < 65), "spoofed")
        .when(re_record | (quality < 2.5), "poor_quality")
        .when(is_ood | (ood > 75), "atypical")
        .when((b == 2) & sim_pd.between(40, 60), "inconclusive")
        .when((b == 1) & (trust_level == "High") & (sim_pd > 65), "agree_high")
        .when((b == 0) & (trust_level == "High") & (sim_healthy > 65), "agree_low")
        .when((b == 1) & (sim_pd < 35), "diverge_down")
        .when((b == 0) & (sim_pd > 65), "diverge_up")
        .otherwise("standard")
    )
    # fixed values: trust cap per rule
    caps = {"spoofed": 15.0, "poor_quality": 20.0, "atypical": 35.0, "inconclusive": 50.0}
    diverging = ("diverge_down", "diverge_up")
    r = F.col("rule")
    table = fixed.DECISIONS
    final_trust = None
    for name, cap in caps.items():
        value = F.least(trust_score, lit(cap))
        final_trust = (
            F.when(r == name, value) if final_trust is None else final_trust.when(r == name, value)
        )
    final_trust = final_trust.when(
        r.isin(*diverging), F.greatest(lit(35.0), trust_score - 15.0)
    ).otherwise(trust_score)
    note = F.when(
        r.isin("agree_high", "agree_low", "standard") & (F.coalesce(drift, lit(0.0))
                                                         > fixed.DRIFT_LIMIT),
        lit(" Note: " + fixed.DRIFT_SHIFT),
    ).otherwise("")
    reason_text = F.when(
        F.size(reasons) > 0, F.concat(lit(" due to: "), F.array_join(reasons, ", "))
    ).otherwise("")
    fills = {
        "reasons": reason_text,
        "pd": sim_pd.cast("string"),
        "healthy": sim_healthy.cast("string"),
        "cluster": nearest,
    }
    return (
        df.withColumn("_band", band(risk))
        .withColumn("rule", rule)
        .withColumns(
            {
                "status": F.coalesce(by_value(r, {k: v[0] for k, v in table.items()}), b).cast(
                    "long"
                ),
                "status_label": F.coalesce(
                    by_value(r, {k: v[1] for k, v in table.items()}),
                    by_value(b, fixed.STATUS_LABEL),
                ),
                "final_trust": half_even(final_trust, 1),
                "final_level": F.when(r.isin(*caps), "Low")
                .when(r.isin(*diverging), "Medium")
                .otherwise(trust_level),
                "reasoning": F.concat(
                    _filled(by_value(r, {k: v[2] for k, v in table.items()}), fills), note
                ),
                "advice": F.coalesce(
                    by_value(r, {k: v[3] for k, v in table.items()}),
                    by_value(b, fixed.STANDARD_ADVICE),
                ),
            }
        )
        .drop("_band")
    )


def fuse_by_confidence(
    df: DataFrame,
    *,
    risk: Column,
    confidence: Column,
    quality: Column,
    re_record: Column,
    reasons: Column,
    ood: Column,
    is_ood: Column,
    similarity: Column,
    nearest: Column,
) -> DataFrame:
    """Second fusion: attach rule, status, status_label, score, label, reasoning, advice."""
    b, r = F.col("_band"), F.col("rule")
    start = confidence * 100.0
    agree = (confidence >= 0.70) & (quality >= 4)
    rule = (
        F.when(re_record | (quality <= 2), "poor_quality")
        .when(is_ood | (ood > 70), "atypical")
        .when((b == 2) & similarity.between(45, 55), "inconclusive")
        .when((b == 1) & agree & (similarity > 65), "agree_high")
        .when((b == 0) & agree & (similarity < 35), "agree_low")
        .when((b == 1) & (similarity < 35), "diverge_down")
        .when((b == 0) & (similarity > 65), "diverge_up")
        .otherwise("standard")
    )
    score = (
        F.when(r == "poor_quality", F.least(start, lit(30.0)))
        .when(r == "atypical", F.least(start, lit(40.0)))
        .when(r == "inconclusive", F.least(start, lit(50.0)))
        .when(r.isin("agree_high", "agree_low"), clamp(F.greatest(start, lit(95.0)), 0.0, 99.0))
        .when(r.isin("diverge_down", "diverge_up"), F.greatest(lit(50.0), start - 15.0))
        .otherwise(start)
    )
    table = fixed.ALT_DECISIONS
    fills = {"reasons": F.array_join(reasons, ", "), "cluster": nearest}
    return (
        df.withColumn("_band", band(risk))
        .withColumn("rule", rule)
        .withColumns(
            {
                "status": F.when(r == "inconclusive", 3).otherwise(b).cast("long"),
                "status_label": by_value(b, fixed.STATUS_LABEL),
                "score": half_even(score, 1),
                "label": F.coalesce(
                    by_value(r, {k: v[0] for k, v in table.items()}),
                    steps(start, [(70, "High"), (35, "Moderate")], "Low"),
                ),
                "reasoning": _filled(by_value(r, {k: v[1] for k, v in table.items()}), fills),
                "advice": F.coalesce(
                    by_value(r, {k: v[2] for k, v in table.items()}), by_value(b, fixed.ADVICE)
                ),
            }
        )
        .drop("_band")
    )


# --- labels and texts -------------------------------------------------------------------------


def certainty_label(p: Column) -> Column:
    rungs = fixed.CERTAINTY
    c = certainty(p)
    return F.struct(
        steps(c, [(r[0], r[1]) for r in rungs[:2]], rungs[2][1]).alias("label"),
        steps(c, [(r[0], r[2]) for r in rungs[:2]], rungs[2][2]).alias("meaning"),
    )


def confidence(c: Column, fused_score: Column, fused_label: Column) -> Column:
    """struct(score, label, reliability); fused values win where present."""
    own = half_even(clamp(F.coalesce(c, lit(0.5)) * 100.0, 50.0, 99.0), 1)
    score = F.coalesce(fused_score, own)
    label = steps(score, [(90, "Very High"), (70, "High"), (55, "Moderate")], "Low")
    return F.struct(
        score.alias("score"),
        F.coalesce(fused_label, label).alias("label"),
        steps(score, [(75, "High"), (55, "Moderate")], "Low").alias("reliability"),
    )


def biomarker_statuses(metrics: dict[str, Column]) -> Column:
    """array<struct(key, label, value, unit, reference_range, status)>, absent ones left out."""
    rows = []
    for key, label, unit, shown, low, high, below, above, scale in fixed.BIOMARKERS:
        raw = metrics.get(key)
        if raw is None:
            continue
        value = raw.cast("double") * scale
        status = lit("Normal")
        if high is not None:
            status = F.when(value <= high, status).otherwise(above)
        if low is not None:
            status = F.when(value < low, below).otherwise(status)
        rows.append(
            F.when(
                raw.isNotNull(),
                F.struct(
                    lit(key).alias("key"),
                    lit(label).alias("label"),
                    half_even(value, 3).cast("string").alias("value"),
                    lit(unit).alias("unit"),
                    lit(shown).alias("reference_range"),
                    status.alias("status"),
                ),
            )
        )
    names = ("key", "label", "value", "unit", "reference_range", "status")
    rows.append(F.struct(*[lit(v).alias(n) for n, v in zip(names, fixed.MFCC_ROW)]))
    return present(*rows)


def directional_biomarkers(top: Column) -> Column:
    """First five attributions (array<struct(label, value)>) with arrow and descriptor."""
    return F.transform(
        F.slice(top, 1, 5),
        lambda a: F.struct(
            a["label"].alias("label"),
            F.when(a["value"] > 0, "↑").otherwise("↓").alias("direction"),
            descriptor(a["label"], a["value"]).alias("descriptor"),
            half_even(a["value"], 4).alias("value"),
        ),
    )


def explanation(top: Column, risk: Column, fused: Column | None = None) -> Column:
    """Sentence from the first three attributions and the risk band; a text of the fusion goes first."""
    phrases = F.transform(
        F.slice(top, 1, 3), lambda a: explanation_phrase(a["label"], a["value"])
    )
    context = by_value(
        F.when(risk >= fixed.HIGH_BAND, 1).when(risk >= fixed.LOW_BAND, 2).otherwise(0),
        fixed.EXPLAIN_CONTEXT,
    )
    empty = F.when(risk < fixed.LOW_BAND, fixed.EXPLAIN_NONE_LOW).otherwise(fixed.EXPLAIN_NONE)
    own = F.when(top.isNull() | (F.size(top) == 0), empty).otherwise(
        F.concat(
            lit("The screening result was primarily influenced by "),
            english_list(phrases), lit(", "), context, lit("."),
        )
    )
    return own if fused is None else override(fused, own)


def override(fused: Column, own: Column) -> Column:
    """The text of the fusion where it has one, else the own text."""
    return F.when(F.length(F.coalesce(fused, F.lit(""))) > 0, fused).otherwise(own)


def recommendation(risk: Column, fused: Column | None = None) -> Column:
    own = by_value(advice_band(risk), fixed.ADVICE)
    return own if fused is None else override(fused, own)


def report(
    f0: Column, jitter_pct: Column, shimmer: Column, hnr: Column, risk: Column, top: Column
) -> Column:
    """struct(category, summary, biomarkers, advice)."""
    b = advice_band(risk)
    pct = shimmer * 100.0
    drivers = F.array_join(
        F.transform(
            F.slice(top, 1, 3),
            lambda a: F.concat(
                a["label"],
                F.when(a["value"] > 0, " (increased risk)").otherwise(" (decreased risk)"),
            ),
        ),
        ", ",
    )
    summary = F.concat(
        by_value(b, fixed.REPORT_SUMMARY),
        F.when(
            F.size(top) > 0, F.concat(lit(fixed.REPORT_DRIVERS), drivers, lit("."))
        ).otherwise(""),
    )

    # fixed values: names, formats and status texts of the four report rows
    def item(name: str, label: str, value: Column, status: Column) -> Column:
        return F.struct(
            lit(name).alias("name"), lit(label).alias("label"), value.alias("value"),
            status.alias("status"),
        )

    items = F.array(
        item(
            "vocal_fundamental_frequency", "Average Pitch (F0)",
            fixed_text(f0, 2, " Hz"),
            F.when((f0 > 0) & (f0 < 80), "Low (Deep voice/dysphonia potential)")
            .when(f0 > 280, "High (Tension potential)")
            .otherwise("Within range"),
        ),
        item(
            "pitch_jitter", "Pitch Jitter (Local)", fixed_text(jitter_pct, 3, "%"),
            F.when(jitter_pct > 1.04, "Elevated").otherwise("Normal"),
        ),
        item(
            "amplitude_shimmer", "Amplitude Shimmer", fixed_text(pct, 3, "%"),
            F.when(pct > 3.80, "Elevated").otherwise("Normal"),
        ),
        item(
            "hnr", "Harmonics-to-Noise (HNR)", fixed_text(hnr, 2, " dB"),
            F.when(hnr < 20.0, "Low (Breathiness)").otherwise("Normal (Stable)"),
        ),
    )
    return F.struct(
        by_value(b, fixed.STATUS_LABEL).alias("category"),
        summary.alias("summary"),
        items.alias("biomarkers"),
        by_value(b, fixed.REPORT_ADVICE).alias("advice"),
    )


def radar(
    f0: Column, jitter_pct: Column, shimmer: Column, hnr: Column, nhr: Column, energy: Column
) -> Column:
    """array<struct(axis, voice, cohort)>; an absent metric scores 80."""
    off = F.when(f0 < 85, 85 - f0).otherwise(f0 - 255)
    pct = F.when(shimmer < 0.1, shimmer * 100).otherwise(shimmer)

    def bounded(x: Column) -> Column:
        return clamp(half_up(x), 15, 99)

    # fixed values: axes and cohort scores
    rows = (
        ("Pitch Stability", f0, F.when(f0.between(85, 255), 92).otherwise(
            F.greatest(lit(25), half_up(90 - off * 0.4))), 85),
        ("Jitter (Pitch)", jitter_pct, bounded(100 - jitter_pct * 30), 90),
        ("Shimmer (Amp)", shimmer, bounded(100 - pct * 8), 90),
        ("Harmonic Ratio", hnr, bounded(hnr * 4), 85),
        ("Noise Ratio", nhr, bounded(100 - nhr * 200), 90),
        ("Spectral Energy", energy, lit(85), 85),
    )
    return F.array(
        *[
            F.struct(
                lit(axis).alias("axis"),
                F.when(raw.isNull(), 80).otherwise(score).cast("long").alias("voice"),
                lit(cohort).cast("long").alias("cohort"),
            )
            for axis, raw, score, cohort in rows
        ]
    )


def drawing_risk(p: Column) -> Column:
    """struct(label, positive) of a drawing score."""
    return F.struct(
        F.when(p < 0.3, "Low risk").when(p < 0.6, "Moderate risk").otherwise("High risk").alias(
            "label"
        ),
        (p >= 0.5).alias("positive"),
    )


def admission(name: Column, size: Column) -> Column:
    """Reason to reject an upload, null when it is admitted."""
    ext = F.element_at(F.split(F.lower(name), r"\."), -1)
    return (
        F.when(size > fixed.MAX_UPLOAD, "too_large")
        .when(name.isNull() | (name == ""), "no_name")
        .when(~ext.isin(*fixed.AUDIO_EXTENSIONS), "unsupported_format")
    )
