"""Expected outcomes of the rules on single rows."""

import pytest
from pyspark.sql import functions as F

from timbrel.functions import rules as R
from timbrel.functions import scalars as S

c, lit = F.col, F.lit


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_quality_audit_good_and_bad(spark):
    good = one(spark, R.quality_audit(*map(lit, (30.0, 2.0, False, 90.0, 15.0, 1.0))))
    assert good.score >= 4.5 and good.reliability == "High" and not good.re_record
    assert good.stars == "★★★★★" and good.reasons == []
    bad = one(spark, R.quality_audit(*map(lit, (5.0, 55.0, True, 10.0, 2.0, 1.0))))
    assert bad.score <= 2.5 and bad.re_record and "signal clipping" in bad.reasons
    assert "Reasons identified: high background noise, signal clipping" in bad.message


def test_quality_audit_odd_microphone_only_when_nothing_else(spark):
    odd = one(spark, R.quality_audit(*map(lit, (30.0, 2.0, False, 90.0, 15.0, 0.75))))
    assert odd.score == 4.0 and odd.reasons == ["abnormal microphone response or reverb"]
    far = one(spark, R.quality_audit(*map(lit, (30.0, 2.0, False, 90.0, 15.0, 0.5))))
    assert far.score == 2.5 and len(far.reasons) == 2


def test_trust(spark):
    high = one(spark, R.trust(*map(lit, (0.90, 4.8, 5.0, 92.0, 97.0))))
    assert high.level == "High" and high.score >= 80
    low = one(spark, R.trust(*map(lit, (0.90, 2.0, 5.0, 92.0, 97.0))))
    assert low.level == "Low" and low.score <= 30
    assert low.reasons[0] == "reduced recording quality (Audit Score: 2.0 Stars)"


def test_out_of_distribution(spark):
    inside = one(spark, R.out_of_distribution(lit(1.5), lit(1.0)))
    assert not inside.is_ood and inside.probability == 37.5
    outside = one(spark, R.out_of_distribution(lit(0.9), lit(1.0)))
    assert outside.is_ood and outside.probability == 60.0
    none = one(spark, R.out_of_distribution(lit(None).cast("double"), lit(1.0)))
    assert not none.is_ood and none.probability == 0.0 and "not trained" in none.reason


FUSE = dict(
    risk=0.88, trust_score=85.0, trust_level="High", quality=4.5, re_record=False, reasons=[],
    ood=5.0, is_ood=False, sim_pd=90.0, sim_healthy=10.0, nearest="Parkinson's Cluster",
    auth=98.0, is_authentic=True, drift=None,
)


def fused(spark, **given):
    v = {**FUSE, **given}
    reasons = F.array(*map(lit, v.pop("reasons"))).cast("array<string>")
    cols = {k: lit(x) if x is not None else lit(None).cast("double") for k, x in v.items()}
    return R.fuse(spark.range(1), reasons=reasons, **cols).first()


@pytest.mark.parametrize(
    "given, rule, status, trust",
    [
        (dict(is_authentic=False), "spoofed", 4, 15.0),
        (dict(quality=2.0, re_record=True, reasons=["signal clipping"]), "poor_quality", 5, 20.0),
        (dict(ood=80.0), "atypical", 2, 35.0),
        (dict(risk=0.5, sim_pd=50.0, trust_score=45.0), "inconclusive", 3, 45.0),
        ({}, "agree_high", 1, 85.0),
        (dict(risk=0.1, sim_pd=10.0, sim_healthy=90.0), "agree_low", 0, 85.0),
        (dict(sim_pd=20.0), "diverge_down", 2, 70.0),
        (dict(risk=0.1, trust_level="Low", trust_score=40.0), "diverge_up", 2, 35.0),
        (dict(risk=0.5), "standard", 2, 85.0),
    ],
)
def test_fusion_rules(spark, given, rule, status, trust):
    row = fused(spark, **given)
    assert (row["rule"], row["status"], row["final_trust"]) == (rule, status, trust)


def test_fusion_texts(spark):
    bad = fused(spark, quality=2.0, re_record=True, reasons=["signal clipping", "x"])
    assert "Suspended" in bad["status_label"] and "due to: signal clipping, x." in bad["reasoning"]
    assert "recording" in bad["advice"]
    shifted = fused(spark, drift=0.2)
    assert "(90.0% pathology similarity)" in shifted["reasoning"]
    assert shifted["reasoning"].endswith("previous baseline recordings.")
    assert "Note:" not in fused(spark, drift=0.2, sim_pd=20.0)["reasoning"]


def alternative(spark, **given):
    v = dict(risk=0.9, confidence=0.8, quality=5.0, re_record=False, ood=5.0, is_ood=False,
             similarity=90.0, nearest="x")
    v.update(given)
    cols = {k: lit(x) for k, x in v.items()}
    return R.fuse_by_confidence(
        spark.range(1), reasons=F.array(lit("noise")).cast("array<string>"), **cols).first()


@pytest.mark.parametrize(
    "given, rule, score",
    [
        (dict(quality=2.0), "poor_quality", 30.0),
        (dict(ood=71.0), "atypical", 40.0),
        (dict(risk=0.5, similarity=50.0), "inconclusive", 50.0),
        ({}, "agree_high", 95.0),
        (dict(risk=0.1, similarity=10.0), "agree_low", 95.0),
        (dict(similarity=10.0), "diverge_down", 65.0),
        (dict(risk=0.1), "diverge_up", 65.0),
        (dict(risk=0.5), "standard", 80.0),
    ],
)
def test_second_fusion(spark, given, rule, score):
    row = alternative(spark, **given)
    assert (row["rule"], row["score"]) == (rule, score)


def test_authenticity(spark):
    silent = one(spark, R.authenticity(*map(lit, (0.0, 2000.0, 3000.0, 0.1, 20.0, 50, True))))
    assert silent.score == 0.0 and silent.confidence == "High" and not silent.is_authentic
    robot = one(spark, R.authenticity(*map(lit, (0.002, 1000.0, 2000.0, 0.0001, 2.0, 50))))
    assert robot.score == 0.0 and len(robot.warnings) == 4
    assert robot.warnings[0] == "Digital saturation clipping detected (0.20% clipped)."
    few = one(spark, R.authenticity(*map(lit, (0.0, 2000.0, 3000.0, 0.1, 2.0, 10))))
    assert few.score == 100.0 and few.is_authentic


def test_recording_quality_default(spark):
    null = lit(None).cast("double")
    row = one(spark, R.recording_quality(null, lit(90.0), lit(9.0), lit(1.0), lit(False)))
    assert (row.score, row.stars, row.suitable) == (1, "★☆☆☆☆", False)
    best = one(spark, R.recording_quality(*map(lit, (30.0, 90.0, 12.0, 2.0, False))))
    assert (best.score, best.warning) == (5, None)


@pytest.mark.parametrize(
    "name, collection, kind, subject",
    [
        ("V03HE1.png", "coded", "spiral", "H_003"),
        ("v12po02.png", "coded", "wave", "PD_012"),
        ("V1234PE1.png", "coded", "spiral", "PD_1234"),
        ("V05PX7.png", "coded", "wave", "PD_005"),
        ("scan.png", "coded", "unknown", "UNK_SCAN"),
        ("0042-3.jpg", "numbered", "both", "HPD_0042"),
        ("odd.jpg", "numbered", "both", "HPD_UNK_odd"),
        ("0042-3.jpg", "tagged", "both", "NHPD_0042"),
        ("042-3.jpg", "tagged", "both", "NHPD_UNK_042-3"),
        ("sp1-P12.jpg", "tagged", "spiral", "NHPD_sp1_12"),
        ("mea3-H7.jpg", "tagged", "wave", "NHPD_mea3_7"),
        ("circA-P5.jpg", "tagged", "spiral", "NHPD_circA_5"),
        ("CIRCa-H5.jpg", "tagged", "spiral", "NHPD_circA_5"),
        ("note.jpg", "tagged", "both", "NHPD_UNK_note"),
    ],
)
def test_drawing_names(spark, name, collection, kind, subject):
    row = one(spark, S.drawing(lit(name), lit(collection)))
    assert (row.kind, row.subject) == (kind, subject)


def test_drawing_pools(spark):
    assert one(spark, S.drawing_pools(lit("both"))) == ["spiral", "wave"]
    assert one(spark, S.drawing_pools(lit("wave"))) == ["wave"]
    assert one(spark, S.drawing_pools(lit("unknown"))) == []


@pytest.mark.parametrize(
    "name, size, reason",
    [
        ("a.wav", 10, None), ("a.b.MP3", 10, None), ("a.txt", 10, "unsupported_format"),
        ("", 10, "no_name"), (None, 10, "no_name"), ("a.wav", 10 * 1024 * 1024, None),
        ("a.wav", 10 * 1024 * 1024 + 1, "too_large"),
    ],
)
def test_admission(spark, name, size, reason):
    assert one(spark, R.admission(lit(name).cast("string"), lit(size))) == reason


def test_biomarkers_leave_absent_ones_out(spark):
    got = one(spark, R.biomarker_statuses(
        {"fo_mean": lit(300.0), "shimmer_local": lit(0.02), "hnr": lit(None).cast("double")}))
    assert [(r.key, r.value, r.status) for r in got] == [
        ("fo_mean", "300.0", "High"), ("shimmer_local", "2.0", "Normal"),
        ("mfcc_profile", "—", "Normal")]


def test_descriptor_order(spark):
    assert one(spark, S.descriptor(lit("Harmonics-to-Noise (HNR)"), lit(1.0))) == (
        "Reduced Harmonic-to-Noise Ratio")
    assert one(spark, S.descriptor(lit("Pitch Jitter (%)"), lit(-1.0))) == "Reduced Jitter"
    assert one(spark, S.descriptor(lit("Odd"), lit(0.0))) == "Reduced Odd"


def test_explanation_without_attributions(spark):
    empty = F.array().cast("array<struct<label: string, value: double>>")
    assert "did not identify" in one(spark, R.explanation(empty, lit(0.1)))
    assert "currently unavailable" in one(spark, R.explanation(empty, lit(0.9)))


def test_scalars(spark):
    assert one(spark, S.two_way_share(lit(50.0), lit(-50.0))) == pytest.approx(100.0)
    assert one(spark, S.two_way_share(lit(-50.0), lit(50.0))) == pytest.approx(0.0)
    assert one(spark, S.decibel(lit(0.0))) == -100.0
    assert one(spark, S.shown_snr(lit(0.0))) == 29
    assert one(spark, S.range_percent(lit(0.5), lit(0.5), lit(0.5))) == 0.0
    assert one(spark, S.subject_id(lit("phon_R01_S01_3"))) == "phon_R01_S01"
    assert one(spark, S.subject_id(lit("phon"))) == "phon"
    assert one(spark, S.stars(lit(2.5))) == "★★☆☆☆"
    assert one(spark, S.fixed_text(lit(0.0625), 3)) == "0.062"
    assert one(spark, S.report_id(lit("/r/report_ab12.pdf"))) == "ab12"
    assert one(spark, S.reference_code(lit("/r/report_ab12.pdf"))) == "VV-AB12"
    assert one(spark, S.clamp(lit(None).cast("double"), 0, 1)) is None


def test_radar_defaults(spark):
    null = lit(None).cast("double")
    got = one(spark, R.radar(lit(400.0), lit(0.5), lit(0.04), null, lit(0.02), lit(0.1)))
    assert [r.voice for r in got] == [32, 85, 68, 80, 96, 85]
