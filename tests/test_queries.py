"""Registered queries against their SQL twins on the smallest tables.

A spread of families runs by default; TIMBREL_ALL=1 runs every query that has a twin.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SAMPLE = """patient_decisions w1_jitter w6_longest_active_run g3_spectrogram_flatness
a15_recurrence_entropy a17_speech_levels a22_detrended_fluctuation j10_asof_lookup
j3_nearest_references m3_density_outlier a7_fold_average m7_subject_level_split m8_group_folds
u1_shared_subjects s1_feature_csv_scan s12_request_log r7_decision_fusion r13_explanation
t1_token_bucket t4_activity_sessions_stream t5_first_value_drift_stream""".split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TIMBREL_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, folder, duck, name):
    _, ok, note = compare(entry.queries()[name](spark, folder), duck, entry.oracle_sql()[name])
    assert ok, note


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
