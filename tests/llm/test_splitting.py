import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm.splitting import bisect_spans, findings, longest_stretch, split_texts


@given(st.text(alphabet="ab .,\n。!", max_size=400), st.integers(12, 60), st.integers(0, 10))
@settings(max_examples=200, deadline=None)
def test_spans_cover_and_fit(text, limit, overlap):
    spans = bisect_spans(text, limit, overlap) if text else []
    assert "".join(text[a:b] for a, b, _ in spans) == text
    assert all(0 < b - a <= limit for a, b, _ in spans)


def test_cuts_at_the_strongest_boundary_near_the_middle():
    text = "one two three. four five\n\nsix seven eight nine ten"
    (a, b, _), (c, d, s) = bisect_spans(text, 30)
    assert text[a:b].endswith("\n\n") and s == 5 and (b, d) == (c, len(text))


def test_boundaries_far_from_the_middle_come_before_bare_cuts():
    for text in ("x" * 5 + " " + "y" * 90, "y" * 89 + " " + "x" * 6, "x" * 30 + " " + "y" * 68):
        spans = bisect_spans(text, 90 if len(text) < 97 else 70, 2)
        assert [s for _, _, s in spans] == [0, 1] and "".join(text[a:b] for a, b, _ in spans) == text
    assert [s for _, _, s in bisect_spans("x " + "y" * 120, 70, 5)] == [0, 0]  # too close to the start for an overlap


SCHEMA = "id bigint, body string, item_key string, piece string"


def test_round_trip_overlap_and_edges(spark):
    long = "word " * 3000 + "x" * 5000
    rows = [(1, long, "c", "c"), (2, "", None, None), (3, None, None, None), (4, "short", None, None), (None, "y" * 120, None, None), (5, "tie tie. " * 30, None, None), (5, "tie tie. " * 30, None, None)]
    out = split_texts(spark.createDataFrame(rows, SCHEMA), "id", "body", 100, 20).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["item_key"] or -1, r["piece_no"])):
        assert len(r["piece"]) <= 100
        by.setdefault(r["item_key"], []).append(r)
    assert set(by) == {1, 4, None, 5}
    whole = by[1][0]["piece"] + "".join(r["piece"][20:] for r in by[1][1:])
    assert whole == long
    assert all(a["piece"][-20:] == b["piece"][:20] for a, b in zip(by[1], by[1][1:]))
    assert len([r for r in by[5] if r["piece_no"] == 0]) == 2  # repeated rows are split each
    found = findings(split_texts(spark.createDataFrame(rows, SCHEMA), "id", "body", 100, 20), "t", 100).collect()
    assert sorted((r["item_key"] or 0, r["kind"]) for r in found) == [(0, "oversized"), (0, "unbroken"), (1, "oversized"), (1, "unbroken"), (5, "oversized"), (5, "oversized")]


def test_empty_table_and_bad_limits(spark):
    assert split_texts(spark.createDataFrame([], SCHEMA), "id", "body", 100, 20).count() == 0
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([], SCHEMA), "id", "body", 10, 10)


@given(st.text(max_size=80))
def test_longest_stretch_against_brute_force(text):
    best = run = 0
    for c in text:
        run = 0 if re.match(r"[\s.,;:!?…、。！？]", c) else run + 1
        best = max(best, run)
    assert longest_stretch(text) == best


def test_only_long_texts_reach_python(spark):
    df = spark.range(100).select(F.col("id"), F.lit("short").alias("body"))
    assert split_texts(df, "id", "body", 100, 20).count() == 100
