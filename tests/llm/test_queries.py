"""The queries of the eight problems over the smallest tables, whole: against SQL, brute force, or what their results must keep."""

import importlib
import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
QUERIES, SQL = registry.collect(importlib.import_module("sparkloom.llm"))

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def _rows(spark, name, *columns):
    df = QUERIES[name](spark, str(DATA))
    return [tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark):
    import duckdb

    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"create view {p.stem} as select * from '{p / '*.parquet' if p.is_dir() else p}'")
    result = c.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert Counter(_rows(spark, name, *names)) == Counter(result.fetchall())


def test_p1_turns_and_their_speech(spark):
    found, turns = _rows(spark, "p1_found", "origin", "item_key", "turn_no", "speaker_id"), QUERIES["p1_turns"](spark, str(DATA))
    assert len(found) == len(set(found)) and {o for o, *_ in found} == {"segments", "subtitle"}
    assert turns.where(F.trim("speech") == "").count() == 0
    assert turns.where("opens").count() == len(found)
    # Turns of a subtitle are numbered from 1 without a gap, and neighbours have different speakers.
    by = {}
    for o, key, no, who in sorted(found):
        if o == "subtitle":
            by.setdefault(key, []).append((no, who))
    assert all([n for n, _ in x] == list(range(1, len(x) + 1)) and all(a[1] != b[1] for a, b in zip(x, x[1:])) for x in by.values())


def test_p2_names_accepted_records_of_earlier_batches(spark):
    found = dict((b, a) for a, b in _rows(spark, "p2_found", "first_record_id", "record_id"))
    batch = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/batch_records.parquet").select("record_id", "batch_id").collect()}
    assert found and all(a == 0 or (a not in found and batch[a] < batch[b]) for b, a in found.items())
    counts = _rows(spark, "p2_by_batch", "repeats", "skipped")
    assert sum(r for r, _ in counts) == sum(a > 0 for a in found.values()) and sum(s for _, s in counts) == sum(a == 0 for a in found.values())


def test_p4_lists_are_ranked(spark):
    rows = _rows(spark, "p4_neighbours", "vector_row", "rank", "neighbour_row", "cosine")
    by = {}
    for v, rank, n, c in sorted(rows):
        by.setdefault(v, []).append((rank, n, c))
    assert all([r for r, *_ in x] == list(range(1, len(x) + 1)) and all(a[2] >= b[2] for a, b in zip(x, x[1:])) and v not in {n for _, n, _ in x} for v, x in by.items())


def test_p5_pairs_against_their_counts(spark):
    found = _rows(spark, "p5_found", "row_a", "row_b")
    assert found and len(found) == len(set(found)) and all(a < b for a, b in found)
    assert sum(p for p, _ in _rows(spark, "p5_counts", "pairs", "leaked_rows")) == len(found)


def test_p6_places_every_token_once(spark):
    packed = QUERIES["p6_packing"](spark, str(DATA))
    capacity = spark.read.parquet(f"{DATA}/size_limits.parquet").where("target = 'documents.text'").first()["max_size"]
    rows = packed.select("container_id", "token_offset", "n_tokens", "doc_id", "piece_no", "char_start", "char_end").collect()
    room = {}
    for r in sorted(rows, key=lambda r: (r["container_id"], r["token_offset"])):
        assert room.get(r["container_id"], 0) == r["token_offset"]
        room[r["container_id"]] = r["token_offset"] + r["n_tokens"]
    assert max(room.values()) <= capacity and len({(r["doc_id"], r["piece_no"]) for r in rows}) == len(rows)
    text = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("text <> ''").collect()}
    spans = {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["char_start"], r["char_end"]))
    assert spans.keys() == text.keys()
    for d, s in spans.items():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] == len(text[d]) and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    ((containers, least),) = _rows(spark, "p6_report", "containers", "least_containers")
    assert containers == len(room) and containers <= 1.02 * least + 1


def test_p7_against_all_runs(spark):
    from sparkloom.llm.leaks import text_words

    runs = lambda w: {tuple(w[i : i + 15]) for i in range(len(w) - 14)}
    items = {r[0]: runs(text_words(r[1])) for r in spark.read.parquet(f"{DATA}/eval_items.parquet").select("item_id", "text").collect() if r[1]}
    docs = {r[0]: runs(text_words(r[1])) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if r[1]}
    want = {(d, i) for d, x in docs.items() for i, y in items.items() if x & y}
    assert set(_rows(spark, "p7_found", "doc_id", "item_id")) == want and want
    assert sum(v for v, _ in _rows(spark, "p7_report", "verbatim_docs", "paraphrase_docs")) == len(want)


def test_p8_places_are_replaced(spark):
    text = {r[0]: r[1] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    found = _rows(spark, "p8_found", "doc_id", "kind", "start_pos")
    assert {k for _, k, _ in found} <= {"email", "phone", "id", "address", "name"}
    spark.conf.set("sparkloom.pseudonym.key", "00" * 16)
    try:
        first, again = dict(_rows(spark, "p8_redacted", "doc_id", "text")), dict(_rows(spark, "p8_redacted", "doc_id", "text"))
    finally:
        spark.conf.unset("sparkloom.pseudonym.key")
    assert first == again and first.keys() == text.keys()
    held = Counter(d for d, *_ in found)
    for d, t in text.items():
        if d not in held and t and "[" not in t:
            assert first[d] == t or "[DATE " in first[d] or "[ACCOUNT " in first[d]
        elif d in held:
            assert sum(first[d].count(f"[{k} ") for k in ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")) >= held[d]
