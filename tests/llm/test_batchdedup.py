import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import batchdedup
from sparkloom.llm.batchdedup import Index, alike, refused, video_id

REC = "record_id bigint, batch_id bigint, video_id string, fake_url string, title string, description string, subtitle string, rid string, ord string, cls string"
CK = "batch_id bigint, skipped_video_ids array<string>, ord string"
SUB = "near the harbour a tiny crater guides the kettle that came from the valley with a jacket while the distant pilot lifts every rounded map twice before the market opens and the ferry leaves slowly for the island"


def _run(spark, rows, ck):
    recs = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], REC)
    return {(r[0], r[1]) for r in refused(recs, spark.createDataFrame([(*c, "x") for c in ck], CK)).collect()}


def _id(n):
    return f"vid{n:08d}"


def test_ids_contents_skips_and_uncommitted(spark):
    other = " ".join(reversed(SUB.split()))
    rows = [
        (1, 0, _id(1), "u", "A title of things", "Some words of description", SUB),
        (2, 0, _id(2), "u", "Another", "Other words here", other),
        (3, 1, f" {_id(1)}\n", "u", "x", "y", "z"),  # same id, padded
        (4, 1, None, f"https://tu.example/{_id(2)}", None, None, None),  # id from the address
        (5, 1, _id(5), "u", "A TITLE of thnigs", "Some words of description!", SUB.replace("kettle", "bucket")),  # near content
        (6, 1, _id(6), "u", "A title of things", "Some words of description", other),  # other subtitle
        (7, 1, _id(7), "u", "q", "w", "e r t"),  # skipped in batch 0
        (8, 2, _id(8), "u", "Never committed", "d", "s"),
        (9, 3, _id(8), "u", "Never committed", "d", "s"),  # batch 2 does not count
        (10, 3, _id(10), "u", "A title of things", "Some words of description", SUB),  # copy of 1, and of the refused 5
        (11, 3, _id(7), "u", None, None, None),  # skipped before
        (12, 0, _id(1), "u", None, None, None),  # same batch: accepted too
        (13, 3, None, None, None, None, None), (14, None, _id(1), "u", "t", "d", "s"), (None, 1, _id(1), "u", "t", "d", "s"),
        (3, 1, f" {_id(1)}\n", "u", "x", "y", "z"),  # repeated row
    ]
    ck = [(0, [f"https://www.tube.example/watch?v={_id(7)}", None]), (1, []), (3, None)]
    assert _run(spark, rows, ck) == {(1, 3), (2, 4), (1, 5), (0, 7), (1, 10), (0, 11)}


def test_accepted_only_counts(spark):
    """A record near a refused one only is accepted."""
    w = [f"w{i}" for i in range(60)]
    a, b, c = list(w), list(w), list(w)
    b[:7] = [f"b{i}" for i in range(7)]
    c[:7] = [f"b{i}" for i in range(7)]
    c[20:27] = [f"c{i}" for i in range(7)]
    rows = [(i, i, _id(i), "u", "the title", "the words", " ".join(x)) for i, x in enumerate((a, b, c))]
    assert alike(" ".join(a), " ".join(b)) and alike(" ".join(b), " ".join(c)) and not alike(" ".join(a), " ".join(c))
    assert _run(spark, rows, [(i, []) for i in range(3)]) == {(0, 1)}


def test_many_copies_and_empty(spark):
    rows = [(i, i // 20, _id(i), "u", "same", "same words", SUB) for i in range(100)]
    assert _run(spark, rows, [(i, []) for i in range(5)]) == {(0, i) for i in range(20, 100)}
    assert _run(spark, [], [(0, [])]) == set() and _run(spark, rows, []) == set()


def test_many_near_copies(spark):
    """More near copies than a search returns: all but the first are refused."""
    rows = [(i, i, _id(i), "u", "same", "same words", f"{SUB} n{i}") for i in range(40)]
    got = _run(spark, rows, [(i, []) for i in range(40)])
    assert got == {(0, i) for i in range(1, 40)}


def test_first_of_many_accepted_copies_is_named(spark):
    """The first batch holds more copies than a search returns; all are accepted and the lowest is named."""
    rows = [(i, 0, _id(i), "u", "same", "same words", f"{SUB} n{i}") for i in range(30)]
    rows += [(100 + i, 1 + i % 2, _id(100 + i), "u", "same", "same words", f"{SUB} n{i} m{i}") for i in range(30)]
    assert _run(spark, rows, [(i, []) for i in range(3)]) == {(0, 100 + i) for i in range(30)}


def test_drifting_families_against_a_sequential_simulation(spark):
    """Families that drift apart block by block: who is accepted hangs on who was refused, with every list full."""
    rng = np.random.default_rng(3)
    rows = []
    for f in range(2):
        w = [f"f{f}w{i}" for i in range(80)]
        for i in range(60):
            v = list(w)
            if i % 6 == 5:  # the family moves on
                at = int(rng.integers(0, 74))
                w[at : at + 5] = [f"f{f}s{i}x{j}" for j in range(5)]
            v[79] = f"n{i}"
            rows.append((f * 1000 + i, i // 10, _id(f * 1000 + i), "u", f"title {f}", f"words {f}", " ".join(v)))
    accepted, want = [], set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        by = [a[0] for a in accepted if a[1] < r[1] and a[4] == r[4] and alike(a[6], r[6])]
        if by:
            want.add((min(by), r[0]))
        else:
            accepted.append(r)
    # Ids rise with the batch within a family only, which is all that is named.
    assert len({a for a, _ in want}) > 3
    assert _run(spark, rows, [(i, []) for i in range(6)]) == want


def test_video_ids(spark):
    forms = ["abcDEF_-123", " abcDEF_-123\n", "https://www.tube.example/watch?v=abcDEF_-123", "http://m.tube.example/watch?app=m&v=abcDEF_-123", "https://tu.example/abcDEF_-123", "tube.example/embed/abcDEF_-123", "https://www.tube.example/shorts/abcDEF_-123?feature=share"]
    df = spark.createDataFrame([(f,) for f in forms], "f string")
    assert {r[0] for r in df.select(video_id(F.col("f"), F.lit(None).cast("string"))).collect()} == {"abcDEF_-123"}


def _history(seed=5, batches=13, families=25):
    """Batches of records, among them edited and exact copies of earlier ones, ids met again, and skipped videos."""
    rng = np.random.default_rng(seed)
    rows, ck, texts, n = [], [], [], 0
    for b in range(batches):
        for _ in range(40 if b == 0 else 12):
            if texts and rng.random() < 0.4:
                w = list(texts[int(rng.integers(0, min(len(texts), families)))])
                for _ in range(int(rng.integers(0, 4))):
                    w[int(rng.integers(0, len(w)))] = f"e{n}"
            else:
                w = [f"w{int(i)}" for i in rng.integers(0, 4000, 40)]
                texts.append(w)
            vid = _id(int(rng.integers(0, n + 1))) if rng.random() < 0.1 else _id(n)
            rows.append((n, b, vid, "u", " ".join(w[:4]), " ".join(w[4:12]), " ".join(w[12:])))
            n += 1
        ck.append((b, [_id(n + 3)] if b % 3 == 0 else None))
    return rows, ck


def _simulated(rows, ck):
    accepted, skips, out = [], set(), set()
    for b, skipped in ck:
        new = [r for r in rows if r[1] == b]
        kept = []
        for r in new:
            by = [a[0] for a in accepted if a[2] == r[2] or all(alike(x, y, i == 0) for i, (x, y) in enumerate(zip(a[4:], r[4:])))]
            if r[2] in skips:
                out.add((0, r[0]))
            elif by:
                out.add((min(by), r[0]))
            else:
                kept.append(r)
        accepted += kept
        skips |= set(skipped or [])
    return out


def _frames(spark, rows, ck):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], REC), spark.createDataFrame([(*c, "x") for c in ck], CK)


def _added(spark, path, rows, ck, cuts):
    """What an index refuses that gets the batches in calls of these sizes, opened anew for each."""
    out = set()
    for a, b in zip([0, *cuts], [*cuts, len(ck)]):
        recs, done = _frames(spark, [r for r in rows if a <= r[1] < b], ck[a:b])
        out |= {(r[0], r[1]) for r in Index(spark, path).add(recs, done).collect()}
    return out


def test_one_by_one_or_many_at_once_is_the_same(spark, tmp_path):
    rows, ck = _history(batches=7)
    want = _simulated(rows, ck)
    assert len(want) > 20 and {0} < {a for a, _ in want}
    assert _run(spark, rows, ck) == want
    one = str(tmp_path / "one")
    assert _added(spark, one, rows, ck, [1, 2, 5]) == want
    index = Index(spark, one)
    assert [s[2:] for s in index.live] == [[0, 4], [4, 6], [6, 7]]  # the blocks of 7 in binary
    assert len(index.batches) == 7
    with pytest.raises(ValueError):
        index.check(*_frames(spark, rows[:1], ck[:1]))


def test_a_batch_reads_shards_and_the_texts_of_its_candidates_only(spark, tmp_path):
    rows, ck = _history(batches=4, families=10)
    path = tmp_path / "index"
    _added(spark, str(path), rows, ck, [1, 2, 3])
    recs, done = _frames(spark, [(900, 9, _id(900), "u", *rows[3][4:]), (901, 9, _id(901), "u", "t", *rows[4][5:])], [(9, [])])
    near = (902, 9, _id(902), "u", rows[5][4], rows[5][5], rows[5][6] + " more")
    recs = recs.unionByName(_frames(spark, [near], [])[0])
    # Merged shards, shards of cut additions and the texts of additions without a candidate can go: nothing reads them.
    Index(spark, str(path)).vacuum()
    for v in range(2, 5):
        shutil.rmtree(path / "texts" / f"version={v}")
    kept = {int(p.name.split("=")[1]) for p in (path / "shards").iterdir()}
    assert 1 not in kept
    got = {(r[0], r[1]) for r in Index(spark, str(path)).check(recs, done).refused().collect()}
    assert got == {(3, 900), (5, 902)}


def test_cells_and_slices(spark, tmp_path, monkeypatch):
    """Shards of many cells, one of them hot and sliced: recall of the routed graphs against brute force."""
    monkeypatch.setattr(batchdedup, "SEGMENT", 64)
    rng = np.random.default_rng(8)
    base = [[f"w{int(i)}" for i in rng.integers(0, 300, 40)] for _ in range(500)]
    hot = [f"h{i}" for i in range(40)]
    base += [[*hot[:20], *(f"w{int(i)}" for i in rng.integers(0, 300, 20))] for _ in range(300)]
    rows = [(i, 0, _id(i), "u", " ".join(w[:4]), " ".join(w[4:8]), " ".join(w[8:])) for i, w in enumerate(base)]
    new = []
    for i, w in enumerate(base):
        v = list(w)
        v[20 + i % 20] = "edit"
        new.append((1000 + i, 1, _id(1000 + i), "u", " ".join(v[:4]), " ".join(v[4:8]), " ".join(v[8:])))
    got = _added(spark, str(tmp_path / "i"), rows + new, [(0, []), (1, [])], [1])
    assert len({r["cell"] for r in spark.read.parquet(str(tmp_path / "i" / "shards" / "version=1")).collect()}) > 5
    assert len({(i, 1000 + i) for i in range(800)} & got) >= 0.9 * 800


def test_nothing_is_published_before_its_row(spark, tmp_path):
    rows, ck = _history(batches=3)
    path = tmp_path / "index"
    _added(spark, str(path), rows, ck, [1, 2])
    shutil.rmtree(path / "meta" / "version=3")  # an addition cut off before its last step
    index = Index(spark, str(path))
    assert len(index.batches) == 2 and not Path(path / "meta" / "version=3").exists()
    recs, done = _frames(spark, [r for r in rows if r[1] == 2], ck[2:])
    assert {(r[0], r[1]) for r in index.add(recs, done).collect()} == {x for x in _simulated(rows, ck) if rows[x[1]][1] == 2}


def test_alike_has_one_measure_for_all_lengths():
    """The same share of edits has the same verdict below and above 2,000 words or letters, and from either side."""
    for n in (70, 700, 1999, 2001, 7000):
        w = [f"w{i}" for i in range(n)]
        some, more, moved = list(w), list(w), w[n // 2 :] + w[: n // 2]
        some[::7] = [f"e{i}" for i in range(len(some[::7]))]
        more[::4] = [f"e{i}" for i in range(len(more[::4]))]
        for other, same in ((some, True), (more, False), (moved, False), (w[: n // 2], False), (w[: 3 * n // 4], True)):
            assert alike(" ".join(w), " ".join(other)) == alike(" ".join(other), " ".join(w)) == same, n
        letters = [chr(0x4E00 + i % 5000) for i in range(n)]
        edited = list(letters)
        edited[::7] = "x" * len(edited[::7])
        assert alike("".join(letters), "".join(edited), True) and alike("".join(edited), "".join(letters), True)


def test_common_subsequences_against_the_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = ([str(v) for v in rng.integers(0, 4, int(rng.integers(0, 30)))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(new[j], row[j + 1]))
            row = new
        assert batchdedup.common(x, y) == batchdedup.common(y, x) == row[-1]


def test_a_long_text_edited_throughout_is_refused(spark):
    w = [f"w{i}" for i in range(2450)]
    v = list(w)
    v[::7] = [f"e{i}" for i in range(len(v[::7]))]
    rows = [(i, i, _id(i), "u", "the title", "the words", " ".join(x)) for i, x in enumerate((w, v))]
    assert _run(spark, rows, [(0, []), (1, [])]) == {(0, 1)}
