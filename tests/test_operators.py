"""Cases that no table holds: errors, edges, hand-made values."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import advantage as A
from sparkloom.operators import batches as B
from sparkloom.operators import losses as L
from sparkloom.operators import retrieval as R
from sparkloom.plans.base import Book, _expand


def test_registries():
    with pytest.raises(ValueError):
        A.register("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        L.register("vanilla")(lambda df: df)
    book = Book()
    book("a")(lambda s, d: None)
    with pytest.raises(ValueError):
        book("a")(lambda s, d: None)


def test_unknown_names(spark):
    df = spark.range(1)
    for f in (lambda: A.advantage(df, "none"), lambda: L.loss(df, "none"), lambda: L.aggregate_loss(df, F.lit(1), "none"), lambda: R.fuse([df], 0), lambda: L.parse_band("3_1"), lambda: L.parse_band("-1")):
        with pytest.raises(ValueError):
            f()
    assert L.parse_band("0.5_2") == (0.5, 2.0) and L.parse_band(3) == (None, 3.0)


def test_singletons_differ_by_estimator(spark):
    df = spark.createDataFrame([(1, 7, 5.0)], "idx bigint, uid bigint, score double")
    assert A.advantage(df, "rloo").first()["advantage"] == 5.0
    assert A.advantage(df, "rloo_vectorized").first()["advantage"] == 0.0
    assert A.advantage(df, "grpo").first()["advantage"] == pytest.approx(5.0, abs=1e-4)


@pytest.mark.parametrize(("a", "b", "c"), [(None, None, None), (2, -3, 2), (-1, None, -1), (-5, 100, 1), (50, 3, -4), (None, None, -1), (3, 3, 1)])
def test_slices_like_python(spark, a, b, c):
    df = spark.range(30).withColumnRenamed("id", "row_pos")
    got = sorted(r[0] for r in B.python_slice(df, 30, a, b, c).collect())
    assert got == sorted(list(range(30))[slice(a, b, c)])


def test_positions_are_dense_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = B.with_positions(df, "k").collect()
    assert all(r["k"] == r["row_pos"] for r in got)
    assert B.with_positions(df.where("k < 0"), "k").count() == 0


def test_karmarkar_karp():
    rng = random.Random(2)
    for _ in range(30):
        x = [rng.randint(1, 500) for _ in range(24)]
        parts = B.karmarkar_karp(x, 4)
        assert sorted(i for p in parts for i in p) == list(range(24))
        sums = [sum(x[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= max(x)
        assert all(len(p) == 6 for p in B.karmarkar_karp(x, 4, equal_size=True))
    with pytest.raises(ValueError):
        B.karmarkar_karp([1, 2, 3], 2, equal_size=True)


def test_pad_chunk_union(spark):
    df = spark.range(10).withColumnRenamed("id", "row_pos")
    p = B.pad_to_divisor(df, 10, 8)
    assert p.count() == 16 and sorted(r[0] for r in p.where("is_padding").select("row_pos").collect()) == list(range(10, 16))
    assert B.pad_to_divisor(df.where("row_pos < 3"), 3, 8).count() == 8  # more padding than rows
    with pytest.raises(ValueError):
        B.chunk(df, 10, 3)
    a = spark.createDataFrame([(1, float("nan"), None)], "k bigint, x double, y string")
    assert B.union_columns(a, a, "k").count() == 1  # NaN and null equal themselves
    other = spark.createDataFrame([(1, 2.0, None)], "k bigint, x double, y string")
    with pytest.raises(Exception, match="differs"):
        B.union_columns(a, other, "k").collect()


def test_fit_raises_on_long_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<bigint>")
    with pytest.raises(Exception, match="too long"):
        df.select(B.fit(F.col("a"), 2, 0)).collect()


def test_text_functions(spark):
    df = spark.createDataFrame([(" https://www.youtube.com/watch?v=abcdefghi_- ", "shard://a%20b/c.tar?o=512&l=7", "shard://x?o=a&l=1", "01:02:03.5")], "u string, s string, bad string, t string")
    r = df.select(T.url_id(F.col("u")).alias("u"), T.shard_parts(F.col("s")).alias("s"), T.shard_parts(F.col("bad")).alias("bad"), T.clock_seconds(F.col("t")).alias("t"), T.shard_uri(F.lit("a b/c.tar"), F.lit(512), F.lit(7)).alias("m")).first()
    assert (r["u"], tuple(r["s"]), r["bad"], r["t"], r["m"]) == ("abcdefghi_-", ("a b/c.tar", 512, 7), None, 3723.5, "shard://a%20b/c.tar?o=512&l=7")


def test_rank_fusion_scores_and_ties(spark):
    def ranked(docs):
        return spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(docs)], "q bigint, doc bigint, rank int")

    out = R.fused_top(R.fuse([ranked([1, 2, 3, 4, 5]), ranked([3, 2, 1, 4, 5])]), 5).orderBy("rank").collect()
    assert [r["doc"] for r in out] == [1, 3, 2, 4, 5]
    assert out[2]["score"] == pytest.approx(2 / 62)


def test_expand_rnd():
    assert _expand("SELECT rnd(avg(a), 2) AS x") == "SELECT floor(CAST((avg(a)) AS DOUBLE) * 100.0 + 0.4137) / 100.0 AS x"


def test_dense_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0] * 64), (2, None), (3, [0.0] * 64), (4, [1.0] * 63)], "id bigint, v array<float>")
    asked = spark.createDataFrame([(9, [1.0] * 64), (8, None)], "q bigint, vector array<float>")
    assert [(r["q"], r["doc"]) for r in R.dense(v, "id", "v", asked, 5).collect()] == [(9, 1)]
    assert R.dense(v.where("id < 0"), "id", "v", asked, 5).count() == 0


def test_perturbed_lists_keep_to_their_hits(spark):
    """Thirty draws over a pool of fifty: a subset of the hits, no url twice, the hits untouched but for title and snippet."""
    from sparkloom.operators import retrieval as R

    rows = [(q, i, f"u{i % 45}", f"Title {i}.", f"snippet of some words number {i} " * 3) for q in range(30) for i in range(50)]
    hits = spark.createDataFrame([(q, i + 1, u, t, s) for q, i, u, t, s in rows], "q bigint, rank int, url string, title string, snippet string")
    gold = spark.createDataFrame([(q, "u0") for q in range(30)], "q bigint, url string")
    for tier in R.TIERS:
        lists, metrics = R.perturb(hits, gold, 10, 3, probs={tier: 1.0})
        got, m = lists.collect(), {r["q"]: r for r in metrics.collect()}
        assert {r["tier"] for r in m.values()} == {tier} and len(m) == 30
        for q in range(30):
            mine = sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])
            assert len(mine) == m[q]["displayed"] <= m[q]["k"] and len({r["url"] for r in mine}) == len(mine)
            assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and {r["url"] for r in mine} <= {f"u{i}" for i in range(45)}
            assert [r["rank"] - 1 for r in mine if r["gold"]] == m[q]["gold_ranks"]
            if m[q]["action"] == "drop" or m[q]["empty"]:
                assert not m[q]["gold_ranks"]
        if tier == "easy":  # untouched but for a place more or less of gold
            assert all(r["title"].startswith("Title") and len(r["title"]) < 12 for r in got) and all(len(m[q]["gold_ranks"]) and m[q]["gold_ranks"][0] <= 1 for q in m)
        if tier == "hard":
            assert len({r["title"] for r in got if not r["title"].startswith("Title")}) > 10 and any(m[q]["injected"] >= 4 for q in m)
    assert R.perturb(hits.where("q > 99"), gold, 10)[0].count() == 0


def test_resampling_is_exact_in_number_and_close_in_share(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 0.0), (3, None), (4, -1.0), (5, 15.0)], "k bigint, w double")
    got = [r["key"] for r in B.resample(df, "k", "w", 4000, 1).collect()]
    assert len(got) == 4000 and set(got) == {1, 5} and abs(got.count(5) / 4000 - 0.75) < 0.03
    assert B.resample(df.where("k = 2"), "k", "w", 10, 1).count() == 0 and B.resample(df.where("k > 9"), "k", "w", 10, 1).count() == 0


def test_long_sequences_scan_in_one_pass(spark):
    from sparkloom.operators import advantage as A

    rows = [(1, i, 1.0, 0.5, 1) for i in range(20000)] + [(2, 0, 2.0, 0.5, 0), (2, 1, 3.0, 0.25, 1)]
    t = spark.createDataFrame(rows, "seq bigint, pos int, reward double, val double, mask int")
    got = {(r["seq"], r["pos"]): r["return"] for r in A.discounted_returns(t, 0.5).collect()}
    assert len(got) == 20002 and got[1, 0] == pytest.approx(2.0) and got[2, 1] == 3.0 and got[2, 0] == pytest.approx(3.5)
    assert A.gae(t.where("seq > 9"), 0.9, 0.9).count() == 0
    assert {"gae", "remax", "gdpo", "reinforce_plus_plus", "optimal_token_baseline"} <= set(A.ESTIMATORS)
