import numpy as np

from sparkloom.llm.pivots import group_pivots, nearest

SCHEMA = "vid bigint, vec array<float>, id string, neighbour string"


def _rows(x, ids):
    return [(int(i), [float(v) for v in row], "c", None) for i, row in zip(ids, x)]


def test_recall_against_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 64))
    x = (centres[rng.integers(0, 12, 3000)] + 0.7 * rng.normal(size=(3000, 64))).astype(np.float32)
    out = nearest(spark.createDataFrame(_rows(x, range(3000)), SCHEMA), "vid", "vec", keep=0.6).toPandas()  # clouds without structure
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :10]
    got = out.groupby("id").neighbour.apply(set)
    assert np.mean([len(got[i] & set(true[i])) for i in range(3000)]) / 10 >= 0.9
    # The footrule ranking decides: of a fifth of each file, chosen by it, most neighbours are left, of a fifth by chance few.
    some = nearest(spark.createDataFrame(_rows(x, range(3000)), SCHEMA), "vid", "vec", keep=0.2).toPandas().groupby("id").neighbour.apply(set)
    assert np.mean([len(some[i] & set(true[i])) for i in range(3000)]) / 10 >= 0.5
    assert (out.groupby("id").size() == 10).all() and set(out["rank"]) == set(range(1, 11))


def test_bad_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64)).astype(np.float32)
    rows = _rows(x, range(40)) + _rows(np.repeat(x[:1], 15, 0), range(100, 115))  # 16 copies of vector 0
    rows += _rows(2 * x[1:2], [200])  # the same direction
    rows += [(300, None, None, None), (301, [0.0] * 64, None, None), (302, [1.0] * 63, None, None), (303, [float("nan")] + [1.0] * 63, None, None), (304, [float("inf")] + [1.0] * 63, None, None), (305, [None] + [1.0] * 63, None, None), (None, [1.0] * 64, None, None)]
    rows += rows[:2]  # repeated rows
    out = nearest(spark.createDataFrame(rows, SCHEMA), "vid", "vec").toPandas()
    assert set(out.id) <= set(range(40)) | set(range(100, 115)) | {200}
    copies = [0, *range(100, 115)]
    for i in copies:  # ten of the other copies, the lowest ids
        assert list(out[out.id == i].sort_values("rank").neighbour) == [c for c in copies if c != i][:10]
    assert out[(out.id == 1) & (out["rank"] == 1)].neighbour.item() == 200
    assert not out.duplicated(["id", "neighbour"]).any() and (out.id != out.neighbour).all()


def test_empty_and_tiny(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), "vid", "vec").count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64, None, None)], SCHEMA)
    assert nearest(one, "vid", "vec").count() == 0


def test_groups_are_balanced():
    g = group_pivots(np.random.default_rng(0).normal(size=(100, 64)).astype(np.float32), 8)
    assert np.bincount(g).max() <= 8


def test_hot_groups_are_cut_into_slices(spark, monkeypatch):
    """A third and more of all vectors around one pivot: the same lists, whatever the slices."""
    from sparkloom.llm import pivots

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=64) + 0.3 * rng.normal(size=(300, 64)), rng.normal(size=(400, 64))]).astype(np.float32)
    df = spark.createDataFrame(_rows(x, range(700)), SCHEMA)
    whole = sorted((r["id"], r["neighbour"]) for r in nearest(df, "vid", "vec", keep=1.0).collect())
    monkeypatch.setattr(pivots, "HOT", 90)
    assert sorted((r["id"], r["neighbour"]) for r in nearest(df, "vid", "vec", keep=1.0).collect()) == whole


def test_whole_files_by_matrix_product():
    """A file is ranked by all its exact cosines, and that in less time than the footrule of half of it takes."""
    from time import perf_counter

    from sparkloom.llm.pivots import nearest_order, ranked, search_file, search_whole_file

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    members, queries = np.arange(0, 3000, 2), np.arange(1000, 2000)
    t = perf_counter()
    q, c, cos = ranked(x, [search_whole_file(x, members[a : a + 400], queries, 10) for a in range(0, 1500, 400)], 10)
    took = perf_counter() - t
    s = x[queries].astype(np.float64) @ x[members].astype(np.float64).T
    s[members[None, :] == queries[:, None]] = -2
    assert (q == np.repeat(queries, 10)).all() and (c.reshape(-1, 10) == members[np.argsort(-s, axis=1)[:, :10]]).all()
    assert np.allclose(cos.reshape(-1, 10), -np.sort(-s, axis=1)[:, :10], atol=1e-9)
    order = nearest_order(x, x[:64], 32)
    assert (order == np.argsort(-(x @ x[:64].T), axis=1, kind="stable")[:, :32]).all()
    t = perf_counter()
    search_file(order, x, members, queries, 10, 0.5)
    assert took < perf_counter() - t


def test_many_vectors_of_one_direction(spark):
    """No exact copies, all cosines 1: the lowest ids, and no list of all pairs."""
    rng = np.random.default_rng(6)
    one = rng.integers(-8, 9, 64) + 0.5
    rows = _rows([one * (i + 1) for i in range(600)], range(600)) + _rows(rng.normal(size=(200, 64)), range(600, 800))
    out = nearest(spark.createDataFrame(rows, SCHEMA), "vid", "vec").toPandas().sort_values(["id", "rank"])
    got = out[out.id < 600].groupby("id").neighbour.apply(list)
    assert all(got[i] == [j for j in range(11) if j != i][:10] for i in range(600))


def test_copies_and_other_vectors_of_their_direction(spark):
    """Beside more copies than a list holds stand only ties with them, by id."""
    x = np.random.default_rng(7).integers(1, 9, (30, 64))
    rows = _rows(np.repeat(x[:1], 300, 0), range(100, 400)) + _rows([2 * x[0], 4 * x[0]], [5, 500]) + _rows(x[1:], range(1000, 1029))
    out = nearest(spark.createDataFrame(rows, SCHEMA), "vid", "vec").toPandas().sort_values(["id", "rank"])
    got = out.groupby("id").neighbour.apply(list)
    want = [5, *range(100, 400), 500]
    assert all(got[i] == [j for j in want if j != i][:10] for i in want)
    near = out[out.id == 1000].merge(out[out.id == 1001], how="outer")
    assert len(near) == 20 and not out.duplicated(["id", "neighbour"]).any()
