import random

import numpy as np

from sparkloom.llm.leaks import lcs, leaks, randomised_svd, text_words

DOC = "doc_id bigint, text string, item_id string, cosine string"
ITEM = "item_id bigint, text string, answer string, doc_id string"


def _world(n=12, seed=1):
    rng = random.Random(seed)
    common = [f"common{i}" for i in range(40)]
    items = []
    for k in range(n):
        w = []
        for j in range(60):
            w.append(f"rare{k}x{j}" if j % 5 == 4 else rng.choice(common))
        items.append(w)
    return rng, common, items


def test_runs_of_fifteen_words_are_found_and_fourteen_are_not(spark):
    rng, common, items = _world()
    docs, want = [], set()
    for d in range(150):
        pad = [rng.choice(common) for _ in range(rng.randint(0, 120))]
        k, at, n = rng.randrange(12), rng.randint(0, 40), rng.choice((14, 15, 16, 20))
        at = min(at, 60 - n)
        run = items[k][at : at + n]
        pos = rng.randint(0, len(pad))
        # Words that are no part of the item at both ends, so that the run has exactly n words.
        docs.append((d, " ".join([*pad[:pos], "stop", *run, "stop", *pad[pos:]]).upper().replace("COMMON1 ", "**Common1** <i>"), None, None))
        if n >= 15:
            want.add((d, k))
    docs += [(900, None, None, None), (901, "", None, None), (902, "?!", None, None), (903, " ".join(rng.choice(common) for _ in range(30000)) + " " + " ".join(items[3][:15]), None, None), (None, " ".join(items[3]), None, None)]
    want.add((903, 3))
    rows = [(k, " ".join(w), f"answer{k}", "x") for k, w in enumerate(items)] + [(50, None, None, None), (51, "short item", None, None), (3, " ".join(items[3]), "answer3", "x")]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, DOC), "doc_id", "text", spark.createDataFrame(rows, ITEM)).where("kind = 'verbatim'").collect()}
    assert got == want


def test_runs_of_common_words_between_other_items(spark):
    """A run that says little, in a passage full of other items' rare words, has a low cosine and is found all the same."""
    rng, common, items = _world()
    plain = rng.sample(common, 15)
    items[0][:15] = plain
    docs = [(d, " ".join([*items[d][5:19], "stop", *plain[: 15 - d // 6], "stop", *items[d + 1][5:19]]), None, None) for d in range(1, 11)]
    rows = [(k, " ".join(w), None, "x") for k, w in enumerate(items)]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, DOC), "doc_id", "text", spark.createDataFrame(rows, ITEM)).collect()}
    assert got == {(d, 0) for d in range(1, 6)}


def test_runs_alone_in_documents_and_inside_other_items(spark):
    """Runs of 15, 20 and 30 words in three surroundings: every cell is found whole."""
    rng, common, items = _world(40, 3)
    docs, want, d = [], set(), 0
    for n in (15, 20, 30):
        for place in ("alone", "document", "item"):
            for _ in range(30):
                k, at = rng.randrange(40), rng.randint(0, 60 - n)
                other = items[(k + 1 + rng.randrange(38)) % 40]
                pad = {"alone": [], "document": [rng.choice(common) for _ in range(80)], "item": other[:14]}[place]
                tail = other[30:44] if place == "item" else pad
                docs.append((d, " ".join([*pad, "stop", *items[k][at : at + n], "stop", *tail]), None, None))
                want.add((d, k))
                d += 1
    rows = [(k, " ".join(w), None, "x") for k, w in enumerate(items)]
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, DOC), "doc_id", "text", spark.createDataFrame(rows, ITEM)).where("kind = 'verbatim'").collect()}
    assert got == want


def test_paraphrase_needs_order_and_answer(spark):
    _, _, items = _world()
    item = items[0][:30]
    loose = [w for w in item if not w.endswith("x14")]  # one word in the middle is missing
    docs = [(1, " ".join([*loose, "so", "answer0"]), None, None), (2, " ".join(loose), None, None)]
    rows = [(0, " ".join(item), "Answer0", "x")]
    got = {(r["doc_id"], r["kind"]) for r in leaks(spark.createDataFrame(docs, DOC), "doc_id", "text", spark.createDataFrame(rows, ITEM), run=16).collect()}
    assert got == {(1, "paraphrase")}


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b", "c", "x")], ITEM)
    assert leaks(docs, "doc_id", "text", items).count() == 0
    assert leaks(spark.createDataFrame([(1, "a b", None, None)], DOC), "doc_id", "text", items.where("item_id < 0")).count() == 0


def test_svd_against_numpy(spark):
    a = np.random.default_rng(0).normal(size=(80, 30)) * (np.random.default_rng(1).random((80, 30)) < 0.3) * np.linspace(3, 0.1, 30)
    rows = spark.createDataFrame([([int(i) for i in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for r in a], "ids array<int>, weights array<float>")
    v = randomised_svd(rows, 30, 5, rounds=8)
    true = np.linalg.svd(a)[2][:5].T
    assert np.linalg.norm(true.T @ v, 2) > 0.99 and np.linalg.svd(true.T @ v)[1].min() > 0.97


def test_words_and_lcs():
    assert text_words("<p>Ánc&shy;hor</p> [00:12] _name_, 00:00:01.349 --> 00:00:02.000 ten​") == ["anchor", "name", "ten"]
    assert lcs(list("abcde"), list("xaczez")) == 3
