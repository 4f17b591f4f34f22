import random

from hypothesis import given
from hypothesis import strategies as st

from sparkloom.llm import crosssplit
from sparkloom.llm.crosssplit import Rarity, chunks, class_pairs, cross_split_counts, cross_split_pairs, overlap, rests
from sparkloom.llm.normalise import answer_key, within, words
from sparkloom.llm.p5 import FRACTION

SCHEMA = "rid bigint, train boolean, question string, answer string, id string, t string"
#: A corpus around the cases, from which the frame and the rarity of words are learned.
FRAMES = ("In the clip named {t}, after the {a} folds the {b}, who repairs the {c} in {p}?", "Who repairs the {c} in {p} after the {a} folds the {b} in the clip named {t}?")


def _word(rng, n):
    return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))


def _corpus(n=400, seed=9):
    rng = random.Random(seed)
    things, places = [_word(rng, 3) for _ in range(60)], [_word(rng, 4) for _ in range(80)]
    rows = []
    for i in range(n):
        f = {"t": _word(rng, 5), "a": rng.choice(things), "b": rng.choice(things), "c": rng.choice(things), "p": rng.choice(places)}
        rows.append((1000 + i, True, rng.choice(FRAMES).format(**f), _word(rng, 6)))
    return rows


def _pairs(spark, rows, fraction=FRACTION):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return {(r[0], r[1]) for r in cross_split_pairs(df, "rid", "train", "question", "answer", fraction).select("left_id", "right_id").collect()}


def test_pairs_through_wording_typos_and_notations(spark):
    q = FRAMES[0].format(t="Trozipohogu", a="diver", b="drawer", c="telescope", p="Faerlozona")
    turned = FRAMES[1].format(t="Trozipohogu", a="diver", b="drawer", c="telescop", p="Faerlozona")
    rows = [
        (1, True, q, "Klidocenomu and Thouthustad"),
        (2, False, q.upper(), '"thouthustad; klidocenomu."'),  # the items of a list in another order
        (3, False, turned + " (short answer)", "Klidocenomu, Thouthustad"),
        (4, False, q, "Another Answer"),
        (5, False, q.replace("Trozipohogu", "Kapunoboga"), "Klidocenomu and Thouthustad"),  # another title, place, thing
        (6, False, q.replace("Faerlozona", "Beirlifell"), "Klidocenomu and Thouthustad"),
        (13, False, q.replace("telescope", "kettle"), "Klidocenomu and Thouthustad"),
        (14, True, q, "Klidocenomu and Thouthustad"),
        (7, False, None, "x"), (8, None, q, "x"), (9, True, "", ""), (10, False, q, None), (None, False, q, "Klidocenomu and Thouthustad"), (2, False, q.upper(), '"thouthustad; klidocenomu."'),
        (11, True, "word " * 20000, "long"), (12, False, "word " * 20000, "long"),
    ]
    assert _pairs(spark, rows + _corpus()) == {(1, 2), (1, 3), (14, 2), (14, 3), (11, 12)}


def test_wording_is_learned(spark):
    """Ways of asking on both sides: each is known from pairs that have one of them only. No list of words is needed."""
    corpus = _corpus()
    rows = list(corpus)
    for i, (_, _, q, a) in enumerate(corpus[:40]):
        rows.append((5000 + i, False, (f"Zuk mavol pelit: {q}", f"{q} (dorim tasu)")[i % 2], a))
    q, a = corpus[50][2:]
    rows += [(9001, True, f"Zuk mavol pelit: {q}", "both ways"), (9002, False, f"{q} (dorim tasu)", "both ways")]
    got = _pairs(spark, rows)
    assert {(1000 + i, 5000 + i) for i in range(40)} | {(9001, 9002)} == got


def test_counts_are_those_of_the_pairs(spark):
    corpus = _corpus(60)
    rows = [*corpus, *((2000 + i, True, q, a) for i, (_, _, q, a) in enumerate(corpus[:5])), *((3000 + i, False, q.lower(), a.upper()) for i, (_, _, q, a) in enumerate(corpus[:8] * 2))]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    want = {}
    for _, r in _pairs(spark, rows):
        want[r] = want.get(r, 0) + 1
    assert {r["right_id"]: r["partners"] for r in cross_split_counts(df, "rid", "train", "question", "answer", FRACTION).collect()} == want
    assert set(want.values()) == {1, 2}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cross_split_pairs(df, "rid", "train", "question", "answer", FRACTION).count() == 0
    assert cross_split_counts(df, "rid", "train", "question", "answer", FRACTION).count() == 0


def test_against_all_pairs(spark, monkeypatch):
    """The prefix filter loses no pair at the fraction."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(120)]
    texts += [" ".join(w if rng.random() > 0.15 else rng.choice(vocabulary) for w in t.split()) for t in texts]
    rows = [(i, i < 120, t, "a", None, None) for i, t in enumerate(texts)]
    monkeypatch.setattr(crosssplit, "_decided", lambda near: near)
    found, _ = class_pairs(spark.createDataFrame(rows, SCHEMA), "rid", "train", "question", "answer", 0.5)
    got = {(r["l"], r["r"]): r["overlap"] for r in found.collect()}
    import numpy as np

    c, counts = chunks(texts), np.zeros(crosssplit.BUCKETS, int)
    for own in c:
        for d in {d for d, _ in own}:
            counts[d % crosssplit.BUCKETS] += 1
    rarity = Rarity(counts, counts, len(texts))
    want = {(i, j): overlap(c[i], c[j], rarity) for i in range(120) for j in range(120, 240)}
    assert got.keys() == {k for k, v in want.items() if v >= 0.5} and len(got) > 50
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_rests():
    frame = frozenset("in the clip which".split())
    assert rests("the red kettle in tarn", "in tarn the red ketle", frame) == ([], [])
    assert rests("the red kettle", "the blue kettle", frame) == (["red"], ["blue"])
    assert rests("which gearbox", "which garboox", frame) == ([], [])  # a single word, two edits
    assert rests("row 12", "row 13", frame) == (["12"], ["13"])
    assert rests("the cat sat", "the catsat", frame) == ([], [])


def test_answer_notations():
    for a, b in (("Seventy-five", "75"), ("7 August 2008", "2008-08-07"), ("August 7, 2008", "7 Aug 2008"), ("405m", "405 metres"), ("92,810 s", "92810"), ("A & B", "A and B"), ("A; B", "a, b"), ("Beta and Alpha", "alpha, beta"), ("Uno y Dos", "dos & uno"), ("The Tower.", "tower")):
        assert answer_key(a) == answer_key(b), (a, b)
    assert answer_key("75") != answer_key("76") and answer_key("7 August 2008") != answer_key("8 August 2008")


@given(st.text(alphabet="abc", max_size=6), st.text(alphabet="abc", max_size=6))
def test_within_is_symmetric_and_reflexive(a, b):
    assert within(a, a, 0) and within(a, b, 2) == within(b, a, 2)


def test_words():
    assert words("<p>Ánc­hor</p> nаmе_x") == ["anchor", "name", "x"]
