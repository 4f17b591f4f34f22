import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.packing import TOKENIZER, measure, pack, pack_histogram, places

SCHEMA = "doc_id bigint, text string, container_id string, n_tokens string"


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1), st.integers(50, 90))
@settings(max_examples=150, deadline=None)
def test_every_piece_has_one_place_and_nothing_overflows(counts, capacity):
    patterns = pack_histogram(counts, capacity)
    table = places(patterns)
    used: dict[int, list] = {}
    for length, n in counts.items():
        at = table[length]
        starts = list(at[:, 0]) + [n]
        assert at[0, 0] == 0 and all(a < b for a, b in zip(starts, starts[1:]))
        for (r, base, slot, offset), nxt in zip(at, starts[1:]):
            for k in range(nxt - r):
                used.setdefault(base + k, []).append((offset, length, slot))
    for pieces in used.values():
        pieces.sort()
        assert [p[2] for p in pieces] == list(range(len(pieces)))
        assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and pieces[-1][0] + pieces[-1][1] <= capacity
    assert len(used) == sum(n for _, n in patterns)
    total = sum(k * v for k, v in counts.items())
    assert len(used) <= 2 * -(-total // capacity)  # decreasing order leaves no two half-empty containers


def test_equal_short_pieces_share_containers():
    assert sum(n for _, n in pack_histogram({5: 1000}, 100)) == 50
    with pytest.raises(ValueError):
        pack_histogram({101: 1}, 100)


def test_pieces_tile_the_text(spark):
    rows = [(1, "héllo wörld 😀 " * 300, "c", "c"), (2, "", None, None), (3, None, None, None), (4, "a", None, None), (4, "a", None, None), (None, "b c", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = measure(df, "doc_id", "text", 64).toPandas()
    one = p[p.doc_id == 1].sort_values("piece_no")
    assert list(one.char_start) == [0, *one.char_end[:-1]] and one.char_end.iloc[-1] == len(rows[0][1]) and (one.n_tokens <= 64).all()
    from tokenizers import Tokenizer

    assert one.n_tokens.sum() == len(Tokenizer.from_file(TOKENIZER).encode(rows[0][1], add_special_tokens=False))
    out = pack(df, "doc_id", "text", 64).toPandas()
    assert len(out) == len(p) and out.groupby("container_id").n_tokens.sum().max() <= 64
    assert not out.duplicated(["container_id", "slot"]).any()
    assert pack(df.where("doc_id < 0"), "doc_id", "text", 64).count() == 0
