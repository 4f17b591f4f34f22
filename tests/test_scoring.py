import pytest
from pyspark.sql import functions as F

from sparkloom.functions import grading as G
from sparkloom.operators import microbatches as M
from sparkloom.operators import scoring as S
from sparkloom.sources import files
from sparkloom.streaming import queues


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "same"), [("\\dfrac12", "\\frac{1}{2}", True), ("0.5", "1/2", True), ("\\left( 3 \\right)", "(3)", True), ("x=7", "7", True), ("50^\\circ", "50", True), ("\\sqrt3", "\\sqrt{3}", True), ("3", "4", False), ("(x+1)^2", "x^2+2x+1", True), ("\\sqrt{8}", "2\\sqrt2", True), ("(1,2]", "(1,2)", False), ("\\{1,2\\}", "\\{2,1\\}", True), ("1,2", "2,1", False), ("\\frac{x^2-1}{x-1}", "x+1", True), ("east", "seat", False), ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1 & 2\\\\ 3 & \\frac82\\end{pmatrix}", True), ("", "", True), ("(((((", "(((((", True), ("x^{99999}", "x^{99999}", True), ("1/0", "1/0", True)])
def test_tex_notations(spark, a, b, same):
    assert _one(spark, G.tex_equal(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize(("a", "b", "same"), [("1,000", "1000", True), ("50%", "0.5", True), ("2/4", "0.5", True), ("\\frac{1}{3}", "0.33333", True), ("1", "2", False), ("abc", "abc", True), ("abc", "abd", False), ("3.1416", "\\pi", True), ("(0.33333, 2)", "(1/3, 2)", True)])
def test_numbers(spark, a, b, same):
    assert _one(spark, G.numeric_equal(F.lit(a), F.lit(b))) is same


def test_boxes_and_final_answers(spark):
    assert _one(spark, G.strict_box(F.lit("\\boxed{1} so \\boxed{\\frac{a}{b}}."), F.lit("\\frac{a}{b}"))) == 1
    assert _one(spark, G.math_score(F.lit("no box"), F.lit("1"))) == 0.0
    assert _one(spark, G.final_answer(F.lit("the total = \\$ 1,234 dollars"))) == "1234"


def _reward(spark, truth, said):
    read = lambda t: F.from_json(F.lit(t), S.CALLS)
    return _one(spark, S.tool_call_reward(read(truth), read(said)))


def test_tool_call_reward(spark):
    a = '[{"name": "f", "parameters": {"x": 1, "y": [2, 3]}}]'
    assert _reward(spark, a, a) == 3.0
    assert _reward(spark, a, "[]") == -3.0 and _reward(spark, a, "broken") == -3.0
    assert _reward(spark, a, '[{"name": "f", "parameters": {"x": 1, "y": 3}}]') == pytest.approx(6 * 3 / 4 - 3)
    two = '[{"name": "f", "parameters": {"x": 1}}, {"name": "f", "parameters": {"x": 2}}]'
    # Each call is used once: the first of the wanted ones takes the one that fits it best.
    assert _reward(spark, two, '[{"name": "f", "parameters": {"x": 2}}, {"name": "f", "parameters": {"x": 1}}]') == 3.0
    assert _reward(spark, two, '[{"name": "f", "parameters": {"x": 2}}]') == pytest.approx(6 * (0.5 + 1) / 5 - 3)


def test_overlong_scorers_and_managers(spark):
    def slow(v):
        while v == "loop":
            pass
        return len(v)

    df = spark.createDataFrame([(1, "ab", 0.5, 10), (2, "loop", None, 100)], "k bigint, v string, s double, n bigint")
    out = S.rewards(df, "batch", key="k", columns=["v"], score=slow, seconds=0.5)
    assert {r["k"]: r["reward"] for r in out.collect()} == {1: 2.0, 2: 0.0}
    out = S.rewards(df, "overlong", score=F.col("s"), length="n", limit=60, buffer=20)
    assert {r["k"]: r["reward"] for r in out.collect()} == {1: 0.5, 2: -3.0}
    out = S.rewards(df, "components", weights={"s": 2.0, "n": 0.1})
    assert {r["k"]: r["reward"] for r in out.collect()} == {1: 2.0, 2: 10.0}
    with pytest.raises(ValueError):
        S.rewards(df, "none")


def test_scores_survive_failures_and_custom_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "2"), (2, "x"), (3, None)], "k bigint, v string")
    assert {r["k"]: r["score"] for r in S.score_batches(df, "k", ["v"], lambda v: int(v)).collect()} == {1: 2.0, 2: 0.0, 3: 0.0}
    (tmp_path / "r.py").write_text("def score(v):\n    return len(v or '')\n")
    assert S.custom_function(str(tmp_path / "r.py"), "score")("abc") == 3
    with pytest.raises(AttributeError):
        S.custom_function(str(tmp_path / "r.py"), "none")


def test_micro_batches():
    n = [100, 900, 300, 300, 200, 50, 50, 700]
    parts = M.micro_batches(n, 1000)
    assert sorted(i for p in parts for i in p) == list(range(8)) and len(parts) == 3
    assert len(M.micro_batches(n, 1000, multiple=4)) == 4
    with pytest.raises(ValueError):
        M.micro_batches([2000], 1000)
    assert sorted(map(len, M.greedy([5] * 8, 4, equal_size=True))) == [2, 2, 2, 2]


def test_answer_instead_of_call_in_the_middle(spark):
    m = [("user", "q"), ("assistant", "a"), ("tool_call", '{"name": "submit_answer", "arguments": "{\\"answer\\": \\"42\\"}"}'), ("tool_response", "ok"), ("user", "more")]
    df = spark.createDataFrame([(m,), ([],), (None,)], "m array<struct<role:string,content:string>>")
    out = [r["x"] for r in df.select(S.answer_instead_of_call(F.col("m")).alias("x")).collect()]
    assert [(x["role"], x["content"]) for x in out[0]] == [("user", "q"), ("assistant", "a\n\n<answer>42</answer>"), ("user", "more")]
    assert out[1] == [] and out[2] is None


def test_token_bucket_and_agent_states(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 6.0), (1, 1, 0.0, 6.0), (1, 2, 10.0, 1.0), (None, 0, 0.0, 11.0)], "k bigint, i int, t double, n double")
    got = {(r["k"], r["i"]): r["waited"] for r in queues.token_bucket(df, "k", "t", "n", ["i"], 1.0, 10.0).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 2.0, (1, 2): 0.0, (None, 0): 1.0}
    turns = [(1, [(1, 10), (0, 10), (1, 10)]), (2, [(1, 10)] * 5), (3, [(1, 999)]), (4, [(1, 1)])]
    df = spark.createDataFrame([(k, i, c, t) for k, x in turns for i, (c, t) in enumerate(x)], "k bigint, i int, c bigint, t bigint")
    got = {r["k"]: (r["state"], r["used"], r["n"]) for r in queues.agent_states(df, "k", ["i"], "c", "t", 4, 100).collect()}
    assert got == {1: ("terminated", 20, 2), 2: ("terminated_turns", 40, 4), 3: ("terminated_length", 999, 1), 4: ("running", 1, 1)}
    assert queues.agent_states(df.where("k > 9"), "k", ["i"], "c", "t", 4, 100).count() == 0


def test_readers(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a bigint").count() == 0
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "none"), "a bigint", strict=True).count()
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{broken\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a bigint").where("a is not null").collect()) == [1, 2]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a bigint", strict=True).collect()
    with pytest.raises(ValueError):
        files.read_records(spark, ["x.csv"])
    empty = spark.createDataFrame([], "a bigint")
    with pytest.raises(ValueError):
        files.write_unified(empty, empty, str(tmp_path / "out"))
