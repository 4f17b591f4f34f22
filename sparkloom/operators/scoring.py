"""Scoring operators that need more than an expression: tool-call rewards, batch rewards, custom functions, conversations."""

from __future__ import annotations

import importlib.util
import signal
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CALLS = "array<struct<name:string,parameters:map<string,string>>>"


def _jaccard(a: Column, b: Column) -> Column:
    """Multiset overlap of two arrays; 1 for equal ones."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(F.array_sort(a) == F.array_sort(b), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def tool_call_reward(truth: Column, said: Column, low: float = -3.0, high: float = 3.0) -> Column:
    """Reward of the calls said for those wanted (both CALLS): agreement of the names, and for each wanted call in turn the best call of its name
    that is still free, by parameter names and values; scaled to low..high. Broken calls (null) give ``low``."""

    def worth(t: Column, c: Column) -> Column:
        keys, held = F.map_keys(t["parameters"]), c["parameters"]
        return _jaccard(keys, F.map_keys(held)) + F.size(F.filter(keys, lambda k: F.map_contains_key(held, k) & F.element_at(t["parameters"], k).eqNullSafe(F.element_at(held, k))))

    def step(acc: Column, t: Column) -> Column:
        # (worth, -place) of the free calls of this name: the largest is the best, and the first of equal ones.
        open_ = F.filter(F.transform(said, lambda c, i: F.struct(F.when(c["name"] == t["name"], worth(t, c)).alias("worth"), (-i).alias("back"))), lambda o: (o["worth"] > 0) & ~F.array_contains(acc["used"], -o["back"]))
        best = F.array_max(open_)
        return F.struct(
            (acc["got"] + F.coalesce(best["worth"], F.lit(0.0))).alias("got"),
            (acc["most"] + 1.0 + F.size(t["parameters"])).alias("most"),
            F.when(best.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(-best["back"]))).alias("used"),
        )

    names = _jaccard(F.transform(truth, lambda c: c["name"]), F.transform(said, lambda c: c["name"]))
    start = F.struct(names.alias("got"), F.lit(1.0).alias("most"), F.array().cast("array<int>").alias("used"))
    return F.coalesce(F.aggregate(truth, start, step, lambda a: (high - low) * a["got"] / a["most"] + low), F.lit(low))


class _TooLong(Exception):
    pass


def _in_time(score: Callable, row: tuple, seconds: float | None) -> object:
    """``score(*row)``, ended by an alarm after ``seconds``: a worker runs it in its main thread."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        return score(*row)

    def ring(*_: object) -> None:
        raise _TooLong

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return score(*row)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def score_batches(df: DataFrame, key: str, columns: list[str], score: Callable[..., float | tuple], default: float = 0.0, seconds: float | None = None) -> DataFrame:
    """key and score of every row, by a Python function over Arrow batches. A failure, a null or a call of more than
    ``seconds`` counts ``default``; of a tuple the first element counts."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f[columns].itertuples(index=False):
                try:
                    s = _in_time(score, row, seconds)
                    s = s[0] if isinstance(s, tuple) else s
                    out.append(default if s is None else float(s))
                except Exception:  # noqa: BLE001 - a broken answer must not end the job
                    out.append(default)
            yield pd.DataFrame({key: f[key], "score": out})

    return df.select(key, *columns).mapInPandas(run, f"{key} {kind}, score double")


MANAGERS: dict[str, Callable[..., DataFrame]] = {}


def register_manager(name: str) -> Callable:
    """Register a reward manager (frame, options -> frame with ``reward``) under a name; a taken name is an error."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if MANAGERS.get(name, f) is not f:
            raise ValueError(f"reward manager {name} exists")
        MANAGERS[name] = f
        return f

    return keep


def rewards(df: DataFrame, manager: str, **options) -> DataFrame:
    """Rewards by the manager of that name."""
    if manager not in MANAGERS:
        raise ValueError(f"no reward manager {manager}; there are {sorted(MANAGERS)}")
    return MANAGERS[manager](df, **options)


@register_manager("naive")
def naive_rewards(df: DataFrame, score: Column) -> DataFrame:
    """A score expression for each row; null counts 0."""
    return df.withColumn("reward", F.coalesce(score.cast("double"), F.lit(0.0)))


@register_manager("batch")
def batch_rewards(df: DataFrame, key: str, columns: list[str], score: Callable, seconds: float | None = None) -> DataFrame:
    """A Python function over batches; failures and overlong calls count 0."""
    return df.join(score_batches(df, key, columns, score, 0.0, seconds).withColumnRenamed("score", "reward"), key)


@register_manager("overlong")
def overlong_rewards(df: DataFrame, score: Column, length: str, limit: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """A score less a penalty that grows over the last ``buffer`` tokens before ``limit``."""
    over = F.least((-(F.col(length) - (limit - buffer)) / float(buffer)) * factor, F.lit(0.0))
    return naive_rewards(df, score).withColumn("reward", F.col("reward") + over)


@register_manager("components")
def component_rewards(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A weighted sum of reward columns; null components count 0."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("reward", total)


def custom_function(path: str, name: str) -> Callable:
    """A reward function loaded from a file of the user's."""
    spec = importlib.util.spec_from_file_location("custom_reward", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    return getattr(module, name)


# --- Conversations: array<struct<role, content>> ---
def answer_instead_of_call(messages: Column, call: str = "submit_answer") -> Column:
    """A closing tool call rewritten as an answer span of the assistant's turn before it; its response goes too."""
    empty = F.array().cast("array<struct<role:string,content:string>>")

    def step(acc: Column, m: Column) -> Column:
        out, last = acc["out"], F.get(acc["out"], F.size(acc["out"]) - 1)
        is_call = (m["role"] == "tool_call") & F.contains(m["content"], F.lit(call))
        answer = F.coalesce(F.get_json_object(m["content"], "$.arguments.answer"), F.get_json_object(F.get_json_object(m["content"], "$.arguments"), "$.answer"), F.lit(""))
        merged = F.struct(last["role"].alias("role"), F.concat(F.coalesce(last["content"], F.lit("")), F.lit("\n\n<answer>"), answer, F.lit("</answer>")).alias("content"))
        rewritten = F.when((last["role"] == "assistant") & ~F.contains(F.coalesce(last["content"], F.lit("")), F.lit("<answer>")), F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(out)
        drop = acc["called"] & (m["role"] == "tool_response")
        return F.struct(F.when(is_call, rewritten).when(drop, out).otherwise(F.concat(out, F.array(F.struct(m["role"].alias("role"), m["content"].alias("content"))))).alias("out"), is_call.alias("called"))

    return F.aggregate(messages, F.struct(empty.alias("out"), F.lit(False).alias("called")), step)["out"]


def exchange_roles(messages: Column) -> Column:
    """Roles of the chat form to those of the training form: tool to tool_response, assistant calls to tool_call."""
    return F.transform(messages, lambda m: F.struct(F.when(m["role"] == "tool", "tool_response").otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def image_tags_match(messages: Column, images: Column) -> Column:
    """Whether the conversation holds as many image tags as there are images."""
    tags = F.aggregate(messages, F.lit(0), lambda n, m: n + F.size(F.regexp_extract_all(F.coalesce(m["content"], F.lit("")), F.lit("<image>"), F.lit(0))))
    return tags == F.size(images)


def external_images(df: DataFrame, key: str, messages: str) -> DataFrame:
    """One row per data URI in the messages: key, message_no, image_no, mime, sha256, bytes."""
    m = df.select(F.col(key), F.posexplode(messages).alias("message_no", "m"))
    uris = F.regexp_extract_all("m.content", F.lit(r"data:(image/[a-z]+;base64,[A-Za-z0-9+/=]+)"), F.lit(1))
    u = m.select(key, "message_no", F.posexplode(uris).alias("image_no", "u"))
    raw = F.unbase64(F.substring_index("u", ",", -1))
    return u.select(key, "message_no", "image_no", F.substring_index("u", ";", 1).alias("mime"), F.sha2(raw, 256).alias("sha256"), F.length(raw).alias("bytes"))


def media_parts(text: Column) -> Column:
    """Text split at <image> and <video>, the marks kept as parts: array<struct<type, value>>."""
    parts = F.filter(F.split(text, r"(?=<image>|<video>)|(?<=<image>|<video>)"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p.isin("<image>", "<video>"), F.substring(p, 2, 5)).otherwise("text").alias("type"), p.alias("value")))


def export_cases(df: DataFrame, key: str, messages: str, metadata: str, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training samples of conversations under ``root``, read back: samples (case_id, sample), metadata (case_id, metadata) and images.

    A sample is one JSON line of messages in the training roles, with images taken out as files ``images/<case>/<message>_<image>`` that it
    names, and <image> in their place. A case id is the key's text with other marks than letters, digits, dots and dashes replaced, 120 characters at most.
    Samples with another number of tags than images are marked, not left out.
    """
    case = F.substring(F.regexp_replace(F.regexp_replace(F.col(key).cast("string"), r"[^\w\-.]", "_"), "^_+|_+$", ""), 1, 120)
    uri = r"data:image/[a-z]+;base64,[A-Za-z0-9+/=]+"
    t = df.select(F.col(key), case.alias("case_id"), F.col(messages).alias("m"), F.col(metadata).alias("metadata"))
    plain = F.transform(exchange_roles(F.col("m")), lambda x: F.struct(x["role"].alias("role"), F.regexp_replace(x["content"], uri, "<image>").alias("content")))
    names = F.flatten(F.transform("m", lambda x, i: F.transform(F.regexp_extract_all(F.coalesce(x["content"], F.lit("")), F.lit(uri), F.lit(0)), lambda _, j: F.concat(F.lit("images/"), F.col("case_id"), F.lit("/"), i.cast("string"), F.lit("_"), j.cast("string")))))
    t = t.withColumn("plain", plain).withColumn("images", names)
    t.select("case_id", F.to_json(F.struct(F.col("plain").alias("messages"), "images")).alias("sample"), image_tags_match(F.col("plain"), F.col("images")).alias("tags_match")).write.mode("overwrite").json(f"{root}/all")
    t.select("case_id", F.to_json("metadata").alias("metadata")).write.mode("overwrite").json(f"{root}/metadata")
    pics = external_images(t.select("case_id", "m"), "case_id", "m")
    pics.write.mode("overwrite").parquet(f"{root}/images")
    spark = df.sparkSession
    return spark.read.schema("case_id string, sample string, tags_match boolean").json(f"{root}/all"), spark.read.schema("case_id string, metadata string").json(f"{root}/metadata"), spark.read.parquet(f"{root}/images")
