"""Text, URL, time and nested-value functions as column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The address forms of generated video ids.
WATCH_PREFIX = "https://www.youtube.com/watch?v="
THUMBNAIL = "https://www.youtube.com/vi/%s/hqdefault.jpg"
SHARD_PREFIX = "shard://"
TRUNCATED = "...(truncated)..."


def tokens(x: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit("[A-Za-z0-9]+"), F.lit(0))


def document_text(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def truncate(x: Column, n: int, keep: str = "head") -> Column:
    """At most n characters, with a mark where the rest was."""
    cut = F.concat(F.substring(x, 1, n), F.lit(TRUNCATED)) if keep == "head" else F.concat(F.lit(TRUNCATED), F.right(x, F.lit(n)))
    return F.when(F.length(x) > n, cut).otherwise(x)


def truncate_response(x: Column, n: int, side: str) -> Column:
    """A tool's response cut on one side; middle keeps half of the room at both ends."""
    half = n // 2
    cut = {
        "left": F.concat(F.substring(x, 1, n), F.lit("...(truncated)")),
        "right": F.concat(F.lit("(truncated)..."), F.right(x, F.lit(n))),
        "middle": F.concat(F.substring(x, 1, half), F.lit(TRUNCATED), F.right(x, F.lit(half))),
    }[side]
    return F.when(F.length(x) > n, cut).otherwise(x)


def snippet(parts: list[Column], words: Column, before: int = 40, after: int = 160, head: int = 200) -> Column:
    """The first non-empty part around the first of ``words`` (in their order) that it holds, else its head."""
    text = F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))
    at = F.filter(F.transform(words, lambda w: F.instr(F.lower(text), w)), lambda i: i > 0)
    start = F.greatest(at[0] - before, F.lit(1))
    return F.trim(F.when(F.size(at) > 0, F.substring(text, start, at[0] + after - start)).otherwise(F.substring(text, 1, head)))


def first_tag(x: Column, tag: str) -> Column:
    """Inside of the first <tag>...</tag>, trimmed; null if either is missing."""
    found = F.regexp_extract_all(x, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.trim(F.get(found, F.lit(0)), F.lit(" \n\t\r"))


def last_tag(x: Column, tag: str) -> Column:
    found = F.regexp_extract_all(x, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1), F.lit(" \n\t\r")))


def count_of(x: Column, mark: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def normal_answer(x: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    x = F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(a|an|the)\b", " "), r"\s+", " "))


def quick_match(prediction: Column, truth: Column) -> Column:
    """Equal, one inside the other, a plural s apart, or all of the truth's words in the prediction."""
    def norm(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))

    def bag(x: Column) -> Column:
        return F.array_except(F.split(x, " "), F.array(*map(F.lit, ("", "the", "a", "an"))))

    p, g = norm(prediction), norm(truth)
    same = (p == g) | F.contains(p, g) | F.contains(g, p) | (F.concat(p, F.lit("s")) == g) | (F.concat(g, F.lit("s")) == p)
    inside = (F.size(bag(g)) > 0) & (F.size(F.array_except(bag(g), bag(p))) == 0)
    return F.when((p == "") | (g == ""), False).otherwise(same | inside)


def judge_verdict(x: Column) -> Column:
    """A JSON verdict, else one written in the text, else a lone true or false, else null."""
    json = F.get_json_object(x, "$.is_correct")
    written = F.nullif(F.lower(F.regexp_extract(x, r'(?i)"is_correct"\s*:\s*(true|false)', 1)), F.lit(""))
    low = F.lower(x)
    lone = F.when(F.contains(low, F.lit("true")) & ~F.contains(low, F.lit("false")), True).when(F.contains(low, F.lit("false")) & ~F.contains(low, F.lit("true")), False)
    return F.coalesce(F.when(json.isin("true", "false"), json == "true"), written == "true", lone)


def language(x: Column) -> Column:
    """zh for any CJK or Kana character, else en."""
    return F.when(x.rlike("[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]"), "zh").otherwise("en")


def clues(x: Column) -> Column:
    """Lines without bullets, blank ones dropped."""
    lines = F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(s, r"^[\s\-*•\d.)]+|\s+$", ""))
    return F.filter(lines, lambda s: s != "")


def numbered(items: Column, render) -> Column:
    """Items rendered one a line behind their number."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), render(x))), "\n")


def case_id(x: Column, longest: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_.\-]+", "_"), "^_+|_+$", ""), 1, longest)


# --- Hashes and addresses ---
def path_id(path: Column) -> Column:
    """First 11 characters of the URL-safe base64 of the SHA-1."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha1(path))), "+/", "-_"), 1, 11)


def watch_url(path: Column) -> Column:
    return F.concat(F.lit(WATCH_PREFIX), path_id(path))


def thumbnail(video_id: Column) -> Column:
    return F.format_string(THUMBNAIL, video_id)


def url_id(url: Column) -> Column:
    """The id of an address of exactly the generated form, else null."""
    return F.nullif(F.regexp_extract(F.trim(url), r"^https://www\.youtube\.com/watch\?v=([A-Za-z0-9_-]{11})$", 1), F.lit(""))


def loose_id(url: Column, fallback: Column | None = None) -> Column:
    """11 characters behind v=, youtu.be/ or shorts/, else the fallback (the address itself)."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|shorts/)([A-Za-z0-9_-]{11})", 1), F.lit("")), url if fallback is None else fallback)


def shard_uri(path: Column, offset: Column, length: Column) -> Column:
    quoted = F.replace(F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(SHARD_PREFIX), quoted, F.lit("?o="), offset.cast("string"), F.lit("&l="), length.cast("string"))


def shard_parts(uri: Column) -> Column:
    """struct(path, offset, length); null if malformed."""
    ok = r"^shard://([^?]+)\?o=(\d+)&l=(\d+)$"
    path = F.url_decode(F.replace(F.regexp_extract(uri, ok, 1), F.lit("+"), F.lit("%2B")))
    return F.when(uri.rlike(ok), F.struct(path.alias("path"), F.regexp_extract(uri, ok, 2).try_cast("bigint").alias("offset"), F.regexp_extract(uri, ok, 3).try_cast("bigint").alias("length")))


def local_file(x: Column) -> Column:
    """Quotes, a trailing full stop and file:// taken off."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""), r"\.$", ""), "^file://", "")


# --- Times ---
def clock_seconds(x: Column) -> Column:
    """HH:MM:SS.mmm or a plain number in seconds, anything else 0."""
    p = F.split(x, ":")
    t = p[0].try_cast("double") * 3600 + p[1].try_cast("double") * 60 + F.replace(p[2], F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(F.when(F.size(p) == 3, t).when(F.size(p) == 1, x.try_cast("double")), F.lit(0.0))


def numbers(x: Column) -> Column:
    """Numbers of a comma list, bad tokens dropped."""
    parts = F.transform(F.split(F.regexp_replace(x, r"[\[\]\s]", ""), ","), lambda s: s.try_cast("double"))
    return F.filter(parts, lambda v: v.isNotNull())


def uniform_indices(total: Column, fps: Column, target: float, cap: int) -> Column:
    """Frame numbers a step of max(1, round(fps / target)) apart, thinned to ``cap``; the middle frame for a bad rate."""
    step = F.greatest(F.lit(1), F.rint(fps / target).cast("bigint"))
    every = F.sequence(F.lit(0).cast("bigint"), total - 1, step)
    n = F.size(every)
    thin = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: every[F.rint(i * (n - 1) / (cap - 1)).cast("int")])
    return F.when(fps.isNull() | (fps <= 0), F.array(F.floor(total / 2))).when(n > cap, thin).otherwise(every)


def scene_middles(splits: Column) -> Column:
    """Midpoints of the scenes that end behind their start."""
    return F.transform(F.filter(splits, lambda s: s[1] > s[0]), lambda s: (s[0] + s[1]) / 2)


def sparse_indices(total: Column, n: int = 16) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / (n - 1)))


# --- Scores ---
def em(prediction: Column, golds: Column) -> Column:
    p = normal_answer(prediction)
    return F.exists(golds, lambda g: normal_answer(g) == p)


def sub_em(prediction: Column, golds: Column) -> Column:
    p = normal_answer(prediction)
    return F.exists(golds, lambda g: F.contains(p, normal_answer(g)))


def qa_score(solution: Column, golds: Column, format_score: float = 0.0, score: float = 1.0, sub: bool = False) -> Column:
    """Score of the last answer span; a quarter of it if there are more than ten spans' marks."""
    answer = last_tag(solution, "answer")
    right = F.when(F.greatest(count_of(solution, "<answer>"), count_of(solution, "</answer>")) > 10, score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when((sub_em if sub else em)(answer, golds), right).otherwise(format_score)


def gsm_answer(x: Column, strict: bool = True) -> Column:
    """The number behind #### in the last 300 characters, or the last number."""
    tail = F.right(x, F.lit(300))
    found = F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)" if strict else r"(-?[0-9.,]+)"), F.lit(1))
    usable = F.filter(found, lambda s: ~s.isin("", "."))
    return F.when(F.size(usable) > 0, F.regexp_replace(F.element_at(usable, -1), "[,$]", ""))


def match_score(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two arrays."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def boxed(x: Column) -> Column:
    """Inside of the last boxed expression, braces balanced by a fold over the characters."""
    tail = F.when(F.contains(x, F.lit("\\boxed{")), F.substring_index(x, "\\boxed{", -1))
    chars = F.split(tail, "")
    end = F.aggregate(
        chars, F.struct(F.lit(1).alias("depth"), F.lit("").alias("out")),
        lambda a, c: F.when(a["depth"] == 0, a).otherwise(F.struct((a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), F.when((c == "}") & (a["depth"] == 1), a["out"]).otherwise(F.concat(a["out"], c)).alias("out"))),
    )
    return F.when(end["depth"] == 0, end["out"])


# --- Tool calls ---
def tagged_calls(x: Column) -> Column:
    """Array of struct(name, arguments as JSON) of the <tool_call> spans; those that are no JSON are left out."""
    raw = F.regexp_extract_all(x, F.lit("(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    calls = F.transform(raw, lambda s: F.struct(F.get_json_object(s, "$.name").alias("name"), F.get_json_object(s, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def channel_calls(x: Column) -> Column:
    """Calls written in channels, reasoning taken out first."""
    body = F.regexp_replace(x, r"(?s)(<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    call = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
    return F.arrays_zip(F.regexp_extract_all(body, F.lit(call), F.lit(1)).alias("name"), F.regexp_extract_all(body, F.lit(call), F.lit(2)).alias("arguments"))


def xml_calls(x: Column) -> Column:
    """Array of struct(name, parameters map) of <function=..><parameter=..> calls; values stay text and are cast by schema
    with try_cast, never evaluated."""
    bodies = F.regexp_extract_all(x, F.lit("(?s)<function=(.*?)</function>"), F.lit(1))

    def parameters(b: Column) -> Column:
        names = F.regexp_extract_all(b, F.lit("(?s)<parameter=([^>]+)>(.*?)</parameter>"), F.lit(1))
        values = F.regexp_extract_all(b, F.lit("(?s)<parameter=([^>]+)>(.*?)</parameter>"), F.lit(2))
        return F.map_from_arrays(names, F.transform(values, lambda v: F.trim(v, F.lit("\n"))))

    return F.transform(bodies, lambda b: F.struct(F.substring_index(b, ">", 1).alias("name"), parameters(b).alias("parameters")))


# --- Rendering of nested values ---
# Headings of a rendered chain.
CHAIN_SUMMARY = "Video synthesised description:"
CHAIN_FACTS = "Background properties (text-verified facts; safe to use as indirect descriptors):"
CHAIN_CAPTIONS = "Per-frame captions (subset):"


def flattened(df, sep: str = "/") -> list[Column]:
    """A column for every field of a frame, structs taken apart to any depth, named by its path; arrays and maps stay whole."""
    from pyspark.sql.types import StructType

    out: list[Column] = []

    def walk(column: Column, name: str, kind) -> None:
        if isinstance(kind, StructType) and kind.fields:
            for f in kind.fields:
                walk(column.getField(f.name), f"{name}{sep}{f.name}", f.dataType)
        else:
            out.append(column.alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType)
    return out


def trace_block(events: Column, most: int = 6, results: int = 3, chars: int = 200, total: Column | None = None) -> Column:
    """The first ``most`` events of a search trace as text: array<struct<kind, query, url, goal, ok, content, results
    array<struct<title, url, snippet>>>>. A search shows its first ``results`` hits with the head of their snippets. ``total``: how many
    events there are, where the array holds the first ones only."""
    none = lambda c: F.coalesce(c, F.lit(""))

    def hit(r: Column) -> Column:
        snippet = F.regexp_replace(F.trim(none(r["snippet"])), "\n", " ")
        return F.concat(F.lit("\n    • "), none(r["title"]), F.lit(" — "), none(r["url"]), F.when(snippet == "", "").otherwise(F.concat(F.lit("\n      "), F.substring(snippet, 1, chars))))

    def line(e: Column) -> Column:
        hits = F.coalesce(e["results"], F.array().cast("array<struct<title:string,url:string,snippet:string>>"))
        search = F.concat(F.lit("- search('"), none(e["query"]), F.lit("') → "), F.size(hits).cast("string"), F.lit(" results"), F.array_join(F.transform(F.slice(hits, 1, results), hit), ""))
        visit = F.concat(F.lit("- visit "), none(e["url"]), F.lit(" goal='"), none(e["goal"]), F.lit("' ok="), F.when(e["ok"], "True").otherwise("False"))
        kind = F.coalesce(e["kind"], F.lit("?"))
        final = F.concat(F.lit("- final_answer: "), F.substring(none(e["content"]), 1, chars))
        named = F.when(kind == "malformed", "- malformed turn").when(kind == "empty_llm", "- empty LLM reply").otherwise(F.concat(F.lit("- "), kind))
        return F.when(kind == "search", search).when(kind == "visit", visit).when(kind == "final_answer", final).otherwise(named)

    left = (F.size(events) if total is None else total) - most
    rest = F.when(left > 0, F.concat(F.lit("\n... ("), left.cast("string"), F.lit(" more events omitted)"))).otherwise("")
    return F.when(F.size(F.coalesce(events, F.array())) == 0, "(empty trace)").otherwise(F.concat(F.array_join(F.transform(F.slice(events, 1, most), line), "\n"), rest))


def chain_block(hops: Column, frames: bool = True, most: int = 12) -> Column:
    """A chain of entities as text, a block for each: array<struct<name, depth, category, title, url, channel, duration, summary, properties
    array<string>, frames array<struct<timestamp, caption>>, next, reason>>; at most ``most`` captions a hop."""

    def lines(c: Column, head: str, each) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(f"\n{head}"), F.array_join(F.transform(c, each), ""))).otherwise("")

    def block(e: Column, i: Column) -> Column:
        text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
        head = F.concat(F.lit("=== Hop "), i.cast("string"), F.lit(" · Entity: "), e["name"], F.lit(" (depth="), text(e["depth"]), F.lit(", category="), F.coalesce(F.nullif(e["category"], F.lit("")), F.lit("-")), F.lit(") ==="))
        video = F.when(e["url"].isNotNull(), F.concat(F.lit("\nLinked video: title='"), text(e["title"]), F.lit("', url="), e["url"], F.lit(", channel="), text(e["channel"]), F.lit(", duration="), text(e["duration"]), F.lit("s"))).otherwise("")
        summary = F.when(F.coalesce(e["summary"], F.lit("")) != "", F.concat(F.lit(f"\n{CHAIN_SUMMARY}\n"), e["summary"])).otherwise("")
        facts = lines(e["properties"], CHAIN_FACTS, lambda p: F.concat(F.lit("\n  • "), p))
        shown = lines(F.slice(e["frames"], 1, most), CHAIN_CAPTIONS, lambda f: F.concat(F.format_string("\n  • t=%.2fs — ", f["timestamp"]), f["caption"])) if frames else F.lit("")
        left = F.size(e["frames"]) - most
        more = F.when(left > 0, F.concat(F.lit("\n  ...("), left.cast("string"), F.lit(" more frames omitted)"))).otherwise("") if frames else F.lit("")
        onward = F.when(F.coalesce(e["next"], F.lit("")) != "", F.concat(F.lit("\n→ next entity picked: "), e["next"], F.lit(" (reason: "), F.coalesce(e["reason"], F.lit("")), F.lit(")"))).otherwise("")
        return F.concat(head, video, summary, facts, shown, more, onward)

    return F.array_join(F.transform(hops, block), "\n\n")
