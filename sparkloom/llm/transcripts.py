"""Speech transcripts into clean speaker turns.

1. Mining. Wherever marks close something (a colon, a bracket, a dash), the tokens before them are sorted into a tree of fixed
   depth: kind of slot, marks before it, shape of the slot (one word, two, an initial, a title, a handle, a number; capital or not), marks
   behind it. Clock forms go into the same tree. The leaves are the layouts; each counts how often it occurs, and with how many
   different values: a slot varies, a constant such as "note:" does not.
2. Inference. A number leaf is a timestamp slot if its values agree with the times of the rows they stand in. A
   name leaf is a speaker slot if names of the roster stand in it. It is an open one if hardly anything else stands in it: then whatever stands
   there is a label, and the roster only says whose; names it does not know are cut from the speech and count as speaker 0.
3. Extraction. The accepted layouts become one pattern; what it captures is looked up in the roster, allowing for
   a typo. Sound annotations, markup, timestamps and filler words are cut; speech goes to the last label.
4. Merge. A turn is a maximal run of speech by one speaker in time order. Segments are ordered by one range
   partitioning over (video, start, id) and merged partition by partition; what crosses a border (the last label
   and speaker of a video) is one small row per partition. So no video, however long, is one task.

Defined results: null and blank texts hold no speech; rows without a video id or a seg_id are left out; a null start
comes last in its video; rows of a video equal in start and text count once (lowest id); repeated subtitle rows are
treated alone; before any label the speaker is 0; an empty table gives no rows; other columns are ignored whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.common import checkpoint, parallelism, written
from sparkloom.llm.normalise import fold, within

_W = r"[^\W\d_]+"
#: Marks that may stand before and behind a slot; a run of them, spaces aside, is one token of the tree. Stars are not among
#: them: they open annotations.
_BEFORE = re.compile(r"(?:<[a-z]\s+|[<>\[({@#|~»«\-–—]+\s*)$")
_BEHIND = re.compile(r"\s*[:：\])}>|~»«]+|\s+[-–—]+(?=\s)")
#: Numbers that may be a time: clock forms, and bracketed seconds.
_TIME = r"\d{1,4}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?"
_CLOCK = re.compile(rf"(?P<o>[<\[({{])\s?(?P<v>{_TIME}|\d{{1,6}}(?:\.\d+)?\s?s)\s?(?P<c>[>\])}}])|(?P<b>(?<![\w:.,]){_TIME}(?![\w:]))")
# Titles before a family name, filler words.
_TITLE = r"(?:dr|prof|mr|mrs|ms|miss|sir)"
FILLERS = re.compile(r"(?<![\w-])(?:uh+(?:-huh)?|u+m+|uhm+|er+m*|h+m+|mm+(?:-?hmm*)?|mhm+|ah+|eh+)(?![\w-])", re.I)
ANNOTATION = re.compile(r"♪[^♪]*♪|[♪♫♬]+|\[[^\[\]]*\]|\({1,2}[^()]*\){1,2}|\{[^{}]*\}|(?<!\w)\*[^*\n]+\*(?!\w)|<[^<>\n]+>")
#: Closing tags: no slot begins with their mark.
_END_TAG = re.compile(r"</[a-z]+>", re.I)
CUE = re.compile(r"^\s*((?:\d+:)?\d+:\d\d[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d\d[.,]\d+)[^\n]*$", re.M)

_FORMS = {  # regular expression of each slot form, the longer ones first
    "number": r"speaker[\s_#]*\d+", "title": rf"{_TITLE}\.?\s{_W}", "initial": rf"[^\W\d_]\.\s?{_W}", "pair": rf"{_W}\s{_W}", "handle": rf"(?<=@){_W}", "one": _W,
}


def seconds(clock: str) -> float:
    """A clock form or ``12.5s`` in seconds."""
    clock = clock.strip().rstrip("s").strip().replace(",", ".")
    total = 0.0
    for part in clock.split(":"):
        total = 60 * total + float(part)
    return total


class Roster:
    """Speakers (id, given, family) and the look-up of a slot's text."""

    def __init__(self, people: list[tuple[int, str, str]]):
        self.people = [(i, fold(g or ""), fold(f or "")) for i, g, f in people]
        self.ids = {i for i, _, _ in self.people}
        self.given = {g: i for i, g, _ in reversed(self.people) if g}
        self.family = {f: i for i, _, f in reversed(self.people) if f}
        self.full = {(g, f): i for i, g, f in reversed(self.people)}
        self.handle = {g[:1] + f: i for i, g, f in reversed(self.people) if g and f}
        self.names = {*self.given, *self.family, *self.handle}
        self.seen: dict[tuple[str, str], int | None] = {}

    def knows(self, form: str, slot: str) -> bool:
        """Whether a slot of this form names somebody, letter for letter."""
        w = re.findall(_W, fold(slot))
        if form == "number":
            return True
        if form == "pair":
            return (w[0], w[1]) in self.full or (w[1], w[0]) in self.full
        if form == "handle":
            return w[0] in self.handle
        return w[-1] in self.family or (form == "one" and w[-1] in self.given)

    def look_up(self, form: str, slot: str) -> int | None:
        key = (form, slot)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._look_up(form, fold(slot))
        return self.seen[key]

    def _look_up(self, form: str, slot: str) -> int | None:
        w = re.findall(_W, slot)
        if form == "number":
            n = int(re.findall(r"\d+", slot)[-1])
            return n if n in self.ids else None
        if form == "pair":
            g, f = w
            if (g, f) in self.full:
                return self.full[g, f]
            if (f, g) in self.full:
                return self.full[f, g]
            return self._only([i for i, a, b in self.people if (g == a and within(f, b, 2)) or (f == b and within(g, a, 2)) or (within(g, a, 1) and within(f, b, 1))])
        if form == "initial":
            return self._only([i for i, a, b in self.people if a[:1] == w[0] and self._near(w[-1], b)])
        if form == "title":
            return self.family.get(w[-1]) or self._only([i for i, _, b in self.people if self._near(w[-1], b)])
        if form == "handle":
            return self.handle.get(slot) or self._only([i for i, a, b in self.people if self._near(slot, a[:1] + b)])
        return self.family.get(slot) or self.given.get(slot) or self._only([i for i, a, b in self.people if self._near(slot, a) or self._near(slot, b)])

    @staticmethod
    def _near(a: str, b: str) -> bool:
        return a == b or (min(len(a), len(b)) >= 5 and within(a, b, 1))

    @staticmethod
    def _only(found: list[int]) -> int | None:
        return found[0] if len(set(found)) == 1 else None


# --- Mining --------------------------------------------------------------------------------------------------
#: Marks that close a slot, and the slots that can stand before them, by shape.
_CLOSE = re.compile(r"(?<=[^\W_])\s*[:：\])}>|~»«]+|(?<=[^\W_])\s+[-–—]+(?=\s)")
_SHAPES = {form: re.compile(rf"(?<![\w{'' if form == 'handle' else '@'}])(?:{pattern})$", re.I) for form, pattern in _FORMS.items()}
_NAMED = tuple(form for form in _FORMS if form != "number")
_SLOT = re.compile(r"\S+(?:\s\S+)?$")
_LAST = re.compile(r"[^\W_]+$")
_ANCHORED = re.compile(rf"(?:^|[\n\r]|(?<=[<>\[({{@#|~»«\-–—]))\s*({_W}(?:\s{_W})?)$")


def _shape(slot: str) -> str:
    """capital, if every word of the slot begins with a capital; else small."""
    return "capital" if all(w[0].isupper() for w in re.findall(_W, slot)) else "small"


def heads(text: str, times: tuple[float, float] | None, roster: Roster) -> list[tuple[tuple[str, str, str, str, str], str, int, int]]:
    """Leaves (kind, before, form, case, behind) that the text falls into, with the slot's value and two counts: known and agreeing."""
    out = []
    text = plain = _END_TAG.sub(lambda m: " " * len(m.group()), text)
    for m in _CLOCK.finditer(text):
        if m["b"] and m.start() and text[m.start() - 1] not in "\n\r":
            continue
        value = m["v"] or m["b"]
        known = times is not None
        agree = known and times[0] - 2 <= seconds(value) <= times[1] + 2
        out.append((("time", m["o"] or "", re.sub(r"\d+", "9", value), "", m["c"] or ""), value, int(known), int(agree)))
        # A boundary stands in for it, so that marks of a time are not taken for marks of a name.
        plain = plain[: m.start()] + "\n" * (m.end() - m.start()) + plain[m.end() :]
    for m in _CLOSE.finditer(plain):
        low = max(0, m.start() - 64)
        left = plain[low : m.start()]
        found = None
        last = fold(_LAST.search(left).group())
        # Only a number or a name of the roster can stand at the end of a known slot.
        forms = ("number",) if last[-1].isdigit() else _NAMED if last in roster.names else ()
        for form in forms:
            if (t := _SHAPES[form].search(left)) and roster.knows(form, t.group()):
                found = form, t
                break
        known = found is not None
        if not known and (t := _ANCHORED.search(left)):  # a slot of another name, or none
            left = left[: t.start(1)] + t.group(1)
            t = _SLOT.search(left, t.start(1))
            found = ("pair" if len(t.group().split()) == 2 else "one"), t
        if found is None:
            continue
        form, t = found
        before = _BEFORE.search(left[: t.start()])
        out.append((("name", before[0].strip() if before else "", form, _shape(t.group()), m.group().strip()), fold(t.group()), int(known), int(known)))
    return out


LEAF = "kind string, before string, form string, shape string, behind string, value string, n bigint, known bigint, agree bigint"
_KEYS = ["kind", "before", "form", "shape", "behind"]


def mine(lines: DataFrame, roster: Roster) -> DataFrame:
    """The leaves over all lines (body, start_s, end_s): n, values (how many different ones), named (how many of those the roster knows), known, agree."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        known: Counter = Counter()
        agree: Counter = Counter()
        total = 0
        for f in frames:
            total += len(f)
            for body, a, b in zip(f["body"], f["start_s"], f["end_s"]):
                times = None if a != a or a is None else (a, max(a, b) if b == b and b is not None else a + 10)
                for leaf, value, k, g in heads(body, times, roster):
                    key = (*leaf, "" if leaf[0] == "time" else value)
                    n[key] += 1
                    known[key] += k
                    agree[key] += g
        rows = [(*key, c, known[key], agree[key]) for key, c in n.items()]
        yield pd.DataFrame([*rows, ("", "", "", "", "", "", total, 0, 0)], columns=[*_KEYS, "value", "n", "known", "agree"])

    by_value = lines.mapInPandas(count, LEAF).groupBy(*_KEYS, "value").agg(*[F.sum(c).alias(c) for c in ("n", "known", "agree")])
    return by_value.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.count_if(F.col("known") > 0).alias("named"), F.sum("known").alias("known"), F.sum("agree").alias("agree"))


def infer(leaves: DataFrame, least: float = 1e-4, share: float = 0.5, open_share: float = 0.9) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]], frozenset[tuple[str, str, str, str]]]:
    """Name and time layouts (form, before, behind), and the open ones of the name layouts (form, shape, before, behind).

    A leaf needs ``least`` occurrences for each line, so a layout counts alike in a corpus of any size. Only leaves that can be
    accepted reach the driver; their marks are short runs, so these are at most a few hundred.
    """
    total = leaves.where("kind = ''").agg(F.sum("n")).collect()[0][0] or 0
    name = (F.col("kind") == "name") & (F.col("behind") != "") & (F.col("known") > 0)
    rows = leaves.where(((F.col("kind") == "time") & (F.col("known") > 0) | name) & (F.col("n") >= least * total)).collect()
    names = {(r["form"], r["before"], r["behind"]) for r in rows if r["kind"] == "name"}
    clocks = {(r["form"], r["before"], r["behind"]) for r in rows if r["kind"] == "time" and r["agree"] >= share * r["known"]}
    # A slot varies: three values at least stand in it. Its values count once, so that many lines of one stray word open nothing.
    open_ = {(r["form"], r["shape"], r["before"], r["behind"]) for r in rows if r["kind"] == "name" and r["values"] >= 3 and r["known"] >= open_share * r["n"] and r["named"] >= open_share * r["values"]}
    return sorted(names), sorted(clocks), frozenset(open_)


# --- Extraction ----------------------------------------------------------------------------------------------
class Extractor:
    """Runs of speech of a text, by the mined layouts."""

    def __init__(self, names: list[tuple[str, str, str]], clocks: list[tuple[str, str, str]], open_: frozenset[tuple[str, str, str, str]], roster: Roster):
        self.roster, self.open = roster, open_
        self.clocks = frozenset(clocks)
        order = {"pair": 0, "initial": 1, "title": 2, "number": 3, "handle": 4, "one": 5}
        self.forms, self.marks, parts = [], [], []
        for i, (form, before, behind) in enumerate(sorted(names, key=lambda x: (order[x[0]], -len(x[1]) - len(x[2]), x))):
            opener = re.escape(before) + (r"\s+" if re.fullmatch(r"<[a-z]", before) else r"\s*") if before else r"(?<![\w@])"
            closer = rf"\s+{re.escape(behind)}(?=\s)" if re.fullmatch(r"[-–—]+", behind) else rf"\s*{re.escape(behind)}"
            parts.append(rf"(?P<s{i}>{opener}(?P<n{i}>{_FORMS[form]}){closer})")
            self.forms.append(form)
            self.marks.append((before, behind))
        self.label = re.compile("|".join(parts), re.I) if parts else None

    def labels(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, speaker) of the labels in the text."""
        out, at = [], 0
        while self.label and (m := self.label.search(text, at)):
            i = next(k for k in range(len(self.forms)) if m[f"s{k}"] is not None)
            who = self.roster.look_up(self.forms[i], m[f"n{i}"])
            if who is None:  # another layout may fit here
                who, m2 = self._others(text, m.start())
                if who is None and (m2 := self._unlisted(text, m.start())):
                    who = 0
                if who is None:
                    at = m.start() + 1
                    # Skip on to the next word: no layout can start inside one.
                    while at < len(text) and text[at].isalnum() and text[at - 1].isalnum():
                        at += 1
                    continue
                out.append((m.start(), m2, who))
                at = m2
                continue
            out.append((m.start(), m.end(), who))
            at = m.end()
        return out

    def _others(self, text: str, start: int) -> tuple[int | None, int]:
        for form, pattern in self._single():
            m = pattern.match(text, start)
            if m and (who := self.roster.look_up(form, m["n"])) is not None:
                return who, m.end()
        return None, start

    def _unlisted(self, text: str, start: int) -> int:
        """End of a label of nobody in the roster at ``start``: an open layout, at the head of a line or behind a mark; 0: none."""
        for (form, pattern), (before, behind) in zip(self._single(), self.marks):
            if (m := pattern.match(text, start)) and (form, _shape(m["n"]), before, behind) in self.open and (before or not text[:start].rstrip(" \t") or text[:start].rstrip(" \t")[-1] in "\n\r"):
                return m.end()
        return 0

    def _single(self) -> list[tuple[str, re.Pattern]]:
        if not hasattr(self, "_one"):
            parts = self.label.pattern.split("|(?P<s") if self.label else []
            self._one = []
            for i, p in enumerate(parts):
                p = p if i == 0 else "(?P<s" + p
                self._one.append((self.forms[i], re.compile(re.sub(r"\(\?P<n\d+>", "(?P<n>", re.sub(r"^\(\?P<s\d+>", "(?:", p)), re.I)))
        return self._one

    def without_times(self, text: str) -> str:
        """Timestamps of the mined layouts blanked, length kept."""

        def cut(m: re.Match) -> str:
            known = (re.sub(r"\d+", "9", m["v"] or m["b"]), m["o"] or "", m["c"] or "") in self.clocks
            return " " * len(m.group()) if known and (m["o"] or m.start() == 0 or not text[m.start() - 1].isalnum()) else m.group()

        return _CLOCK.sub(cut, text)

    @staticmethod
    def clean(text: str) -> str:
        """Speech alone: without annotations, markup and fillers."""
        text = FILLERS.sub(" ", ANNOTATION.sub(" ", text))
        text = re.sub(r"\s+([,;:.!?])", r"\1", " ".join(text.split()))
        return re.sub(r"^(?:[,;:]\s*)+|(?:,\s*)+(?=,)", "", text).strip()

    def runs(self, text: str) -> list[tuple[int | None, str]]:
        """(label or None to go on with the last one, speech; empty if there is none), in order."""
        text = self.without_times(_END_TAG.sub(lambda m: " " * len(m.group()), text))
        out, at, who = [], 0, None
        for a, b, i in self.labels(text):
            if at or a:
                out.append((who, self.clean(text[at:a])))
            who, at = i, b
        out.append((who, self.clean(text[at:])))
        return [(w, s if any(c.isalnum() for c in s) else "") for w, s in out]


def cues(text: str) -> list[tuple[float | None, str]]:
    """(start or None, body) of the cues of a subtitle in order of time; lines, where it has no cue times."""
    found = list(CUE.finditer(text))
    if found:
        out = []
        for m, nxt in zip(found, [*found[1:], None]):
            body = text[m.end() : nxt.start() if nxt else len(text)]
            if nxt:  # the line before the next cue times may be its number or name
                body = re.sub(r"\n[ \t]*\n[^\n]*\n?\Z", "\n", body) if re.search(r"\n[ \t]*\n[ \t]*[^\s][^\n]*\n?\Z", body) else body
            out.append((seconds(m[1]), body.strip("\n")))
        return sorted(out, key=lambda x: x[0])
    lines = text.split("\n")
    at = [_CLOCK.match(x) for x in lines]
    timed = [m for m in at if m and m["o"] and m["c"]]
    if timed and 2 * len(timed) >= sum(bool(x.strip()) for x in lines) and at[0]:
        out, now = [], None
        for x, m in zip(lines, at):
            if m and m["o"] and m["c"]:
                now = seconds(m["v"])
                out.append((now, x[m.end() :]))
            else:
                out.append((now, x))
        return sorted(out, key=lambda x: x[0] if x[0] is not None else -1.0)
    return [(None, text)]


# --- Queries' building blocks --------------------------------------------------------------------------------
def prepared_segments(segments: DataFrame) -> DataFrame:
    """video_id, start_s, end_s, seg_id, body: one row of those equal in video, start and text."""
    src = segments.where(F.col("video_id").isNotNull() & F.col("seg_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))
    best = F.min(F.struct(F.col("seg_id").cast("bigint").alias("seg_id"), F.col("end_s").cast("double").alias("end_s")))
    out = src.groupBy("video_id", F.col("start_s").cast("double").alias("start_s"), F.col("text").alias("body")).agg(best.alias("b"))
    return out.select("video_id", "start_s", F.col("b.end_s").alias("end_s"), F.col("b.seg_id").alias("seg_id"), "body")


def subtitle_lines(videos: DataFrame) -> DataFrame:
    """Non-blank subtitles: video_idx, body."""
    return videos.where(F.col("subtitle").isNotNull() & (F.trim("subtitle") != "")).select(F.col("video_idx").cast("bigint").alias("video_idx"), F.col("subtitle").alias("body"))


def layouts(segments: DataFrame, subtitles: DataFrame, roster: Roster) -> tuple[list, list, frozenset]:
    """Accepted layouts over all segments and subtitles."""
    none = F.lit(None).cast("double")
    lines = segments.select("body", "start_s", "end_s").unionByName(subtitles.select("body", none.alias("start_s"), none.alias("end_s")))
    return infer(written(mine(lines.repartition(parallelism(segments.sparkSession)), roster)))


LINE = "video_id string, start_s double, end_s double, seg_id bigint, run_no int, label int, speech string"


def segment_lines(segments: DataFrame, extractor: Extractor) -> DataFrame:
    """The runs of every segment, in global order (video_id, start_s nulls last, seg_id, run_no), checkpointed, with turn
    columns: speaker_id, item_key (the seg_id that opens the turn), opens (whether the run does)."""
    spark = segments.sparkSession

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (v, a, b, i, n, w, s)
                for v, a, b, i, body in zip(f["video_id"], f["start_s"], f["end_s"], f["seg_id"], f["body"])
                for n, (w, s) in enumerate(extractor.runs(body))
                if w is not None or s
            ]
            yield pd.DataFrame(rows, columns=["video_id", "start_s", "end_s", "seg_id", "run_no", "label", "speech"]).astype({"label": "Int32"})

    order = [F.col("video_id"), F.col("start_s").asc_nulls_last(), F.col("seg_id"), F.col("run_no")]
    # Written first: the range partitioning reads its input twice, once for a sample.
    runs = written(segments.repartition(parallelism(spark)).mapInPandas(extract, LINE)).repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    runs = checkpoint(runs).withColumn("part", F.spark_partition_id())

    def summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = part = None
        label, spoke = None, None  # spoke: a speaker, -1: the label at entry, None: nobody
        for f in frames:
            for p, v, w, s in zip(f["part"], f["video_id"], f["label"], f["speech"]):
                part = int(p)
                if v != last:
                    first, last, label, spoke = first if first is not None else v, v, None, None
                if w is not None and w == w:
                    label = int(w)
                if s:
                    spoke = label if label is not None else -1
        if part is not None:
            yield pd.DataFrame({"part": [part], "first": [first], "last": [last], "label": pd.array([label], "Int32"), "spoke": pd.array([spoke], "Int32")})

    # One row per partition.
    ends = {r["part"]: r for r in runs.mapInPandas(summary, "part int, first string, last string, label int, spoke int").collect()}
    enter: dict[int, tuple[str | None, int, int | None]] = {}
    video, label, spoke = None, 0, None
    for p in sorted(ends):
        enter[p] = (video, label, spoke)
        r = ends[p]
        if r["last"] != video or r["first"] != r["last"]:
            label0, spoke0 = 0, None  # the last video starts within this partition
        else:
            label0, spoke0 = label, spoke
        video = r["last"]
        spoke = spoke0 if r["spoke"] is None else (label0 if r["spoke"] == -1 else r["spoke"])
        label = label0 if r["label"] is None else r["label"]

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for f in frames:
            who, opens = [], []
            for p, v, w, s in zip(f["part"], f["video_id"], f["label"], f["speech"]):
                if state is None:
                    state = enter[int(p)]
                if v != state[0]:
                    state = (v, 0, None)
                lab = state[1] if w is None or w != w else int(w)
                new = bool(s) and state[2] != lab
                state = (v, lab, lab if s else state[2])
                who.append(lab)
                opens.append(new)
            yield f.drop(columns=["part", "label"]).assign(speaker_id=who, opens=opens)

    return runs.mapInPandas(merge, "video_id string, start_s double, end_s double, seg_id bigint, run_no int, speech string, speaker_id int, opens boolean").where("speech <> ''")


def subtitle_turns(subtitles: DataFrame, extractor: Extractor) -> DataFrame:
    """item_key, turn_no (from 1), speaker_id, start_s, speech of every turn of every subtitle."""

    def turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[list] = []
            for key, body in zip(f["video_idx"], f["body"]):
                label, spoke, no = 0, None, 0
                for start, cue in cues(body):
                    for w, s in extractor.runs(cue):
                        label = label if w is None else w
                        if not s:
                            continue
                        if spoke != label:
                            no += 1
                            rows.append([key, no, label, start, [s]])
                            spoke = label
                        else:
                            rows[-1][4].append(s)
            yield pd.DataFrame([(k, n, w, a, " ".join(s)) for k, n, w, a, s in rows], columns=["item_key", "turn_no", "speaker_id", "start_s", "speech"]).astype({"start_s": "float64"})

    return subtitles.repartition(parallelism(subtitles.sparkSession)).mapInPandas(turns, "item_key bigint, turn_no int, speaker_id int, start_s double, speech string")


def roster_of(speakers: DataFrame) -> Roster:
    """The roster, a reference list read whole."""
    rows = speakers.where("speaker_id is not null").select("speaker_id", "given_name", "family_name").orderBy("speaker_id").collect()
    return Roster([(r[0], r[1], r[2]) for r in rows])
