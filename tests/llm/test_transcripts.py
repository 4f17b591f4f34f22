from sparkloom.llm.transcripts import Extractor, Roster, cues, infer, layouts, mine, prepared_segments, roster_of, seconds, segment_lines, subtitle_lines, subtitle_turns

PEOPLE = [(1, "Skubin", "Handinwick"), (2, "Zounden", "Zibyaette"), (3, "Neda", "Zeminmond")]
SEG = "seg_id bigint, video_id string, start_s double, end_s double, text string, label string, part string, speech string"
FORMS = ["Skubin Handinwick: ", "S. Handinwick: ", "Dr. Handinwick: ", "[Skubin Handinwick] ", "skubin handinwick : ", "- Skubin: ", ">> Handinwick: ", ">>SKUBIN: ", "@shandinwick: ", "Speaker 1 - ", "SPEAKER_001: ", "<v Skubin Handinwick>", "(Handinwick) ", "Handinwick："]


def _extractor(spark):
    roster = Roster(PEOPLE)
    rows = [(i, "v", float(10 * i), 10.0 * i + 9, f + "the kettle turns", None, None, None) for i, f in enumerate(FORMS * 6)]
    rows += [(1000 + i, "w", float(60 * i), 60.0 * i + 9, f"[0{i}:00] note: the furnace, it cools", None, None, None) for i in range(9)]
    seg = prepared_segments(spark.createDataFrame(rows, SEG))
    return Extractor(*infer(mine(seg, roster)), roster), roster


def test_every_notation_is_mined_and_read(spark):
    x, _ = _extractor(spark)
    for f in FORMS:
        assert [r for r in x.runs(f + "um, the kettle turns") if r[0] or r[1]] == [(1, "the kettle turns")], f
    assert x.runs("the tent <00:00:03.898>>>SKUBIN: erm [music] ") [1:] == [(1, "")] or x.runs("the tent >>SKUBIN: erm [music]")[-1] == (1, "")
    assert x.runs("Handinwick：*laughs*")[-1] == (1, "")
    assert x.runs("Skubin Handniwick: typo")[-1] == (1, "typo")
    assert x.runs("note: the furnace, (( coughs )) it cools") == [(None, "note: the furnace, it cools")]
    assert x.runs("[04:00] *laughs* ♪ music ♪ hmm {noise}") == [(None, "")]
    assert [r[0] for r in x.runs("one two  [Zounden Zibyaette] three\n>> Zeminmond: four")] == [None, 2, 3]


def test_turns_over_borders_repeats_and_nulls(spark):
    x, _ = _extractor(spark)
    rows, want, last = [], [], None
    for i in range(400):
        who = (i // 7) % 3 + 1
        label = FORMS[0].replace("Skubin Handinwick", f"{PEOPLE[who - 1][1]} {PEOPLE[who - 1][2]}") if i % 7 == 0 else ""
        rows.append((i, "long", float(i), None, f"{label}word {i}", None, None, None))
        if i == 0 or who != last:
            want.append((i, who))
        last = who
    rows += [(900, "long", 3.0, 4.0, "word 3", None, None, None), (901, "short", 5.0, 1.0, "hello", None, None, None), (902, "short", 6.0, None, None, None, None, None), (903, "short", 7.0, 8.0, "um [music]", None, None, None), (904, "short", 8.0, 9.0, "Skubin Handinwick: uh", None, None, None), (905, "short", None, 9.0, "last", None, None, None), (906, None, 1.0, 2.0, "nobody", None, None, None), (None, "short", 1.0, 2.0, "nobody", None, None, None)]
    lines = segment_lines(prepared_segments(spark.createDataFrame(rows, SEG)), x)
    got = sorted((r["seg_id"], r["speaker_id"]) for r in lines.where("opens").collect())
    assert got == sorted([*want, (901, 0), (905, 1)])
    assert segment_lines(prepared_segments(spark.createDataFrame([], SEG)), x).count() == 0


def test_subtitles(spark):
    x, _ = _extractor(spark)
    vtt = "WEBVTT\n\n00:00:05.000 --> 00:00:07.000\nskubin handinwick : second\n\n00:00:01.000 --> 00:00:02.000\n>> Zibyaette: first\n\n00:00:08.000 --> 00:00:09.000\n[music]\n"
    srt = "1\n00:00:01,000 --> 00:00:02,000\nhello\n\n2\n00:00:03,000 --> 00:00:04,000\nDr. Handinwick: there"
    df = spark.createDataFrame([(1, vtt, "x"), (2, srt, "x"), (3, "", "x"), (4, None, "x"), (5, "[00:01] Zeminmond：one\n[00:03] two", "x"), (5, "plain", "x")], "video_idx bigint, subtitle string, body string")
    got = sorted((r["item_key"], r["turn_no"], r["speaker_id"], r["speech"]) for r in subtitle_turns(subtitle_lines(df), x).collect())
    assert got == [(1, 1, 2, "first"), (1, 2, 1, "second"), (2, 1, 0, "hello"), (2, 2, 1, "there"), (5, 1, 0, "plain"), (5, 1, 3, "one two")]


def test_parts(spark):
    assert seconds("00:01:02,5") == 62.5 and seconds("12.5s") == 12.5
    assert cues("a\nb") == [(None, "a\nb")]
    assert roster_of(spark.createDataFrame([(1, "A", "B"), (None, "C", "D")], "speaker_id int, given_name string, family_name string")).ids == {1}
    empty = prepared_segments(spark.createDataFrame([], SEG))
    none = subtitle_lines(spark.createDataFrame([], "video_idx bigint, subtitle string"))
    assert layouts(empty, none, Roster(PEOPLE)) == ([], [], frozenset())
    assert Extractor([], [], frozenset(), Roster(PEOPLE)).runs("text") == [(None, "text")]


MANY = [*PEOPLE, *((10 + i, f"{a}{b}en", f"{b}o{a}mond") for i, (a, b) in enumerate((x, y) for x in ("Bal", "Dor", "Fen") for y in ("Gul", "Har", "Kis", "Lom")))]


def _corpus(spark, times=1):
    names = [f"{a} {b}" for _, a, b in MANY]
    rows = []
    for k in range(60 * times):
        rows.append((k, f"v{k}", 0.0, 9.0, f"{names[k % 15]}: the kettle turns", None, None, None))
    rows += [(10000 + k, f"w{k}", 0.0, 9.0, f"the magnet{'s' * (k % 7)}: it turns", None, None, None) for k in range(20 * times)]
    rows += [(20000 + k, f"x{k}", 0.0, 9.0, f"{names[k % 15].lower()}: low", None, None, None) for k in range(20 * times)]
    rows += [(30000, "u", 0.0, 9.0, "Jonas Weber: hello there", None, None, None), (30001, "u", 1.0, 9.0, "still he", None, None, None), (30002, "u", 2.0, 9.0, "Neda Zeminmond: yes", None, None, None)]
    return prepared_segments(spark.createDataFrame(rows, SEG))


def test_labels_of_people_outside_the_roster(spark):
    """Two capital words before a colon are names almost always: an open layout. Two small ones are speech as often as not."""
    roster = Roster(MANY)
    found = infer(mine(_corpus(spark), roster))
    assert ("pair", "capital", "", ":") in found[2] and ("pair", "small", "", ":") not in found[2]
    x = Extractor(*found, roster)
    assert x.runs("Jonas Weber: hello there") == [(0, "hello there")]
    assert x.runs("the magnet: it turns") == [(None, "the magnet: it turns")]
    assert x.runs("neda zeminmond: low") == [(3, "low")]
    assert x.runs("we saw Jonas Weber: there") == [(None, "we saw Jonas Weber: there")]  # not at the head of a line
    got = [(r["seg_id"], r["speaker_id"]) for r in segment_lines(_corpus(spark).where("video_id = 'u'"), x).where("opens").orderBy("seg_id").collect()]
    assert got == [(30000, 0), (30002, 3)]


def test_layouts_do_not_hang_on_the_size_of_the_corpus(spark):
    roster = Roster(MANY)
    assert infer(mine(_corpus(spark), roster)) == infer(mine(_corpus(spark, 8), roster))


def test_annotations_of_any_length(spark):
    x, _ = _extractor(spark)
    long = "a door slams and " * 40
    for text in (f"[{long}]", f"(({long}))", f"♪ {long} ♪", f"*{long}*", f"{{{long}}}"):
        assert x.runs(f"Skubin Handinwick: {text} the kettle turns")[-1] == (1, "the kettle turns")
    assert x.runs("<v Skubin Handinwick>the kettle</v> turns")[-1] == (1, "the kettle turns")
