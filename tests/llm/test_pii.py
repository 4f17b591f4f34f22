import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkloom.llm.pii import DATE, SCHEMES, Finder, common_words, date_pseudonym, id_pseudonym, lexicon, national, permute_text, phone_pseudonym, places, read_date, redact, redacted

FINDER = Finder(frozenset({"neirna", "amber", "yorel", "sogon", "lelya", "dobon"}), frozenset({"bridge", "fafonarro", "field", "kalvyaette", "muthinelle", "romisson", "zavimond", "zavarro", "tukarro", "sevimond", "penarro", "tukinarro"}), frozenset({"amber", "bridge"}))
KEY = b"k"


@given(st.text(alphabet="0123456789ABCXYZ", min_size=1, max_size=18))
def test_feistel_is_a_permutation(value):
    new = permute_text(value, KEY)
    assert permute_text(new, KEY, back=True) == value
    assert [c.isdigit() for c in new] == [c.isdigit() for c in value]


def test_feistel_hits_every_value_once():
    assert {permute_text(f"{i:03d}", KEY) for i in range(1000)} == {f"{i:03d}" for i in range(1000)}
    letters = [f"{a}{b}{i}" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for i in range(10)]
    assert {permute_text(x, KEY) for x in letters} == set(letters)


def _scheme(value):
    s = "".join(c for c in value if c.isalnum())
    return [x.name for x in SCHEMES if x.fits(s)]


@pytest.mark.parametrize(("value", "name"), [("12345678Z", "dni"), ("X1234567L", "nie"), ("123-45-6789", "ssn"), ("AB 12 34 56 C", "nino"), ("4111 1111 1111 1111", "card"), ("DE89 3704 0044 0532 0130 00", "iban"), ("2 55 08 14 168 025 38", "nir")])
def test_valid_numbers_get_valid_pseudonyms(value, name):
    new = id_pseudonym(value, KEY)
    assert name in _scheme(value) and name in _scheme(new) and new != value
    assert [c.isalnum() for c in new] == [c.isalnum() for c in value]
    assert id_pseudonym(new, KEY, back=True) == value


@given(st.integers(min_value=0, max_value=10**8 - 1))
def test_check_letters_hold_for_every_number(n):
    letter = "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23]
    assert _scheme(id_pseudonym(f"{n:08d}{letter}", KEY)) == ["dni"]
    wrong = f"{n:08d}{'O'}"  # no check letter
    assert "dni" not in _scheme(id_pseudonym(wrong, KEY)) and id_pseudonym(id_pseudonym(wrong, KEY), KEY, back=True) == wrong


def test_one_phone_in_many_notations():
    for forms in (["+44 20 7946 0958", "0044 20 7946 0958", "020 7946 0958", "+44 (0)20 7946 0958", "020/79460958"], ["(617) 555-0162", "+1 617 555 0162", "1-617-555-0162", "six one seven, double five five, zero one six two"]):
        new = [phone_pseudonym(f, KEY) for f in forms]
        assert len({national(x)[0] for x in new}) == 1 and national(new[0])[0] != national(forms[0])[0]
        assert [re.sub(r"\d", "9", x) for x in new[:3]] == [re.sub(r"\d", "9", x) for x in forms[:3]]
        assert phone_pseudonym(new[0], KEY, back=True) == forms[0]
    assert all(national(phone_pseudonym(f"(617) 555-{i:04d}", KEY))[0][3] in "23456789" for i in range(50))


def test_dates_stay_dates():
    forms = ["1987-03-25", "25/03/1987", "03/25/1987", "25. März 1987", "March 25th, 1987", "25 de marzo de 1987", "25 mars 1987"]
    assert len({read_date(DATE.fullmatch(date_pseudonym(f, KEY))) for f in forms if "/" not in f}) == 1
    for f in forms:
        new = date_pseudonym(f, KEY)
        assert read_date(DATE.fullmatch(new)) and new != f
    assert date_pseudonym("1987-02-31", KEY) == "1987-02-31" and date_pseudonym(date_pseudonym("1987-03-25", KEY), KEY, back=True) == "1987-03-25"
    text = "Born on 25/03/1987; recorded 2019-09-09"
    assert [(k, text[a:b]) for k, a, b in FINDER.find(text)] == [("date", "25/03/1987")]
    every = Finder(frozenset(), frozenset(), dates="all").find(text)
    assert [(k, text[a:b]) for k, a, b in every] == [("date", "25/03/1987"), ("date", "2019-09-09")]


@pytest.mark.parametrize("frame", ["yesterday {} came home", "later that day {} waited", "{} came home", "so {}, then", "we met {}", "x y {} z"])
@pytest.mark.parametrize("name", ["Neirna Fafonarro", "neirna fafonarro", "Fafonarro, Neirna", "N. Fafonarro", "Neirna B. Fafonarro", "Neirna Fafonarro-Field"])
def test_names_at_every_place(frame, name):
    text = frame.format(name)
    assert ("name", name) in [(k, text[a:b]) for k, a, b in FINDER.find(text)]


def test_many_hits_take_linear_time():
    import time

    took = []
    for n in (2000, 16000):
        text = " ".join(f"write to u{i}@mail.example now;" for i in range(n))
        began = time.perf_counter()
        assert len(FINDER.find(text)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * 4 * took[0]


CASES = [
    ("mail Neirna.b+x@mx8.reel.example now", "email", "Neirna.b+x@mx8.reel.example"), ("x zurlel-b@reel[.]example y", "email", "zurlel-b@reel[.]example"), ("at kofi97 at mail dot example", "email", "kofi97 at mail dot example"),
    ("u a_b (at) mail (dot) example", "email", "a_b (at) mail (dot) example"), ("?user=hefa@post.test", "email", "hefa@post.test"),
    ("Phone: 0044 7700 900244", "phone", "0044 7700 900244"), ("call (617) 555-0162 now", "phone", "(617) 555-0162"), ("Tel.: 030/23125736", "phone", "030/23125736"), ("Tél. 01.99.00.38.24", "phone", "01.99.00.38.24"), ("tel +12125550133", "phone", "+12125550133"), ("call 2125550110", "phone", "2125550110"),
    ("call six one seven, five five five, zero one two eight", "phone", "six one seven, five five five, zero one two eight"),
    ("Passport no. X76416526 belongs", "id", "X76416526"), ("ssn=000-60-0463;", "id", "000-60-0463"), ("ID card QQ 99 78 59 C,", "id", "QQ 99 78 59 C"), ("Ausweisnummer L73X98T41,", "id", "L73X98T41"), ("n 0 53 97 99 576 620 39 x", "id", "0 53 97 99 576 620 39"),
    ("moved to 146 Drulhaven Road, Houbanor last", "address", "146 Drulhaven Road, Houbanor"), ("au 79 bis, avenue Nodhaven, 00541 Drurlepool.", "address", "79 bis, avenue Nodhaven, 00541 Drurlepool"), ("en C/ Pouvgate, 78, 00196 Zeilvoudell.", "address", "C/ Pouvgate, 78, 00196 Zeilvoudell"), ("wohne Brendmere-Allee 100 in Velvofell.", "address", "Brendmere-Allee 100 in Velvofell"),
    ("My name is Yorel B. Fafonarro and", "name", "Yorel B. Fafonarro"), ("issued to ZAVIMOND, Lelya", "name", "ZAVIMOND, Lelya"), ("Ms N. Kalvyaette lives", "name", "N. Kalvyaette"), ("Contact Amber Bridge at", "name", "Amber Bridge"), ("me llamo sogon romisson y vivo", "name", "sogon romisson"),
]


@pytest.mark.parametrize(("text", "kind", "value"), CASES)
def test_found(text, kind, value):
    assert (kind, value) in [(k, text[a:b]) for k, a, b in FINDER.find(text)]


@pytest.mark.parametrize("text", ["thumb@2x.png at 1920x1080", "frame@53.4s", "see @route95", "call sign 97-26-641, channel 5170", "video id 40266845668, batch_00755", "recorded 2019-09-09", "47 Minute Road trip", "Route 69 Lane closed near Skedobury", "crossing the Amber Bridge at", "score 0006 / 666 points", "sha 5fcd1ea35c252319", "episode 6-15-0763", "invoice 123 45 6789", "000-00-0000", "4111 1111 1111 1112", ""])
def test_not_found(text):
    assert FINDER.find(text) == []


def test_invisible_characters_and_positions():
    text = "x­ call (617) 555‑016​2 y"
    ((kind, a, b),) = FINDER.find(text)
    assert kind == "phone" and text[a] == "(" and text[b - 1] == "2"


def test_tables(spark):
    long = "lorem ipsum " * 20000 + "mail a@b.example"
    df = spark.createDataFrame([(1, "tel +12125550133 tel +12125550133", "k"), (2, None, None), (3, "", None), (4, long, None), (None, "a@b.example", None), (1, "tel +12125550133 tel +12125550133", "k")], "doc_id bigint, text string, kind string")
    got = sorted((r["doc_id"] or 0, r["kind"], r["start_pos"]) for r in places(df, "doc_id", "text", FINDER).collect())
    assert got == [(0, "email", 1), (1, "phone", 5), (1, "phone", 5), (1, "phone", 22), (1, "phone", 22), (4, "email", len(long) - 10)]
    out = {r["doc_id"]: r["text"] for r in redacted(df, "doc_id", "text", FINDER, KEY).collect()}
    assert out[2] is None and out[3] == "" and re.fullmatch(r"tel (\[PHONE \+\d{11}\]) tel \1", out[1])
    assert places(df.where("doc_id > 9"), "doc_id", "text", FINDER).count() == 0
    g, f = lexicon(spark.createDataFrame([("Amber", "given"), ("Bridge", "family"), (None, "given")], "name_part string, kind string"))
    docs = spark.createDataFrame([(i, "the bridge is amber") for i in range(5)], "doc_id bigint, text string")
    assert (g, f) == ({"amber"}, {"bridge"}) and common_words(docs, "text", g | f) == {"amber", "bridge"}


def test_redaction_keeps_the_rest():
    text = "Hi a@b.example, bye"
    assert re.fullmatch(r"Hi \[EMAIL [0-9a-f]{10}\], bye", redact(text, FINDER.find(text), KEY))
