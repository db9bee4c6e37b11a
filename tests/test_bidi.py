"""Visual order: worked examples with capital letters for a right-to-left script, and what must hold for any text."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import bidi

HEBREW = {chr(ord("A") + i): chr(0x5D0 + i) for i in range(26)}
BACK = {v: k for k, v in HEBREW.items()}
NAMED = {"{": "⁧", "<<": "⁦", "}": "⁩", "[RLE]": "‫", "[LRE]": "‪", "[RLO]": "‮", "[LRO]": "‭", "[PDF]": "‬", "[RLM]": "‏", "[FSI]": "⁨"}


def shown(text):
    for name, mark in NAMED.items():
        text = text.replace(name, mark)
    return "".join(BACK.get(c, c) for c in bidi.visual_line("".join(HEBREW.get(c, c) for c in text)))


@pytest.mark.parametrize(
    "logical,visual",
    [
        ("car is THE CAR in hebrew", "car is RAC EHT in hebrew"),
        ("CAR IS the car IN ENGLISH", "HSILGNE NI the car SI RAC"),
        ("he said 'IT IS 123, 456, OK'.", "he said 'KO ,456 ,123 SI TI'."),
        ("HE SAID 'it is 123, 456, ok'.", ".'it is 123, 456, ok' DIAS EH"),
        ("plain text (a) 1+2", "plain text (a) 1+2"),
        ("ABC", "CBA"),
        ("A (b) C", "C (b) A"),
        ("a (B) c", "a (B) c"),
        ("AB(CD[&ef]!)gh", "gh(![ef&]DC)BA"),
        ("smith (fabrikam ARABIC) HEBREW", "smith (fabrikam CIBARA) WERBEH"),
        ("ARABIC (HEBREW)", "(WERBEH) CIBARA"),
        ("A 12-34 B", "B 12-34 A"),
        ("A 12/34 B", "B 12/34 A"),
        ("A $12 B", "B $12 A"),
        ("a < B > c", "a < B > c"),
        ("A < b", "b > A"),
        ("A b  ", "  b A"),
        ("a {B 1} c", "a 1 B c"),
        ("A <<b, c} D", "D b, c A"),
        ("a [FSI]B c} d", "a c B d"),
        ("a[RLE]B c[PDF]d", "ac Bd"),
        ("a[RLO]bc[PDF]d", "acbd"),
        ("A[LRO]BC[PDF]D", "DBCA"),
        ("[RLM]1 2", "2 1"),
        ("a } B", "a  B"),
    ],
)
def test_worked_examples(logical, visual):
    assert shown(logical) == visual


def test_arabic_digits_and_marks():
    alef, beh, fatha = "ا", "ب", "َ"
    assert bidi.visual_line(f"{alef}{beh} 12 x") == f"x 12 {beh}{alef}"
    assert bidi.visual_line(f"{alef}{fatha}") == f"{fatha}{alef}"
    assert bidi.visual_line(f"{alef} ١٢-٣") == f"٣-١٢ {alef}"
    levels, base, _ = bidi.levels_of(f"{alef} 1")
    assert (levels, base) == ([1, 1, 2], 1)


def test_pairs_by_names():
    assert [bidi.bracket(c) for c in "([{"] == [("open", c) for c in "([{"] and [bidi.bracket(c) for c in ")]}"] == [("close", c) for c in "([{"]
    assert bidi.bracket("<") is None and bidi.mirror("<") == ">" and bidi.mirror("a") == "a" and bidi.mirror("≪") == "≫"
    assert bidi.bracket("〈") == bidi.bracket("〈")  # equivalent
    assert all(bidi.mirror(bidi.mirror(c)) == c for c in map(chr, range(0x3100)) if unicodedata.category(c) in ("Ps", "Pe") and bidi.mirror(c) != c)


PARTS = st.sampled_from([*"ab אבا1١.,:+$()[]̀‪‫‬‭‮⁦⁧⁨⁩‏\t"])


@given(st.lists(PARTS, max_size=40).map("".join))
@settings(max_examples=400, deadline=None)
def test_nothing_is_lost_and_levels_are_even_for_latin(text):
    out = bidi.visual_line(text)
    hidden = "‪‫‬‭‮⁦⁧⁨⁩‏"
    if bidi._RTL.search(text):
        mirrored = lambda s: sorted(min(c, bidi.mirror(c)) for c in s if c not in hidden)
        assert mirrored(out) == mirrored(text)
    else:
        assert out == text
    levels, base, kinds = bidi.levels_of(text)
    assert base in (0, 1) and all(base <= x <= 126 for x in levels)
    assert all(x % 2 == 0 for x, k, c in zip(levels, kinds, text, strict=True) if k == "L" and not set(text) & set("‮"))


def test_column(spark):
    rows = [("car אב\nא b",), (None,), ("",), ("plain",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(bidi.visual_order("t")).collect()]
    assert got == ["car בא\nb א", None, "", "plain"]
    assert unicodedata.bidirectional("א") == "R"


def test_lines_without_controls_and_mirrored_characters_need_no_levels_of_each(monkeypatch):
    rng = random.Random(12)
    pools = ["abאבג12+-#$,. ְ̀اب!&*\t()«‏‫⁧⁩é\U00010800", "אב1+,. a$", "اب12,.$- aאְ", "ab1, ١٢אا"]
    for _ in range(4000):
        pool = rng.choice(pools)
        text = "\n".join("".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(2))
        assert bidi.visual_text(text) == "\n".join(map(bidi.visual_line, text.split("\n"))), ascii(text)
    want = bidi.visual_line("No. 1: שלום, 12.5% ab עולם  ")
    monkeypatch.setattr(bidi, "levels_of", None)  # that of each character
    assert bidi.visual_text("No. 1: שלום, 12.5% ab עולם  \nabc\n") == f"{want}\nabc\n"
