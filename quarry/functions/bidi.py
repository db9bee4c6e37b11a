"""Visual order of mixed left-to-right and right-to-left text, by the Unicode bidirectional algorithm (UAX #9).

Each line is a paragraph whose direction its first strong character gives. Levels
are found with explicit embeddings, overrides and isolates, weak and neutral types
and bracket pairs; then runs are reversed and characters of right-to-left runs
mirrored. Controls of direction are not shown. Character properties are those of
Python's Unicode tables; the pairs of brackets and mirror images, which are not in
these, follow from the characters' names.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DEEPEST = 125
#: Characters without which a text is in visual order as it stands: those of right-to-left scripts, and the controls.
RTL = r"[֐-ࣿיִ-﷿ﹰ-ﻼ‏‫‮⁧\U00010800-\U00010fff\U0001e800-\U0001efff]"
_RTL = re.compile(RTL)
ISOLATES = {"LRI", "RLI", "FSI"}
NEUTRAL = {"B", "S", "WS", "ON", "LRI", "RLI", "FSI", "PDI"}
REMOVED = {"RLE", "LRE", "RLO", "LRO", "PDF", "BN"}


def kind_of(c: str) -> str:
    found = unicodedata.bidirectional(c)
    return found or ("R" if _RTL.match(c) else "L")


@lru_cache(4096)
def mirror(c: str) -> str:
    """The mirror image of a character, or itself."""
    if not unicodedata.mirrored(c):
        return c
    name = unicodedata.name(c, "")
    for a, b in (("LEFT", "RIGHT"), ("LESS-THAN", "GREATER-THAN"), ("PRECEDES", "SUCCEEDS"), ("SUBSET", "SUPERSET"), ("ELEMENT OF", "CONTAINS AS MEMBER")):
        for old, new in ((a, b), (b, a)):
            if re.search(rf"\b{old}\b", name):
                try:
                    return unicodedata.lookup(re.sub(rf"\b{old}\b", new, name))
                except KeyError:
                    continue
    return c


def bracket(c: str) -> tuple[str, str] | None:
    """("open" or "close", the pair's opening bracket); equivalent brackets share one."""
    side = {"Ps": "open", "Pe": "close"}.get(unicodedata.category(c))
    if not side or not unicodedata.mirrored(c) or mirror(c) == c:
        return None
    return side, unicodedata.normalize("NFC", c if side == "open" else mirror(c))


def _match_isolates(kinds: list[str]) -> dict[int, int]:
    """Isolate initiator to its matching end, and back; those without one are left out."""
    out, stack = {}, []
    for i, kind in enumerate(kinds):
        if kind in ISOLATES:
            stack.append(i)
        elif kind == "PDI" and stack:
            j = stack.pop()
            out[i], out[j] = j, i
    return out


def _first_strong(kinds: list[str], pairs: dict[int, int], start: int, end: int) -> int | None:
    i = start
    while i < end:
        if kinds[i] in ("L", "R", "AL"):
            return 0 if kinds[i] == "L" else 1
        i = pairs.get(i, end) if kinds[i] in ISOLATES else i + 1
    return None


def _explicit(kinds: list[str], pairs: dict[int, int], base: int) -> tuple[list[int], list[str]]:
    """Levels by embeddings and isolates, and the types that overrides leave (X1 to X8)."""
    stack, levels, types = [(base, None, False)], [], list(kinds)
    over_isolate = over_embedding = valid = 0
    for i, kind in enumerate(kinds):
        level, override, _ = stack[-1]
        if kind in ("RLE", "LRE", "RLO", "LRO"):
            levels.append(level)
            new = (level + 1) | 1 if kind[0] == "R" else (level + 2) & ~1
            if new <= DEEPEST and not over_isolate and not over_embedding:
                stack.append((new, {"RLO": "R", "LRO": "L"}.get(kind), False))
            elif not over_isolate:
                over_embedding += 1
        elif kind in ISOLATES:
            levels.append(level)
            types[i] = override or kind
            rtl = kind == "RLI" or kind == "FSI" and _first_strong(kinds, pairs, i + 1, pairs.get(i, len(kinds))) == 1
            new = (level + 1) | 1 if rtl else (level + 2) & ~1
            if new <= DEEPEST and not over_isolate and not over_embedding:
                valid += 1
                stack.append((new, None, True))
            else:
                over_isolate += 1
        elif kind == "PDI":
            if over_isolate:
                over_isolate -= 1
            elif valid:
                over_embedding = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                valid -= 1
            levels.append(stack[-1][0])
            types[i] = stack[-1][1] or kind
        elif kind == "PDF":
            levels.append(level)
            if not over_isolate and over_embedding:
                over_embedding -= 1
            elif not over_isolate and not stack[-1][2] and len(stack) > 1:
                stack.pop()
        else:
            levels.append(base if kind == "B" else level)
            if override and kind not in ("BN", "B"):
                types[i] = override
    return levels, types


def _sequences(kinds: list[str], levels: list[int], pairs: dict[int, int]) -> list[list[int]]:
    """Isolating run sequences: runs of one level, joined where an isolate stands between (X10)."""
    runs: list[list[int]] = []
    for i in (i for i, k in enumerate(kinds) if k not in REMOVED):
        if runs and levels[runs[-1][-1]] == levels[i] and not (kinds[runs[-1][-1]] in ISOLATES and runs[-1][-1] in pairs) and not (kinds[i] == "PDI" and i in pairs):
            runs[-1].append(i)
        else:
            runs.append([i])
    by_start, out = {r[0]: r for r in runs}, []
    for run in runs:
        if kinds[run[0]] == "PDI" and run[0] in pairs:
            continue
        whole = list(run)
        while kinds[whole[-1]] in ISOLATES and pairs.get(whole[-1]) in by_start:
            whole += by_start[pairs[whole[-1]]]
        out.append(whole)
    return out


def _weak(t: list[str], sos: str) -> None:
    """Rules W1 to W7 on the types of one sequence."""
    before = sos
    for i, kind in enumerate(t):
        if kind == "NSM":
            t[i] = "ON" if before in ISOLATES or before == "PDI" else before
        before = t[i]
    strong = sos
    for i, kind in enumerate(t):
        if kind in ("L", "R", "AL"):
            strong = kind
        elif kind == "EN" and strong == "AL":
            t[i] = "AN"
    t[:] = ["R" if kind == "AL" else kind for kind in t]
    for i in range(1, len(t) - 1):
        if t[i - 1] == t[i + 1] and (t[i] == "ES" and t[i - 1] == "EN" or t[i] == "CS" and t[i - 1] in ("EN", "AN")):
            t[i] = t[i - 1]
    i = 0
    while i < len(t):
        j = i
        while j < len(t) and t[j] == "ET":
            j += 1
        if j > i and (i and t[i - 1] == "EN" or j < len(t) and t[j] == "EN"):
            t[i:j] = ["EN"] * (j - i)
        i = max(j, i + 1)
    t[:] = ["ON" if kind in ("ES", "ET", "CS") else kind for kind in t]
    strong = sos
    for i, kind in enumerate(t):
        if kind in ("L", "R"):
            strong = kind
        elif kind == "EN" and strong == "L":
            t[i] = "L"


def _brackets(text: str, at: list[int], t: list[str], original: list[str], sos: str, own: str) -> None:
    """Rule N0: both brackets of a pair take the direction of what they hold, or of what stands before."""
    strong = lambda kind: "R" if kind in ("R", "EN", "AN") else "L" if kind == "L" else None
    stack, pairs = [], []
    for i, place in enumerate(at):
        found = bracket(text[place]) if t[i] == "ON" else None
        if not found:
            continue
        if found[0] == "open":
            if len(stack) == 63:
                break
            stack.append((found[1], i))
        else:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == found[1]), None)
            if k is not None:
                pairs.append((stack[k][1], i))
                del stack[k:]
    for a, b in sorted(pairs):
        inside = {strong(kind) for kind in t[a + 1 : b]}
        if own in inside:
            new = own
        elif inside - {None}:
            before = next((strong(kind) for kind in reversed(t[:a]) if strong(kind)), sos)
            new = before if before != own else own
        else:
            continue
        for i in (a, b):
            t[i] = new
            k = i + 1
            while k < len(t) and original[at[k]] == "NSM":
                t[k] = new
                k += 1


def levels_of(text: str) -> tuple[list[int], int, list[str]]:
    """(level of each character, paragraph level, types) of one paragraph, before lines are broken."""
    kinds = [kind_of(c) for c in text]
    pairs = _match_isolates(kinds)
    base = _first_strong(kinds, pairs, 0, len(kinds)) or 0
    levels, types = _explicit(kinds, pairs, base)
    shown = [i for i, k in enumerate(kinds) if k not in REMOVED]
    place = {i: n for n, i in enumerate(shown)}
    for at in _sequences(kinds, levels, pairs):
        level = levels[at[0]]
        n = place[at[0]]
        before = levels[shown[n - 1]] if n else base
        open_end = kinds[at[-1]] in ISOLATES and at[-1] not in pairs
        n = place[at[-1]]
        after = levels[shown[n + 1]] if n + 1 < len(shown) and not open_end else base
        sos, eos = ("R" if max(level, x) % 2 else "L" for x in (before, after))
        own = "R" if level % 2 else "L"
        t = [types[i] for i in at]
        _weak(t, sos)
        _brackets(text, at, t, kinds, sos, own)
        i = 0
        while i < len(t):
            j = i
            while j < len(t) and t[j] in NEUTRAL:
                j += 1
            if j > i:
                a, b = ("L" if k == "L" else "R" for k in (t[i - 1] if i else sos, t[j] if j < len(t) else eos))
                t[i:j] = [a if a == b else own] * (j - i)
            i = max(j, i + 1)
        for i, kind in zip(at, t, strict=True):
            levels[i] += (kind == "R") if level % 2 == 0 and kind in ("L", "R") else 2 if level % 2 == 0 else (kind != "R")
    return levels, base, kinds


def visual_line(text: str) -> str:
    """One line in the order in which it is shown, from the left."""
    if not _RTL.search(text):
        return text
    levels, base, kinds = levels_of(text)
    trailing = True
    for i in range(len(text) - 1, -1, -1):
        if kinds[i] in ("B", "S"):
            levels[i], trailing = base, True
        elif kinds[i] == "WS" or kinds[i] in ISOLATES or kinds[i] == "PDI" or kinds[i] in REMOVED:
            levels[i] = base if trailing else levels[i]
        else:
            trailing = False
    order = [i for i, k in enumerate(kinds) if k not in REMOVED and k not in ISOLATES and k != "PDI" and text[i] not in "‎‏؜"]
    for level in range(max((levels[i] for i in order), default=0), 0, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return "".join(mirror(text[i]) if levels[i] % 2 else text[i] for i in order)


# ---- lines without controls, isolates and mirrored characters: one level but for numbers and the other direction, so the rules are patterns on types
#: A letter for each type; other types, and characters that are mirrored or left out, have "x".
LETTERS = {"L": "L", "R": "R", "AL": "A", "EN": "1", "AN": "2", "ES": "e", "ET": "t", "CS": "c", "NSM": "n", "WS": "w", "ON": "o"}


@lru_cache(2)
def _letters(n: int) -> np.ndarray:
    """The letter of each of the first n code points' types."""
    odd = set("\u200e\u200f\u061c")
    letter = lambda c: "\n" if c == "\n" else "x" if c in odd or mirror.__wrapped__(c) != c else LETTERS.get(kind_of(c), "x")
    return np.frombuffer("".join(map(letter, map(chr, range(n)))).encode("latin-1"), np.uint8)


_MARKS = re.compile("(^|[^n])(n+)")
_ARABIC = re.compile("A[^LRA]*")
_SEPARATORS = re.compile("(?<=1)[ec](?=1)|(?<=2)c(?=2)")
_TERMINATORS = re.compile("(?<=1)t+|t+(?=1)")
_LATIN = re.compile("L[^LR]*")
_NEUTRAL = str.maketrans("etcw", "oooo")
_RIGHT = re.compile("[R12](?:[R12o]*[R12])?")  # at level 1 and 2 of a line from the left
_NUMBERS = re.compile("[12]+")
_LEFT = re.compile("(?:[12]|L(?:[Lo]*L)?)+")  # at level 2 of a line from the right


def _mirrored_runs(text: str, runs) -> str:
    """A text from its end to its start, but for what `runs` match, which stay as they are."""
    out, end = [], len(text)
    for a, b in reversed([m.span() for m in runs]):
        out += text[b:end][::-1], text[a:b]
        end = a
    return "".join([*out, text[:end][::-1]])


def _plain_line(text: str, t: str) -> str:
    """`visual_line` of a line whose types `t` have no "x"."""
    strong = next((c for c in t if c in "LRA"), "L")
    own = "L" if strong == "L" else "R"
    if "n" in t:
        t = _MARKS.sub(lambda m: (m[1] or own) * (len(m[1]) + len(m[2])), t)
    if "A" in t:
        t = _ARABIC.sub(lambda m: m[0].replace("1", "2"), t).replace("A", "R")
    if "1" in t or "2" in t:
        if "1e1" in t or "1c1" in t or "2c2" in t:
            t = _SEPARATORS.sub(lambda m: m.string[m.start() - 1], t)
        if "1t" in t or "t1" in t:
            t = _TERMINATORS.sub(lambda m: "1" * len(m[0]), t)
        t = _LATIN.sub(lambda m: m[0].replace("1", "L"), t if own == "R" else f"L{t}")[own == "L" :]
    t = t.translate(_NEUTRAL)
    if own == "R":
        return _mirrored_runs(text, _LEFT.finditer(t))
    out, end = [], 0
    for m in _RIGHT.finditer(t):
        a, b = m.span()
        out += text[end:a], _mirrored_runs(text[a:b], _NUMBERS.finditer(m[0]))
        end = b
    return "".join([*out, text[end:]])


def visual_text(text: str) -> str:
    if not _RTL.search(text):
        return text
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    types = _letters(0x10000 if points.max() < 0x10000 else 0x110000)[points].tobytes().decode("latin-1").split("\n")
    return "\n".join([visual_line(line) if "x" in t else _plain_line(line, t) for line, t in zip(text.split("\n"), types, strict=True)])


def visual_order(text: Column) -> Column:
    """Texts in visual order, line by line; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else visual_text(x) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)
