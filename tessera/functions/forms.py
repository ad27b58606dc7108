"""What characters count as: compatibility forms, one kind of dash, nothing for format characters.

The tables come from the Unicode data of Python's standard library. Most texts of any script hold
no character that counts as another; of the rest most hold only such as count as one other, which
one pass of translate puts in their places.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that count as '-'.
DASHES = "‐‑‒–—―−﹘﹣－"
HYPHENS = str.maketrans(dict.fromkeys(DASHES, "-"))
# Where characters lie that may change (the rest are unified ideographs, Hangul syllables and private ones).
PLANES = ((0x80, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
#: Runs of characters of no interest that are at least this long are passed over at once.
RUN = 32
ASCII = r"[\x00-\x7F]"


def counts_as(ch: str) -> str:
    """What one character counts as."""
    if unicodedata.is_normalized("NFKC", ch) and ch not in DASHES and unicodedata.category(ch) != "Cf":
        return ch
    return "".join(c for c in unicodedata.normalize("NFKC", ch).translate(HYPHENS) if unicodedata.category(c) != "Cf")


@cache
def changed() -> dict[str, str]:
    """The characters that count as something else, in order."""
    found = ((ch, counts_as(ch)) for a, b in PLANES for ch in map(chr, range(a, b)))
    return {ch: seen for ch, seen in found if seen != ch}


@cache
def meeting() -> frozenset[str]:
    """Characters that may join with what precedes them, or change places with it, when a text is normalised."""
    pairs = (unicodedata.decomposition(chr(i)).split() for a, b in PLANES for i in range(a, b))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    second |= set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # vowels and finals of syllables
    every = (chr(i) for a, b in PLANES for i in range(a, b))
    return frozenset(ch for ch in every if (first := unicodedata.normalize("NFKD", ch)[0]) in second or unicodedata.combining(first))


def char_class(codes) -> str:
    """A pattern of any of these code points, which ascend."""
    runs = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


@cache
def calm() -> str:
    """A pattern of one character of the long runs in which none changes or meets another."""
    stops, runs = sorted({ord(ch) for ch in changed()} | {ord(ch) for ch in meeting()}), []
    for a, b in zip([-1, *stops], [*stops, 0x110000]):
        if b - a > RUN:
            runs.append((a + 1, b - 1))
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs) + "]"


@cache
def single() -> tuple[str, str]:
    """Characters that count as one other, and those."""
    pairs = [(ch, seen) for ch, seen in changed().items() if len(seen) == 1]
    return "".join(ch for ch, _ in pairs), "".join(seen for _, seen in pairs)


@cache
def unequal() -> str:
    """A pattern of the characters that count as several or none."""
    return char_class([ord(ch) for ch, seen in changed().items() if len(seen) != 1])


def odd_characters(text: Column) -> Column:
    """The characters of a text outside the calm runs: few as a rule, so that long patterns are tried on these alone.

    ASCII, which is calm, goes first: the pattern of the calm runs is slow for each character.
    """
    return F.regexp_replace(F.regexp_replace(text, ASCII + "+", ""), calm() + "+", "")


def has_odd(text: Column) -> Column:
    """Whether odd_characters(text) has any; stops at the first."""
    return text.rlike("[^" + ASCII[1:]) & text.rlike("[^" + calm()[1:])


def has_single(odd: Column) -> Column:
    """Whether any counts as one other (odd: odd_characters)."""
    return (odd != "") & (F.translate(odd, single()[0], "") != odd)


def has_unequal(odd: Column) -> Column:
    """Whether any counts as several or none."""
    return (odd != "") & odd.rlike(unequal())


def has_meeting(odd: Column) -> Column:
    return (odd != "") & odd.rlike(char_class(sorted(map(ord, meeting()))))


def same_length_view(text: Column) -> Column:
    """text with each character that counts as one other replaced; the others stay, so places are the same."""
    return F.translate(text, *single())


def view(text: Column) -> Column:
    """text as all of its characters count."""
    gone = "".join(ch for ch, seen in changed().items() if not seen)
    first, second = single()
    left = F.translate(text, first + gone, second)
    several = {ch: seen for ch, seen in changed().items() if len(seen) > 1}
    expands = char_class(list(map(ord, several)))
    table = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    # Runs that stay, and single characters that are looked up.
    parts = F.regexp_extract_all(left, F.lit(rf"(?s){calm()}+|."), F.lit(0))
    written_out = F.array_join(F.transform(parts, lambda p: F.when((F.length(p) == 1) & p.rlike(expands), F.try_element_at(table, p)).otherwise(p)), "")
    return F.when(odd_characters(left).rlike(expands), written_out).otherwise(left)
