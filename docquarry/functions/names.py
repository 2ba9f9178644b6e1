"""Names folded for matching, their script, and the forms under which a name stands in text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations

#: Letters and marks that count as another one.
_SAME = {
    "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ک": "ك", "ة": "ه", "ۀ": "ه", "ہ": "ه",
    "׳": "'", "’": "'", "‘": "'", "ʼ": "'", "´": "'", "״": '"', "“": '"', "”": '"',
    "־": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
}
#: Marks that count as nothing: vowel signs and tatweel, points, joiners, directions.
_NOTHING = [
    *range(0x064B, 0x0660), 0x0670, 0x0640, *(c for c in range(0x0591, 0x05C8) if c not in (0x05BE, 0x05C3)), 0x200C, 0x200D,
    0x200E, 0x200F, 0x061C, *range(0x2066, 0x206A), *range(0x202A, 0x202F), 0xFEFF,
]
_FOLD = {**{ord(k): v for k, v in _SAME.items()}, **dict.fromkeys(_NOTHING)}
_SPACES = re.compile(r"\s+")
#: Letters and digits, with an apostrophe inside where a letter follows, or behind a Hebrew letter.
_TOKEN = re.compile(r"[^\W_]+(?:'(?=[^\W\d_])[^\W_]+)*(?:(?<=[א-ת])')?")
_BLOCKS = {"Hebr": ((0x0590, 0x05FF), (0xFB1D, 0xFB4F)), "Arab": ((0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)), "Latn": ((0x00, 0x7F), (0xC0, 0x024F), (0x1E00, 0x1EFF))}

#: Letters that stand before a Hebrew name; conjunctions and prepositions before an
#: Arabic one; Croatian palatals and the sounds they turn into.
_HEBREW, _CONJUNCTIONS, _PREPOSITIONS = "ובכלמשה", ("", "و", "ف"), ("ب", "ك", "ل")
_PALATAL, _SIBILANT = ("č", "ć", "ž", "š", "đ", "j", "c", "lj", "nj", "dž"), {"k": "c", "g": "z", "h": "s"}
#: Methods by precedence where several begin at one place.
METHODS = ("exact", "latin.uppercase", "en.possessive", "hr.inflection", "he.prefix", "ar.proclitic")


def fold(text: str | None) -> str:
    """Compatibility forms composed, letter variants as one, marks left out, white space as one
    space. Latin letters keep case and accents."""
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", (text or "").translate(_FOLD)).translate(_FOLD))


def match_key(name: str | None) -> str:
    """The form in which a name is compared."""
    return fold(name).strip()


def script_of(name: str) -> str | None:
    """Latn, Arab or Hebr where all letters are of it, else None."""
    found = {next((s for s, parts in _BLOCKS.items() if any(a <= ord(c) <= b for a, b in parts)), None) for c in name if c.isalpha()}
    return found.pop() if len(found) == 1 else None


def name_tokens(text: str | None) -> list[tuple[int, str, bool]]:
    """(start, token, joined) of a text as folded; ``joined``: only spaces and hyphens stand
    between it and the token before."""
    own, out, end = fold(text), [], 0
    for m in _TOKEN.finditer(own):
        gap = own[end : m.start()]
        out.append((m.start(), m.group(), bool(out) and bool(gap) and not gap.strip(" -")))
        end = m.end()
    return out


def _croatian(lemma: str) -> Iterator[str]:
    if len(lemma) < 3 or not lemma.isalpha():
        return
    last, stem = lemma[-1], lemma[:-1]
    soft = lambda word: "em" if word.lower().endswith(_PALATAL) else "om"
    if last == "a":
        yield from (stem + "e", stem[:-1] + _SIBILANT.get(stem[-1], stem[-1]) + "i", stem + "u", stem + "om")
    elif last in "oe":
        yield from (stem + "a", stem + "u", stem + soft(stem))
    elif last not in "aeiouAEIOU" and last.lower() not in "yw":
        yield from (lemma + "a", lemma + "u", lemma + soft(lemma))


def _hebrew_prefixes() -> list[str]:
    made = {"".join(p) for n in (1, 2, 3) for p in permutations(_HEBREW, n)}
    return sorted((p for p in made if "ו" not in p[1:] and "ה" not in p[:-1]), key=lambda p: (len(p), p))


_PREFIXES = _hebrew_prefixes()


def forms(name: str, language: str) -> Iterator[tuple[int, str, list[str]]]:
    """(rank, method, tokens) of every form of a name; of those that begin at one place only the
    least rank counts."""
    own = [t for _, t, _ in name_tokens(name)]
    if not own:
        return
    yield 0, METHODS[0], own
    script = script_of(name)
    upper = [t.upper() for t in own]
    if script == "Latn" and upper != own and len(upper[0]) > 1:
        yield 1, METHODS[1], upper
    if language == "en" and len(own) == 1 and len(own[0]) > 1:
        yield 2, METHODS[2], [own[0] + "'s"]
    if language == "hr" and len(own) == 1:
        yield from ((3, METHODS[3], [f]) for f in dict.fromkeys(_croatian(own[0])))
    if language == "he" and len(own[0]) > 1:
        yield from ((4 + i, METHODS[4], [p + own[0], *own[1:]]) for i, p in enumerate(_PREFIXES))
    if language == "ar":
        for i, conjunction in enumerate(_CONJUNCTIONS):
            base = 1000 + 10 * i
            if own[0].startswith("ال") and len(own[0]) > 3:
                yield base, METHODS[5], [conjunction + "لل" + own[0][2:], *own[1:]]
            if len(own[0]) > 1:
                yield from ((base + 1 + k, METHODS[5], [conjunction + p + own[0], *own[1:]]) for k, p in enumerate(_PREPOSITIONS))
                if conjunction:
                    yield base + 9, METHODS[5], [conjunction + own[0], *own[1:]]
