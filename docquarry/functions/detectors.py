"""Signals in text: dates in several notations and calendars, places, contacts.

Overlapping finds are resolved by length, then kind, then position. A notation that allows
several readings keeps them all; a date that doesn't exist is never made up.
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from docquarry.functions.dates import hijri_to_gregorian, jalali_to_gregorian

#: Month names by language, January first.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
_MONTH = {name: i + 1 for names in MONTHS.values() for i, name in enumerate(names.split())}
_NAMES = "|".join(sorted(_MONTH, key=len, reverse=True))
_DAYS = {"day": 1, "week": 7}
_PATTERNS = [
    ("iso", re.compile(r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)")),
    ("named", re.compile(rf"(?<!\w)(\d{{1,2}})\.?\s+(?:de\s+)?({_NAMES})\s+(?:de\s+)?(\d{{4}})(?!\d)", re.I)),
    ("named_first", re.compile(rf"(?<!\w)({_NAMES})\s+(\d{{1,2}}),?\s+(\d{{4}})(?!\d)", re.I)),
    ("numeric", re.compile(r"(?<!\d)(\d{1,2})([./])(\d{1,2})\2(\d{4})(?!\d)")),
    ("eastern", re.compile(r"(?<!\d)(1[34]\d{2})/(\d{1,2})/(\d{1,2})(?!\d)")),
    ("relative", re.compile(r"(?<!\w)(?:within|in)\s+(\d{1,3})\s+(day|week|month|year)s?(?!\w)", re.I)),
]
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]?(?=\s|$)|[^\n]")


@dataclass(frozen=True)
class Signal:
    """A span with its reading: an exact day, or none where there is no reference."""

    start: int
    end: int
    surface: str
    kind: str
    calendar: str
    day: date | None
    readings: int


def later(anchor: date, amount: int, unit: str) -> date | None:
    """So many calendar units after a day: the same day of a later month or year, or that
    month's last one where it is shorter. None beyond the calendar."""
    try:
        if unit in _DAYS:
            return anchor + timedelta(days=amount * _DAYS[unit])
        years, month = divmod(anchor.month - 1 + amount * (12 if unit == "year" else 1), 12)
        year = anchor.year + years
        return date(year, month + 1, min(anchor.day, monthrange(year, month + 1)[1]))
    except (ValueError, OverflowError):
        return None


def _valid(make, *parts: int) -> date | None:
    try:
        return make(*parts)
    except (ValueError, OverflowError):
        return None


def _read(kind: str, m: re.Match, anchor: date | None) -> list[tuple[str, date | None]]:
    """All readings of a match that name a real day."""
    if kind == "iso":
        found = [("gregorian", _valid(date, int(m[1]), int(m[2]), int(m[3])))]
    elif kind == "named":
        found = [("gregorian", _valid(date, int(m[3]), _MONTH[m[2].lower()], int(m[1])))]
    elif kind == "named_first":
        found = [("gregorian", _valid(date, int(m[3]), _MONTH[m[1].lower()], int(m[2])))]
    elif kind == "numeric":
        one, two, year = int(m[1]), int(m[3]), int(m[4])
        found = [("gregorian", _valid(date, year, two, one))]
        if m[2] == "/" and one != two:
            found.append(("gregorian", _valid(date, year, one, two)))
    elif kind == "eastern":
        parts = int(m[1]), int(m[2]), int(m[3])
        found = [("jalali", _valid(jalali_to_gregorian, *parts))]
        if 1 <= parts[1] <= 12 and 1 <= parts[2] <= 30:
            found.append(("hijri", _valid(hijri_to_gregorian, *parts)))
    else:
        return [("relative", later(anchor, int(m[1]), m[2].lower()) if anchor else None)]
    return [(c, d) for c, d in found if d]


def temporal_signals(text: str, anchor: date | None = None) -> list[Signal]:
    """The dates that a text names. Relative ones need the anchor, else stay unresolved."""
    finds = []
    for order, (kind, pattern) in enumerate(_PATTERNS):
        for m in pattern.finditer(text):
            if readings := _read(kind, m, anchor):
                finds.append((m.start() - m.end(), order, m.start(), m, kind, readings))
    taken: list[tuple[int, int]] = []
    out = []
    for _, _, start, m, kind, readings in sorted(finds, key=lambda f: f[:3]):
        if all(m.end() <= a or start >= b for a, b in taken):
            taken.append((start, m.end()))
            out += [Signal(start, m.end(), m[0], kind, c, d, len(readings)) for c, d in readings]
    return sorted(out, key=lambda s: (s.start, s.calendar, s.day or date.min))


def name_runs(text: str, longest: int) -> Iterator[tuple[int, int, int, int, str, str]]:
    """Runs of up to ``longest`` capitalised words: index of the first, number, start, end,
    surface and key (lower case, without a closing possessive)."""
    words = list(re.finditer(r"\w+(?:['’]s)?", text))
    for i in range(len(words)):
        for k in range(1, min(longest, len(words) - i) + 1):
            if words[i + k - 1][0][0].islower():
                break
            run = words[i : i + k]
            key = re.sub(r"['’]s$", "", " ".join(w[0].lower() for w in run))
            yield i, k, run[0].start(), run[-1].end(), text[run[0].start() : run[-1].end()], key


class PlaceFinder:
    """Places of a gazetteer in text: the longest run of words that is a name, capitalised,
    with or without a possessive. A name of several places keeps them all."""

    def __init__(self, names: Iterable[tuple[str, int]]):
        self.places: dict[str, list[int]] = {}
        for name, place in names:
            self.places.setdefault(" ".join(name.lower().split()), []).append(place)
        self.longest = max((k.count(" ") + 1 for k in self.places), default=0)

    def find(self, text: str) -> Iterator[tuple[int, int, str, list[int]]]:
        """start, end, surface and place ids of each mention."""
        words = list(re.finditer(r"\w+(?:['’]s)?", text))
        i = 0
        while i < len(words):
            for k in range(min(self.longest, len(words) - i), 0, -1):
                run = words[i : i + k]
                if any(w[0][0].islower() for w in run):
                    continue
                key = re.sub(r"['’]s$", "", " ".join(w[0].lower() for w in run))
                if key in self.places:
                    yield run[0].start(), run[-1].end(), text[run[0].start() : run[-1].end()], sorted(self.places[key])
                    i += k - 1
                    break
            i += 1


def sentence_at(text: str, place: int) -> str:
    """The sentence that holds a position."""
    for m in _SENTENCE.finditer(text):
        if m.start() <= place < m.end():
            return m[0].strip()
    return ""
