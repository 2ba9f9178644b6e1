"""Tokens of a text with their places: entities first, words in what is left.

Urls, mails, phone numbers, dates and coordinates are tokens of their own. Where two of them
overlap the longer one stays, of equally long ones the first; words come from the text between.
"""

from __future__ import annotations

import re

#: What an entity looks like, in the order in which kinds are asked. Letter case
#: doesn't count. No pattern looks around itself, so SQL engines understand them too.
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
_REST = r'[^\s<>"{}|\\^`\[\]]*'
ENTITIES = {
    "url": r'\b(?:https?|ftp|ftps|file)://(?:[^\s<>"{}|\\`\[\]]+|\[[0-9a-fA-F:]+\])(?:/' + _REST + ")?",
    "email": r"[a-zA-Z0-9](?:[a-zA-Z0-9._%+-]*[a-zA-Z0-9])?@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?)+",
    "coordinates": r"""[-+]?\d{1,3}\.\d+[\s,]+[-+]?\d{1,3}\.\d+|\d{1,3}\.\d+°?[\s]?[NS][\s,]+\d{1,3}\.\d+°?[\s]?[EW]|\d{1,3}°\d{1,2}'[\d\.]+"?[NS][\s,]+\d{1,3}°\d{1,2}'[\d\.]+"?[EW]|\([-+]?\d{1,3}\.\d+[\s]*,[\s]*[-+]?\d{1,3}\.\d+\)""",
    "phone": r"\+\d{1,3}[\s\-\.]?\(?\d{1,4}\)?[\s\-\.]?\d{1,4}[\s\-\.]?\d{1,4}[\s\-\.]?\d{1,9}|\+?1[\s\-\.]?\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}|\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}|\b\d{1,3}[\s\-\.]?\d{2,4}[\s\-\.]?\d{2,4}[\s\-\.]?\d{2,4}\b|\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}[\s\-\.]*(?:x|ext|extension)[\s\-\.]*\d{1,6}",
    "date": r"\b(?:\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}|\d{2,4}[/\-\.]\d{1,2}[/\-\.]\d{1,2}|\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}|(?:" + _MONTHS + r")\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+(?:" + _MONTHS + r")\s+\d{4}|\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?|\d{4}/\d{2}/\d{2}(?:\s+\d{2}:\d{2}:\d{2})?)\b",
    "date_iso": r"\b\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\b",
    "url_no_protocol": r"\b(?:www\.)?" + _LABEL + r"(?:\." + _LABEL + r")+(?::\d+)?(?:/" + _REST + ")?",
    "domain": r"\b(?:" + _LABEL + r"\.)+[a-zA-Z]{2,}\b",
}
#: Fixed value: a word, besides letters, digits and underscores the Hebrew, Arabic, Cyrillic and Han blocks.
WORD = r"[\w֐-׿؀-ۿЀ-ӿ一-鿿'-]+"
#: The same for engines whose ``\\w`` has Latin letters only.
PLAIN_WORD = WORD.replace(r"\w", r"\p{L}\p{N}_")

_FIND = [(kind, re.compile(pattern, re.IGNORECASE)) for kind, pattern in ENTITIES.items()]
_WORD = re.compile(WORD)
#: No entity is without one of these characters, so most texts skip most patterns.
_NEEDS = {"url": "://", "email": "@", "url_no_protocol": ".", "domain": "."}
_DIGITS = re.compile(r"\d")
#: Control characters that are taken out before anything is looked for.
_CONTROLS = {c: None for c in range(32) if c not in (9, 10, 13)}

Token = tuple[int, str, str]


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities that stay, in order."""
    digits, spans = _DIGITS.search(text) is not None, []
    for rank, (kind, pattern) in enumerate(_FIND):
        if (_NEEDS[kind] in text) if kind in _NEEDS else digits:
            spans += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    for start, _, end, kind in sorted(spans):
        if kept and start < kept[-1][1]:
            if end - start > kept[-1][1] - kept[-1][0]:
                kept[-1] = start, end, kind
        else:
            kept.append((start, end, kind))
    return kept


def tokens(text: str | None) -> list[Token]:
    """(start, token, kind) of a text in order; ``start`` counts characters from 0 and leaves
    control characters out. Single characters that are no letter or digit are no words."""
    text = (text or "").translate(_CONTROLS)
    out: list[Token] = []

    def words(start: int, end: int) -> None:
        for m in _WORD.finditer(text, start, end):
            word = m.group()
            if len(word) > 1 or word.isalnum():
                out.append((m.start(), word.lower(), "word"))

    at = 0
    for start, end, kind in entities(text):
        if at < start:
            words(at, start)
        out.append((start, text[start:end].lower(), kind))
        at = end
    words(at, len(text))
    return out
