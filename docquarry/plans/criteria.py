"""Criteria: one declarative, canonical filter that is compiled to columns in one place.

A criteria value is immutable, has a canonical JSON form and a fingerprint. Parsing is
strict: unknown keys, wrong ids and malformed expressions are errors. ``compile_paths``
returns the matched occurrences; access scope is part of the plan from the start.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXT, MAX_PHRASES, MAX_IDS = 2000, 50, 1000
SCOPES = ("all", "uncategorized", "categorized")
LOGICS = ("AND", "OR", "NOT")
STATUSES = ("Read", "Unread")


class CriteriaError(ValueError):
    """The criteria can't be parsed."""


@dataclass(frozen=True)
class Criteria:
    """What is searched for. None leaves a dimension open; an empty tuple matches nothing."""

    text: str = ""
    phrases: tuple[str, ...] = ()
    case_sensitive: bool = False
    whole_word: bool = False
    keywords: tuple[int, ...] = ()
    keyword_logic: str = "OR"
    categories: tuple[str, ...] = ()
    analyst_scope: str = "all"
    sources: tuple[str, ...] | None = None
    sides: tuple[str, ...] | None = None
    file_types: tuple[str, ...] | None = None
    file_statuses: tuple[str, ...] | None = None
    date_from: str | None = None
    date_to: str | None = None
    unit: str = "path"

    def __post_init__(self):
        if len(self.text) > MAX_TEXT or len(self.phrases) > MAX_PHRASES:
            raise CriteriaError("text or phrases too long")
        if self.keyword_logic not in LOGICS or self.analyst_scope not in SCOPES or self.unit not in ("hash", "path"):
            raise CriteriaError("unknown logic, scope or unit")
        if any(x not in STATUSES for x in self.file_statuses or ()):
            raise CriteriaError(f"a status is one of {STATUSES}")
        if any(k <= 0 for k in self.keywords) or len(self.keywords) > MAX_IDS:
            raise CriteriaError("keyword ids are positive and at most 1000")
        object.__setattr__(self, "keywords", tuple(sorted(set(self.keywords))))
        if self.text.strip():
            parse_expression(self.text)

    @classmethod
    def from_dict(cls, raw: dict) -> Criteria:
        unknown = set(raw) - {f.name for f in fields(cls)}
        if unknown:
            raise CriteriaError(f"unknown keys: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    def canonical(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    def fingerprint(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()

    def explain(self) -> list[str]:
        """The conditions in force, in a fixed order."""
        said = []
        for f in fields(self):
            value = getattr(self, f.name)
            if value != f.default:
                said.append(f"{f.name} = {value!r}")
        return said


_LEX = re.compile(r'\s*(?:"([^"]*)"|(\()|(\))|([^\s()"]+))')


def parse_expression(text: str) -> tuple:
    """("term", s), ("and", a, b), ("or", a, b) or ("not", a).

    Quotes keep a phrase; AND binds before OR; terms side by side mean AND; NOT stands
    before one operand, and ``a NOT b`` is a AND NOT b.
    """
    tokens: list[tuple[str, str]] = []
    at = 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise CriteriaError("unbalanced quote")
        at = m.end()
        if m[1] is not None:
            if not m[1].strip():
                raise CriteriaError("empty quotes")
            tokens.append(("term", m[1]))
        elif m[2] or m[3]:
            tokens.append((m[2] or m[3], ""))
        else:
            word = m[4]
            tokens.append((word, "") if word in ("AND", "OR", "NOT") else ("term", word))
    place = 0

    def peek() -> str:
        return tokens[place][0] if place < len(tokens) else ""

    def unary() -> tuple:
        nonlocal place
        kind = peek()
        if kind == "NOT":
            place += 1
            return ("not", unary())
        if kind == "(":
            place += 1
            inner = either()
            if peek() != ")":
                raise CriteriaError("unbalanced parenthesis")
            place += 1
            return inner
        if kind != "term":
            raise CriteriaError(f"expected a term, found {kind or 'the end'}")
        place += 1
        return ("term", tokens[place - 1][1])

    def both() -> tuple:
        nonlocal place
        left = unary()
        while peek() in ("AND", "NOT", "term", "("):
            if peek() == "AND":
                place += 1
            left = ("and", left, unary())
        return left

    def either() -> tuple:
        nonlocal place
        left = both()
        while peek() == "OR":
            place += 1
            left = ("or", left, both())
        return left

    tree = either()
    if place < len(tokens):
        raise CriteriaError("unbalanced parenthesis")
    return tree


def literal(column: Column, value: str, case_sensitive: bool = False) -> Column:
    """Plain containment: no character of ``value`` is special."""
    return column.contains(value) if case_sensitive else F.lower(column).contains(value.lower())


def whole_word(column: Column, phrase: str, case_sensitive: bool = False) -> Column:
    """The phrase between word borders, any white space for its own; empty never matches."""
    parts = phrase.split()
    if not parts:
        return F.lit(False)
    quoted = r"\s+".join(rf"\Q{p}\E" for p in parts)
    flag = "" if case_sensitive else "(?iu)"
    return column.rlike(rf"{flag}(^|[^\p{{L}}\p{{N}}_]){quoted}([^\p{{L}}\p{{N}}_]|$)")


def terms_of(tree: tuple) -> list[str]:
    """The distinct terms of an expression, in order."""
    found = [tree[1]] if tree[0] == "term" else [t for x in tree[1:] for t in terms_of(x)]
    return list(dict.fromkeys(found))


def compile_expression(tree: tuple, test: Callable[[str], Column]) -> Column:
    """The predicate of an expression, given that of a term."""
    kind = tree[0]
    if kind == "term":
        return test(tree[1])
    if kind == "not":
        return ~compile_expression(tree[1], test)
    left, right = (compile_expression(x, test) for x in tree[1:])
    return left & right if kind == "and" else left | right


def among(column: str, values: tuple | None) -> Column:
    """Membership; None leaves it open and nothing is in an empty list."""
    if values is None:
        return F.lit(True)
    return F.col(column).isin(*values) if values else F.lit(False)


def compile_paths(
    criteria: Criteria, paths: DataFrame, texts: DataFrame, keyword_hits: DataFrame | None = None,
    category_hits: DataFrame | None = None, assigned: DataFrame | None = None, allowed_sources: tuple[str, ...] | None = None,
) -> DataFrame:
    """The occurrences that match.

    ``paths``: occurrences; ``texts``: (hash_id, text), of which only flags are joined, made
    where the text is read; ``keyword_hits``: (hash_id, keyword_id); ``category_hits``: (hash_id, category); ``assigned``: (path_id) filed by
    analysts. ``allowed_sources`` is the reader's access: None for all, empty for nothing.
    """
    out = paths.where(among("source", allowed_sources))
    for column, values in (("source", criteria.sources), ("side", criteria.sides), ("file_type", criteria.file_types), ("file_status", criteria.file_statuses)):
        out = out.where(among(column, values))
    if criteria.date_from:
        out = out.where(F.col("file_date") >= F.lit(criteria.date_from).cast("date"))
    if criteria.date_to:
        out = out.where(F.col("file_date") <= F.lit(criteria.date_to).cast("date"))
    if criteria.text.strip() or criteria.phrases:
        tree = parse_expression(criteria.text) if criteria.text.strip() else None
        terms, test = terms_of(tree) if tree else [], whole_word if criteria.whole_word else literal
        said = lambda column, term: F.coalesce(test(column, term, criteria.case_sensitive), F.lit(False))
        phrases = reduce(lambda a, p: a & F.coalesce(whole_word(F.col("text"), p, criteria.case_sensitive), F.lit(False)), criteria.phrases, F.lit(True))
        flags = texts.select("hash_id", *(said(F.col("text"), t).alias(f"_term{i}") for i, t in enumerate(terms)), phrases.alias("_phrases"))
        names = [F.col("file_name"), F.col("file_type"), F.col("source"), F.col("side")]
        anywhere = lambda t: reduce(lambda a, f: a | said(f, t), names, F.col(f"_term{terms.index(t)}"))
        content = F.col("_phrases") & compile_expression(tree, anywhere) if tree else F.col("_phrases")
        out = out.join(flags, "hash_id").where(content).select(*out.columns)
    if criteria.keywords:
        wanted = keyword_hits.where(F.col("keyword_id").isin(*criteria.keywords))
        if criteria.keyword_logic == "AND":
            wanted = wanted.groupBy("hash_id").agg(F.countDistinct("keyword_id").alias("k")).where(F.col("k") == len(criteria.keywords))
        out = out.join(wanted.select("hash_id"), "hash_id", "left_anti" if criteria.keyword_logic == "NOT" else "left_semi")
    if criteria.categories:
        out = out.join(category_hits.where(F.col("category").isin(*criteria.categories)).select("hash_id"), "hash_id", "left_semi")
    if criteria.analyst_scope != "all":
        out = out.join(assigned.select("path_id"), "path_id", "left_semi" if criteria.analyst_scope == "categorized" else "left_anti")
    return out


def count(matched: DataFrame, unit: str) -> DataFrame:
    """One row: how many contents or paths matched."""
    return matched.agg(F.countDistinct("hash_id" if unit == "hash" else "path_id").alias("matched"))


def page(matched: DataFrame, unit: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of ids: newest first with the id last, or contents by id."""
    if not 1 <= limit <= 10_000 or offset < 0:
        raise CriteriaError("limit is 1 to 10000")
    if unit == "hash":
        return matched.select("hash_id").distinct().orderBy("hash_id").offset(offset).limit(limit)
    return matched.orderBy(F.col("file_date").desc_nulls_last(), "path_id").select("path_id", "file_date").offset(offset).limit(limit)
