"""English stems by the published Snowball rules (Porter 2), as columns and as SQL.

A step is a list of suffixes, the longest first: the first that a word ends in decides,
whether its condition holds or not. Conditions are patterns of what stands before the suffix.
``STEPS`` is the one statement of the rules; ``with_stem`` turns it into columns, ``stem_sql``
into the same expressions for another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vowels and others; Y is a y that stands for a consonant.
_V, _C = "[aeiouy]", "[^aeiouy]"
#: Conditions on what stands before a suffix: the suffix lies in R1 or R2, the regions behind
#: the first and the second consonant that follows a vowel. Any other condition is a pattern.
R1, R2 = "R1", "R2"
_SHORT = f"(?:^{_V}{_C}|{_C}{_V}[^aeiouywxY])$"
_ANY = ""

Rule = tuple[str, str, str]

#: Fixed values: (suffix, what must stand before it, replacement), by step.
STEPS: dict[str, list[Rule]] = {
    "s0": [("'s'", _ANY, ""), ("'s", _ANY, ""), ("'", _ANY, "")],
    "s1a": [
        ("sses", _ANY, "ss"), ("ied", "..$", "i"), ("ies", "..$", "i"), ("ied", _ANY, "ie"), ("ies", _ANY, "ie"), ("us", _ANY, "us"), ("ss", _ANY, "ss"),
        ("s", f"{_V}.+$", ""),
    ],
    "s1b": [
        ("eedly", R1, "ee"), ("ingly", _V, "+"), ("edly", _V, "+"), ("eed", R1, "ee"), ("ing", _V, "+"), ("ed", _V, "+"),
    ],
    "s1c": [("y", f".{_C}$", "i"), ("Y", f".{_C}$", "i")],
    "s2": [
        ("ational", R1, "ate"), ("fulness", R1, "ful"), ("iveness", R1, "ive"), ("ization", R1, "ize"), ("ousness", R1, "ous"), ("biliti", R1, "ble"), ("lessli", R1, "less"), ("tional", R1, "tion"),
        ("alism", R1, "al"), ("aliti", R1, "al"), ("ation", R1, "ate"), ("entli", R1, "ent"), ("fulli", R1, "ful"), ("iviti", R1, "ive"), ("ousli", R1, "ous"),
        ("abli", R1, "able"), ("alli", R1, "al"), ("anci", R1, "ance"), ("ator", R1, "ate"), ("enci", R1, "ence"), ("izer", R1, "ize"), ("bli", R1, "ble"), ("ogi", "R1 l$", "og"), ("li", "R1 [cdeghkmnrt]$", ""),
    ],
    "s3": [
        ("ational", R1, "ate"), ("tional", R1, "tion"), ("alize", R1, "al"), ("ative", R2, ""), ("icate", R1, "ic"), ("iciti", R1, "ic"), ("ical", R1, "ic"), ("ness", R1, ""), ("ful", R1, ""),
    ],
    "s4": [
        ("ement", R2, ""), ("able", R2, ""), ("ance", R2, ""), ("ence", R2, ""), ("ible", R2, ""), ("ment", R2, ""), ("ant", R2, ""), ("ate", R2, ""), ("ent", R2, ""), ("ion", "R2 [st]$", ""),
        ("ism", R2, ""), ("iti", R2, ""), ("ive", R2, ""), ("ize", R2, ""), ("ous", R2, ""), ("al", R2, ""), ("er", R2, ""), ("ic", R2, ""),
    ],
}
#: Words with a stem of their own, and those that stay as step 1a leaves them.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: English words that a full-text index leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Fixed value: beginnings behind which R1 starts, whatever the rule.
_BEGINNINGS = "^(?:gener|commun|arsen)"
_DOUBLE, _LETTERS = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", "^[a-z']+$"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: How an engine asks whether a text matches a pattern somewhere.
Match = Callable[[str, str], str]


def _in_spark(text: str, pattern: str) -> str:
    return f"({text} RLIKE {_quoted(pattern)})"


def _in_duckdb(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_quoted(pattern)})"


def _holds(stem: str, condition: str, match: Match) -> str:
    """Whether what stands before a suffix of ``w`` meets a condition."""
    region, _, pattern = condition.partition(" ") if condition[:2] in (R1, R2) else ("", "", condition)
    found = [match(stem, pattern)] if pattern else []
    if region:
        more = f"{_C}*{_V}+{_C}" if region == R2 else ""
        found.append(f"CASE WHEN {match('w', _BEGINNINGS)} THEN {match(stem, _BEGINNINGS + more)} ELSE {match(stem, f'^{_C}*{_V}+{_C}{more}')} END")
    return " AND ".join(found) or "true"


def _step(rules: list[Rule], match: Match) -> str:
    """One step over ``w``; every suffix is asked once, its conditions in turn."""
    out = []
    for suffix in dict.fromkeys(suffix for suffix, _, _ in rules):
        stem = f"left(w, length(w) - {len(suffix)})"
        tries = [(_holds(stem, condition, match), repl) for own, condition, repl in rules if own == suffix]
        cases = " ".join(f"WHEN {cond} THEN concat({stem}, {_quoted(repl)})" for cond, repl in tries)
        out.append(f"WHEN right(w, {len(suffix)}) = {_quoted(suffix)} THEN CASE {cases} ELSE w END")
    return f"CASE {' '.join(out)} ELSE w END"


def _steps(match: Match, consonant_y: str) -> list[str]:
    """Expressions to be taken one after the other: the first and the last over ``token``, all but
    the first over ``w``, what the one before made. A word that is kept starts with ``=``, one
    whose ending went in step 1b ends in ``+``."""
    cut = "left(w, length(w) - 1)"
    after = (
        f"CASE WHEN right(w, 1) <> '+' THEN w WHEN {match(cut, '(?:at|bl|iz)$')} THEN concat({cut}, 'e') WHEN {match(cut, _DOUBLE)} THEN left(w, length(w) - 2) "
        f"WHEN {match(cut, _SHORT)} AND NOT {_holds('left(w, length(w) - 2)', R1, match)} THEN concat({cut}, 'e') ELSE {cut} END"
    )
    last = (
        f"CASE WHEN right(w, 1) = 'e' THEN CASE WHEN {_holds(cut, R2, match)} OR ({_holds(cut, R1, match)} AND NOT {match(cut, _SHORT)}) THEN {cut} ELSE w END "
        f"WHEN right(w, 2) = 'll' AND {_holds(cut, R2, match)} THEN {cut} ELSE w END"
    )
    kept = ", ".join(map(_quoted, KEPT))
    whole = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in WHOLE.items())
    late = [after, *(_step(STEPS[s], match) for s in ("s1c", "s2", "s3", "s4")), last]
    return [
        "CASE WHEN left(token, 1) = '''' THEN right(token, length(token) - 1) ELSE token END", consonant_y, _step(STEPS["s0"], match), _step(STEPS["s1a"], match),
        f"CASE WHEN w IN ({kept}) THEN concat('=', w) ELSE {_step(STEPS['s1b'], match)} END",
        *(f"CASE WHEN left(w, 1) = '=' THEN w ELSE {x} END" for x in late),
        f"CASE WHEN length(token) < 3 OR NOT {match('token', _LETTERS)} THEN token ELSE CASE token {whole} ELSE replace(lower(w), '=', '') END END",
    ]


def with_stem(words: DataFrame) -> DataFrame:
    """``words`` (token, ...) with ``stem``; a word with other letters than a to z is its own stem.

    Give it distinct words: the steps are some hundred comparisons each.
    """
    *steps, stem = _steps(_in_spark, "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '$1Y')")
    for step in steps:
        words = words.withColumn("w", F.expr(step))
    return words.withColumn("stem", F.expr(stem)).drop("w")


def stem_sql(source: str, name: str) -> str:
    """CTEs that end in ``name``: the columns of the CTE ``source`` (with token) and ``stem``."""
    first, *steps, stem = _steps(_in_duckdb, "regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g')")
    out = [f"{name}_0 AS MATERIALIZED (SELECT *, {first} AS w FROM {source})"]
    out += [f"{name}_{i} AS MATERIALIZED (SELECT * REPLACE ({step} AS w) FROM {name}_{i - 1})" for i, step in enumerate(steps, 1)]
    return ",\n".join([*out, f"{name} AS MATERIALIZED (SELECT * EXCLUDE (w), {stem} AS stem FROM {name}_{len(steps)})"])


def is_stop_word(word: Column) -> Column:
    """Whether an index leaves the word out."""
    return word.isin(STOP_WORDS)
