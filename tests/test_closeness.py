"""Close matches against the ratio of every word."""

import difflib

from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.operators import closeness

WORDS = sorted({a + b + c for a in ("li", "le", "re", "") for b in ("cen", "cens", "ss", "e") for c in ("ce", "se", "sed", "e", "ing", "")} | {"aaaa", "a", "éclair", "eclair", "licence", "ecnecil", "x" * 40})


def ratio(word, wanted):
    return difflib.SequenceMatcher(None, word, wanted).ratio()


@settings(max_examples=300)
@given(st.text("abc", min_size=1, max_size=8), st.text("abc", min_size=1, max_size=12), st.sampled_from([0.5, 0.6, 0.75, 0.9]))
def test_bounds_never_lose_a_match(wanted, word, cutoff):
    """What the index asks for holds for every pair within the cutoff."""
    if ratio(word, wanted) < cutoff:
        return
    low, high = closeness.lengths(len(wanted), cutoff)
    assert low <= len(word) <= high
    shared = set(closeness.grams_of(wanted)) & set(closeness.grams_of(word))
    assert 2 * len(shared) >= cutoff * (len(word) + len(wanted)) - 1e-9
    least = max(1, -(-round(cutoff * (len(wanted) + low) / 2, 9) // 1))
    assert len(shared) >= least


def test_all_words_within_the_cutoff(spark):
    index = closeness.char_index(spark.createDataFrame([(w,) for w in WORDS if w], "word string")).cache()
    for wanted, cutoff in (("licence", 0.6), ("e", 0.6), ("aab", 0.5), ("éclairs", 0.8), ("zzz", 0.6), ("resse", 0.75)):
        got = {r.word: r.ratio for r in closeness.close_matches(index, wanted, cutoff).collect()}
        assert got == {w: ratio(w, wanted) for w in WORDS if w and ratio(w, wanted) >= cutoff}
    assert closeness.close_matches(index, "").count() == 0


def test_completions_are_filled(spark):
    counted = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS) if w], "word string, n long")
    index = closeness.char_index(counted.select("word"))
    got = [(r.suggestion, r.kind) for r in closeness.complete(counted, index, "licens", 8).collect()]
    own = sorted((-n, w) for w, n in ((w, i) for i, w in enumerate(WORDS)) if w.startswith("licens"))
    close = sorted((-ratio(w, "licens"), w) for w in WORDS if w and not w.startswith("licens") and ratio(w, "licens") >= 0.6)
    assert got == ([(w, "word") for _, w in own] + [(w, "fuzzy_match") for _, w in close])[:8] and {k for _, k in got} == {"word", "fuzzy_match"}
    assert [r.suggestion for r in closeness.complete(counted, index, "l", 2).collect()] == [w for _, w in sorted((-i, w) for i, w in enumerate(WORDS) if w.startswith("l"))][:2]


def test_the_filter_reaches_the_index(spark):
    index = closeness.word_index(spark, "/root/testdata/sf0.001")
    plan = closeness.candidates(index, "licence")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "GreaterThanOrEqual(length" in plan
