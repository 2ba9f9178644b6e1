"""Tokens with places, and searches on the positional index."""

import pytest
from pyspark.sql import functions as F

from docquarry.functions import tokens
from docquarry.operators import fulltext
from docquarry.plans.criteria import CriteriaError
from docquarry.sources import shared

SF = "/root/testdata/sf0.001"


def kinds(text):
    return [(token, kind) for _, token, kind in tokens.tokens(text)]


def test_entities_are_whole():
    text = "Mail Jane.Doe@Example.com, see https://a.example/x?y=1 or www.site.org/p on 2024-03-05; call +1 (663) 555-6869 at 40.7128, -74.0060."
    got = kinds(text)
    assert ("jane.doe@example.com", "email") in got and ("https://a.example/x?y=1", "url") in got and ("www.site.org/p", "url_no_protocol") in got
    assert ("+1 (663) 555-6869", "phone") in got and ("40.7128, -74.0060", "coordinates") in got
    assert [t for t, k in got if k == "word"] == ["mail", "see", "or", "on", "call", "at"]
    assert all(text[start : start + len(token)].lower() == token for start, token, _ in tokens.tokens(text))


def test_the_longer_of_overlapping_entities_stays():
    assert kinds("12.03.2024T") == [("12.03.2024t", "url_no_protocol")]
    assert kinds("5 March 2024") == [("5 march 2024", "date")]
    assert kinds("2024-03-05") == [("2024-03-05", "phone")]  # equally long: the first kind in order


def test_odd_texts():
    assert tokens.tokens(None) == tokens.tokens("") == tokens.tokens(" \n- ' _ ") == []
    assert kinds("a-b c'd é _ x\x00y") == [("a-b", "word"), ("c'd", "word"), ("é", "word"), ("xy", "word")]
    assert len(tokens.tokens("word " * 100_000)) == 100_000


@pytest.fixture
def small(spark, monkeypatch, tmp_path):
    texts = [
        (1, "The licensed works of the licence holder."), (2, "license under the Apache License"), (3, "apache works; no licence"), (4, "running runs run"), (5, None), (6, "a@b.example said: run the works"), (7, "run run x run"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'s' as source", "'en' as lang", "1L as n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    yield str(tmp_path)
    shared.forget(str(tmp_path))


def ids(frame):
    return sorted(r.hash_id for r in frame.collect())


def test_searches(spark, small):
    look = lambda text: ids(fulltext.match(spark, small, text))
    assert look("licenses") == [1, 2] and look("licence") == [1, 3]
    assert look('"license under the apache license"') == look('"license under the apache"') == look('"license under an apache"') == [2]
    assert look('"license under Apache"') == look('"license works the apache"') == []
    assert look('"apache license" OR running') == [2, 4, 6, 7]
    assert look("works NOT run") == [1, 3] and look("NOT works") == [2, 4, 7] and look("NOT (works OR run)") == [2]  # no text, no content
    assert look("the works") == [1, 3, 6]  # a stop word asks for nothing
    assert look("a@b.example run") == [6] and look("nothinglikeit") == []
    with pytest.raises(CriteriaError):
        look("the OR of")


def test_nearness(spark, small):
    near = lambda *how: sorted(tuple(r) for r in fulltext.near(spark, small, *how).collect())
    assert near("run", "works", 1) == [] and near("run", "works", 2) == [(6, 1, 2)]
    assert near("run", "running", 1) == [(4, 3, 1), (7, 2, 1)] and near("run", "run", 2) == [(4, 3, 1), (7, 3, 1)]


def test_many_tokens_of_a_stem_are_joined(spark, small, monkeypatch):
    monkeypatch.setattr(fulltext, "NAMED_TOKENS", 1)
    assert ids(fulltext.match(spark, small, "run")) == [4, 6, 7]


def test_index_is_pruned_by_token(spark):
    """The search's filter reaches the files, and no text is read again."""
    plan = fulltext.of_stems(spark, SF, ["licens"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan and "documents.parquet" not in plan


def test_phrases_with_repeated_words(spark):
    index = spark.createDataFrame([(1, i, t) for i, t in enumerate("a a a b a a".split())], "hash_id long, position int, token string")
    asked = spark.createDataFrame([(1, "a a"), (2, "a b a"), (3, "b b"), (4, "a")], "keyword_id int, phrase string")
    got = sorted(tuple(r) for r in fulltext.phrase_hits(index, asked).select("keyword_id", "hash_id", "n", F.col("first_position")).collect())
    assert got == [(1, 1, 3, 0), (2, 1, 1, 2), (4, 1, 5, 0)]
