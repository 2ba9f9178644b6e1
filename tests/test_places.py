"""Names folded, their forms, and mentions in small texts."""

from docquarry.functions import names
from docquarry.operators import places


def forms(name, language):
    return {" ".join(t): m for _, m, t in names.forms(name, language)}


def test_folding():
    assert names.match_key("  Tel  Aviv ") == "Tel Aviv" and names.match_key("Šibenik") == "Šibenik" and names.match_key(None) == ""
    assert names.match_key("ﺣَﻠَﺐ") == "حلب" and names.match_key("مكة") == names.match_key("مکہ") == "مكه" and names.match_key("أحمد") == "احمد"
    assert names.match_key("ג׳דה") == "ג'דה" and names.match_key("יְרוּשָׁלַיִם") == "ירושלים" and names.match_key("תל־אביב") == "תל-אביב"


def test_scripts():
    assert [names.script_of(x) for x in ("Split", "Šibenik 2", "حلب", "ירושלים", "Splitحلب", "Москва", "12")] == ["Latn", "Latn", "Arab", "Hebr", None, None, None]


def test_tokens():
    assert names.name_tokens("People's Park, Tel Aviv-Yafo") == [(0, "People's", False), (9, "Park", True), (15, "Tel", False), (19, "Aviv", True), (24, "Yafo", True)]
    assert [t for _, t, _ in names.name_tokens("'a' b' 'c")] == ["a", "b", "c"] and [t for _, t, _ in names.name_tokens("פרת' x")] == ["פרת'", "x"]


def test_forms():
    assert forms("Paris", "en") == {"Paris": "exact", "PARIS": "latin.uppercase", "Paris's": "en.possessive"}
    assert forms("New York", "en") == {"New York": "exact", "NEW YORK": "latin.uppercase"}
    assert {k for k, m in forms("Rijeka", "hr").items() if m == "hr.inflection"} == {"Rijeke", "Rijeci", "Rijeku", "Rijekom"}
    assert {k for k, m in forms("Zadar", "hr").items() if m == "hr.inflection"} == {"Zadara", "Zadaru", "Zadarom"}
    hebrew = forms("חיפה", "he")
    assert hebrew["בחיפה"] == hebrew["ומחיפה"] == "he.prefix" and "הבחיפה" not in hebrew
    arabic = forms("القاهرة", "ar")
    assert {arabic[x] for x in ("للقاهره", "وللقاهره", "بالقاهره", "والقاهره", "فكالقاهره")} == {"ar.proclitic"}
    assert forms("", "en") == {} and forms("A", "en") == {"A": "exact"}


GAZETTEER = [
    (1, "Paris", "en"), (2, "Paris", "en"), (3, "New York", "en"), (4, "York", "en"), (5, "Rijeka", "hr"), (6, "חיפה", "he"), (7, "New York City Hall", "en"), (8, "Tel Aviv-Yafo", "en"), (9, None, "en"), (10, "Split", "hr"),
]


def found(spark, *texts):
    rows = [(h, p, s, t, j) for h, text in enumerate(texts) for p, (s, t, j) in enumerate(names.name_tokens(text))]
    index = spark.createDataFrame(rows, "hash_id long, position int, start int, token string, joined boolean")
    got = places.mentions(index, spark.createDataFrame(GAZETTEER, "place_id long, name string, language string"))
    return sorted((r.hash_id, r.position, r.start, r.tokens, r.method, r.place_ids) for r in got.collect())


def test_mentions(spark):
    assert found(spark, "In Paris, in PARIS and Paris's parks, not paris.") == [(0, 1, 3, 1, "exact", [1, 2]), (0, 3, 13, 1, "latin.uppercase", [1, 2]), (0, 5, 23, 1, "en.possessive", [1, 2])]
    assert found(spark, "New York City, New York. New, York; New York City Hall York") == [
        (0, 0, 0, 2, "exact", [3]), (0, 3, 15, 2, "exact", [3]), (0, 6, 30, 1, "exact", [4]), (0, 7, 36, 4, "exact", [7]), (0, 11, 55, 1, "exact", [4]),
    ]
    assert found(spark, "u Rijeci, split", "נסע לחיפה", "Tel Aviv Yafo", "", "NEW York NEW YORK") == [
        (0, 1, 2, 1, "hr.inflection", [5]), (1, 1, 4, 1, "he.prefix", [6]), (2, 0, 0, 3, "exact", [8]), (4, 1, 4, 1, "exact", [4]), (4, 2, 9, 2, "latin.uppercase", [3]),
    ]


def test_nothing_to_find(spark):
    assert found(spark, "no place here") == [] == found(spark)
