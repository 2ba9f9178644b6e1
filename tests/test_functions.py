import bz2
import io
import lzma
import math
import tarfile
import zipfile
import zlib
from datetime import date

import pytest
from pyspark.sql import functions as F

from docquarry.functions import dates, measures
from docquarry.functions.detectors import PlaceFinder, later, sentence_at, temporal_signals
from docquarry.operators import detection, library
from docquarry.plans.criteria import Criteria, CriteriaError, literal, parse_expression, whole_word
from docquarry.sources import files, formats


def test_measures(spark):
    row = spark.createDataFrame([(100, 50, 10_000, 20_000), (0, 0, 0, 5)], "a long, b long, c long, d long").select(
        measures.log_likelihood(*map(F.col, "abcd")).alias("g"), measures.direction(*map(F.col, "abcd")).alias("s")
    )
    first, second = row.collect()
    want = 2 * (100 * math.log(100 / (10_000 * 150 / 30_000)) + 50 * math.log(50 / (20_000 * 150 / 30_000)))
    assert abs(first["g"] - want) < 1e-9 and abs(want - 100 * math.log(2)) < 1e-9
    assert first["s"] == 1 and second["g"] is None
    levels = spark.createDataFrame([(15.13,), (15.0,), (6.63,), (3.84,), (3.0,), (None,)], "g double").select(measures.significance(F.col("g"))).collect()
    assert [r[0] for r in levels] == ["p<0.0001", "p<0.001", "p<0.01", "p<0.05", "none", None]


def test_calendars():
    assert dates.jalali_to_gregorian(1403, 1, 1) == date(2024, 3, 20)
    assert dates.jalali_to_gregorian(1403, 12, 30) == date(2025, 3, 20)
    assert dates.jalali_leap(1403) and not dates.jalali_leap(1402)
    assert abs((dates.hijri_to_gregorian(1445, 9, 1) - date(2024, 3, 11)).days) <= 2
    with pytest.raises(ValueError):
        dates.jalali_to_gregorian(1402, 12, 30)
    known = {1300: (1921, 3, 21), 1354: (1975, 3, 21), 1375: (1996, 3, 20), 1399: (2020, 3, 20), 1408: (2029, 3, 20), 1420: (2041, 3, 20)}
    assert {y: dates.jalali_to_gregorian(y, 1, 1) for y in known} == {y: date(*d) for y, d in known.items()}
    assert [y for y in range(1370, 1410) if dates.jalali_leap(y)] == [1370, 1375, 1379, 1383, 1387, 1391, 1395, 1399, 1403, 1408]
    for year in range(1, 3000, 7):
        days = (dates.jalali_to_gregorian(year + 1, 1, 1) - dates.jalali_to_gregorian(year, 1, 1)).days
        assert days == 365 + dates.jalali_leap(year)


def test_horizon(spark):
    at = F.lit("2024-01-15").cast("date")
    rows = [("2024-01-01", "2024-01-14", "future"), ("2024-01-01", "2024-01-14", None), ("2024-01-01", "2024-01-15", "past"), ("2024-01-22", "2024-01-22", None), ("2024-02-14", "2024-02-14", None), ("2024-04-14", "2024-04-14", "future"), (None, None, None)]
    df = spark.createDataFrame(rows, "a string, b string, o string").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"), "o")
    got = df.select(dates.horizon_bucket(F.col("a"), F.col("b"), F.col("o"), at), dates.imminent(F.col("a"), F.col("b"), at), dates.overlaps(F.col("a"), F.col("b"), at, at), dates.orientation(F.col("a"), F.col("b"), at)).collect()
    assert [r[0] for r in got] == ["overdue", "past", "week", "month", "quarter", "later", None]
    assert [r[1] for r in got] == [False, False, True, False, False, False, False]
    assert [r[2] for r in got] == [False, False, True, False, False, False, False]
    assert [r[3] for r in got] == ["past", "past", "current", "future", "future", "future", None]


def test_calendar_periods():
    assert later(date(2024, 1, 31), 1, "month") == date(2024, 2, 29) and later(date(2024, 2, 29), 1, "year") == date(2025, 2, 28)
    assert later(date(2024, 11, 5), 14, "month") == date(2026, 1, 5) and later(date(9999, 12, 1), 2, "month") is None
    assert temporal_signals("in 2 months", date(2024, 12, 31))[0].day == date(2025, 2, 28)
    assert sentence_at("One. Two here! Three", 7) == "Two here!"


def test_joined_places_are_the_same(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "From New York's port to Paris, not york. New York City, York"), (2, None), (3, "New York New York Paris")], "id long, text string")
    names = spark.createDataFrame([("New York", 1), ("York", 2), ("Paris", 3), ("Paris", 4), ("New York City", 5), ("York New York", 6)], "name string, place int")
    found = sorted(detection.detect_places(texts, names).collect())
    monkeypatch.setattr(detection, "MAX_NAMES", 2)
    assert len(found) > 5 and sorted(detection.detect_places(texts, names).collect()) == found


def _zip(**entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), content)
    return data.getvalue()


def test_office_texts():
    """Mixed inline content, tails, tabs and typed cells."""
    odt = _zip(mimetype="application/vnd.oasis.opendocument.text", content_xml='<o xmlns:t="u"><t:p>Hello <t:span>big</t:span> lost<t:tab/>world<t:s t:c="2"/>!</t:p><t:h>End</t:h></o>')
    assert formats.READERS["odt"](odt) == "Hello big lost\tworld  !\nEnd"
    docx = _zip(word__document_xml='<w:d xmlns:w="u"><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two</w:t><w:tab/></w:r></w:p><w:p><w:r><w:t>three</w:t></w:r></w:p></w:d>')
    assert formats.READERS["docx"](docx).split() == ["One", "two", "three"]
    sheet = '<s xmlns="u"><row><c r="A1" t="s"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>12</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="inlineStr"><is><t>in</t></is></c></row></s>'
    xlsx = _zip(xl__workbook_xml="<w/>", xl__sharedStrings_xml='<s xmlns="u"><si><t>age</t></si><si><r><t>na</t></r><r><t>me</t></r></si><si><t>Ann</t></si></s>', xl__worksheets__sheet1_xml=sheet)
    assert formats.READERS["xlsx"](xlsx) == "name\t\tage\nAnn\t12\tTRUE\tin"
    assert [formats.column_letter(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and formats.column_number("AAA") == 703
    epub = _zip(mimetype="application/epub+zip", **{"a.xhtml": "<h><head><title>no</title></head><p>An <em>em</em> and <b>b</b>.</p><li>item</li></h>"})
    assert formats.READERS["epub"](epub) == "An em and b.\nitem"
    assert formats.READERS["csv"](b"a;b\n1,5;2\n") == "a\tb\n1,5\t2"


def test_pdf_text_layer():
    page = rb"BT /F1 12 Tf 72 700 Td (Hello \(PDF\)) Tj T* [(W) 20 (or) -250 (ld \351)] TJ ET"
    pdf = lambda body, extra=b"": b"%PDF-1.4\n1 0 obj<</Length 9" + extra + b">>\nstream\n" + body + b"\nendstream\nendobj\n"
    assert formats.READERS["pdf"](pdf(page)) == formats.READERS["pdf"](pdf(zlib.compress(page), b"/Filter/FlateDecode")) == "Hello (PDF)\nWor ld \xe9"
    for wrong in (pdf(b"BT <00410042> Tj ET"), pdf(page) + b"trailer<</Encrypt 5 0 R>>"):
        with pytest.raises(ValueError):
            formats.READERS["pdf"](wrong)


def test_archive_budget_covers_all_levels(monkeypatch):
    monkeypatch.setattr(formats, "MAX_FILES", 6)
    level = b"text"
    for _ in range(3):
        level = _zip(**{f"f{i}.{'zip' if level[:2] == b'PK' else 'txt'}": level for i in range(3)})
    seen = list(formats.read(level, "a.zip", budget=formats.Budget(6, 1 << 20)))
    assert any("UnsafeArchive" in r[2] for r in seen) and sum(r[3] == "text" for r in seen) < 6
    for packed, name in ((bz2.compress(b"hi there"), "x.txt.bz2"), (lzma.compress(b"hi there"), "x.txt.xz")):
        assert list(formats.read(packed, name))[1][3] == "hi there"


def test_temporal_signals():
    got = temporal_signals("Due 2024-02-30 or 2024-02-29, paid 03/04/2024, on 5 mars 2024, within 3 days.", date(2024, 1, 1))
    assert [(s.kind, s.day, s.readings) for s in got] == [
        ("iso", date(2024, 2, 29), 1), ("numeric", date(2024, 3, 4), 2), ("numeric", date(2024, 4, 3), 2), ("named", date(2024, 3, 5), 1), ("relative", date(2024, 1, 4), 1),
    ]
    assert temporal_signals("in 2 weeks")[0].day is None


def test_places():
    finder = PlaceFinder([("New York", 1), ("York", 2), ("Paris", 3), ("Paris", 4)])
    got = [(s, p) for _, _, s, p in finder.find("From New York's port to Paris, not york.")]
    assert got == [("New York's", [1]), ("Paris", [3, 4])]


def test_expression():
    assert parse_expression('a "b c" OR NOT d') == ("or", ("and", ("term", "a"), ("term", "b c")), ("not", ("term", "d")))
    for wrong in ("(a", "a OR", '"a', "a)", "NOT", '""'):
        with pytest.raises(CriteriaError):
            parse_expression(wrong)


def test_criteria_strict():
    assert Criteria(keywords=(2, 1, 2)).fingerprint() == Criteria(keywords=(1, 2)).fingerprint()
    for wrong in ({"nope": 1}, {"keywords": [0]}, {"unit": "x"}, {"text": "a OR"}):
        with pytest.raises(CriteriaError):
            Criteria.from_dict(wrong)


def test_literals_have_no_special_characters(spark):
    df = spark.createDataFrame([("100% sure_thing (a.b)",), ("100x surething",)], "t string")
    for v in ("100%", "e_t", "(a.b)"):
        assert [r[0] for r in df.select(literal(F.col("t"), v)).collect()] == [True, False]
    got = df.select(whole_word(F.col("t"), "sure_thing"), whole_word(F.col("t"), "sure"), whole_word(F.col("t"), " ")).first()
    assert tuple(got) == (True, False, False)


def test_safe_cell(spark):
    df = spark.createDataFrame([("=1+1",), (" @x",), ("a=b",), (None,)], "t string")
    assert [r[0] for r in df.select(files.safe_cell(F.col("t"))).collect()] == ["'=1+1", "' @x", "a=b", None]


def test_files(spark, tmp_path):
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        info = tarfile.TarInfo("deep.txt")
        info.size = 4
        t.addfile(info, io.BytesIO(b"deep"))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/page.html", "<html><p>Hi &amp; bye</p><script>no</script></html>")
        z.writestr("in.tar", inner.getvalue())
    (tmp_path / "m.eml").write_bytes(b"From: a@b.c\r\nSubject: S\r\nContent-Type: text/plain\r\n\r\nbody text\r\n")
    (tmp_path / "p.txt").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "s.7z").write_bytes(b"7z\xbc\xaf\x27\x1cxx")
    (tmp_path / "bad.json").write_bytes(b"{broken")
    got = {r["file_path"].rpartition("/a.zip")[2] or r["file_path"].rpartition("/")[2]: r for r in files.read_files(files.scan(spark, str(tmp_path))).collect()}
    assert [r["text"].strip() for name, r in got.items() if name.endswith("page.html")] == ["Hi & bye"]
    texts = {r["text"].strip() for r in got.values()}
    assert "deep" in texts and any("body text" in t for t in texts)
    assert any(r["status"].startswith("failed") for r in got.values()) and any(r["status"] == "unsupported" for r in got.values())
    assert formats.identify(b"%PDF-1.4 x", "p.txt").mismatch


def test_unsafe_archives():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("../up.txt", "x")
    _, (_, _, wrong, _) = list(formats.read(data.getvalue(), "u.zip"))
    assert wrong.startswith("failed: UnsafeArchive")


def test_snapshots(spark):
    known = spark.createDataFrame([("h1", 1, "a")], "hash string, size long, path string")
    found = spark.createDataFrame([("h1", 1, "b"), ("h2", 2, "d"), ("h2", 2, "c")], "hash string, size long, path string")
    assert sorted(map(tuple, files.register(known, found).collect())) == [("h1", 1, "a"), ("h2", 2, "c")]
    marks = spark.createDataFrame([("r", 5)], "reader string, last_id long")
    assert files.merge_watermark(marks, spark.createDataFrame([("r", 3), ("s", 1)], marks.schema)).count() == 2


def test_cursors():
    key = (3, "2024-01-01", None)
    assert library.decode_cursor(library.encode_cursor(*key), 3) == key
    for wrong in ("%%", "e30", library.encode_cursor(1)):
        with pytest.raises(ValueError):
            library.decode_cursor(wrong, 3)


def test_normal_forms(spark):
    df = spark.createDataFrame([("\ufb01ne  \uff21\uff22\tx",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(library.normal_text("t")).collect()] == ["fine ab x", None, ""]
    assert df.select(library.search_tokens(F.lit("Don't a - b_c \u05e9\u05dc\u05d5\u05dd ' 5"))).first()[0] == ["don't", "a", "b_c", "\u05e9\u05dc\u05d5\u05dd", "5"]
    assert df.select(library.first_page(F.lit("one\ftwo"))).first()[0] == "one"
