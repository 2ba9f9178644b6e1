"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words and cut into windows of ``window`` consecutive
words; all windows, over all items, go into one automaton. Each document is normalised the
same way, as words between single spaces, and scanned once. Hits are word ranges of the
document and are mapped back to character offsets of its original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import bound_batches, stored, texts_of

#: Characters of benchmark text behind one automaton (its patterns hold ten times as many). A
#: larger benchmark is split by item; its parts are scanned for one after the other.
MAX_ITEM_CHARS = 25_000_000

#: Lower-cases A-Z and turns every ASCII character that isn't a letter or digit into a space.
_FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SPANS = "array<struct<start:int,end:int>>"
SCAN = f"id long, n_words long, n_hit long, item_ids array<string>, spans {SPANS}"


def words_of(text: str) -> list[bytes]:
    """The words of a text, lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """Each run of ``size`` words, or all of them when there are fewer but some."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


class WindowMatcher:
    """The automaton over all windows of all items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), window):
                owners.setdefault(w, set()).add(item)
        self.machine = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.machine.add_word(f" {w.decode()} ", (w.count(b" ") + 1, len(w.decode()) + 2, ids))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Word count, hit word ranges (merged, half-open) and the items found."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        flat = f" {b' '.join(words).decode()} "
        found = list(self.machine.iter(flat))
        if not found:
            return len(words), [], set()
        items: set[str] = set()
        ranges: list[tuple[int, int]] = []
        at = first = 0
        for end, (count, chars, ids) in found:
            items |= ids
            begin = end - chars + 1
            if begin >= at:
                first += flat.count(" ", at, begin)
            else:
                first -= flat.count(" ", begin, at)
            at = begin
            ranges.append((first, first + count))
        return len(words), merged(ranges), items


_HELD: dict[str, WindowMatcher] = {}


def _held(key: str, items: list[tuple[str, str]], window: int) -> WindowMatcher:
    """One automaton a Python worker, so that the next task needn't build it again."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = WindowMatcher(items, window)
    return _HELD[key]


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as character offsets of the unchanged text."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [{"start": places[lo][0], "end": places[hi - 1][1]} for lo, hi in ranges]


def benchmark_parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """(i, t): the items, in parts of about ``MAX_ITEM_CHARS`` characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), text.alias("t"))
    n = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // MAX_ITEM_CHARS)
    return [items] if n < 2 else [items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


def benchmark_items(part: DataFrame) -> list[tuple[str, str]]:
    """A part's items on the driver; ``benchmark_parts`` has bounded it."""
    return [(r["i"], r["t"]) for r in part.collect()]


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: id, n_words, n_hit, item_ids (sorted) and spans in its text.

    Null and empty texts have no words and no hits; repeated rows are scanned each; a null
    id stays null; columns besides id and text aren't read. Items without words match
    nothing; items sharing a window are all reported. No shuffle: a map over the documents
    with the automaton's patterns broadcast, bounded by ``MAX_ITEM_CHARS``. Documents pass
    once for each part of a benchmark beyond that, kept in between with what was found.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = benchmark_parts(benchmark)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = found.select("*", F.array().cast("array<int>").alias("ranges"), F.array().cast("array<string>").alias("item_ids"))
    for k, part in enumerate(parts):
        found = _scan_part(found, part, window, last=k == len(parts) - 1)
        if k < len(parts) - 1:
            found = stored(found)
    return found


def _scan_part(docs: DataFrame, part: DataFrame, window: int, last: bool) -> DataFrame:
    """``docs`` (id, text, ranges, item_ids) with what one automaton finds; at the ``last``
    the result of all."""
    items, key = docs.sparkSession.sparkContext.broadcast(benchmark_items(part)), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _held(key, items.value, window)
        for batch, texts in texts_of(batches, "text"):
            counts, ranges, owners = [], [], []
            for text, before, ids in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n, found, more = matcher.scan(text)
                counts.append(n)
                ranges.append(merged([*zip(before[::2], before[1::2]), *found]) if before else found)
                owners.append(sorted({*ids, *more}))
            of_items = pa.array(owners, pa.list_(pa.string()))
            if not last:
                flat = pa.array([[x for r in rs for x in r] for rs in ranges], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, of_items], ["id", "text", "ranges", "item_ids"])
                continue
            hit = pa.array([sum(hi - lo for lo, hi in rs) for rs in ranges], pa.int64())
            spans = pa.array([original_spans(t, rs) for t, rs in zip(texts, ranges)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), hit, of_items, spans], ["id", "n_words", "n_hit", "item_ids", "spans"])

    return docs.mapInArrow(scan, SCAN if last else "id long, text string, ranges array<int>, item_ids array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item. A null text holds none.

    A map; for a benchmark in several parts, one for each, what is left kept in between.
    """
    bound_batches(docs.sparkSession)
    parts = benchmark_parts(benchmark)
    for k, part in enumerate(parts):
        docs = docs.where(~_holds(docs.sparkSession, part, window)(F.col(text_col)))
        if k < len(parts) - 1:
            docs = stored(docs)
    return docs


def _holds(spark: SparkSession, part: DataFrame, window: int) -> Callable[[Column], Column]:
    items, key = spark.sparkContext.broadcast(benchmark_items(part)), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = _held(key, items.value, window)
        for texts in parts:
            yield pd.Series([bool(matcher.scan(t or "")[1]) for t in texts], dtype="bool")

    return found
