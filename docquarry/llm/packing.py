"""Best-two-fit packing of token sequences into bins of one capacity.

Documents are cut into pieces of at most ``capacity`` tokens. A bin is filled greedily with
the longest piece that still fits; then its smallest piece is replaced by two unpacked
pieces when these fill the gap, widened by that piece, more tightly.

Bins depend on piece lengths only, so the packing is planned over the histogram of lengths
(at most ``capacity`` counts, whatever the corpus): a filled bin is a pattern of lengths,
used as often as the counts allow. Each use of a pattern ends the stock of some length, so
there are a few thousand patterns at most. Pieces then find their place by their rank among
the pieces of their length.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bound_batches, number_rows, stable

CAPACITY = 4096
#: Bytes of words and their token ids that are remembered; then it starts anew.
CACHE_BYTES = 24 << 20
#: Bytes of text, about, that are split at a time, and words worked out at a time.
BYTES_AT_ONCE, WORDS_AT_ONCE = 4 << 20, 1 << 16
#: Capitals whose lower case isn't by letter, and letters that are a letter and a mark in normal form.
_UNLIKE = re.compile(
    "[\u03a3\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d"
    "\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb4e]"
)

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


class Plan:
    """The bins: for each length, intervals of ranks with the first bin and the offset."""

    def __init__(self) -> None:
        self.entries: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first bin, offset
        self.bins = 0

    def add(self, pattern: list[int], times: int, used: Counter) -> None:
        offset = 0
        for length in pattern:
            self.entries.append((length, used[length], times, self.bins, offset))
            used[length] += times
            offset += length
        self.bins += times


class _Stock:
    """Lengths in stock, sorted, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.left)

    def largest(self, most: int, taken: Counter) -> int:
        """The largest length up to ``most`` that isn't all taken, else 0."""
        i = bisect.bisect_right(self.lengths, most) - 1
        while i >= 0 and self.left[self.lengths[i]] <= taken[self.lengths[i]]:
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def best_two(self, room: int, over: int, taken: Counter) -> tuple[int, int]:
        """Two lengths with the largest sum in (over, room], else zeros."""
        best, found = over, (0, 0)
        free = [k for k in self.lengths[: bisect.bisect_right(self.lengths, room - 1)] if self.left[k] > taken[k]]
        i, j = 0, len(free) - 1
        while i <= j:
            if i == j and self.left[free[i]] - taken[free[i]] < 2:
                break
            total = free[i] + free[j]
            if total > room:
                j -= 1
                continue
            if total > best:
                best, found = total, (free[j], free[i])
                if best == room:
                    break
            i += 1
        return found

    def use(self, pattern: list[int]) -> int:
        """Takes the pattern out as often as the stock allows; how often that was."""
        need = Counter(pattern)
        times = min(self.left[k] // n for k, n in need.items())
        for k, n in need.items():
            self.left[k] -= n * times
            if not self.left[k]:
                del self.left[k]
                del self.lengths[bisect.bisect_left(self.lengths, k)]
        return times


def fill_one(stock: _Stock, capacity: int) -> list[int]:
    """One bin: greedy from the longest piece, then the exchange of its smallest for two."""
    pattern, room, taken = [], capacity, Counter()
    while room and (k := stock.largest(room, taken)):
        pattern.append(k)
        taken[k] += 1
        room -= k
    if room and len(pattern) > 1:
        smallest = pattern[-1]
        taken[smallest] -= 1
        pair = stock.best_two(room + smallest, smallest, taken)
        if pair[0]:
            pattern = pattern[:-1] + list(pair)
    return pattern


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Bins for ``counts`` pieces of each length, 1 to ``capacity``."""
    stock, plan, used = _Stock(counts), Plan(), Counter()
    while stock.lengths:
        pattern = fill_one(stock, capacity)
        plan.add(pattern, stock.use(pattern), used)
    return plan


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others, in order, for U+0100 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


#: The steps of a tokenizer file under which words can be told one by one.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def chunkable(definition: str) -> bool:
    """Whether a tokenizer file has the steps that ``ChunkedTokenizer`` relies on."""
    told = json.loads(definition)
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = told.get("model") or {}
    return (
        (told.get("normalizer") or {}).get("normalizers") == _NORMAL_FORM and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern") == {"Regex": _WORD_PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
        and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        and not told.get("truncation") and not told.get("padding")
        and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens") or [])
    )


class ChunkedTokenizer:
    """Token ids by a tokenizer file, worked out once for each distinct word and remembered.

    Holds for tokenizers that drop white space and never join across it, lower-case, and
    part a run of letters from ASCII punctuation behind it; ``chunkable`` looks for these in
    the file, and texts take the tokenizer's whole way without them. Such a run of letters
    is one word of the byte-level model, whatever its case and the punctuation behind it, as
    long as it is letters in normal form too; anything else takes the whole way by itself.
    """

    def __init__(self, definition: str, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.chunkable = chunkable(definition)
        self.word_ids = self.tokenizer.model.tokenize
        self.characters = _byte_characters()
        self.most = most
        self.forget()

    def _letters(self, word: str) -> bytes:
        """The ids of lower-case letters in normal form."""
        if not word.isascii():
            word = "".join(map(self.characters.__getitem__, word.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.word_ids(word)])

    def _any(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: str) -> bytes:
        """The ids of a lower-case run of letters, or of any other chunk as it stands."""
        if word.isalpha() and (word.isascii() or (unicodedata.is_normalized("NFC", word) and not _UNLIKE.search(word))):
            return self._letters(word)
        return self._any(word)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """Like ``encode_batch`` for an Arrow column, null as empty.

        Texts are split, told apart and put together by Arrow; Python sees each distinct
        word of some ``BYTES_AT_ONCE`` once.
        """
        texts = texts.fill_null("")
        if not self.chunkable:
            return map(self._any, texts.to_pylist())
        step = max(1, len(texts) * BYTES_AT_ONCE // max(1, texts.nbytes))
        return (ids for i in range(0, len(texts), step) for ids in self._encode(texts.slice(i, step)))

    def _encode(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids = self._chunk_ids(coded.dictionary).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(ids))])[np.asarray(split.offsets)]
        data = memoryview(ids.buffers()[2] or b"")
        return (data[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()))

    def forget(self) -> None:
        """Drops what is remembered, as an idle worker needn't hold it."""
        self.chunks, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        pa.default_memory_pool().release_unused()

    def _chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk: those of its letters and those of the punctuation behind."""
        chunks = chunks.cast(pa.large_string())
        cut = pc.extract_regex(chunks, r"(?s)^(?P<head>.*?)(?P<tail>[[:punct:]]*)$")
        head, tail = cut.flatten()
        plain = pc.and_not(pc.utf8_is_alpha(head), pc.match_substring_regex(head, _UNLIKE.pattern))
        words = pc.if_else(plain, pc.utf8_lower(head), chunks)
        tails = pc.if_else(plain, tail, "")
        ids = self._look_up(pa.concat_arrays([words, tails.cast(words.type)]))
        return pc.binary_join_element_wise(ids[: len(chunks)], ids[len(chunks) :], pa.scalar(b"", ids.type))

    def _look_up(self, words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, self.chunks)
        missing = coded.dictionary.filter(at.is_null())
        places = at.fill_null(-1).to_numpy().astype(np.int64)
        places[places < 0] = len(self.chunks) + np.arange(len(missing))
        parts = (missing.slice(i, WORDS_AT_ONCE).to_pylist() for i in range(0, len(missing), WORDS_AT_ONCE))
        ids = pa.concat_arrays([self.ids, *(pa.array([self._learn(w) for w in x], self.ids.type) for x in parts)])
        if len(missing):
            self.chunks, self.ids = pa.concat_arrays([self.chunks, missing]), ids
            if self.chunks.nbytes + self.ids.nbytes > self.most:
                self.forget()
        return ids.take(pa.array(places[coded.indices.to_numpy()]))


_LOADED: dict[int, ChunkedTokenizer] = {}


def loaded_tokenizer(definition: str) -> ChunkedTokenizer:
    """One tokenizer a Python worker, so that the next task needn't load it again."""
    key = zlib.crc32(definition.encode())
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ChunkedTokenizer(definition)
    return _LOADED[key]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined up to about ``BYTES_AT_ONCE``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.nbytes for b in held) + batch.nbytes > BYTES_AT_ONCE:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def tokenize_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document's ids, closed by ``end_id`` and cut into pieces: id, piece, start,
    length, ids_crc32. A map without a shuffle; texts aren't carried on."""
    spark = docs.sparkSession
    bound_batches(spark)
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    closing = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded_tokenizer(definition.value)
        for batch in _together(batches):
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), tokenizer.encode_column(batch.column(1))):
                ids += closing
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "piece", "start", "length", "ids_crc32"])
        tokenizer.forget()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    Pieces of one length are ranked by (id, piece, ids_crc32); equal rows get a rank each.
    """
    pieces = stable(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    plan = plan_bins(counts, capacity)
    numbered, _ = number_rows(pieces, "length", "id", "piece", "ids_crc32")
    table = sorted(plan.entries)
    first = np.array([e[1] for e in table], np.int64)
    lengths = np.array([e[0] for e in table], np.int64)
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    starts = first + np.array([before[int(k)] for k in lengths], np.int64)
    bins, offsets = np.array([e[3] for e in table], np.int64), np.array([e[4] for e in table], np.int64)
    shared = pieces.sparkSession.sparkContext.broadcast((starts, bins, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def place(row: pd.Series) -> pd.DataFrame:
        starts, bins, offsets = shared.value
        rows = row.to_numpy()
        at = np.searchsorted(starts, rows, side="right") - 1
        return pd.DataFrame({"sequence_id": bins[at] + rows - starts[at], "offset": offsets[at]})

    placed = numbered.withColumn("_p", place("row"))
    return placed.select("id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens.

    A null text counts as empty: one piece, the closing id. Null ids stay null and come
    first; repeated rows are packed each; other columns aren't read; an empty table gives
    no rows. Only documents longer than a sequence are cut.
    """
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity)
