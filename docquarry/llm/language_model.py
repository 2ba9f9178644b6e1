"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its lower-cased words and an end. Where the two words before a token have been met
before, in the text or else in training, one bit says whether the same word follows again;
its predictor counts hits and misses in the text, by how long the last run of hits was. Any
other token is a path of bits in the Huffman tree of the most frequent training words, or an
escape followed by the word's bytes, eight bits each, and a space. Every bit is predicted
from several contexts: tree node alone, node with the previous word, node with the last very
common word; in spelled words, the last one, two, three and five bytes. Context statistics
are bit counts in hashed tables, gathered over all training texts.

Predictions are mixed in the logistic domain. The weights are gated by how well the context
is known and how deep the bit stands. While a text is coded its own copy of the weights
follows the coding error, block by block, and a refinement of the mixed prediction, by gate,
follows it too; so each text is scored alike wherever it stands in the input. All weights
start alike. Those of spelled words don't follow a text, for a byte's cost is kept for all
texts: they are learned online over a share of the distinct training words, in each task,
and averaged. The total is a proper code length of the tokens; bits per byte come with it.

Tables grow with the training tokens up to what a worker can hold: ``VOCABULARY`` words with
a path (all others are spelled), ``WORD_SLOTS`` and ``MATCH_SLOTS``. Counts behind the base
score are complete at any size.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bound_batches, stored

#: Stands for the end of a text among the tokens; no word is a newline.
END = b"\n"
#: Words of the Huffman tree at most.
VOCABULARY = 1 << 17
#: Further words whose counts go along when texts are scored, by hash; the others are joined.
COUNTED = 1 << 20
#: Slots of a word-context table, of the table of followers and of a spelling table, at most.
WORD_SLOTS, MATCH_SLOTS, SPELL_SLOTS = 1 << 22, 1 << 22, 1 << 20
#: Ids below these keep their identity as the previous word and as the last common word.
OWN_IDS, COMMON_IDS, ENDINGS = 1024, 256, 512
#: Tokens between two updates of a text's weights, and the step of an update.
BLOCK_TOKENS, RATE = 32, 0.004
_CHUNK = 1 << 16
#: A task counts equal words, contexts and byte windows together: so many bytes of words, pairs
#: of a context and a token, and spelled words at a time. Costs of windows that a worker keeps.
_WORD_BYTES, _PAIRS, _SPELLED, _KEPT = 32 << 20, 1 << 21, 50_000, 1 << 19
_SPELL_ORDERS = (1, 2, 3, 5)
_MIX = np.uint32(0x9E3779B1)
#: Where the table of followers stands among the tables; bits of a follower in an entry.
_FOLLOWERS, _RANK_BITS = 2, 18
#: Hits and misses that each predictor of repetition begins with: for followers from training
#: and from the text, by the run of hits before (0, 1 to 3, 4 to 15, more).
_BEGIN = np.array([[0.6, 2.0], [2.0, 0.7], [6.0, 0.5], [30.0, 0.5], [0.8, 1.6], [2.0, 0.7], [6.0, 0.5], [30.0, 0.5]])
#: Inputs of the mixer of words (node alone, previous word, common word) and its gates: three
#: depths of the node, each by how well the previous word is known there. Every weight of a text
#: starts alike.
_INPUTS, _GATES = 3, 12
#: One in so many distinct training words stays out of the spelling tables: these words settle
#: the spelling weights, in steps of so many words and this size, going over them so often.
TUNING_SHARE, TUNING_STEP, TUNING_RATE, TUNING_ROUNDS = 64, 64, 0.1, 2

BLOCKS = "tab int, block int, counts binary"


def words_of(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


@dataclass
class Words:
    """The words of texts, as ``words_of`` has them: the distinct ones, the place of each text
    word among them, text after text, and how many words each text has."""

    distinct: pa.Array
    place: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        flat, sizes = split_words(texts)
        coded = flat.dictionary_encode()
        return cls(coded.dictionary, coded.indices.to_numpy().astype(np.int64), sizes)

    def only(self, rows: list[int]) -> Words:
        """The words of some of the texts, in the order of all."""
        taken = np.zeros(len(self.sizes), bool)
        taken[rows] = True
        return Words(self.distinct, self.place[np.repeat(taken, self.sizes)], self.sizes[taken])

    def listed(self) -> list[bytes]:
        """The distinct words."""
        return as_list(self.distinct)


def as_list(column: pa.Array) -> list[bytes]:
    """An Arrow column as a list; several times faster than its ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts one after the other, and how many each text has; null is empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    word = pc.binary_length(flat).to_numpy() > 0  # white space at either end splits off an empty one
    words = flat.cast(pa.large_binary() if pa.types.is_large_string(flat.type) else pa.binary()).filter(pa.array(word))
    return words, np.diff(np.concatenate([[0], np.cumsum(word)])[bounds])


def token_counts(docs: DataFrame) -> DataFrame:
    """token and n over all texts of ``docs`` (column text), ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        ends = size = 0
        for batch in batches:
            held.append(split_words(batch.column(0))[0])
            ends, size = ends + batch.num_rows, size + held[-1].nbytes
            if size > _WORD_BYTES:
                yield from _count_batches(held, ends)
                held, ends, size = [], 0, 0
        yield from _count_batches(held, ends)

    return docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _count_batches(held: list[pa.Array], ends: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], ["token", "n"])
    counted = pa.chunked_array(held).value_counts()
    for i in range(0, len(counted), 50_000):
        tokens, counts = counted.slice(i, 50_000).flatten()
        yield pa.RecordBatch.from_arrays([tokens.cast(pa.binary()), counts], ["token", "n"])


def pack(numbers: np.ndarray) -> bytes:
    """Numbers in the narrowest of 1, 2 and 4 bytes that holds them all, compressed."""
    most = int(numbers.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return struct.pack("<BI", width, len(numbers)) + pa.compress(numbers.astype(f"<u{width}").tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    """The reverse of ``pack``."""
    width, n = struct.unpack_from("<BI", packed)
    return np.frombuffer(pa.decompress(packed[5:], width * n, "zstd", asbytes=True), f"<u{width}")


def _blocks(tab: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table as compressed pieces of ``_CHUNK`` numbers, empty ones left out."""
    for b in range(0, len(table), _CHUNK):
        part = table[b : b + _CHUNK]
        if part.any():
            packed = pack(part)
            yield pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([b // _CHUNK], pa.int32()), pa.array([packed], pa.binary())], ["tab", "block", "counts"])


def _stretched(blocks: DataFrame, sizes: list[int], greatest: int = -1) -> list[np.ndarray]:
    """Summed tables as one int16 a slot: 4 * stretch level + how well known (0 to 3). Of the
    table numbered ``greatest``, the greatest entry of each slot instead."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for tab, b, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = unpack(packed)
                if (tab, b) not in sums:
                    sums[tab, b] = part.astype(np.uint32 if tab == greatest else np.uint64)
                elif tab == greatest:
                    np.maximum(sums[tab, b], part, out=sums[tab, b])
                else:
                    sums[tab, b] += part
        for (tab, b), total in sums.items():
            packed = total.tobytes() if tab == greatest else level_of(total[0::2], total[1::2]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([b], pa.int32()), pa.array([packed], pa.binary())], ["tab", "block", "counts"])

    out = [np.zeros(n, np.uint32 if tab == greatest else np.int16) for tab, n in enumerate(sizes)]
    for r in blocks.repartition("tab", "block").mapInArrow(add, BLOCKS).collect():  # 2 or 4 bytes a slot in all
        own = out[r["tab"]]
        part = np.frombuffer(r["counts"], own.dtype)
        at = r["block"] * (_CHUNK if own.dtype == np.uint32 else _CHUNK // 2)
        own[at : at + len(part)] = part
    return out


def level_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Bit counts as 4 * (stretch in sixteenths) + confidence."""
    n = zeros.astype(np.float64) + ones
    stretch = np.log((ones + 0.3) / (zeros + 0.3))
    known = (n > 0).astype(np.int16) + (n > 3) + (n > 30)
    return (np.clip(np.rint(stretch * 16), -128, 127).astype(np.int16) << 2) + known


def value_of(level: np.ndarray) -> np.ndarray:
    """The stretch that a table's level tells."""
    return (level >> 2).astype(np.float32) * np.float32(1 / 16)


@dataclass
class Vocabulary:
    """Ranks of the most frequent tokens, the end first, and their Huffman paths. A token's
    id is its rank; all others share the id ``escape``."""

    ranks: dict[bytes, int]
    counts: np.ndarray
    escape: int
    classes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    steps: np.ndarray  # 2 * node + bit, path after path
    stretch: np.ndarray  # of each node
    gates: np.ndarray  # of each node, by its depth
    mixed: np.ndarray  # of each node, its part of a slot

    @classmethod
    def build(cls, tokens: list[bytes], counts: np.ndarray, total: int, once: int) -> Vocabulary:
        """From the most frequent tokens, in order, with their counts; ``total`` counts all
        training tokens, ``once`` the words among them that were met once: as many as these
        are new words expected to be, and words of the tree give way to them by half a count."""
        order = sorted(range(len(tokens)), key=lambda i: tokens[i] != END)  # stable
        tokens, counts = [tokens[i] for i in order], np.asarray(counts, np.int64)[order]
        if not tokens or tokens[0] != END:
            tokens, counts = [END, *tokens], np.concatenate([[0], counts]).astype(np.int64)
        n = len(tokens)
        freq = np.append(np.maximum(1, 2 * counts - 1), max(1, 2 * (total - int(counts.sum())) + once))
        classes = np.array([i if i < OWN_IDS else ending(tokens[i]) for i in range(n)] + [OWN_IDS], np.uint32)
        starts, lengths, steps, stretch, gates = _huffman(freq)
        mixed = np.arange(1, len(stretch) + 1, dtype=np.uint32) * np.uint32(0x85EBCA6B)
        return cls({w: i for i, w in enumerate(tokens)}, counts, n, classes, starts, lengths, steps, stretch, gates, mixed)


def ending(word: bytes) -> int:
    """The class of a rare word as a context: its last two bytes, hashed."""
    return OWN_IDS + zlib.crc32(word[-2:]) % ENDINGS


def _huffman(freq: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paths from the root: starts and lengths by symbol, steps; stretch and gate by node.

    Two queues: symbols by frequency, and made nodes, which come in order of weight.
    """
    n = len(freq)
    weight = np.concatenate([freq, np.zeros(n, np.int64)]).astype(np.int64).tolist()
    parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    leaves, leaf, made, new = np.argsort(freq, kind="stable").tolist(), 0, n, n
    while new < 2 * n - 1:
        pair = []
        for _ in (0, 1):
            if made >= new or (leaf < n and weight[leaves[leaf]] <= weight[made]):
                pair.append(leaves[leaf])
                leaf += 1
            else:
                pair.append(made)
                made += 1
        a, b = pair
        parent[a] = parent[b] = new
        side[b] = 1
        weight[new] = weight[a] + weight[b]
        new += 1
    root = new - 1
    stretch, depth = np.zeros(n, np.float32), np.zeros(n, np.int64)
    for at in range(root - 1, -1, -1):
        if at >= n:
            depth[at - n] = depth[parent[at] - n] + 1
        if side[at]:
            stretch[parent[at] - n] = math.log(weight[at] / (weight[parent[at]] - weight[at]))
    at, paths = np.arange(n), []
    while (at != root).any():  # a level a round, from the leaves up
        paths.append(np.where(at != root, 2 * (parent[at] - n) + side[at], -1).astype(np.int32))
        at = np.where(at != root, parent[at], root)
    table = np.array(paths[::-1], np.int32).T if paths else np.zeros((n, 0), np.int32)
    lengths = (table >= 0).sum(axis=1)
    gates = np.where(depth < 4, 0, np.where(depth < 9, 4, 8)).astype(np.uint8)  # four gates each
    return np.cumsum(lengths) - lengths, lengths, table[table >= 0].astype(np.uint32), np.clip(stretch, -12, 12), gates


class Coder:
    """Turns texts into tokens, contexts and bits under a vocabulary."""

    def __init__(self, vocabulary: Vocabulary, slots: int = WORD_SLOTS):
        self.v = vocabulary
        self.shift = np.uint32(32 - (slots.bit_length() - 1))

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it has none."""
        return np.fromiter(map(self.v.ranks.get, words, repeat(-1)), np.int64, len(words))

    def tokens(self, words: list[bytes], ranks: np.ndarray) -> tuple[np.ndarray, ...]:
        """``coded`` for one text, all words of which are listed."""
        return self.coded(words, ranks, np.arange(len(words)), np.array([len(words)]))

    def coded(self, distinct: list[bytes], ranks: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of texts with their ends, the two context classes of each, what each is (its
        id, or a hash below zero where it is an escape), and where words are. Of the texts'
        words ``place`` tells which of the distinct ones, with these ranks, each is."""
        v = self.v
        own, rare = np.where(ranks < 0, v.escape, ranks), np.flatnonzero(ranks < 0)
        own_class, own_what = v.classes[own], own.copy()
        spelled = [distinct[i] for i in rare.tolist()]
        own_class[rare] = np.fromiter(map(ending, spelled), np.uint32, len(spelled))
        own_what[rare] = ~np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled))
        ends = np.cumsum(sizes + 1) - 1
        is_word = np.ones(len(place) + len(sizes), bool)
        is_word[ends] = False
        at = np.flatnonzero(is_word)
        ids, what = np.zeros(len(is_word), np.int64), np.zeros(len(is_word), np.int64)
        ids[at], what[at] = own[place], own_what[place]
        before = np.empty(len(ids), np.uint32)
        before[at + 1] = own_class[place]
        begin = ends - sizes
        before[begin] = OWN_IDS + ENDINGS
        last = np.zeros(len(ids), np.int64)  # one more than the place of the last common word
        last[1:] = np.maximum.accumulate(np.where(ids < COMMON_IDS, np.arange(1, len(ids) + 1), 0))[:-1]
        common = np.where(last > np.repeat(begin, sizes + 1), ids[np.maximum(last, 1) - 1], COMMON_IDS).astype(np.uint32)
        return ids, before, common + np.uint32(4096), what, at

    def steps(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bit of the tokens: which token, and 2 * node + bit."""
        lengths = self.v.lengths[ids]
        ends = np.cumsum(lengths)
        token = np.repeat(np.arange(len(ids)), lengths)
        step = np.arange(len(token))
        step += np.repeat(self.v.starts[ids] - (ends - lengths), lengths)
        return token, self.v.steps[step]

    def slots(self, context: np.ndarray, token: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The table slot of each bit under a context; ``mixed``: the nodes' part of it."""
        out = (context * np.uint32(0xC2B2AE35))[token]
        out ^= mixed
        out ^= out >> np.uint32(15)
        out *= _MIX
        out >>= self.shift
        return out

    def count(self, table: np.ndarray, pairs: np.ndarray) -> None:
        """Adds the bits of tokens in their contexts to a table; equal ``paired`` ones are
        counted first, and their bits added at once."""
        pairs, times = _counted(pairs)
        for i in range(0, len(pairs), 16_384):  # so that a step's arrays stay in the cache
            part = pairs[i : i + 16_384]
            of, step = self.steps((part & np.uint32((1 << _RANK_BITS) - 1)).astype(np.int64))
            slot = self.slots(part >> np.uint32(_RANK_BITS), of, self.v.mixed[(step >> 1).astype(np.int64)])
            slot <<= np.uint32(1)
            slot += step & 1
            np.add.at(table, slot.astype(np.int64), times[i : i + 16_384][of])


def paired(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A context class, below 2^13, and a token's id, below 2^18, as one number."""
    return (context << np.uint32(_RANK_BITS)) | ids.astype(np.uint32)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32)


def pairs_before(what: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of the two tokens before each one, in texts that start at ``begin``; 0 where
    there are none."""
    key = np.zeros(len(what), np.uint64)
    w = what.view(np.uint64)
    key[2:] = (w[1:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    key |= np.uint64(1)
    key[begin] = 0
    second = begin + 1
    key[second[second < len(key)]] = 0
    return key


def _entry(key: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot in the table of followers, and check bits in place."""
    slot = (key >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)
    check = ((key >> np.uint64(8)) & np.uint64(0x3FFF)).astype(np.uint32) << np.uint32(_RANK_BITS)
    return slot, check


def followers(what: np.ndarray, text: np.ndarray, key: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What followed the same two tokens before, and where that is known from: 0 nowhere,
    1 training, 2 the text itself."""
    slot, check = _entry(key, len(table))
    entry = table[slot]
    mask = np.uint32((1 << _RANK_BITS) - 1)
    known = ((entry & ~mask) == check) & (entry & mask > 0) & (key > 0)
    guess, source = np.where(known, (entry & mask).astype(np.int64) - 1, 0), known.astype(np.int64)
    own = key ^ (text.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = _order(own)
    same = np.flatnonzero((own[order[1:]] == own[order[:-1]]) & (key[order[1:]] > 0))
    guess[order[same + 1]] = what[order[same]]
    source[order[same + 1]] = 2
    return guess, source


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of 64-bit hashes, equal ones together: by their upper bits with the
    place below, which sorts faster; by the whole ones if unequal hashes share the upper bits."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    mixed = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    order = (mixed & low).astype(np.int64)
    found = keys[order]
    if (((found[1:] ^ found[:-1]) <= low) & (found[1:] != found[:-1])).any():
        return np.argsort(keys, kind="stable")
    return order


def _windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For words spelled with a closing space: how many bytes each has, and each byte with the
    five before it in its word, the byte itself lowest; zeros before the word begins."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8) if words else np.zeros(0, np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    windows = flat.astype(np.uint64)
    for back in range(1, max(_SPELL_ORDERS) + 1):
        windows[back:] |= np.where(place[back:] >= back, flat[:-back], 0).astype(np.uint64) << np.uint64(8 * back)
    return lengths, windows


def _window_bits(windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The eight bits of each window's last byte, and their slots by order."""
    k = np.arange(8, dtype=np.uint32)
    wide = (windows & np.uint64(255)).astype(np.uint32)[:, None]
    node = (np.uint32(1) << k) | (wide >> (np.uint32(8) - k))
    bit = (wide >> (np.uint32(7) - k)) & np.uint32(1)
    node *= np.uint32(0x85EBCA6B)
    slots, context = [], np.zeros(len(windows), np.uint32)
    for back in range(1, max(_SPELL_ORDERS) + 1):
        context = (context + ((windows >> np.uint64(8 * back)) & np.uint64(255)).astype(np.uint32) + np.uint32(1)) * np.uint32(0x2C1B3C6D)
        context ^= context >> np.uint32(15)
        if back in _SPELL_ORDERS:
            h = (context[:, None] + np.uint32(back)) ^ node
            h ^= h >> np.uint32(13)
            slots.append(((h * _MIX) >> np.uint32(32 - (SPELL_SLOTS.bit_length() - 1))).ravel())
    return bit.ravel(), slots


def _spell_bits(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For words spelled with a closing space: word and bit of each step, slots by order."""
    lengths, windows = _windows(words)
    return np.repeat(np.arange(len(words)), 8 * lengths), *_window_bits(windows)


@dataclass
class Model:
    """Everything that scoring needs."""

    vocabulary: Vocabulary
    tables: list[np.ndarray]
    spelling: list[np.ndarray]
    total: int
    distinct: int
    start: np.ndarray = field(default_factory=lambda: np.full((_INPUTS, _GATES), 1 / _INPUTS))
    spell_weights: np.ndarray = field(default_factory=lambda: mean_of_known())


def mean_of_known() -> np.ndarray:
    """Spelling weights by the longest order known: the mean of the orders up to that one."""
    gates = np.arange(len(_SPELL_ORDERS) + 1)[:, None]
    return np.where(np.arange(len(_SPELL_ORDERS)) < gates, 1 / np.maximum(gates, 1), 0.0)


def _known_orders(levels: list[np.ndarray]) -> np.ndarray:
    """For each bit how many orders there are up to the longest one that is known."""
    known = np.zeros(len(levels[0]), np.int8)
    for i, x in enumerate(levels):
        np.maximum(known, ((x & 3) > 0).view(np.int8) * np.int8(i + 1), out=known)
    return known.astype(np.int64)


def tuned_spelling(words: list[bytes], tables: list[np.ndarray], rounds: int = TUNING_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spelling weights learned online from words that the tables don't hold, and bits by gate."""
    weights, seen = mean_of_known(), np.zeros(len(_SPELL_ORDERS) + 1)
    value = (np.arange(-512, 512) >> 2) / 16
    for _ in range(rounds):
        for at in range(0, len(words), TUNING_STEP):
            _, bit, slots = _spell_bits(words[at : at + TUNING_STEP])
            levels = [t[s] for t, s in zip(tables, slots)]
            known, inputs = _known_orders(levels), [value[x + 512] for x in levels]
            z = sum(weights[known, i] * x for i, x in enumerate(inputs))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - bit
            bits = np.bincount(known, minlength=len(weights))
            for i, x in enumerate(inputs):
                weights[:, i] -= TUNING_RATE * np.bincount(known, error * x, minlength=len(weights)) / np.maximum(bits, 1)
            seen += bits
    return weights, seen


class Scorer:
    """Log-probabilities of texts under a model."""

    def __init__(self, model: Model):
        self.m, self.coder = model, Coder(model.vocabulary, len(model.tables[0]))
        self.kept = np.full(_KEPT, -1, np.int64).view(np.uint64), np.zeros(_KEPT)  # windows by their hash, and their costs

    def spell(self, words: list[bytes]) -> np.ndarray:
        """Natural log-probability of each word's bytes."""
        lengths, windows = _windows(words)
        return np.add.reduceat(self.window_costs(windows), np.cumsum(lengths) - lengths) if words else np.zeros(0)

    def window_costs(self, windows: np.ndarray) -> np.ndarray:
        """Natural log-probability of the last byte of each window. It depends on the window
        alone, so those met lately are looked up, and of the others each distinct one is coded."""
        held, costs = self.kept
        slot = ((windows * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (_KEPT.bit_length() - 1))).astype(np.int64)
        out, other = costs[slot], np.flatnonzero(held[slot] != windows)
        if len(other):
            new, which = np.unique(windows[other], return_inverse=True)
            coded = np.concatenate([self.coded_windows(new[i : i + 4096]) for i in range(0, len(new), 4096)])
            out[other] = coded[which]
            held[slot[other]] = windows[other]
            costs[slot[other]] = out[other]
        return out

    def coded_windows(self, windows: np.ndarray) -> np.ndarray:
        """``window_costs`` bit by bit."""
        bit, slots = _window_bits(windows)
        levels = [t[s.astype(np.int64)] for t, s in zip(self.m.spelling, slots)]
        known = _known_orders(levels)
        columns = np.ascontiguousarray(self.m.spell_weights.T, np.float32)
        z = sum(columns[i][known] * value_of(x) for i, x in enumerate(levels))
        miss = np.exp(np.minimum((1 - 2 * bit.astype(np.float32)) * z, 30))
        return -np.log(miss + 1).reshape(-1, 8).sum(axis=1, dtype=np.float64)

    def repeated(self, what: np.ndarray, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens a follower foretells, and the log-probability of that bit for each."""
        guess, source = followers(what, text, pairs_before(what, begin), self.m.tables[_FOLLOWERS])
        hit = (source > 0) & (guess == what)
        at = np.arange(len(what))
        last = np.maximum.accumulate(np.where(hit, -1, at))  # the last miss so far
        run = np.zeros(len(what), np.int64)
        run[1:] = at[:-1] - last[:-1]
        run = np.minimum(run, at - begin[text])
        kind = (source - 1) * 4 + (run > 0) + (run > 3) + (run > 15)
        asked = np.flatnonzero(source > 0)
        group = text[asked] * 8 + kind[asked]
        order = np.argsort(group, kind="stable")
        group, hits = group[order], hit[asked][order].astype(np.int64)
        new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        place = np.arange(len(group))
        first = np.maximum.accumulate(np.where(new, place, 0)) if len(group) else place
        before = np.cumsum(hits) - hits
        before -= before[first]
        yes, no = _BEGIN[group % 8].T
        p = (yes + before) / (yes + no + place - first)
        cost = np.zeros(len(what))
        cost[asked[order]] = np.log(np.where(hits, p, 1 - p))
        return hit, cost

    def score(self, words: Words, listed: list[bytes] | None = None, ranks: np.ndarray | None = None, rate: float = RATE, keep: list | None = None) -> list[float]:
        """Natural log-probability of each text, given as its words (and the list of the
        distinct ones and their ranks).

        All texts advance together, ``BLOCK_TOKENS`` tokens at a time, each with weights of
        its own. ``keep`` receives the final weights.
        """
        if not len(words.sizes):
            return []
        v, coder = self.m.vocabulary, self.coder
        listed = words.listed() if listed is None else listed
        ranks = coder.look_up(listed) if ranks is None else ranks
        ids, before, common, what, at = coder.coded(listed, ranks, words.place, words.sizes)
        n, sizes = len(words.sizes), words.sizes + 1
        begin, text = np.cumsum(sizes) - sizes, np.repeat(np.arange(n), sizes)
        hit, cost = self.repeated(what, text, begin)
        rare = np.flatnonzero(ranks < 0)
        spelling = np.zeros(len(ranks))
        spelling[rare] = self.spell([listed[i] for i in rare.tolist()])
        cost[at] += np.where(hit[at], 0.0, spelling[words.place])
        total = np.bincount(text, cost, minlength=n)
        rest = np.flatnonzero(~hit)
        sizes = np.bincount(text[rest], minlength=n)
        order = np.argsort(-sizes, kind="stable")
        moved = rest[np.argsort(np.argsort(order)[text[rest]], kind="stable")]  # longest text first
        ids, before, common, sizes = ids[moved], before[moved], common[moved], sizes[order]
        begin = np.cumsum(sizes) - sizes
        weights = [np.repeat(self.m.start[k][None, :], n, axis=0).astype(np.float32).ravel() for k in range(3)]
        refined, coded_total = np.zeros(n * 12, np.float32), np.zeros(n)
        for at in range(0, int(sizes[0]), BLOCK_TOKENS):
            m = int(np.searchsorted(-sizes, -at, side="left"))  # texts longer than ``at``
            take = np.minimum(sizes[:m] - at, BLOCK_TOKENS)
            doc = np.repeat(np.arange(m), take)
            token = begin[doc] + at + np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take)
            of, step = coder.steps(ids[token])
            node = (step >> 1).astype(np.int64)  # entries are taken faster by 64-bit numbers
            mixed = v.mixed[node]
            one = self.m.tables[0][coder.slots(before[token], of, mixed).astype(np.int64)]
            two = self.m.tables[1][coder.slots(common[token], of, mixed).astype(np.int64)]
            inputs = (v.stretch[node], value_of(one), value_of(two))
            gate = (doc * 12)[of]
            gate += one & 3
            gate += v.gates[node]
            z = weights[0][gate]
            z *= inputs[0]
            z += weights[1][gate] * inputs[1]
            z += weights[2][gate] * inputs[2]
            z += refined[gate]
            sign = 1 - 2 * (step & 1).astype(np.float32)
            z *= sign
            miss = np.exp(np.minimum(z, 30, out=z), out=z)
            bits = np.cumsum(v.lengths[ids[token]])[np.cumsum(take) - 1]
            whole = miss + 1
            miss /= whole
            coded_total[:m] -= np.add.reduceat(np.log(whole, out=whole), np.concatenate([[0], bits[:-1]]), dtype=np.float64)  # log1p takes six times as long
            miss *= sign
            for k in range(3):
                weights[k][: m * 12] -= np.float32(rate) * np.bincount(gate, miss * inputs[k], minlength=m * 12)
            refined[: m * 12] -= np.float32(rate) * np.bincount(gate, miss, minlength=m * 12)
        if keep is not None:
            keep += [w.reshape(n, 12) for w in weights]
        total[order] += coded_total
        return total.tolist()


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` tokens reach."""
    by_count = sorted(((r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = (by_count[0][0] + 1 if by_count else 1), 0
    for n, k in by_count:
        held += k
        if held > most:
            break
        least = n
    return least


def _slots(tokens: int, most: int) -> int:
    """A table's slots: enough for so many tokens, from 4096 to ``most``."""
    return min(most, 1 << max(12, (tokens - 1).bit_length()))


def train(docs: DataFrame, usable: Column, counts: DataFrame | None = None) -> tuple[Model, DataFrame]:
    """The model and the token counts of the usable ``docs`` (columns id and text).

    Counts, contexts, followers and spellings come from every usable text, whole.
    """
    spark = docs.sparkSession
    own = docs.where(usable)
    counts = stored(token_counts(own)) if counts is None else counts
    total, distinct, once = counts.agg(F.sum("n"), F.count("*"), F.count(F.when(F.col("n") == 1, 1))).first()
    least = _least_count(counts, VOCABULARY)
    head = counts.where((F.col("n") >= least) | (F.col("token") == F.lit(END))).orderBy(F.desc("n"), "token").toArrow()
    tokens, often = head.column("token").to_pylist(), head.column("n").to_numpy()
    vocabulary = Vocabulary.build(tokens, often, total or 0, once)
    most = int(often[OWN_IDS - 1]) if len(often) >= OWN_IDS else total or 0
    del head, tokens, often
    shared = spark.sparkContext.broadcast(vocabulary)
    word_slots, match_slots = _slots(16 * (total or 1), WORD_SLOTS), _slots(2 * (total or 1), MATCH_SLOTS)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, word_slots)
        tables = [np.zeros(2 * word_slots, np.uint32) for _ in range(2)]
        follows = np.zeros(match_slots, np.uint32)
        held: list[list[np.ndarray]] = [[], []]

        def add() -> None:
            for table, own in zip(tables, held):
                if own:
                    coder.count(table, np.concatenate(own))
                own.clear()

        for batch in batches:
            words = Words.of(batch.column(0))
            if not len(words.sizes):
                continue
            listed = words.listed()
            ids, before, common, what, _ = coder.coded(listed, coder.look_up(listed), words.place, words.sizes)
            sizes = words.sizes + 1
            key = pairs_before(what, np.cumsum(sizes) - sizes)
            told = np.flatnonzero((key > 0) & (what >= 0))
            slot, check = _entry(key[told], match_slots)
            np.maximum.at(follows, slot, check | (what[told] + 1).astype(np.uint32))
            for own, context in zip(held, (before, common)):
                own.append(paired(context, ids))
            if sum(map(len, held[0])) > _PAIRS:
                add()
        add()
        for tab, table in enumerate([*tables, follows]):
            yield from _blocks(tab, table)

    def spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * SPELL_SLOTS, np.uint32) for _ in _SPELL_ORDERS]
        for words in _grouped(batches, _SPELLED):
            windows, times = _counted(_windows(words)[1])
            for i in range(0, len(windows), 4096):
                bit, slots = _window_bits(windows[i : i + 4096])
                for table, slot in zip(tables, slots):
                    np.add.at(table, 2 * slot.astype(np.int64) + bit, np.repeat(times[i : i + 4096], 8))
        for tab, table in enumerate(tables):
            yield from _blocks(tab, table)

    tables = _stretched(own.select("text").mapInArrow(contexts, BLOCKS), [word_slots, word_slots, match_slots], _FOLLOWERS)
    rare = counts.where((F.col("n") <= most) & (F.col("token") != F.lit(END))).select("token")
    aside = F.crc32("token") % TUNING_SHARE == 0
    spelling = _stretched(rare.where(~aside).mapInArrow(spellings, BLOCKS), [SPELL_SLOTS] * len(_SPELL_ORDERS))
    given = spark.sparkContext.broadcast(spelling)

    def tune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _grouped(batches, 20_000):
            weights, bits = tuned_spelling(words, given.value)
            yield pa.RecordBatch.from_arrays([pa.array([weights.ravel().tolist()], pa.list_(pa.float64())), pa.array([bits.tolist()], pa.list_(pa.float64()))], ["weights", "bits"])

    parts = rare.where(aside).mapInArrow(tune, "weights array<double>, bits array<double>")
    each = [(F.col("weights")[g * len(_SPELL_ORDERS) + i], F.col("bits")[g]) for g in range(len(_SPELL_ORDERS) + 1) for i in range(len(_SPELL_ORDERS))]
    means = parts.agg(*(F.sum(w * b) / F.nullif(F.sum(b), F.lit(0.0)) for w, b in each)).first()
    mean = mean_of_known()
    weights = np.array([m if x is None else x for x, m in zip(means, mean.ravel())]).reshape(mean.shape)
    return Model(vocabulary, tables, spelling, total or 0, distinct or 0, spell_weights=weights), counts


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[bytes]]:
    """The values of the first column, ``size`` at a time."""
    held: list[bytes] = []
    for batch in batches:
        held += as_list(batch.column(0))
        while len(held) >= size:
            yield held[:size]
            held = held[size:]
    if held:
        yield held


def _counts_of(words: list[bytes], hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of the words whose hash is among the sorted ``hashes``, else 0."""
    if not words or not len(hashes):
        return np.zeros(len(words), np.int64)
    own = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)).view(np.int64)
    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    return np.where(hashes[at] == own, counts[at], 0)


class _Worker:
    """The scorer of a worker: the costs of windows that one task has coded serve the next."""

    name: str = ""
    scorer: Scorer | None = None

    @classmethod
    def of(cls, name: str, model: Callable[[], Model]) -> Scorer:
        if cls.name != name:
            cls.name, cls.scorer = name, None
            cls.scorer = Scorer(model())
        return cls.scorer


SCORED = "id long, n_tokens long, n_known long, base double, logp double, n_bytes long, rest array<struct<token:binary,n:int>>"


def score_documents(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Every row of ``docs`` (columns id and text) with its scores.

    Returns id, n_tokens, n_known, base_score, score (both log10) and bits_per_byte. Null
    text is empty: one token, the end. Ids may be null or repeated. The base score needs
    exact counts: those of the ``VOCABULARY`` most frequent tokens go along with the
    model, those of ``COUNTED`` more as 64-bit hashes, other tokens are looked up by a join.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    often = counts.where(F.col("n") >= _least_count(counts, COUNTED)).select(F.xxhash64("token").alias("h"), "n").toArrow()  # COUNTED rows at most
    order = np.argsort(often["h"].to_numpy())
    further = spark.sparkContext.broadcast((often["h"].to_numpy()[order], often["n"].to_numpy()[order]))
    del often, order
    room = model.total + model.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Worker.of(name, lambda: shared.value)
        v = scorer.m.vocabulary
        logs = np.log10((v.counts + 1) / room)
        scored: dict[bytes, float] = {}  # copies in a task are scored once
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            words = Words.of(texts)
            n, listed = len(texts), words.listed()
            ranks = scorer.coder.look_up(listed)
            rare = np.flatnonzero(ranks < 0)
            met = np.zeros(len(ranks), np.int64)
            met[rare] = _counts_of([listed[i] for i in rare.tolist()], *further.value)
            known = np.where(ranks < 0, met > 0, True)
            worth = np.where(ranks < 0, np.log10((met + 1) / room), logs[ranks])
            doc = np.repeat(np.arange(n), words.sizes)
            found = known[words.place]
            n_known = np.bincount(doc[found], minlength=n) + int(v.counts[0] > 0)
            base = np.bincount(doc[found], worth[words.place[found]], minlength=n) + logs[0]
            # of the words that aren't counted yet, each once a text
            left, times = _counted((doc[~found].astype(np.uint64) << np.uint64(32)) | words.place[~found].astype(np.uint64))
            tokens = words.distinct.cast(pa.binary()).take(pa.array((left & np.uint64(0xFFFFFFFF)).astype(np.int64)))
            bounds = np.searchsorted(left >> np.uint64(32), np.arange(n + 1)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([tokens, pa.array(times.astype(np.int32))], ["token", "n"]))
            raw = as_list(texts.cast(pa.binary()))
            keys = [xxhash.xxh3_128_digest(t) for t in raw]
            new = sorted(i for k, i in {k: i for i, k in enumerate(keys)}.items() if k not in scored)
            scored.update(zip([keys[i] for i in new], scorer.score(words.only(new), listed, ranks)))
            logp = [scored[k] for k in keys]
            if len(scored) > 100_000:
                scored.clear()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(words.sizes + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(logp, pa.float64()), pa.array([len(t) for t in raw], pa.int64()), rest,
                ],
                [x.split()[0] for x in SCORED.split(", ")],
            )

    first = stored(docs.select("id", "text").mapInArrow(run, SCORED).withColumn("_row", F.monotonically_increasing_id()))
    rare = first.select("_row", F.explode("rest").alias("r")).select("_row", "r.token", F.col("r.n").alias("k"))
    met = rare.join(counts, "token", "left")
    looked = met.groupBy("_row").agg(
        F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(room)))).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("also"),
    )
    out = first.drop("rest").join(looked, "_row", "left")
    bits = F.when(F.col("n_bytes") > 0, -F.col("logp") / math.log(2) / F.col("n_bytes"))
    return out.select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("logp") / math.log(10)).alias("score"), bits.alias("bits_per_byte"),
    )
