"""SimHash near duplicates by Golay-code fuzzy hashing, exact, down to connected components.

A document's fingerprint has a bit set where more than half of its shingle hashes have it.
Fingerprints link when they differ in at most two bits. The join works on distinct
fingerprints only, so copies count once:

1. Keys. A fingerprint is cut into three segments of 22, 21 and 21 bits. Of two errors at
   most, one segment has none (pigeonhole). The binary Golay code [23, 12] is perfect: every
   word of 23 bits decodes to one codeword, at most three bits away. Two fingerprints with up
   to two errors in the other two segments have one in the middle that differs from each in
   one bit at most, so both list the codeword indices that it decodes to. A key is the
   segment without errors with one index for each of the others: some 29 keys a fingerprint,
   of 46 bits.
2. Buckets. Members of a key are counted, with the least and the greatest, before they are
   shuffled. Two members are a candidate pair as they stand. Up to ``BUCKET`` members are
   gathered and compared; only links that connect something are kept.
3. Large buckets. Members of more crowded keys are dealt by each fingerprint within one bit
   of them. Those that meet there differ in two bits at most, and there can't be more than 65
   of them: each links with the least. So nothing is capped and no key gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bound_batches, stable, stored
from docquarry.llm.similarity_join import components

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits; the keys below are made for two.
MOST_BITS = 2
#: Buckets of more members are dealt by neighbouring fingerprints instead of gathered.
BUCKET = 64
#: First bit and bits of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_CHECK_BITS, _WORD_BITS = 11, 23


def _remainders() -> np.ndarray:
    """The remainder by the generator of every 12-bit number followed by 11 zeros."""
    out = np.zeros(1 << 12, np.int64)
    for i in range(1 << 12):
        left = i << _CHECK_BITS
        for bit in range(_WORD_BITS - 1, _CHECK_BITS - 1, -1):
            if left >> bit & 1:
                left ^= GENERATOR << (bit - _CHECK_BITS)
        out[i] = left
    return out


_REMAINDER = _remainders()


def _syndrome(words: np.ndarray) -> np.ndarray:
    return _REMAINDER[words >> _CHECK_BITS] ^ (words & ((1 << _CHECK_BITS) - 1))


def _errors() -> np.ndarray:
    """The one pattern of at most three errors for each of the 2048 syndromes."""
    patterns = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(_WORD_BITS), n)], np.int64)
    out = np.zeros(1 << _CHECK_BITS, np.int64)
    out[_syndrome(patterns)] = patterns
    return out


_ERROR = _errors()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ _ERROR[_syndrome(words)]) >> _CHECK_BITS


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys (int64) of the fingerprints (uint64) and the row that each belongs to."""
    parts = [(fingerprints >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
    plain = [codeword_index(p) for p in parts]
    flipped = [codeword_index(p[:, None] ^ (1 << np.arange(bits))) for p, (_, bits) in zip(parts, SEGMENTS)]
    keys, rows = [], []
    for exact in range(3):
        j, k = (s for s in range(3) if s != exact)
        indices = np.concatenate(
            [(plain[j] << 12 | plain[k])[:, None], flipped[j] << 12 | plain[k][:, None], plain[j][:, None] << 12 | flipped[k]], axis=1
        )
        indices.sort(axis=1)
        new = np.ones(indices.shape, bool)
        new[:, 1:] = indices[:, 1:] != indices[:, :-1]
        row, _ = np.nonzero(new)
        keys.append(exact << 60 | parts[exact][row] << 24 | indices[new])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a UTF-8 text; zero where it has no words.

    Words are parted by ASCII white space, A-Z are lower-cased, and a text of fewer words than
    ``size`` is one shingle. Shingles are hashed by XXH64, repeats as often as they occur.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.fromiter(map(len, words), np.int64, n)
    np.cumsum(ends + 1, out=ends)
    starts = np.concatenate([[0], ends[: n - size]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, fp) of each row of (id, text); ``fp`` is signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t or b"", size) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.mapInArrow(run, "id long, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            keys, rows = keys_of(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows])], ["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def connecting(members: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links between ``members`` (at most ``BUCKET``) that connect what is linked, and no more."""
    own = members.view(np.uint64)
    near = np.bitwise_count(own[:, None] ^ own[None, :]) <= most
    label, out = np.arange(len(own)), []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        if label[i] != label[j]:
            out.append((int(members[i]), int(members[j])))
            label[label == label[j]] = label[i]
    return out


def _within(buckets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = batch.column(0).offsets.to_numpy().tolist(), batch.column(0).values.to_numpy()
            found = [x for i, j in zip(offsets, offsets[1:]) for x in connecting(values[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints ``fps`` (fp) exactly as all links do."""
    keyed = stored(_keyed(fps))
    counted = stable(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = counted.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)).select("a", "b")
    few = keyed.join(counted.where((F.col("n") > 2) & (F.col("n") <= bucket)).select("key"), "key", "left_semi")
    gathered = few.groupBy("key").agg(F.collect_list("fp").alias("members")).select("members")
    many = keyed.join(counted.where(F.col("n") > bucket).select("key"), "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(64)])
    around = many.select("fp", F.explode(flips).alias("flip")).groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    met = around.agg(F.collect_list("fp").alias("members")).where("size(members) > 1")  # 65 at most
    stars = met.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.unionByName(_within(gathered)).unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """Every row of ``docs`` as (id, fp, component_id); ``fp`` is the signed fingerprint.

    ``component_id`` is the least id among the rows connected by links of at most two
    differing bits. Null, empty and blank texts have the fingerprint zero, and link with it and
    what is near it like any other. Repeated rows and equal texts are copies of each other.
    Null ids stay null and are never a component's id; a component of nothing else has a null
    id. Other columns aren't read, whatever their names; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    marked = stored(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), size))
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(links(distinct.select("fp"), bucket))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_fp = named.join(lowest, "label").select(F.col("fp").alias("own"), "component_id")
    return marked.join(of_fp, marked["fp"] == of_fp["own"], "left").select("id", "fp", "component_id")
