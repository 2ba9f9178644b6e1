"""N-gram Jaccard join by a token-group matrix, exact, down to connected components.

A document is the set of its shingles (64-bit hashes of ``SHINGLE`` consecutive words);
equal sets form one class. Two classes link when their Jaccard similarity reaches the
threshold. The join has four steps:

1. Groups. A class joins the most popular of its minhash values, so that similar classes
   come together whether they link or not; a group is cut into blocks of about
   ``GROUP_MEMBERS`` classes or ``GROUP_TOKENS`` tokens. Any grouping gives the same result.
2. Matrix. Of a set of n tokens any (1-t)n + 1 must meet a set that links with it, so a class
   enters with its n(1-t) + 1 rarest tokens in one global order: a fixed-size count sketch of
   all documents puts tokens that many documents share last. The matrix has a row for each
   token and group, with the members' number and sizes. A class is a candidate for a group
   that shares one of its tokens and fits in size: rows grow with classes times groups, never
   with pairs of classes.
3. Own groups. The candidates of each group are compared inside it. First bucketed token
   counts, a lower bound of the symmetric difference, drop most. Then token sets are sent; a
   class opens the group only if its overlap with the union of the others' tokens can reach
   what a link needs. Only links that connect something new are kept. The parts of one large
   group meet through the class most like all, which is compared in each.
4. Other groups. Candidates for other groups, where these hold another component at a
   shared token, are compared with that group's candidates in the same way.

Nothing is capped: a third of all documents in one group of copies is one class, and one of
near copies is joined by its own groups, after which no pair of them is a candidate.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import bound_batches, release, stable, stored, texts_of

SHINGLE = 5
PERCENT = 80
#: A group is cut into parts of about so many classes and tokens.
GROUP_MEMBERS, GROUP_TOKENS = 1024, 1 << 19
#: Counters of the sketch, and those in one of its blocks.
SLOTS, BLOCK = 1 << 24, 1 << 16
#: Minhash values of a class.
VALUES = 5
#: Buckets of the token counts that bound the symmetric difference.
BUCKETS = 256
#: Tokens whose counter in the sketch has so many bits are joined without a look at each other.
HOT_LEVEL = 17
#: Bits of the filter that picks the classes whose sets are read again.
FILTER_BITS = 1 << 26

_ODD = np.random.default_rng(20).integers(1 << 60, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
#: Base of the polynomial hash, odd, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A-Z lower-cased, white space as a space.
_FOLD = bytes(32 if 9 <= b <= 13 else b for b in range(256)).lower()


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(1 << 16, 2 * n)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; fewer words count as one shingle.

    A shingle's hash is a polynomial over its bytes, words parted by one space, taken from
    sums over the whole text; then mixed.
    """
    a = np.frombuffer(text.encode("utf-8", "replace").translate(_FOLD), np.uint8)
    if len(a):
        space = a == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        a = a[keep]
        a = a[: len(a) - (len(a) > 0 and a[-1] == 32)]
    if not len(a):
        return np.empty(0, np.uint64)
    gaps = np.flatnonzero(a == 32)
    up, down = _POWERS.to(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    n = len(gaps) + 2 - size
    if n < 1:
        starts, ends = np.zeros(1, np.int64), np.array([len(a)])
    else:
        starts, ends = np.empty(n, np.int64), np.empty(n, np.int64)
        starts[0], ends[-1] = 0, len(a)
        starts[1:] = gaps[: n - 1] + 1
        ends[:-1] = gaps[size - 1 :]
    out = (sums[ends] - sums[starts]) * down[starts]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    out.sort()
    keep = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]


def class_of(tokens: np.ndarray) -> int:
    """The signed 64-bit id of a set of tokens."""
    return int(np.int64(np.uint64(xxhash.xxh3_128_intdigest(tokens.tobytes()) & (2**64 - 1)).astype(np.int64)))


def minhashes(tokens: np.ndarray) -> list[int]:
    """``VALUES`` minima under multiplicative orders, in 32 bits."""
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    for i in range(0, len(tokens), 4096):
        np.minimum(least, (tokens[i : i + 4096, None] * _ODD).min(axis=0), out=least)
    return ((least >> np.uint64(32)).astype(np.int64) - (1 << 31)).tolist()


def histogram(tokens: np.ndarray) -> bytes:
    """Tokens by bucket, at most 255 each: ``BUCKETS`` bytes."""
    return np.minimum(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def add_counts(sketch: np.ndarray, tokens: np.ndarray) -> None:
    """Counts ``tokens`` in a sketch of bytes, which stay at 255: a byte a counter, as each
    task that runs holds a sketch."""
    at, counts = np.unique((tokens & np.uint64(len(sketch) - 1)).astype(np.uint32), return_counts=True)
    sketch[at] = np.minimum(sketch[at] + counts, 255)


_SIGNED = "id long, class long, n int, sig array<int>, buckets binary, block int, counts binary"


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """A row a document (id, class, n, sig, buckets) and rows of sketch blocks (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, held, n_held, seen = np.zeros(SLOTS, np.uint8), [], 0, set()

        def flush() -> None:
            nonlocal held, n_held
            if held:
                add_counts(sketch, np.concatenate(held))
            held, n_held = [], 0

        for batch, texts in texts_of(batches, "text"):
            classes, sizes, sigs, buckets = [], [], [], []
            for text in texts:
                tokens = shingles(text, size)
                sizes.append(len(tokens))
                if not len(tokens):
                    classes.append(None)
                    sigs.append(None)
                    buckets.append(None)
                    continue
                classes.append(key := class_of(tokens))
                sigs.append(None if key in seen else minhashes(tokens))
                buckets.append(None if key in seen else histogram(tokens))
                seen.add(key)
                held.append(tokens)
                n_held += len(tokens)
                if n_held > 500_000:
                    flush()
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.list_(pa.int32())), pa.array(buckets, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                _NAMES,
            )
        flush()
        for b in range(SLOTS // BLOCK):
            part = sketch[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                packed = zlib.compress(part.tobytes(), 1)
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([b], pa.int32()), pa.array([packed], pa.binary())], _NAMES)

    return docs.mapInArrow(run, _SIGNED)


_NAMES = [x.split()[0] for x in _SIGNED.split(", ")]


def _sketch(blocks: DataFrame) -> bytes:
    """The summed sketch as one byte a counter, the bit length of the count: ``SLOTS`` bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), np.uint8)
                if b in sums:
                    sums[b] += part
                else:
                    sums[b] = part.astype(np.uint32)
        for b, total in sums.items():
            level = np.frexp(total.astype(np.float64))[1].astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["block", "level"])

    out = np.zeros(SLOTS, np.uint8)
    for r in blocks.repartition("block").mapInArrow(add, "block int, level binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["level"], np.uint8)
    return out.tobytes()


def prefix_length(n: int, percent: int) -> int:
    """So many tokens of a set of n that one of them is in any set linked with it."""
    return n - (percent * n + 99) // 100 + 1


def short_length(n: int, percent: int) -> int:
    """The same against sets that are at least as large."""
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def _prefixes(docs: DataFrame, size: int, percent: int, sketch: bytes) -> DataFrame:
    """token, class, n, short and hot of the prefix tokens; once a class in a partition.

    ``short``: the token also counts against sets that are at least as large. ``hot``: very
    many documents may have it. Tokens are cut to 40 bits here: a false meeting only costs a
    comparison.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = np.frombuffer(shared.value, np.uint8), set()
        for _, texts in texts_of(batches, "text"):
            classes, sizes, lengths, parts, shorts, hots = [], [], [], [np.empty(0, np.uint64)], [np.empty(0, bool)], [np.empty(0, bool)]
            for text in texts:
                tokens = shingles(text, size)
                if not (n := len(tokens)) or (key := class_of(tokens)) in seen:
                    continue
                seen.add(key)
                rare = level[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
                order = np.argsort((rare << np.uint64(58)) | (tokens >> np.uint64(6)), kind="stable")
                order = order[: prefix_length(n, percent)]
                parts.append(tokens[order] >> np.uint64(24))
                hots.append(rare[order] >= HOT_LEVEL)
                shorts.append(np.arange(len(parts[-1])) < short_length(n, percent))
                classes.append(key)
                sizes.append(n)
                lengths.append(len(parts[-1]))
            columns = [
                pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), lengths)),
                pa.array(np.repeat(np.array(sizes, np.int32), lengths)), pa.array(np.concatenate(shorts)), pa.array(np.concatenate(hots)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["token", "class", "n", "short", "hot"])

    return docs.mapInArrow(run, "token long, class long, n int, short boolean, hot boolean")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class and whole token set of the ``wanted`` classes (and of a few others).

    A bit filter of fixed size picks them while the texts are read, so what is shuffled is a
    row for each picked class and partition.
    """
    place = F.col("class").bitwiseAND(FILTER_BITS - 1) + 1  # class ids are hashes themselves
    bits = wanted.select(place.alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
    filled = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.collect():  # FILTER_BITS bits at most
        at = (r["b"] - 1) * 4096
        filled[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(filled.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bit = set(), shared.value
        for _, texts in texts_of(batches, "text"):
            keys, parts = [], []
            for text in texts:
                tokens = shingles(text, size)
                if not len(tokens):
                    continue
                key = class_of(tokens)
                at = key & (FILTER_BITS - 1)
                if bit[at >> 3] >> (at & 7) & 1 and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    parts.append(tokens.view(np.int64))
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=offsets[1:])
            values = np.concatenate(parts) if parts else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["class", "tokens"])

    return docs.mapInArrow(run, "class long, tokens array<long>").dropDuplicates(["class"])


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node it is connected with, from edges (a, b) of longs.

    Least labels spread along edges and by pointer jumping until none changes; each round
    is kept in the shared folder. Isolated nodes aren't listed.
    """
    both = stable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        spread = stable(spread)
        to = spread.select(F.col("node").alias("_node"), F.col("new").alias("_label"))
        jumped = spread.join(to, spread["new"] == to["_node"], "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("_label", "new")).alias("label"))
        jumped = stable(jumped)
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


def _groups(classes: DataFrame) -> DataFrame:
    """class, grp and pivot of the classes that share a minhash value with another one.

    ``pivot`` is the class whose values are shared most, where the group is cut into parts.
    """
    keyed = classes.select("class", "n", F.posexplode("sig").alias("r", "key"))
    popular = keyed.groupBy("r", "key").agg(F.count("*").alias("members")).where("members > 1")
    best = keyed.join(popular, ["r", "key"]).groupBy("class").agg(
        F.first("n").alias("n"), F.sum("members").alias("liked"), F.max(F.struct("members", "r", "key")).alias("best")
    )
    named = best.select("class", "n", "liked", F.xxhash64("best.r", "best.key").alias("whole"))
    sizes = named.groupBy("whole").agg(F.count("*").alias("members"), F.sum("n").alias("tokens"), F.max(F.struct("liked", "class")).alias("most"))
    parts = F.greatest(F.ceil(F.col("members") / GROUP_MEMBERS), F.ceil(F.col("tokens") / GROUP_TOKENS))
    cut = named.join(sizes.withColumn("parts", parts), "whole").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    whole = F.col("parts") == 1
    return cut.select("class", F.when(whole, F.col("whole")).otherwise(F.xxhash64("whole", "part")).alias("grp"), F.when(~whole, F.col("most.class")).alias("pivot"))


def _met(prefixes: DataFrame, groups: DataFrame) -> DataFrame:
    """token, class, n, short, grp of the prefix tokens that two classes or more have.

    A token's rows come together once. Hot ones, few as they stand last in the order, are
    dealt by class as well and all kept, so none gathers in a task.
    """
    spread = F.when(F.col("hot"), F.col("class"))
    same = Window.partitionBy("token", "spread")
    marked = prefixes.withColumn("spread", spread).withColumn("low", F.min("class").over(same)).withColumn("high", F.max("class").over(same))
    met = marked.where("hot or low < high").select("token", "class", "n", "short").dropDuplicates(["token", "class"])
    return met.join(groups.select("class", "grp"), "class", "left").withColumn("grp", F.coalesce("grp", "class"))


def _candidates(met: DataFrame, percent: int, own: bool) -> DataFrame:
    """ga, gb, left, class: classes to be compared within one group (``own``) or between two.

    ``left``: the class is in ``ga``, the lower of the two. ``met`` has comp, the class's
    component so far; where a token's holders in a group are all of that component there is
    nothing to find.
    """
    n, small = F.col("n").cast("long"), F.min(F.when(F.col("short"), F.col("n").cast("long")))
    matrix = met.groupBy(F.col("token").alias("at"), F.col("grp").alias("with")).agg(
        F.count("*").alias("members"), F.min(n).alias("lo"), F.max(n).alias("hi"), small.alias("lo_short"), F.min("comp").alias("first"), F.max("comp").alias("last")
    )
    fits = (100 * n >= percent * F.col("lo")) & (100 * F.col("hi") >= percent * n)
    rare = (F.col("short") & (F.col("hi") >= n)) | (F.col("lo_short") <= n)
    other = (F.col("first") != F.col("comp")) | (F.col("last") != F.col("comp"))
    group = (F.col("grp") == F.col("with")) & (F.col("members") > 1) if own else F.col("grp") != F.col("with")
    found = met.join(matrix, (F.col("token") == F.col("at")) & group & fits & rare & other)
    return found.select(F.least("grp", "with").alias("ga"), F.greatest("grp", "with").alias("gb"), (F.col("grp") <= F.col("with")).alias("left"), "class").distinct()


def spanning(classes: np.ndarray, sets: list[np.ndarray], left: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked among ``sets`` of distinct tokens, and no more.

    With ``left``, only classes of different sides are compared. A class opens the group if
    its overlap with the token union of those it may link with reaches the least that a link
    needs; then its overlap with each of them is counted over an inverted index.
    """
    m, n = len(sets), np.array([len(t) for t in sets], np.int64)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who, common = np.repeat(np.arange(m), n), counts[ids] > 1
    ids, who = ids[common], who[common]
    begin = np.searchsorted(who, np.arange(m + 1))
    order = np.argsort(ids, kind="stable")
    holders, first = who[order], np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(counts)))])
    label, out = np.arange(m), []
    if left is None:
        asking, smallest = range(m - 1), [int(n.min())] * 2
    else:
        on_left = np.bincount(ids[left[who]], minlength=len(counts))
        on_right = np.bincount(ids[~left[who]], minlength=len(counts))
        asking = np.flatnonzero(left if left.sum() * 2 <= m else ~left).tolist()
        smallest = [int(n[side].min(initial=1 << 62)) for side in (left, ~left)]
    for q in asking:
        own = ids[begin[q] : begin[q + 1]]
        if left is not None:
            own = own[(on_right if left[q] else on_left)[own] > 0]
        least = max(smallest[int(left is not None and left[q])], -(-percent * n[q] // 100))
        if len(own) * (100 + percent) < percent * (n[q] + least):
            continue
        each = first[own + 1] - first[own]
        at = np.repeat(first[own] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        both = np.bincount(holders[at], minlength=m)
        links = 100 * both >= percent * (n + n[q] - both)
        if left is None:
            links[: q + 1] = False
        else:
            links &= left != left[q]
        links &= label != label[q]
        while links.any():
            other = int(np.argmax(links))
            out.append((int(classes[q]), int(classes[other])))
            label[label == label[other]] = label[q]
            links &= label != label[q]
        if (label == label[q]).all():
            break
    return out


def _by_pair(rows: DataFrame, schema: str, work: Callable[[bool, np.ndarray, np.ndarray, list], list]) -> DataFrame:
    """``work`` on the candidates of each pair of groups: whether it is one group, which are on
    the left, their classes and their last columns, binary or lists of longs, as arrays.

    ``rows`` has ga, gb, left, class and that column. A task gets the rows of a pair one
    after the other and holds one pair at a time.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def ended() -> pa.RecordBatch:
            left, classes = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            found = work(key, left, classes, [x for h in held for x in h[2]])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "left" else pa.int64()) for c, n in zip(found, names)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ga, gb, left, classes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            last = batch.column(4)
            if pa.types.is_binary(last.type):
                arrays = [np.frombuffer(x, np.uint8) for x in last.to_pylist()]
            else:
                offsets, values = last.offsets.to_numpy().tolist(), last.values.to_numpy()
                arrays = [values[i:j] for i, j in zip(offsets, offsets[1:])]
            cuts = np.flatnonzero((ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ga)]):
                if key != (int(ga[i]), int(gb[i])):
                    if held:
                        yield ended()
                    key, held = (int(ga[i]), int(gb[i])), []
                held.append((left[i:j].astype(bool), classes[i:j], arrays[i:j]))
        if held:
            yield ended()

    return rows.repartition("ga", "gb").sortWithinPartitions("ga", "gb").mapInArrow(run, schema)


def near(buckets: np.ndarray, left: np.ndarray | None, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of some sets may link with another one (of the other side), by their buckets.

    With s tokens together and d the sum of bucket differences (no more than the symmetric
    difference), a link needs d <= s (100 - p) / (100 + p).
    """
    own, keep = buckets.astype(np.int16), np.zeros(len(buckets), bool)
    for i in range(len(own)):
        apart = np.abs(own - own[i]).sum(axis=1, dtype=np.int64)
        close = apart * (100 + percent) <= (sizes + sizes[i]) * (100 - percent)
        close[i] = False
        keep[i] = (close if left is None else close & (left != left[i])).any()
    return keep


def _bounded(rows: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """The candidate ``rows`` that their buckets (class, buckets with the size) leave."""

    def work(key: tuple[int, int], left: np.ndarray, classes: np.ndarray, held: list[np.ndarray]) -> list:
        sizes = np.array([int.from_bytes(x[:4].tobytes(), "big") for x in held])
        keep = near(np.array([x[4:] for x in held]), None if key[0] == key[1] else left, sizes, percent)
        n = int(keep.sum())
        return [[key[0]] * n, [key[1]] * n, left[keep], classes[keep]]

    return _by_pair(rows.join(buckets, "class").select("ga", "gb", "left", "class", "buckets"), "ga long, gb long, left boolean, class long", work)


def _links(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Connecting links (a, b) within or between the groups of candidate ``rows``."""
    sets = _sets(docs, rows.select("class").distinct(), size)

    def work(key: tuple[int, int], left: np.ndarray, classes: np.ndarray, held: list[np.ndarray]) -> list:
        found = spanning(classes, held, None if key[0] == key[1] else left, percent) if len(held) > 1 else []
        return [[x[0] for x in found], [x[1] for x in found]]

    return stable(_by_pair(rows.join(sets, "class").select("ga", "gb", "left", "class", "tokens"), "a long, b long", work))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (id, n_shingles, component_id).

    ``component_id`` is the least id among the documents connected by links of Jaccard
    similarity ``percent`` / 100 or more. Null, empty and blank texts have no shingles and
    link with nothing: their component is their own id. Repeated rows are copies of each
    other. Null ids stay null and are never a component's id; a component of nothing else
    has a null id. Other columns aren't read; an empty table gives no rows. Hashes have 64
    bits: documents are confused with a probability of about their number squared / 2**65.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = stored(_signatures(own, size))
    documents = first.where("block is null").select("id", "class", "n")
    classes = first.where("sig is not null").groupBy("class").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    groups = stored(_groups(classes))
    sketch = _sketch(first.where("block is not null").select("block", "counts"))
    met = stored(_met(_prefixes(own, size, percent, sketch), groups))
    of_class = first.where("buckets is not null").groupBy("class").agg(F.first(F.concat(F.to_binary(F.lpad(F.hex("n"), 8, "0"), F.lit("hex")), "buckets")).alias("buckets"))
    release(docs.sparkSession)
    inside = stable(_candidates(met.withColumn("comp", F.col("class")), percent, own=True))
    pivots = groups.where("pivot is not null").join(inside.select(F.col("ga").alias("grp")).distinct(), "grp", "left_semi")
    pivots = pivots.select(F.col("grp").alias("ga"), F.col("grp").alias("gb"), F.lit(True).alias("left"), F.col("pivot").alias("class"))
    links = _links(stable(_bounded(inside.union(pivots).distinct(), of_class, percent)), own, size, percent)
    release(docs.sparkSession)
    label = components(links)
    met = met.join(label, met["class"] == label["node"], "left").withColumn("comp", F.coalesce("label", "class")).drop("node", "label")
    across = _links(stable(_bounded(_candidates(met, percent, own=False), of_class, percent)), own, size, percent)
    labels = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(across))
    at = documents.join(labels, documents["class"] == labels["node"], "left").select("id", "n", F.coalesce("label", "class").alias("label"))
    least = at.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    found = at.join(least, "label", "left")
    return found.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
