"""Fingerprints and their components against brute force over every pair."""

import re

import numpy as np
import pytest
import xxhash

from docquarry.llm import golay_dedup, registry

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(id, fingerprint) rows to the least id reachable, by every pair."""
    fps = np.array([fp for _, fp in rows], np.uint64)
    label = np.arange(len(rows))
    for i in range(len(rows)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2)
        for other in set(label[near].tolist()) - {label[i]}:
            label[label == other] = label[i]
    least = {}
    for (key, _), at in zip(rows, label.tolist()):
        if key is not None:
            least[at] = min(key, least.get(at, key))
    return sorted(((key, fp, least.get(at)) for (key, fp), at in zip(rows, label.tolist())), key=repr)


def test_code_is_perfect():
    rng = np.random.default_rng(1)
    index = rng.integers(0, 1 << 12, 500)
    word = index << 11 | golay_dedup._REMAINDER[index]
    for errors in range(4):
        flips = np.array([sum(1 << b for b in rng.choice(23, errors, replace=False)) for _ in index], np.int64)
        assert (golay_dedup.codeword_index(word ^ flips) == index).all()


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_near_fingerprints_share_a_key(bits):
    rng = np.random.default_rng(bits)
    own = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in own], np.uint64)
    keys = [set() for _ in own]
    for key, row in zip(*golay_dedup.keys_of(own)):
        keys[row].add(int(key))
    shared = [False] * len(own)
    for key, row in zip(*golay_dedup.keys_of(own ^ flips)):
        shared[row] |= int(key) in keys[row]
    assert all(shared)


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_connect_as_all_pairs_do(spark, bucket):
    """Dense clusters, so that buckets of every size occur; each way of comparing them."""
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 8), replace=False) * 5) for _ in range(1500)]
    fps = np.unique(np.concatenate([seeds[rng.integers(0, 12, 1500)] ^ np.array(flips, np.uint64), rng.integers(0, 1 << 64, 200, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    label = {r.node: r.label for r in golay_dedup.components(golay_dedup.links(frame, bucket)).collect()}
    got = {}
    for x in fps.view(np.int64).tolist():
        got.setdefault(label.get(x, x), set()).add(x)
    want = {}
    for key, _, least in brute_components(list(enumerate(fps.tolist()))):
        want.setdefault(least, set()).add(int(fps.view(np.int64)[key]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = registry.QUERIES["op11_simhash"](spark, SF)
    assert found.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    got = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found.collect()), key=repr)
    assert got == brute_components(rows) and len({c for _, _, c in got}) < len(got)


def test_odd_input(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [
        (9, None, "x", 1), (None, "some text here", None, None), (2, "", "y", 2), (3, " \n\t ", "y", 2), (4, long, "z", 3), (7, long.upper(), "b", 2),
        (5, "one two", "a", 1), (5, "one two", "a", 1), (6, "One\tTWO", "b", 2), (None, None, None, None), (8, "Été çà 漢字 \U0001f600 tail", "c", 0), (10, "one two\x1cthree four", "a", 1),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string, id string, fp int")
    got = sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in golay_dedup.near_duplicates(frame).collect()), key=repr)
    assert got == brute_components([(t[0], plain_fingerprint(t[1])) for t in texts])
    assert golay_dedup.near_duplicates(frame.limit(0)).count() == 0
