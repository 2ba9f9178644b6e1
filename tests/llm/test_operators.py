"""Each operator against brute force, round trips or held-out rows, and on awkward input."""

import hashlib
import itertools
import re
import struct
import time
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm import chat, decontamination, dom, html_extraction, images, language_model, media, packing, registry, sharding, similarity_join, toxicity, url_filter
from docquarry.llm.labelled_pages import labelled_pages

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, clashing columns."""
    rows = [
        (1, None, "x", 1), (None, "some text here, with words and more of them", None, None), (2, "", "y", 2), (3, " \n\t ", "y", 2), (4, LONG, "z", 3),
        (5, "one two", "a", 1), (5, "one two", "a", 1), (6, "One TWO", "b", 2), (7, LONG, "b", 2), (None, None, None, None), (8, "Été çà 漢字 \U0001f600 tail", "c", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, row int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


# --- toxicity


def test_toxicity(spark):
    docs = spark.createDataFrame([(i, f"plain words here {i} and there" + (" nasty" if i % 5 == 0 else "")) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in got)


def test_toxicity_odd_input(spark, odd, empty):
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, toxic int")
    for labels in (none, none.limit(0)):
        model = toxicity.train(odd, labels)
        assert all(0 <= r.score < 0.5 for r in toxicity.score_documents(odd, model).collect())
    assert toxicity.score_documents(empty, model).count() == 0


def test_toxicity_held_out(spark):
    rows = registry.op1_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    caught = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    wrong = sum(r.predicted for r in rows if not r.toxic) / sum(1 - r.toxic for r in rows)
    assert caught > 0.85 and wrong < 0.01


# --- chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_end|>", "a\nb%0A"]), st.text(alphabet="<|im_endstar>\\ \n", max_size=40)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    t = chat.Template()
    segments = [s for role, text in turns for s in t.segments(role, text)]
    got = list(t.parse(segments))
    assert [(r, x) for r, x, _ in got] == turns
    assert [u for _, _, u in got] == [x if r == "assistant" else "" for r, x in turns]


def test_chat_odd_input(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, None, None, "x"), (2, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'q' AS loss", "1 AS part")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert (got[1].n_turns, got[1].valid, got[1].first_error) == (3, False, 0)
    assert got[None].n_turns == 1 and got[2].loss_chars == 1 and not got[2].valid
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.Template(start="aa")


# --- language model


def test_language_model(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text")
    model, counts = language_model.train(docs, registry.id_mod("id", 7) != 2)
    n = sum(r.n for r in counts.collect())
    assert n == model.total
    scored = language_model.score_documents(docs, model, counts).collect()
    assert len(scored) == docs.count() and all(r.score < 0 for r in scored)
    trained = [r for r in scored if zlib.crc32(str(r.id).encode()) % 7 != 2]
    assert sum(r.score for r in trained) > sum(r.base_score for r in trained)
    strange = language_model.score_documents(odd.selectExpr("doc_id AS id", "text"), model, counts).collect()
    assert len(strange) == 11 and all(np.isfinite(r.score) for r in strange)
    again, none = language_model.train(empty.selectExpr("doc_id AS id", "text"), registry.id_mod("id", 7) != 2)
    assert all(np.isfinite(r.score) for r in language_model.score_documents(odd.selectExpr("doc_id AS id", "text"), again, none).collect())


def test_language_model_held_out(spark):
    """The base score and its counts from scratch; the model is better on texts it hasn't seen."""
    rows = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    tokens = {k: [*words(t), None] for k, t in rows.items()}
    held = {k for k in rows if zlib.crc32(str(k).encode()) % 7 == 2}
    counts = defaultdict(int)
    for k in rows.keys() - held:
        for w in tokens[k]:
            counts[w] += 1
    n = sum(counts.values())
    got = {r.doc_id: r for r in registry.op3_language_model(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == rows.keys()
    for k, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k in held, len(tokens[k]), sum(w in counts for w in tokens[k]), n)
        assert abs(r.base_score - sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in tokens[k])) < 1e-6 * len(tokens[k])
    assert sum(got[k].score for k in held) > 0.9 * sum(got[k].base_score for k in held)


def test_repetition_is_coded_in_order(spark):
    """Followers, runs and their adaptive bits against a walk through the texts, token by token."""
    docs = spark.createDataFrame([(i, f"a b c d e f g h{i % 3} a b c d e x{i} a b") for i in range(9)] + [(9, "a"), (10, "")], "id long, text string")
    model, _ = language_model.train(docs, registry.id_mod("id", 7) != 2)
    scorer, v = language_model.Scorer(model), model.vocabulary
    split = [language_model.words_of(t) for t in ("a b c d zz yy a b c d zz yy a b c zz yy q", "", "a b", "zz yy zz yy zz yy zz")]
    coded = [scorer.coder.tokens(w, scorer.coder.look_up(w)) for w in split]
    what, sizes = np.concatenate([c[3] for c in coded]), np.array([len(c[3]) for c in coded])
    begin = np.cumsum(sizes) - sizes
    hit, cost = scorer.repeated(what, np.repeat(np.arange(len(sizes)), sizes), begin)
    key, mask = language_model.pairs_before(what, begin), (1 << 18) - 1
    for start, size in zip(begin, sizes):
        own, run, seen = {}, 0, {}
        for i in range(start, start + size):
            guess, source = None, 0
            if i - start > 1:
                slot, check = language_model._entry(key[i : i + 1], len(model.tables[2]))
                entry = int(model.tables[2][slot][0])
                if entry & mask and entry & ~mask == int(check[0]):
                    guess, source = (entry & mask) - 1, 1
                pair = (what[i - 2], what[i - 1])
                if pair in own:
                    guess, source = own[pair], 2
                own[pair] = what[i]
            if source:
                kind = (source - 1) * 4 + (run > 0) + (run > 3) + (run > 15)
                yes, no = seen.setdefault(kind, list(language_model._BEGIN[kind]))
                right = guess == what[i]
                assert hit[i] == right and np.isclose(cost[i], np.log((yes if right else no) / (yes + no)))
                seen[kind][0 if right else 1] += 1
            else:
                right = False
                assert not hit[i] and cost[i] == 0
            run = run + 1 if right else 0
    assert v.escape == len(v.counts)


def test_language_model_counts_are_exact(spark):
    """A hot slot keeps its share of ones, in one task or over several."""
    table = np.zeros(2 * 1024, np.uint32)
    table[:6] = 900_000, 100_000, 70_000, 3_000_000_000, 1, 2
    packed = [tuple(batch.column(i)[0].as_py() for i in range(3)) for _ in range(3) for batch in language_model._blocks(0, table)]
    found = language_model._stretched(spark.createDataFrame(packed, language_model.BLOCKS), [1024])[0]
    total = 3 * table.astype(np.int64)
    assert (found == language_model.level_of(total[0::2], total[1::2])).all() and found[0] >> 2 == round(16 * np.log(1 / 9))


def test_huffman_is_a_code():
    starts, lengths, *_ = language_model._huffman([5, 1, 1, 9, 30, 2])
    assert abs(sum(2.0 ** -int(k) for k in lengths) - 1) < 1e-12


# --- sharding


@given(st.integers(1, 3000), st.integers(0, 2**63))
@settings(max_examples=40, deadline=None)
def test_feistel(n, seed):
    p = sharding.FeistelPermutation(n, seed)
    place = p.place(np.arange(n))
    assert sorted(place.tolist()) == list(range(n))
    assert (p.row(place) == np.arange(n)).all()


def test_sharding(odd, empty):
    rows = sharding.assign_shards(odd, 4).collect()
    assert len(rows) == 11
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.shard, r.slot) == tuple(int(x) for x in sharding.locate([r.row], 11, 4) for x in x)
        assert int(sharding.row_at(r.shard, r.slot, 11, 4)) == r.row
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r.size for r in rows if r.id == 1} == {1} and all(r.text_crc32 == zlib.crc32(b"one two") for r in rows if r.id == 5)
    assert sharding.assign_shards(empty, 4).count() == 0


# --- html


def test_html_held_out():
    model, right, total = html_extraction.default_model(), 0, 0
    from docquarry.llm import dom

    for page in labelled_pages(60, seed=1234):
        tree = dom.parse(page)
        labels = html_extraction._labels(tree)
        for node, y, got in zip(tree.nodes, labels, model.content(tree)):
            total += node.chars > 0
            right += node.chars > 0 and y == got
    assert right / total > 0.98


def test_tree_marginals_are_exact():
    """Sum-product against the sum over all labelings."""
    from itertools import product

    from docquarry.llm import dom

    model = html_extraction.default_model()
    tree = dom.parse("<body><div class=menu><a href=x>y</a></div><article><p>Some words here, with more.</p></article></body>")
    full, _, _ = model.messages(tree)
    mass, on = 0.0, np.zeros(len(tree.nodes))
    for ys in product((0, 1), repeat=len(tree.nodes)):
        s = sum(model.potential(x) * y for x, y in zip(tree.nodes, ys))
        s += sum(model.edge(x)[2 * ys[x.parent] + ys[i]] for i, x in enumerate(tree.nodes) if i)
        mass += np.exp(s)
        on += np.exp(s) * np.array(ys)
    assert np.allclose(on / mass, 1 / (1 + np.exp(-np.array(full))))


def test_html_keeps_what_is_not_raw():
    text = lambda html: dom.text_of(tree := dom.parse(html), [True] * len(tree.nodes))
    for tag in "math object canvas audio video noscript svg select".split():
        assert text(f"<p>one</p><{tag}>two</{tag}><p>three</p>").split() == ["one", "two", "three"]
    for tag in "math object svg select template iframe".split():
        assert "three" in text(f"<p>one</p><{tag}><p>three</p>").split()
    assert text("<p>one</p><script>two</script><p>three</p><style>four").split() == ["one", "three"]
    assert text("<p>a <math><mi>x</mi><mspace/><mo>=</mo><mn>2</mn></math> b</p><p>c</p>") == "a x=2 b\nc"
    assert text('<div><svg><path d="m"/><text>two</text></svg><svg/>three</div>').split() == ["two", "three"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p title=it's>First words here.</p>", "First words here."), ('<p class="a"">First words.</p>', "First words."), ('<a title = "x > y">told</a>', "told"), ("<div data-x='{\"a\":\">\"}'>in</div>", "in"),
        ('<p title="open>words</p>', "words"), ("<p it's>a</p>", "a"), ('<p a="x"b="y">c</p>', "c"), ('<a onclick=f("x")>go</a>', "go"),
    ],
)
def test_html_stray_quotes(html, text):
    """A quote is one behind an equals sign; no tag is left in the text for it."""
    tree = dom.parse(html)
    assert dom.text_of(tree, [True] * len(tree.nodes)) == text


@pytest.mark.parametrize("unit", ["<a ", "<a '", '<a x="', "<!", "<iframe>", "<template>", "<b></i>", "<div><li></li>", "</p>", "<svg/>", "<p x=\"<>\" ", "&#"])
def test_html_parser_is_linear(unit):
    """A megabyte of what is never closed, in seconds."""
    began = time.process_time()
    page = dom.parse("<p>first</p>" + unit * (1_000_000 // len(unit)) + "<p>last</p>")
    assert time.process_time() - began < 20 and page.pieces[0][2] == "first"


def test_html_odd_input(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p>a &amp; b<br>c"), (2, "u", "<"), (3, "u", "<article><p>" + "long words, here. " * 20_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'t' AS text")
    got = [(r.id, r.text) for r in html_extraction.extract_pages(df).collect()]
    assert got[0] == (1, "") and got[1] == (None, "") and len(got[4][1]) > 300_000
    assert html_extraction.extract_pages(df.limit(0)).count() == 0


# --- decontamination


def test_decontamination_spans(spark):
    docs = spark.createDataFrame([(1, "Pre. ÉTÉ One, two-THREE four five six seven eight nine ten! post"), (2, "ten nine")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten"), (8, None), (9, "Ten Nine"), (None, "...")], "item_id long, text string")
    got = {r.id: r for r in decontamination.scan_documents(docs, bench).collect()}
    text = docs.first().text
    assert [text[s.start : s.end] for s in got[1].spans] == ["One, two-THREE four five six seven eight nine ten"]
    assert got[1].item_ids == ["7"] and got[1].n_hit == 10 and got[2].item_ids == ["9"]


def test_decontamination_in_parts(spark, monkeypatch):
    """A benchmark beyond one automaton gives the same in several."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(repr, decontamination.scan_documents(docs, bench).collect()))
    clean = {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "MAX_ITEM_CHARS", 3000)
    assert len(decontamination.benchmark_parts(bench)) > 2
    assert sorted(map(repr, decontamination.scan_documents(docs, bench).collect())) == whole
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()} == clean


def test_decontamination_odd_input(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    got = decontamination.scan_documents(odd, bench).collect()
    assert len(got) == 11 and sorted(r.id for r in got if r.n_hit) == [5, 5, 6]
    assert decontamination.scan_documents(empty, bench).count() == 0
    assert all(r.n_hit == 0 for r in decontamination.scan_documents(odd, bench.limit(0)).collect())


# --- similarity join


def brute(rows, percent=80):
    """Components by comparing all pairs; ids may repeat."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((key, len(sets[i]), low[root(i)]) for i, (key, _) in enumerate(rows)), key=repr)


def test_similarity_join_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"t{i}" for i in range(400)]
    passage = [str(x) for x in rng.choice(vocabulary, 60)]
    rows = []
    for base in range(25):
        text = [str(x) for x in rng.choice(vocabulary, rng.integers(20, 200))] + (passage if base % 3 == 0 else [])
        for _ in range(rng.integers(1, 8)):
            copy = list(text)
            for _ in range(rng.integers(0, 9)):
                copy[rng.integers(len(copy))] = "edit" + str(rng.integers(1000))
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in similarity_join.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)


def test_similarity_join_large_groups(spark, monkeypatch):
    """Groups cut into parts, of copies near one text, copies near each other and chains."""
    monkeypatch.setattr(similarity_join, "GROUP_MEMBERS", 8)
    rng = np.random.default_rng(5)
    rows = []
    for base, edits in enumerate((1, 2, 3, 4)):
        text = [f"b{base}x{i}" for i in range(60)]
        for k in range(60):
            copy = list(text)
            for _ in range(edits):
                copy[rng.integers(60)] = f"e{rng.integers(6)}"
            if base == 3 and k % 2:  # each a little further from the first
                copy = [f"b3x{i + k // 4}" for i in range(60)]
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in similarity_join.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)


@given(st.lists(st.tuples(st.sets(st.integers(0, 12), min_size=1), st.booleans()), min_size=2, max_size=9), st.booleans())
@settings(max_examples=200, deadline=None)
def test_spanning_links(members, two_sides):
    """Just the links that connect what all pairs connect."""
    sets = [np.array(sorted(s), np.int64) for s, _ in members]
    left = np.array([x for _, x in members]) if two_sides else None
    found = similarity_join.spanning(np.arange(len(sets)), sets, left, 60)
    all_links = [
        (i, j) for i, (a, _) in enumerate(members) for j, (b, _) in enumerate(members[:i])
        if 100 * len(a & b) >= 60 * len(a | b) and (left is None or left[i] != left[j])
    ]

    def parts(links):
        label = list(range(len(sets)))
        for i, j in links:
            label = [label[j] if x == label[i] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    assert parts(found) == parts(all_links) and len(found) == len(sets) - len(parts(all_links))
    assert {tuple(sorted(x, reverse=True)) for x in found} <= set(all_links)


def test_similarity_join_odd_input(odd, empty):
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in similarity_join.near_duplicates(odd).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert similarity_join.near_duplicates(empty).count() == 0


@given(st.integers(1, 2000), st.integers(1, 2000))
@settings(max_examples=200, deadline=None)
def test_prefix_bounds(n, m):
    """A linked pair shares so much that the prefixes can't miss it."""
    n, m = max(n, m), min(n, m)
    for both in range(m + 1):
        if 100 * both >= 80 * (n + m - both):
            assert n - both < similarity_join.prefix_length(n, 80) and m - both < similarity_join.short_length(m, 80)


# --- language model, in parts


def test_language_model_levels():
    """What a level tells, and how many orders are known, by their plain definitions."""
    levels = np.arange(-512, 512, dtype=np.int16)
    assert language_model.value_of(levels).tolist() == [(x >> 2) / 16 for x in levels.tolist()]
    rng = np.random.default_rng(3)
    each = [rng.integers(-512, 512, 300).astype(np.int16) & np.int16(~3) | rng.integers(0, 2, 300).astype(np.int16) for _ in range(4)]
    want = [max([i + 1 for i in range(4) if each[i][k] & 3], default=0) for k in range(300)]
    assert language_model._known_orders(each).tolist() == want


def test_language_model_words():
    """Words from Arrow columns are those of each text, null and bytes beside ASCII included."""
    texts = ["a\tB  c ", " \n", None, "", "\u00c9 x\u00a0y\x0bz\x0cq\rA a", "\x1cA\x1d \x85b\x00c", "\u0130 A"]
    words = language_model.Words.of(pa.array(texts, pa.string()))
    listed, plain = words.listed(), [language_model.words_of(t or "") for t in texts]
    assert [listed[i] for i in words.place] == [w for own in plain for w in own]
    assert words.sizes.tolist() == [len(own) for own in plain] and len(set(listed)) == len(listed)
    some = words.only([0, 4])
    assert [listed[i] for i in some.place] == plain[0] + plain[4] and some.sizes.tolist() == [3, 6]
    assert not len(language_model.Words.of(pa.array([], pa.string())).sizes)


def test_language_model_contexts_are_counted_once(monkeypatch):
    """Equal tokens in equal contexts go down their path once, and count as often as they occur."""
    names = [b"\n", *(f"w{i}".encode() for i in range(40))]
    coder = language_model.Coder(language_model.Vocabulary.build(names, np.arange(90, 49, -1), 4000, 5), 1 << 12)
    rng = np.random.default_rng(5)
    context, ids = rng.integers(0, 4353, 12).astype(np.uint32)[rng.integers(0, 12, 3000)], rng.integers(0, 42, 3000)
    want = np.zeros(2 << 12, np.uint32)
    for c, i in zip(context, ids):
        of, step = coder.steps(np.array([i]))
        slot = coder.slots(np.array([c]), of, coder.v.mixed[step >> 1])
        np.add.at(want, 2 * slot.astype(np.int64) + (step & 1), np.uint32(1))
    walked, steps = [], language_model.Coder.steps
    monkeypatch.setattr(language_model.Coder, "steps", lambda self, ids: walked.append(len(ids)) or steps(self, ids))
    got = np.zeros(2 << 12, np.uint32)
    coder.count(got, language_model.paired(context, ids))
    assert (got == want).all() and sum(walked) == len(set(zip(context.tolist(), ids.tolist()))) <= 12 * 42


def test_spelling_codes_a_window_once(monkeypatch):
    """A byte costs by itself and the five before it: coded once, and as bit by bit, whatever is kept."""
    rng = np.random.default_rng(6)
    words = [b"".join(rng.choice([b"con", b"per", b"form", b"ed", b"\x00", b"\xc3\xa9"], 4).tolist()) for _ in range(300)]
    levels = [rng.integers(-512, 512, language_model.SPELL_SLOTS).astype(np.int16) for _ in language_model._SPELL_ORDERS]
    model = language_model.Model(language_model.Vocabulary.build([b"\n"], np.array([1]), 1, 0), [np.zeros(1, np.int16)] * 3, levels, 1, 1)
    word, bit, slots = language_model._spell_bits(words)
    found = [t[s.astype(np.int64)] for t, s in zip(levels, slots)]
    z = sum(model.spell_weights[language_model._known_orders(found), i] * (x >> 2) / 16 for i, x in enumerate(found))
    want = np.bincount(word, -np.log1p(np.exp((1 - 2 * bit.astype(float)) * z)))
    distinct = {(w + b" ")[max(0, i - 5) : i + 1].rjust(6, b"\0") for w in words for i in range(len(w) + 1)}
    coded, plain = [], language_model.Scorer.coded_windows
    monkeypatch.setattr(language_model.Scorer, "coded_windows", lambda self, windows: coded.append(len(windows)) or plain(self, windows))
    assert np.allclose(language_model.Scorer(model).spell(words), want, rtol=1e-5) and sum(coded) == len(distinct)
    monkeypatch.setattr(language_model, "_KEPT", 16)
    few = language_model.Scorer(model)
    for part in (words[:200], words[100:], words):
        assert np.allclose(few.spell(part), want[[words.index(w) for w in part]], rtol=1e-5)
    assert not len(few.spell([]))


def test_order_of_hashes():
    """Equal hashes stand together in order of place, also where unequal ones share their upper bits."""
    rng = np.random.default_rng(7)
    for keys in (rng.integers(0, 2**64, 500, np.uint64)[rng.integers(0, 500, 4000)], rng.integers(0, 9, 4000).astype(np.uint64), np.zeros(0, np.uint64)):
        order = language_model._order(keys)
        assert (np.sort(keys) == keys[order]).all()
        assert all(a < b for a, b in zip(order, order[1:]) if keys[a] == keys[b])


# --- media


def test_images_codec():
    picture = images.render(np.arange(64, dtype=np.float32))
    assert (images.decode(images.encode_png(picture)) == picture).all()
    assert images.decode(b"P5 2 1 255\n\x01\x02").tolist() == [[1, 2]]
    assert [images.decode(x) for x in (None, b"", b"junk", b"\x89PNG\r\n\x1a\nxx")] == [None] * 4


def _plain_png(rows, kinds):
    """A colour PNG written with a given filter for each row, straight from the format's rules."""
    h, w, _ = rows.shape
    out, up = b"", np.zeros(3 * w, int)
    for y in range(h):
        line = rows[y].reshape(-1).astype(int)
        left = np.concatenate([[0] * 3, line[:-3]])
        corner = np.concatenate([[0] * 3, up[:-3]])
        p = left + up - corner
        near = np.abs(np.stack([p - left, p - up, p - corner])).argmin(axis=0)
        guess = [0 * line, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kinds[y]]
        out += bytes([kinds[y]]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        up = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_images_png_filters():
    rows = np.random.default_rng(2).integers(0, 256, (12, 9, 3))
    got = images.decode(_plain_png(rows, [0, 1, 2, 3, 4, 4, 3, 1, 4, 2, 3, 0]))
    assert np.allclose(got, rows.mean(axis=2), atol=1e-3)
    big = np.random.default_rng(3).integers(0, 256, (512, 512, 3))
    began = time.process_time()
    images.decode(_plain_png(big, [4] * 512))
    assert time.process_time() - began < 5


def test_media_finds_planted_copies(spark):
    rows = registry.op8_media(spark, "/root/testdata/sf0.01").collect()
    planted = [r for r in rows if r.vec_id % 8 == 3]
    for how in range(4):
        some = [r for r in planted if r.vec_id // 8 % 4 == how]
        assert sum(r.component_id == r.vec_id - 1 for r in some) >= 0.9 * len(some)
    assert sum(r.n_links for r in rows) <= 2.1 * len(planted)


def _blobs(seed, side=120):
    """A smooth picture: unlike those that the operator draws."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side]
    out = np.zeros((side, side))
    for _ in range(150):
        cy, cx, s = *rng.uniform(0, side, 2), rng.uniform(1.5, 9)
        out += rng.normal() * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * s * s))
    return (out - out.min()) / (out.max() - out.min()) * 255


def _resized(a, by):
    """Each new pixel is the mean of nine places in the area it covers."""
    h, w = round(a.shape[0] * by), round(a.shape[1] * by)
    y, x = (np.arange(h)[:, None] + 0.5) / by - 0.5 + np.zeros((1, w)), (np.arange(w)[None, :] + 0.5) / by - 0.5 + np.zeros((h, 1))
    steps = np.array([-1, 0, 1]) / max(1, by) / 3 / by
    at = lambda y, x: a[np.clip(np.rint(y), 0, a.shape[0] - 1).astype(int), np.clip(np.rint(x), 0, a.shape[1] - 1).astype(int)]
    fine = np.kron(a, np.ones((3, 3)))
    k = 3 * by
    if by > 1:
        return sum(at(y + d, x + e) for d in (-0.33, 0, 0.33) for e in (-0.33, 0, 0.33)) / 9
    at = lambda y, x: fine[np.clip(np.rint(3 * y + 1), 0, fine.shape[0] - 1).astype(int), np.clip(np.rint(3 * x + 1), 0, fine.shape[1] - 1).astype(int)]
    return sum(at(y + d, x + e) for d in steps for e in steps) / 9


def _spun(a, degrees):
    """Turned about the centre, the mean of four nearest places each."""
    h, w = a.shape
    t, out = np.deg2rad(degrees), 0
    for dy in (-0.25, 0.25):
        for dx in (-0.25, 0.25):
            y, x = np.mgrid[:h, :w] + np.array([dy - (h - 1) / 2, dx - (w - 1) / 2])[:, None, None]
            v, u = np.cos(t) * y - np.sin(t) * x + (h - 1) / 2, np.sin(t) * y + np.cos(t) * x + (w - 1) / 2
            out = out + a[np.clip(np.rint(v), 0, h - 1).astype(int), np.clip(np.rint(u), 0, w - 1).astype(int)]
    return out / 4


EDITS = {
    "contrast and light": lambda a: np.clip(a * 0.75 + np.linspace(0, 40, a.shape[1]), 0, 255),
    "noise": lambda a: a + np.random.default_rng(1).normal(0, 8, a.shape),
    "crop to 70 %": lambda a: a[18:-18, 18:-18],
    "half crop": lambda a: a[:, : a.shape[1] // 2],
    "turned 15": lambda a: _spun(a, 15), "turned 30": lambda a: _spun(a, 30), "turned 45": lambda a: _spun(a, 45), "turned 90": lambda a: np.rot90(a),
    "size 0.5": lambda a: _resized(a, 0.5), "size 0.8": lambda a: _resized(a, 0.8), "size 1.5": lambda a: _resized(a, 1.5), "size 2": lambda a: _resized(a, 2),
}


def test_media_recall_by_edit(spark):
    """Copies by edits of this test's own, of two kinds of pictures; unlike ones stay apart."""
    rows, of = [], {}
    for i in range(20):
        base = _blobs(i) if i % 2 else images.render(np.full(8, i, np.float32), side=120, cell=5).astype(float)
        for k, edit in enumerate([lambda a: a, *EDITS.values()]):
            key = 100 * i + k
            of[key] = i
            rows.append((key, images.encode_png(np.clip(np.rint(edit(base)), 0, 255).astype(np.uint8))))
    got = {r.id: r for r in media.image_copies(spark.createDataFrame(rows, "id long, media binary").repartition(4)).collect()}
    assert all(of[r.component_id] == of[k] for k, r in got.items())
    found = {name: sum(got[100 * i + k].component_id == 100 * i for i in range(20)) / 20 for k, name in enumerate(EDITS, 1)}
    assert min(found.values()) >= 0.9, found


def test_media_tables_against_all_pairs(spark):
    """Of the pairs with enough votes, the tables find nearly all, the hot values too."""
    pictures = [images.render(np.full(8, i, np.float32)).astype(float) for i in range(12)]
    pictures += [np.clip(np.rint(_spun(p, 20)), 0, 255) for p in pictures] + [np.clip(pictures[0] + np.random.default_rng(k).normal(0, 9, pictures[0].shape), 0, 255) for k in range(25)]
    files = [(i, images.encode_png(np.rint(p).astype(np.uint8))) for i, p in enumerate(pictures)]
    described = media.describe(spark.createDataFrame(files, "class long, media binary")).cache()
    held = {r["class"]: np.frombuffer(r.corners, media.CORNER) for r in described.collect()}
    place = lambda c, k: np.stack([c["y"][k], c["x"][k]], axis=1).astype(float)
    want = set()
    for b in held:
        for a in range(b):
            i, j = images.matches(held[a]["bits"], held[b]["bits"], media.MOST_BITS)
            if images.votes(place(held[a], i), place(held[b], j)) >= max(media.LEAST_VOTES, media.LEAST_SHARE * min(len(held[a]), len(held[b]))):
                want.add((a, b))
    got = {(r.a, r.b) for r in media.consensus(media.alike(described), described).collect()}
    label = {n: n for n in held}
    for a, b in sorted(got):
        low, high = sorted((label[a], label[b]))
        label = {n: low if x == high else x for n, x in label.items()}
    assert got <= want and sum(label[a] == label[b] for a, b in want) >= 0.98 * len(want)


@pytest.mark.parametrize("cell", [256, 8])
def test_media_values_of_many_images_join_all(spark, monkeypatch, cell):
    """Images meet in every value that they share, however many others have it."""
    monkeypatch.setattr(media, "CELL", cell, raising=False)
    rng = np.random.default_rng(5)
    shared, rows = rng.integers(0, 256, (2, 32), np.uint8), []
    for k in range(40):
        corners = np.zeros(5, media.CORNER)
        corners["bits"] = np.concatenate([shared, rng.integers(0, 256, (3, 32), np.uint8)])
        rows.append((k, 5, corners.tobytes()))
    described = spark.createDataFrame(rows, "class long, n_corners int, corners binary")
    assert sorted((r.a, r.b) for r in media.alike(described).collect()) == list(itertools.combinations(range(40), 2))


def test_media_odd_input(spark):
    same = images.encode_png(images.render(np.ones(64, np.float32)))
    rows = [(1, None), (2, b""), (3, b"junk"), (4, b"junk"), (None, same), (6, same)]
    got = {r.id: r for r in media.image_copies(spark.createDataFrame(rows, "id long, media binary").selectExpr("*", "1 AS key")).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4, None, 6)] == [1, 2, 3, 3, 6, 6]
    assert media.image_copies(spark.createDataFrame([], "id long, media binary")).count() == 0


# --- packing


def test_packing_round_trip(spark, odd, empty):
    path = registry.tokenizer_path()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = packing.pack_documents(odd, path, 1, 256).collect()
    ids = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in odd.collect()}
    for r in rows:
        if r.id is not None:
            part = np.array(ids[r.id][r.start : r.start + r.length], "<u4").tobytes()
            assert zlib.crc32(part) == r.ids_crc32 and r.start == 256 * r.piece
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, path).count() == 0


def test_tokens_are_the_tokenizers_own():
    """Word by word where the file allows it, else whole: the ids are the plain tokenizer's."""
    from tokenizers import Tokenizer

    texts = ["Hello, World's end. 12 <|endoftext|> na\u00efve \u0130\u03a3 don't!!", "", "  \u00a0x\x1cy ", LONG[:2000]]
    for name, chunked in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        definition = open(registry.tokenizer_path(name), encoding="utf-8").read()
        assert packing.chunkable(definition) == chunked
        plain = Tokenizer.from_str(definition)
        found = list(packing.ChunkedTokenizer(definition).encode_batch(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_words_are_tokenized_once(monkeypatch):
    """Case and the punctuation behind don't make another word; columns give what lists give."""
    definition = open(registry.tokenizer_path(), encoding="utf-8").read()
    tokenizer, asked = packing.ChunkedTokenizer(definition), []
    for name in ("_letters", "_any"):
        monkeypatch.setattr(tokenizer, name, lambda word, own=getattr(tokenizer, name): asked.append(word) or own(word))
    texts = ["Word*** word&&& WORD$$$ word, word.%%%", "und\u00e4 Und\u00c4### <|endoftext|>", "", " "]
    found = [bytes(x) for x in tokenizer.encode_batch(texts)]
    assert sorted(x for x in asked if x) == sorted(["word", "***", "&&&", "$$$", ",", ".%%%", "und\u00e4", "###", "<|endoftext|>"])
    plain = tokenizer.tokenizer
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for kind, size in ((pa.string(), 1), (pa.string(), 20), (pa.large_string(), 1 << 20)):
        monkeypatch.setattr(packing, "BYTES_AT_ONCE", size)
        assert list(tokenizer.encode_column(pa.array(["x", *texts, None], kind)[1:])) == [*found, b""]
    assert list(tokenizer.encode_column(pa.array([], pa.string()))) == []


def test_batches_taken_together(monkeypatch):
    """Small batches are joined up to a bound; every row comes once, in order."""
    batches = [pa.RecordBatch.from_arrays([pa.array([k, None], pa.int64()), pa.array([f"a{k} b", None])], ["id", "text"]) for k in range(5)]
    for bound, parts in ((1, 5), (2 * batches[0].nbytes, 3), (1 << 20, 1)):
        monkeypatch.setattr(packing, "BYTES_AT_ONCE", bound)
        taken = list(packing._together(iter(batches)))
        assert len(taken) == parts
        assert [x for b in taken for x in b.to_pylist()] == [x for b in batches for x in b.to_pylist()]
    assert list(packing._together(iter([]))) == []


def test_letters_that_normal_form_parts():
    """A letter that becomes a letter and a mark: the mark belongs with the punctuation behind."""
    from tokenizers import Tokenizer

    definition = open(registry.tokenizer_path(), encoding="utf-8").read()
    texts = ["\u0958. \u095c!?", "x\u09df, X\u0a33... \ufb1d.", "e\u0301. \u1100\u1161, \u212a!"]
    found = list(packing.ChunkedTokenizer(definition).encode_batch(texts))
    plain = Tokenizer.from_str(definition)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_uses_every_piece(counts):
    plan, used = packing.plan_bins(counts, 64), defaultdict(int)
    load = defaultdict(int)
    for length, first, times, bin_, offset in plan.entries:
        assert first == used[length]
        used[length] += times
        for k in range(times):
            assert offset == load[bin_ + k]
            load[bin_ + k] += length
    assert dict(used) == counts and all(v <= 64 for v in load.values()) and len(load) == plan.bins


# --- urls


def test_urls(spark):
    rules = [url_filter.Rule("block", "bad.com/"), url_filter.Rule("allow", "good.org/"), url_filter.Rule("allow", "bad.com/ok")]
    rows = [
        (1, "http://bad.com/x", '<a href="http://other.net/">'), (2, "https://Sub.BAD.com/ok/1?q", None), (3, "http://friend.net/", "<a href='//bad.com/y'>"),
        (4, "http://GOOD.org", '<a href="http://fine.net/">'), (5, "http://fine.net/#x", ""), (6, None, None), (None, "no-scheme", None), (7, "http://friend.net/2", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS id")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect()}
    assert got[1][2:] == ("bad.com/", "block") and got[2] == ("sub.bad.com", "/ok/1", "bad.com/ok", "allow")
    assert got[3][2:] == (None, "block") and got[7][3] == "block"  # it links to a blocked host
    assert got[5] == ("fine.net", "/", None, "allow") and got[6] == ("", "", None, "allow") and got[None] == ("", "", None, "allow")
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_urls_chain_converges(spark):
    """A chain of 20 hosts to a blocked one, of which the last 9 are linked from a trusted host too."""
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(19)] + [(19, "http://bad.com/", "")]
    rows[18] = (18, "http://h18.net/", '<a href="//bad.com/">')
    rows.append((20, "http://good.org/", "".join(f'<a href="http://h{i}.net/">' for i in range(10, 19))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.judge_urls(df, [url_filter.Rule("block", "bad.com/"), url_filter.Rule("allow", "good.org/")]).collect()}
    hosts = sorted(got)
    links = {(f"h{i}.net", f"h{i + 1}.net"): 1.0 for i in range(18)} | {("h18.net", "bad.com"): 1.0} | {("good.org", f"h{i}.net"): 1.0 for i in range(10, 19)}

    def settled(seed, edges):
        share = np.zeros((len(hosts), len(hosts)))
        for (a, b), n in edges.items():
            share[hosts.index(b), hosts.index(a)] = n / sum(m for (c, _), m in edges.items() if c == a)
        return np.linalg.solve(np.eye(len(hosts)) - 0.85 * share, 0.15 * np.array([float(h == seed) for h in hosts]))

    trust, distrust = settled("good.org", links), settled("bad.com", {(b, a): n for (a, b), n in links.items()})
    for h, t, d in zip(hosts, trust, distrust):
        assert abs((got[h].trust or 0) - t) < 1e-5 and abs((got[h].distrust or 0) - d) < 1e-5
        if not got[h].rule:
            assert got[h].verdict == ("block" if d > t else "allow")
    assert [got[f"h{i}.net"].verdict for i in range(10)] == ["block"] * 10


# --- registered queries against SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    names = sorted(found.columns)
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, want.select(*names).fetchall()))


def test_chat_contract_row(spark):
    row = registry.op2_chat(spark, SF).where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.loss_chars == len(said)


def test_spelling_weights_are_learned_from_words_aside():
    """Weights stay those of the mean where nothing is known, and code like words in fewer bits."""
    words = [f"{a}{b}{c}".encode() for a in ("con", "per", "trans") for b in ("form", "port", "mit", "fer") for c in ("ed", "ing", "s", "")]
    tables = [np.zeros((language_model.SPELL_SLOTS, 2), np.int64) for _ in language_model._SPELL_ORDERS]
    for bit, slots in [language_model._spell_bits(words[::2])[1:]]:
        for table, slot in zip(tables, slots):
            np.add.at(table, (slot.astype(np.int64), bit.astype(np.int64)), 1)
    levels = [language_model.level_of(t[:, 0], t[:, 1]) for t in tables]
    weights, bits = language_model.tuned_spelling(words[1::2], levels, rounds=20)
    assert weights.shape == (5, 4) and bits.sum() == 20 * sum(8 * (len(w) + 1) for w in words[1::2])
    assert (weights[bits == 0] == language_model.mean_of_known()[bits == 0]).all()

    def cost(weights):
        model = language_model.Model(language_model.Vocabulary.build([b"\n"], np.array([1]), 1, 0), [np.zeros(1, np.int16)] * 3, levels, 1, 1, spell_weights=weights)
        return -language_model.Scorer(model).spell(words[1::2]).sum()

    assert cost(weights) < cost(language_model.mean_of_known())
    none, _ = language_model.tuned_spelling([], levels)
    assert (none == language_model.mean_of_known()).all()


def test_language_model_counts_from_every_source(spark, monkeypatch):
    """Counts of words with a path, of those sent as hashes, of joined ones and of unknown ones."""
    monkeypatch.setattr(language_model, "VOCABULARY", 40)
    monkeypatch.setattr(language_model, "COUNTED", 400)
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text")
    model, counts = language_model.train(docs, registry.id_mod("id", 7) != 2)
    rows = {r.id: words(r.text) for r in docs.collect()}
    count = defaultdict(int)
    for key, own in rows.items():
        if zlib.crc32(str(key).encode()) % 7 != 2:
            for w in [*own, "\n"]:
                count[w] += 1
    total, distinct = sum(count.values()), len(count)
    for r in language_model.score_documents(docs, model, counts).collect():
        own = [*rows[r.id], "\n"]
        assert r.n_known == sum(count.get(w, 0) > 0 for w in own)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (total + distinct + 1)) for w in own), rel=1e-9)
    kinds = sorted(count.values(), reverse=True)
    assert kinds[39] > kinds[400] > kinds[-1] == 1


def test_workers_forget_tokens(spark):
    """What a Python worker remembers of one task's words is gone when it is idle."""
    docs = spark.createDataFrame([(i, " ".join(f"x{i}y{k}" for k in range(3_000))) for i in range(8)], "doc_id long, text string")
    assert packing.tokenize_pieces(docs.repartition(4), registry.tokenizer_path()).count() >= 8

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.chunks) for t in packing._LOADED.values())], pa.int64())], ["n"])

    assert max(r.n for r in spark.range(4, numPartitions=4).mapInArrow(kept, "n long").collect()) == 0


def test_sketch_of_a_task_is_small():
    """A byte a counter; beyond 255 a counter stays there."""
    run = similarity_join._signatures(type("Frame", (), {"mapInArrow": lambda self, run, schema: run})(), 5)
    texts = ["a b c d e"] * 300 + ["f g h i j"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    rows = [x for out in run(iter([batch])) for x in out.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.concatenate([np.frombuffer(zlib.decompress(x["counts"]), np.uint8) for x in rows if x["block"] is not None])
    assert sorted(counts[counts > 0].tolist()) == [1, 255]
    assert peak < 2 * similarity_join.SLOTS
