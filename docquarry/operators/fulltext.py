"""Full-text search over a positional index: stems, phrases, nearness, entities.

The index is two kept tables. Postings have a row for each token of each content: its ordinal
and its character, and whether it is a word or a kind of entity. They lie in the order of
the tokens, by ranges that also cut inside a common token, so a search reads the tokens that
it asks for and no token gathers in one task. The vocabulary has a row for each token with
its stem, in the order of the stems; stems are made there, once a token.

A search looks up the tokens of its stems, takes their postings, and brings the postings of a
content together once: a phrase is there where the places less the words' ordinals in the
phrase meet with all words, whatever the phrase's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import stems, tokens
from docquarry.plans.criteria import CriteriaError, parse_expression
from docquarry.plans.registry import query
from docquarry.sources import corpus
from docquarry.sources.shared import kept, staged

#: Tokens that a search names in its filter; more of them are joined instead.
NAMED_TOKENS = 2000
_WORD = "word"


def tokenized(texts: DataFrame) -> DataFrame:
    """(hash_id, tokens: start, token, kind) of each row of (hash_id, text); null is empty."""
    schema = pa.list_(pa.struct([("start", pa.int32()), ("token", pa.string()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a few texts at once: their tokens are larger than they are
                part = batch.slice(at, 64)
                made = [[{"start": s, "token": t, "kind": k} for s, t, k in tokens.tokens(text)] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, schema)], ["hash_id", "tokens"])

    return texts.mapInArrow(run, "hash_id long, tokens array<struct<start: int, token: string, kind: string>>")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id, position, start, token and kind of every token of the contents."""

    def build() -> DataFrame:
        own = tokenized(corpus.texts(spark, sf_dir).select("hash_id", "text")).join(corpus.content_ids(spark, sf_dir), "hash_id", "left_semi")
        rows = staged(own).select("hash_id", F.posexplode("tokens").alias("position", "t")).select("hash_id", "position", "t.start", "t.token", "t.kind")
        return rows.repartitionByRange("token", "hash_id").sortWithinPartitions("token", "hash_id", "position")

    return kept(spark, sf_dir, "postings", build)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, kind, contents, occurrences and stem (an entity's is the entity)."""

    def build() -> DataFrame:
        each = postings(spark, sf_dir).groupBy("token", "kind", "hash_id").agg(F.count("*").alias("n"))
        own = each.groupBy("token", "kind").agg(F.count("*").alias("contents"), F.sum("n").alias("occurrences"))
        made = stems.with_stem(own).withColumn("stem", F.when(F.col("kind") == _WORD, F.col("stem")).otherwise(F.col("token")))
        return staged(made).repartitionByRange("stem").sortWithinPartitions("stem", "token")

    return kept(spark, sf_dir, "vocabulary", build)


def stems_of(spark: SparkSession, text: str) -> list[tuple[int, str]]:
    """Ordinals and stems of the tokens of a search term, without stop words; ordinals count those."""
    found = tokens.tokens(text)
    rows = [(i, token, kind) for i, (_, token, kind) in enumerate(found) if token not in stems.STOP_WORDS]
    if not rows:
        return []
    made = stems.with_stem(spark.createDataFrame(rows, "i int, token string, kind string")).collect()  # as many as the term has words
    return sorted((r.i, r.stem if r.kind == _WORD else r.token) for r in made)


def of_stems(spark: SparkSession, sf_dir: str, wanted: list[str]) -> DataFrame:
    """hash_id, position and stem of the postings of the tokens with these stems."""
    words = vocabulary(spark, sf_dir).where(F.col("stem").isin(wanted)).select("token", "stem").distinct()
    few = words.limit(NAMED_TOKENS + 1).collect()
    own = postings(spark, sf_dir)
    if len(few) > NAMED_TOKENS:
        return own.join(words, "token").select("hash_id", "position", "stem")
    named = spark.createDataFrame(few, "token string, stem string")
    return own.where(F.col("token").isin([r.token for r in few])).join(F.broadcast(named), "token").select("hash_id", "position", "stem")  # NAMED_TOKENS rows


def _leaves(tree: tuple) -> Iterator[str]:
    if tree[0] == "term":
        yield tree[1]
    else:
        for part in tree[1:]:
            yield from _leaves(part)


def _evaluated(tree: tuple, flags: dict[str, Column], missing: bool = False) -> Column | None:
    """The tree over the flags of its terms; a term of nothing but stop words asks for nothing."""
    if tree[0] == "term":
        return F.lit(False) if missing and tree[1] in flags else flags.get(tree[1])
    parts = [x for x in (_evaluated(t, flags, missing) for t in tree[1:]) if x is not None]
    if not parts:
        return None
    return ~parts[0] if tree[0] == "not" else reduce((lambda a, b: a & b) if tree[0] == "and" else lambda a, b: a | b, parts)


def _needs_a_term(tree: tuple, known: set[str]) -> bool:
    """Whether the tree is false for a content with none of its terms."""
    if tree[0] == "term":
        return tree[1] in known
    if tree[0] == "not":
        return False
    parts = [_needs_a_term(t, known) for t in tree[1:] if any(x in known for x in _leaves(t))]
    return (any if tree[0] == "and" else all)(parts)


def match(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """hash_id of the contents that match an expression of words and quoted phrases, by stems.

    AND, OR, NOT, parentheses and quotes as in criteria. Stop words are left out of terms, but
    keep their places in phrases; an expression of nothing else is an error.
    """
    tree = parse_expression(text)
    terms = {leaf: stems_of(spark, leaf) for leaf in dict.fromkeys(_leaves(tree))}
    terms = {leaf: own for leaf, own in terms.items() if own}
    if not terms:
        raise CriteriaError("nothing to look for but stop words")
    if max(len(own) for own in terms.values()) > 60:
        raise CriteriaError("a phrase has 60 words at most")
    rows = [(n, at, stem, 1 << bit) for n, own in enumerate(terms.values()) for bit, (at, stem) in enumerate(own)]
    asked = spark.createDataFrame(rows, "term int, ordinal int, stem string, bit long")
    hits = of_stems(spark, sf_dir, sorted({r[2] for r in rows})).join(F.broadcast(asked), "stem")  # as many rows as the expression has words
    # one shuffle serves both aggregations
    placed = hits.select("hash_id", "term", (F.col("position") - F.col("ordinal")).alias("begin"), "bit").repartition("hash_id")
    whole = placed.groupBy("hash_id", "term", "begin").agg(F.bit_or("bit").alias("bits"))
    flags = [F.bool_or((F.col("term") == n) & (F.col("bits") == (1 << len(own)) - 1)).alias(f"has_{n}") for n, own in enumerate(terms.values())]
    found, names = whole.groupBy("hash_id").agg(*flags), {leaf: F.col(f"has_{n}") for n, leaf in enumerate(terms)}
    if not _needs_a_term(tree, set(terms)):
        found = corpus.content_ids(spark, sf_dir).join(found, "hash_id", "left").na.fill(False)
    return found.where(_evaluated(tree, names)).select("hash_id")


def near(spark: SparkSession, sf_dir: str, one: str, other: str, within: int) -> DataFrame:
    """hash_id, places of ``one`` with ``other`` at most ``within`` tokens away, and the least distance.

    Each place looks at the last and the next place of the other word only, in one pass over
    the places of a content in order, so no pairs are made.
    """
    (_, first), (_, second) = stems_of(spark, one)[0], stems_of(spark, other)[0]
    hits = of_stems(spark, sf_dir, [first, second])
    order = Window.partitionBy("hash_id").orderBy("position")
    own = F.when(F.col("stem") == second, F.col("position"))
    if first == second:
        before, after = F.lag(own).over(order), F.lead(own).over(order)
    else:
        before = F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first(own, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    away = F.least(F.col("position") - F.col("before"), F.col("after") - F.col("position"))
    placed = hits.withColumn("before", before).withColumn("after", after).where(F.col("stem") == first).withColumn("away", away).where(F.col("away") <= within)
    return placed.groupBy("hash_id").agg(F.count("*").alias("places"), F.min("away").alias("nearest"))


# --- the same in SQL


def cut_sql(source: str, text: str, pattern: str, extra: str, flags: str, start: str = "0") -> str:
    """Of a source: its columns ``extra``, and start and text of each match of a pattern."""
    marked = f"string_split(regexp_replace({text}, {literal(pattern)}, chr(1) || '\\0' || chr(1), '{flags}'), chr(1))"
    return (
        f"SELECT {extra}, s, part FROM (SELECT {extra}, i, part, base + coalesce(sum(length(part)) OVER (PARTITION BY {extra}, base ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s "
        f"FROM (SELECT {extra}, {start} AS base, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS part FROM (SELECT *, {marked} AS p FROM {source}))) WHERE i % 2 = 0"
    )


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FOUND = " UNION ALL ".join(
    f"SELECT hash_id, {rank} AS rank, '{kind}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(part) AS BIGINT) AS e FROM ({cut_sql('src', 't', pattern, 'hash_id', 'gi')})"
    for rank, (kind, pattern) in enumerate(tokens.ENTITIES.items())
)
POSTINGS_SQL = rf"""
src AS (SELECT hash_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t FROM contents
), spans AS (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY s, rank) AS k FROM ({_FOUND})
), fold AS (
  SELECT hash_id, k, s, e, kind, CAST(NULL AS BIGINT) AS os, CAST(NULL AS BIGINT) AS oe, CAST(NULL AS VARCHAR) AS okind FROM spans WHERE k = 1
  UNION ALL
  SELECT n.hash_id, n.k, CASE WHEN stays THEN r.s ELSE n.s END, CASE WHEN stays THEN r.e ELSE n.e END, CASE WHEN stays THEN r.kind ELSE n.kind END,
         CASE WHEN n.s >= r.e THEN r.s END, CASE WHEN n.s >= r.e THEN r.e END, CASE WHEN n.s >= r.e THEN r.kind END
  FROM fold r JOIN spans n ON n.hash_id = r.hash_id AND n.k = r.k + 1, LATERAL (SELECT n.s < r.e AND n.e - n.s <= r.e - r.s AS stays)
), ent AS (
  SELECT hash_id, os AS s, oe AS e, okind AS kind FROM fold WHERE os IS NOT NULL
  UNION ALL SELECT hash_id, s, e, kind FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY hash_id ORDER BY k DESC) = 1)
), edges AS (
  SELECT hash_id, coalesce(lag(e) OVER (PARTITION BY hash_id ORDER BY s), 0) AS gs, s AS ge FROM ent
  UNION ALL SELECT src.hash_id, coalesce(max(e), 0), length(any_value(t)) FROM src LEFT JOIN ent ON ent.hash_id = src.hash_id GROUP BY src.hash_id
), gaps AS (SELECT hash_id, gs, substring(t, gs + 1, ge - gs) AS g FROM edges JOIN src USING (hash_id) WHERE ge > gs
), plain AS ({cut_sql("gaps", "g", tokens.PLAIN_WORD, "hash_id, gs", "g", "gs")}
), toks AS (
  SELECT hash_id, CAST(s AS INTEGER) AS start, lower(part) AS token, 'word' AS kind FROM plain WHERE length(part) > 1 OR regexp_matches(part, '^[\p{{L}}\p{{N}}]$')
  UNION ALL SELECT hash_id, CAST(s AS INTEGER), lower(substring(t, s + 1, e - s)), kind FROM ent JOIN src USING (hash_id)
), post AS (SELECT hash_id, CAST(row_number() OVER (PARTITION BY hash_id ORDER BY start) - 1 AS INTEGER) AS position, start, token, kind FROM toks
), voc_in AS (SELECT token, kind, count(DISTINCT hash_id) AS contents, count(*) AS occurrences FROM post GROUP BY token, kind
), {stems.stem_sql("voc_in", "voc_made")}
, voc AS (SELECT token, kind, contents, occurrences, CASE WHEN kind = 'word' THEN stem ELSE token END AS stem FROM voc_made
), stemmed AS (SELECT hash_id, position, stem FROM post JOIN voc USING (token, kind))"""
_INDEX = f"WITH RECURSIVE {corpus.SQL}, {POSTINGS_SQL}"


@query(f"{_INDEX} SELECT hash_id, position, start, token, kind FROM post WHERE kind <> 'word'")
def index_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entities of the contents with their places among the tokens and characters."""
    return postings(spark, sf_dir).where(F.col("kind") != _WORD).select("hash_id", "position", "start", "token", "kind")


@query(f"{_INDEX} SELECT kind, count(*) AS tokens, CAST(sum(occurrences) AS BIGINT) AS occurrences, max(contents) AS most_contents FROM voc GROUP BY kind")
def index_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens and occurrences of each kind."""
    return vocabulary(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("tokens"), F.sum("occurrences").alias("occurrences"), F.max("contents").alias("most_contents"))


@query(f"{_INDEX} SELECT hash_id, CAST(count(*) AS BIGINT) AS tokens, max(start) AS last_start, CAST(sum(CAST(position AS BIGINT) * start) AS BIGINT) AS weighed FROM post GROUP BY hash_id")
def index_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each content, where the last one starts, and a sum over all their places."""
    weighed = F.sum(F.col("position").cast("long") * F.col("start"))
    return postings(spark, sf_dir).groupBy("hash_id").agg(F.count("*").alias("tokens"), F.max("start").alias("last_start"), weighed.alias("weighed"))


@query(f"{_INDEX} SELECT stem, count(*) AS words, min(token) AS first, max(token) AS last, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM voc WHERE kind = 'word' GROUP BY stem HAVING count(*) > 1")
def stem_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of more than one word."""
    own = vocabulary(spark, sf_dir).where(F.col("kind") == _WORD).groupBy("stem")
    return own.agg(F.count("*").alias("words"), F.min("token").alias("first"), F.max("token").alias("last"), F.sum("occurrences").alias("occurrences")).where("words > 1")


def _has(stem: str) -> str:
    return f"(hash_id IN (SELECT hash_id FROM stemmed WHERE stem = '{stem}'))"


def _adjacent(*placed: tuple[int, str]) -> str:
    joins = " ".join(f"JOIN stemmed s{i} ON s{i}.hash_id = s0.hash_id AND s{i}.position = s0.position + {at - placed[0][0]} AND s{i}.stem = '{stem}'" for i, (at, stem) in enumerate(placed) if i)
    return f"(hash_id IN (SELECT s0.hash_id FROM stemmed s0 {joins} WHERE s0.stem = '{placed[0][1]}'))"


_CONTENTS = f"{_INDEX} SELECT hash_id FROM contents WHERE "


@query(_CONTENTS + f"({_has('idiot')} OR {_has('licens')}) AND NOT {_has('trash')}")
def fulltext_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents by a boolean expression over stems."""
    return match(spark, sf_dir, "(idiots OR licensed) AND NOT trash")


@query(_CONTENTS + _adjacent((0, "licens"), (3, "apach"), (4, "licens")))
def fulltext_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with a phrase by stems; stop words in it only keep their places."""
    return match(spark, sf_dir, '"license under the Apache licensing"')


@query(_CONTENTS + f"NOT {_has('licens')} AND NOT {_adjacent((0, 'heap'), (1, 'trash'))}")
def fulltext_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that lack a word and a phrase: all others are asked too."""
    return match(spark, sf_dir, 'NOT licenses AND NOT "heap trash"')


@query(
    f"{_INDEX}, a AS (SELECT hash_id, position FROM stemmed WHERE stem = 'licens'), d AS (SELECT a.hash_id, a.position, min(abs(a.position - b.position)) AS away FROM a JOIN stemmed b ON b.hash_id = a.hash_id AND b.stem = 'apach' GROUP BY ALL) "
    "SELECT hash_id, count(*) AS places, min(away) AS nearest FROM d WHERE away <= 4 GROUP BY hash_id"
)
def fulltext_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one word near another one."""
    return near(spark, sf_dir, "licenses", "apache", 4)


@query(
    f"{_INDEX}, {corpus.KEYWORDS_SQL}, w AS (SELECT hash_id, list(token ORDER BY position) AS ts FROM post GROUP BY hash_id), seat AS (SELECT hash_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM w) "
    "SELECT keyword_id, hash_id, count(*) AS n, CAST(min(i) - 1 AS INTEGER) AS first_position FROM seat JOIN kw ON array_to_string(list_slice(ts, i, i + len(string_split(phrase, ' ')) - 1), ' ') = phrase GROUP BY keyword_id, hash_id"
)
def keyword_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of all keywords, single words and phrases, from the index alone."""
    return phrase_hits(postings(spark, sf_dir), spark.createDataFrame(corpus.KEYWORDS, "keyword_id int, phrase string"))


def phrase_hits(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """keyword_id, hash_id, n and first_position of the ``phrases`` (keyword_id, phrase) as they stand.

    All phrases are looked for at once: each word of each phrase meets its postings, and what
    begins at one place with all the words of a phrase is an occurrence.
    """
    parts = phrases.select("keyword_id", F.posexplode(F.split("phrase", " ")).alias("ordinal", "token"), F.size(F.split("phrase", " ")).alias("size"))
    met = index.join(parts, "token").groupBy("hash_id", "keyword_id", "size", (F.col("position") - F.col("ordinal")).alias("begin")).agg(F.count("*").alias("words"))
    return met.where("words = size").groupBy("keyword_id", "hash_id").agg(F.count("*").alias("n"), F.min("begin").alias("first_position"))
