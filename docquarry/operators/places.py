"""Places in text: the forms of all names joined with the tokens of all texts.

What a name can look like (upper case, possessive, endings, prefixes) is made on the side of the
names, which are few; so finding them is one equi-join on tokens, whatever the rules. A form is
there where its tokens stand in a row with only spaces and hyphens between them. Of the forms
that begin at one place those of the least rank count, of them the longest; going from the left,
the next mention begins behind the last one. A form of several places keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import names
from docquarry.operators.fulltext import cut_sql
from docquarry.plans.registry import query
from docquarry.sources import corpus
from docquarry.sources.shared import kept, staged

_OCC = f"WITH RECURSIVE {corpus.SQL}"


def name_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id, position, start, token (with its case) and joined of each content's name tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("token", pa.string()), ("joined", pa.bool_())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [[{"start": s, "token": t, "joined": j} for s, t, j in names.name_tokens(text)] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, kind)], ["hash_id", "tokens"])

    def build() -> DataFrame:
        own = corpus.texts(spark, sf_dir).select("hash_id", "text").mapInArrow(run, "hash_id long, tokens array<struct<start: int, token: string, joined: boolean>>")
        rows = staged(own.join(corpus.content_ids(spark, sf_dir), "hash_id", "left_semi")).select("hash_id", F.posexplode("tokens").alias("position", "t"))
        return rows.select("hash_id", "position", "t.*").repartitionByRange("token", "hash_id").sortWithinPartitions("token", "hash_id", "position")

    return kept(spark, sf_dir, "name_postings", build)


def all_forms(gazetteer: DataFrame) -> DataFrame:
    """place_id, name, rank, method and tokens of every form of the names (place_id, name, language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, n, r, m, t) for p, n, language in zip(*(c.to_pylist() for c in batch.columns)) for r, m, t in names.forms(n or "", language or "")]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["place_id", "name", "rank", "method", "tokens"])

    return gazetteer.select("place_id", "name", "language").mapInArrow(run, "place_id long, name string, rank int, method string, tokens array<string>")


def mentions(index: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """hash_id, position, start, tokens (how many), method and place_ids of each mention.

    Spots of a content meet once; there is a row for each place a form begins at, and these are
    gone through in order in the row that holds them.
    """
    forms = all_forms(gazetteer).groupBy("tokens", "rank", "method").agg(F.sort_array(F.collect_set("place_id")).alias("place_ids"))  # as many as share a name
    forms = staged(forms.withColumn("form", F.monotonically_increasing_id()))
    asked = forms.select("form", "rank", F.size("tokens").alias("size"), F.posexplode("tokens").alias("ordinal", "token"))
    met = index.join(asked, "token").where((F.col("ordinal") == 0) | F.col("joined"))
    begin = (F.col("position") - F.col("ordinal")).alias("begin")
    whole = met.repartition("hash_id").groupBy("hash_id", "form", "rank", "size", begin).agg(F.count("*").alias("n"), F.min("start").alias("start")).where("n = size")
    spots = whole.groupBy("hash_id", "begin").agg(F.min_by(F.struct("rank", "size", "form", "start"), F.struct("rank", -F.col("size"))).alias("s"))
    line = spots.groupBy("hash_id").agg(F.array_sort(F.collect_list(F.struct("begin", "s.size", "s.form", "s.start"))).alias("spots"))  # of one content
    taken = F.expr(
        "aggregate(spots, named_struct('next', -1, 'kept', cast(array() as array<int>)), "
        "(a, x) -> if(x.begin >= a.next, named_struct('next', x.begin + x.size, 'kept', array_append(a.kept, x.begin)), a), a -> a.kept)"
    )
    kept_ = line.withColumn("kept", taken).select("hash_id", F.explode(F.expr("filter(spots, x -> array_contains(kept, x.begin))")).alias("x"))
    named = forms.select("form", "method", "place_ids")
    return kept_.select("hash_id", "x.begin", "x.start", "x.size", "x.form").join(named, "form").select("hash_id", F.col("begin").alias("position"), "start", F.col("size").alias("tokens"), "method", "place_ids")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id, name and language: the first word, and the first two, of each benchmark item."""
    own = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place_id"), F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).where("size(w) > 1")
    return own.select("place_id", F.explode(F.array(F.col("w")[0], F.concat_ws(" ", F.col("w")[0], F.col("w")[1]))).alias("name"), F.lit("en").alias("language"))


_NAME_TOKEN = r"[\p{L}\p{N}]+(?:'\p{L}[\p{L}\p{N}]*)*"
_MENTIONS_SQL = f"""{_OCC}, gaps AS (SELECT hash_id, CAST(0 AS BIGINT) AS gs, regexp_replace(text, '\\s+', ' ', 'g') AS g FROM contents
), cuts AS ({cut_sql("gaps", "g", _NAME_TOKEN, "hash_id, gs", "g", "gs")}
), nt AS (SELECT c.hash_id, s, part AS token, row_number() OVER w - 1 AS position, lag(s + length(part)) OVER w AS e FROM cuts c WINDOW w AS (PARTITION BY c.hash_id ORDER BY s)
), np AS (SELECT nt.*, e IS NOT NULL AND s > e AND trim(replace(substring(g, CAST(e + 1 AS BIGINT), CAST(s - e AS BIGINT)), '-', ' ')) = '' AS joined FROM nt JOIN gaps USING (hash_id)
), gz AS (SELECT item_id AS place_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark), nm AS (SELECT place_id, w[1:k] AS tk FROM gz, (VALUES (1), (2)) AS v(k) WHERE len(w) > 1
), fm AS (
  SELECT place_id, 0 AS rank, 'exact' AS method, tk FROM nm UNION ALL SELECT place_id, 1, 'latin.uppercase', list_transform(tk, lambda x: upper(x)) FROM nm WHERE list_transform(tk, lambda x: upper(x)) <> tk AND length(tk[1]) > 1
  UNION ALL SELECT place_id, 2, 'en.possessive', [tk[1] || '''s'] FROM nm WHERE len(tk) = 1 AND length(tk[1]) > 1
), ff AS (SELECT tk, rank, method, list_sort(list_distinct(list(place_id))) AS ids FROM fm GROUP BY tk, rank, method
), hit AS (
  SELECT a.hash_id, a.position AS b, a.s, len(tk) AS size, rank, method, ids FROM ff JOIN np a ON a.token = tk[1] LEFT JOIN np z ON z.hash_id = a.hash_id AND z.position = a.position + 1
  WHERE len(tk) = 1 OR (z.token = tk[2] AND z.joined)
), spot AS (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY b) AS k FROM (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY hash_id, b ORDER BY rank, size DESC) = 1)
), go AS (
  SELECT hash_id, k, b + size AS nxt, true AS took FROM spot WHERE k = 1
  UNION ALL SELECT p.hash_id, p.k, CASE WHEN p.b >= go.nxt THEN p.b + p.size ELSE go.nxt END, p.b >= go.nxt FROM go JOIN spot p ON p.hash_id = go.hash_id AND p.k = go.k + 1
), men AS (SELECT spot.* FROM spot JOIN go USING (hash_id, k) WHERE took)"""


@query(f"{_MENTIONS_SQL} SELECT hash_id, CAST(b AS INTEGER) AS position, CAST(s AS INTEGER) AS start, CAST(size AS INTEGER) AS tokens, method, array_to_string(ids, ',') AS place_ids FROM men")
def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of a gazetteer's names in the documents."""
    found = mentions(name_postings(spark, sf_dir), gazetteer(spark, sf_dir))
    return found.select("hash_id", "position", "start", "tokens", "method", F.concat_ws(",", F.col("place_ids").cast("array<string>")).alias("place_ids"))


@query(f"{_MENTIONS_SQL} SELECT place_id, count(*) FILTER (WHERE len(ids) = 1) AS identified, count(*) FILTER (WHERE len(ids) > 1) AS ambiguous, count(DISTINCT hash_id) AS contents FROM (SELECT hash_id, ids, unnest(ids) AS place_id FROM men) GROUP BY place_id")
def place_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each place, those of it alone and those it shares, and contents."""
    found = mentions(name_postings(spark, sf_dir), gazetteer(spark, sf_dir)).select("hash_id", F.size("place_ids").alias("k"), F.explode("place_ids").alias("place_id"))
    return found.groupBy("place_id").agg(F.count(F.when(F.col("k") == 1, 1)).alias("identified"), F.count(F.when(F.col("k") > 1, 1)).alias("ambiguous"), F.countDistinct("hash_id").alias("contents"))
