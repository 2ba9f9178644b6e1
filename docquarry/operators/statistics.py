"""Corpus statistics: sizes, timelines, word frequencies, categories, measures of labels and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import measures
from docquarry.operators.filters import KEYWORD_SQL
from docquarry.plans.registry import query
from docquarry.sources import corpus

_OCC = f"WITH {corpus.SQL}"


@query(
    _OCC + " SELECT file_type, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS total_size, round(avg(file_size), 4) AS avg_size, min(file_size) AS min_size, max(file_size) AS max_size,"
    " count(*) FILTER (WHERE file_status = 'Read') AS read_files, round(count(*) FILTER (WHERE file_status = 'Read') * 100.0 / count(*), 2) AS read_rate FROM occ GROUP BY file_type"
)
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and sizes of each type, and how many were read."""
    read = F.count(F.when(F.col("file_status") == "Read", 1))
    return corpus.occurrences(spark, sf_dir).groupBy("file_type").agg(
        F.count("*").alias("files"), F.sum("file_size").alias("total_size"), F.round(F.avg("file_size"), 4).alias("avg_size"),
        F.min("file_size").alias("min_size"), F.max("file_size").alias("max_size"), read.alias("read_files"),
        measures.rate(read, F.count("*")).alias("read_rate"),
    )


@query(_OCC + " SELECT file_status, count(*) AS files FROM occ GROUP BY file_status")
def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by processing status."""
    return corpus.occurrences(spark, sf_dir).groupBy("file_status").agg(F.count("*").alias("files"))


def size_bucket(size: Column) -> Column:
    """Four size classes, with bounds of 1 000, 3 000 and 10 000 characters."""
    return F.when(size < 1000, "tiny").when(size < 3000, "small").when(size < 10_000, "medium").otherwise("large")


@query(_OCC + " SELECT CASE WHEN file_size < 1000 THEN 'tiny' WHEN file_size < 3000 THEN 'small' WHEN file_size < 10000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS total_size FROM occ GROUP BY 1")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by size class."""
    return corpus.occurrences(spark, sf_dir).groupBy(size_bucket(F.col("file_size")).alias("bucket")).agg(F.count("*").alias("files"), F.sum("file_size").alias("total_size"))


def _timeline(unit: str):
    part = {"hour": "strftime(ts, '%Y-%m-%d %H')", "day": "strftime(ts, '%Y-%m-%d')", "month": "strftime(ts, '%Y-%m')"}[unit]
    form = {"hour": "yyyy-MM-dd HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = corpus.table(spark, sf_dir, "events").groupBy(F.date_format("ts", form).alias("bucket"))
        return e.agg(F.count("*").alias("events"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("purchases"))

    run.__name__, run.__doc__ = f"timeline_{unit}", f"Events by {unit}."
    return query(f"SELECT {part} AS bucket, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1")(run)


timeline_hour, timeline_day, timeline_month = map(_timeline, ("hour", "day", "month"))


@query(_OCC + " SELECT path_id, file_name, file_size FROM occ ORDER BY file_size DESC, path_id LIMIT 20")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest files."""
    return corpus.occurrences(spark, sf_dir).orderBy(F.desc("file_size"), "path_id").limit(20).select("path_id", "file_name", "file_size")


@query(_OCC + " SELECT source, count(*) AS files, round(count(*) FILTER (WHERE file_status = 'Read') * 100.0 / nullif(count(*), 0), 2) AS success_rate FROM occ GROUP BY source")
def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each source's files that were read."""
    read = F.count(F.when(F.col("file_status") == "Read", 1))
    return corpus.occurrences(spark, sf_dir).groupBy("source").agg(F.count("*").alias("files"), measures.rate(read, F.count("*")).alias("success_rate"))


@query(_OCC + " SELECT word, count(*) AS contents, CAST(sum(n) AS BIGINT) AS occurrences FROM words GROUP BY word ORDER BY contents DESC, word LIMIT 100")
def word_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred words in most contents."""
    out = corpus.words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("contents"), F.sum("n").alias("occurrences"))
    return out.orderBy(F.desc("contents"), "word").limit(100)


@query(_OCC + " SELECT hash_id, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (WHERE n = 1) AS hapax, round(count(*) * 1.0 / sum(n), 6) AS ttr FROM words GROUP BY hash_id")
def content_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, types, words met once and the type-token ratio of each content."""
    w = corpus.words(spark, sf_dir).groupBy("hash_id")
    return w.agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.count(F.when(F.col("n") == 1, 1)).alias("hapax"), F.round(F.count("*") / F.sum("n"), 6).alias("ttr"))


@query(_OCC + " SELECT source, CAST(sum(n) AS BIGINT) AS tokens, count(DISTINCT word) AS types, round(count(DISTINCT word) * 1.0 / sum(n), 6) AS ttr FROM (SELECT DISTINCT source, hash_id FROM occ) JOIN words USING (hash_id) GROUP BY source")
def vocabulary_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of each source: counts of a word are summed before types are counted."""
    own = corpus.occurrences(spark, sf_dir).select("source", "hash_id").distinct()
    by_word = own.join(corpus.words(spark, sf_dir), "hash_id").groupBy("source", "word").agg(F.sum("n").alias("n"))
    return by_word.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"), F.round(F.count("*") / F.sum("n"), 6).alias("ttr"))


@query(
    f"{_OCC}, {corpus.TAXONOMY_SQL}, {KEYWORD_SQL}, hit AS (SELECT category, hash_id, word, n FROM words JOIN tax USING (word)), "
    "m AS (SELECT category, count(DISTINCT word) AS member_hits, count(DISTINCT hash_id) AS contents, sum(n) AS occurrences FROM hit GROUP BY category), "
    "f AS (SELECT category, count(DISTINCT path_id) AS files, count(DISTINCT source) AS sources FROM (SELECT DISTINCT category, hash_id FROM hit) JOIN occ USING (hash_id) GROUP BY category) "
    "SELECT t.category, CAST(coalesce(member_hits, 0) AS BIGINT) AS member_hits, CAST(coalesce(contents, 0) AS BIGINT) AS contents, CAST(coalesce(occurrences, 0) AS BIGINT) AS occurrences, "
    "CAST(coalesce(files, 0) AS BIGINT) AS files, CAST(coalesce(sources, 0) AS BIGINT) AS sources FROM (SELECT DISTINCT category FROM tax) t LEFT JOIN m USING (category) LEFT JOIN f USING (category)"
)
def category_five_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members met, contents, occurrences, files and sources of each category.

    Each metric is aggregated before the join, so that no join multiplies another's rows.
    """
    tax = corpus.taxonomy(spark)
    hit = corpus.words(spark, sf_dir).join(F.broadcast(tax), "word")
    m = hit.groupBy("category").agg(F.countDistinct("word").alias("member_hits"), F.countDistinct("hash_id").alias("contents"), F.sum("n").alias("occurrences"))
    f = hit.select("category", "hash_id").distinct().join(corpus.occurrences(spark, sf_dir), "hash_id").groupBy("category").agg(F.countDistinct("path_id").alias("files"), F.countDistinct("source").alias("sources"))
    out = tax.select("category").distinct().join(m, "category", "left").join(f, "category", "left")
    return out.select("category", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("member_hits", "contents", "occurrences", "files", "sources")))


@query(f"WITH {corpus.TAXONOMY_SQL} SELECT word, string_agg(DISTINCT category, ', ' ORDER BY category) AS categories, count(DISTINCT category) AS n FROM (SELECT * FROM tax UNION ALL SELECT 'extra', word FROM tax WHERE word IN ('the', 'de')) GROUP BY word HAVING count(DISTINCT category) > 1")
def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in more than one category, with the categories' names."""
    tax = corpus.taxonomy(spark)
    tax = tax.unionByName(tax.where("word in ('the', 'de')").select(F.lit("extra").alias("category"), "word"))
    own = tax.groupBy("word").agg(F.array_join(F.sort_array(F.collect_set("category")), ", ").alias("categories"), F.countDistinct("category").alias("n"))
    return own.where("n > 1")


@query(
    r"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS mail FROM documents) "
    "SELECT lower(split_part(mail, '@', 2)) AS domain, count(*) AS mails, count(DISTINCT doc_id) AS paths FROM m GROUP BY 1"
)
def email_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the mail addresses in texts."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)))
    m = corpus.table(spark, sf_dir, "documents").where(F.col("text").contains("@")).select("doc_id", found.alias("mail"))
    return m.groupBy(F.lower(F.split_part("mail", F.lit("@"), F.lit(2))).alias("domain")).agg(F.count("*").alias("mails"), F.countDistinct("doc_id").alias("paths"))


@query(
    _OCC + ", s AS (SELECT side, source, sum(file_size) AS size FROM occ GROUP BY side, source), p AS (SELECT side, size * 100.0 / sum(size) OVER (PARTITION BY side) AS share FROM s) "
    "SELECT side, round(sum(share * share), 4) AS hhi, count(*) AS sources, sum(share * share) >= 1800 AS concentrated FROM p GROUP BY side"
)
def hhi_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How concentrated each side's text is on few sources."""
    s = corpus.occurrences(spark, sf_dir).groupBy("side", "source").agg(F.sum("file_size").alias("size"))
    share = s.withColumn("share", F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy("side")))
    hhi = F.sum(F.col("share") * F.col("share"))
    return share.groupBy("side").agg(F.round(hhi, 4).alias("hhi"), F.count("*").alias("sources"), (hhi >= measures.HHI_CONCENTRATED).alias("concentrated"))


@query(
    _OCC + ", df AS (SELECT word, count(*) AS df FROM words GROUP BY word), n AS (SELECT count(*) AS total FROM contents), s AS (SELECT hash_id, word, round(n * ln(CAST(total AS DOUBLE) / df), 6) AS score FROM words JOIN df USING (word) CROSS JOIN n) "
    "SELECT hash_id, word, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY score DESC, word) AS rank FROM s) WHERE rank <= 3"
)
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most telling words of each content."""
    w = corpus.words(spark, sf_dir)
    df = w.groupBy("word").agg(F.count("*").alias("df"))
    total = corpus.content_ids(spark, sf_dir).agg(F.count("*").alias("total"))
    score = F.round(measures.tf_idf(F.col("n"), F.col("total"), F.col("df")), 6)
    s = w.join(df, "word").crossJoin(F.broadcast(total)).select("hash_id", "word", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("hash_id").orderBy(F.desc("score"), "word"))
    return s.withColumn("rank", rank.cast("long")).where("rank <= 3")


@query(
    "WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS same, count(*) FILTER (WHERE quality = 1) AS q, count(*) FILTER (WHERE toxic = 1) AS x FROM labels), "
    "p AS (SELECT n, same * 1.0 / n AS po, (q * 1.0 / n) * (x * 1.0 / n) + (1 - q * 1.0 / n) * (1 - x * 1.0 / n) AS pe FROM t WHERE n > 0) "
    "SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round(CASE WHEN pe <> 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM p"
)
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two label columns beyond chance; null when chance is certain."""
    n, one = F.count("*"), lambda c: F.count(F.when(F.col(c) == 1, 1))
    t = corpus.table(spark, sf_dir, "labels").agg(n.alias("n"), F.count(F.when(F.col("quality") == F.col("toxic"), 1)).alias("same"), one("quality").alias("q"), one("toxic").alias("x")).where("n > 0")
    po, q, x = F.col("same") / F.col("n"), F.col("q") / F.col("n"), F.col("x") / F.col("n")
    p = t.select("n", po.alias("po"), (q * x + (1 - q) * (1 - x)).alias("pe"))
    return p.select("n", F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), F.round(F.when(F.col("pe") != 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type: a short series whatever the number of events."""
    return corpus.table(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("t")).agg(F.count("*").alias("y"))


_SERIES = "WITH s AS (SELECT event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, count(*) AS y FROM events GROUP BY 1, 2), pairs AS (SELECT a.event_type, a.t AS t1, b.t AS t2, a.y AS y1, b.y AS y2 FROM s a JOIN s b ON a.event_type = b.event_type AND a.t < b.t)"


@query(
    _SERIES + ", k AS (SELECT event_type, CAST(sum(sign(y2 - y1)) AS BIGINT) AS s FROM pairs GROUP BY 1), n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1), "
    "ties AS (SELECT event_type, sum(c * (c - 1) * (2 * c + 5)) AS t FROM (SELECT event_type, y, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY 1), "
    "v AS (SELECT n.event_type, n, s, (n * (n - 1) * (2 * n + 5) - t) / 18.0 AS var FROM n JOIN k USING (event_type) JOIN ties USING (event_type) WHERE n >= 3) "
    "SELECT event_type, n, s, round(var, 6) AS variance, round(CASE WHEN var <= 0 THEN NULL WHEN s > 0 THEN (s - 1) / sqrt(var) WHEN s < 0 THEN (s + 1) / sqrt(var) ELSE 0 END, 6) AS z FROM v"
)
def mann_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotonic trend of each event type's daily counts, variance corrected for ties."""
    s = _series(spark, sf_dir)
    pairs = s.toDF("event_type", "t1", "y1").join(s.toDF("event_type", "t2", "y2"), "event_type").where("t1 < t2")
    k = pairs.groupBy("event_type").agg(F.sum(F.signum(F.col("y2") - F.col("y1"))).cast("long").alias("s"))
    n = s.groupBy("event_type").agg(F.count("*").alias("n"))
    tied = s.groupBy("event_type", "y").agg(F.count("*").alias("c")).groupBy("event_type").agg(F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("ties"))
    v = n.join(k, "event_type").join(tied, "event_type").where("n >= 3")
    v = v.withColumn("var", (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("ties")) / 18.0)
    z = F.when(F.col("var") <= 0, None).when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var")).otherwise(0.0)
    return v.select("event_type", "n", "s", F.round("var", 6).alias("variance"), F.round(z, 6).alias("z"))


@query(_SERIES + " SELECT event_type, round(median((y2 - y1) * 1.0 / (t2 - t1)), 6) AS slope FROM pairs GROUP BY event_type")
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median slope of each event type's daily counts."""
    s = _series(spark, sf_dir)
    pairs = s.toDF("event_type", "t1", "y1").join(s.toDF("event_type", "t2", "y2"), "event_type").where("t1 < t2")
    return pairs.groupBy("event_type").agg(F.round(F.median((F.col("y2") - F.col("y1")) / (F.col("t2") - F.col("t1"))), 6).alias("slope"))


@query(_OCC + r", seq AS (SELECT hash_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM contents), g AS (SELECT array_to_string(list_slice(w, i, i + 1), ' ') AS bigram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM seq)) SELECT bigram, count(*) AS n FROM g GROUP BY bigram ORDER BY n DESC, bigram LIMIT 100")
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent word pairs."""
    w = corpus.words_in(F.col("text"))
    shifted = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    g = corpus.contents(spark, sf_dir, shifted.alias("w")).select(F.explode("w").alias("bigram")).where("bigram is not null")
    return g.groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(100)


@query(_OCC + f", {KEYWORD_SQL} SELECT o.source, h.keyword_id, CAST(sum(h.n) AS BIGINT) AS occurrences, count(DISTINCT o.hash_id) AS contents FROM (SELECT DISTINCT source, hash_id FROM occ) o JOIN hits h USING (hash_id) GROUP BY 1, 2")
def keyword_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each keyword in each source."""
    from docquarry.operators.filters import keyword_hits

    own = corpus.occurrences(spark, sf_dir).select("source", "hash_id").distinct()
    return own.join(keyword_hits(spark, sf_dir), "hash_id").groupBy("source", "keyword_id").agg(F.sum("n").alias("occurrences"), F.countDistinct("hash_id").alias("contents"))


@query(r"SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '[.!?]+')) AS BIGINT) AS sentences FROM documents")
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, lines, words and sentence ends of each document."""
    size = lambda c: F.size(c).cast("long")
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").cast("long").alias("chars"), size(F.split("text", "\n", -1)).alias("lines"),
        size(corpus.words_in(F.col("text"))).alias("words"), F.regexp_count("text", F.lit("[.!?]+")).cast("long").alias("sentences"),
    )


@query(
    _OCC + f", {KEYWORD_SQL} SELECT (SELECT count(*) FROM contents) AS contents, (SELECT count(*) FROM occ) AS paths, (SELECT count(DISTINCT source) FROM occ) AS sources, (SELECT count(DISTINCT side) FROM occ) AS sides, "
    "(SELECT count(DISTINCT keyword_id) FROM hits) AS keywords_met, (SELECT CAST(sum(n) AS BIGINT) FROM words) AS tokens, (SELECT min(file_date) FROM occ) AS first_ingest, (SELECT max(file_date) FROM occ) AS last_ingest, (SELECT count(*) FROM contexts) AS contexts"
)
def comprehensive_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the whole corpus, of one-row aggregates."""
    from docquarry.operators.filters import keyword_hits

    occ = corpus.occurrences(spark, sf_dir)
    whole = occ.agg(
        F.countDistinct("hash_id").alias("contents"), F.count("*").alias("paths"), F.countDistinct("source").alias("sources"), F.countDistinct("side").alias("sides"),
        F.min("file_date").alias("first_ingest"), F.max("file_date").alias("last_ingest"), F.countDistinct("hash_id", "source", "side").alias("contexts"),
    )
    met = keyword_hits(spark, sf_dir).agg(F.countDistinct("keyword_id").alias("keywords_met"))
    tokens = corpus.lengths(spark, sf_dir).agg(F.sum("tokens").alias("tokens"))
    return whole.crossJoin(F.broadcast(met)).crossJoin(F.broadcast(tokens))  # one row each
