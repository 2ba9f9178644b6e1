"""Interactive search: BM25, additive relevance, completion, matching lines, similar words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.operators.alike import similar_sets
from docquarry.plans.criteria import whole_word
from docquarry.plans.registry import query
from docquarry.sources import corpus
from docquarry.sources.shared import release, shared_dir, staged

_OCC = f"WITH {corpus.SQL}"
#: BM25's saturation and length weight; the field weights and bonuses of ranking.
K1, B = 1.5, 0.75
NAME_WEIGHT, TEXT_WEIGHT, RECENCY, HALF_LIFE = 2.0, 1.0, 0.1, 30
TERMS = ("idiot", "license", "the")
_LIST = ", ".join(f"'{t}'" for t in TERMS)


def bm25(words: DataFrame, lengths: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """hash_id and score of the contents that hold any of the terms.

    Only the terms' rows are joined; the corpus size is an aggregate of the contents' lengths. The inverse
    document frequency is negative for terms in more than half of the contents, and so can
    the score be. Unknown counts are left out of lengths and scores.
    """
    lengths = lengths.select("hash_id", F.col("tokens").alias("len"))
    size = lengths.agg(F.count("*").alias("total"), F.avg("len").alias("mean"))
    hits = words.where(F.col("word").isin(*terms))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    j = hits.join(F.broadcast(df), "word").join(lengths, "hash_id").crossJoin(F.broadcast(size))  # as many rows as terms; one row
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return j.groupBy("hash_id").agg(F.sum(idf * tf).alias("score"))


@query(
    _OCC + ", len AS (SELECT hash_id, sum(n) AS l FROM words GROUP BY hash_id), size AS (SELECT count(*) AS total, avg(l) AS mean FROM len), "
    f"hit AS (SELECT * FROM words WHERE word IN ({_LIST})), df AS (SELECT word, count(*) AS df FROM hit GROUP BY word), "
    f"s AS (SELECT hash_id, sum(ln((total - df + 0.5) / (df + 0.5)) * n * {K1 + 1} / (n + {K1} * (1 - {B} + {B} * l / mean))) AS score FROM hit JOIN df USING (word) JOIN len USING (hash_id) CROSS JOIN size GROUP BY hash_id) "
    "SELECT hash_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, hash_id LIMIT 50"
)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best contents for three terms."""
    s = bm25(corpus.words(spark, sf_dir), corpus.lengths(spark, sf_dir), TERMS).withColumn("score", F.round("score", 6))
    return s.orderBy(F.desc("score"), "hash_id").limit(50)


_RELEVANCE = " + ".join(f"{NAME_WEIGHT} * CAST(contains(lower(file_name), '{t}') AS INTEGER) + {TEXT_WEIGHT} * CAST(coalesce(list_contains(ws, '{t}'), false) AS INTEGER)" for t in ("idiot", "fr", "la"))


@query(
    _OCC + ", h AS (SELECT hash_id, list(word) AS ws FROM words WHERE word IN ('idiot', 'fr', 'la') GROUP BY hash_id), "
    f"r AS (SELECT path_id, {_RELEVANCE} AS terms, file_date FROM occ LEFT JOIN h USING (hash_id)) "
    f"SELECT path_id, round(terms + {RECENCY} * pow(2, -date_diff('day', file_date, DATE '2024-12-31') / {float(HALF_LIFE)}), 6) AS score FROM r WHERE terms > 0 ORDER BY 2 DESC, path_id LIMIT 100"
)
def relevance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive relevance of names and words, with a bonus for recent files."""
    terms = ("idiot", "fr", "la")
    held = corpus.words(spark, sf_dir).where(F.col("word").isin(*terms)).groupBy("hash_id").agg(F.collect_set("word").alias("ws"))
    r = corpus.occurrences(spark, sf_dir).join(held, "hash_id", "left")
    score = F.lit(0.0)
    for t in terms:
        score = score + NAME_WEIGHT * F.lower("file_name").contains(t).cast("int") + TEXT_WEIGHT * F.coalesce(F.array_contains("ws", t), F.lit(False)).cast("int")
    recent = RECENCY * F.pow(F.lit(2.0), -F.datediff(F.lit("2024-12-31").cast("date"), "file_date") / float(HALF_LIFE))
    out = r.withColumn("terms", score).where("terms > 0").select("path_id", F.round(F.col("terms") + recent, 6).alias("score"))
    return out.orderBy(F.desc("score"), "path_id").limit(100)


@query(
    _OCC + ", c AS (SELECT word AS suggestion, 'word' AS kind, count(*) AS n FROM words WHERE starts_with(word, 'cl') GROUP BY word UNION ALL SELECT source, 'source', count(*) FROM occ WHERE starts_with(source, 'cl') OR starts_with(source, 'src1') GROUP BY source) "
    "SELECT suggestion, kind, n FROM c ORDER BY starts_with(suggestion, 'cl') DESC, n DESC, suggestion LIMIT 20"
)
def autocomplete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of a prefix among words and names."""
    w = corpus.words(spark, sf_dir).where(F.col("word").startswith("cl")).groupBy(F.col("word").alias("suggestion")).agg(F.count("*").alias("n"))
    s = corpus.occurrences(spark, sf_dir).where(F.col("source").startswith("cl") | F.col("source").startswith("src1")).groupBy(F.col("source").alias("suggestion")).agg(F.count("*").alias("n"))
    both = w.withColumn("kind", F.lit("word")).unionByName(s.withColumn("kind", F.lit("source")))
    return both.orderBy(F.desc(F.col("suggestion").startswith("cl")), F.desc("n"), "suggestion").limit(20).select("suggestion", "kind", "n")


def matching_lines(texts: DataFrame, test: Column) -> DataFrame:
    """hash_id, line number from 1, the line and its neighbours, for the lines that pass
    ``test`` (a predicate of the column line). Other lines never leave their row's task."""
    lines = F.split("text", "\n", -1)
    each = texts.select("hash_id", lines.alias("ls"), F.posexplode(lines).alias("i", "line")).where(test)
    at = lambda k: F.get("ls", F.col("i") + k)
    return each.select("hash_id", (F.col("i") + 1).cast("long").alias("line_no"), "line", at(-1).alias("before"), at(1).alias("after"))


@query(
    _OCC + ", l AS (SELECT hash_id, string_split(text, chr(10)) AS ls FROM contents), e AS (SELECT hash_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l) "
    r"SELECT hash_id, i AS line_no, ls[i] AS line, CASE WHEN i > 1 THEN ls[i - 1] END AS before, ls[i + 1] AS after FROM e WHERE regexp_matches(ls[i], '(?i)(^|[^\p{L}\p{N}_])license([^\p{L}\p{N}_]|$)')"
)
def line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word, numbered, with the lines around them."""
    found = matching_lines(corpus.texts(spark, sf_dir), whole_word(F.col("line"), "license"))
    return found.join(corpus.content_ids(spark, sf_dir), "hash_id", "left_semi")


SYNONYMS = {"error": ("failure", "fault"), "license": ("licence",), "idiot": ("moron",)}


def expand(term: str, most: int = 3) -> tuple[str, ...]:
    """A term with its synonyms, in a fixed order."""
    return (term, *sorted(SYNONYMS.get(term.lower(), ())))[: most + 1]


@query(_OCC + " SELECT word, count(*) AS contents FROM words WHERE word IN ('idiot', 'moron', 'licence', 'license') GROUP BY word")
def expanded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of each term of an expanded query."""
    terms = [t for q in ("idiot", "license") for t in expand(q)]
    return corpus.words(spark, sf_dir).where(F.col("word").isin(*terms)).groupBy("word").agg(F.count("*").alias("contents"))


def jaccard_links(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    """a, b (a < b) and jaccard of the contents whose word sets are similar enough."""
    hashes = F.transform(F.array_distinct(corpus.words_in(F.col("text"))), lambda w: F.xxhash64(w))
    sets = staged(corpus.contents(spark, sf_dir, hashes.alias("words")).where("size(words) > 0").select(F.col("hash_id").alias("id"), "words"))
    release(spark)
    return similar_sets(sets, threshold)


THRESHOLD = 0.6
_PAIRS = (
    ", size AS (SELECT hash_id, count(*) AS n FROM words GROUP BY hash_id), met AS (SELECT x.hash_id AS a, y.hash_id AS b, count(*) AS k FROM words x JOIN words y ON x.word = y.word AND x.hash_id < y.hash_id GROUP BY 1, 2), "
    f"pairs AS (SELECT a, b, k * 1.0 / (sa.n + sb.n - k) AS j FROM met JOIN size sa ON sa.hash_id = a JOIN size sb ON sb.hash_id = b WHERE k * 1.0 / (sa.n + sb.n - k) >= {THRESHOLD})"
)


@query(f"{_OCC}{_PAIRS} SELECT a, b, round(j, 6) AS jaccard FROM pairs")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of contents with similar word sets."""
    return jaccard_links(spark, sf_dir, THRESHOLD).withColumn("jaccard", F.round("jaccard", 6))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node connected) from edges (a, b).

    Labels spread along edges and jump to their labels' labels, so rounds grow with the
    logarithm of the longest path. Each round is checkpointed: the plan doesn't grow and lost
    executors cost one round.
    """
    shared_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")).checkpoint()
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new")).checkpoint()
        to = spread.select(F.col("node").alias("at"), F.col("new").alias("further"))
        jumped = spread.join(to, F.col("new") == F.col("at")).select("node", F.col("label").alias("old"), F.least("new", "further").alias("label")).checkpoint()
        labels = jumped.select("node", "label")
        if jumped.where("old <> label").isEmpty():
            return labels


@query(
    f"WITH RECURSIVE {corpus.SQL}{_PAIRS}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs), r AS (SELECT a AS node, b AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) "
    "SELECT node AS hash_id, least(node, min(seen)) AS group_id FROM r GROUP BY node"
)
def similarity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of contents connected by similarity."""
    return components(jaccard_links(spark, sf_dir, THRESHOLD)).select(F.col("node").alias("hash_id"), F.col("label").alias("group_id"))


@query(_OCC + " SELECT side, path_id, file_size, rank FROM (SELECT side, path_id, file_size, row_number() OVER (PARTITION BY side ORDER BY file_size DESC, path_id) AS rank FROM occ) WHERE rank <= 5")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest files of each side; Spark prunes by rank before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("file_size"), "path_id"))
    return corpus.occurrences(spark, sf_dir).withColumn("rank", rank).where("rank <= 5").select("side", "path_id", "file_size", F.col("rank").cast("long").alias("rank"))
