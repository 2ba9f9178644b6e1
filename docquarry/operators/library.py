"""The file library: paths as trees, bounded filters, generic column filters, cursors, normal forms."""

from __future__ import annotations

import base64
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions import measures
from docquarry.operators.filters import KEYWORD_SQL, category_hits, keyword_hits
from docquarry.operators.signals import any_of
from docquarry.plans.criteria import literal
from docquarry.plans.registry import query
from docquarry.sources import corpus

_OCC = f"WITH {corpus.SQL}"
_PATHS = "p AS (SELECT *, CASE WHEN path_id % 3 = 0 THEN replace(source || '/' || side || '/' || file_name, '/', chr(92)) WHEN path_id % 3 = 1 THEN source || '/' || side || '.zip::' || file_name ELSE source || '/' || side || '/' || file_name END AS file_path FROM occ)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences with file_path: folders by source and side, some with the other separator,
    some inside an archive (``::``)."""
    plain = F.concat_ws("/", "source", "side", "file_name")
    inside = F.concat(F.concat_ws("/", "source", "side"), F.lit(".zip::"), F.col("file_name"))
    path = F.when(F.col("path_id") % 3 == 0, F.replace(plain, F.lit("/"), F.lit("\\"))).when(F.col("path_id") % 3 == 1, inside).otherwise(plain)
    return corpus.occurrences(spark, sf_dir).withColumn("file_path", path)


def normal_path(path: Column) -> Column:
    """One separator for folders and archives alike."""
    return F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("::"), F.lit("/"))


def below(path: Column, folder: str) -> Column:
    """Whether a path is in a folder or archive, at any depth; a folder of a longer name isn't it."""
    wanted = folder.replace("\\", "/").replace("::", "/").rstrip("/")
    return normal_path(path).startswith(wanted + "/")


def path_tree(files: DataFrame) -> DataFrame:
    """node, depth, files and size of every folder and archive: each file adds to all above it."""
    steps = F.split(normal_path(F.col("file_path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.struct(F.array_join(F.slice(steps, F.lit(1), k), "/").alias("node"), k.alias("depth")))
    each = files.where(F.size(steps) > 1).select("file_size", F.explode(up).alias("at"))
    return each.groupBy("at.node", "at.depth").agg(F.count("*").alias("files"), F.sum("file_size").alias("size"))


#: Operators of the generic filter.
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "LIKE", "ILIKE", "IN", "BETWEEN")


def column_filter(df: DataFrame, wanted: list[tuple[str, str, object]]) -> DataFrame:
    """``df`` by (column, operator, value) conditions; unknown columns, operators and values of
    the wrong form are passed over."""
    for column, op, value in wanted:
        if column not in df.columns or op not in OPERATORS:
            continue
        c = F.col(column)
        if op in ("IN", "BETWEEN"):
            if not isinstance(value, (list, tuple)) or not value or op == "BETWEEN" and len(value) != 2:
                continue
            df = df.where(c.isin(*value) if op == "IN" else c.between(*value))
        elif isinstance(value, (list, tuple)) or value is None:
            continue
        else:
            compare = {"=": c == value, "!=": c != value, ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}
            df = df.where(c.like(value) if op == "LIKE" else c.ilike(value) if op == "ILIKE" else compare[op])
    return df


def encode_cursor(*key: object) -> str:
    """The last row's sort key as an opaque text."""
    return base64.urlsafe_b64encode(json.dumps(key, default=str, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, parts: int) -> tuple:
    """The key of a cursor; ValueError if it isn't one of so many parts."""
    try:
        key = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except (ValueError, UnicodeDecodeError) as wrong:
        raise ValueError("not a cursor") from wrong
    if not isinstance(key, list) or len(key) != parts:
        raise ValueError("not a cursor of this view")
    return tuple(key)


def after(df: DataFrame, order: list[tuple[str, bool]], cursor: str | None, limit: int) -> DataFrame:
    """The page after a cursor, by (column, descending) and the whole key compared, so that ties aren't passed over."""
    if cursor:
        key, past, same = decode_cursor(cursor, len(order)), F.lit(False), F.lit(True)
        for (column, descending), value in zip(order, key):
            at = F.lit(value).cast(df.schema[column].dataType)
            past = past | (same & (F.col(column) < at if descending else F.col(column) > at))
            same = same & (F.col(column) == at)
        df = df.where(past)
    return df.orderBy(*(F.desc(c) if descending else F.asc(c) for c, descending in order)).limit(limit)


def normal_text(column: Column) -> Column:
    """NFKC, lower case, runs of white space as one space: a form for comparing names."""

    @F.pandas_udf("string")
    def form(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()))

    return form(column)


def search_tokens(text: Column) -> Column:
    """Lower-cased tokens of a query: letters with their marks, digits, underscore, apostrophe
    and hyphen; single signs are dropped."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_'-]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) | t.rlike(r"^[\p{L}\p{N}]$"))


def first_page(text: Column, most: int = 12_000) -> Column:
    """A text up to its first form feed, within a bound."""
    return F.substring(F.get(F.split(text, "\f", 2), F.lit(0)), 1, most)


@query(f"{_OCC}, {_PATHS}, n AS (SELECT path_id, replace(replace(file_path, chr(92), '/'), '::', '/') AS f FROM p) SELECT path_id FROM n WHERE starts_with(f, 'src1/fr/') OR starts_with(f, 'src2/en.zip/')")
def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder or in an archive, whatever the separator."""
    return paths(spark, sf_dir).where(below(F.col("file_path"), "src1\\fr") | below(F.col("file_path"), "src2/en.zip::")).select("path_id")


@query(
    f"{_OCC}, {_PATHS}, n AS (SELECT file_size, string_split(replace(replace(file_path, chr(92), '/'), '::', '/'), '/') AS s FROM p), e AS (SELECT file_size, s, unnest(range(1, len(s))) AS depth FROM n) "
    "SELECT array_to_string(list_slice(s, 1, depth), '/') AS node, CAST(depth AS INTEGER) AS depth, count(*) AS files, CAST(sum(file_size) AS BIGINT) AS size FROM e GROUP BY 1, 2"
)
def path_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder with the files and bytes below it."""
    return path_tree(paths(spark, sf_dir))


@query(f"{_OCC} SELECT path_id, file_size FROM occ WHERE contains(lower(file_name), 'doc1') AND file_type IN ('en', 'fr') AND file_size / 1048576.0 BETWEEN 0.0005 AND 0.01 AND file_date >= DATE '2024-02-01'")
def library_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by name, type, size in megabytes and date."""
    size = F.col("file_size") / 1048576.0
    wanted = literal(F.col("file_name"), "DOC1") & any_of("file_type", ("en", "fr")) & size.between(0.0005, 0.01)
    return corpus.occurrences(spark, sf_dir).where(wanted & (F.col("file_date") >= F.lit("2024-02-01").cast("date"))).select("path_id", "file_size")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey BETWEEN 3 AND 15 AND c_name LIKE 'Customer%' AND c_name ILIKE '%1' AND c_nationkey <> 7")
def generic_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by any of the operators; three conditions are malformed and passed over."""
    wanted = [
        ("c_acctbal", ">", 1000), ("c_mktsegment", "IN", ["BUILDING", "MACHINERY"]), ("c_nationkey", "BETWEEN", [3, 15]), ("c_name", "LIKE", "Customer%"),
        ("c_name", "ILIKE", "%1"), ("c_nationkey", "!=", 7), ("nothing", "=", 1), ("c_name", "~", "x"), ("c_acctbal", "BETWEEN", [1]),
    ]
    return column_filter(corpus.table(spark, sf_dir, "customer"), wanted).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_custkey < 100 OR (o_custkey = 100 AND o_orderdate > TIMESTAMP '1996-01-01') OR (o_custkey = 100 AND o_orderdate = TIMESTAMP '1996-01-01' AND o_orderkey > 5) ORDER BY o_custkey DESC, o_orderdate, o_orderkey LIMIT 40")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after an opaque cursor of three columns."""
    o = corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return after(o, [("o_custkey", True), ("o_orderdate", False), ("o_orderkey", False)], encode_cursor(100, "1996-01-01 00:00:00", 5), 40)


@query(f"{_OCC} SELECT o.path_id, contains(lower(file_name), '7') AS in_name, contains(lower(t.text), 'license') AS in_content, contains(lower(source), '7') OR contains(lower(side), '7') AS in_metadata FROM occ o JOIN contents t USING (hash_id) WHERE contains(lower(file_name), '7') OR contains(lower(t.text), 'license') OR contains(lower(source), '7') OR contains(lower(side), '7')")
def field_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields a search matched; of the text only the flag leaves its task."""
    said = corpus.texts(spark, sf_dir).select("hash_id", F.coalesce(literal(F.col("text"), "license"), F.lit(False)).alias("in_content"))
    name = lambda c: literal(F.col(c), "7")
    o = corpus.occurrences(spark, sf_dir).select("path_id", "hash_id", name("file_name").alias("in_name"), (name("source") | name("side")).alias("in_metadata"))
    return o.join(said, "hash_id").where("in_name or in_content or in_metadata").select("path_id", "in_name", "in_content", "in_metadata")


@query(f"{_OCC} SELECT count(DISTINCT coalesce(CASE WHEN path_id % 5 > 0 THEN CAST(hash_id AS VARCHAR) END, 'path:' || path_id)) AS documents FROM occ")
def distinct_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents counted by content, and by path where the content isn't known."""
    key = F.coalesce(F.when(F.col("path_id") % 5 > 0, F.col("hash_id").cast("string")), F.concat(F.lit("path:"), F.col("path_id")))
    return corpus.occurrences(spark, sf_dir).agg(F.countDistinct(key).alias("documents"))


@query(f"{_OCC} SELECT upper(coalesce(nullif(trim(regexp_extract(file_name, '[.]([^.]*)$', 1)), ''), 'NONE')) AS extension, count(*) AS files FROM (SELECT CASE WHEN path_id % 6 = 0 THEN 'x' || path_id WHEN path_id % 6 = 1 THEN 'x.' ELSE file_name END AS file_name FROM occ) GROUP BY 1")
def extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by extension, in one case, those without any under one name."""
    name = F.when(F.col("path_id") % 6 == 0, F.concat(F.lit("x"), F.col("path_id"))).when(F.col("path_id") % 6 == 1, "x.").otherwise(F.col("file_name"))
    ending = F.upper(F.coalesce(F.nullif(F.trim(F.regexp_extract(name, r"[.]([^.]*)$", 1)), F.lit("")), F.lit("NONE")))
    return corpus.occurrences(spark, sf_dir).groupBy(ending.alias("extension")).agg(F.count("*").alias("files"))


@query("SELECT lower(c_mktsegment) AS name, string_agg(DISTINCT c_nationkey, ',' ORDER BY c_nationkey) AS ids, count(*) AS n FROM customer GROUP BY lower(c_mktsegment) HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ in case only, with the ids that have them in order."""
    c = corpus.table(spark, sf_dir, "customer").groupBy(F.lower("c_mktsegment").alias("name"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("c_nationkey")), lambda x: x.cast("string")), ",")  # as many as nations
    return c.agg(ids.alias("ids"), F.count("*").alias("n")).where("n > 1")


@query("SELECT event_type, CASE WHEN value >= 75 THEN 'high' WHEN value >= 25 THEN 'medium' ELSE 'low' END AS priority, count(*) AS total, count(*) FILTER (WHERE event_id % 3 > 0) AS unread FROM events GROUP BY GROUPING SETS ((), (event_type), (priority))")
def alert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notifications in all, by type and by priority, and how many are unread, in one pass."""
    level = F.when(F.col("value") >= 75, "high").when(F.col("value") >= 25, "medium").otherwise("low")
    e = corpus.table(spark, sf_dir, "events").select("event_id", "event_type", level.alias("priority"))
    kinds = [F.col("event_type"), F.col("priority")]
    return e.groupingSets([[], *([k] for k in kinds)], *kinds).agg(F.count("*").alias("total"), F.count(F.when(F.col("event_id") % 3 > 0, 1)).alias("unread"))


@query(f"{_OCC}, {corpus.TAXONOMY_SQL}, {KEYWORD_SQL}, f AS (SELECT category, o.path_id FROM (SELECT DISTINCT category, hash_id FROM words JOIN tax USING (word)) JOIN occ o USING (hash_id) UNION SELECT 'links', o.path_id FROM hits h JOIN occ o USING (hash_id) WHERE keyword_id IN (3, 5)) SELECT category, count(*) AS files FROM f GROUP BY category")
def category_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each category, by its words or by its keywords, each once."""
    o = corpus.occurrences(spark, sf_dir).select("hash_id", "path_id")
    by_word = category_hits(spark, sf_dir).join(o, "hash_id").select("category", "path_id")
    by_keyword = keyword_hits(spark, sf_dir).where("keyword_id in (3, 5)").join(o, "hash_id").select(F.lit("links").alias("category"), "path_id")
    return by_word.union(by_keyword).distinct().groupBy("category").agg(F.count("*").alias("files"))


@query(f"{_OCC} SELECT o.path_id, count(n) AS known_words, count(*) AS words FROM occ o JOIN words w USING (hash_id) GROUP BY o.path_id")
def words_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each path and those of known count: summed by content before paths are joined."""
    each = corpus.words(spark, sf_dir).groupBy("hash_id").agg(F.count("n").alias("known_words"), F.count("*").alias("words"))
    return corpus.occurrences(spark, sf_dir).join(each, "hash_id").select("path_id", "known_words", "words")


@query(f"{_OCC} SELECT kind, value, count(*) AS files, count(DISTINCT hash_id) AS contents, CAST(sum(file_size) AS BIGINT) AS size, round(count(*) FILTER (WHERE file_status = 'Read') * 100.0 / count(*), 2) AS read_rate FROM (SELECT *, unnest(['source', 'side', 'type']) AS kind, unnest([source, side, file_type]) AS value FROM occ) GROUP BY 1, 2")
def dimension_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, contents, size and read rate by source, side and type, in one pass."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("source", "source"), ("side", "side"), ("type", "file_type"))))
    each = corpus.occurrences(spark, sf_dir).select("hash_id", "file_size", "file_status", F.inline(kinds))
    read = F.count(F.when(F.col("file_status") == "Read", 1))
    return each.groupBy("kind", "value").agg(F.count("*").alias("files"), F.countDistinct("hash_id").alias("contents"), F.sum("file_size").alias("size"), measures.rate(read, F.count("*")).alias("read_rate"))


@query(r"WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_''-]+')) AS token FROM documents) SELECT token, count(*) AS n FROM t WHERE length(token) > 1 OR regexp_matches(token, '^[\p{L}\p{N}]$') GROUP BY token ORDER BY n DESC, token LIMIT 200")
def search_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred most frequent search tokens."""
    t = corpus.table(spark, sf_dir, "documents").select(F.explode(search_tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(200)


@query("SELECT doc_id, CAST(length(substr(split_part(text, chr(12), 1), 1, 12000)) AS BIGINT) AS chars, md5(substr(split_part(text, chr(12), 1), 1, 12000)) AS digest FROM documents")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each document, as a length and a digest."""
    page = first_page(F.col("text"))
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.length(page).cast("long").alias("chars"), F.md5(page).alias("digest"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id < 5000 AND event_type IN ('purchase', 'error') ORDER BY event_id DESC LIMIT 50")
def audit_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the log before an id."""
    e = corpus.table(spark, sf_dir, "events").where((F.col("event_id") < 5000) & any_of("event_type", ("purchase", "error")))
    return e.select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(50)


@query("SELECT DISTINCT event_type FROM events")
def audit_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's distinct actions; combined in each task before they are shuffled."""
    return corpus.table(spark, sf_dir, "events").select("event_type").distinct()


@query(f"{_OCC}, c AS (SELECT path_id, file_size, file_date FROM occ WHERE contains(lower(file_name), '1') ORDER BY file_date DESC, path_id LIMIT 300) SELECT path_id, round(ln(1 + file_size) + date_diff('day', DATE '2024-01-01', file_date) / 100.0, 6) AS score FROM c ORDER BY score DESC, path_id LIMIT 100")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times as many candidates as asked for, the newest, ranked again by score."""
    c = corpus.occurrences(spark, sf_dir).where(literal(F.col("file_name"), "1")).orderBy(F.desc("file_date"), "path_id").limit(300)
    score = F.log(1 + F.col("file_size")) + F.datediff("file_date", F.lit("2024-01-01").cast("date")) / 100.0
    return c.select("path_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path_id").limit(100)


@query("SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING list_has_any(list(role), ['system', 'tool'])")
def array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with any of two roles, by an overlap of arrays (of as many items as roles)."""
    roles = corpus.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.count("*").alias("turns"))
    return roles.where(F.arrays_overlap("roles", F.array(F.lit("system"), F.lit("tool")))).select("conv_id", "turns")
