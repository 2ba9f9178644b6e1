"""Declared report datasets: matches, relations, changes, horizon, facets, coverage, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import dates
from docquarry.operators.filters import matched
from docquarry.plans.registry import query
from docquarry.sources import corpus
from docquarry.sources.shared import staged

_OCC, _SIG = f"WITH {corpus.SQL}", f"WITH {corpus.SIGNALS_SQL}"
AS_OF = "2024-01-15"


def _ref():
    """The reference day of the horizon."""
    return F.lit(AS_OF).cast("date")


@query(_OCC + " SELECT path_id, file_name, file_type, file_size, source, side, file_date FROM occ WHERE side = 'fr' AND file_status = 'Read' ORDER BY file_date DESC, path_id LIMIT 5000")
def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched occurrences, newest first, at most 5 000 of them."""
    m = matched(spark, sf_dir, sides=("fr",), file_statuses=("Read",))
    return m.orderBy(F.desc("file_date"), "path_id").limit(5000).select("path_id", "file_name", "file_type", "file_size", "source", "side", "file_date")


@query(_OCC + " SELECT count(DISTINCT path_id) AS paths, count(DISTINCT hash_id) AS contents FROM occ WHERE side = 'fr' AND file_status = 'Read'")
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of matches."""
    m = matched(spark, sf_dir, sides=("fr",), file_statuses=("Read",))
    return m.agg(F.countDistinct("path_id").alias("paths"), F.countDistinct("hash_id").alias("contents"))


@query(
    _OCC + ", per AS (SELECT hash_id, count(*) AS k, count(DISTINCT source) AS s FROM contexts GROUP BY hash_id) "
    "SELECT c.context_id, c.hash_id, c.source, c.side, c.n_paths, p.k - 1 AS sibling_contexts, p.s - 1 AS sibling_sources FROM contexts c JOIN per p USING (hash_id)"
)
def relationship_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each context with the other contexts and sources that hold its content."""
    c = corpus.contexts(spark, sf_dir)
    per = c.groupBy("hash_id").agg(F.count("*").alias("k"), F.countDistinct("source").alias("s"))
    return c.join(per, "hash_id").select("context_id", "hash_id", "source", "side", "n_paths", (F.col("k") - 1).alias("sibling_contexts"), (F.col("s") - 1).alias("sibling_sources"))


@query(_OCC + " SELECT hash_id, count(*) AS paths, count(DISTINCT source || '/' || side) AS contexts FROM occ GROUP BY hash_id HAVING count(*) > 1")
def relation_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents met more than once."""
    out = corpus.occurrences(spark, sf_dir).groupBy("hash_id").agg(F.count("*").alias("paths"), F.countDistinct("source", "side").alias("contexts"))
    return out.where("paths > 1")


@query(_OCC + " SELECT hash_id, count(DISTINCT path_id) AS copies, min(path_id) AS first_path FROM occ GROUP BY hash_id HAVING count(DISTINCT path_id) > 1 ORDER BY copies DESC, hash_id LIMIT 1000")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thousand contents with most copies."""
    out = corpus.occurrences(spark, sf_dir).groupBy("hash_id").agg(F.countDistinct("path_id").alias("copies"), F.min("path_id").alias("first_path"))
    return out.where("copies > 1").orderBy(F.desc("copies"), "hash_id").limit(1000)


@query(_OCC + " SELECT path_id, hash_id FROM (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY file_date DESC, path_id) AS r FROM occ) WHERE r = 1")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest occurrence of each content."""
    best = F.min_by("path_id", F.struct(-F.unix_date("file_date"), "path_id"))  # an aggregate: combined before the shuffle, unlike a window
    return corpus.occurrences(spark, sf_dir).groupBy("hash_id").agg(best.alias("path_id"))


@query(_SIG + ", r AS (SELECT *, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank FROM sig) SELECT hash_id, signal_id, signal_type FROM (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY rank DESC, signal_id) AS k FROM r) WHERE k = 1")
def distinct_on_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident signal of each content."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    best = F.min_by(F.struct("signal_id", "signal_type"), F.struct(-rank, F.col("signal_id")))
    return corpus.signals(spark, sf_dir).groupBy("hash_id").agg(best.alias("b")).select("hash_id", "b.signal_id", "b.signal_type")


@query(f"{_SIG} SELECT hash_id, signal_id, date_from FROM (SELECT *, row_number() OVER (PARTITION BY hash_id ORDER BY date_from, signal_id) AS k FROM sig WHERE date_from > DATE '{AS_OF}') WHERE k = 1")
def next_event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content's next dated signal after the reference day (a forward as-of lookup)."""
    s = corpus.signals(spark, sf_dir).where(F.col("date_from") > _ref())
    return s.groupBy("hash_id").agg(F.min(F.struct("date_from", "signal_id")).alias("n")).select("hash_id", "n.signal_id", "n.date_from")


_BUCKET = (
    f"CASE WHEN date_from IS NULL THEN NULL WHEN date_to < DATE '{AS_OF}' THEN (CASE WHEN text_orientation = 'future' THEN 'overdue' ELSE 'past' END) "
    f"WHEN date_from < DATE '{AS_OF}' + 7 THEN 'week' WHEN date_from < DATE '{AS_OF}' + 30 THEN 'month' WHEN date_from < DATE '{AS_OF}' + 90 THEN 'quarter' ELSE 'later' END"
)


def _bucket():
    return dates.horizon_bucket(F.col("date_from"), F.col("date_to"), F.col("text_orientation"), _ref())


@query(f"{_SIG} SELECT signal_id, hash_id, signal_type, date_from, {_BUCKET} AS bucket FROM sig WHERE {_BUCKET} <> 'past' ORDER BY date_from, signal_id LIMIT 5000")
def horizon_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated signals by horizon bucket, the past left out, at most 5 000."""
    s = corpus.signals(spark, sf_dir).withColumn("bucket", _bucket()).where("bucket <> 'past'")
    return s.orderBy("date_from", "signal_id").limit(5000).select("signal_id", "hash_id", "signal_type", "date_from", "bucket")


@query(f"{_SIG} SELECT {_BUCKET} AS bucket, count(*) AS signals, count(DISTINCT hash_id) AS contents FROM sig WHERE date_from IS NOT NULL GROUP BY 1")
def horizon_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and contents in each bucket."""
    s = corpus.signals(spark, sf_dir).where("date_from is not null")
    return s.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("signals"), F.countDistinct("hash_id").alias("contents"))


@query(f"{_SIG} SELECT signal_type, count(*) FILTER (WHERE date_from IS NULL) AS undated, count(date_from) AS dated FROM sig GROUP BY signal_type")
def undated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with and without a date: unknown is counted, not taken for none."""
    return corpus.signals(spark, sf_dir).groupBy("signal_type").agg(F.count(F.when(F.col("date_from").isNull(), 1)).alias("undated"), F.count("date_from").alias("dated"))


@query(f"{_SIG} SELECT resolution, count(*) AS signals FROM sig WHERE date_from IS NULL OR resolution <> 'resolved' GROUP BY resolution")
def horizon_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose day couldn't be determined: counted, never put into a bucket."""
    s = corpus.signals(spark, sf_dir).where("date_from is null or resolution <> 'resolved'")
    return s.groupBy("resolution").agg(F.count("*").alias("signals"))


#: The dimensions of the facets, and what stands for a null in each.
FACETS = {"detector": "none", "signal_type": "none", "confidence": "unrecorded", "language": "unspecified", "calendar": "none", "resolution": "none", "method": "unrecorded"}


@query(f"{_SIG} " + " UNION ALL ".join(f"SELECT '{d}' AS facet, coalesce({d}, '{null}') AS value, count(*) AS n FROM sig GROUP BY 2" for d, null in FACETS.items()))
def signal_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven facets in one pass of grouping sets; a null is a value of its own."""
    kinds = [F.coalesce(d, F.lit(null)).alias(d) for d, null in FACETS.items()]
    x = corpus.signals(spark, sf_dir).select(*kinds)
    g = x.groupingSets([[F.col(d)] for d in FACETS], *FACETS).agg(F.count("*").alias("n"))
    named = F.coalesce(*(F.when(F.col(d).isNotNull(), F.lit(d)) for d in FACETS))  # the one column of the set
    return g.select(named.alias("facet"), F.coalesce(*FACETS).alias("value"), "n")


_RUNS = """runs AS (SELECT doc_id AS hash_id, CASE WHEN quality = 1 THEN 'v2' WHEN doc_id % 5 > 0 THEN 'v1' END AS version,
CASE WHEN toxic = 1 THEN 'failed' WHEN doc_id % 7 = 0 THEN 'truncated' WHEN doc_id % 11 = 0 THEN 'no_text' ELSE 'complete' END AS status FROM labels)"""


@query(
    _OCC + f", {_RUNS}, c AS (SELECT count(*) AS matching_contents, count(*) FILTER (WHERE r.hash_id IS NULL) AS never_analysed, count(*) FILTER (WHERE status = 'failed') AS failed, "
    "count(*) FILTER (WHERE status <> 'failed' AND version IS DISTINCT FROM 'v2') AS stale_version, count(*) FILTER (WHERE status <> 'failed' AND version = 'v2') AS current, "
    "count(*) FILTER (WHERE status = 'truncated' AND version = 'v2') AS current_truncated, count(*) FILTER (WHERE status = 'no_text' AND version = 'v2') AS current_no_text "
    "FROM contents c LEFT JOIN runs r ON r.hash_id = c.hash_id) SELECT *, never_analysed + failed + stale_version AS not_measured FROM c"
)
def detector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a detector's current version has come: not measured is told from empty."""
    runs = corpus.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("hash_id"), F.when(F.col("quality") == 1, "v2").when(F.col("doc_id") % 5 > 0, "v1").alias("version"),
        F.when(F.col("toxic") == 1, "failed").when(F.col("doc_id") % 7 == 0, "truncated").when(F.col("doc_id") % 11 == 0, "no_text").otherwise("complete").alias("status"),
    )
    j = corpus.content_ids(spark, sf_dir).join(runs, "hash_id", "left")
    n = lambda x: F.count(F.when(x, 1))
    status, current = F.col("status"), F.col("version").eqNullSafe("v2")
    counts = j.agg(
        F.count("*").alias("matching_contents"), n(status.isNull()).alias("never_analysed"), n(status == "failed").alias("failed"),
        n((status != "failed") & ~current).alias("stale_version"), n((status != "failed") & current).alias("current"),
        n((status == "truncated") & current).alias("current_truncated"), n((status == "no_text") & current).alias("current_no_text"),
    )
    return counts.withColumn("not_measured", F.col("never_analysed") + F.col("failed") + F.col("stale_version"))


@query(
    "WITH names AS (SELECT n_nationkey AS place, lower(n_name) AS name FROM nation UNION ALL SELECT 100 + r_regionkey, lower(r_name) FROM region UNION ALL SELECT 200 + n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 5 = 0), "
    "said AS (SELECT c_custkey AS signal, lower(n_name) AS name FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "cand AS (SELECT s.signal, n.place, count(*) OVER (PARTITION BY s.signal) AS k FROM said s JOIN names n USING (name)) "
    "SELECT place, count(*) FILTER (WHERE k = 1) AS identified, count(*) FILTER (WHERE k > 1) AS ambiguous FROM cand GROUP BY place"
)
def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each place: those of one reading and those of several, never added up."""
    nation, region = corpus.table(spark, sf_dir, "nation"), corpus.table(spark, sf_dir, "region")
    name = F.lower("n_name").alias("name")
    names = nation.select(F.col("n_nationkey").alias("place"), name).union(region.select(F.col("r_regionkey") + 100, F.lower("r_name")))
    names = names.union(nation.where("n_nationkey % 5 = 0").select(F.col("n_nationkey") + 200, name))
    readings = names.groupBy("name").agg(F.collect_list("place").alias("places"))  # a gazetteer: small, by name
    said = corpus.table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("signal"), name)
    cand = said.join(F.broadcast(readings), "name").select(F.size("places").alias("k"), F.explode("places").alias("place"))
    return cand.groupBy("place").agg(F.count(F.when(F.col("k") == 1, 1)).alias("identified"), F.count(F.when(F.col("k") > 1, 1)).alias("ambiguous"))


@query(_OCC + " SELECT path_id, file_date, path_id > 500 AS is_new, file_date >= DATE '2024-12-31' - INTERVAL 30 DAY AS recent FROM occ ORDER BY path_id DESC LIMIT 5000")
def latest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest occurrences, new or seen against a reader's baseline of id 500."""
    baseline = spark.createDataFrame([("src", 500)], "reader string, last_id long").select("last_id")
    out = corpus.occurrences(spark, sf_dir).crossJoin(F.broadcast(baseline))  # one row
    recent = F.col("file_date") >= F.date_sub(F.lit("2024-12-31").cast("date"), 30)
    return out.orderBy(F.desc("path_id")).limit(5000).select("path_id", "file_date", (F.col("path_id") > F.col("last_id")).alias("is_new"), recent.alias("recent"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' OR (o_orderdate = TIMESTAMP '1995-06-01' AND o_orderkey > 100) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a composite cursor (date descending, then key)."""
    at = F.lit("1995-06-01 00:00:00").cast("timestamp")
    date = F.col("o_orderdate").cast("timestamp")
    after = (date < at) | ((date == at) & (F.col("o_orderkey") > 100))
    o = corpus.table(spark, sf_dir, "orders").where(after)
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("WITH w AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER v AS prev_key, lead(o_orderkey) OVER v AS next_key, row_number() OVER v AS position FROM orders WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT * FROM w")
def neighbour_prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's neighbours and position in its customer's view."""
    v = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = corpus.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", F.lag("o_orderkey").over(v).alias("prev_key"), F.lead("o_orderkey").over(v).alias("next_key"), F.row_number().over(v).cast("long").alias("position"))


@query("WITH t AS (SELECT o_orderdate AS d, o_orderkey AS k FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)) SELECT count(*) + 1 AS position FROM orders, t WHERE o_orderdate > d OR (o_orderdate = d AND o_orderkey < k)")
def position_in_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the newest key in the view by date: a count of those before it."""
    o = corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    target = o.agg(F.max_by("o_orderdate", "o_orderkey").alias("d"), F.max("o_orderkey").alias("k"))
    before = o.crossJoin(F.broadcast(target)).where((F.col("o_orderdate") > F.col("d")) | ((F.col("o_orderdate") == F.col("d")) & (F.col("o_orderkey") < F.col("k"))))
    return before.agg((F.count("*") + 1).alias("position"))


_TREE = "tree AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part)"


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT id AS node, id, parent, 0 AS depth FROM tree UNION ALL SELECT u.node, t.id, t.parent, u.depth + 1 FROM up u JOIN tree t ON t.id = u.parent WHERE u.depth < 20) SELECT node, id AS ancestor, depth FROM up WHERE depth > 0")
def lineage_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of all nodes, at most twenty steps up."""
    return ancestors(_tree(spark, sf_dir))


def ancestors(tree: DataFrame, most: int = 20) -> DataFrame:
    """node, ancestor and depth, for at most ``most`` steps up the ``tree`` (id, parent).

    A node's ancestors of one depth are its parent's of the depth before. Each depth is joined
    by the parent and kept, so no row of all nodes meets at the few nodes at the top, and a
    recursive query's bound on its rows doesn't hold.
    """
    edges = staged(tree.where("parent is not null").select(F.col("id").alias("child"), "parent"))
    level, found = tree.select(F.col("id").alias("node"), F.col("id").alias("ancestor")), None
    for depth in range(1, most + 1):
        level = staged(edges.join(level, F.col("parent") == F.col("node")).select(F.col("child").alias("node"), "ancestor"))
        own = level.withColumn("depth", F.lit(depth))
        found = own if found is None else found.union(own)
        if level.isEmpty():
            break
    return found


@query(f"WITH RECURSIVE {_TREE}, down AS (SELECT id, 0 AS depth FROM tree WHERE id = 3 UNION ALL SELECT t.id, d.depth + 1 FROM down d JOIN tree t ON t.parent = d.id WHERE d.depth < 20) SELECT id, depth FROM down WHERE depth > 0 ORDER BY depth, id LIMIT 500")
def lineage_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five hundred descendants of a node."""
    _tree(spark, sf_dir)
    return spark.sql(
        "WITH RECURSIVE down AS (SELECT id, 0 AS depth FROM docquarry_tree WHERE id = 3 UNION ALL "
        "SELECT t.id, d.depth + 1 FROM down d JOIN docquarry_tree t ON t.parent = d.id WHERE d.depth < 20) SELECT id, depth FROM down WHERE depth > 0 ORDER BY depth, id LIMIT 500"
    )


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey > 1 THEN p_partkey div 2 END").alias("parent"))
    part.createOrReplaceTempView("docquarry_tree")
    return part
