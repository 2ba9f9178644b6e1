"""Criteria queries over the corpus: expressions, phrases, structured filters, keywords, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.plans import criteria as C
from docquarry.plans.registry import query
from docquarry.sources import corpus


def phrase_count(joined: Column, phrase: str) -> Column:
    """How often a word sequence occurs in words that have a space on each side of each.

    Overlaps count. Occurrences share no character unless the phrase ends as it begins;
    then they are counted by the length that removing them takes away, else by a
    look-ahead that matches at each place without using it up.
    """
    words = phrase.split()
    wanted = f" {'  '.join(words)} "
    if any(words[:k] == words[-k:] for k in range(1, len(words))):
        return F.regexp_count(joined, F.lit(rf"(?=\Q{wanted}\E)")).cast("long")
    removed = F.length(joined) - F.length(F.replace(joined, F.lit(wanted), F.lit("")))
    return F.floor(removed / len(wanted)).cast("long")


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id, keyword_id and occurrences, for the contents that hold a keyword."""
    joined = F.concat(F.lit(" "), F.array_join(corpus.words_in(F.col("text")), "  "), F.lit(" "))
    counts = lambda w: F.array(*(F.struct(F.lit(i).alias("keyword_id"), phrase_count(w, p).alias("n")) for i, p in corpus.KEYWORDS))
    each = F.flatten(F.transform(F.array(joined), counts))  # the words are taken apart once, not once a keyword
    hits = corpus.texts(spark, sf_dir).select("hash_id", F.explode(each).alias("k")).select("hash_id", "k.keyword_id", "k.n").where("n > 0")
    return hits.join(corpus.content_ids(spark, sf_dir), "hash_id", "left_semi")


KEYWORD_SQL = corpus.KEYWORDS_SQL + r"""
, seq AS (SELECT hash_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM contents
), pos AS (SELECT hash_id, w, unnest(range(1, len(w) + 1)) AS i FROM seq
), hits AS (
  SELECT p.hash_id, k.keyword_id, count(*) AS n FROM pos p JOIN kw k
    ON array_to_string(list_slice(p.w, p.i, p.i + len(string_split(k.phrase, ' ')) - 1), ' ') = k.phrase GROUP BY p.hash_id, k.keyword_id
)"""


def category_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash_id and category where the content holds a word of the category."""
    tax = F.broadcast(corpus.taxonomy(spark))  # a few literal rows
    return corpus.words(spark, sf_dir).join(tax, "word").select("hash_id", "category").distinct()


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences that analysts have filed: here those labelled of quality."""
    return corpus.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("path_id")).distinct()


def matched(spark: SparkSession, sf_dir: str, allowed: tuple[str, ...] | None = None, **wanted) -> DataFrame:
    """Occurrences that match the given criteria."""
    c = C.Criteria(**wanted)
    return C.compile_paths(
        c, corpus.occurrences(spark, sf_dir), corpus.texts(spark, sf_dir),
        keyword_hits(spark, sf_dir) if c.keywords else None, category_hits(spark, sf_dir) if c.categories else None,
        assigned(spark, sf_dir) if c.analyst_scope != "all" else None, allowed,
    )


_OCC = f"WITH {corpus.SQL}"
_NAMES = "(lower(t.text) LIKE '%{0}%' OR lower(file_name) LIKE '%{0}%' OR lower(file_type) LIKE '%{0}%' OR lower(source) LIKE '%{0}%' OR lower(side) LIKE '%{0}%')"
_JOINED = f"{_OCC} SELECT path_id, o.hash_id FROM occ o JOIN contents t ON t.hash_id = o.hash_id WHERE "


@query(_JOINED + f"({_NAMES.format('idiot')} OR {_NAMES.format('license')}) AND NOT {_NAMES.format('src3')}")
def criteria_boolean(spark, sf_dir):
    """A boolean expression over text and names."""
    return matched(spark, sf_dir, text="(idiot OR license) NOT src3").select("path_id", "hash_id")


@query(_JOINED + r"regexp_matches(t.text, '(?i)(^|[^\p{L}\p{N}_])apache\s+license([^\p{L}\p{N}_]|$)')")
def criteria_phrase(spark, sf_dir):
    """A phrase between word borders."""
    return matched(spark, sf_dir, phrases=("apache license",)).select("path_id", "hash_id")


@query(_JOINED + "(" + " OR ".join(rf"regexp_matches({c}, '(?i)(^|[^\p{{L}}\p{{N}}_])trash([^\p{{L}}\p{{N}}_]|$)')" for c in ("t.text", "file_name", "file_type", "source", "side")) + ")")
def criteria_whole_word(spark, sf_dir):
    """A term as a whole word."""
    return matched(spark, sf_dir, text="trash", whole_word=True).select("path_id", "hash_id")


@query(_JOINED + "(contains(t.text, 'The') OR contains(file_name, 'The') OR contains(file_type, 'The') OR contains(source, 'The') OR contains(side, 'The'))")
def criteria_case_sensitive(spark, sf_dir):
    """A term with its case."""
    return matched(spark, sf_dir, text="The", case_sensitive=True).select("path_id", "hash_id")


@query(_OCC + " SELECT path_id, hash_id FROM occ WHERE source IN ('src1', 'src2') AND file_type IN ('en', 'fr') AND file_status = 'Read' AND file_date BETWEEN DATE '2024-03-01' AND DATE '2024-09-30'")
def criteria_structured_filters(spark, sf_dir):
    """Sources, types, status and an inclusive date range."""
    return matched(spark, sf_dir, sources=("src1", "src2"), file_types=("en", "fr"), file_statuses=("Read",), date_from="2024-03-01", date_to="2024-09-30").select("path_id", "hash_id")


@query(_OCC + " SELECT path_id, hash_id FROM occ WHERE 1 = 0")
def criteria_status_empty(spark, sf_dir):
    """An empty list of statuses matches nothing."""
    return matched(spark, sf_dir, file_statuses=()).select("path_id", "hash_id")


_KW = f"{_OCC}, {KEYWORD_SQL} SELECT path_id, hash_id FROM occ WHERE hash_id "


@query(_KW + "IN (SELECT hash_id FROM hits WHERE keyword_id IN (1, 2) GROUP BY hash_id HAVING count(DISTINCT keyword_id) = 2)")
def keyword_and(spark, sf_dir):
    """Contents that hold all of the keywords."""
    return matched(spark, sf_dir, keywords=(1, 2), keyword_logic="AND").select("path_id", "hash_id")


@query(_KW + "IN (SELECT hash_id FROM hits WHERE keyword_id IN (3, 5))")
def keyword_or(spark, sf_dir):
    """Contents that hold any of the keywords."""
    return matched(spark, sf_dir, keywords=(3, 5)).select("path_id", "hash_id")


@query(_KW + "NOT IN (SELECT hash_id FROM hits WHERE keyword_id IN (1, 4))")
def keyword_not(spark, sf_dir):
    """Contents that hold none of the keywords."""
    return matched(spark, sf_dir, keywords=(1, 4), keyword_logic="NOT").select("path_id", "hash_id")


@query(f"{_OCC}, {corpus.TAXONOMY_SQL} SELECT path_id, hash_id FROM occ WHERE hash_id IN (SELECT hash_id FROM words JOIN tax USING (word) WHERE category IN ('rare'))")
def category_filter(spark, sf_dir):
    """Contents with a word of a category."""
    return matched(spark, sf_dir, categories=("rare",)).select("path_id", "hash_id")


@query(_OCC + " SELECT path_id FROM occ WHERE path_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def analyst_scope_categorized(spark, sf_dir):
    """Occurrences that analysts have filed."""
    return matched(spark, sf_dir, analyst_scope="categorized").select("path_id")


@query(_OCC + " SELECT path_id FROM occ WHERE path_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def analyst_scope_uncategorized(spark, sf_dir):
    """Occurrences that nobody has filed."""
    return matched(spark, sf_dir, analyst_scope="uncategorized").select("path_id")


@query(_OCC + " SELECT count(DISTINCT hash_id) AS matched FROM occ WHERE side = 'en'")
def unit_hash_count(spark, sf_dir):
    """Matches counted by content."""
    return C.count(matched(spark, sf_dir, sides=("en",)), "hash")


@query(_OCC + " SELECT count(DISTINCT path_id) AS matched FROM occ WHERE side = 'en'")
def unit_path_count(spark, sf_dir):
    """Matches counted by occurrence."""
    return C.count(matched(spark, sf_dir, sides=("en",)), "path")


@query(_OCC + " SELECT path_id, source FROM occ WHERE source IN ('src4', 'src5') AND side = 'fr'")
def access_scope_restricted(spark, sf_dir):
    """A reader who may see two sources."""
    return matched(spark, sf_dir, allowed=("src4", "src5"), sides=("fr",)).select("path_id", "source")


@query(_OCC + " SELECT path_id, file_date FROM occ WHERE side = 'de' ORDER BY file_date DESC, path_id LIMIT 25 OFFSET 25")
def criteria_page_paths(spark, sf_dir):
    """The second page of matches, newest first."""
    return C.page(matched(spark, sf_dir, sides=("de",)), "path", 25, 25)


@query(_OCC + " SELECT DISTINCT hash_id FROM occ WHERE side = 'de' ORDER BY hash_id LIMIT 25 OFFSET 50")
def criteria_page_hashes(spark, sf_dir):
    """The third page of matching contents."""
    return C.page(matched(spark, sf_dir, sides=("de",)), "hash", 25, 50)


@query(f"{_OCC}, {KEYWORD_SQL}, known AS (SELECT hash_id, keyword_id, CASE WHEN hash_id % 50 <> 7 THEN n END AS n FROM hits) "
    "SELECT keyword_id, phrase AS label, CAST(count(h.hash_id) AS BIGINT) AS contents, CAST(coalesce(sum(n), 0) AS BIGINT) AS occurrences, "
    "CAST(count(h.hash_id) - count(n) AS BIGINT) AS unknown_count_rows, (SELECT count(*) FROM contents) AS corpus_contents FROM kw LEFT JOIN known h USING (keyword_id) GROUP BY keyword_id, phrase")
def keyword_intelligence(spark, sf_dir):
    """All keywords with their contents and occurrences, those without any too.

    Counts of contents of some ids are unknown: left out of the sum and counted apart.
    """
    names = spark.createDataFrame(corpus.KEYWORDS, "keyword_id int, label string")
    known = F.when(F.col("hash_id") % 50 != 7, F.col("n"))
    hits = keyword_hits(spark, sf_dir).groupBy("keyword_id").agg(F.count("*").alias("contents"), F.sum(known).alias("occurrences"), F.count(F.when(known.isNull(), 1)).alias("unknown_count_rows"))
    size = corpus.content_ids(spark, sf_dir).agg(F.count("*").alias("corpus_contents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(hits, "keyword_id", "left").crossJoin(F.broadcast(size)).select("keyword_id", "label", zero("contents"), zero("occurrences"), zero("unknown_count_rows"), "corpus_contents")  # size: one row


@query(
    f"{_OCC}, {corpus.TAXONOMY_SQL}, hit AS (SELECT category, hash_id, n FROM words JOIN tax USING (word)), "
    "size AS (SELECT count(*) AS total FROM contents) "
    "SELECT t.category, CAST(t.members AS BIGINT) AS member_words, CAST(coalesce(h.c, 0) AS BIGINT) AS contents, CAST(coalesce(h.n, 0) AS BIGINT) AS occurrences, "
    "round(CASE WHEN total > 0 THEN coalesce(h.c, 0) * 100.0 / total END, 4) AS share "
    "FROM (SELECT category, count(*) AS members FROM tax GROUP BY category) t LEFT JOIN (SELECT category, count(DISTINCT hash_id) AS c, sum(n) AS n FROM hit GROUP BY category) h USING (category) CROSS JOIN size"
)
def category_analysis(spark, sf_dir):
    """Each category's members, contents, occurrences and share of contents."""
    tax = corpus.taxonomy(spark)
    hit = corpus.words(spark, sf_dir).join(F.broadcast(tax), "word").groupBy("category").agg(F.countDistinct("hash_id").alias("c"), F.sum("n").alias("n"))
    total = corpus.content_ids(spark, sf_dir).agg(F.count("*").alias("total"))
    members = tax.groupBy("category").agg(F.count("*").alias("member_words"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return members.join(hit, "category", "left").crossJoin(F.broadcast(total)).select(
        "category", "member_words", zero("c", "contents"), zero("n", "occurrences"),
        F.round(F.when(F.col("total") > 0, F.coalesce("c", F.lit(0)) * 100.0 / F.col("total")), 4).alias("share"),
    )
