"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

Each line's sites go into a HyperLogLog sketch, and sketches of equal lines merge in the aggregation, so a line on every page
of the corpus is one small row per task before the shuffle. Sketches decide what is far from the threshold; lines near
it get an exact distinct count.

Which lines go has two rules. With ``max_share`` (the rule of OP5_SQL) a document that is mostly such lines keeps them all. Without
it, as in the pipeline, a line's sites are counted over one document per group of page copies, and it goes from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslane.llm.common import scratch, table
from crosslane.llm.components import components

MIN_SITES = 5
MIN_CHARS = 10
MAX_SHARE = 0.5
SKETCH_LG = 12
# Share of the threshold around it that is counted exactly: over five standard errors of the sketch.
NEAR = 0.1
# Words of a shingle by which copies of a page are told, as in near-duplicate removal.
PAGE_WORDS = 5
BIG, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> list[Column]:
    """128 bits of the trimmed line: two streams of a 64-bit hash."""
    plain = F.trim(line)
    return [F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(5), plain, F.length(plain)).alias("h2")]


def lines_of(documents: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """key, text hash, site, place, line; null texts have no lines, a null site is a site of its own."""
    return documents.select(
        F.col(key).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.col(site).isNull(), F.col(site)).alias("site"),
        F.posexplode(F.split(text, "\n", -1)).alias("place", "line"),
    )


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> tuple[DataFrame, list[str]]:
    """Keys (h1, h2) of the lines on at least ``min_sites`` sites, and the scratch tables behind them.

    Lines shorter than ``min_chars`` characters are part of ordinary structure and are never boilerplate.
    """
    spark = lines.sparkSession
    long = lines.where(F.length(F.trim("line")) >= min_chars).select(*line_key(F.col("line")), "site")
    low, high = int(min_sites * (1 - NEAR)), int(min_sites * (1 + NEAR)) + 1
    spread = (
        long.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", SKETCH_LG).alias("sites"), F.min("site").alias("least"), F.max("site").alias("most"))
        # A line on one site needs no estimate.
        .where((F.col("least") < F.col("most")) | F.lit(min_sites <= 1))
        .select("h1", "h2", F.hll_sketch_estimate("sites").alias("estimate"))
        .where(F.col("estimate") >= low)
    )
    spread, spread_path = scratch(spread, "line-spread")
    near = spread.where(F.col("estimate") <= high).select("h1", "h2")
    # Distinct (line, site) pairs are formed before the last shuffle, so a frequent line weighs as much as its sites.
    exact = (
        long.join(near, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "site")
        .agg(F.count("*").alias("n"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("h1", "h2")
    )
    found = spread.where(F.col("estimate") > high).select("h1", "h2").unionByName(exact)
    found, found_path = scratch(found, "line-boilerplate")
    return found, [spread_path, found_path]


def shingles(text: Column, width: int = PAGE_WORDS) -> Column:
    """Hashes of the distinct shingles of a text; fewer words than a shingle are one shingle, none are none."""
    found = F.regexp_extract_all(F.translate(text, BIG, SMALL), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def of(words: Column) -> Column:
        wide = F.least(F.lit(width), F.size(words))
        hashed = F.transform(F.sequence(F.lit(1), F.size(words) - wide + 1), lambda k: F.xxhash64(F.slice(words, k, wide)))
        return F.when(F.size(words) > 0, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))

    # The words are the variable of a lambda, so they are found once and not for every shingle.
    return F.transform(F.array(found), of)[0]


def page_copies(documents: DataFrame, pages: DataFrame, text: str) -> DataFrame:
    """(node, root): texts (by hash) that are copies of one page, out of ``pages`` (text_hash, h1, h2).

    Every text is held against the smallest text of each of its lines. They are copies where near-duplicate removal would link
    them (0.8 of their shingles in common), which a page with shared lines and a text of its own does not reach.
    """
    leaders = pages.groupBy("h1", "h2").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("last")).where("a < last")
    pairs = pages.join(leaders, ["h1", "h2"]).where("text_hash != a").select("a", F.col("text_hash").alias("b")).distinct()
    pairs, _ = scratch(pairs, "line-pairs")
    named = pairs.select(F.col("a").alias("text_hash")).unionByName(pairs.select(F.col("b").alias("text_hash"))).distinct()
    texts = documents.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    texts = texts.join(named, "text_hash", "left_semi").distinct()
    sets = texts.select("text_hash", shingles(F.col("text")).alias("set")).select("text_hash", F.size("set").alias("n"), "set")
    sets, _ = scratch(sets, "line-sets")
    # Sizes alone first: sets travel only with pairs that can be similar enough.
    sizes = sets.select("text_hash", "n")
    pairs = (
        pairs.join(sizes.toDF("a", "n_a"), "a")
        .join(sizes.toDF("b", "n_b"), "b")
        .where((5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")))
    )
    both = pairs.join(sets.select(F.col("text_hash").alias("b"), F.col("set").alias("set_b")), "b").join(
        sets.select(F.col("text_hash").alias("a"), F.col("set").alias("set_a")), "a"
    )
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links = both.select("a", "b", "n_a", "n_b", shared.alias("shared")).where("5 * shared >= 4 * (n_a + n_b - shared)")
    return components(links.select("a", "b"))


def spread_over_pages(documents: DataFrame, lines: DataFrame, found: DataFrame, text: str, min_sites: int, min_chars: int) -> DataFrame:
    """Those of the lines ``found`` that are on ``min_sites`` sites with one document (of the smallest site) per page.

    Copies of a page repeat all its lines on their sites; that alone makes none of them boilerplate.
    """
    rows = lines.where(F.length(F.trim("line")) >= min_chars).select("text_hash", "site", *line_key(F.col("line")))
    pages = rows.join(found, ["h1", "h2"], "left_semi").groupBy("text_hash", "h1", "h2").agg(F.min("site").alias("site"))
    pages, _ = scratch(pages, "line-pages")
    roots = page_copies(documents, pages, text).withColumnRenamed("node", "text_hash")
    rooted = pages.join(roots, "text_hash", "left").withColumn("page", F.coalesce("root", "text_hash"))
    sites = rooted.groupBy("page").agg(F.min("site").alias("site"))
    counted = rooted.select("h1", "h2", "page").distinct().join(sites, "page").groupBy("h1", "h2", "site").agg(F.count("*").alias("n"))
    spread = counted.groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2")
    return scratch(spread, "line-spread")[0]


def mark_boilerplate(
    documents: DataFrame,
    key: str = "doc_id",
    site: str = "source",
    text: str = "text",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
    max_share: float | None = MAX_SHARE,
) -> DataFrame:
    """All columns of ``documents`` as ``whole``, with n_lines, n_boilerplate, n_removed and clean_text.

    A document whose boilerplate lines hold more than ``max_share`` of its characters is a copy of a whole page, not a
    page with boilerplate: its lines stay, for near-duplicate removal to decide. With ``max_share`` None, copies of a page count
    as one document when a line's sites are counted, and boilerplate lines go whatever their share. Null texts stay null and have no
    lines. Repeated rows are cleaned alike. All rows come back; rows travel packed, so no column name can clash.
    """
    lines = lines_of(documents, key, site, text)
    found, _ = boilerplate_lines(lines, min_sites, min_chars)
    if max_share is None:
        found = spread_over_pages(documents, lines, found, text, min_sites, min_chars)
    hits = (
        lines.where(F.length(F.trim("line")) >= min_chars)
        .select("key", "text_hash", "place", *line_key(F.col("line")))
        .join(found, ["h1", "h2"], "left_semi")
        .groupBy("key", "text_hash")
        .agg(F.collect_set("place").alias("places"))
        .select(F.col("key").alias("hit_key"), F.col("text_hash").alias("hit_hash"), "places")
    )
    packed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"),
        F.col(key).alias("key"),
        F.xxhash64(text).alias("text_hash"),
        F.col(text).alias("text"),
    )
    joined = packed.join(
        hits, F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("text_hash") == F.col("hit_hash")), "left"
    ).withColumn("lines", F.when(F.col("text").isNotNull(), F.split("text", "\n", -1)))
    size = F.coalesce(F.size("lines"), F.lit(0))
    places = F.coalesce(F.col("places"), F.array().cast("array<int>"))
    chars = F.aggregate(F.transform(places, lambda p: F.length(F.col("lines")[p])), F.lit(0).cast("long"), lambda a, x: a + x)
    joined = joined.withColumn("hits", places).withColumn("n_lines", F.greatest(size, F.lit(0)).cast("long"))
    copied = F.lit(False) if max_share is None else chars > max_share * (F.length("text") - F.col("n_lines") + 1)
    joined = joined.withColumn("copied", copied)
    joined = joined.withColumn("gone", F.when(~F.col("copied"), F.col("hits")).otherwise(F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    clean = F.when(F.size("gone") > 0, F.array_join(F.transform(kept, lambda p: F.col("lines")[p]), "\n")).otherwise(F.col("text"))
    return joined.select(
        "whole",
        "n_lines",
        F.size("hits").cast("long").alias("n_boilerplate"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        clean.alias("clean_text"),
    )


def remove_boilerplate(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents with boilerplate lines cut; every row and every column stays."""
    marked = mark_boilerplate(documents, text=text, **options)
    return marked.select(*[(F.col("clean_text") if c == text else F.col("whole")[c]).alias(c) for c in documents.columns])


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    marked = mark_boilerplate(table(spark, sf_dir, "documents"))
    return marked.select(
        F.col("whole.doc_id").alias("doc_id"),
        "n_lines",
        "n_boilerplate",
        "n_removed",
        F.length("clean_text").cast("long").alias("clean_chars"),
        F.sha2("clean_text", 256).alias("clean_sha256"),
    )


OP5_SQL = """
WITH s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, coalesce(source, '') AS source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM s),
b AS (SELECT trim(line) AS t FROM l WHERE length(trim(line)) >= 10 GROUP BY 1 HAVING count(DISTINCT source) >= 5),
m AS (SELECT l.*, b.t IS NOT NULL AS hit FROM l LEFT JOIN b ON trim(l.line) = b.t),
a AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_boilerplate,
    coalesce(sum(length(line)) FILTER (WHERE hit), 0) > 0.5 * sum(length(line)) AS copied,
    coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT hit), '') AS rest
  FROM m GROUP BY doc_id),
r AS (
  SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_boilerplate, 0) AS n_boilerplate,
    CASE WHEN copied THEN 0 ELSE coalesce(n_boilerplate, 0) END AS n_removed,
    CASE WHEN copied OR coalesce(n_boilerplate, 0) = 0 THEN text ELSE rest END AS clean
  FROM s LEFT JOIN a USING (doc_id))
SELECT doc_id, n_lines::BIGINT AS n_lines, n_boilerplate::BIGINT AS n_boilerplate, n_removed::BIGINT AS n_removed,
  length(clean)::BIGINT AS clean_chars, sha256(clean) AS clean_sha256
FROM r
"""
