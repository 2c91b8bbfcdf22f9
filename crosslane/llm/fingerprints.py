"""Merkle fingerprints of documents, in DataFrame functions only.

A text is sections (parted by blank lines) of paragraphs (lines) of leaves: phrases of at most four words that also end where a
sentence ends. Every node is a hash of its children, so equal roots mean equal texts, and comparing trees from the
root down reaches only the branches that differ. A fingerprint writes the tree as text:
``root|section/section`` with ``paragraph;paragraph`` in a section and ``digest,leaf,leaf`` in a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslane.llm.common import scratch, table

LEAF_WORDS = 4
NO_ID = -(1 << 63)
# Up to three words that end no sentence, then one more word, with the white space around them; or white space alone.
LEAF = rf"\s*+(?:\S++(?<![.!?])\s++){{0,{LEAF_WORDS - 1}}}\S++\s*+|\s++"


def leaf_tree(text: Column) -> Column:
    """Leaf hashes as array<array<array<bigint>>>: sections, paragraphs, leaves. Joined, the leaves are the text."""

    def leaves(paragraph: Column) -> Column:
        return F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x))

    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))


def paragraph_digests(tree: Column) -> Column:
    """array<array<string>>: each paragraph's digest over its leaves."""
    return F.transform(
        tree, lambda s: F.transform(s, lambda p: F.sha2(F.array_join(F.transform(p, lambda x: F.hex(x)), ","), 256))
    )


def section_digests(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: F.sha2(F.array_join(s, ","), 256))


def root_digest(sections: Column) -> Column:
    return F.sha2(F.array_join(sections, ","), 256)


def fingerprint_text(root: Column, paragraphs: Column, tree: Column) -> Column:
    def paragraph(digest: Column, leaves: Column) -> Column:
        return F.concat_ws(",", F.substring(digest, 1, 16), F.transform(leaves, lambda x: F.substring(F.lpad(F.hex(x), 16, "0"), 9, 8)))

    parts = F.zip_with(paragraphs, tree, lambda ds, ls: F.array_join(F.zip_with(ds, ls, paragraph), ";"))
    return F.concat(root, F.lit("|"), F.array_join(parts, "/"))


def add_fingerprint(frame: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}tree``, ``{prefix}paragraphs``, ``{prefix}root``, ``{prefix}leaves`` and ``{prefix}fingerprint``."""
    frame = frame.withColumn(f"{prefix}tree", leaf_tree(F.col(text)))
    frame = frame.withColumn(f"{prefix}paragraphs", paragraph_digests(F.col(f"{prefix}tree")))
    frame = frame.withColumn(f"{prefix}root", root_digest(section_digests(F.col(f"{prefix}paragraphs"))))
    frame = frame.withColumn(f"{prefix}leaves", F.array_distinct(F.flatten(F.flatten(f"{prefix}tree"))))
    said = fingerprint_text(F.col(f"{prefix}root"), F.col(f"{prefix}paragraphs"), F.col(f"{prefix}tree"))
    return frame.withColumn(f"{prefix}fingerprint", said)


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 where the roots are equal, else twice the shared leaves over all leaves."""
    both = F.size(leaves_a) + F.size(leaves_b)
    shared = 2.0 * F.size(F.array_intersect(leaves_a, leaves_b)) / both
    return F.when(root_a == root_b, 1.0).when(both == 0, 0.0).otherwise(shared)


def differing_paragraphs(paragraphs_a: Column, paragraphs_b: Column) -> Column:
    """Places (counted through all sections) of the paragraphs whose digests differ; a missing one differs."""
    pairs = F.zip_with(F.flatten(paragraphs_a), F.flatten(paragraphs_b), lambda a, b: ~a.eqNullSafe(b))
    return F.filter(F.transform(pairs, lambda differs, i: F.when(differs, i)), lambda i: i.isNotNull())


def neighbours(keys: DataFrame) -> DataFrame:
    """Per distinct (key, text_hash) the one before it in ascending order, the first after the last, and its size.

    Keys only: rows are dealt by ranges, ordered inside each range, and the ends of ranges (one row each) are linked.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "text_hash"]
    dealt = keys.distinct().repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt, _ = scratch(dealt, "fingerprint-order")
    row = F.struct("key", "text_hash", "n_chars")
    ends = dealt.groupBy("part").agg(F.max(row).alias("last"))
    chain = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(chain).alias("ended"), F.max("last").over(Window.partitionBy(F.lit(1))).alias("end"))
    ends = ends.select("part", F.coalesce("ended", "end").alias("ended"))
    inside = Window.partitionBy("part").orderBy(*order)
    before = F.coalesce(F.lag(row).over(inside), F.col("ended"))
    linked = dealt.join(ends, "part").select("key", "text_hash", before.alias("before"))
    return linked.select(
        "key",
        "text_hash",
        F.col("before.key").alias("before_key"),
        F.col("before.text_hash").alias("before_hash"),
        F.col("before.n_chars").alias("before_chars"),
    )


def edit_with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_chars, the text with its last quarter replaced by the head of the next one, the next one's root and leaves.

    Texts are shuffled once: both joins read the same exchange. A document sends only the needed head and its leaves to the
    one before it. Null texts are empty. Null ids count as the smallest id; rows that repeat an id are ordered by the
    hash of their text, and identical rows share their place and neighbour.
    """
    rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    near, _ = scratch(neighbours(rows.select("key", "text_hash", F.length("text").alias("n_chars"))), "fingerprint-neighbours")
    sent = rows.join(near, ["key", "text_hash"]).select(
        F.col("before_key").alias("key"),
        F.col("before_hash").alias("text_hash"),
        F.substr("text", F.lit(1), F.floor(F.col("before_chars") / 4).cast("int")).alias("head"),
        F.col("text").alias("next_text"),
    )
    sent = add_fingerprint(sent, "next_text", "next_").select("key", "text_hash", "head", "next_root", "next_leaves")
    joined = rows.join(sent.dropDuplicates(["key", "text_hash"]), ["key", "text_hash"])
    joined = joined.withColumn("n_chars", F.length("text"))
    kept = F.substr("text", F.lit(1), F.col("n_chars") - F.floor(F.col("n_chars") / 4).cast("int"))
    doc_id = F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id")
    return joined.select(doc_id, "text", "n_chars", F.concat(kept, F.col("head")).alias("edited"), "next_root", "next_leaves")


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    frame = edit_with_next(table(spark, sf_dir, "documents"))
    frame = add_fingerprint(add_fingerprint(frame, "text"), "edited", "edited_")
    return frame.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("root"), F.col("leaves"), F.col("edited_root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near_next"),
        F.size(differing_paragraphs(F.col("paragraphs"), F.col("edited_paragraphs"))).cast("long").alias("paragraphs_edited"),
    )
