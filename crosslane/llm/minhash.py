"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of bands are computed per distinct shingle set, ``BANDS`` bands of ``BAND_HASHES`` minhashes each. A
table key pairs one band of the first collection with one of the second, so 12 x 12 tables of 6 minhashes cost 72 minhashes, not
864. A pair with similarity s meets in a table with probability (1 - (1 - s^3)^12)^2: 0.9996 at s = 0.8.

Links are confirmed on full sets, and no candidate is skipped:

1. Documents with equal sets are one class with a number of its own; only classes go on, so an id that is null or repeated
   links nothing. A class is read from its row with the smallest (id, text hash).
2. A band that no other document has cannot meet anyone: only combinations of shared bands become table keys.
3. In each bucket all members are compared with its smallest id. Links join components.
4. Buckets that still hold several components name the documents whose other pairs are open. Those go through an exact
   prefix join on their rarest shingles (with the positional bound), which finds every pair above the threshold among
   them without listing the pairs of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosslane.llm.common import LOWER_BYTES, drop_path, scratch, small_batches, table, text_bytes, to_batch
from crosslane.llm.components import components

SHINGLE_WORDS = 5
BANDS = 12
BAND_HASHES = 3
LANES = 2 * BANDS * BAND_HASHES
# Ids that a broadcast may hold (8 bytes each); their number is counted first, and more ids go through a shuffle.
BROADCAST_IDS = 1_000_000
NO_ID = -(1 << 63)

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    return (x ^ (x >> np.uint64(27))) * MIX_A


def lane_values(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the minhash lanes, by a rule."""
    steps = np.arange(1, count + 1, dtype=np.uint64)
    return mixed(steps * MIX_A) | np.uint64(1), mixed(steps * MIX_B + np.uint64(7))


FACTORS, OFFSETS = lane_values(LANES)


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than a shingle are one shingle, none are none."""
    found = raw.translate(LOWER_BYTES).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    width = min(words, len(found))
    out = np.full(len(found) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out) + hashes[k : k + len(out)]
    return np.unique(mixed(out))


def bands(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """The 2 x BANDS band hashes of a set, block by block."""
    least = np.full(LANES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), block):
        values = shingles[None, k : k + block] * FACTORS[:, None] + OFFSETS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    out = np.zeros(2 * BANDS, dtype=np.uint64)
    for lane in least.reshape(2 * BANDS, BAND_HASHES).T:
        out = mixed(out) + lane
    return mixed(out).view(np.int64)


SKETCH = pa.schema(
    [("id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))]
)


def row_name(key: str, text: str) -> list[Column]:
    """id (NO_ID where null) and text hash: rows that agree in both are one document."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_bytes(text)).alias("text_hash")]


def sketch(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id (NO_ID where null), text hash, set size, 128-bit name of the set, bands."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text_hash, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = shingle_set(raw, words)
                name = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), dtype=np.int64)
                rows.append((doc, text_hash, len(found), int(name[0]), int(name[1]), bands(found) if len(found) else None))
            yield to_batch(rows, SKETCH)

    return documents.select(*row_name(key, text), text_bytes(text).alias("raw")).mapInArrow(
        run, "id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>"
    )


def shared_tables(classes: DataFrame) -> DataFrame:
    """(key, id): a row for every table in which both bands of the document's key are shared with some other document."""
    rows = classes.select("id", F.posexplode("bands").alias("band", "value"))
    shared = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select("band", "value")
    live = rows.join(shared, ["band", "value"], "left_semi")
    # At most 2 x BANDS rows per document meet here.
    held = live.groupBy("id").agg(F.collect_list(F.struct("band", "value")).alias("live"))
    first = F.filter("live", lambda x: x["band"] < BANDS)
    second = F.filter("live", lambda x: x["band"] >= BANDS)
    pairs = held.select("id", F.explode(first).alias("a"), second.alias("second")).select("id", "a", F.explode("second").alias("b"))
    return pairs.select(F.xxhash64("a.band", "a.value", "b.band", "b.value").alias("key"), "id")


def sets_of(documents: DataFrame, ids: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, shingles) of the named documents, shingles as packed sorted 64-bit integers."""
    rows = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), text_bytes(text).alias("raw"))
    few = ids.count() <= BROADCAST_IDS
    return packed_sets(rows.join(F.broadcast(ids) if few else ids, "id", "left_semi"), words)


def sets_of_classes(documents: DataFrame, classes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, shingles) of ``classes`` (node, id, text_hash), each once; here id is the class's node."""
    few = classes.count()
    rows = documents.select(*row_name(key, text), text_bytes(text).alias("raw"))
    rows = rows.join(F.broadcast(classes) if few <= BROADCAST_IDS else classes, ["id", "text_hash"])
    sets, _ = scratch(packed_sets(rows.select(F.col("node").alias("id"), "raw"), words), "minhash-sets")
    # Rows that repeat id and text give the same set again.
    return sets if sets.count() == few else scratch(sets.dropDuplicates(["id"]), "minhash-sets")[0]


def packed_sets(rows: DataFrame, words: int) -> DataFrame:
    """(id, shingles) out of (id, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shingle_set(raw, words).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles binary")


def similar(a: bytes, b: bytes) -> bool:
    """100 * intersection >= 80 * union."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
        .select("a", "b", "set_a", "set_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            good = pa.array([similar(a, b) for a, b in sides], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return joined.mapInArrow(run, "a long, b long")


def open_pairs(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Every pair (a, b) of different components among ``labels`` (id, root) that can reach the threshold, and few others.

    Shingles are ordered from rare to frequent. If two sets are similar enough, the smaller one has a common shingle in
    its first n - ceil(8n/9) + 1, the larger one in its first n - ceil(4n/5) + 1, and at the first common one enough of both sets is
    left. A frequent passage stands at the end of this order, so the documents that share it do not meet there.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, root, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                values = np.frombuffer(raw, dtype=np.int64)
                n = len(values)
                columns = [np.full(n, i), np.full(n, root), np.full(n, n), values]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "root", "n", "shingle"])

    rows = sets.join(labels, "id").select("id", "root", "shingles").mapInArrow(unpack, "id long, root long, n long, shingle long")
    spread = rows.groupBy("shingle").agg(F.count("*").alias("found"), F.min("root").alias("r1"), F.max("root").alias("r2"))
    ranked = rows.join(spread, "shingle").groupBy("id", "root", "n").agg(
        F.sort_array(F.collect_list(F.struct("found", "shingle", (F.col("r1") < F.col("r2")).alias("meets")))).alias("order")
    )
    wide = (F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1).cast("int")
    head = ranked.select("id", "root", "n", F.posexplode(F.slice("order", F.lit(1), wide)).alias("place", "x"))
    head = head.where("x.meets").select("id", "root", "n", "place", F.col("x.shingle").alias("shingle"))
    short = head.where(F.col("place") < F.col("n") - F.ceil(F.col("n") * 8 / 9) + 1)
    a, b = short.alias("a"), head.alias("b")
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    met = a.join(
        b,
        (F.col("a.shingle") == F.col("b.shingle"))
        & (F.col("a.root") != F.col("b.root"))
        & ordered
        & (5 * F.col("a.n") >= 4 * F.col("b.n"))
        & (9 * left >= 4 * (F.col("a.n") + F.col("b.n"))),
    )
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def marked_rows(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """id (NO_ID where null), text_hash, n_shingles, component (its smallest id) and kept per document row."""
    spark = documents.sparkSession
    drawn, _ = scratch(sketch(documents, key, text, words), "minhash-sketch")
    sized = drawn.where("n_shingles > 0")
    # Equal sets have equal bands: one row per set leaves the tasks, however many copies there are.
    classes = sized.groupBy("s1", "s2").agg(F.min(F.struct("id", "text_hash")).alias("first"), F.min("bands").alias("bands"))
    classes, _ = scratch(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    tables, tables_path = scratch(shared_tables(classes.select(F.col("node").alias("id"), "bands")), "minhash-tables")
    buckets = tables.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    members, members_path = scratch(tables.join(buckets.select("key", "leader"), "key"), "minhash-members")
    drop_path(spark, tables_path)

    nodes = members.select(F.col("id").alias("node")).distinct()
    met, _ = scratch(classes.select("node", "first.*").join(nodes, "node", "left_semi"), "minhash-ids")
    sets = sets_of_classes(documents, met, key, text, words)
    stars = members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links, _ = scratch(confirm(stars, sets), "minhash-links")
    roots = components(links)

    rooted = members.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
    rooted = rooted.select("key", "id", F.coalesce("root", "id").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("key")
    still, _ = scratch(rooted.join(split, "key", "left_semi").select("id", "root").distinct(), "minhash-open")
    drop_path(spark, members_path)
    found = confirm(open_pairs(sets, still), sets)
    more = found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(more)

    named = classes.select("s1", "s2", "first", "node").join(roots, "node", "left")
    named, _ = scratch(named.select("s1", "s2", "first", F.coalesce("root", "node").alias("root")), "minhash-named")
    # Written, so that the join back can be split where a component has many classes.
    best, _ = scratch(named.groupBy("root").agg(F.min("first").alias("best")), "minhash-best")
    named = named.select("s1", "s2", "root").join(best, "root").select("s1", "s2", "best")
    out = drawn.select("id", "text_hash", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    own = F.struct("id", "text_hash")
    return out.select(
        "id",
        "text_hash",
        "n_shingles",
        F.coalesce("best.id", "id").alias("component"),
        (F.coalesce("best", own) == own).alias("kept"),
    )


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per document row.

    Null and empty texts have no shingles and are linked with nothing. Texts are linked, not ids: rows with one id or none are
    linked only where their texts are similar. component_id is the smallest id of the component, null where a null id is in it (it
    orders before every id); the row with the smallest (id, text hash) is kept. Only ``key`` and ``text`` are read. An
    empty table gives no rows.
    """
    marked = marked_rows(documents, key, text, words)
    return marked.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
        "n_shingles",
        F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
        "kept",
    )


def drop_near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, one_per_id: bool = True
) -> DataFrame:
    """One document, by (id, text hash), of each group of linked ones.

    ``one_per_id``: repeated ids, null among them, stay once, whatever their texts. Without it, as in the pipeline, only rows that
    repeat both id and text stay once.
    """
    spark = documents.sparkSession
    marked, _ = scratch(marked_rows(documents, key, text, words), "minhash-marked")
    gone = marked.where(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    own_id, own_hash = row_name(key, text)
    kept = documents.join(gone, (own_id == F.col("gone_id")) & (own_hash == F.col("gone_hash")), "left_anti")
    same = ["id"] if one_per_id else ["id", "text_hash"]
    repeated = marked.where("kept").groupBy(*same).count().where("count > 1").limit(1).count()
    return kept.dropDuplicates([key] if one_per_id else [key, text]) if repeated else kept


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN [ws[1]]
      ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  WITH RECURSIVE reach(doc_id, other) AS (
    SELECT DISTINCT a, a FROM e UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
  SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, w.doc_id) AS component_id,
  coalesce(root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)
"""
