"""Benchmark decontamination: windows of test words in a broadcast hash set, verified hits, spans or documents removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslane.llm.common import small_batches, table, text_bytes, to_batch, words_of

WINDOW = 10
# Words of test items that one broadcast block may hold (about 100 bytes each in a task); more items are further blocks.
BLOCK_WORDS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class WindowSet:
    """The distinct windows of some test items: a sorted hash array per window length and the words behind each hash."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple, list[int]]] = {}
        self.names = [name for name, _ in items]
        for place, (_, raw) in enumerate(items):
            words = words_of(raw)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            length = min(window, len(ids))
            if length:
                found = self.by_length.setdefault(length, {})
                for start in range(len(ids) - length + 1):
                    owners = found.setdefault(tuple(ids[start : start + length]), [])
                    if not owners or owners[-1] != place:
                        owners.append(place)
        self.hashes = {}
        for length, found in self.by_length.items():
            windows = np.array(list(found), dtype=np.uint64).reshape(len(found), length)
            self.hashes[length] = np.unique(window_hashes(windows.ravel(), length)[::length])

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(start, length) of each verified window in the words, and the items they come from."""
        look = self.vocabulary.get
        ids = np.fromiter((look(w, 0) for w in words), dtype=np.uint64, count=len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for length, hashes in self.hashes.items():
            if len(ids) < length:
                continue
            whole = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(whole):
                continue
            values = hash_at(ids, whole, length)
            place = np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)
            exact = self.by_length[length]
            for start in whole[hashes[place] == values].tolist():
                owners = exact.get(tuple(ids[start : start + length].tolist()))
                if owners:
                    spans.append((start, length))
                    items.update(owners)
        return spans, items


def hash_at(ids: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(length):
        out = (out ^ (out >> np.uint64(29))) * MIX + ids[starts + k]
    return out


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    return hash_at(ids, np.arange(len(ids) - length + 1), length)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint (start, end) word ranges that cover the same words."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> list[DataFrame]:
    """The test items, split so that no block can hold more than about ``block_words`` words.

    An item of n bytes has at most n / 2 + 1 words; that bound is summed by Spark before anything is collected.
    """
    rows = benchmark.select(F.col(item).cast("string").alias("item"), text_bytes(text).alias("raw"))
    words = rows.select(F.sum(F.length("raw") / 2 + 1).alias("n")).first().n or 0
    blocks = int(words // block_words) + 1
    if blocks == 1:
        return [rows]
    return [rows.where(F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)) == k) for k in range(blocks)]


def find_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(key, raw, hit_spans, hit_items) per document row, in one pass over the documents for each block of items.

    No shuffle: a document meets each block's window set in its own task, and the spans found so far travel with it.
    Null texts have no words. Null item ids hit words but have no name. Repeated items count once. Without items no
    document is hit. Only ``key`` and ``text`` are read, so further columns cannot clash.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(
        F.col(key).alias("key"),
        text_bytes(text).alias("raw"),
        F.array().cast("array<array<int>>").alias("hit_spans"),
        F.array().cast("array<string>").alias("hit_items"),
    )
    schema = rows.schema
    for block in item_blocks(benchmark, item, item_text, block_words):
        items = sorted(((r.item, bytes(r.raw)) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1]))
        shared = spark.sparkContext.broadcast(WindowSet(items, window))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in batches:
                spans_out, items_out = [], []
                raws, spans_in, items_in = (batch.column(k).to_pylist() for k in (1, 2, 3))
                for raw, spans, names in zip(raws, spans_in, items_in, strict=True):
                    hits, owners = windows.hits(words_of(raw))
                    old = [(a, b - a) for a, b in spans]
                    spans_out.append([list(s) for s in merged(hits + old)] if hits else spans)
                    names = set(names) | {windows.names[o] for o in owners if windows.names[o] is not None}
                    items_out.append(sorted(names))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(spans_out, type=pa.list_(pa.list_(pa.int32()))),
                        pa.array(items_out, type=pa.list_(pa.string())),
                    ],
                    names=["key", "raw", "hit_spans", "hit_items"],
                )

        rows = rows.mapInArrow(scan, schema)
    return rows


def cut_spans(raw: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words in the spans and what stands between them."""
    starts, ends, inside = [], [], False
    for place, c in enumerate(raw.translate(words_table()) + b" "):
        if (c != 32) != inside:
            (starts if not inside else ends).append(place)
            inside = not inside
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : starts[first]])
        at = ends[last - 1]
    return b"".join(out) + raw[at:]


def words_table() -> bytes:
    from crosslane.llm.common import WORD_BYTES

    return WORD_BYTES


def remove_contamination(documents: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """The documents without those that hold test windows (``mode="documents"``), or with the hit spans cut (``"spans"``).

    All columns are kept; rows travel as one packed column, so no name can clash.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), F.col(text).alias("text"))
    hits = find_hits(packed, benchmark, "whole", "text", **options)
    if mode == "documents":
        return hits.where(F.size("hit_spans") == 0).select("key.*")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_spans(r, s).decode() for r, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "cut_text"])

    changed = hits.select("key", "raw", "hit_spans").where(F.size("hit_spans") > 0)
    cleaned = changed.mapInArrow(clean, changed.select("key", F.lit("").alias("cut_text")).schema)
    kept = hits.where(F.size("hit_spans") == 0).select("key.*")
    columns = [F.col("cut_text").alias(c) if c == text else F.col("key")[c].alias(c) for c in documents.columns]
    return kept.unionByName(cleaned.select(*columns))


DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
    ]
)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: its words, those inside verified windows, and the items they come from."""
    hits = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw, spans, items in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                n_hit = sum(b - a for a, b in spans)
                sha = hashlib.sha256(",".join(items).encode()).hexdigest()
                rows.append((key, len(words_of(raw)), n_hit, len(items), sha, n_hit > 0))
            yield to_batch(rows, DIGEST)

    return hits.mapInArrow(
        digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(10, len(ws)) AS l FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (
  SELECT item_id, l, ws, unnest(range(1, len(ws) - l + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS g FROM (
  SELECT doc_id, l, ws, unnest(range(1, len(ws) - l + 2)) AS i
  FROM w, (SELECT DISTINCT l FROM bl) WHERE len(ws) >= l)),
hit AS (SELECT DISTINCT doc_id, item_id, i, dw.l AS l FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
