"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped by readers.

Format of one part: ``.ids`` holds the ids of its documents, one after the other, as little-endian 16-bit integers (32-bit
where the vocabulary needs it); ``.offsets`` holds n + 1 little-endian 64-bit offsets counted over all parts; ``.docs`` holds n
little-endian 64-bit document ids and then n bytes, 0 for a null id. Parts follow each other in ascending document id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosslane.llm.chunks import Chunked, Memo, groups
from crosslane.llm.common import (
    LOWER_BYTES,
    arrow_rows,
    commit_file,
    fresh_path,
    open_folder,
    regrouped,
    small_batches,
    table,
    text_bytes,
)

END_ID = 2
MEMO_CHUNKS = 250_000
# Words that the library gets as one text: its cost for a call is shared, and its regular expressions stay fast.
JOINED_WORDS = 500
# Stops that the splitting pattern keeps apart from letters and digits, and what starts a special token.
STOPS = ".,;:!?%&$#*"
MARK = "<|"
# The first code point that may combine or that Unicode versions may see differently, and its first byte.
BEYOND, BEYOND_BYTE = "\u0250", 0xC9
# Lower case of one becomes two code points, one of them combining.
DOTTED = "\u0130"
_LOWER = np.frombuffer(LOWER_BYTES, dtype=np.uint8)
_WORD = np.array([chr(c).isascii() and chr(c).isalnum() for c in range(256)])


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, with a bounded memory of the pieces of blank-separated chunks.

    The file's splitting pattern never matches across a blank or line feed and its normalizer never joins what they
    separate, so the ids of a text are those of its chunks, one after the other. Likewise a chunk that ends in a letter or
    digit and a run of stops is its head and that run; a head without combining characters may be lowered first, as the
    normalizer does. A word of letters is one match of the pattern and its last id is one that closes a word, so many
    words go to the library as one text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        closing = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + size + 1, dtype=bool)
        self.closes[[n for token, n in vocabulary.items() if closing and token.endswith(closing)]] = True
        self.chunks = Memo(MEMO_CHUNKS)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; every distinct piece of a group of texts is looked up once."""
        out: list[bytes] = []
        for group in groups(texts):
            chunked = Chunked(pa.array([t.replace("\n", " ") for t in group], type=pa.string()))
            out += map(bytes, chunked.joined(self._chunk_ids(chunked.dictionary)))
        return out

    def _chunk_ids(self, chunks: pa.StringArray) -> pa.LargeBinaryArray:
        pieces = heads_and_stops(chunks).dictionary_encode()
        known = pa.array(self.chunks.all_of(pieces.dictionary.to_pylist(), self._library_ids), type=pa.large_binary())
        _, offsets, data = known.take(pieces.indices).buffers()
        # Every second offset: a head and its stops become one value.
        ends = np.ascontiguousarray(np.frombuffer(offsets, dtype=np.int64)[: 2 * len(chunks) + 1 : 2])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(ends), data])

    def _library_ids(self, pieces: list[str]) -> list[bytes]:
        words = [p for p in pieces if p.isalpha() and (p.isascii() or max(p) < BEYOND and DOTTED not in p)]
        found: dict[str, bytes] = {}
        parts = [words[k : k + JOINED_WORDS] for k in range(0, len(words), JOINED_WORDS)]
        for part, ids in zip(parts, self._packed([" ".join(p) for p in parts]), strict=True):
            ends = np.flatnonzero(self.closes[np.frombuffer(ids, dtype=self.dtype)]) + 1
            if len(ends) == len(part) and ends[-1] * self.dtype.itemsize == len(ids):
                bounds = [0, *(ends * self.dtype.itemsize).tolist()]
                found.update((word, ids[a:b]) for word, a, b in zip(part, bounds, bounds[1:], strict=False))
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self._packed(rest), strict=True))
        return [found[p] for p in pieces]

    def _packed(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]


def heads_and_stops(chunks: pa.StringArray) -> pa.StringArray:
    """Two values per chunk: head and closing stops where the splitting pattern surely parts them, else the chunk and "".

    Both are cut out of the chunks' own bytes by new offsets. A-Z are lowered in chunks that hold no special token and
    only code points that neither combine nor change with the case of their neighbours.
    """
    n = len(chunks)
    _, offsets, data = chunks.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[chunks.offset : chunks.offset + n + 1]
    # One byte more, so that an empty last chunk has a place too.
    raw = np.append(np.frombuffer(data, dtype=np.uint8)[: bounds[-1]] if data is not None else np.empty(0, np.uint8), np.uint8(0))
    starts, sizes = bounds[:-1], np.diff(bounds)
    marked = pc.match_substring(chunks, MARK).to_numpy(zero_copy_only=False)
    simple = (np.maximum.reduceat(raw, starts) < BEYOND_BYTE) & ~marked if n else marked
    lowered = np.repeat(simple, sizes)
    raw[bounds[0] : bounds[-1]] = np.where(lowered, _LOWER[raw[bounds[0] : bounds[-1]]], raw[bounds[0] : bounds[-1]])
    heads = pc.binary_length(pc.ascii_rtrim(chunks, characters=STOPS)).to_numpy()
    last, lead = raw[starts + np.maximum(heads - 1, 0)], raw[starts + np.maximum(heads - 2, 0)]
    # Letters of two bytes below U+0240, without the signs of multiplication and division and the dotted capital I.
    letter = (heads > 1) & (last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead < BEYOND_BYTE)
    letter &= ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC4) & (last == 0xB0))
    heads = np.where((heads > 0) & (_WORD[last] | letter), heads, sizes)
    cuts = np.empty(2 * n + 1, dtype=np.int32)
    cuts[0::2], cuts[1::2] = bounds, starts + heads
    return pa.StringArray.from_buffers(2 * n, pa.py_buffer(cuts), pa.py_buffer(raw))


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


PARTS = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())])


def write_token_files(
    documents: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> list[tuple[int, int, int, int]]:
    """Write the parts and return (part, documents, tokens, base) for each, in ascending document id.

    Two jobs. The first deals rows by ranges of the id and writes ids and counts; the second adds each part's base, the
    prefix sum of the tokens before it. Only one row per part reaches the driver. Null texts are empty, so
    they hold the end id only; null ids come first; rows that repeat an id follow the hash of their text.
    """
    spark = documents.sparkSession
    small_batches(spark)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(key).cast("long").alias("key"), text_bytes(text).alias("raw"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("raw")]
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _write_part(batches, folder, vocabulary, end_id)
        yield from arrow_rows(iter([found] if found else []), PARTS)

    parts = sorted(tuple(r) for r in dealt.mapInArrow(write, "part int, docs long, tokens long").collect())
    based, base = [], 0
    for part, docs, tokens in parts:
        based.append((part, docs, tokens, base))
        base += tokens
    if based:
        part_frame(spark, based).foreachPartition(lambda found: [_write_offsets(folder, r.part, r.base) for r in found])
    return based


def part_frame(spark: SparkSession, parts: list[tuple[int, int, int, int]]) -> DataFrame:
    """One row and one task per part."""
    found = spark.createDataFrame(parts, "part int, docs long, tokens long, base long")
    return found.repartitionByRange(len(parts), "part")


def _write_part(batches, folder: str, vocabulary: str, end_id: int) -> tuple[int, int, int] | None:
    part = TaskContext.get().partitionId()
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    words = encoder(vocabulary)
    end = np.array([end_id], dtype=words.dtype).tobytes()
    counts: list[int] = []
    ids: list[int | None] = []

    def encoded() -> Iterator[bytes]:
        for docs, raws in regrouped(batches):
            texts = [raw.decode("utf-8", "replace") for raw in raws]
            for doc, packed in zip(docs, words.encode_many(texts), strict=True):
                counts.append(len(packed) // words.dtype.itemsize + 1)
                ids.append(doc)
                yield packed + end

    name = f"{root}/part-{part:06d}"
    commit_file(files, f"{name}.ids", encoded())
    if not ids:
        files.delete_file(f"{name}.ids")
        return None
    plain = np.array([0 if x is None else x for x in ids], dtype="<i8").tobytes()
    commit_file(files, f"{name}.docs", [plain, bytes(x is not None for x in ids)])
    commit_file(files, f"{name}.counts", [np.array(counts, dtype="<u8").tobytes()])
    return part, len(ids), int(sum(counts))


def _write_offsets(folder: str, part: int, base: int) -> None:
    files, root = open_folder(folder)
    name = f"{root}/part-{part:06d}"
    with files.open_input_file(f"{name}.counts") as source:
        counts = np.frombuffer(source.read(), dtype="<u8")
    offsets = base + np.concatenate(([0], np.cumsum(counts)))
    commit_file(files, f"{name}.offsets", [offsets.astype("<u8").tobytes()])


def mapped(files: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where the shared folder is mounted, else read."""
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with files.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), dtype=dtype)


class TokenPart:
    """One part, mapped: ``ids_of(k)`` are the ids of its k-th document."""

    def __init__(self, folder: str, part: int, width: int):
        files, root = open_folder(folder)
        name = f"{root}/part-{part:06d}"
        self.ids = mapped(files, f"{name}.ids", f"<u{width}")
        self.offsets = mapped(files, f"{name}.offsets", "<u8")
        raw = mapped(files, f"{name}.docs", "<u1")
        n = len(self.offsets) - 1
        self.docs, self.known = raw[: 8 * n].view("<i8"), raw[8 * n :]

    def __len__(self) -> int:
        return len(self.docs)

    def ids_of(self, k: int) -> np.ndarray:
        base = int(self.offsets[0])
        return self.ids[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base]


FACTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
FACTS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], width: int = 2) -> DataFrame:
    """Per document of the files: its first token's place among all tokens, its tokens, their checksum."""
    if not parts:
        return spark.createDataFrame([], FACTS_DDL)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from arrow_rows(facts(batches), FACTS)

    def facts(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                part = TokenPart(folder, number, width)
                for k in range(len(part)):
                    ids = part.ids_of(k)
                    crc = zlib.crc32(ids.astype("<u4").tobytes())
                    yield int(part.docs[k]) if part.known[k] else None, int(part.offsets[k]), len(ids), crc

    return part_frame(spark, parts).mapInArrow(read, FACTS_DDL)


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's ids written into the files and read back."""
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    parts = write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary)
    return read_token_files(spark, folder, parts, encoder(vocabulary).dtype.itemsize)
