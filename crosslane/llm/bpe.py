"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse as a byte-to-text state machine."""

from __future__ import annotations

import bisect
import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crosslane.llm.chunks import Chunked, Memo, groups
from crosslane.llm.common import regrouped, small_batches, table, text_bytes, to_batch

# Fixed value: the pattern that splits text into pieces before merging, for text without the characters that the standard
# library's classes treat otherwise; texts with those are split by the tokenizer file's own splitter.
PLAIN_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
# Answers that a task remembers: at most twice as many, about 200 bytes each.
MEMO_PIECES = 120_000
MEMO_CHUNKS = 80_000
# White space other than blanks and line feeds: by itself in ASCII texts, as a class in others. Runs of white space, and the start
# of a special token.
ODD_BLANKS, ODD_BLANK = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f", re.compile(r"[^\S \n]")
RUNS = ("  ", "\n\n", " \n", "\n ", "<|")
LONG_CHARS = 1 << 20
BLOCK_CHARS = 1 << 16
BLOCK_BYTES = 1 << 8
NO_MERGE = 1 << 29
# Pieces of at most so many bytes are merged side by side, so many at once.
SHORT_BYTES = 48
MERGED_AT_ONCE = 8192
# Fewer than so many are merged one by one.
FEW = 64


def is_chunked(text: str) -> bool:
    """Whether a text is words with one white space between two of them, and no special token."""
    if not text or len(text) > LONG_CHARS or text[0].isspace() or text[-1].isspace():
        return False
    if any(x in text for x in RUNS) or any(x in text for x in ODD_BLANKS):
        return False
    return text.isascii() or not ODD_BLANK.search(text)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeList:
    """Tokens as bytes, merges by rank, and the lookahead that makes tokens final."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.byte_id = [0] * 256
        for i, raw in self.bytes_of.items():
            if len(raw) == 1 and i not in self.special.values():
                self.byte_id[raw[0]] = i
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        rules = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.merges[a, b] = rank
            self.made.append(c)
            rules.append((a, b, c))
        self.lookahead = sufficient_lookahead(rules, {i: len(raw) for i, raw in self.bytes_of.items()})
        self.pairs = PairTable(self.merges)
        self.made_ids = np.array(self.made, dtype=np.int32)
        self.byte_ids = np.array(self.byte_id, dtype=np.int32)

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """What ``merge`` gives for each of many short pieces, packed as 32-bit integers: one merge of every piece a step."""
        if len(raws) < FEW:
            return [np.array(self.merge(raw), dtype="<u4").tobytes() for raw in raws]
        out: list[bytes] = [b""] * len(raws)
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        for start in range(0, len(order), MERGED_AT_ONCE):
            rows = order[start : start + MERGED_AT_ONCE]
            width = int(sizes[rows[-1]])
            flat = np.frombuffer(b"".join(raws[r] for r in rows.tolist()), dtype=np.uint8)
            ids = np.full((len(rows), width + 1), -1, dtype=np.int32)
            ids[np.arange(width + 1) < sizes[rows][:, None]] = self.byte_ids[flat]
            ranks = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width)
            while len(rows):
                best = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(rows)), best]
                open_rows = rank < NO_MERGE
                for r, row in zip(rows[~open_rows].tolist(), ids[~open_rows], strict=True):
                    out[r] = row[row >= 0].astype("<u4").tobytes()
                rows, ids, ranks, best, rank = (x[open_rows] for x in (rows, ids, ranks, best, rank))
                if not len(rows):
                    break
                at, line = best[:, None], np.arange(len(rows))
                places = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, places + (places > at), axis=1)
                ids[line, best] = self.made_ids[rank]
                ranks = np.take_along_axis(ranks, places[:-1] + (places[:-1] >= at), axis=1)
                # The joined token has a new pair on either side; the last place of a row is never a token.
                right = best < ranks.shape[1]
                ranks[line[right], best[right]] = self.pairs.ranks(ids[line[right], best[right]], ids[line[right], best[right] + 1])
                left = best > 0
                ranks[line[left], best[left] - 1] = self.pairs.ranks(ids[line[left], best[left] - 1], ids[line[left], best[left]])
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Ids of bytes that are all there: the lowest rank first, the leftmost of equal ranks first."""
        ids = [self.byte_id[b] for b in raw]
        look = self.merges.get
        ranks = [look(both, NO_MERGE) for both in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            k = ranks.index(best)
            ids[k] = self.made[best]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = look((ids[k - 1], ids[k]), NO_MERGE)
            if k < len(ranks):
                ranks[k] = look((ids[k], ids[k + 1]), NO_MERGE)
        return ids

    def transduce(self, parts: Iterable[bytes], block: int = BLOCK_BYTES) -> Iterator[int]:
        """Ids of one piece whose bytes arrive in parts; holds at most about ``block`` + lookahead bytes.

        Whatever follows, it can change no token that ends at least ``lookahead`` bytes before the end of what is known, so
        these tokens are emitted and the rest starts anew at a token's end.
        """
        held = b""
        for part in parts:
            held += part
            while len(held) >= block + self.lookahead:
                window = held[: block + self.lookahead]
                final, at = len(window) - self.lookahead, 0
                for token in self.merge(window):
                    if at + len(self.bytes_of[token]) > final:
                        break
                    at += len(self.bytes_of[token])
                    yield token
                if not at:
                    block *= 2
                held = held[at:]
        yield from self.merge(held)


class PairTable:
    """Ranks of pairs of ids for whole arrays: open addressing in two flat arrays."""

    def __init__(self, merges: dict[tuple[int, int], int]):
        keys = np.array([(a << 32) | b for a, b in merges], dtype=np.int64)
        ranks = np.fromiter(merges.values(), dtype=np.int32, count=len(merges))
        self.bits = max(8, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NO_MERGE, dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):
            # Of the keys that want one free slot the first takes it; the others go to the next slot.
            free = self.keys[slots] == -1
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(np.where(free, slots, -1), return_index=True)[1]] = True
            taken = free & first
            self.keys[slots[taken]], self.values[slots[taken]] = keys[taken], ranks[taken]
            keys, ranks, slots = keys[~taken], ranks[~taken], (slots[~taken] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NO_MERGE where there is none or an id is negative."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(len(keys), NO_MERGE, dtype=np.int32)
        open_at = np.flatnonzero((left >= 0) & (right >= 0))
        slots = self._slots(keys[open_at])
        while len(open_at):
            found = self.keys[slots]
            hit = found == keys[open_at]
            out[open_at[hit]] = self.values[slots[hit]]
            on = ~hit & (found != -1)
            open_at, slots = open_at[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out


def sufficient_lookahead(rules: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes before the end of a prefix beyond which no continuation changes the tokens.

    Compare a prefix with any longer text, rule by rule. Their tokens agree up to a border, at first the prefix's
    end. A rule (u, v) moves the border only if it joins the last common token u with a v behind the border, and then to the
    start of u. The next rule that moves it comes later and its v starts there, so u is on the left edge of that v,
    and what stands above u on that edge was made no earlier than by the rule before. The longest chain of such
    rules, counted in bytes of u, bounds how far the border can move: one pass in rank order finds it.
    """
    made = {c: rank for rank, (_, _, c) in enumerate(rules)}
    left = {c: a for a, _, c in rules}
    ends: dict[int, tuple[list[int], list[int]]] = {}  # for each u: ranks, and the longest chain up to each
    longest = 0
    for rank, (u, v, _) in enumerate(rules):
        before, edge, above = 0, v, rank
        while edge is not None:
            known = ends.get(edge)
            if known:
                k = bisect.bisect_right(known[0], above)
                if k:
                    before = max(before, known[1][k - 1])
            above = made.get(edge, -1)
            edge = left.get(edge)
        chain = size[u] + before
        ranks, best = ends.setdefault(u, ([], []))
        ranks.append(rank)
        best.append(max(chain, best[-1] if best else 0))
        longest = max(longest, chain)
    return longest


class ByteToText:
    """Token bytes in, text out; a character split between tokens waits for its last byte."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.table = pa.array([bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)], type=pa.large_binary())
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        data = self.table.take(pa.array(ids)).buffers()[2]
        return self.state.decode(memoryview(data) if data is not None else b"")

    def end(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


class StreamEncoder:
    """Text to ids in blocks: pieces whose end is certain go to the transducer, and a bounded memory keeps its answers."""

    def __init__(self, path: str):
        self.rules = MergeList(path)
        self.decoder = ByteToText(self.rules.bytes_of)
        self.pieces, self.chunks = Memo(MEMO_PIECES), Memo(MEMO_CHUNKS)
        self.marks = re.compile("|".join(map(re.escape, self.rules.special))) if self.rules.special else None
        self.decimals = pa.array([f",{i}".encode() for i in range(max(self.rules.bytes_of) + 1)], type=pa.large_binary())
        self.splitter = Tokenizer.from_file(path).pre_tokenizer

    def _pieces(self, text: str) -> list[str]:
        odd = any(x in text for x in "\x1c\x1d\x1e\x1f") if text.isascii() else NOT_PLAIN.search(text)
        if odd:
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return PLAIN_PIECES.findall(text)

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces as packed 32-bit integers: short ones side by side, others out of the transducer; a special token has
        its own id."""
        raws = [b"" if p in self.rules.special else p.encode() for p in pieces]
        out = self.rules.merge_many([raw if len(raw) <= SHORT_BYTES else b"" for raw in raws])
        for n, raw in enumerate(raws):
            if len(raw) > SHORT_BYTES:
                parts = (raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES))
                out[n] = np.fromiter(self.rules.transduce(parts), dtype="<u4").tobytes()
            elif not raw and pieces[n]:
                out[n] = np.array([self.rules.special[pieces[n]]], dtype="<u4").tobytes()
        return out

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of plain texts: one that starts with a line feed as it is, any other after its blank.

        A chunk holds white space at its start only, so the pieces of all chunks come out of one pass over them in a row, and a
        piece that starts with white space starts a chunk.
        """
        row = "".join([c if c[0] == "\n" else " " + c for c in chunks])
        pieces = self._pieces(row)
        distinct = pa.array(pieces, type=pa.string()).dictionary_encode()
        answers = self.pieces.all_of(distinct.dictionary.to_pylist(), self._piece_ids)
        ids = pa.array(answers, type=pa.large_binary()).take(distinct.indices)
        _, offsets, data = ids.buffers()
        opens = [n for n, p in enumerate(pieces) if p[0] in " \n"]
        if len(opens) != len(chunks):
            raise AssertionError("pieces do not follow the chunks")
        places = np.frombuffer(offsets, dtype=np.int64)[ids.offset + np.array([*opens, len(pieces)])].tolist()
        view = data.to_pybytes() if data is not None else b""
        return [view[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]

    def piece_blocks(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces in order, each from at most about BLOCK_CHARS characters; a special token is a list of its own."""
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            yield from self._segment(text[at : mark.start()])
            yield [mark.group()]
            at = mark.end()
        yield from self._segment(text[at:] if at else text)

    def _segment(self, text: str) -> Iterator[list[str]]:
        start, stop = 0, 0
        while start < len(text):
            stop = min(len(text), max(stop, start) + BLOCK_CHARS)
            pieces = self._pieces(text[start:stop])
            if stop < len(text):
                # What follows can lengthen the last piece, or join the last two (an apostrophe and a letter).
                pieces = pieces[:-2]
            if pieces:
                start += sum(map(len, pieces))
                yield pieces

    def id_blocks(self, text: str) -> Iterator[np.ndarray]:
        """Ids of any text, block by block."""
        for pieces in self.piece_blocks(text):
            distinct = list(set(pieces))
            known = dict(zip(distinct, self.pieces.all_of(distinct, self._piece_ids), strict=True))
            yield np.frombuffer(b"".join([known[p] for p in pieces]), dtype="<u4")

    def ids_many(self, texts: list[str]) -> Iterator[Iterable[np.ndarray]]:
        """Per text its blocks of ids. Texts without runs of white space are chunks that share look-ups; long ones go by blocks."""
        for group in groups(texts):
            plain = [is_chunked(t) for t in group]
            if any(plain):
                rows = [t.replace("\n", " \n") for t, p in zip(group, plain, strict=True) if p]
                # The first chunk has no blank before it: it goes by itself.
                firsts = [t.split(" ", 1) for t in rows]
                rest = Chunked(pa.array([f[1] if len(f) > 1 else None for f in firsts], type=pa.string()))
                tails = iter(rest.joined(self.chunks.all_of(rest.distinct, self._chunk_ids)))
                heads = iter(firsts)
            for text, chunked in zip(group, plain, strict=True):
                if chunked:
                    yield [*self.id_blocks(next(heads)[0]), np.frombuffer(next(tails), dtype="<u4")]
                else:
                    yield self.id_blocks(text)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, digest of the decimal ids, digest of the text decoded from the ids."""
        out = []
        for blocks in self.ids_many(texts):
            count, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
            for ids in blocks:
                if len(ids):
                    said = self.decimals.take(pa.array(ids)).buffers()[2]
                    ids_sha.update(memoryview(said)[0 if count else 1 :])
                    count += len(ids)
                    text_sha.update(self.decoder.feed(ids).encode())
            text_sha.update(self.decoder.end().encode())
            out.append((count, ids_sha.hexdigest(), text_sha.hexdigest()))
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *self.id_blocks(text)])

    def decode(self, ids) -> str:
        """The text of ids, in steps of bounded size."""
        ids = np.asarray(ids, dtype=np.uint32)
        return "".join(self.decoder.feed(ids[k : k + 4096]) for k in range(0, len(ids), 4096)) + self.decoder.end()


@lru_cache(maxsize=4)
def encoder(path: str) -> StreamEncoder:
    return StreamEncoder(path)


def encode_documents(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text. Null texts are empty and have no ids; only ``key`` and ``text`` are read."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            texts = [raw.decode("utf-8", "replace") for raw in batch.column(1).to_pylist()]
            ids = [np.concatenate([np.zeros(0, "<u4"), *blocks]).astype(np.int32) for blocks in words.ids_many(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) out of (doc_id, ids)."""
    small_batches(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            texts = [words.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


FACTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def token_facts(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids again, and return both digests, block by block in one pass."""
    small_batches(documents.sparkSession)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for keys, raws in regrouped(batches):
            found = words.digests([raw.decode("utf-8", "replace") for raw in raws])
            yield to_batch([(k, *facts) for k, facts in zip(keys, found, strict=True)], FACTS)

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return rows.mapInArrow(facts, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())]
)


def encode_and_check(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text decoded from these ids."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            texts = [raw.decode("utf-8", "replace") for raw in batch.column(1).to_pylist()]
            rows = []
            for doc, blocks in zip(batch.column(0).to_pylist(), words.ids_many(texts), strict=True):
                ids = np.concatenate([np.zeros(0, "<u4"), *blocks])
                digest = hashlib.sha256(words.decode(ids).encode()).hexdigest()
                rows.append((doc, len(ids), ids.astype(np.int32), digest))
            yield to_batch(rows, ENCODED)

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return token_facts(table(spark, sf_dir, "documents"), vocabulary_path())
