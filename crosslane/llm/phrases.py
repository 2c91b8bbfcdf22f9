"""Phrase collocations by sampling and its negative border.

A sample proposes words and pairs of words. One pass over all documents counts exactly what can be frequent if the sample was
right, and its border: every word, every pair of proposed words, every triple of two proposed pairs. Where a border phrase turns
out to be frequent the proposal has failed there, and further passes count what the failures open, until nothing new is frequent.
The sample only saves work: counts, scores and ranks are those of all documents.

What to count is decided by hash filters of bounded size. A filter decides by the phrase alone, so a phrase is counted at all its
places or at none, and a false positive only counts a phrase more than needed. The border is summed by 64-bit hashes first, which
can only join phrases; whatever reaches the threshold there is counted again by its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosslane.llm.common import drop_path, fresh_path, scratch, small_batches, table, text_bytes
from crosslane.session import broadcast_if

MIN_COUNT = 10
# One of so many documents is in the sample (ten occurrences leave 1.25 there on average), and how often a word and a phrase
# must be there to be proposed. A word costs little if the proposal is too wide, a phrase if it is too narrow.
SAMPLE_OF = 8
SAMPLE_COUNTS = (2, 3)
# Bytes of text behind one encoded row: two million words at most, so that three of their numbers fit 63 bits.
SLICE_BYTES = 4_000_000
WORD_BITS = 21
# Bytes of texts that a task holds back to fill its rows, over all languages.
HELD_BYTES = 32_000_000
# Encoded rows of a Parquet row group.
ROWS_A_GROUP = 4
# A filter has 16 bits a member, at most 2**27 bits (16 MB); beyond that it lets more false positives through.
MOST_BITS = 1 << 27

# A-Z become a-z; the characters that end a piece; blanks between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b"\x20\x09"
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
KIND = bytes(2 if c in PIECE_ENDS else 1 if c in BLANKS else 0 for c in range(256))

ENCODED = pa.schema(
    [
        ("lang", pa.string()),
        ("sampled", pa.bool_()),
        ("lead", pa.int32()),
        ("words", pa.list_(pa.string())),
        ("hashes", pa.binary()),
        ("ids", pa.binary()),
    ]
)
ENCODED_PLAIN = (pa.string(), pa.bool_(), pa.int32(), pa.binary(), pa.binary())
ENCODED_DDL = "lang string, sampled boolean, lead int, words array<string>, hashes binary, ids binary"
COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
HASHES = pa.schema([("h", pa.int64()), ("n", pa.int64())])
COUNTS_DDL = "lang string, k int, phrase string, n long"


def word_spans(kinds: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, opens a piece) of the words of a text out of the kinds of its bytes."""
    kind = np.frombuffer(kinds, dtype=np.uint8)
    inside = np.zeros(len(kind) + 2, dtype=bool)
    np.equal(kind, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    pieces = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, dtype=np.int32)
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = pieces[1:] != pieces[:-1]
    return starts, ends, opens


def encoded(raw: bytes, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array, bytes]]:
    """(lead, words, ids) of lowered text in slices: ids are 32-bit numbers, turned to -1 - id where a piece opens.

    A slice starts two words before the end of the last one; those ``lead`` words only give phrases their beginning.
    """
    kinds = raw.translate(KIND)
    at, end, lead = 0, 0, 0
    while end < len(raw):
        end = min(len(raw), end + slice_bytes)
        while end < len(raw) and kinds[end - 1] == 0:
            end += 1
        part, part_kinds = raw[at:end], kinds[at:end]
        starts, ends, opens = word_spans(part_kinds)
        if len(starts) > lead:
            offsets = np.zeros(len(starts) + 1, dtype=np.int64)
            np.cumsum(ends - starts, out=offsets[1:])
            joined = np.frombuffer(part, dtype=np.uint8)[np.frombuffer(part_kinds, dtype=np.uint8) == 0]
            words = pa.Array.from_buffers(
                pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]
            ).dictionary_encode()
            ids = words.indices.to_numpy().astype("<i4")
            yield lead, words.dictionary.cast(pa.string()), np.where(opens, -1 - ids, ids).tobytes()
        lead = min(2, len(starts))
        at = at + int(starts[-lead]) if lead else end


def encode(batches: Iterator[pa.RecordBatch], slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Encoded rows out of (lang, sampled, raw): texts of one language and side of the sample share a row."""
    held: dict[tuple[str, bool], list[bytes]] = {}
    sizes: dict[tuple[str, bool], int] = {}

    def flush(group: tuple[str, bool]) -> Iterator[pa.RecordBatch]:
        sizes.pop(group)
        for lead, words, ids in encoded(b"\n".join(held.pop(group)).translate(LOWERED), slice_bytes):
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            hashes = word_hashes(group[0], words.to_pylist()).tobytes()
            plain = [pa.array([v], t) for v, t in zip((*group, lead, hashes, ids), ENCODED_PLAIN, strict=True)]
            yield pa.RecordBatch.from_arrays([*plain[:3], listed, *plain[3:]], schema=ENCODED)

    for batch in batches:
        for lang, sampled, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            group = (lang, sampled)
            if group in sizes and sizes[group] + len(raw) > slice_bytes:
                yield from flush(group)
            held.setdefault(group, []).append(raw)
            sizes[group] = sizes.get(group, 0) + len(raw) + 1
            if sum(sizes.values()) > HELD_BYTES:
                yield from flush(max(sizes, key=sizes.get))
    for group in list(sizes):
        yield from flush(group)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ ((second << np.uint64(31)) | (second >> np.uint64(33)))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


class HashFilter:
    """A set of phrases as two bits a member in a bit field; may hold more than its members, never less."""

    def __init__(self, field: np.ndarray):
        self.field = field
        self.mask = np.uint64(len(field) * 64 - 1)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes & self.mask, (hashes >> np.uint64(32)) & self.mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for place in self.places(hashes):
            out &= (self.field[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


def build_filter(hashes: DataFrame) -> HashFilter:
    """The filter of the phrases whose hashes are in ``hashes`` (h).

    Spark unites the places; the driver receives the words of the field that are not 0, which its size bounds (2**27 bits: 2
    million rows).
    """
    hashes, path = scratch(hashes, "phrase-hashes")
    bits = 1 << max(16, (16 * hashes.count() - 1).bit_length())
    bits = min(bits, MOST_BITS)
    frame = HashFilter(np.zeros(bits // 64, dtype=np.uint64))
    places = F.explode(
        F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))
    ).alias("place")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    words = (
        hashes.select(places)
        .groupBy(F.shiftrightunsigned("place", 6).alias("word"))
        .agg(F.bit_or(mask).alias("held"))
        .toArrow()
    )
    drop_path(hashes.sparkSession, path)
    frame.field[words["word"].to_numpy()] = words["held"].to_numpy().view(np.uint64)
    return frame


def hashed(phrases: DataFrame) -> DataFrame:
    """(h) of the phrases (lang, phrase), as the passes compute it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(len(batch), dtype=np.uint64)
            for n, (lang, phrase) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True)):
                parts = word_hashes(lang, phrase.split(" "))
                whole = parts[:1]
                for part in parts[1:]:
                    whole = pair_hashes(whole, np.array([part]))
                out[n] = whole[0]
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


class Row:
    """One encoded row with what the passes ask of it; pair n is the words n and n + 1, triple n goes on to n + 2."""

    def __init__(self, lang: str, lead: int, words: pa.Array, hashes: bytes, ids: bytes):
        marked = np.frombuffer(ids, dtype="<i4")
        opens = marked < 0
        self.lang, self.lead = lang, lead
        self.ids = np.where(opens, -1 - marked, marked).astype(np.int64)
        self.names = words
        self.joined = ~opens[1:]
        self.hashes = np.frombuffer(hashes, dtype=np.uint64)
        at = self.hashes[self.ids]
        self.pair_hash = pair_hashes(at[:-1], at[1:])
        self.triple_hash = pair_hashes(self.pair_hash[:-1], at[2:])

    def words_in(self, words: HashFilter) -> np.ndarray:
        """Of each pair: whether it stands in one piece and both words are in the filter."""
        known = words.holds(self.hashes)[self.ids]
        return known[:-1] & known[1:] & self.joined

    def pairs_in(self, pairs: HashFilter) -> np.ndarray:
        """Of each triple: whether it stands in one piece and both pairs are in the filter."""
        good = pairs.holds(self.pair_hash) & self.joined
        return good[:-1] & good[1:]

    def new(self, chosen: np.ndarray, k: int) -> np.ndarray:
        """Places of the chosen phrases whose last word is not one of the leading words that the slice before has counted."""
        return np.flatnonzero(chosen[max(0, self.lead - k + 1) :]) + max(0, self.lead - k + 1)

    def single_counts(self) -> Iterator[pa.RecordBatch]:
        n = np.bincount(self.ids[self.lead :], minlength=len(self.names))
        there = np.flatnonzero(n)
        yield self.batch(0, pa.array([""]), np.array([len(self.ids) - self.lead]))
        yield self.batch(1, self.names.take(pa.array(there)), n[there])

    def phrase_counts(self, chosen: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """The chosen phrases, each once, and how often it is there: word numbers of 21 bits make exact keys."""
        at = self.new(chosen, k)
        if not len(at):
            return
        keys = self.ids[at]
        for step in range(1, k):
            keys = (keys << WORD_BITS) | self.ids[at + step]
        keys, n = np.unique(keys, return_counts=True)
        mask = np.int64((1 << WORD_BITS) - 1)
        words = [self.names.take(pa.array((keys >> np.int64(WORD_BITS * (k - 1 - j))) & mask)) for j in range(k)]
        yield self.batch(k, pc.binary_join_element_wise(*words, " "), n)

    def hash_counts(self, pairs: np.ndarray, triples: np.ndarray) -> Iterator[pa.RecordBatch]:
        chosen = [self.pair_hash[self.new(pairs, 2)], self.triple_hash[self.new(triples, 3)]]
        hashes, n = np.unique(np.concatenate(chosen), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], schema=HASHES)

    def batch(self, k: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        size = len(n)
        lang, words = pa.repeat(pa.scalar(self.lang, pa.string()), size), pa.repeat(pa.scalar(k, pa.int32()), size)
        return pa.RecordBatch.from_arrays([lang, words, phrase, pa.array(n.astype(np.int64))], schema=COUNTS)


class Proposal:
    """What the sample proposes as frequent: words, pairs and triples."""

    def __init__(self, words: HashFilter, pairs: HashFilter, triples: HashFilter):
        self.words, self.pairs, self.triples = words, pairs, triples

    @staticmethod
    def counts(row: Row, proposal: Proposal) -> Iterator[pa.RecordBatch]:
        """Exact counts of every word and of the proposed pairs and triples."""
        yield from row.single_counts()
        yield from row.phrase_counts(row.words_in(proposal.words) & proposal.pairs.holds(row.pair_hash), 2)
        yield from row.phrase_counts(row.pairs_in(proposal.pairs) & proposal.triples.holds(row.triple_hash), 3)

    def border_pairs(self, row: Row) -> np.ndarray:
        return row.words_in(self.words) & ~self.pairs.holds(row.pair_hash)

    def border_triples(self, row: Row) -> np.ndarray:
        return row.pairs_in(self.pairs) & ~self.triples.holds(row.triple_hash)


def run_pass(rows: DataFrame, ddl: str, work: Callable[..., Iterator[pa.RecordBatch]], *given: HashFilter | Proposal) -> DataFrame:
    """``work(row, *given)`` on every encoded row; ``given`` are broadcast, their size is bounded by that of the filters."""
    shared = rows.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, lead, words, hashes, ids in zip(*(batch.column(k) for k in range(5)), strict=True):
                row = Row(lang.as_py(), lead.as_py(), words.values, hashes.as_py(), ids.as_py())
                yield from work(row, *shared.value)

    return rows.select("lang", "lead", "words", "hashes", "ids").mapInArrow(run, ddl)


def summed(parts: DataFrame) -> DataFrame:
    """(lang, k, phrase, n) over all rows of a pass."""
    return parts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def words_and_pairs(row: Row) -> Iterator[pa.RecordBatch]:
    yield from row.single_counts()
    yield from row.phrase_counts(row.joined, 2)


def triples_of(row: Row, pairs: HashFilter, counted: HashFilter | None = None) -> Iterator[pa.RecordBatch]:
    """Triples of two pairs in ``pairs``, but not those of two pairs in ``counted``."""
    chosen = row.pairs_in(pairs)
    return row.phrase_counts(chosen if counted is None else chosen & ~row.pairs_in(counted), 3)


def border(row: Row, proposal: Proposal) -> Iterator[pa.RecordBatch]:
    return row.hash_counts(proposal.border_pairs(row), proposal.border_triples(row))


def failed_and_opened(
    row: Row, proposal: Proposal, failed: HashFilter, words: HashFilter
) -> Iterator[pa.RecordBatch]:
    """Border phrases whose hash has failed, and the pairs that ``words`` opens beyond the proposal."""
    opened = row.words_in(words) & ~row.words_in(proposal.words)
    yield from row.phrase_counts((proposal.border_pairs(row) & failed.holds(row.pair_hash)) | opened, 2)
    yield from row.phrase_counts(proposal.border_triples(row) & failed.holds(row.triple_hash), 3)


def propose(sampled: DataFrame, word_count: int, phrase_count: int) -> tuple[Proposal, dict[int, DataFrame], list[str]]:
    """The proposal, its words and pairs as tables, and the scratch tables behind them."""
    found, path = scratch(
        summed(run_pass(sampled, COUNTS_DDL, words_and_pairs)).where(
            (F.col("k") > 0) & (F.col("n") >= F.when(F.col("k") == 1, word_count).otherwise(phrase_count))
        ),
        "phrase-sample",
    )
    known = {k: found.where(F.col("k") == k).select("lang", "phrase") for k in (1, 2)}
    words, pairs = (build_filter(hashed(known[k])) for k in (1, 2))
    triples = summed(run_pass(sampled, COUNTS_DDL, triples_of, pairs))
    triples, triples_path = scratch(triples.where(F.col("n") >= phrase_count), "phrase-sample")
    return Proposal(words, pairs, build_filter(hashed(triples))), known, [path, triples_path]


def failed_border(rows: DataFrame, proposal: Proposal, min_count: int) -> DataFrame:
    """(h): hashes under which the border's pairs and triples occur ``min_count`` times or more, so that every frequent one is
    among them. One long is the key of each sum: the border is most of what a pass sees, and its text is never shuffled."""
    parts = run_pass(rows, "h long, n long", border, proposal)
    return parts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("h")


def frequent_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_of: int = SAMPLE_OF,
    sample_counts: tuple[int, int] = SAMPLE_COUNTS,
    slice_bytes: int = SLICE_BYTES,
) -> tuple[DataFrame, list[int]]:
    """(lang, k, phrase, n) of every phrase of 1 to 3 words that occurs ``min_count`` times or more, and the words of each
    language as k = 0; with the frequent phrases that each pass found, the full pass first.

    The full pass counts the proposal exactly and its border by hash. Where the border fails, a second pass counts exactly the
    border phrases behind failed hashes and the pairs that newly frequent words open; a third one the triples that newly
    frequent pairs open. Three words are the longest phrase, so that closes it. No phrase is counted in two passes.
    """
    if not 0 < slice_bytes <= SLICE_BYTES:
        raise ValueError(f"slice_bytes must be in 1..{SLICE_BYTES}")
    spark = docs.sparkSession
    small_batches(spark)
    raw = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        (F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(sample_of)) == 0).alias("sampled"),
        text_bytes(F.col(f"`{text}`")).alias("raw"),
    )
    rows, rows_path = written_rows(raw.mapInArrow(lambda batches: encode(batches, slice_bytes), ENCODED_DDL))
    proposal, proposed, paths = propose(rows.where("sampled"), *sample_counts)
    passes: list[DataFrame] = []
    found: list[int] = []

    def keep(parts: DataFrame) -> None:
        kept = summed(parts).where((F.col("n") >= min_count) | (F.col("k") == 0))
        passes.append(scratch(kept, "phrase-counts")[0])
        found.append(passes[-1].where(F.col("k") > 0).count())

    def known(k: int) -> DataFrame:
        out = passes[0]
        for more in passes[1:]:
            out = out.unionByName(more)
        return out.where(F.col("k") == k).select("lang", "phrase")

    def outside(k: int) -> bool:
        return not known(k).join(proposed[k], ["lang", "phrase"], "left_anti").isEmpty()

    keep(run_pass(rows, COUNTS_DDL, Proposal.counts, proposal))
    failed, path = scratch(failed_border(rows, proposal, min_count), "phrase-border")
    paths.append(path)
    words = outside(1)
    if words or not failed.isEmpty():
        filters = [build_filter(failed), build_filter(hashed(known(1))) if words else proposal.words]
        keep(run_pass(rows, COUNTS_DDL, failed_and_opened, proposal, *filters))
    if outside(2):
        keep(run_pass(rows, COUNTS_DDL, triples_of, build_filter(hashed(known(2))), proposal.pairs))
    for path in (rows_path, *paths):
        drop_path(spark, path)
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out, found


def written_rows(rows: DataFrame) -> tuple[DataFrame, str]:
    """The encoded rows as a written table; few rows make a row group, so that a reader holds few of them at once."""
    path = fresh_path(rows.sparkSession, "phrase-rows")
    rows.write.option("parquet.block.row.count.limit", ROWS_A_GROUP).option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def with_parts(needs: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``needs`` with the count ``f`` of its ``part``.

    A part with a thousandth of all words is asked for by very many phrases: at most 1,000 such words and 1,000 such pairs
    exist, whatever the corpus, and those are broadcast. The others are joined by a shuffle.
    """
    sizes = counts.where(F.col("k").isin(1, 2)).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    hot = F.col("f") * 1000 >= total
    first = needs.join(F.broadcast(sizes.where(hot)), ["lang", "part"], "left")
    rest = first.where(F.col("f").isNull()).drop("f").join(sizes.where(~hot), ["lang", "part"])
    return first.where(F.col("f").isNotNull()).unionByName(rest)


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits, exact for counts below 10 ** 16."""
    return F.expr(
        f"(1000000 * cast({a} as decimal(18,0)) * cast({a} as decimal(18,0)))"
        f" div (cast({left} as decimal(18,0)) * cast({right} as decimal(18,0)))"
    )


def score_phrases(counts: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of every frequent phrase of two or three words, at its lowest-scoring cut."""
    total = counts.where(F.col("k") == 0).agg(F.sum("n")).first()[0] or 0

    def part(cut: int, side: str, words: int) -> Column:
        return F.struct(
            F.lit(f"{side}{cut}").alias("place"), F.substring_index(F.col("phrase"), " ", words).alias("part")
        )

    pair = F.array(part(1, "l", 1), part(1, "r", -1))
    triple = F.array(part(1, "l", 1), part(1, "r", -2), part(2, "l", 2), part(2, "r", -1))
    needs = (
        counts.where(F.col("k") > 1)
        .select("lang", "k", "phrase", F.col("n").alias("a"), F.explode(F.when(F.col("k") == 2, pair).otherwise(triple)).alias("x"))
        .select("lang", "k", "phrase", "a", "x.place", "x.part")
    )
    places = ("l1", "r1", "l2", "r2")
    sides = with_parts(needs, counts, total).groupBy("lang", "k", "phrase", "a").agg(
        *[F.max(F.when(F.col("place") == p, F.col("f"))).alias(p) for p in places]
    )
    scored = sides.withColumns({"s1": cut_score("a", "l1", "r1"), "s2": cut_score("a", "l2", "r2")})
    second = F.col("s2").isNotNull() & (F.col("s2") < F.col("s1"))
    return scored.select(
        "lang",
        "k",
        "phrase",
        "a",
        *[F.when(second, F.col(b)).otherwise(F.col(c)).alias(n) for n, c, b in (("l", "l1", "l2"), ("r", "r1", "r2"), ("score", "s1", "s2"))],
    )


def without_covered(phrases: DataFrame, share: int = 50) -> DataFrame:
    """Pairs go where a triple around them has ``share`` percent of their occurrences or more."""
    triples = phrases.where(F.col("k") == 3).select(
        "lang",
        "a",
        F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"),
    )
    around = triples.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    pairs = phrases.where(F.col("k") == 2).join(around, ["lang", "phrase"], "left")
    kept = pairs.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * share)).drop("around")
    return kept.unionByName(phrases.where(F.col("k") == 3))


def collocations(docs: DataFrame, top: int = 2000, min_count: int = MIN_COUNT, share: int = 50, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two or three words.

    A text is lowered (A-Z) and split into pieces at ``[.,;:!?`` and the controls 0x0A to 0x0D, a piece into words at blanks and
    tabs. Order: score down, a down, phrase up by its UTF-8 bytes. Null texts are empty, a null language is ``und``. Rows that
    repeat an id are rows of their own. A text of any length is read whole, in slices that share two words. A language without
    a phrase of ``min_count`` occurrences has no rows, nor has an empty table. Only the named columns are read.
    """
    counts, _ = frequent_phrases(docs, min_count, **options)
    words = counts.where(F.col("k") == 0).select("lang", F.col("n"))
    scored, _ = scratch(score_phrases(counts), "phrase-scores")
    best = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The first of each of 16 groups of a language before the first of the language: its task reads 16 times ``top`` rows.
    parts = Window.partitionBy("lang", "group").orderBy(*best)
    dealt = without_covered(scored, share).withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    first = dealt.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top).drop("rank")
    order = Window.partitionBy("lang").orderBy(*best)
    ranked = first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(broadcast_if(words, words.count()), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language over whole ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
q AS (SELECT lang, doc, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pn FROM p),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM q),
t AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM t, (SELECT unnest([1, 2, 3]) AS k)
  WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(c) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, c AS a FROM f WHERE k > 1 AND c >= 10),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT u.lang, u.k, u.phrase, u.ws, u.a, u.cut, x.c AS l, y.c AS r,
    (1000000::HUGEINT * u.a * u.a // (x.c::HUGEINT * y.c)) AS score
  FROM u JOIN f AS x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:cut], ' ')
  JOIN f AS y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[cut + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s),
d AS (
  SELECT DISTINCT lang, phrase FROM (
    SELECT lang, a AS longer, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
    FROM c WHERE k = 3) AS x JOIN (SELECT lang, phrase, a FROM c WHERE k = 2) AS y USING (lang, phrase)
  WHERE 100 * longer >= 50 * a),
z AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM b ANTI JOIN d USING (lang, phrase) WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""
