"""License scan: matching statistics against a generalised suffix automaton of licence words, chained into template spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslane.llm.common import small_batches, table, text_bytes, to_batch, words_of
from crosslane.llm.license_texts import NOTICES, PHRASES

MIN_MATCH = 4
MAX_GAP = 12
MIN_COVER = 0.6
PHRASE_SCORE = 0.5


class LicenseAutomaton:
    """Suffix automaton over the words of all templates: a state stands for the substrings that end at the same places."""

    def __init__(self, notices: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES):
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link, self.moves = [0], [-1], [{}]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.labels, self.sizes = [], []
        for label, text in notices:
            words = self._ids(text)
            self.labels.append(label)
            self.sizes.append(len(words))
            self._add(words, len(self.labels) - 1)
        named = []
        for label, text in phrases:
            words = self._ids(text)
            self._add(words, None)
            named.append((label, words))
        order = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for state in order:
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        # Phrases that end where a state ends: its own (if the match is long enough) and those of its suffix links.
        own: dict[int, list[tuple[int, str]]] = {}
        for label, words in named:
            state = 0
            for w in words:
                state = self.moves[state][w]
            own.setdefault(state, []).append((len(words), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.length]
        for state in reversed(order):
            self.phrases[state] = own.get(state, []) + self.phrases[self.link[state]]
        self.shortest = min([MIN_MATCH, *(len(words) for _, words in named)])

    def _ids(self, text: str) -> list[int]:
        return [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode())]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.moves.append(moves)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the shorter substrings; the moves that meant those lead to it."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.moves[target]))
        self.link[target] = copy
        while state >= 0 and self.moves[state].get(word) == target:
            self.moves[state][word] = copy
            state = self.link[state]
        return copy

    def _add(self, words: list[int], template: int | None) -> None:
        last = 0
        for place, word in enumerate(words):
            known = self.moves[last].get(word)
            if known is not None:
                exact = self.length[known] == self.length[last] + 1
                last = known if exact else self._split(last, word, known)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                state = last
                while state >= 0 and word not in self.moves[state]:
                    self.moves[state][word] = new
                    state = self.link[state]
                if state >= 0:
                    target = self.moves[state][word]
                    exact = self.length[target] == self.length[state] + 1
                    self.link[new] = target if exact else self._split(state, word, target)
                last = new
            if template is not None:
                self.ends[last].add((template, place + 1))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
        """Maximal matches (end, length, state) of at least MIN_MATCH words, and phrase places (start, length, label)."""
        look = self.vocabulary.get
        ids = [look(w, 0) for w in words]
        known = np.array(ids, dtype=np.int32) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        matches: list[tuple[int, int, int]] = []
        places: list[tuple[int, int, str]] = []
        length, link, moves, phrases = self.length, self.link, self.moves, self.phrases
        for first, stop in edges.reshape(-1, 2).tolist():
            if stop - first < self.shortest:
                continue
            state = size = 0
            for at in range(first, stop):
                word = ids[at]
                before, old = size, state
                while state and word not in moves[state]:
                    state = link[state]
                    size = length[state]
                if word in moves[state]:
                    state = moves[state][word]
                    size += 1
                if size <= before and before >= MIN_MATCH:
                    matches.append((at, before, old))
                for wide, label in phrases[state]:
                    if wide <= size:
                        places.append((at + 1 - wide, wide, label))
            if size >= MIN_MATCH:
                matches.append((stop, size, state))
        return matches, places

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, covered share of the template) of each chain.

        Matches of a template chain while they move forward in both texts and the text's gap stays small.
        """
        running: dict[int, list[int]] = {}
        done: list[tuple[int, list[int]]] = []
        for end, size, state in sorted(matches):
            for template, stop in self.ends[state]:
                chain = running.get(template)
                start, there = end - size, stop - size
                if chain and start - chain[1] <= MAX_GAP and stop > chain[2]:
                    fresh = min(size, stop - max(there, chain[2]), end - max(start, chain[1]))
                    if fresh > 0:
                        running[template] = [chain[0], end, stop, chain[3] + fresh]
                    continue
                if chain and start < chain[1]:
                    continue
                if chain:
                    done.append((template, chain))
                running[template] = [start, end, stop, size]
        done += running.items()
        out = [(self.labels[t], c[0], c[1], min(1.0, c[3] / self.sizes[t])) for t, c in done]
        return sorted(x for x in out if x[3] >= MIN_COVER)


SCAN = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])
            ),
        ),
    ]
)
SCAN_DDL = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:long,end:long,cover:double>>"
)


def scan_licenses(documents: DataFrame, key: str = "doc_id", text: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """Per document row: phrase places, covered template spans, labels and a score.

    The score is the largest covered share of a template, and at least 0.5 where a phrase stands. Null and empty texts have
    no words and score 0. Repeated rows are scanned each. Only ``key`` and ``text`` are read.
    """
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(LicenseAutomaton(notices, phrases))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(raw)
                matches, places = automaton.scan(words)
                spans = automaton.spans(matches)
                base = {label for _, _, label in places}
                starts = [start for start, _, _ in places]
                rows.append(
                    (
                        doc,
                        len(words),
                        len(places),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(base | {s[0] for s in spans})),
                        max([PHRASE_SCORE * bool(places), *(s[3] for s in spans)]),
                        [dict(zip(("label", "first", "end", "cover"), s, strict=True)) for s in spans],
                    )
                )
            yield to_batch(rows, SCAN)

    return documents.select(F.col(key).cast("long").alias("key"), text_bytes(text).alias("raw")).mapInArrow(scan, SCAN_DDL)


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
