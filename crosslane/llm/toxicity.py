"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is a learned vector of the word plus those of its character n-grams (with its borders). A window of words runs
through a gated recurrent unit in both directions; attention weighs the states; a logistic unit scores the window. All
overlapping windows of a text are scored, and the calibrated largest one is the text's score.

Only documents say whether they are toxic, not their windows. Training starts from windows with the most telling
features (smoothed log odds over the training documents) and then takes the windows that the network itself scores
highest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslane.llm.common import small_batches, table, text_bytes, words_of

WINDOW = 32
STRIDE = 16
HIDDEN = 8
WIDTH = 8
WORD_BUCKETS = 1 << 14
GRAM_BUCKETS = 1 << 17
GRAM_SIZES = (3, 4, 5, 6)
# Longer words (a text without ASCII blanks is one) become pieces of about a word's size; each shares bytes with the one before it.
LONG_BYTES, PIECE_BYTES, PIECE_OVERLAP = 126, 48, 16
GRAM_FACTOR, GRAM_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
# The labelled sample: at most so many documents of either label, taken in hash order, and characters of each.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 200_000
THRESHOLD = 0.7
MEMO_WORDS = 100_000
BLOCK = 2048
SEED = 11


def steps_of(raw: bytes) -> list[bytes]:
    """The words of a text, over-long ones as overlapping pieces that hold every stem of up to PIECE_OVERLAP bytes whole."""
    words = words_of(raw)
    if max(map(len, words), default=0) <= LONG_BYTES:
        return words
    out = []
    for w in words:
        starts = range(0, len(w) - PIECE_OVERLAP, PIECE_BYTES - PIECE_OVERLAP) if len(w) > LONG_BYTES else ()
        out += [w[k : k + PIECE_BYTES] for k in starts] or [w]
    return out


def features_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, word after word, and how many each has.

    Words stand between the marks ^ and $. All n-grams of all words are hashed together: the hash of one that is a byte
    longer goes on from the shorter one's.
    """
    edged = [b"^" + w + b"$" for w in words]
    lengths = np.fromiter(map(len, edged), dtype=np.int64, count=len(edged))
    starts = np.cumsum(lengths) - lengths
    letters = np.frombuffer(b"".join(edged), dtype=np.uint8).astype(np.uint64)
    counts = np.maximum(lengths[None, :] - np.array(GRAM_SIZES)[:, None] + 1, 0)
    sizes = 1 + counts.sum(axis=0)
    ends = np.cumsum(sizes)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    flat[ends - sizes] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)) % WORD_BUCKETS
    place = ends - sizes + 1
    hashed, size = letters, 1
    for n, count in zip(GRAM_SIZES, counts, strict=True):
        while size < n:
            hashed = hashed[:-1] * GRAM_FACTOR + letters[size:]
            size += 1
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        found = hashed[np.repeat(starts, count) + within] + np.uint64(n)
        found = (found ^ (found >> np.uint64(29))) * GRAM_MIX
        flat[np.repeat(place, count) + within] = WORD_BUCKETS + (found >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS
        place = place + count
    return flat, sizes


def window_index(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) -> word, counted through all texts and 1-based (0: past the end), and each window's text.

    A text of n words has windows at every STRIDE until one reaches its end; none if it has no words.
    """
    counts = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // STRIDE)) + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = within[:, None] * STRIDE + np.arange(WINDOW)[None, :]
    base = (np.cumsum(lengths) - lengths)[owner]
    return np.where(start < lengths[owner][:, None], base[:, None] + start + 1, 0), owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Network:
    """Parameters, scoring and training of the window network."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def drawn(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.embedding = (0.01 * rng.standard_normal((WORD_BUCKETS + GRAM_BUCKETS, WIDTH))).astype(np.float32)
        self.weights = {}
        for side in ("f", "b"):
            self.weights["w" + side] = drawn(WIDTH, 3 * HIDDEN)
            self.weights["u" + side] = drawn(HIDDEN, 3 * HIDDEN)
            self.weights["c" + side] = np.zeros(3 * HIDDEN, dtype=np.float32)
        self.weights["attend"] = drawn(2 * HIDDEN, 1)[:, 0]
        self.weights["out"] = drawn(2 * HIDDEN, 1)[:, 0]
        self.weights["bias"] = np.zeros(1, dtype=np.float32)
        self.scale, self.shift = 1.0, 0.0

    def word_vector(self, features: np.ndarray) -> np.ndarray:
        return self.embedding[features].sum(axis=0)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """Gate inputs of word vectors for both directions."""
        w = self.weights
        return np.concatenate([vectors @ w["wf"] + w["cf"], vectors @ w["wb"] + w["cb"]], axis=1)

    def run(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Window logits out of gate inputs (row 0: no word) and the words of each window."""
        w, (n, steps) = self.weights, index.shape
        columns = np.ascontiguousarray(index.T)
        mask = (index > 0).astype(np.float32)
        states = np.zeros((steps, n, 2 * HIDDEN), dtype=np.float32)
        trace = {}
        for side, order, at in (("f", range(steps), 0), ("b", range(steps - 1, -1, -1), HIDDEN)):
            u, h = w["u" + side], np.zeros((n, HIDDEN), dtype=np.float32)
            column = slice(3 * at, 3 * at + 3 * HIDDEN)
            side_gates = np.ascontiguousarray(gates[:, column])
            for t in order:
                x, inner = side_gates.take(columns[t], axis=0), h @ u
                zr = sigmoid(x[:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(x[:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
                after = (new + z * (h - new)) * mask[:, t, None]
                if keep:
                    trace[side, t] = (h, z, r, new, inner[:, 2 * HIDDEN :])
                h = after
                states[t, :, at : at + HIDDEN] = h
        pull = np.where(mask.T > 0, states @ w["attend"], -1e9)
        pull = np.exp(pull - pull.max(axis=0)) * mask.T
        share = pull / np.maximum(pull.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", share, states)
        logits = pooled @ w["out"] + w["bias"][0]
        return (logits, states, share, pooled, trace, mask) if keep else logits

    def gradients(self, gates: np.ndarray, index: np.ndarray, target: np.ndarray):
        """Loss, gradients of the weights, and of the gate inputs of each (step, window)."""
        w = self.weights
        logits, states, share, pooled, trace, mask = self.run(gates, index, keep=True)
        p = sigmoid(logits)
        n, steps = index.shape
        up = ((p - target) / n).astype(np.float32)
        g = {"out": pooled.T @ up, "bias": np.array([up.sum()], dtype=np.float32)}
        d_pooled = up[:, None] * w["out"]
        d_share = np.einsum("nh,tnh->tn", d_pooled, states)
        d_pull = share * (d_share - (share * d_share).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", d_pull, states)
        d_states = share[:, :, None] * d_pooled[None] + d_pull[:, :, None] * w["attend"]
        d_gates = np.zeros((steps, n, 6 * HIDDEN), dtype=np.float32)
        for side, order, at in (("f", range(steps - 1, -1, -1), 0), ("b", range(steps), HIDDEN)):
            u = w["u" + side]
            g["u" + side] = np.zeros_like(u)
            carried = np.zeros((n, HIDDEN), dtype=np.float32)
            for t in order:
                h, z, r, new, inner = trace[side, t]
                d = (d_states[t, :, at : at + HIDDEN] + carried) * mask[:, t, None]
                d_new = d * (1 - z) * (1 - new * new)
                d_z = d * (h - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_new], axis=1)
                d_inner = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g["u" + side] += h.T @ d_inner
                carried = d * z + d_inner @ u.T
                d_gates[t, :, 3 * at : 3 * at + 3 * HIDDEN] = d_x
        loss = float(np.mean(np.logaddexp(0, logits) - target * logits))
        return loss, g, d_gates

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * logits + self.shift)


class Corpus:
    """Texts as rows of distinct words, with the buckets of each distinct word."""

    def __init__(self, texts: list[bytes]):
        known: dict[bytes, int] = {}
        rows = [[known.setdefault(w, len(known) + 1) for w in steps_of(t)] for t in texts]
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.words = np.array([0, *(w for r in rows for w in r)], dtype=np.int64)
        self.flat, self.sizes = features_of(list(known))
        self.features = np.split(self.flat, np.cumsum(self.sizes)[:-1]) if known else []
        places, self.owner = window_index(self.lengths)
        self.windows = self.words[places]

    def vectors(self, network: Network, words: np.ndarray | None = None) -> np.ndarray:
        """Vectors of the distinct words (row 0: none), in blocks."""
        out = np.zeros((len(self.features) + 1, WIDTH), dtype=np.float32)
        ends = np.cumsum(self.sizes)
        for k in range(0, len(self.features), BLOCK):
            stop = min(k + BLOCK, len(self.features))
            first = ends[k] - self.sizes[k]
            rows = network.embedding[self.flat[first : ends[stop - 1]]]
            out[k + 1 : stop + 1] = np.add.reduceat(rows, ends[k:stop] - self.sizes[k:stop] - first, axis=0)
        return out

    def logits(self, network: Network) -> np.ndarray:
        gates = network.projected(self.vectors(network))
        gates[0] = 0
        parts = [network.run(gates, self.windows[k : k + BLOCK]) for k in range(0, len(self.windows), BLOCK)]
        return np.concatenate([np.zeros(0, np.float32), *parts])

    def best(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The window with the largest value of each text that has any, and the text."""
        order = np.lexsort((-values, self.owner))
        first = np.flatnonzero(np.diff(self.owner[order], prepend=-1))
        return order[first], self.owner[order[first]]


def log_odds(corpus: Corpus, target: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each bucket by the documents that hold it; 0 where few do or little is told."""
    buckets = WORD_BUCKETS + GRAM_BUCKETS
    held = np.zeros((2, buckets))
    ends = np.cumsum(corpus.lengths)
    for doc, (stop, n) in enumerate(zip(ends.tolist(), corpus.lengths.tolist(), strict=True)):
        words = np.unique(corpus.words[stop - n + 1 : stop + 1])
        if len(words):
            found = np.unique(np.concatenate([corpus.features[w - 1] for w in words.tolist()]))
            held[int(target[doc]), found] += 1
    totals = np.array([(target == 0).sum(), (target == 1).sum()]) + 1.0
    odds = np.log((held[1] + 0.5) / totals[1]) - np.log((held[0] + 0.5) / totals[0])
    return np.where((held.sum(axis=0) >= 3) & (odds > 1.5), odds, 0.0)


def train(texts: list[bytes], labels: list[int], rounds: int = 3, epochs: int = 3, batch: int = 128, seed: int = SEED) -> Network | None:
    """A trained and calibrated network; None where either label is missing."""
    target = np.array(labels, dtype=np.float32)
    if not (target == 1).any() or not (target == 0).any():
        return None
    corpus, network, rng = Corpus(texts), Network(seed), np.random.default_rng(seed)
    odds = log_odds(corpus, target)
    network.embedding[:, 0] += (0.2 * odds).astype(np.float32)
    told = np.concatenate([[0.0], [odds[f].max() for f in corpus.features]])
    values = told[corpus.windows].sum(axis=1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in network.weights.items()}
    seen, step = np.full(network.embedding.shape, 1e-6, dtype=np.float32), 0
    for _ in range(rounds):
        top, owner = corpus.best(values)
        clean = np.flatnonzero(target[corpus.owner] == 0)
        drawn = rng.choice(clean, size=min(len(clean), len(top)), replace=False)
        chosen = np.concatenate([top, drawn])
        goal = np.concatenate([target[owner], np.zeros(len(drawn), dtype=np.float32)])
        for _ in range(epochs):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), batch):
                part = order[k : k + batch]
                index = corpus.windows[chosen[part]]
                words, local = np.unique(index, return_inverse=True)
                # Row 0 is the place past a text's end; without one it stands for nothing here.
                if words[0] != 0:
                    words, local = np.concatenate([[0], words]), local + 1
                local = local.reshape(index.shape)
                features = [corpus.features[w - 1] for w in words[1:].tolist()]
                vectors = np.zeros((len(words), WIDTH), dtype=np.float32)
                for n, f in enumerate(features):
                    vectors[n + 1] = network.word_vector(f)
                gates = network.projected(vectors)
                _, grads, d_gates = network.gradients(gates, local, goal[part])
                flat = np.zeros((len(words), 6 * HIDDEN), dtype=np.float32)
                np.add.at(flat, local.T.ravel(), d_gates.reshape(-1, 6 * HIDDEN))
                flat[0] = 0
                for side, at in (("f", 0), ("b", 3 * HIDDEN)):
                    mine = flat[:, at : at + 3 * HIDDEN]
                    grads["w" + side], grads["c" + side] = vectors.T @ mine, mine.sum(axis=0)
                w = network.weights
                d_vectors = flat[:, : 3 * HIDDEN] @ w["wf"].T + flat[:, 3 * HIDDEN :] @ w["wb"].T
                step += 1
                for name, g in grads.items():
                    one, two = moments[name]
                    one += 0.1 * (g - one)
                    two += 0.01 * (g * g - two)
                    network.weights[name] = w[name] - 0.01 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8)
                ids = np.concatenate(features) if features else np.zeros(0, np.int64)
                rows = np.repeat(np.arange(1, len(words)), [len(f) for f in features])
                touched, place = np.unique(ids, return_inverse=True)
                total = np.zeros((len(touched), WIDTH), dtype=np.float32)
                np.add.at(total, place, d_vectors[rows])
                seen[touched] += total * total
                network.embedding[touched] -= 0.02 * total / np.sqrt(seen[touched])
        values = corpus.logits(network)
    calibrate(network, corpus, values, target)
    return network


def calibrate(network: Network, corpus: Corpus, values: np.ndarray, target: np.ndarray, steps: int = 200) -> None:
    """Scale and shift of the largest logit so that scores are likelihoods on the training documents (Newton steps)."""
    top, owner = corpus.best(values)
    x, y = values[top].astype(np.float64), target[owner].astype(np.float64)
    # Targets short of 0 and 1 keep the slope finite where the classes part fully.
    ones, zeros = y.sum(), (1 - y).sum()
    y = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(steps):
        p = sigmoid(design @ beta)
        hessian = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, design.T @ (y - p) - 1e-6 * beta)
        beta += np.clip(move, -1.0, 1.0)
        if np.abs(move).max() < 1e-9:
            break
    network.scale, network.shift = float(max(beta[0], 1e-3)), float(beta[1])


class Scorer:
    """Scores of many texts; remembers the gate inputs of the words met lately."""

    def __init__(self, network: Network):
        self.network = network
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.gates = np.zeros((1 << 16, 6 * HIDDEN), dtype=np.float32)
        self.used = 1

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row of each word; the rows of a call stay valid until the next one."""
        distinct = set(words)
        if self.used + len(distinct) > MEMO_WORDS:
            self.reset()
        new = [w for w in distinct if w not in self.known]
        if new:
            while self.used + len(new) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            for k in range(0, len(new), BLOCK):
                flat, sizes = features_of(new[k : k + BLOCK])
                vectors = np.add.reduceat(self.network.embedding.take(flat, axis=0), np.cumsum(sizes) - sizes, axis=0)
                self.gates[self.used + k : self.used + k + len(sizes)] = self.network.projected(vectors)
            self.known.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """One score per text; a text without words scores 0."""
        parted = [steps_of(t) for t in texts]
        lengths = np.array([len(p) for p in parted], dtype=np.int64)
        words = np.concatenate([[0], self.rows([w for p in parted for w in p])])
        places, owner = window_index(lengths)
        best = np.full(len(texts), -np.inf)
        for k in range(0, len(places), BLOCK):
            logits = self.network.run(self.gates, words[places[k : k + BLOCK]])
            np.maximum.at(best, owner[k : k + BLOCK], logits)
        return np.where(lengths > 0, self.network.scores(np.where(lengths > 0, best, 0.0)), 0.0)


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def training_sample(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_label: int) -> DataFrame:
    """(raw, label) of at most ``per_label`` labelled documents of either label that are not held out, in hash order.

    The sample's keys are chosen from the labels alone and are few by that bound, so the documents are scanned, not shuffled.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
    rows = rows.groupBy(F.col(key).alias("sample_key")).agg(F.max(label).alias("label"))
    picked = [
        rows.where(F.col("label") == value).orderBy(F.xxhash64("sample_key"), "sample_key").limit(per_label) for value in (0, 1)
    ]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    short = documents.select(F.col(key).alias("sample_key"), F.col(text).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    return short.join(sample, "sample_key").select("sample_key", text_bytes("text").alias("raw"), "label")


def fit(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_DOCS
) -> Network | None:
    """A network trained on the bounded sample of rows whose crc32(key) mod 3 is not 1."""
    rows = training_sample(documents, labels, key, text, label, per_label).limit(4 * per_label).collect()
    rows.sort(key=lambda r: (r.sample_key, bytes(r.raw)))
    return train([bytes(r.raw) for r in rows], [int(r.label) for r in rows])


def add_scores(documents: DataFrame, network: Network | None, key: str = "key", text: str = "text") -> DataFrame:
    """(key, score) per document row: every overlapping window of the whole text. Without a network every score is 0.

    ``key`` may be any column, a packed row too. Null and empty texts score 0.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(F.col(key).alias("key"), text_bytes(text).alias("raw"))
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            raws = batch.column(1).to_pylist()
            found = scorer.score(raws) if scorer and raws else np.zeros(len(raws))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["key", "score"])

    return rows.mapInArrow(run, rows.select("key", F.lit(0.0).alias("score")).schema)


def remove_toxic(documents: DataFrame, network: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"), F.col(text).alias("text"))
    return add_scores(packed, network, "whole", "text").where(F.col("score") < threshold).select("key.*")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    network = fit(documents, table(spark, sf_dir, "labels"))
    scored = add_scores(documents, network, "doc_id")
    return scored.select(
        F.col("key").alias("doc_id"),
        held_out("key").alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
