import random
import zlib

import numpy as np
import pytest

from crosslane.llm import toxicity as op


def tiny():
    rng = random.Random(9)
    clean = [f"w{k}" for k in range(300)]

    def text(n, bad):
        ws = [rng.choice(clean) for _ in range(n)]
        if bad:
            ws[rng.randrange(n)] = rng.choice(["nasty", "vile", "zqxbad" + rng.choice(["one", "two", "three"])])
        return " ".join(ws).encode()

    labels = [k % 4 == 0 for k in range(400)]
    return [text(rng.randrange(2, 200), y) for y in labels], [int(y) for y in labels], text


@pytest.fixture(scope="module")
def network():
    texts, labels, _ = tiny()
    return op.train(texts, labels)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = op.Network(1)
    for k, v in net.weights.items():
        net.weights[k] = v.astype(np.float64) + 0.3 * rng.standard_normal(v.shape)
    gates = rng.standard_normal((20, 6 * op.HIDDEN))
    gates[0] = 0
    index = rng.integers(1, 20, (5, op.WINDOW))
    index[1, 20:] = 0
    target = np.array([1, 0, 1, 0, 0.0])
    loss, grads, d_gates = net.gradients(gates, index, target)
    for name, g in grads.items():
        flat = net.weights[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            old = flat[k]
            flat[k] = old + 1e-3
            up = net.gradients(gates, index, target)[0]
            flat[k] = old - 1e-3
            down = net.gradients(gates, index, target)[0]
            flat[k] = old
            assert abs((up - down) / 2e-3 - g.reshape(-1)[k]) < 2e-3
    row = int(index[0, 4])
    for column in (0, op.HIDDEN, 2 * op.HIDDEN, 3 * op.HIDDEN + 1):
        old = gates[row, column]
        gates[row, column] = old + 1e-3
        up = net.gradients(gates, index, target)[0]
        gates[row, column] = old - 1e-3
        down = net.gradients(gates, index, target)[0]
        gates[row, column] = old
        assert abs((up - down) / 2e-3 - d_gates[:, :, column][index.T == row].sum()) < 2e-3
    assert loss > 0


def test_windows_cover_every_word():
    lengths = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    index, owner = op.window_index(lengths)
    ends = np.cumsum(lengths)
    for doc, n in enumerate(lengths):
        mine = index[owner == doc]
        seen = set(mine[mine > 0].tolist())
        assert seen == set(range(ends[doc] - n + 1, ends[doc] + 1))
        if n > op.WINDOW:
            assert (np.diff(mine[:, 0]) == op.STRIDE).all()


def test_learns_words_and_character_stems(network):
    _, _, text = tiny()
    scorer = op.Scorer(network)
    clean, bad = [text(150, False) for _ in range(100)], [text(150, True) for _ in range(100)]
    bad.append(b"w1 w2 zqxbadnew w3 w4 w5")
    low, high = scorer.score(clean), scorer.score(bad)
    assert (low < op.THRESHOLD).mean() > 0.97 and (high >= op.THRESHOLD).mean() > 0.95
    assert high[-1] >= op.THRESHOLD


def test_scores_do_not_depend_on_the_batch(network, monkeypatch):
    texts = tiny()[0][:60] + [b"", b"...", b"w1 " * 5000 + b"nasty", b"x" * 10_000]
    whole = op.Scorer(network).score(texts)
    single = np.array([op.Scorer(network).score([t])[0] for t in texts])
    assert np.allclose(whole, single, atol=1e-5)
    assert whole[60] == whole[61] == 0 and whole[62] >= op.THRESHOLD and whole[63] < op.THRESHOLD
    monkeypatch.setattr(op, "MEMO_WORDS", 10)
    monkeypatch.setattr(op, "BLOCK", 7)
    small = op.Scorer(network)
    assert np.allclose(np.concatenate([small.score(texts[k : k + 3]) for k in range(0, len(texts), 3)]), whole, atol=1e-5)


def test_over_long_words_are_read_whole():
    """Texts without ASCII blanks: every byte is in a step, and a stem in the middle is learned and found."""
    rng = random.Random(2)

    def run(n, bad):
        cs = "".join(chr(0x4E00 + rng.randrange(60)) for _ in range(n))
        at = rng.randrange(40, n - 40)
        return (cs[:at] + "\u6bd2\u8a9e\u7f75\u60aa" * bad + cs[at:]).encode()

    for n in (125, 126, 127, 128, 220, 221, 5000):
        word = run(2000, False)[:n]
        steps = op.steps_of(word)
        assert steps[0] + b"".join(s[op.PIECE_OVERLAP :] for s in steps[1:]) == word
        assert len(steps) == 1 if n <= op.LONG_BYTES else max(map(len, steps)) <= op.PIECE_BYTES
    assert op.steps_of(b"") == [] and op.steps_of(b"a " + b"b" * 100) == [b"a", b"b" * 100]
    labels = [k % 3 == 0 for k in range(300)]
    scorer = op.Scorer(op.train([run(rng.randrange(90, 300), y) for y in labels], [int(y) for y in labels]))
    low, high = (scorer.score([run(rng.randrange(90, 300), y) for _ in range(100)]) for y in (False, True))
    assert np.mean(high[:, None] > low[None, :]) > 0.9


def test_frames(spark, frame, network):
    rows = [(1, "w1 nasty w2"), (2, None), (3, ""), (4, "w1 w2 w3"), (4, "w1 w2 w3"), (None, "vile w3")]
    scored = {(r.key, round(r.score, 4)) for r in op.add_scores(frame(rows), network, "doc_id").collect()}
    assert len(scored) == 5
    kept = op.remove_toxic(frame(rows), network)
    assert kept.columns == frame(rows).columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 4]
    assert op.add_scores(frame([]), network, "doc_id").count() == 0
    assert {r.score for r in op.add_scores(frame(rows), None, "doc_id").collect()} == {0.0}


def test_sample_leaves_out_held_out_rows(spark, frame):
    rows = [(k, f"text {k}") for k in range(300)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(300)] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    found = op.training_sample(frame(rows), labels, "doc_id", "text", "toxic", 40).collect()
    assert len(found) == 80 and all(zlib.crc32(str(r.sample_key).encode()) % 3 != 1 for r in found)
    one = spark.createDataFrame([(k, 1, 1) for k in range(9)], "doc_id long, quality int, toxic int")
    assert op.fit(frame(rows), one) is None


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = op.op3_toxicity(spark, sf).collect()
    held = [(r.score, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.85 and all(r.predicted == (r.score >= op.THRESHOLD) for r in found)
