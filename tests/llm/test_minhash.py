import random

import numpy as np
import plain
import pytest

from crosslane.llm import minhash as op
from crosslane.llm.components import components


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, words, changes):
    words = words.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=3):
    """Copies, chains of edits, a large group of near copies, and a passage that many documents share."""
    rng, rows = random.Random(seed), []

    def add(t):
        rows.append((len(rows) * 3 + 1, t))

    for _ in range(60):
        add(text(rng, rng.randrange(1, 120)))
    for _ in range(12):
        base = text(rng, 150)
        for _ in range(6):
            add(edited(rng, base, rng.randrange(0, 14)))
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, 7)
            add(chain)
    base = text(rng, 200)
    for _ in range(120):
        add(edited(rng, base, rng.randrange(0, 9)))
    for passage, own in ((160, 26), (160, 20), (160, 14)):
        shared = text(rng, passage)
        for _ in range(50):
            add(shared + " " + text(rng, own, 10**6))
    for t in (None, "", "  \n", "one", "One", "one two", "ONE TWO", "one  two\n", "x" * 20_000, "word " * 3000):
        add(t)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_all_components_match_plain_version(spark, frame, words):
    rows = corpus()
    roots = plain.linked_components(rows, words)
    found = op.near_duplicates(frame(rows), words=words).collect()
    assert {r.doc_id: r.component_id for r in found} == roots
    assert {r.doc_id: r.n_shingles for r in found} == {d: len(plain.shingles(t, words)) for d, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    kept = op.drop_near_duplicates(frame(rows), words=words)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r for r in roots.values()})


def test_open_pairs_are_all_found(spark, frame):
    rows = corpus(8)
    sets = op.sets_of(frame(rows), frame(rows).selectExpr("doc_id as id"), "doc_id", "text", 2)
    labels = frame(rows).selectExpr("doc_id as id", "doc_id as root")
    found = {tuple(sorted((r.a, r.b))) for r in op.confirm(op.open_pairs(sets, labels), sets).collect()}
    own = {d: plain.shingles(t, 2) for d, t in rows}
    want = {
        (a, b) for a in own for b in own if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])
    }
    assert found == want


def test_repeated_and_null_ids(spark, frame):
    same = "a b c d e f g h i j"
    rows = [(5, same), (5, same), (None, same), (9, same + " k"), (7, "other words"), (7, "quite different ones here"), (None, "")]
    found = op.near_duplicates(frame(rows), words=2).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(5, None), (None, None), (9, None), (7, 7)}
    assert sorted((r.doc_id is not None, r.doc_id) for r in op.drop_near_duplicates(frame(rows), words=2).collect()) == [(False, None), (True, 7)]
    assert op.near_duplicates(frame([])).count() == 0


def test_ids_link_nothing(spark, frame):
    """Null and repeated ids with different texts: every text stays, and groups are not chained through an id."""
    rng = random.Random(4)
    one, two, other = (text(rng, 60) for _ in range(3))
    rows = [(None, one + " a"), (1, one), (None, two + " b"), (7, two), (7, other), (7, other), (8, two + " c"), (None, text(rng, 40))]
    rows += [(None, None), (9, ""), (3, text(rng, 1)), rows[-1]]
    found = {(r.doc_id, r.component_id, r.kept, r.n_shingles > 0) for r in op.near_duplicates(frame(rows)).collect()}
    assert found == {
        (None, None, True, True), (1, None, False, True), (7, None, False, True), (7, 7, True, True), (8, None, False, True),
        (None, None, True, False), (9, 9, True, False), (3, 3, True, True),
    }
    kept = sorted(((r.doc_id, r.text) for r in op.drop_near_duplicates(frame(rows), one_per_id=False).collect()), key=str)
    gone = {(1, one), (7, two), (8, two + " c")}
    assert kept == sorted({r for r in rows if r not in gone}, key=str)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(40)]
    links += [(2000, 2001 + k) for k in range(200)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_estimate_similarity():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(both[:850]), np.unique(both[50:])
    assert (op.bands(a) == op.bands(a, block=64)).all()
    assert 0.3 < (op.bands(a) == op.bands(b)).mean() < 1
