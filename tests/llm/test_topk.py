import math
import random

import duckdb
import numpy as np
import pytest

from crosslane.llm import topk as op

SCHEMA = "vec_id long, embedding array<float>, label int, key long, ids string, score double, block int"


def make(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", 0.5, 2) for i, v in rows], SCHEMA)


def whole(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def plain_top(rows, every, k, scale=1024.0):
    """(query_id, rank, vec_id, score) by scoring all pairs."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if whole(v)]
    out = []
    for n, (query, w) in enumerate(kept):
        if query is None or query % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(w, v, strict=True)), i is None, i or 0)
            for m, (i, v) in enumerate(kept)
            if m != n and len(v) == len(w)
        ]
        out += [(query, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def some_rows():
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(6)]) for i in range(-20, 130)]
    rows += [(i, [0.25, -0.5, 0.0, 0.125, 1.0, -1.0]) for i in range(200, 240)]
    rows += [(300, [0.0] * 6), (301, [-0.0] * 6), (305, [1e4] * 6), (310, [0.1] * 3), (311, [0.2] * 3), (320, []), (321, [])]
    rows += [(None, [0.5] * 6), (None, None), (330, None), (340, [None] * 6), (350, [float("nan")] + [0.1] * 5)]
    rows += [(360, [float("inf")] + [0.1] * 5), (40, [0.1] * 6), (40, [0.1] * 6), (None, [0.25, -0.5, 0.0, 0.125, 1.0, -1.0])]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block_rows", "query_rows", "k"), [(4096, 256, 10), (7, 3, 10), (16, 256, 1), (30, 2, 500)])
def test_matches_all_pairs(spark, block_rows, query_rows, k):
    rows = some_rows()
    got = op.top_k(make(spark, rows).repartition(3), 10, k, block_rows=block_rows, query_rows=query_rows)
    assert found(got) == plain_top(rows, 10, k)


def test_shuffled_queries_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "broadcast_if", lambda df, rows: df.hint("shuffle_hash"))
    rows = some_rows()
    assert found(op.top_k(make(spark, rows), 10, 5, block_rows=20, query_rows=4)) == plain_top(rows, 10, 5)


def test_lists_are_left_before_their_end():
    draw = np.random.default_rng(1)
    matrix = np.floor(1024 * draw.exponential(0.1, (2000, 3))).astype(np.int64)
    matrix[77] = [9000, 9000, 9000]
    lists = np.argsort(matrix, axis=0, kind="stable").astype(np.uint16)
    block = op.Block(0, 3, list(range(2000)), op.packed(matrix), np.ascontiguousarray(lists.T).tobytes())
    for weights in ([5, 3, 1], [5, -3, 0], [-1, -1, -1], [0, 0, 0]):
        w = np.array(weights, dtype=np.int64)
        want = sorted((-int(v @ w), n) for n, v in enumerate(matrix) if n != 4)[:10]
        places, scores, depth = block.search(w, 4, 10, None)
        assert [(-s, p) for p, s in zip(places.tolist(), scores.tolist(), strict=True)] == want
        if weights == [5, 3, 1]:
            assert depth < 500
    top = int(matrix[77].sum()) * 1
    places, scores, depth = block.search(np.array([1, 1, 1]), None, 10, top)
    assert (places.tolist(), scores.tolist(), depth) == ([77], [top], 16)


def test_large_numbers_are_exact_or_refused(spark):
    rows = [(0, [2.0**17 + 1, 2.0**17]), (1, [2.0**17, 2.0**17 - 3]), (2, [-(2.0**17), 5.0])]
    assert found(op.top_k(make(spark, rows), 1, 2)) == plain_top(rows, 1, 2)
    with pytest.raises(Exception, match="64 bits"):
        op.top_k(make(spark, [(0, [1e30, 1.0])]), 1, 2).count()


def test_empty_tables(spark):
    assert op.top_k(make(spark, [])).count() == 0
    assert op.top_k(make(spark, [(100, [1.0])])).count() == 0
    assert op.top_k(make(spark, [(101, [1.0]), (102, [2.0])])).count() == 0


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert found(op.op12_topk(spark, sf)) == sorted(con.sql(op.OP12_SQL).fetchall(), key=str)
