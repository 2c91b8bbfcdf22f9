from collections import Counter
from itertools import permutations

import duckdb
import plain
import pytest

from crosslane.llm import filter_audit as op

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LONG = " ".join(f"w{k}" for k in range(250))
ROWS = [
    (1, None, "en"),
    (2, "", "en"),
    (3, LONG, "en"),
    (4, LONG, "en"),
    (4, LONG, "de"),
    (5, "same " * 300, "en"),
    (6, "AB " * 250, None),
    (7, LONG + " #", None),
    (8, LONG + "\x0b|\x0c\r\n", ""),
    (None, LONG, "en"),
    (None, "", "de"),
    (9, "é" * 50 + "A", "de"),
    (10, "Ü" * 50 + "AA", "de"),
    (7, "other text under a used id", "en"),
    (11, "Same blank " * 400, "de"),
    (12, "x" * 100_000 + " y" * 50_000, "fr"),
]
LABELS = [(3, 1, 0), (4, 1, 1), (4, 0, None), (5, 0, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (9, None, 1)]


def failed(rows):
    """Letters of the filters that each row fails."""
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = plain.blank_words_as_they_are(text)
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
            bad.add("C")
        if any(c in "#$%&*|" for c in text):
            bad.add("D")
        if doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, _ in rows):
            bad.add("E")
        out.append(bad)
    return out


def expected(rows, labels):
    bad = failed(rows)
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, x in labels if d is not None and x == 1}
    out = []
    for part in {p or "" for _, _, p in rows}:
        here = [(d, b) for (d, _, p), b in zip(rows, bad, strict=True) if (p or "") == part]
        lines, by_filter = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(here)
            for step, letter in enumerate(order, 1):
                gone = [(d, b) for d, b in left if letter in b]
                left = [(d, b) for d, b in left if letter not in b]
                by_filter[letter] += len(gone)
                all_fail = sum(letter in b for _, b in here)
                lines.append(
                    [part, order, step, len(left), len(gone), all_fail - len(gone), sum(b == {letter} for _, b in here),
                     sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                )
        out += [(*x, by_filter[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def make(spark, rows, labels):
    docs = spark.createDataFrame(
        [(*r, 1, "x", True, "y") for r in rows], "doc_id long, text string, lang string, id long, part string, good boolean, body string"
    )
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("copies", [512, 2])
def test_audit_matches_plain_version(spark, monkeypatch, copies):
    monkeypatch.setattr(op, "COPIES_A_TASK", copies)
    rows = ROWS + [(100 + k, "copied", "en" if k % 3 else "fr") for k in range(40)] + [ROWS[4]] * 3
    got = op.audit(*make(spark, rows, LABELS)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == expected(rows, LABELS)


def test_own_filters_and_names(spark):
    docs, labels = make(spark, ROWS, LABELS)
    tests = {"x": lambda t: t.contains("w1"), "y": lambda t: t == ""}
    got = op.audit(docs, labels, tests).collect()
    assert {r.filter_order for r in got} == {"".join(p) for p in permutations("xyE")}
    first = next(r for r in got if r.part == "en" and r.filter_order == "xyE" and r.step == 1)
    assert (first.removed, first.kept) == (3, 4)
    with pytest.raises(ValueError):
        op.audit(docs, labels, {"E": tests["x"]})


def test_empty_tables(spark):
    assert op.audit(*make(spark, [], [])).count() == 0
    docs, labels = make(spark, [(1, None, None)], [])
    got = op.audit(docs, labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and sum(r.removed for r in got) == 120


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    found = con.sql(op.OP13_SQL)
    places = [found.columns.index(c) for c in COLUMNS]
    want = sorted(tuple(r[p] for p in places) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in COLUMNS) for r in op.op13_filter_audit(spark, sf).collect()) == want
