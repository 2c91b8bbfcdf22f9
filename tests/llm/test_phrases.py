import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from crosslane.llm import phrases as op

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces_of(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def all_counts(rows):
    f = {}
    for _, text, lang in rows:
        here = f.setdefault("und" if lang is None else lang, Counter())
        for ws in pieces_of(text):
            for k in (1, 2, 3):
                here.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f


def expected(rows, top=2000, min_count=10, share=50):
    out = []
    for lang, f in all_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: c for p, c in f.items() if len(p) > 1 and c >= min_count}
        found = []
        for p, a in good.items():
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            around = [c for q, c in good.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if not any(100 * c >= share * a for c in around):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def make(spark, rows):
    full = [(*r, 5, "x", 1, 2) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, n long, phrase string, rank int, k int")


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


def rows_with_all_sorts():
    rows = [(k, f"New York City is big, {'é' * (k % 3)} the new  york\tpost; item {k % 7} of many", "en") for k in range(25)]
    rows += [(k, "alpha beta gamma. alpha beta gamma! Alpha beta\x0bgamma alpha beta gamma", ["de", None][k % 2]) for k in range(12)]
    rows += [(None, None, None), (None, "", "en"), (7, "same words " * 40, "fr"), (7, "same words " * 40, "fr")]
    rows += [(8, "a a a a a a a a a a a a a", "es"), (9, "rare pair", "it"), (10, "x\x00y \x01z " * 15, "und"), (11, " \t .,;", "nl")]
    rows += [(12, "ümlaut 漢字 🙂 " * 20 + "w" * 5000, "en"), (13, "ümlaut 漢字 🙂 " * 20, "")]
    return rows


@pytest.mark.parametrize(("sample_of", "slice_bytes"), [(1, 4_000_000), (3, 40), (1_000_003, 7), (2, 200)])
def test_collocations_match_plain_version(spark, sample_of, slice_bytes):
    rows = rows_with_all_sorts()
    df = make(spark, rows).repartition(3)
    assert got(op.collocations(df, sample_of=sample_of, slice_bytes=slice_bytes)) == expected(rows)
    if slice_bytes == 40:
        assert got(op.collocations(df, top=3, min_count=2, share=101)) == expected(rows, 3, 2, 101)


def test_border_failures_open_further_passes(spark):
    rows = rows_with_all_sorts()
    whole, found_whole = op.frequent_phrases(make(spark, rows), sample_of=1)
    none, found_none = op.frequent_phrases(make(spark, rows), sample_of=1_000_003)
    assert len(found_whole) == 1 and len(found_none) == 3 and all(found_none)
    want = sorted(
        (lang, len(p), " ".join(p), c) for lang, f in all_counts(rows).items() for p, c in f.items() if c >= 10
    )
    for counts in (whole, none):
        assert sorted(map(tuple, counts.where("k > 0").collect())) == want
    totals = {lang: sum(c for p, c in f.items() if len(p) == 1) for lang, f in all_counts(rows).items()}
    assert {r.lang: r.n for r in none.where("k = 0").collect()} == {k: v for k, v in totals.items() if v}


def test_full_filter_only_costs_work(spark, monkeypatch):
    monkeypatch.setattr(op, "MOST_BITS", 1 << 16)
    members = spark.range(200_000).selectExpr("'en' AS lang", "cast(id AS string) AS phrase")
    field = op.build_filter(op.hashed(members))
    assert len(field.field) * 64 == 1 << 16
    assert field.holds(op.word_hashes("en", [str(n) for n in range(0, 200_000, 997)])).all()
    monkeypatch.undo()
    loose = op.build_filter(op.hashed(members))
    assert loose.holds(op.word_hashes("en", [str(n) for n in range(200_000)])).all()
    assert loose.holds(op.word_hashes("de", [str(n) for n in range(200_000)])).mean() < 0.05


def test_phrase_hashes_are_those_of_the_passes(spark):
    words = ["a", "b", "é", "a"]
    ids = b"".join(int(i).to_bytes(4, "little", signed=True) for i in (-1, 1, 2, 0))
    row = op.Row("en", 0, pa.array(words[:3]), op.word_hashes("en", words[:3]).tobytes(), ids)
    phrases = spark.createDataFrame([("en", "a b"), ("en", "b é"), ("en", "é a"), ("en", "a b é"), ("en", "b é a")], "lang string, phrase string")
    want = [*row.pair_hash.view("int64").tolist(), *row.triple_hash.view("int64").tolist()]
    assert sorted(r.h for r in op.hashed(phrases).collect()) == sorted(want)


@pytest.mark.parametrize("slice_bytes", [1, 5, 11, 64, 10_000])
def test_slices_hold_every_phrase_once(slice_bytes):
    text = "one two  three.four five\tsix seven, " * 9 + " " * 30 + "eight nine " + "x" * 50 + " ten" + " " * 40
    found = Counter()
    for lead, words, ids in op.encoded(text.encode(), slice_bytes):
        row = op.Row("en", lead, words, op.word_hashes("en", words.to_pylist()).tobytes(), ids)
        for batches in (row.single_counts(), row.phrase_counts(row.joined, 2), row.phrase_counts(row.joined[:-1] & row.joined[1:], 3)):
            for batch in batches:
                for k, phrase, n in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    found[k, phrase] += n
    f = all_counts([(1, text, "en")])["en"]
    want = Counter({(len(p), " ".join(p)): c for p, c in f.items()})
    want[0, ""] = sum(c for p, c in f.items() if len(p) == 1)
    assert found == want


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000_000
    df = spark.createDataFrame([(big, 2 * big, big + 7)], "a long, l long, r long")
    assert df.select(op.cut_score("a", "l", "r")).first()[0] == 1000000 * big * big // (2 * big * (big + 7))


def test_empty_tables(spark):
    assert op.collocations(make(spark, [])).count() == 0
    assert op.collocations(make(spark, [(1, None, None), (2, "", "en"), (3, "one two", "en")])).count() == 0


def test_query_matches_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got(op.op11_phrases(spark, sf)) == sorted(con.sql(op.OP11_SQL).fetchall())
