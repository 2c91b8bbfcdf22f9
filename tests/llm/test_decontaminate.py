import plain
import pytest

from crosslane.llm import decontaminate as op

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "Short Item!"),
    (3, "x"),
    (4, ""),
    (5, None),
    (6, "ONE two three four five six seven eight nine ten"),
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (10, "äöü Ä ß 漢字 12 a b c d e f g"),
    (None, "nameless item of several words here"),
]
TEXTS = [
    None,
    "",
    "...",
    "zero one two three four five six seven eight nine ten eleven",
    "One, TWO; three-four five six seven eight nine ten eleven twelve one two",
    "a short item and another short item",
    "x y x",
    "pre äöü Ä ß 漢字 12 a b c d e f g post",
    "one two three four five six seven eight nine",
    "so a nameless item of several words here it is",
    "filler " * 5000 + "short item",
    "x" * 50_000,
]


def expected(rows):
    out = []
    for doc, text in rows:
        ws, places, names = plain.hits(text, ITEMS)
        listed = sorted(str(n) for n in names if n is not None)
        out.append((doc, len(ws), len(places), len(listed), plain.sha(",".join(listed)), bool(places)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_hits_match_plain_version(spark, frame, block_words):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, TEXTS[3])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = op.find_hits(frame(rows), bench, block_words=block_words).collect()
    got = []
    for r in found:
        n = sum(b - a for a, b in r.hit_spans)
        got.append((r.key, len(plain.words(bytes(r.raw).decode())), n, len(r.hit_items), plain.sha(",".join(r.hit_items)), n > 0))
    assert sorted(got, key=str) == expected(rows)


def test_documents_and_spans_are_removed(spark, frame):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = op.remove_contamination(frame(rows), bench)
    assert kept.columns == frame(rows).columns
    assert {r.doc_id for r in kept.collect()} == {doc for doc, *_, dirty in expected(rows) if not dirty}
    cut = {r.doc_id: r.text for r in op.remove_contamination(frame(rows), bench, mode="spans").collect()}
    assert len(cut) == len(rows) and cut[5] == "a " + " and another "
    assert cut[8] == TEXTS[8] and cut[0] is None
    with pytest.raises(ValueError):
        op.remove_contamination(frame(rows), bench, mode="other")


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.find_hits(frame([]), none).count() == 0
    assert op.remove_contamination(frame([(1, "a b")]), none).count() == 1
