import hashlib

from pyspark.sql import functions as F

from crosslane.llm import fingerprints as op

LONG = "\n\n".join("\n".join(f"Sentence {s} {p} has some words. And one more {p}!" for p in range(6)) for s in range(8))


def facts(spark, rows, schema="doc_id long, text string, text_hash string, n_chars string, next_root int"):
    frame = op.edit_with_next(spark.createDataFrame([(d, t, "", "", 0) for d, t in rows], schema))
    frame = op.add_fingerprint(op.add_fingerprint(frame, "text"), "edited", "edited_")
    near = op.likeness(F.col("root"), F.col("leaves"), F.col("edited_root"), F.col("edited_leaves"))
    nxt = op.likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves"))
    return frame.select("doc_id", "text", "n_chars", "edited", "fingerprint", near.alias("near"), nxt.alias("next")).collect()


def plain_edits(rows):
    ordered = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for k, (doc, text) in enumerate(ordered):
        q = len(text) // 4
        out[doc] = text[: len(text) - q] + ordered[(k + 1) % len(ordered)][1][:q]
    return out


def test_edited_texts(spark):
    rows = [(7, "seven words are in this text here."), (3, "x"), (5, ""), (1, None), (20, "ü漢🙂" * 9), (9, LONG), (11, LONG), (40, " \n\n "), (None, "null id")]
    rows += [(100 + k, f"document {k} " * (k + 1)) for k in range(60)]
    found = facts(spark, rows)
    edits = plain_edits(rows)
    assert {r.doc_id: r.edited for r in found} == edits and len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert by[9].fingerprint == by[11].fingerprint and by[9].next == 1.0
    assert 0.6 < by[9].near <= 1.0 and by[11].next < 0.1
    assert all(0 <= x <= 1 for r in found for x in (r.near, r.next))
    assert len({r.fingerprint for r in found}) == len({r.text for r in found})


def test_white_space_counts(spark):
    texts = ["a b", "a  b", "a b ", " a b", "a\nb", "a\n\nb", "a\n\n\nb", "a\n \nb", "", "\n", "\n\n", " ", "a. b", "a.b"]
    frame = op.add_fingerprint(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    assert frame.select("fingerprint").distinct().count() == len(texts)
    again = frame.select(F.transform(F.split("text", "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.regexp_extract_all(p, F.lit(op.LEAF), F.lit(0)))).alias("leaves"), "text")
    for r in again.collect():
        assert "\n\n".join("\n".join("".join(p) for p in s) for s in r.leaves) == r.text


def test_branches_locate_edits(spark):
    changed = LONG.replace("Sentence 3 4", "Sentence 3 four")
    a = op.add_fingerprint(spark.createDataFrame([(LONG, changed)], "text string, other string"), "text")
    row = op.add_fingerprint(a, "other", "other_").select(
        op.differing_paragraphs(F.col("paragraphs"), F.col("other_paragraphs")).alias("places"),
        F.filter(F.zip_with(op.section_digests(F.col("paragraphs")), op.section_digests(F.col("other_paragraphs")), lambda x, y: x != y), lambda d: d).alias("sections"),
    ).first()
    assert row.places == [3 * 6 + 4] and len(row.sections) == 1


def test_repeated_rows_and_small_tables(spark):
    rows = [(1, "same text here"), (1, "same text here"), (1, "another text"), (2, "last one of them")]
    found = facts(spark, rows)
    assert len(found) == 4
    assert len({r.edited for r in found if r.text == "same text here"}) == 1
    alone = facts(spark, [(5, "only one document")])
    assert alone[0].edited == "only one document"[:13] + "only" and alone[0].next == 1.0
    assert facts(spark, []) == []


def test_query(spark, sf, docs):
    edits = plain_edits([(r.doc_id, r.text) for r in docs.collect()])
    for r in op.op8_fingerprints(spark, sf).collect():
        assert r.edited_sha256 == hashlib.sha256(edits[r.doc_id].encode()).hexdigest()
