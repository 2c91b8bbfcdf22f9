import corpus_pipeline
import plain
from pyspark.sql import functions as F

from crosslane.llm.common import scratch

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(((r.doc_id, r.text, r.source) for r in frame.collect()), key=str)


def test_every_stage_matches_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        docs, _ = scratch(stage(spark, docs, SF), "pipeline-test")
        made[name] = docs
        if name != "encoding":
            assert docs.columns == columns
            after = rows_of(docs)
        if name == "toxicity":
            gone = {r[0] for r in before} - {r[0] for r in after}
            clean = [d for d, y in labels.items() if y == 0]
            assert len(gone & set(clean)) <= 0.05 * len(clean) and set(after) <= set(before)
        if name == "line_dedup":
            cleaned = plain.clean_lines([(s, t) for _, t, s in before])
            assert after == sorted(((d, c[2], s) for (d, _, s), c in zip(before, cleaned, strict=True)), key=str)
        if name == "near_dedup":
            roots = plain.linked_components([(d, t) for d, t, _ in before], 5)
            assert [r[0] for r in after] == [r[0] for r in before if roots[r[0]] == r[0]]
        if name == "decontamination":
            assert [r[0] for r in after] == [r[0] for r in before if not plain.hits(r[1], bench)[1]]
    encoded = made["encoding"].collect()
    assert {r.doc_id: r.decoded_sha256 for r in encoded} == {r[0]: plain.sha(r[1]) for r in rows_of(made["decontamination"])}
    whole = corpus_pipeline.run(spark, SF)
    key = F.struct(*sorted(whole.columns))
    assert sorted(map(str, whole.select(key).collect())) == sorted(map(str, made["encoding"].select(key).collect()))


def test_stages_take_hard_rows(spark):
    extra = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 30_000, None, None, -1), (3, " \n\n ", "de", "s", 4)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for docs in (extra, extra.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs, _ = scratch(stage(spark, docs, SF), "pipeline-test")
        assert docs.count() == (4 if docs is not None and docs.count() else 0)
