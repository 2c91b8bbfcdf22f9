import hashlib

from crosslane.llm import warc
from crosslane.session import fresh_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def run(spark, rows, **sizes):
    folder = fresh_path(spark, "warc-test")
    index = warc.write_bundles(pages(spark, rows), folder, **sizes).cache()
    return index, sorted(map(tuple, warc.read_bundles(index).collect()), key=str)


def plain(rows):
    first = {}
    for page, _, html in rows:
        if html is not None and len(html.encode()) >= 100 and page is not None:
            first[html] = min(first.get(html, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = first.get(html) if len(raw) >= 100 else None
        refers = None if refers == page else refers
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip_of_hard_pages(spark):
    big = "<p>" + "ü" * 200 + "</p>"
    rows = [(k, f"http://x/{k}", f"<p>{k}</p>") for k in range(30)]
    rows += [(100 + k, "u\r\nWARC-Type: fake", big) for k in range(50)]
    rows += [(200, None, None), (201, "", ""), (202, "u", "x" * 99), (203, "u", "x" * 99), (204, "u", "x" * 100), (205, "u", "x" * 100)]
    rows += [(None, "n", big), (7, "again", "<p>7</p>"), (100, "again", big), (300, "u", "WARC/1.1\r\n\r\n" * 40), (301, "u", "y" * 300_000)]
    for sizes in ({}, {"frame_bytes": 500, "bundle_bytes": 800}):
        index, found = run(spark, rows, **sizes)
        assert found == plain(rows)
        assert index.count() == len(rows)


def test_frames_are_independent_and_seekable(spark):
    rows = [(k, "u", f"{k} " * 400) for k in range(60)]
    index, _ = run(spark, rows, frame_bytes=4000)
    assert index.select("bundle", "frame").distinct().count() > 10
    raw = warc.read_record(index, 17)
    headers, block, end = warc.parse_record(raw, 0)
    assert end == len(raw) and headers["X-Page-Id"] == "17" and block.endswith(("17 " * 400).encode())
    assert warc.read_record(index, 999) is None


def test_empty_table(spark):
    index, found = run(spark, [])
    assert found == [] and index.count() == 0
