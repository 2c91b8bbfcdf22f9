import plain

from crosslane.llm import line_dedup as op

BANNER = "Subscribe to our letter today"


def rows():
    out = []
    for k in range(40):
        body = f"Own sentence number {k} of the text.\nAnother own line {k}, long enough to stay here."
        out.append((k, f"{body}\n {BANNER}" if k % 2 else f"{BANNER}\n{body}", f"site{k % 8}"))
    out += [(100 + k, "four sites only here\n" + "own words " * (k + 3), f"site{k}") for k in range(4)]
    out += [(200 + k, "line on five sites\n" + "other words " * (k + 3), f"site{k}") for k in range(5)]
    out += [(300 + k, f"null counts as a site\nunique text of row {k} {k}", f"site{k}" if k else None) for k in range(5)]
    out += [(400 + k, "a whole page that is a copy\nwith a second line", f"site{k}") for k in range(9)]
    out += [(500 + k, "short\n" + f"body of document {k}", f"site{k}") for k in range(9)]
    out += [(600, None, "site1"), (601, "", "site2"), (602, "\n\n", "site3"), (603, (BANNER + "\n") * 3 + "own " * 50, "site1")]
    out += [(1, out[1][1], "site1"), (None, out[3][1], "site3"), (700, "x" * 100_000, "site4")]
    out += [(800 + k, "one site repeats this line\nown text here " * 2, "site0") for k in range(60)]
    return out


def test_matches_plain_version(spark, frame):
    data = rows()
    marked = op.mark_boilerplate(frame(data)).collect()
    got = sorted(((r.whole.doc_id, r.n_boilerplate, r.n_removed, r.clean_text) for r in marked), key=str)
    cleaned = plain.clean_lines([(s, t) for _, t, s in data])
    assert got == sorted(((d, *c) for (d, _, _), c in zip(data, cleaned, strict=True)), key=str)
    counts = {r.whole.doc_id: r.n_lines for r in marked}
    assert (counts[600], counts[601], counts[602]) == (0, 1, 3)


def test_sketch_decides_far_lines(spark, frame):
    data = [(k, f"wide line of many sites\nown text of document {k}, long enough to stay", f"s{k}") for k in range(300)]
    found, _ = op.boilerplate_lines(op.lines_of(frame(data), "doc_id", "source", "text"))
    assert found.count() == 1


def test_rows_and_columns_stay(spark, frame):
    data = frame(rows())
    out = op.remove_boilerplate(data)
    assert out.columns == data.columns and out.count() == data.count()
    assert op.remove_boilerplate(frame([])).count() == 0


def test_mostly_shared_lines_go_and_copies_stay(spark, frame):
    """Without a share limit: shared lines leave short pages, null and repeated rows too; copies of a page keep their lines."""
    nav = "Home and products and prices and help and contact\n" + "A long footer that all the shops of this chain show below their pages. " * 3
    own = {k: " ".join(f"own{k}word{n}" for n in range(18)) for k in range(7)}
    page = [f"line {n} of a page that was copied, " + " ".join(f"w{n}x{m}" for m in range(12)) for n in range(30)]
    rows = [(k, f"{nav}\n{own[k]}", f"site{k}") for k in own]
    rows += [(100 + k, "\n".join(page), f"site{k}") for k in range(8)]
    # Near copies: other words in one line each, at another place.
    rows += [(200 + k, "\n".join(x + " edited" * (n == 3 * k) for n, x in enumerate(page)), f"site{k}") for k in range(8)]
    rows += [(300, nav, "site1"), (301, None, "site2"), (302, nav + "\n" + own[0], None), (303, "", "site3"), (0, rows[0][1], "site0")]
    marked = op.mark_boilerplate(frame(rows), max_share=None).collect()
    clean = sorted(((r.whole.doc_id, r.clean_text) for r in marked), key=str)
    want = {d: own[d] if d < 100 else t for d, t, _ in rows} | {300: "", 302: own[0]}
    assert clean == sorted(((d, want[d]) for d, _, _ in rows), key=str)
    assert {r.n_removed for r in marked if r.whole.doc_id < 100} == {2}
    assert op.remove_boilerplate(frame([]), max_share=None).count() == 0
    left = op.mark_boilerplate(frame(rows)).where("whole.doc_id < 100 and n_removed = 0").count()
    assert left == 8


def test_shingles_are_those_of_near_duplicates(frame):
    texts = ["", "  \n", "one", "One two  THREE", "a b c d e f a b c d e f g", "\u00c9 \u00e9 x\x0by z\tq \u00a0 w"]
    found = frame([(k, t) for k, t in enumerate(texts)]).select("doc_id", op.shingles(op.F.col("text")).alias("s")).collect()
    assert {r.doc_id: len(r.s) for r in found} == {k: len(plain.shingles(t, 5)) for k, t in enumerate(texts)}
