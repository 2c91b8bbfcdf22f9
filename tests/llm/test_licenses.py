import random

import plain
import pytest

from crosslane.llm import licenses as op
from crosslane.llm.license_texts import NOTICES, PHRASES


def places(text):
    ws, out = plain.words(text), []
    for label, phrase in PHRASES:
        ps = phrase.split()
        out += [(k, label) for k in range(len(ws) - len(ps) + 1) if ws[k : k + len(ps)] == ps]
    return ws, out


def rows():
    rng = random.Random(6)
    common = "the of this license mit apache general public permission software is a copy".split()
    texts = [" ".join(rng.choice(common) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    texts += [f"code before. {n} code after" for _, n in NOTICES]
    texts += [None, "", "...", "MIT-LICENSE mit License", "apache\nlicense, general public license general public license", "x" * 50_000]
    texts += ["mit license " * 3000, "é mit license é", "mit licenses", "permission is hereby granted"]
    return list(enumerate(texts)) + [(3, texts[3]), (None, "mit license")]


def test_phrase_places_match_plain_version(spark, frame):
    data = rows()
    got, want = [], []
    for r in op.scan_licenses(frame(data)).collect():
        got.append((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) - {""} and 0 <= r.score <= 1
    for doc, text in data:
        ws, found = places(text)
        starts = [k for k, _ in found]
        labels = ",".join(sorted({label for _, label in found}))
        want.append((doc, len(ws), len(found), min(starts, default=None), max(starts, default=None), labels))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_matching_statistics_match_plain_version():
    automaton, rng = op.LicenseAutomaton(), random.Random(2)
    notices = [plain.words(n) for _, n in NOTICES] + [p.split() for _, p in PHRASES]
    joined = {tuple(n[a:b]) for n in notices for a in range(len(n)) for b in range(a + 1, min(len(n), a + 25) + 1)}
    for _ in range(200):
        ws = []
        while len(ws) < 40:
            n = rng.choice(notices)
            a = rng.randrange(len(n))
            ws += n[a : a + rng.randrange(1, 12)]
        matches, _ = automaton.scan([w.encode() for w in ws])
        longest = []
        for end in range(1, len(ws) + 1):
            longest.append(max((end - a for a in range(max(0, end - 24), end) if tuple(ws[a:end]) in joined), default=0))
        ends = [k + 1 for k in range(len(ws)) if longest[k] >= op.MIN_MATCH and (k + 1 == len(ws) or longest[k + 1] <= longest[k])]
        assert [(e, n) for e, n, _ in matches] == [(e, longest[e - 1]) for e in ends]


@pytest.mark.parametrize("label,text", NOTICES)
def test_notices_are_covered(label, text):
    automaton = op.LicenseAutomaton()
    ws = plain.words(text)
    changed = ["before"] * 5 + [w if k % 25 != 12 else "changed" for k, w in enumerate(ws)] + ["after"] * 5
    for words in (["before"] * 5 + ws + ["after"] * 5, changed):
        spans = automaton.spans(automaton.scan([w.encode() for w in words])[0])
        assert any(s[0] == label and s[1] >= 5 and s[2] <= len(words) - 5 for s in spans)


def test_empty_table(spark, frame):
    assert op.scan_licenses(frame([])).count() == 0
