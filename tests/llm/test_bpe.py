import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crosslane.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(count, seed=5):
    rng = random.Random(seed)
    letters = "ab'sretTHé ßñ漢Σ\n\t 12.,!<|endoftext|>_ \u0085\x1c　🙂²½"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(count)]


def test_hard_texts(library, hard_text):
    ours = bpe.encoder(PATH)
    ids = library.encode(hard_text, add_special_tokens=False).ids
    assert ours.ids(hard_text).tolist() == ids
    decoded = library.decode(ids, skip_special_tokens=False)
    assert ours.decode(ids) == decoded
    assert ours.digests([hard_text]) == [
        (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    ]


@pytest.mark.parametrize("block", [bpe.BLOCK_CHARS, 16])
def test_random_texts(library, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    ours, texts = bpe.StreamEncoder(PATH), random_texts(800)
    for text, blocks in zip(texts, ours.ids_many(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.concatenate([np.zeros(0, "<u4"), *blocks]).tolist() == ids
        assert ours.ids(text).tolist() == ids


def test_transducer_needs_only_its_lookahead(library):
    rules, rng = bpe.encoder(PATH).rules, random.Random(2)
    assert 0 < rules.lookahead < 4096
    for letters in (b"abcdethinorsx", b"aA-=", b"a", b" \n", bytes(range(128, 256))):
        raw = bytes(rng.choice(letters) for _ in range(4000))
        parts = [raw[k : k + 37] for k in range(0, len(raw), 37)]
        assert list(rules.transduce(parts, block=16)) == rules.merge(raw)


def test_lookahead_is_needed_and_computed():
    # a b c: (b, c) first; (a, b) only where no c follows: one byte decides about two.
    rules = [(1, 2, 4), (0, 1, 3)]
    assert bpe.sufficient_lookahead(rules, {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}) == 2


def test_split_characters_decode(library):
    ids = library.encode("漢字🙂é", add_special_tokens=False).ids
    state = bpe.ByteToText(bpe.encoder(PATH).rules.bytes_of)
    assert "".join(state.feed(np.array([i], dtype=np.uint32)) for i in ids) + state.end() == "漢字🙂é"
    assert bpe.encoder(PATH).decode(ids[:1]) == library.decode(ids[:1], skip_special_tokens=False)


def test_frames(spark, frame, library):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "ü"), (4, "x" * 5000)]
    encoded = bpe.encode_documents(frame(rows), PATH)
    back = bpe.decode_documents(encoded, PATH)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert bpe.token_facts(frame([]), PATH).count() == 0
    checked = bpe.encode_and_check(frame(rows), PATH).collect()
    assert all(r.n_tokens == len(r.ids) for r in checked)
    assert {r.decoded_sha256 for r in checked if r.doc_id == 3} == {hashlib.sha256(b"a b").hexdigest()}


def test_query_matches_library(spark, sf, docs, library):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.op6_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
