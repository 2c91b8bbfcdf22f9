import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from crosslane.llm import token_files as op
from crosslane.session import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(rows):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [op.END_ID]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_hard_texts(hard_text):
    ids = Tokenizer.from_file(PATH).encode(hard_text, add_special_tokens=False).ids
    assert np.frombuffer(op.encoder(PATH).encode(hard_text), "<u2").tolist() == ids


def test_random_texts():
    rng, library = random.Random(4), Tokenizer.from_file(PATH)
    letters = "ab'sretTHé ßñ漢Σσİ\n\t 12.,!<|endoftext|>_ \u0085\x1c　🙂́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(800)]
    for text, packed in zip(texts, op.encoder(PATH).encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_at_letters_that_combine_or_change_case():
    rng, library = random.Random(8), Tokenizer.from_file(PATH)
    parts = ["H", "\u0331", "I", "\u0307", "\u0130", "\u0131", "É", "é", "E\u0301", "ß", "ẞ", "×", "÷", "ª", "µ", "²", "ŉ", "ǅ", "ȿ", "ɐ", "Ⱥ", "K"]
    parts += ["Σ", "a", "Z", "9", "'S", "'", ".", ",!", "$", "#*", "<|", "<|endoftext|>", "|>", " ", " ", "\n", "\u00a0", "\u0378", "漢", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", " ", ".", "\n", *parts]
    for text, packed in zip(texts, op.encoder(PATH).encode_many(texts), strict=True):
        assert np.frombuffer(packed, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text
    for text in texts[-60:]:
        assert np.frombuffer(op.ChunkEncoder(PATH).encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


class Counting:
    """The tokenizer, counting the texts it gets."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_words_share_calls_of_the_library():
    rng, library = random.Random(2), Tokenizer.from_file(PATH)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 14))) for _ in range(5000)]
    text = " ".join(rng.choice([str.title, str.lower, str.upper])(w) + rng.choice(["", "", ".", ",", "?!"]) for w in words)
    small = op.ChunkEncoder(PATH)
    small.tokenizer = Counting(small.tokenizer)
    assert np.frombuffer(small.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids
    assert small.tokenizer.texts < 300


def test_words_without_closing_ids_go_one_by_one():
    text = "The cat's é hats, and 12 H\u0331 more words."
    plain_ids, odd = op.encoder(PATH).encode(text), op.ChunkEncoder(PATH)
    odd.closes[:] = False
    assert odd.encode(text) == plain_ids


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(op, "MEMO_CHUNKS", 5)
    small = op.ChunkEncoder(PATH)
    texts = [f"w{k} v{k % 7} the x{k}." for k in range(200)]
    assert [small.encode(t) for t in texts] == [op.encoder(PATH).encode(t) for t in texts]
    assert len(small.chunks.young) <= 5


def test_files(spark, frame):
    rows = [(9, "nine"), (None, "no id"), (3, "three words here"), (1, None), (5, ""), (4, "The Cat's 12 " * 500), (2, "<|endoftext|>")]
    rows += [(100 + k, f"doc {k}") for k in range(40)]
    folder = fresh_path(spark, "token-test")
    parts = op.write_token_files(frame(rows), folder, PATH)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    found = op.read_token_files(spark, folder, parts).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == plain(ordered)
    assert [p[3] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(len(parts))]


def test_repeated_ids_and_empty_table(spark, frame):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d"), (0, "z")]
    folder = fresh_path(spark, "token-test")
    found = op.read_token_files(spark, folder, op.write_token_files(frame(rows), folder, PATH)).collect()
    assert len(found) == 4 and [r.doc_id for r in sorted(found, key=lambda r: r.start)] == [0, 1, 1, 1]
    empty = fresh_path(spark, "token-test")
    assert op.read_token_files(spark, empty, op.write_token_files(frame([]), empty, PATH)).count() == 0


def test_query_matches_library(spark, sf, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, op.op7_token_files(spark, sf).collect())) == plain(rows)
