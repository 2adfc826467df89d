import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_rows import documents, empty, odd_rows
from tokenizers import Tokenizer

from lorespan.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a", " a", "a ", "\na\n", "a  b \n\n c's don't", "x y é́", "<|endoftext|> a", "12ab,, 'll \n", "a\n b", "a \nb", "ñ'é, ,,a 3.5% ok.\n- x", "word,%%% w&&&\n\tTab", "日本 語。x", "😀 a😀.\r\nb", "it's,they're;we'LL", "Ünï__çode--x (a) [b]{c}"]


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    encoder, plain = token_files.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for text in [*ODD, *(t for _, t, _ in odd_rows() if t is not None and len(t) < 5000)]:
        assert np.frombuffer(encoder.encode(text), dtype=encoder.kind).tolist() == whole(plain, text), text


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    encoder, plain = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    text = "many different words that are more than three, twice: many different words"
    assert np.frombuffer(encoder.encode(text), dtype=encoder.kind).tolist() == whole(plain, text)
    assert len(encoder.spaced) <= 3


def test_files_read_back_in_the_order_of_ids(spark):
    rows = odd_rows() + [(600 + n, t, "s0") for n, t in enumerate(ODD)]
    plain = Tokenizer.from_file(PATH)
    files = token_files.write_tokens(documents(spark, rows), PATH)
    found = sorted((tuple(r) for r in files.read().collect()), key=lambda r: r[1])
    ids = [r[0] for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    start = 0
    for _, at, n, _ in found:
        assert at == start
        start += n
    want = sorted((repr(i), len(x := [*whole(plain, t), 0]), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, t, _ in rows)
    assert sorted((repr(i), n, crc) for i, _, n, crc in found) == want
    assert files.bits == 16


def test_empty_table(spark):
    assert token_files.write_tokens(empty(spark), PATH).read().collect() == []


def test_texts_encoded_together_share_lookups():
    rng = random.Random(1)
    texts = ["", None, " ", "\n", "a", "a\n", "\na", " a", "a ", "a b\nc d ", "\n\n", "a  b", "é\nü. x", "\t", "a \nb", "日本 語\nx", "it's\nit's"]
    texts += ["".join(rng.choices("ab é,.'1 \n\x1f", k=rng.randint(0, 12))) for _ in range(500)]
    words = token_files.Encoder(PATH, remembered=0)
    assert words.encode_all(texts) == [words.encode(t) for t in texts]
    assert words.encode_all([]) == [] and words.encode_all([None]) == [b""]
    asked, units = [], words.spaced.units
    words.spaced.units = lambda piece: asked.append(piece) or units(piece)
    words.encode_all(["x unheard word", "y unheard of"] * 50)
    assert len(asked) == 3
