import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import bpe
from trackloom.llm.common import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
LIBRARY = tokenizers.Tokenizer.from_file(tokenizer_path(bpe.VOCABULARY))
LIBRARY.no_truncation()
LIBRARY.no_padding()
CODER = bpe.Coder()


def agrees(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    got = CODER.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids
    assert CODER.decode(got) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    agrees(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="theinganr  \n'sé0!", max_size=200))
def test_text_of_frequent_letters(text):
    agrees(text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "a" * 3000, "ab" * 2000, "\x1c\x1d\x85\xa0x", "ՙ֐׿ࢠ", "漢字かな交じり", "I'll we've 'S"])
def test_hard_texts(text):
    agrees(text)


def test_pieces_against_plain_merging():
    r = random.Random(4)
    for _ in range(300):
        piece = bytes(r.choice(b"theinganr es") for _ in range(r.randint(1, 40)))
        parts = [next(i for i in range(256) if CODER.bytes_of[i] == bytes([b])) for b in piece]
        while True:
            best = min(((CODER.merged.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
            if best[0] == 1 << 40:
                break
            i = best[1]
            whole = CODER.bytes_of[parts[i]] + CODER.bytes_of[parts[i + 1]]
            parts[i : i + 2] = [CODER.bytes_of.index(whole)]
        assert np.frombuffer(CODER.encode_piece(piece), "<u4").tolist() == parts


def test_on_spark_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "The the", "x", 1), (1, "The the", "y", 2), (None, None, "z", 3), (2, "", "z", 3), (3, "word " * 40_000, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded_and_back(docs).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want and bpe.encoded_and_back(docs).count() == 5 and bpe.encoded_and_back(docs.limit(0)).count() == 0
