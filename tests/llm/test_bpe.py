import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skein.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = bpe.Codec(PATH, leaf_chars=7)
REFERENCE = Tokenizer.from_file(PATH)
PIECES = ["a", "b", "é", " ", "  ", "\n", "'", "'re", "'s", "ll", "日本", "1", "23", "!!", "🙂", "the ", "ing", "<|endoftext|>", "<|endof", "\t", "###", "　"]


def agrees(text):
    want = REFERENCE.encode(text, add_special_tokens=False).ids
    got = SMALL.encode(text)
    return got.tolist() == want and SMALL.decode(got) == REFERENCE.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120).map("".join))
def test_tree_equals_whole_on_pieces(text):
    assert agrees(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_tree_equals_whole_on_any_text(text):
    assert agrees(text)


def test_unsplit_texts():
    r = random.Random(5)
    for alphabet in ("ab", "a", " ", "🙂", "é!", "01"):
        assert agrees("".join(r.choice(alphabet) for _ in range(1500)))


def test_every_code_point_splits_alike():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b {chr(c)}1" for c in points[at : at + 20_000 : 7]]
        assert [e.ids for e in REFERENCE.encode_batch_fast(texts, add_special_tokens=False)] == [SMALL.direct(t).tolist() for t in texts]


def test_round_trip_rows(edge, edge_rows, no_rows):
    got = sorted(tuple(r) for r in bpe.round_trip(edge, leaf_chars=64).na.fill(-1).collect())
    want = []
    for i, t, *_ in edge_rows:
        ids = REFERENCE.encode(t or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(REFERENCE.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(no_rows).count() == 0


def test_columns(spark):
    df = spark.createDataFrame([("hello world",), (None,)], "t string")
    ids = df.select(bpe.encode(df.t).alias("ids"))
    assert [r[0] for r in ids.select(bpe.decode(ids.ids)).collect()] == ["hello world", ""]
