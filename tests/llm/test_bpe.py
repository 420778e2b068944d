"""Token ids against the public tokenizer library."""

import random

import pytest

from gristmill.llm import bpe
from tests.conftest import same_rows

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_random_texts(reference):
    rng, enc = random.Random(5), bpe.encoder()
    letters = "ab \n\tcé漢😀<|endoftext|>0129__--==​́'ſ"
    for _ in range(800):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(90)))
        assert enc.encode(s).tolist() == reference(s)


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 20_000, "漢" * 9_000, " " * 30_000 + "x", "=" * 30_001, "<|endoftext|>" * 50])
def test_very_long_pretokens(reference, text):
    assert bpe.encoder().encode(text).tolist() == reference(text)


def test_queue_gives_least_rank_then_leftmost():
    q = bpe.RankQueue(70_000)
    rng = random.Random(1)
    items = [(rng.randrange(70_000), rng.randrange(100)) for _ in range(500)]
    for r, p in items:
        q.push(r, p)
    out = []
    while (x := q.pop()) is not None:
        out.append(x)
    assert out == sorted(items) and not q.top and not any(q.low) and not any(q.mid)


def test_rows_nulls_repeats_and_clashing_columns(spark, reference):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (3, "", "x"), (4, " \n\t ", "x"), (None, "é" * 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    same_rows(bpe.encode_documents(df).collect(), [(i, reference(t) if t else []) for i, t, _ in rows])
    same_rows(bpe.count_tokens(df).collect(), [(i, len(reference(t)) if t else 0) for i, t, _ in rows])
    assert bpe.encode_documents(df.where("false")).count() == 0
