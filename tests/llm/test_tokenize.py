import random

import numpy as np
import pytest

from netweave.llm import tokenize as t

TEXTS = [
    None, "", " ", "\n\n \t", "hello", "  hello   world  ", "aaaaaaaaaaaaaaaaaaa", "don't we'll I'VE", "<|endoftext|>", "Brückenwaage an der Straße", "Мост закрыт", "如果天气允许，新的统计", "👩🏽‍🔧 ok",
    "3.14159265358979", "‮gnirts‬", "x" * 5000, "ab" * 3000 + " " + "通行费" * 800, "\x07\x1b[0m", "á", "１００５５５",
]


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(t.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_another_implementation(spark, reference):
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in t.token_ids(df).collect()}
    assert got == {i: reference.encode_ordinary(x or "") for i, x in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in t.token_counts(df).collect()}
    assert counts == {i: len(v) for i, v in got.items()}


def test_random_words_and_repeated_pairs(reference):
    r = random.Random(4)
    merges = t.read_merges(t.VOCABULARY)
    words = ["".join(r.choice("abcdeaaa ñ的") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for word, ids in zip(words, t.encode_words([w.encode() for w in words], *merges)):
        # one word at a time: no split by the pattern
        assert ids.tolist() == reference._core_bpe.encode_single_piece(word.encode())


def test_ids_spell_the_text(reference):
    encode = t.encoder(*t.read_merges(t.VOCABULARY))
    for text, ids in zip(TEXTS, encode(TEXTS)):
        assert reference.decode(ids.tolist()) == (text or "")
    assert encode([]) == [] and isinstance(encode([None])[0], np.ndarray)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert t.token_ids(df).count() == 0
