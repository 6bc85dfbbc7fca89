"""Ids and decoded texts against the library, on odd, random and long texts."""

from __future__ import annotations

import random

import pytest

from lattica.llm import sentencepiece_bpe as B
from lattica.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(PIECE_MODEL)
    return B.model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def same(both, text):
    mine, library = both
    ids = mine.encode(text)
    assert ids == library.encode(text) and mine.decode(ids) == library.decode(ids), repr(text[:80])


def test_runs_of_spaces(both):
    for n in [*range(1, 130), 777, 5000]:
        for a, b in (("", ""), ("a", "the"), ("\n", "\n"), ("é", "▁")):
            same(both, a + " " * n + b)


def test_random_texts(both):
    rng = random.Random(2)
    letters = ["a", "e", "th", "ing", "▁", " ", "  ", "\n", "\t", "0", "é", "ß", "中", "😀", "́", "�", "_", "==", "http://", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "​"]
    for _ in range(3000):
        same(both, "".join(rng.choice(letters) for _ in range(rng.randrange(40))))


def test_long_texts(both):
    rng = random.Random(3)
    same(both, "x" * 20_000)
    same(both, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12))) for _ in range(40_000)))
    same(both, "".join(rng.choice("aeinrst") for _ in range(30_000)))


def test_unbroken_parts_take_time_in_proportion(both):
    """A text without spaces or line ends, 640,000 characters: under 16 times what 80,000 take."""
    import time

    mine, library = both
    for unit in ("ab", "the中"):
        took = []
        for n in (80_000, 640_000):
            text = unit * (n // len(unit))
            mine.encode(text[:1000])
            began = time.process_time()
            ids = mine.encode(text)
            took.append(time.process_time() - began)
            assert mine.decode(ids) == text
        assert took[1] < 16 * max(took[0], 0.02)
        assert ids == library.encode(text)


def test_clashing_columns_are_replaced(spark):
    from lattica.llm.queries import encoded

    rows = spark.createDataFrame([(1, "a b", 9, "x", "y", "z", 5.0)], "doc_id long, text string, n_tokens long, IDS_sha256 string, _e string, _r string, `a.b` double")
    got = encoded(rows)
    assert sorted(got.columns) == sorted(["doc_id", "text", "_e", "_r", "a.b", "n_tokens", "ids_sha256", "decoded_sha256"])
    x = got.select("n_tokens", "_e", "`a.b`").first()
    assert (x[1], x[2]) == ("y", 5.0) and x[0] == len(both_ids("a b"))


def both_ids(text):
    import public_tokenizers

    return B.model(public_tokenizers.path(PIECE_MODEL)).encode(text)
