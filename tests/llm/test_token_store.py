"""Shards and their index against the tokenizers library, and keyed access."""

from __future__ import annotations

import random
import uuid
import zlib

import numpy as np
import pytest

from lattica.llm import token_store as T
from lattica.llm.common import shared_dir
from lattica.llm.queries import END_ID, WORD_MODEL, op11_token_store


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path(WORD_MODEL)


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def stored(spark, rows, vocabulary, schema="doc_id long, text string, shard long, key string, copy int", **bounds):
    at = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    docs = spark.createDataFrame([(*r, 1, "k", 7) for r in rows], schema)
    T.write(docs, f"{at}/shards", vocabulary, END_ID, **bounds)
    T.index(T.entries(spark, f"{at}/shards"), f"{at}/index", bucket_keys=50)
    return at


def ids_of(row):
    return np.frombuffer(bytes(row.ids), "<u4").tolist()


def test_query_equals_the_library(spark, smoke, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{smoke}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op11_token_store(spark, smoke).collect()}
    assert got.keys() == docs.keys()
    start = 0
    for i in sorted(docs):
        ids = [*library.encode(docs[i] or "", add_special_tokens=False).ids, END_ID]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_equal_whole_texts(vocabulary, library):
    rng = random.Random(4)
    m = T.WordIds(vocabulary)
    assert m.by_word
    letters = ["a", "E", "th", "É", "ñ", "'s", "'", "don't", ".", ",", "...", "!?", ";:", "́", " ", "  ", "\n", "\r\n", "\t", " ", " ", "\x1c", "0", "12", "ß", "中", "😀", "<|endoftext|>", "<|", "|>", "=", "̸", "ΑΣ", "İ", '."', "x.y", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert np.frombuffer(m.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    m.kept.clear()
    text = " ".join("".join(rng.choice("abcdeé.") for _ in range(rng.randrange(1, 60))) for _ in range(20_000))
    assert np.frombuffer(m.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_bound_on_kept_words_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(T, "KEPT", 5)
    m = T.WordIds(vocabulary)
    for text in ("one two three four five six", "six seven. eight nine ten", "one six two", ""):
        assert np.frombuffer(m.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


def test_edges(spark, vocabulary, library):
    """Null and empty texts, repeated ids and rows over several shards, null ids, negative ids, extra columns."""
    rows = [(5, "five"), (5, "five"), (5, None), (-3, "minus"), (None, "no id"), (None, None), (0, ""), (1 << 40, "long " * 3000)] + [(7, f"copy {i % 3}") for i in range(40)]
    at = stored(spark, rows, vocabulary, shard_bytes=300, shard_docs=6)
    found = T.entries(spark, f"{at}/shards").collect()
    assert len(found) == len(rows)
    assert sorted((r.key, r.copy) for r in found if r.key is not None) == sorted({(k, c): 1 for k in {r[0] for r in rows if r[0] is not None} for c in range(sum(x[0] == k for x in rows))})
    keys = spark.createDataFrame([(5,), (7,), (7,), (-3,), (0,), (1 << 40,), (99,), (None,)], "key long")
    got = T.fetch(spark, f"{at}/shards", T.lookup(spark, f"{at}/index", keys)).collect()
    assert len(got) == len(rows) - 2
    # the file's order: by id, then null ids; starts run on over all shards
    wanted = {}
    for k, t in rows:
        wanted.setdefault(k, []).append([*library.encode(t or "", add_special_tokens=False).ids, END_ID])
    for k, texts in wanted.items():
        if k is not None:
            assert sorted(ids_of(r) for r in got if r.key == k) == sorted(texts)
    everything = T.fetch(spark, f"{at}/shards", T.entries(spark, f"{at}/shards")).orderBy("start").collect()
    assert [r.start for r in everything] == np.concatenate([[0], np.cumsum([r.n for r in everything])[:-1]]).tolist()
    assert [r.key for r in everything] == sorted(k for k, _ in rows if k is not None) + [None, None]
    sizes = [r.n_docs for r in T.shards(spark, f"{at}/shards").collect()]
    assert max(sizes) <= 6 and sum(sizes) == len(rows)


def test_empty_table(spark, vocabulary):
    at = stored(spark, [], vocabulary)
    assert T.entries(spark, f"{at}/shards").count() == 0
    assert T.fetch(spark, f"{at}/shards", T.lookup(spark, f"{at}/index", spark.createDataFrame([(1,)], "key long"))).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (1, 2, 100, 30_000):
        h = T.key_hash(rng.choice(1 << 50, n, replace=False), np.zeros(n, np.int64))
        levels, number = T.perfect_hash(h)
        assert sorted(number.tolist()) == list(range(n))
        assert (T.numbers(h, levels) == number).all()
    assert sum(map(len, levels)) < 4.5 * n  # bits a key
    strange = T.key_hash(np.arange(1 << 51, (1 << 51) + 200_000), np.zeros(200_000, np.int64))
    at = T.numbers(strange, levels)
    held = np.empty(n, np.uint32)
    held[number] = T.prints(h)
    assert ((at >= 0) & (held[at] == T.prints(strange))).sum() <= 2


def test_files_hold_what_they_say(spark, vocabulary, library):
    at = stored(spark, [(2, "second text"), (1, "first")], vocabulary)
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(f"{at}/shards/part-*").orderBy("path").collect())
    ids = [library.encode(t, add_special_tokens=False).ids + [END_ID] for t in ("first", "second text")]
    assert raw.startswith(T.MAGIC)
    assert all(np.array(x, "<u2").tobytes() in raw for x in ids)
