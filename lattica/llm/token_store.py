"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

A shard is one file: a header, the keys of its documents, the running number of
ids at each document's end, and then the raw ids, in two bytes each where the
vocabulary allows it and in four otherwise, little-endian throughout:

    IDSHARD1 | item bytes u32 | documents without a key u32 | shard u64 | documents u64 | ids u64
    keys i64[documents] | ends u64[documents] | ids[ids]

:func:`write` orders documents by key over all shards (those of one key by a hash
of their text, those without a key last) and bounds shards by bytes and documents;
only a document that is larger by itself makes a larger one.  Shards are written
by Spark's own writer, so a lost task writes its shards anew and none stays behind.

:func:`index` maps each key to its shard and the place in it.  Keys are dealt to
buckets by hash; each bucket's keys get the numbers 0 .. n-1 by a cascade of bit
arrays (a key is placed at the first level where no other key of the bucket meets
it), and fingerprint, shard, first id and length stand at that number.  A lookup
is a hash or two, a count of bits and one comparison; a key that is not stored is
taken for another with a chance of 2**-32.  Of documents that share a key, number
``c`` (from 0) is stored under (key, c), and the first tells how many there are.

:func:`lookup` and :func:`fetch` go from keys to addresses and from addresses to
ids: fetching opens only the shards that are asked for, and reads neighbours at once.

Null and empty texts have no ids but the end id.  Documents without a key have no
address; :func:`entries` lists them, and :func:`fetch` reads them from there.
Repeated rows are documents of their own.  Texts of any length are encoded whole.
An empty table makes no shard and an empty index.  Other columns are not read.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, small
from .textvec import mix64

MAGIC, HEAD = b"IDSHARD1", "<8sIIQQQ"
HEAD_BYTES = struct.calcsize(HEAD)
#: Shards of a task: its number times this, and on.
PER_TASK = 1 << 20
#: Words whose ids a worker keeps at most, in each of two generations, and the longest kept, in characters.
KEPT, LONGEST = 450_000, 40
#: Bytes that are read at once, about.
READ = 4 << 20
#: Places that each level of the hash offers for a key that comes to it.
ROOM = 2.0

_LATIN = "a-zA-ZÀ-ÖØ-öø-ÿ"
_PLAIN, _BEFORE_STOP = re.compile(f"[{_LATIN}]+"), re.compile(f"(?<=[{_LATIN}])(?=[.,;:!?])")


class WordIds:
    """A word-end tokenizer's ids of whole texts, encoded word by word.

    Its rules never look past white space, nor from a letter to a full stop or
    the like after it, so texts are cut there, and the library encodes each new part
    once; plain Latin words go to its model itself, as its normal form of them is
    known.  A worker keeps the ids of the last ``KEPT`` parts it met, and those of as
    many before them; a part that is met again moves up.  ``by_word`` tells that the
    vocabulary's file has these rules; texts of others are encoded at once.
    """

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        mark, steps = rules["model"].get("end_of_word_suffix"), rules.get("pre_tokenizer") or {}
        cut_first = [p.get("behavior") for p in steps.get("pretokenizers", [])][:1] == ["Removed"]
        self.by_word = bool(mark) and cut_first and not rules.get("post_processor") and not any(c in t["content"] for t in rules.get("added_tokens", []) for c in " .,;:!?\t\n\r")
        self.size = self.tokenizer.get_vocab_size()
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        letters = [c for c in map(chr, range(256)) if _PLAIN.fullmatch(c)]
        bytes_as = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {ord(c): bytes_as.pre_tokenize_str(c)[0][0] for c in letters if ord(c) > 127}
        self.model = self.tokenizer.model
        probe = ["".join(letters), *letters, *(a + b for a in "aEñÉ" for b in letters)]
        whole = self.tokenizer.encode_batch(probe, add_special_tokens=False)
        self.direct = all(self._plain(w) == np.array(e.ids, np.uint32).tobytes() for w, e in zip(probe, whole, strict=True))

    def _plain(self, word: str) -> bytes:
        word = word.lower()
        if not word.isascii():  # the others' bytes are shown as they are
            word = word.translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put the ids of ``words`` among those kept."""
        kept, older, parts, wanted = self.kept, self.older, [], []
        for w in words:
            if (ids := older.get(w)) is not None:
                kept[w] = ids
            elif w.isalpha():
                wanted.append(w)
            elif len(ps := _BEFORE_STOP.split(w)) > 1:
                parts.append((w, ps))
            else:
                wanted.append(w)
        if parts:
            inner = {p for _, ps in parts for p in ps if p not in kept}
            wanted = list(inner.union(wanted))
        other = []
        for p in wanted:
            if self.direct and _PLAIN.fullmatch(p):
                kept[p] = self._plain(p)
            else:
                other.append(p)
        for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            kept[p] = np.array(e.ids, np.uint32).tobytes()
        for w, ps in parts:
            kept[w] = b"".join([kept[p] for p in ps])

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if new := set(words).difference(self.kept):
            if len(self.kept) + len(new) > KEPT:
                self.older, self.kept = self.kept, {"": b""}
                new = set(words)
            self._learn(new)
            out = b"".join(map(self.kept.__getitem__, words))
            for w in new:
                if len(w) > LONGEST:
                    del self.kept[w]
            return out
        return b"".join(map(self.kept.__getitem__, words))


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def pack(shard: int, keys: list[int | None], ids: list[np.ndarray], item: int) -> bytes:
    """One shard's bytes; keys that are null stand last."""
    null = sum(k is None for k in keys)
    ends = np.cumsum([len(x) for x in ids], dtype="<u8")
    own = np.array([0 if k is None else k for k in keys], "<i8")
    head = struct.pack(HEAD, MAGIC, item, null, shard, len(keys), int(ends[-1]) if len(ends) else 0)
    return b"".join([head, own.tobytes(), ends.tobytes(), *(x.astype(f"<u{item}").tobytes() for x in ids)])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = 16 << 20, shard_docs: int = 1 << 16) -> None:
    """Encode ``text``, append ``end_id``, and write shards under ``path``, in ascending order of ``key``.

    ``tokenizer`` is the path of the vocabulary's file on every machine.
    """
    order = [F.col("key").asc_nulls_last(), F.col("h").asc()]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    # rows that are wholly alike are told apart by their place, so that no range is too full
    rows = rows.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order).select("key", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = encoder(tokenizer)
        item = 2 if max(m.size, end_id + 1) <= 1 << 16 else 4
        tail = np.array([end_id], np.uint32)
        first, n = TaskContext.get().partitionId() * PER_TASK, 0
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            nonlocal n
            data = pack(first + n, keys, ids, item)
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for part in parts:
            for k, t in zip(part["key"].to_pylist(), part["text"], strict=True):
                own = np.concatenate([np.frombuffer(m.encode(t.as_py()), np.uint32), tail])
                size = own.size * item + 16
                if keys and (held + size > shard_bytes or len(keys) >= shard_docs):
                    yield full()
                    keys, ids, held = [], [], 0
                keys.append(k)
                ids.append(own if item == 4 else own.astype(np.uint16))
                held += size
        if keys:
            yield full()

    shards = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))  # bytes as they are
    shards.write.option("maxRecordsPerFile", 1).text(path)


def _opened(path: str):
    """The file at ``path`` (a URI or a local path), for reads anywhere in it."""
    from pyarrow import fs

    where, name = (fs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


def _header(f) -> tuple[int, int, int, int, int]:
    """Item size, documents without a key, shard number, documents and ids of an open shard."""
    magic, *rest = struct.unpack(HEAD, f.read_at(HEAD_BYTES, 0))
    if magic != MAGIC:
        raise ValueError("not a shard")
    return tuple(rest)


def _head(f) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Documents without a key, shard number, keys and ends of an open shard."""
    _, null, shard, n, _ = _header(f)
    raw = f.read_at(16 * n, HEAD_BYTES)
    return null, shard, np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the shards; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"))


def _each_file(spark: SparkSession, path: str, schema: str, rows_of) -> DataFrame:
    """``rows_of(name, open file)`` of every shard, as columns of numpy arrays."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name in part["file"].to_pylist():
                with _opened(name) as f:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows_of(name, f)], names=names)

    return _files(spark, path).mapInArrow(run, schema)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows (shard, file, n_docs, n_ids, start): ``start`` ids stand in the shards before."""

    def rows_of(name: str, f) -> list:
        _, _, shard, n_docs, n_ids = _header(f)
        return [np.array([shard]), [name], np.array([n_docs], np.int64), np.array([n_ids], np.int64)]

    own = cut(_each_file(spark, path, "shard long, file string, n_docs long, n_ids long", rows_of)).withColumn("t", F.floor(F.col("shard") / PER_TASK))
    # running sums in two levels: over tasks, one row each, and over a task's shards
    of_task = own.groupBy("t").agg(F.sum("n_ids").alias("s"))
    of_task = of_task.select("t", (F.sum("s").over(W.orderBy("t")) - F.col("s")).alias("base"))
    inner = F.sum("n_ids").over(W.partitionBy("t").orderBy("shard")) - F.col("n_ids")
    return own.withColumn("inner", inner).join(of_task, "t").select("shard", "file", "n_docs", "n_ids", (F.col("base") + F.col("inner")).alias("start"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, copy, shard, first, n) of all documents: the ``n`` ids from ``first`` on in a shard.

    ``copy`` numbers the documents of one key from 0.  A null key is none.
    """

    def rows_of(name: str, f) -> list:
        null, shard, keys, ends = _head(f)
        real = np.arange(len(keys)) < len(keys) - null
        turn = np.ones(len(keys), bool)
        turn[1:] = (keys[1:] != keys[:-1]) | (real[1:] != real[:-1])
        at = np.arange(len(keys))
        run = np.maximum.accumulate(np.where(turn, at, 0))
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        # the first run may go on from the shard before
        return [pa.array(keys, mask=~real), (at - run), np.full(len(keys), shard), first, ends - first, run == 0]

    rows = cut(_each_file(spark, path, "key long, copy long, shard long, first long, n long, goes_on boolean", rows_of))
    # of keys at a shard's start or end, how many documents stand in the shards before
    met = rows.where("goes_on").groupBy("key").agg(F.min("shard").alias("_s")).select(F.col("key").alias("_key"))
    per = rows.join(met, F.col("key").eqNullSafe(F.col("_key")), "left_semi").groupBy("key", "shard").agg(F.count("*").alias("m"))
    before = per.withColumn("before", F.sum("m").over(W.partitionBy("key").orderBy("shard")) - F.col("m")).where("before > 0")
    before = cut(before.select(F.col("key").alias("_k"), F.col("shard").alias("_s"), "before"))
    moved = rows.join(small(before), F.col("key").eqNullSafe(F.col("_k")) & (F.col("shard") == F.col("_s")) & F.col("goes_on"), "left")
    return moved.select("key", (F.col("copy") + F.coalesce("before", F.lit(0))).alias("copy"), "shard", "first", "n")


def key_hash(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    return mix64(keys.astype(np.int64).view(np.uint64) + mix64(copies.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((mix64(h + np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


def prints(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def perfect_hash(h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels' bit arrays for the distinct hashes ``h``, and each hash's number below len(h)."""
    levels, number, left, base = [], np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    while len(left):
        if len(levels) == 64:
            raise ValueError("keys with equal hashes")
        size = max(8, int(ROOM * len(left)))
        at = _place(h[left], len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        number[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    return levels, number


def numbers(h: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The number of each hash, -1 where no level holds it."""
    number, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for level, bits in enumerate(levels):
        at = _place(h[left], level, len(bits))
        alone = bits[at]
        number[left[alone]] = base + (np.cumsum(bits) - 1)[at[alone]]
        base += int(bits.sum())
        left = left[~alone]
    return number


FIELDS = ("print", "shard", "first", "n", "copies")
INDEX = "bucket long, buckets long, sizes array<int>, bits array<binary>, " + ", ".join(f"{x} binary" for x in FIELDS)


def index(found: DataFrame, path: str, bucket_keys: int = 1 << 15) -> None:
    """Write the index of ``found``, the rows of :func:`entries`, under ``path``: a row for each bucket of about ``bucket_keys`` keys."""
    found = found.where("key is not null")
    many = cut(found.where("copy > 0").groupBy("key").agg((F.max("copy") + 1).alias("copies")).withColumnRenamed("key", "_k"))
    own = found.join(small(many), (F.col("key") == F.col("_k")) & (F.col("copy") == 0), "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    buckets = max(1, -(-found.count() // bucket_keys))

    def build(group: pa.Table) -> pa.Table:
        col = lambda name: group[name].to_numpy()
        h = key_hash(col("key"), col("copy"))
        levels, number = perfect_hash(h)
        put = np.argsort(number)
        data = {"print": prints(h)[put], **{x: col(x)[put].astype(np.int64) for x in FIELDS[1:]}}
        row = {"bucket": [col("bucket")[0]], "buckets": [buckets], "sizes": [[len(b) for b in levels]], "bits": [[np.packbits(b).tobytes() for b in levels]]}
        return pa.table(row | {k: [x.tobytes()] for k, x in data.items()}, schema=pa.schema([("bucket", pa.int64()), ("buckets", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.list_(pa.binary()))] + [(x, pa.binary()) for x in FIELDS]))

    build.__annotations__ = {"group": pa.Table, "return": pa.Table}
    own.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, INDEX).write.parquet(path)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key", "copy"), F.lit(buckets))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Addresses (key, copy, shard, first, n) of all documents of ``keys(key)``, from the index under ``path``.

    Keys that are not stored give no row, a null key none; repeated keys are looked up once.
    """
    held = spark.read.schema(INDEX).parquet(path)
    some = held.select("buckets").limit(1).collect()
    buckets = some[0].buckets if some else 1

    def find(wanted: pa.Table, row: pa.Table) -> pa.Table:
        out = {x: np.zeros(0, np.int64) for x in ("key", "copy", "shard", "first", "n", "copies")}
        if len(wanted) and len(row):
            r = row.to_pylist()[0]
            key, copy = wanted["key"].to_numpy(), wanted["copy"].to_numpy()
            h = key_hash(key, copy)
            levels = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(r["bits"], r["sizes"], strict=True)]
            number = numbers(h, levels)
            held = np.frombuffer(r["print"], np.uint32)
            ok = (number >= 0) & (held[number] == prints(h))
            out = {"key": key[ok], "copy": copy[ok]} | {x: np.frombuffer(r[x], np.int64)[number[ok]] for x in FIELDS[1:]}
        return pa.table(out)

    find.__annotations__ = {"wanted": pa.Table, "row": pa.Table, "return": pa.Table}

    def found(wanted: DataFrame) -> DataFrame:
        own = wanted.withColumn("bucket", _bucket(buckets))
        return own.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(find, "key long, copy long, shard long, first long, n long, copies long")

    first = cut(found(keys.where("key is not null").select(F.col("key").cast("long").alias("key")).distinct().withColumn("copy", F.lit(0).cast("long"))))
    address = ("key", "copy", "shard", "first", "n")
    again = first.where("copies > 1").select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies") - 1)).alias("copy"))
    return first.select(*address).unionByName(found(again).select(*address)) if first.where("copies > 1").limit(1).count() else first.select(*address)


def fetch(spark: SparkSession, path: str, addresses: DataFrame) -> DataFrame:
    """Rows (key, copy, start, n, ids) of ``addresses``, read from the shards under ``path``.

    ``start`` is the number of ids of all documents before; ``ids`` are
    little-endian 32-bit numbers.  Each shard's addresses come to one task in
    the order of their places; documents that stand side by side are read at once.
    """
    where = cut(shards(spark, path).select(F.col("shard").alias("_s"), "file", F.col("start").alias("base")))
    own = addresses.join(small(where), F.col("shard") == F.col("_s")).select("key", "copy", "first", "n", "file", "base", "shard")
    own = own.repartition("shard").sortWithinPartitions("shard", "first")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f = None
        for part in parts:
            files = part["file"].to_pylist()
            first, n = (part[c].to_numpy(zero_copy_only=False) for c in ("first", "n"))
            base = part["base"].to_numpy(zero_copy_only=False)
            at = 0
            while at < len(files):
                if files[at] != name:
                    if f is not None:
                        f.close()
                    name, f = files[at], _opened(files[at])
                    item, _, _, docs, _ = _header(f)
                    data = HEAD_BYTES + 16 * docs
                to, size = at + 1, int(n[at])
                while to < len(files) and files[to] == name and first[to] == first[to - 1] + n[to - 1] and (size + n[to]) * item <= READ:
                    size += int(n[to])
                    to += 1
                ids = np.frombuffer(f.read_at(size * item, data + int(first[at]) * item), f"<u{item}").astype("<u4", copy=False)
                edge = np.concatenate([[0], np.cumsum(n[at:to])]).astype(np.int64) * 4
                raw = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(edge), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part["key"].slice(at, to - at), part["copy"].slice(at, to - at), pa.array((base + first)[at:to]), pa.array(n[at:to]), raw], names=["key", "copy", "start", "n", "ids"])
                at = to
        if f is not None:
            f.close()

    return own.mapInArrow(run, "key long, copy long, start long, n long, ids binary")
