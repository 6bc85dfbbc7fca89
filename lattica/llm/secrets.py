"""Secret scans: patterns of known kinds, and character Markov models.

Two first-order character models, of random strings and of ordinary words and
identifiers, are counted by Spark from labelled samples (text, label) and
compared by log-likelihood ratio on every token of a text that could hold a
secret.  The models are two tables of fixed size, whatever the sample.  A token
that is not random as a whole, or holds a match of a pattern, is searched for its
best windows; what such a window adds to the patterns' spans is a span too.

The least length and ratio (``LEAST``, ``LEAST_BITS``) are those at which, on
held-out samples of both labels, next to nothing is confused; the tests hold
precision and recall there, the README lists them.

Null and empty texts hold nothing.  Texts of any length are scanned whole, in
time that grows with the text and its spans.  Offsets are code points, ends exclusive.
Repeated rows are scanned alike.  Other columns than ``text`` are carried along
unread; columns that the scan adds replace those of the same name.  Without
samples of either label the models add no span.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Tokens that the models judge.
LEAST = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: What a token's parts stand between.
BREAK = re.compile(r"[+/_=-]")
WORD = re.compile(r"[A-Za-z]{4,}[A-Za-z0-9_-]*")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET)
CODE = np.full(128, -1, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(SIZE)
#: Pairs with a character that no ordinary sample holds; in paths they are no sign of randomness.
FOREIGN = np.array([a in "+/=" or b in "+/=" for a in ALPHABET for b in ALPHABET])
#: Mean log-likelihood ratio a character, in bits, from which a token counts as random.
LEAST_BITS = 1.0

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' matches, each kind leftmost and without overlap.

    Greedy runs make ``{14,}`` and ``{16,}`` the same as ``+`` with short matches
    dropped; an assignment's value must be measured after the match, as a short
    one still uses up its text.
    """
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def pair_codes(token: str) -> np.ndarray:
    c = CODE[np.frombuffer(token.encode(), np.uint8)]
    return c[:-1] * SIZE + c[1:]


def ordinary(text: str) -> str:
    """The words outside the patterns' matches, alone and joined in pairs as identifiers are, by lines."""
    for start, _, end in sorted(base_spans(text), reverse=True):
        text = text[:start] + " " + text[end:]
    words = WORD.findall(text)
    out = words + [a + "_" + b for a, b in zip(words[::2], words[1::2], strict=False)]
    return "\n".join(out + [a.lower() + b.capitalize() for a, b in zip(words[::3], words[1::3], strict=False)])


def labelled_samples(docs: DataFrame, random_strings: int = 4000) -> DataFrame:
    """Samples (text, label) for training: 1 random, 0 ordinary.

    Random strings are drawn uniformly from the alphabets that keys are written
    in (digests in hexadecimal and base64, upper-case and mixed identifiers).
    Ordinary ones are the texts of all documents, of which the words count.
    """
    spark = docs.sparkSession
    d = lambda i: F.sha2(F.concat(F.lit(f"{i}:"), F.col("id").cast("string")), 256)
    raw = spark.range(random_strings)
    base64 = F.base64(F.unhex(d(0)))
    kinds = [d(1), base64, F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(F.concat(d(2), d(3)))), "[+/=]", ""), 1, 32)), F.regexp_replace(F.base64(F.unhex(d(4))), "[+/=]", "")]
    text = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    random = raw.select(text.alias("text"), F.lit(1).alias("label"))
    return random.unionByName(docs.where("text is not null").select("text", F.lit(0).alias("label")))


def train(samples: DataFrame, smoothing: float = 0.5) -> np.ndarray | None:
    """Log-likelihood ratio in bits of each pair of characters, random over ordinary.

    Pairs are counted where the samples are, of label 0 in ``ordinary``; at most two tables of
    ``SIZE ** 2`` sums reach the driver.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, SIZE * SIZE), np.int64)
        for part in parts:
            for text, label in zip(part["text"], part["label"], strict=True):
                if text and label == 0:
                    text = ordinary(text)
                if text and len(text) > 1 and label in (0, 1) and text.isascii():
                    c = CODE[np.frombuffer(text.encode(), np.uint8)]
                    ok = (c[:-1] >= 0) & (c[1:] >= 0)
                    sums[int(label)] += np.bincount((c[:-1] * SIZE + c[1:])[ok], minlength=SIZE * SIZE)
        at = np.nonzero(sums)
        yield pd.DataFrame({"label": at[0], "pair": at[1], "n": sums[at]})

    got = samples.select("text", "label").mapInPandas(run, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIZE, SIZE))
    for r in got:
        counts[r.label, r.pair // SIZE, r.pair % SIZE] = r.n
    if not counts.sum(axis=(1, 2)).all():
        return None
    p = (counts + smoothing) / (counts + smoothing).sum(axis=2, keepdims=True)
    return np.where(FOREIGN, 0.0, np.log2(p[1] / p[0]).ravel())


def best_windows(token: str, model: np.ndarray, least_bits: float) -> list[tuple[int, int]]:
    """The windows of ``LEAST`` characters or more whose mean reaches ``least_bits``, the best of all first, then
    those on either side of it; each reaches out to the ends of the parts that it begins and ends in."""
    over = np.concatenate([[0.0], np.cumsum(model[pair_codes(token)] - least_bits)])  # of the pairs before a character
    at = [m.start() for m in BREAK.finditer(token)]
    first, last = np.array([0, *(x + 1 for x in at)]), np.array([*at, len(token)])
    out, todo = [], [(0, len(token))]
    while todo:
        low, high = todo.pop()
        if high - low < LEAST:
            continue
        begins, ends = over[low : high - LEAST + 1], over[low + LEAST - 1 : high]
        gain = ends - np.minimum.accumulate(begins)
        end = int(gain.argmax())
        if gain[end] < 0:
            continue
        start = low + int(begins[: end + 1].argmin())
        end = low + LEAST + end
        start = max(low, int(first[np.searchsorted(first, start, "right") - 1]))
        end = min(high, int(last[np.searchsorted(last, end)]))
        out.append((start, end))
        todo += [(low, start), (end, high)]
    return out


def all_spans(text: str, model: np.ndarray | None, least_bits: float = LEAST_BITS) -> list[Span]:
    """The patterns' spans, and what the models call random apart from them."""
    found = base_spans(text)
    if model is not None:
        begins, ends = union(found)
        for m in TOKEN.finditer(text):
            token, at = m.group(), m.start()
            free = bisect_right(ends, at) == bisect_left(begins, m.end())
            if free and model[pair_codes(token)].mean() >= least_bits:
                found.append((at, 3, m.end()))
                continue
            for start, end in best_windows(token, model, least_bits):
                start, end = start + at, end + at
                k = bisect_right(ends, start)
                while start < end:  # what lies between the patterns' spans
                    stop = min(begins[k], end) if k < len(begins) else end
                    if start < stop:
                        found.append((start, 3, stop))
                    start, k = ends[k] if k < len(ends) else end, k + 1
    return sorted(found)


def union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint runs that spans cover."""
    begins: list[int] = []
    ends: list[int] = []
    for start, _, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(start)
            ends.append(end)
    return begins, ends


def scan(docs: DataFrame, model: np.ndarray | None, redact: bool = False, least_bits: float = LEAST_BITS) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end) in order; or, with
    ``redact``, with each span of ``text`` replaced by ``[kind]`` (overlaps as one)."""
    span = "array<struct<kind:string,start:int,end:int>>"
    if redact:
        def clean(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for start, kind, end in all_spans(text, model, least_bits):
                if start >= at:
                    out += [text[at:start], f"[{KINDS[kind]}]"]
                at = max(at, end)
            return "".join(out) + text[at:]

        cleaned = F.pandas_udf(lambda s: pd.Series([clean(t) for t in s], dtype=object), "string")
        return docs.withColumn("text", cleaned("text"))

    found = F.pandas_udf(lambda s: pd.Series([[(KINDS[k], a, b) for a, k, b in all_spans(t, model, least_bits)] if t else [] for t in s], dtype=object), span)
    return docs.drop("spans").withColumn("spans", found("text"))
