"""SentencePiece encoding and decoding of merge-type (BPE) models.

The encoder does not keep a queue of merges.  It walks a text from the left and
takes, at each position, the longest piece (Aho-Corasick) that is compatible
with the piece before it: two pieces are compatible if merging their joined
characters from scratch gives just these two.  Where no piece fits it steps
back and marks the position in a bitfield of failed ones, so that no position
is tried twice with the same outcome.

Pieces never span a space mark that follows another character, so texts are cut
there (and at line ends and unknown characters) and the parts' ids are kept by
part; each Python worker keeps a bounded number of them.

Null and empty texts have no ids and decode to the empty text.  Texts of any
length are encoded whole, repeated rows alike; a table without rows gives none.
Models with user-defined or unused pieces are refused.  U+2581 counts as
a space, as in the library.  Unknown characters become byte pieces, or, in
models without them, the unknown piece.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator, Sequence
from itertools import chain, groupby

import ahocorasick

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PART = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
#: Parts whose ids a worker keeps at most, each of ``LONGEST`` characters at most.
KEPT, LONGEST = 200_000, 32


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message, one level deep."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[i : i + n]
            i += n


def _one_byte(e: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", e.start + 1


codecs.register_error("one-byte", _one_byte)


class Model:
    """A model file's pieces, and the encoder and decoder over them."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        prefix, strip, kind_of_model = 1, 1, 1
        for f, v in _fields(data):
            if f == 1:
                x = dict(_fields(v))
                self.pieces.append(x[1].decode())
                self.scores.append(struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(x.get(3, NORMAL))
            elif f == 2:
                kind_of_model = dict(_fields(v)).get(3, 1)
            elif f == 3:
                x = dict(_fields(v))
                prefix, strip = x.get(3, 1), x.get(4, 1)
                if x.get(2):
                    raise ValueError("models with a character map are not supported")
        if kind_of_model != 2 or strip:
            raise ValueError("only BPE models that keep white space are supported")
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = bool(prefix)
        self.id = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.length = [len(p) for p in self.pieces]
        self.text = [self._shown(i) for i in range(len(self.pieces))]
        self.number = [str(i) for i in range(len(self.pieces))]
        self.known = {p for p in self.id if len(p) == 1}
        self.search = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merged(p) == [i]:  # a piece that merging cannot reach never stands in a result
                self.search.add_word(p, i)
        self.search.make_automaton()
        # the longest proper prefix of each piece that is a piece
        self.shorter: list[int] = [-1] * len(self.pieces)
        for p, i in self.id.items():
            for n in range(len(p) - 1, 0, -1):
                if p[:n] in self.search:
                    self.shorter[i] = self.id[p[:n]]
                    break
        self.fits: dict[int, bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def _shown(self, i: int) -> str:
        if self.kinds[i] == BYTE:
            b = int(self.pieces[i][3:5], 16)
            return chr(b) if b < 128 else chr(0xDC00 + b)
        if self.kinds[i] == CONTROL:
            return ""
        return " ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " ")

    def merged(self, chars: str) -> list[int]:
        """Ids of known characters by merging, best score first, leftmost among equals."""
        parts = list(chars)
        while len(parts) > 1:
            best = at = None
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[p] if p in self.id else -1 for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        if (ok := self.fits.get(key)) is None:
            ok = self.fits[key] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return ok

    def backtrack(self, part: str) -> list[int]:
        """Ids of a part all of whose characters are pieces."""
        n = len(part)
        longest = [-1] * n
        for end, i in self.search.iter(part):
            longest[end - self.length[i] + 1] = i  # later matches of a start are longer
        out: list[int] = []
        failed, pos, piece = bytearray(n // 8 + 1), 0, longest[0]
        while pos < n:
            end = pos + self.length[piece]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                pos = end
                piece = longest[pos] if pos < n else -1
            elif self.shorter[piece] >= 0:
                piece = self.shorter[piece]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError(part)
                piece = out.pop()
                pos -= self.length[piece]
        return out

    def part_ids(self, part: str) -> tuple[int, ...]:
        if self.known.issuperset(part):
            return tuple(self.backtrack(part))
        out, at = [], 0
        for known, chars in groupby(part, key=self.known.__contains__):
            end = at + sum(1 for _ in chars)
            run, at = part[at:end], end
            if known:
                out += self.backtrack(run)
            else:
                out += [self.byte[b] for b in run.encode()] if self.byte else [self.unknown] * len(run)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(self.parts) > KEPT:
            self.parts.clear()
        if len(self.fits) > 2 * KEPT:
            self.fits.clear()
        parts = PART.findall((MARK if self.prefix else "") + text.replace(" ", MARK))
        kept, long = self.parts, {}
        for p in parts:
            if p not in kept and p not in long:
                (kept if len(p) <= LONGEST else long)[p] = self.part_ids(p)
        if long:
            return [i for p in parts for i in (long[p] if p in long else kept[p])]
        return list(chain.from_iterable(map(kept.__getitem__, parts)))

    def decode(self, ids: Sequence[int]) -> str:
        s = "".join(map(self.text.__getitem__, ids))
        if self.prefix and s.startswith(" "):
            first = next((i for i in ids if self.kinds[i] != CONTROL), None)
            if first is not None and self.kinds[first] in (NORMAL, USER):
                s = s[1:]
        if not s.isascii() and any("\udc80" <= c <= "\udcff" for c in s):
            # bytes join to characters only within a run of byte pieces
            runs = groupby(ids, key=lambda i: self.kinds[i] == CONTROL)
            whole = "\udc00".join("".join(map(self.text.__getitem__, run)) for control, run in runs if not control)
            whole = whole[1:] if len(s) < sum(len(self.text[i]) for i in ids) else whole
            s = "".join(x.encode("utf-8", "surrogateescape").decode("utf-8", "one-byte") for x in whole.split("\udc00"))
        return s


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model at ``path``, once for each process."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = Model(f.read())
    return _models[path]
