"""Problem 6: encode texts with a public byte-level BPE by prefix dynamic programming.

For every prefix of a pre-token's bytes exactly one last token is valid: the one the merge procedure leaves at the
end of that prefix. A token ending at byte i is the valid one iff it and the valid last token of the prefix before
it would not have been merged across their border. So one array (prefix length -> last token) holds the encoding
of every prefix, can be appended to without looking back, and after an edit has to be redone only from the edit to
the next pre-token border.

Border test: while two neighbouring tokens are built, only a piece of the left one's right spine and a piece of the
right one's left spine ever touch. Merges are ordered by rank and a merged token ranks above its parts, so the
border survives iff no such pair has a merge that comes before both pieces are consumed by their own tokens
(equal ranks: the left merge goes first).
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: The pre-token pattern of the vocabulary (fixed value, published with it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a worker's memo of words is emptied: bounds its memory, never changes a result.
MEMO = 400_000
#: A pre-token never has to be re-read further back than this many pre-tokens when text is appended (a contraction spans three).
LOOK_BACK = 3


class Vocabulary:
    """Tokens, ranks and the merge that made each token."""

    def __init__(self, data: bytes):
        self.rank: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.token = {v: k for k, v in self.rank.items()}
        self.longest: dict[bytes, int] = {}
        for t in self.rank:
            e = t[-2:]
            if len(t) > self.longest.get(e, 0):
                self.longest[e] = len(t)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.token):
            t = self.token[i]
            if len(t) > 1:
                self._made(i, t)

    def _made(self, i: int, t: bytes) -> None:
        """The two tokens whose merge gives t: the only cut whose halves survive side by side under the earlier merges."""
        for k in range(1, len(t)):
            a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
            if a is not None and b is not None and a < i and b < i and self.border(a, b):
                self.parts[i], self.joins[a, b] = (a, b), i
                return

    def border(self, a: int, b: int) -> bool:
        """Whether tokens a, b next to each other stay two tokens."""
        xs, limit = [(a, 1 << 60)], a
        while (p := self.parts.get(limit)) is not None:
            xs.append((p[1], limit))
            limit = p[1]
        y, until, joins = b, 1 << 60, self.joins
        while True:
            for x, eaten in xs:
                r = joins.get((x, y))
                if r is not None and r < eaten and r <= until:
                    return False
            p = self.parts.get(y)
            if p is None:
                return True
            y, until = p[0], y

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Continue `last` (last[i]: the last token of the first i bytes; last[0] = -1) to all of `data`."""
        rank, longest, fits = self.rank, self.longest, self.fits
        for i in range(len(last), len(data) + 1):
            for n in range(min(i, max(1, longest.get(data[max(0, i - 2) : i], 1))), 0, -1):
                t = rank.get(data[i - n : i])
                if t is None:
                    continue
                before = last[i - n]
                if before < 0:
                    break
                ok = fits.get((before, t))
                if ok is None:
                    if len(fits) > 4 * MEMO:
                        fits.clear()
                    ok = fits[before, t] = self.border(before, t)
                if ok:
                    break
            else:
                raise ValueError("no token of the vocabulary ends here")
            last.append(t)
        return last

    def read(self, last: list[int]) -> list[int]:
        """The ids of the whole, from the last token of each prefix."""
        out, i = [], len(last) - 1
        while i > 0:
            t = last[i]
            out.append(t)
            i -= len(self.token[t])
        out.reverse()
        return out

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        t = self.rank.get(data)
        return (t,) if t is not None else tuple(self.read(self.extend(data, [-1])))


class Encoder:
    """Encodes texts; remembers the ids of words it has met."""

    def __init__(self, data: bytes, pattern: str = PATTERN):
        self.vocabulary = Vocabulary(data)
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words = _Words(self)

    def piece(self, p: str) -> tuple[int, ...]:
        ids = self.pieces.get(p)
        if ids is None:
            if len(self.pieces) > MEMO:
                self.pieces.clear()
            ids = self.vocabulary.encode_bytes(p.encode("utf-8", "surrogatepass"))
            if len(p) <= 64:
                self.pieces[p] = ids
        return ids

    def plain(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece, self.pattern.findall(text))))

    def runs(self, text: str) -> list[tuple[int, ...]]:
        """Ids of the text's words in order.

        A border of pre-tokens lies before every single space between two other characters, so the text is cut there
        and each part is looked up whole. Parts at other white space are put together again first.
        """
        parts = text.split(" ")
        words = self.words
        if len(words) > MEMO:
            words.clear()
        if "  " in text or text[0].isspace() or text[-1].isspace() or _odd(text):
            joined = [parts[0]]
            for p in parts[1:]:
                if p and not p[0].isspace() and joined[-1] and not joined[-1][-1].isspace():
                    joined.append(p)
                else:
                    joined[-1] += " " + p
            parts = joined
        return [self.plain(parts[0]), *map(words.__getitem__, parts[1:])]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.runs(text))) if text else []

    def count(self, text: str) -> int:
        return sum(map(len, self.runs(text))) if text else 0


#: White space other than the space, by any library's definition (fixed values).
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOUCHING = tuple((w, w + " ", " " + w) for w in SPACES)


def _odd(text: str) -> bool:
    """Whether other white space touches a space."""
    for w, before, after in TOUCHING:
        if w in text and (before in text or after in text):
            return True
    return False


class _Words(dict):
    """word -> ids of ' ' + word."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.encoder.plain(" " + word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class Document:
    """An encoded text that can be appended to and edited without encoding it anew.

    Keeps each pre-token with its array of last tokens. `append` re-reads at most the last LOOK_BACK pre-tokens and
    extends the array of a pre-token that only grew; `edit` re-reads from shortly before the edit until the new
    pre-token borders meet the old ones.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.pieces, self.last = encoder, [], []
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    @property
    def ids(self) -> list[int]:
        v = self.encoder.vocabulary
        return [t for last in self.last for t in v.read(last)]

    def _arrays(self, piece: str, near: str = "", have: list[int] | None = None) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        keep = list(have) if have and piece.startswith(near) else [-1]
        return self.encoder.vocabulary.extend(data, keep)

    def append(self, more: str) -> None:
        if not more:
            return
        at = max(0, len(self.pieces) - LOOK_BACK)
        old, arrays = self.pieces[at:], self.last[at:]
        del self.pieces[at:], self.last[at:]
        for k, p in enumerate(self.encoder.pattern.findall("".join(old) + more)):
            self.pieces.append(p)
            self.last.append(self._arrays(p, old[k], arrays[k]) if k < len(old) else self._arrays(p))

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the code points [start, end) by `new`."""
        lo, k = 0, 0
        while k < len(self.pieces) and lo + len(self.pieces[k]) <= start:
            lo += len(self.pieces[k])
            k += 1
        for _ in range(LOOK_BACK):
            if k:
                k -= 1
                lo -= len(self.pieces[k])
        tail = "".join(self.pieces[k:])
        changed = tail[: start - lo] + new + tail[end - lo :]
        shift, ends, pos = len(new) - (end - start), {}, lo
        for j in range(k, len(self.pieces)):
            ends.setdefault(pos, j)
            pos += len(self.pieces[j])
        pieces, pos, rest = [], lo, len(self.pieces)
        for m in self.encoder.pattern.finditer(changed):
            pos = lo + m.start()
            if pos - shift >= end and pos >= start + len(new) and pos - shift in ends:
                rest = ends[pos - shift]
                break
            pieces.append(m.group())
        self.last[k:rest] = [self._arrays(p) for p in pieces]
        self.pieces[k:rest] = pieces


def vocabulary_bytes(spark: SparkSession, folder: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The vocabulary file (a fixed 0.8 MB), read by the driver so that executors need no copy."""
    with open(os.path.join(folder or spark.conf.get("citeresolve.tokenizers", TOKENIZERS), name), "rb") as f:
        return f.read()


_ENCODER: dict[int, Encoder] = {}


def encoder_of(data: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    k = hash(data)
    if k not in _ENCODER:
        _ENCODER[k] = Encoder(data)
    return _ENCODER[k]


def encode_column(df: DataFrame, id_col: str, text_col: str, folder: str | None = None) -> DataFrame:
    """(id, ids array<int>) for every row. A null or an empty text has an empty list. Map-only."""
    src = df.select(F.col(id_col), F.col(text_col))
    data = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(df.sparkSession, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(data.value)
        for b in batches:
            flat, ends = [], [0]
            for t in b.column(1).to_pylist():
                if t:
                    ids = list(chain.from_iterable(e.runs(t)))
                    flat.append(np.fromiter(ids, np.int32, len(ids)))
                    ends.append(ends[-1] + len(ids))
                else:
                    ends.append(ends[-1])
            values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], [id_col, "ids"])

    return src.mapInArrow(run, T.StructType([src.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_counter(spark: SparkSession, folder: str | None = None) -> Callable:
    """A Column function: number of tokens of a text; null and empty texts have 0."""
    data = spark.sparkContext.broadcast(vocabulary_bytes(spark, folder))

    @F.pandas_udf(T.LongType())
    def n_tokens(texts: pd.Series) -> pd.Series:
        e = encoder_of(data.value)
        return pd.Series([e.count(t) if t else 0 for t in texts], dtype="int64")

    return n_tokens
