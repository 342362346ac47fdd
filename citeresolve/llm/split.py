"""Problem 5: cut oversized items at natural boundaries, with an overlap between consecutive pieces.

Method: the size of every prefix is an array of offset prefix sums (by default one unit per code point; any
tokenizer that yields token lengths can supply other units), the places where a cut reads naturally are sorted
arrays of offsets by rank (paragraph, line, sentence, clause, word). A piece starting at `s` may end at the last
offset whose size stays within the limit; each rank's array is binary searched for its last boundary there. The
best rank with a boundary in the last part of the piece (from MIN_FILL of the limit on) wins; where no rank has one there, the
last boundary of any rank before it does; and only where the piece has none beyond the overlap is the cut hard (but
never between a letter and its combining marks). The next piece starts exactly `overlap` units before the cut.

Defined results: a null text has no piece; an empty text has one empty piece; a text within the limit is one
piece; ties between ranks go to the higher rank. Every row is cut: rows delivered repeatedly are passed once
(`rows.once`).
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP, MIN_FILL = 3000, 200, 0.5

#: Ranks of natural boundaries, best first; a boundary is the offset after the match.
RANKS = tuple(
    regex.compile(p)
    for p in (
        r"\r?\n[ \t]*(?:\r?\n[ \t]*)+|\f",
        r"\r?\n",
        r"[.!?…](?:[\"'”’»)\]]*)\s+(?=[\p{Lu}\p{N}\"“‘«(\[—–-])",
        r"[;:]\s+|,\s+|\s[—–]\s",
        r"\s+",
    )
)


def boundaries(text: str) -> list[list[int]]:
    """The sorted offsets after each natural boundary, one array per rank."""
    return [[m.end() for m in p.finditer(text)] for p in RANKS]


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, min_fill: float = MIN_FILL, offsets: Sequence[int] | None = None) -> list[tuple[int, int]]:
    """The pieces of `text` as [start, end) offsets of code points.

    `offsets[i]` is the size of the first i code points (prefix sums); None counts code points.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    size = offsets if offsets is not None else range(n + 1)
    if size[n] <= limit:
        return [(0, n)]
    ranks = boundaries(text)
    out: list[tuple[int, int]] = []
    s = 0
    while True:
        last = max(bisect_right(size, size[s] + limit) - 1, s + 1)
        if last >= n:
            out.append((s, n))
            return out
        # beyond the overlap, so that every piece brings new text
        least = max(s + 1, bisect_right(size, size[s] + overlap))
        full = max(least, bisect_right(size, size[s] + int(limit * min_fill) - 1))
        ends = [b[k - 1] for b in ranks if (k := bisect_right(b, last)) and b[k - 1] >= least]
        end = next((e for e in ends if e >= full), max(ends, default=0))
        if not end:
            end = last
            while end > least and unicodedata.combining(text[end]):
                end -= 1
        out.append((s, end))
        s = max(s + 1, bisect_right(size, size[end] - overlap) - 1 if offsets is not None else end - overlap)


def splitter(id_col: str, text_col: str, limit: int, overlap: int, min_fill: float, with_text: bool, sizes: Callable[[str], Sequence[int]] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, no, lo, hi, of, text = [], [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None:
                    continue
                ps = spans(t, limit, overlap, min_fill, sizes(t) if sizes else None)
                for k, (x, y) in enumerate(ps):
                    ids.append(i), no.append(k), lo.append(x), hi.append(y), of.append(len(ps))
                    if with_text:
                        text.append(t[x:y])
            cols = [pa.array(ids, b.schema.field(0).type), *(pa.array(x, pa.int32()) for x in (no, of, lo, hi))]
            names = [id_col, "piece_no", "pieces", "start", "end"]
            if with_text:
                cols.append(pa.array(text, pa.string())), names.append("piece")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def split_items(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, min_fill: float = MIN_FILL, with_text: bool = True, sizes: Callable[[str], Sequence[int]] | None = None) -> DataFrame:
    """(id, piece_no, pieces, start, end[, piece]) of every non-null text. Map-only: one pass, no shuffle.

    `sizes` maps a text to its prefix sums when pieces are measured in other units than code points.
    """
    src = df.select(F.col(id_col), F.col(text_col))
    fields = [T.StructField(id_col, src.schema[id_col].dataType), *(T.StructField(x, T.IntegerType()) for x in ("piece_no", "pieces", "start", "end"))]
    if with_text:
        fields.append(T.StructField("piece", T.StringType()))
    return src.mapInArrow(splitter(id_col, text_col, limit, overlap, min_fill, with_text, sizes), T.StructType(fields))
