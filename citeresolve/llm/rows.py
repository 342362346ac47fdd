"""Rows delivered repeatedly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeresolve.session import materialize

#: Repeated ids up to which their table is broadcast; beyond, the join is a shuffle.
BROADCAST = 500_000
#: Rows, and characters of text, of one frame that a Python worker returns: a column of more than 2 GB is no Arrow array.
PIECE_ROWS, PIECE_CHARS = 50_000, 32_000_000


def weight(x) -> int:
    """About how many characters a value takes."""
    if isinstance(x, str):
        return len(x)
    if isinstance(x, dict):
        return sum(map(weight, x.values()))
    return sum(map(weight, x)) if isinstance(x, (list, tuple)) else 8


def pieces(rows: Iterable[tuple], columns: list[str], most_rows: int = PIECE_ROWS, most_chars: int = PIECE_CHARS) -> Iterator[pd.DataFrame]:
    """The rows as frames of bounded size, made as they come."""
    out, size = [], 0
    for r in rows:
        n = weight(r)
        if out and (len(out) >= most_rows or size + n > most_chars):
            yield pd.DataFrame(out, columns=columns)
            out, size = [], 0
        out.append(r)
        size += n
    if out:
        yield pd.DataFrame(out, columns=columns)


def once(df: DataFrame, id_col: str, rank: list[str] | None = None) -> DataFrame:
    """Each id once: of the rows of a repeated one, the first by `rank` (any, if they are alike). Rows of null ids stay.

    Only the ids are shuffled, and the rows of repeated ids; while these ids are few, all other rows stay where they are.
    """
    many = materialize(df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("_n")).where("_n > 1").select(id_col), "repeated")
    n = many.count()
    if not n:
        return df
    if n <= BROADCAST:
        many = F.broadcast(many)
    rest = [c for c in df.columns if c != id_col]
    order = F.struct(*[F.col(c) for c in rank]) if rank else None
    again = df.join(many, id_col, "left_semi")
    if order is None:
        again = again.dropDuplicates([id_col])
    else:
        again = again.groupBy(id_col).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(id_col, "_r.*")
    return df.join(many, id_col, "left_anti").unionByName(again.select(*df.columns))
