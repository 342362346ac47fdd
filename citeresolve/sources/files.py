"""Sources and sinks: text folders, canonical tables in SQLite or parquet, contract JSON and packed CSV."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CANONICAL = "id bigint, tribunal string, natureza string, ano int, relator string, texto string"
CITATIONS = "array<struct<inicio:int,fim:int,trecho:string,tipo:string,classificacao:string,resolucao:struct<id_canonico:string>,confianca:double>>"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(documento_id, text) of the *.txt files of a folder, not of its subfolders; line ends and positions are kept."""
    t = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return t.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("documento_id"), F.col("value").alias("text"))


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], int(options.get("partitions", 8))

    def _connect(self) -> sqlite3.Connection:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as c:
            lo, hi = c.execute("SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM documentos").fetchone()
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [_Range(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)] or [_Range(0, -1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with self._connect() as c:
            rows = c.execute("SELECT id, tribunal, natureza, ano, relator, texto FROM documentos WHERE rowid BETWEEN ? AND ?", (partition.lo, partition.hi))
            for i, t, n, a, r, x in rows:
                yield int(i), t, n, int(a) if a not in (None, "") else None, r, x


class SqliteSource(DataSource):
    """Read-only scan of a SQLite canonical table, split by ranges of row ids."""

    @classmethod
    def name(cls) -> str:
        return "canonical_sqlite"

    def schema(self) -> str:
        return CANONICAL

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


def canonical(spark: SparkSession, path: str) -> DataFrame:
    """The canonical table from a SQLite file or parquet."""
    if path.endswith((".db", ".sqlite")):
        spark.dataSource.register(SqliteSource)
        return spark.read.format("canonical_sqlite").option("path", path).load()
    return spark.read.parquet(path)


def contract_json(spark: SparkSession, folder: str) -> DataFrame:
    """Long rows of the contract's JSON files."""
    d = spark.read.schema(f"documento_id string, citacoes {CITATIONS}").json(folder, multiLine=True)
    return d.select("documento_id", F.explode_outer("citacoes").alias("c")).select("documento_id", "c.inicio", "c.fim", "c.trecho", "c.tipo", "c.classificacao", F.col("c.resolucao.id_canonico").alias("id_canonico"), "c.confianca")


def write_json(nested: DataFrame, folder: str) -> None:
    """One JSON text a line: (documento_id, json) as produced by the contract module."""
    nested.select(F.col("json").alias("value")).write.mode("overwrite").text(folder)


def write_packed(packed: DataFrame, folder: str) -> None:
    packed.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(folder)
