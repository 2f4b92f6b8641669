"""Footers of stored files: row groups with their rows, bytes and range of times.

They are read in tasks, some files each, and no data page is read. A file whose writer left
no statistics has no range, and is taken to hold any time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files whose footers one task reads, about.
FILES_PER_TASK = 64
_DDL = "file string, row_group int, rows long, bytes long, least long, most long"


def _metadata(path: str) -> pq.FileMetaData:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    system, name = pyarrow.fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as source:
        return pq.read_metadata(source)


def read(spark: SparkSession, files: list[str], time_column: str) -> DataFrame:
    """file, row_group, rows, bytes (compressed), least, most (of ``time_column``, null if
    unknown): a row for each row group. Files without rows give none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file in batch["file"]:
                meta = _metadata(file)
                names = [meta.schema.column(i).path for i in range(meta.num_columns)]
                place = names.index(time_column) if time_column in names else None
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    found = None if place is None else group.column(place).statistics
                    known = found is not None and found.has_min_max
                    size = sum(group.column(i).total_compressed_size for i in range(meta.num_columns))
                    out.append((file, g, group.num_rows, size, found.min if known else None, found.max if known else None))
            frame = pd.DataFrame(out, columns=["file", "row_group", "rows", "bytes", "least", "most"])
            yield frame.astype({"least": "Int64", "most": "Int64"})

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    tasks = max(1, -(-len(files) // FILES_PER_TASK))
    return listed.repartition(tasks, "file").mapInPandas(rows, _DDL)


def overlapping(footers: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """The row groups that may hold times from ``start`` (included) to ``end`` (excluded)."""
    if start is not None:
        footers = footers.where(F.col("most").isNull() | (F.col("most") >= start))
    if end is not None:
        footers = footers.where(F.col("least").isNull() | (F.col("least") < end))
    return footers
