"""Tables that grow by one folder per batch and are merged in place.

``new/batch=<id>`` holds what one batch wrote (a retry replaces it); ``merged/<first>-<last>``
holds several batches as one. A reader takes the widest finished folders and the batches no
such folder covers, so a merge changes no result and may be lost half-way. Streams read
``new`` only and never see a merge. Covered folders go once ``keep`` later batches exist.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types as T

# Separate folders a reader may meet before the younger ones are merged.
LIMIT = 8


@dataclass(frozen=True)
class Run:
    """Batches ``first`` to ``last`` in one folder."""

    first: int
    last: int
    path: str
    size: int
    name: str  # below the table: new/batch=3 or merged/0-7


def read_folders(spark: SparkSession, paths: list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of several table folders, each with its own partition folders below it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reduce(DataFrame.unionByName, [reader.parquet(p) for p in paths])


class Runs:
    """The folders of one table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _finished(self, below: str) -> list[Run]:
        fs, place = self._folder(f"{self.path}/{below}")
        if not fs.exists(place):
            return []
        out = []
        for status in fs.listStatus(place):
            name, path = status.getPath().getName(), status.getPath().toString()
            marker = self._folder(f"{path}/_SUCCESS")[1]
            if status.isDirectory() and fs.exists(marker):
                first, last = name.split("-") if below == "merged" else [name.removeprefix("batch=")] * 2
                out.append(Run(int(first), int(last), path, fs.getContentSummary(status.getPath()).getLength(), f"{below}/{name}"))
        return out

    def runs(self, before: int | None = None) -> list[Run]:
        """The folders that make up the table (of batches below ``before``), oldest first.

        A merged folder that reaches beyond ``before`` is never needed: a batch merges only
        batches below itself, and a retried batch comes before its successors.
        """
        every = [r for r in self._finished("merged") + self._finished("new") if before is None or r.last < before]
        wide = sorted(every, key=lambda r: (r.first - r.last, r.first))
        kept: list[Run] = []
        for r in wide:
            if not any(k.first <= r.first and r.last <= k.last for k in kept):
                kept.append(r)
        return sorted(kept, key=lambda r: r.first)

    def write(self, df: DataFrame, batch: int, partition: tuple[str, ...] = ()) -> str:
        path = f"{self.path}/new/batch={batch}"
        df.write.mode("overwrite").partitionBy(*partition).parquet(path)
        return path

    def read(self, schema: T.StructType | None = None, before: int | None = None) -> DataFrame:
        """All rows, with the given types: partition values are not guessed from folder names.

        Without a schema the files' own types hold; that needs a folder, and none with partitions.
        """
        paths = [r.path for r in self.runs(before)]
        if not paths:
            if schema is None:
                raise ValueError(f"nothing was written to {self.path}")
            return self.spark.createDataFrame([], schema)
        return read_folders(self.spark, paths, schema)

    def due(self, before: int, limit: int = LIMIT) -> list[Run]:
        """Youngest folders to merge: none up to ``limit`` folders, else all that are not much larger than those after them."""
        runs = self.runs(before)
        if len(runs) <= limit:
            return []
        take, total = [runs[-1]], runs[-1].size
        for r in reversed(runs[:-1]):
            if r.size > 2 * total and len(take) >= 2:
                break
            take.insert(0, r)
            total += r.size
        return take

    def merge(self, runs: list[Run], write: Callable[[list[str], str], None], keep: int | None = 2) -> None:
        """``write(paths, target)`` makes one folder of several. Covered folders go once ``keep``
        later batches exist, or stay for ``retire`` where that is None."""
        if len(runs) < 2:
            return
        write([r.path for r in runs], f"{self.path}/merged/{runs[0].first}-{runs[-1].last}")
        if keep is not None:
            self.retire(max(r.last for r in self._finished("new")) - keep)

    def retire(self, last: int) -> None:
        """Delete covered folders of batches up to ``last``."""
        seen = {r.name for r in self.runs()}
        for r in self._finished("merged") + self._finished("new"):
            if r.name not in seen and r.last <= last:
                fs, place = self._folder(r.path)
                fs.delete(place, True)
