"""Index of landed ids: which ids of a batch were seen before, without reading the landed rows.

Ids are dealt by the leading bits of their hash into files of about ``FILE_IDS`` ids, each with
a Bloom filter. A batch is probed against the filters; only files whose filter answers yes
for some id are opened, and the ids in them decide. Small runs are merged into larger ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fillsight.session import materialize
from fillsight.streaming.runs import Runs, read_folders

FILE_IDS = 500_000
# Bits per id and probes per id: about one wrong yes in a hundred.
BITS, PROBES = 10, 7
# Files opened by name; where more are hit, the whole index is read instead.
MANY_FILES = 5_000

_IDS = T.StructType([T.StructField("id", T.StringType()), T.StructField("part", T.LongType())])
_FILTERS = T.StructType([T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])


def _part(depth: Column) -> Column:
    """Leading ``depth`` bits of the id's hash."""
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.xxhash64("id"), (64 - depth).cast("int")))


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """Bit positions of each hash, one row per probe."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(size - 1) for i in range(PROBES)]).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    """Filter of some hashes, a power of two of bits."""
    size = 64
    while size < BITS * len(hashes):
        size *= 2
    bits = np.zeros(size, bool)
    bits[_places(hashes, size)] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return flags[_places(hashes, len(flags))].all(0)


class IdentityIndex:
    """Ids landed so far, below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.ids, self.filters = spark, Runs(spark, f"{path}/ids"), Runs(spark, f"{path}/filters")

    def add(self, ids: DataFrame, batch: int) -> None:
        """Index the ids a batch has landed, and merge what has become too many small runs below it."""
        self._write(ids.select("id"), f"{self.ids.path}/new/batch={batch}", f"{self.filters.path}/new/batch={batch}")
        runs = self.ids.due(batch)

        def merge(paths: list[str], target: str) -> None:
            every = read_folders(self.spark, paths, _IDS).select("id")
            self._write(every, target, target.replace(self.ids.path, self.filters.path))

        self.ids.merge(runs, merge)
        if runs:
            self.filters.retire(batch - 2)

    def _write(self, ids: DataFrame, ids_path: str, filters_path: str) -> None:
        """The filters are written first: a run counts once its ids are there."""
        depth = max(0, int(ids.count() // FILE_IDS).bit_length())
        dealt = ids.withColumn("part", _part(F.lit(depth)))

        def one(group: pa.Table) -> pa.Table:
            hashes = group.column("h").to_numpy()
            return pa.table({"part": group.column("part")[:1], "n": pa.array([len(hashes)]), "bits": pa.array([bloom(hashes)], pa.binary())})

        hashed = dealt.withColumn("h", F.xxhash64("id")).select("part", "h")
        hashed.groupBy("part").applyInArrow(one, _FILTERS).write.mode("overwrite").parquet(filters_path)
        dealt.repartition(max(1, 1 << min(depth, 12)), "part").sortWithinPartitions("part", "id").write.mode("overwrite").partitionBy("part").parquet(ids_path)

    def candidates(self, ids: DataFrame, before: int) -> DataFrame:
        """(run, part, id): files of the index whose filter says yes to an id of the batch."""
        runs = self.ids.runs(before)
        if not runs:
            return self.spark.createDataFrame([], "run int, part bigint, id string")
        filters = None
        for i, run in enumerate(runs):
            one = self.spark.read.schema(_FILTERS).parquet(f"{self.filters.path}/{run.name}").withColumn("run", F.lit(i))
            filters = one if filters is None else filters.unionByName(one)
        # the depth of a run follows from its largest part; one row per run
        sizes = filters.groupBy("run").agg(F.sum("n").alias("n")).collect()
        depth = {r["run"]: max(0, (r["n"] // FILE_IDS).bit_length()) for r in sizes}
        salts = int(ids.count() // FILE_IDS) + 1
        which = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(depth.get(i, 0)).alias("depth")) for i in range(len(runs))])
        asked = ids.select("id", F.xxhash64("id").alias("h"), F.inline(which)).withColumn("part", _part(F.col("depth"))).drop("depth")
        asked = asked.withColumn("salt", F.pmod("h", F.lit(salts)))
        copies = filters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return left.select(["run", "part", "id"]).slice(0, 0)
            yes = may_hold(right.column("bits")[0].as_py(), left.column("h").to_numpy())
            return left.select(["run", "part", "id"]).filter(pa.array(yes))

        keys = ["run", "part", "salt"]
        return asked.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(probe, "run int, part bigint, id string")

    def known(self, ids: DataFrame, before: int) -> DataFrame:
        """The ids (column ``id``, each once) that batches below ``before`` have landed."""
        runs = [r.path for r in self.ids.runs(before)]
        if not runs:
            return ids.limit(0).select("id")
        found = materialize(self.candidates(ids, before))
        files = found.select("run", "part").distinct().limit(MANY_FILES + 1).collect()
        if not files:
            return found.select("id")
        if len(files) > MANY_FILES:
            landed = read_folders(self.spark, runs, _IDS)
        else:
            landed = self.spark.read.schema("id string").parquet(*[f"{runs[f['run']]}/part={f['part']}" for f in files])
        return found.select("id").distinct().join(landed, "id", "left_semi")
