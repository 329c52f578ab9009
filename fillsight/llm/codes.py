"""Vector codes by member-resident Lloyd: parts stay with their codebook entry between rounds.

Vectors are cut into parts; every part is a member row (position, entry, salt, components).
Members live in a table bucketed by (position, entry, salt), so a round works where they are:

* each owner adds up its resident members, one row per (position, entry) and task, and the
  codebook (positions x entries rows) is made of these;
* one pass assigns the residents under the new codebook; those who keep their entry are
  written back to their bucket without an exchange, and only those who change it migrate,
  dealt by their new (position, entry, salt).

The salt is the row's number modulo the number of buckets, so an entry that holds most
members is spread over all of them. A round's table goes once the next one is whole.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fillsight.session import materialize, shared_folder

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
# Components beyond this many units count as this many, so that all sums fit 64 bits.
LIMIT = 1 << 24
# Members a bucket is meant to hold, vectors turned into members at once, rows of one label joined
# under one key, and the most labels that may be larger than that.
BUCKET_MEMBERS = 1_000_000
CHUNK_ROWS = 4_096
LABEL_ROWS = 1_000
MANY_LABELS = 50_000


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v = floor(scale * x); rows without a vector or with a NULL or non-finite component go."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    bound = F.lit(float(LIMIT))
    unit = lambda c: F.floor(F.greatest(F.least(F.lit(scale) * c.cast("double"), bound), -bound)).cast("int")
    return vectors.where(x.isNotNull()).where(finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.transform(x, unit).alias("v"))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix; shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest index of the nearest entry and the squared distance, in integers."""
    best, error = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    for k, entry in enumerate(entries):
        d = parts - entry
        d = np.einsum("ij,ij->i", d, d)
        closer = d < error
        best[closer], error[closer] = k, d[closer]
    return best, error


class _Members:
    """The bucketed table of members, one version per round."""

    def __init__(self, spark, buckets: int, width: int, label: str):
        self.spark, self.buckets, self.width = spark, buckets, width
        self.dims = [f"c{i}" for i in range(width)]
        self.schema = ", ".join([f"row bigint, vec_id bigint, label {label}, pos tinyint, entry smallint, salt int", *[f"{c} int" for c in self.dims]])
        self.name = self.path = None

    def write(self, *frames: DataFrame) -> None:
        """A new version from frames whose rows are dealt by bucket already; the old one goes."""
        old, name = (self.name, self.path), f"members_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        both = reduce(DataFrame.unionByName, frames)
        both.write.bucketBy(self.buckets, "pos", "entry", "salt").option("path", path).saveAsTable(name)
        self.name, self.path = name, path
        self.drop(*old)

    def drop(self, name: str | None, path: str | None) -> None:
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def deal(self, moving: DataFrame) -> DataFrame:
        return moving.repartition(self.buckets, "pos", "entry", "salt")

    def frame(self) -> DataFrame:
        return self.spark.table(self.name)

    def update(self, codebook: np.ndarray) -> np.ndarray:
        """Entries replaced by the floor of the mean of their residents; unused entries stay."""
        sums = self.frame().groupBy("pos", "entry").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in self.dims])
        codebook = codebook.copy()
        for r in sums.collect():  # positions x entries rows
            codebook[r["pos"], r["entry"]] = [r[c] // r["n"] for c in self.dims]
        return codebook

    def assigned(self, codebook: np.ndarray) -> DataFrame:
        """Residents with ``new`` (their entry under this codebook) and ``error``."""
        dims = self.dims

        def run(batches):
            for b in batches:
                pos = b.column("pos").to_numpy()
                x = np.stack([b.column(c).to_numpy() for c in dims], 1).astype(np.int64) if dims else np.zeros((len(pos), 0), np.int64)
                new, error = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
                for p in np.unique(pos):
                    at = np.flatnonzero(pos == p)
                    new[at], error[at] = nearest(x[at], codebook[p])
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(new.astype(np.int16)), pa.array(error)], names=[*b.schema.names, "new", "error"])

        return self.frame().mapInArrow(run, self.schema + ", new smallint, error bigint")

    def migrate(self, codebook: np.ndarray) -> None:
        """Residents stay in their bucket; those who change entry move to their new one."""
        found = self.assigned(codebook).drop("error")
        moving = found.where("new <> entry").withColumn("entry", F.col("new")).drop("new")
        self.write(found.where("new = entry").drop("new"), self.deal(moving))


def _place(rows: DataFrame, members: _Members, codebook: np.ndarray, buckets: int) -> DataFrame:
    """Members of all rows with their first entry; the part at position 0 carries id and label."""
    width, schema = members.width, members.schema
    parts, dims = codebook.shape[0], [f"c{i}" for i in range(width)]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK_ROWS):
                b = whole.slice(start, CHUNK_ROWS)
                x, number = _vectors(b.column("v"), parts * width), b.column("row").to_numpy()
                for p in range(parts):
                    part = x[:, p * width : (p + 1) * width]
                    entry, _ = nearest(part, codebook[p])
                    none = pa.nulls(len(number))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number), b.column("vec_id") if p == 0 else none.cast(pa.int64()),
                         b.column("label") if p == 0 else none.cast(b.schema.field("label").type), pa.array(np.full(len(number), p, np.int8)),
                         pa.array(entry.astype(np.int16)), pa.array((number % buckets).astype(np.int32)),
                         *[pa.array(part[:, i].astype(np.int32)) for i in range(width)]],
                        names=["row", "vec_id", "label", "pos", "entry", "salt", *dims])

    return rows.select("row", "vec_id", "label", "v").mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each row of ``quantized`` vectors, and the codebooks.

    Codebooks start from the smallest vec_ids (equal ids by vector, NULL ids last). Vectors end
    in zeros up to the next multiple of ``parts`` of the longest one. Repeated rows each count
    and each get a row. Fewer rows than entries make a smaller codebook. ``code`` has the entry
    indexes in part order, two hex digits each.
    """
    spark = vectors.sparkSession
    vectors = materialize(vectors.withColumn("row", F.monotonically_increasing_id()))
    n, longest = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    width = -(-(longest or 0) // parts)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    seeds = _vectors(first.column("v").combine_chunks(), parts * width) if n else np.zeros((0, parts * width), np.int64)
    codebook = np.ascontiguousarray(seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    buckets = n * parts // BUCKET_MEMBERS + spark.sparkContext.defaultParallelism
    label = vectors.schema["label"].dataType.simpleString()
    members = _Members(spark, buckets, width, label)
    if not n:
        return spark.createDataFrame([], f"vec_id bigint, label {label}, code string, error bigint"), codebook
    members.write(members.deal(_place(vectors, members, codebook, buckets)))
    for left in range(rounds, 0, -1):
        codebook = members.update(codebook)
        if left > 1:
            members.migrate(codebook)
    at = [f"p{p}" for p in range(parts)]
    rows = members.assigned(codebook).groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("error").alias("error"),
        *[F.max(F.when(F.col("pos") == p, F.col("new"))).alias(c) for p, c in enumerate(at)])
    code = F.concat(*[F.lower(F.lpad(F.hex(c), 2, "0")) for c in at])
    result = materialize(rows.select("vec_id", "label", code.alias("code"), "error"))
    members.drop(members.name, members.path)
    return result, codebook


def with_label_error(rows: DataFrame, key: str = "label") -> DataFrame:
    """``label_error``: the errors of all rows of the same label, NULLs together.

    Rows of a large label are dealt over as many salts as it needs, and its sum is copied to
    each. What counts as large grows with the table beyond rows / ``MANY_LABELS``, so there
    are at most that many large labels, and only their salts are broadcast.
    """
    rows = rows.withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")))
    sums = materialize(rows.groupBy("_k").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    bound = max(LABEL_ROWS, (sums.agg(F.sum("_n")).first()[0] or 0) // MANY_LABELS)
    salts = F.floor(F.col("_n") / bound).cast("bigint") + 1
    large = sums.where(F.col("_n") >= bound).select("_k", salts.alias("_salts"))
    salt = F.floor(F.rand(7) * F.coalesce("_salts", F.lit(1))).cast("bigint")
    dealt = rows.join(F.broadcast(large), "_k", "left").withColumn("_s", salt).drop("_salts")
    copies = sums.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_n")
    return dealt.join(copies, ["_k", "_s"]).drop("_k", "_s")


def codebook_digest(codebook: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebook.reshape(-1).tolist())).encode()).hexdigest()


def compress_embeddings(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row.

    Components beyond +-4,096 count as +-4,096. An empty table gives no rows.
    """
    rows, codebook = compress(quantized(embeddings))
    return with_label_error(rows).select(
        "vec_id", "code", "error", "label_error", F.lit(codebook_digest(codebook)).alias("codebooks_sha256"))
