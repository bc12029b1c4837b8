"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a key bitmap: for each key, at least, and at most (16 MB).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 15, 1 << 27
#: Bytes of an Arrow batch that a worker gets, and rows that the Parquet reader unpacks at a time; Spark's own limits, 64 MB and 4,096, take whole partitions of long texts.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which has one machine, may go without."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts the lineage: a lost executor loses nothing.

    instead_of: a table that this function returned and nothing reads any more; it is deleted. What is left goes with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(target)
    if instead_of is not None:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(instead_of.stored_at), True)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def two_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so further columns of any name do no harm."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow, for tables of whole texts: batches of about BATCH_BYTES, so that neither the executor nor its workers hold a partition's texts at once.

    Spark reads these limits when the result is computed, so they stay set in the session; no result depends on them.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def in_slices(column, most_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """An Arrow text column's values as UTF-8, in lists of about most_bytes (a longer text stands alone), so that a batch is never copied whole. Null is empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield [t or b"" for t in column.slice(at, upto - at).to_pylist()]
        at = upto


def positions(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bitmap(keys: DataFrame, key: Column) -> tuple[DataFrame, int]:
    """A bitmap of hashed keys as rows (__block, __bitmap) of 32,768 bits, and its number of bits: 32 a key or more, up to MOST_BITS, a size that can always be broadcast."""
    bits = LEAST_BITS
    n = keys.count()
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2
    at = keys.select(positions(key, bits).alias("at"))
    rows = at.groupBy(F.shiftright("at", 15).alias("__block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(LEAST_BITS - 1))).alias("__bitmap"))
    return rows, bits


def parted(df: DataFrame, key: Column, keys: DataFrame, of: Column) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose key may be in keys (by a bitmap of their hashes), and rows whose key surely isn't.

    Only the first part, the keys' own rows and a few others, has to be joined with keys exactly; the bulk of a wide table is never
    shuffled. keys is a stored table, `of` the key in it. The plan is the same at every size; with more than four million keys
    the bitmap's fixed size lets more of the others through.
    """
    rows, bits = key_bitmap(keys, of)
    at = positions(key, bits)
    marked = df.withColumn("__at", at).join(F.broadcast(rows), F.shiftright("__at", 15) == F.col("__block"), "left")
    inside = F.col("__at").bitwiseAND(F.lit(LEAST_BITS - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("__bitmap", F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, inside.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return marked.where(may).select(*df.columns), marked.where(~may).select(*df.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, max_rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """At most about max_rows whole labelled texts for fitting, as (text, label), with at most max_bytes of text in all.

    train: the condition on doc_id that a row must meet. The rows are chosen by a hash of doc_id, each class to at most half of
    max_rows (a class with fewer gives all it has); an id with several texts gives one. Texts are taken in the order of that hash as
    long as they fit in max_bytes, whatever their length; one that doesn't fit any more is passed over. The sample is ordered by doc_id. Only
    it reaches the driver.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & train).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    order = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    cut = F.lit(False)
    for value, n in counts.items():
        cut |= (F.col("label") == value) & (order < int(scale * min(1.0, max_rows / 2 / n)))
    chosen = rows.where(cut)
    text = F.coalesce("text", F.lit(""))
    found = two_columns(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min_by(text, F.xxhash64("text")).alias("text"))
    stored = materialize(found.withColumns({"bytes": F.octet_length("text"), "order": order}), "sample")
    left, taken = max_bytes, []
    for r in stored.select("doc_id", "bytes").orderBy("order", "doc_id").collect():
        if r["bytes"] <= left:
            left -= r["bytes"]
            taken.append(r["doc_id"])
    return [(r["text"], r["label"]) for r in stored.where(F.col("doc_id").isin(taken)).orderBy("doc_id").select("text", "label").collect()]
