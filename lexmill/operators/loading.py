"""Loads: first-row dedupe, combining sources, keyed upserts, snapshot differences, stale embeddings, release manifests."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """df over all cores if it is read in fewer parts than that, as a small file is; a large table stays as it is.

    most_rows: of a part on average, for work that takes long for a row; the rows are counted first, which a stored table's files tell.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if most_rows:
        n = max(n, -(-df.count() // most_rows))
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def slices(columns: list, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Where to cut a batch, so that its Arrow text columns have about most_bytes between two cuts (a longer row stands alone): only a slice is ever held as Python strings."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, side="right")))
        yield at, upto
        at = upto


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("__row")).select(*keys, "__row.*").select(df.columns)


def combine(tables: list[DataFrame]) -> DataFrame:
    """The distinct rows of tables with different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).distinct()


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new put in the place of those with the same key, and new keys added."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new.select(old.columns))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change (added, removed, changed) of rows that differ between two snapshots."""
    pack = lambda df, name: df.select(F.col(key), F.struct(*columns).alias(name))
    joined = pack(before, "was").join(pack(after, "is"), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return joined.select(key, change.alias("change")).where(F.col("change").isNotNull())


def embedding_state(rows: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and state of each row's embedding: current if the stored text hash is the row's, else stale, or pending without one."""
    digest = F.concat(F.lit("sha256:"), F.sha2(text_col, 256))
    joined = rows.select(F.col(id_col).alias("id"), digest.alias("hash")).join(known.select(F.col("id").alias("k"), F.col("hash").alias("stored")), F.col("id") == F.col("k"), "left")
    return joined.select("id", F.when(F.col("stored").isNull(), "pending").when(F.col("stored") == F.col("hash"), "current").otherwise("stale").alias("state"))


def content_digest(df: DataFrame) -> DataFrame:
    """rows and digest of a table: a hash of its rows that doesn't depend on their order, without bringing them together."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows and digest of each table of a release."""
    return reduce(DataFrame.unionByName, [content_digest(df).select(F.lit(name).alias("name"), "rows", "digest") for name, df in sorted(tables.items())])


def row_identity(fields: list[Column], whole: Column) -> Column:
    """The first field that isn't blank as name:value, else a hash of the row."""
    named = [F.when(F.trim(f.cast("string")) != "", F.concat(F.lit(f"f{i}:"), F.trim(f.cast("string")))) for i, f in enumerate(fields)]
    return F.coalesce(*named, F.sha2(F.to_json(whole), 256))


def latest_by_window(df: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key with all its columns (for orders that an aggregate cannot compare)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
