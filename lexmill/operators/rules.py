"""Rules in force: validity intervals, as-of lookups, supersession, jurisdictions and recent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_force(start: Column, end: Column, day: Column) -> Column:
    """Whether day lies in an interval with inclusive ends; no end means open."""
    return (start <= day) & (end.isNull() | (end >= day))


def applicable(rules: DataFrame, day: str, scope: DataFrame | None = None, start_col: str = "start_date", end_col: str = "end_date", scope_col: str = "jurisdiction") -> DataFrame:
    """Rules in force on a day, in a scope of jurisdictions (column `ancestor`) if given. The day's bounds reach the scan as filters."""
    d = F.lit(day).cast("timestamp")
    found = rules.where(in_force(F.col(start_col), F.col(end_col), d))
    return found if scope is None else found.join(F.broadcast(scope.select("ancestor").distinct()), F.col(scope_col) == F.col("ancestor"), "left_semi")


def intervals_from_events(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Each event with the end of its validity: the next event's time of its key, open for the last one."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return events.withColumn("end_date", F.lead(at).over(w))


def latest_as_of(events: DataFrame, key: str, at: str, tie: str, day: str, columns: list[str]) -> DataFrame:
    """Each key's last event at or before a day, by an aggregate that combines before the shuffle."""
    picked = F.max_by(F.struct(*columns), F.struct(at, tie))
    return events.where(F.col(at) <= F.lit(day).cast("timestamp")).groupBy(key).agg(picked.alias("__last")).select(key, "__last.*")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    Both sides go through one shuffle on the key: the union is ordered by time, right rows first, and the last right values are carried on.
    """
    l = left.select(*left.columns, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values])
    r = right.select(F.col(key), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c != key], F.col(right_at).alias("__at"), F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    r = r.select(l.columns)
    w = Window.partitionBy(key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = l.unionByName(r).withColumn("__seen", F.last(F.when(F.col("__side") == 0, F.struct(*[f"__{v}" for v in values])), ignorenulls=True).over(w))
    return marked.where(F.col("__side") == 1).select(*left.columns, *[F.col(f"__seen.__{v}").alias(v) for v in values])


def superseded(rules: DataFrame, key: str, start_col: str) -> DataFrame:
    """from_start and to_start of each rule and the one of its key that follows it."""
    w = Window.partitionBy(key).orderBy(start_col)
    return rules.select(key, F.col(start_col).alias("from_start"), F.lead(start_col).over(w).alias("to_start")).where(F.col("to_start").isNotNull())


def keep_newest(rows: DataFrame, scope: str, at: str, tie: str, most: int) -> DataFrame:
    """The newest rows of each scope, for lists of recent items."""
    w = Window.partitionBy(scope).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def is_iso_date(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$")) & text.try_cast("date").isNotNull()


def current_flags(rows: DataFrame, identity: str, edition: str) -> DataFrame:
    """Whether each row is of its identity's latest edition."""
    top = rows.groupBy(identity).agg(F.max(edition).alias("__top"))
    return rows.join(top, identity).withColumn("current", F.col(edition) == F.col("__top")).drop("__top")
