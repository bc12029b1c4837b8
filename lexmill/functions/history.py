"""History notes on columns: effects in time, lineage between sections, session laws, intervals."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.extract import LONG_DATE, iso_date, long_dates
from lexmill.functions.text import stable_id

#: What shows each kind of effect in a note, in lower case.
EFFECTS = {
    "operative": ["becomes operative", "is operative", "become operative"],
    "effective": ["becomes effective", "takes effect", "effective date"],
    "repeal": ["repealed"],
    "sunset": ["sunset"],
    "applies_to": ["applies to"],
    "expires": ["expires", "expiration"],
    "retroactive": ["retroactive", "applies retroactively"],
    "delayed_effective": ["notwithstanding the effective date"],
}
#: Which column an effect's first date goes to.
DATE_COLUMNS = {"effective_date": ["effective"], "operative_date": ["operative"], "repeal_date": ["repeal"], "expiration_date": ["expires", "sunset"]}
SECTION = r"[0-9]{1,3}[A-Z]?\.[0-9]{3}"
LINEAGE = [("formerly", rf"(?i)formerly\s+(?:ORS\s+)?({SECTION})"), ("renumbered_to", rf"(?i)renumbered\s+(?:ORS\s+)?({SECTION})"), ("repealed_by", r"(?i)repealed by\s+([0-9]{4} c\.[0-9]+)")]
SESSION_LAW = r"\b([0-9]{4}) c\.([0-9]+)(?: §+([0-9]+))?"


def temporal_effects(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, effect_id, effect_type, first_date and the date in the column of its type, a row for each kind of effect that a note shows."""
    low = F.lower(text_col)
    shown = F.array_compact(F.array(*[F.when(reduce(or_, [F.contains(low, F.lit(p)) for p in phrases]), F.lit(kind)) for kind, phrases in EFFECTS.items()]))
    rows = notes.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.explode(shown).alias("effect_type"))
    date = iso_date(F.get(long_dates(F.col("t")), F.lit(0)))
    dated = rows.select("id", F.concat(F.lit("temporal_effect:"), stable_id(F.concat_ws("::", F.col("id").cast("string"), "effect_type", "t"))).alias("effect_id"), "effect_type", date.alias("first_date"))
    return dated.select("*", *[F.when(F.col("effect_type").isin(kinds), F.col("first_date")).alias(c) for c, kinds in DATE_COLUMNS.items()])


def lineage_events(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, lineage_type and other (section or law) of each formerly, renumbered and repealed-by phrase."""

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("lineage_type"), x.alias("other")))

    each = [named(kind, pattern) for kind, pattern in LINEAGE]
    return notes.select(F.col(id_col).alias("id"), F.explode(F.concat(*each)).alias("e")).select("id", "e.*")


def session_laws(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, citation, year and chapter of each session law of a note, once."""
    found = F.array_distinct(F.regexp_extract_all(text_col, F.lit(SESSION_LAW), F.lit(0)))
    rows = notes.select(F.col(id_col).alias("id"), F.explode(found).alias("citation"))
    return rows.select("id", "citation", F.regexp_extract("citation", SESSION_LAW, 1).try_cast("int").alias("year"), F.regexp_extract("citation", SESSION_LAW, 2).try_cast("int").alias("chapter"))


def time_intervals(notes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and start_date of every long date in a note."""
    return notes.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(LONG_DATE), F.lit(0))).alias("d")).select("id", iso_date(F.col("d")).alias("start_date"))


def status_of(text: Column) -> Column:
    """Repealed, renumbered or active, by what a status line says."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("repealed")), "repealed").when(F.contains(low, F.lit("renumbered")), "renumbered").otherwise("active")
