"""Registries of court rules as plain text: one row an order, rule edition or amendment, with its dates, status, identifier, topics and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import slug, stable_id

DATE = r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b"
#: What a registry's subcategories stand for.
KINDS = {"cjo": "ChiefJusticeOrder", "pjo": "PresidingJudgeOrder", "rule": "SupplementaryLocalRuleEdition", "out-of-cycle": "OutOfCycleAmendment"}
#: Topics by a word of the title, in order.
TOPICS = [
    ("emergency", "Emergency Closure"), ("closure", "Court Closure"), ("court operations", "Court Operations"), ("covid", "COVID-19"), ("remote", "Remote Proceedings"), ("pretrial release", "Pretrial Release"), ("fees", "Fees"), ("certified", "Certified Copies"),
    ("exemplified", "Certified Copies"), ("security screening", "Security Screening"), ("probate commissioner", "Probate Commissioner"), ("weapons", "Weapons"), ("landlord tenant", "Landlord Tenant Sealing"), ("immigration", "Immigration Enforcement"), ("ojcin", "OJCIN Fees"),
    ("face covering", "Face Coverings"), ("fed", "FED Extensions"), ("duii", "DUII Diversions"), ("vaccination", "Vaccination"), ("social distancing", "Social Distancing"), ("set aside", "Landlord Tenant Sealing"), ("seal eligible", "Landlord Tenant Sealing"),
]
DEFAULT_TOPIC = "Court Rules Registry"


def registry_date(text: Column) -> Column:
    """M/D/YYYY as an ISO date; null if it is none."""
    return F.date_format(F.try_to_timestamp(F.regexp_extract(text, r"^([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})$", 1), F.lit("M/d/yyyy")), "yyyy-MM-dd")


def jurisdiction_id(name: Column, state: str = "or:state") -> Column:
    """The id of a jurisdiction by its name: the state's own, an id as it is, a county without that word."""
    prefix = state.split(":")[0]
    n = F.lower(F.trim(name))
    return F.when(n == "statewide", state).when(n.isin("oregon", "or:state"), "or:state").when(n.startswith("or:"), n).otherwise(F.concat(F.lit(f"{prefix}:"), slug(F.regexp_replace(n, " county$", ""))))


def columns_of(line: Column) -> Column:
    """title, jurisdiction, subcategory, start and end of a line: parted by tabs, else by its first date and the words before it; null if it is neither."""
    tabs = F.transform(F.split(line, "\t"), lambda c: F.trim(c))
    dates = F.regexp_extract_all(line, F.lit(DATE), F.lit(0))
    before = F.trim(F.regexp_extract(line, f"^(.*?){DATE}", 1))
    words = r"^(.*)\s(\S+)\s(\S+)$"
    row = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("title", "jurisdiction", "subcategory", "start", "end"))])
    tabbed = row(*[F.get(tabs, F.lit(i)) for i in range(4)], F.coalesce(F.get(tabs, F.lit(4)), F.lit("")))
    spaced = row(*[F.trim(F.regexp_extract(before, words, i)) for i in (1, 2, 3)], F.get(dates, F.lit(0)), F.coalesce(F.get(dates, F.lit(1)), F.lit("")))
    return F.when(F.size(tabs) >= 4, tabbed).when((F.size(dates) > 0) & F.regexp_like(before, F.lit(words)), spaced)


def kind_of(subcategory: Column) -> Column:
    low = F.lower(F.trim(subcategory))
    named = F.array_join(F.transform(F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.initcap(w)), "")
    return reduce(lambda acc, kv: F.when(low == kv[0], kv[1]).otherwise(acc), KINDS.items(), named)


def identifier(title: Column, kind: Column) -> Column:
    """What an order or amendment is called, by its kind; null if its title doesn't say."""
    part = lambda p, head: F.when(F.regexp_like(title, F.lit(p)), F.concat(F.lit(head), F.regexp_extract(title, p, 1)))
    amended = F.nullif(F.concat_ws("; ", part(r"(?i)\bSLR\s+([0-9]+(?:\.[0-9]+)?)\b", "SLR "), F.when(F.contains(F.lower(title), F.lit("appendix b")), "Appendix B")), F.lit(""))
    return F.when(kind == "ChiefJusticeOrder", part(r"(?i)\bCJO\s+([0-9]{2,4}-[0-9]{3})\b", "CJO ")).when(kind == "PresidingJudgeOrder", part(r"(?i)\bPJO\s*([0-9]{2,4}(?:-[0-9]{3})?)\b", "PJO ")).when(kind == "OutOfCycleAmendment", amended)


def topics(title: Column) -> Column:
    """The topics of a title, in order and each once; a default one if no word tells."""
    low = F.lower(title)
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(word)), F.lit(topic)) for word, topic in TOPICS])))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_TOPIC)))


def entries(registries: DataFrame, id_col: str = "registry_id", text_col: str = "text", snapshot_col: str = "snapshot_date") -> tuple[DataFrame, DataFrame]:
    """The rows of registries' tables and the lines that could not be read.

    Rows: registry_id, row_index, title, jurisdiction_id, kind, bucket, start_date, end_date, date_status, flags (sorted), identifier,
    authority_document_id, topics and amends (the edition that an amendment changes). Lines before a section and headings are no rows.
    """
    lines = registries.select(F.col(id_col).alias("registry_id"), F.col(snapshot_col).alias("snapshot"), F.posexplode(F.split(text_col, "\r?\n")).alias("at", "raw")).withColumn("line", F.trim("raw")).where("line <> ''")
    section = F.when(F.lower("line") == "current and future rules", "current_future").when(F.lower("line") == "prior rules", "prior")
    along = Window.partitionBy("registry_id").orderBy("at")
    placed = lines.withColumn("section", section).withColumn("bucket", F.last("section", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    heading = F.col("line").startswith("Description") & F.contains("line", F.lit("Effective Start Date"))
    table = placed.where(F.col("section").isNull() & F.col("bucket").isNotNull() & ~heading & (F.contains("raw", F.lit("\t")) | F.regexp_like("line", F.lit(DATE))))
    read = table.withColumn("c", columns_of(F.col("raw"))).withColumns({"start_date": registry_date(F.trim("c.start")), "end_date": registry_date(F.trim("c.end")), "kind": kind_of(F.col("c.subcategory"))})
    good = F.col("start_date").isNotNull() & ((F.trim(F.col("c.end")) == "") | F.col("end_date").isNotNull())
    fine = read.where(F.coalesce(good, F.lit(False)))
    status = F.when(F.col("start_date") > F.col("snapshot"), "future").when(F.col("end_date") < F.col("snapshot"), "expired").otherwise("current")
    named = fine.select("registry_id", F.row_number().over(along).alias("row_index"), F.col("c.title").alias("title"), jurisdiction_id(F.col("c.jurisdiction")).alias("jurisdiction_id"), "kind", "bucket", "start_date", "end_date", status.alias("date_status"))
    k = F.col("kind")
    flags = F.array_sort(F.array_compact(F.array(F.col("date_status"), F.when(F.col("bucket") == "prior", "prior"), F.when(F.col("end_date").isNull(), "open_ended"), F.when(F.col("end_date") == F.col("start_date"), "one_day_only"), F.when(k == "OutOfCycleAmendment", "out_of_cycle"))))
    told = named.withColumns({"flags": flags, "identifier": identifier(F.col("title"), k), "topics": topics(F.col("title"))})
    edition = F.concat("jurisdiction_id", F.lit(":slr@"), F.left("start_date", F.lit(4)))
    plain = F.concat_ws(":", "jurisdiction_id", F.lower("kind"), slug(F.concat_ws(" ", "title", "start_date")))
    document = F.when(k == "SupplementaryLocalRuleEdition", edition).when(F.col("identifier").isNotNull(), F.concat("jurisdiction_id", F.lit(":"), F.replace(F.lower("identifier"), F.lit(" "), F.lit(":")))).otherwise(plain)
    rows = told.withColumns({"authority_document_id": document, "amends": F.when(k == "OutOfCycleAmendment", edition)})
    return rows, read.where(~F.coalesce(good, F.lit(False))).select("registry_id", "at", "line")


def intervals(rows: DataFrame) -> DataFrame:
    """effective_interval_id, authority_document_id, start_date and end_date of each entry."""
    return rows.select(F.concat(F.lit("effective_interval:"), stable_id(F.col("authority_document_id"))).alias("effective_interval_id"), "authority_document_id", "start_date", "end_date")


def supersessions(rows: DataFrame) -> DataFrame:
    """src, dst, reason and confidence: each rule edition and the one before it in its jurisdiction, and orders whose titles say what they supersede, once a pair."""
    editions = rows.where("kind = 'SupplementaryLocalRuleEdition'").select("registry_id", "jurisdiction_id", F.left("start_date", F.lit(4)).alias("year"), F.col("authority_document_id").alias("src"))
    older = F.lead("src").over(Window.partitionBy("registry_id", "jurisdiction_id").orderBy(F.desc("year")))
    annual = editions.distinct().withColumn("dst", older).where("dst is not null and src <> dst").select("src", "dst", F.lit("edition sequence").alias("reason"), F.lit(0.95).alias("confidence"))
    said = rows.select(F.col("authority_document_id").alias("src"), F.explode(F.regexp_extract_all("title", F.lit(r"(?i)supersed(?:e|ing)\s+CJO\s+([0-9]{2,4}-[0-9]{3})"), F.lit(1))).alias("n"))
    known = rows.where("identifier is not null").groupBy(F.lower("identifier").alias("i")).agg(F.max_by("authority_document_id", "row_index").alias("dst"))
    stated = said.join(known, F.concat(F.lit("cjo "), F.lower("n")) == F.col("i")).select("src", "dst", F.lit("title states supersession").alias("reason"), F.lit(0.9).alias("confidence"))
    return annual.union(stated).groupBy("src", "dst").agg(F.max_by("reason", "confidence").alias("reason"), F.max("confidence").alias("confidence"))


def with_superseded(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with `superseded` among the flags of documents that an edge supersedes."""
    gone = edges.select(F.col("dst").alias("authority_document_id"), F.lit(True).alias("__gone")).distinct()
    joined = rows.join(gone, "authority_document_id", "left")
    return joined.withColumn("flags", F.when(F.col("__gone"), F.array_sort(F.array_union("flags", F.array(F.lit("superseded"))))).otherwise(F.col("flags"))).drop("__gone")
