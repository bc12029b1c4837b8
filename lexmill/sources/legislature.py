"""Rows of a legislative data service: measures, sponsors, votes and meetings from loosely named fields, with diagnostics for missing keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import first_value, service_date, value_bool


@dataclass(frozen=True)
class Entity:
    """An entity set: the parts of its key and its fields, each with the names that it may come under; and links (edge type, key parts of the target)."""

    kind: str
    key: dict[str, tuple[str, ...]]
    fields: dict[str, tuple[str, ...]]
    dates: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    links: tuple[tuple[str, str, tuple[str, ...]], ...] = ()


SESSION = ("SessionKey", "Session", "sessionKey")
PREFIX, NUMBER = ("MeasurePrefix", "Prefix"), ("MeasureNumber", "MeasureNo", "Number")
MEASURE = {"session": SESSION, "prefix": PREFIX, "number": NUMBER}
ENTITIES = {
    "sessions": Entity("session", {"session": SESSION}, {"name": ("SessionName", "Name"), "begins": ("BeginDate",), "ends": ("EndDate",)}, dates=("begins", "ends")),
    "measures": Entity("measure", MEASURE, {"title": ("CatchLine", "RelatingTo", "Title"), "status": ("CurrentLocation", "Status"), "emergency": ("EmergencyClause",)}, flags=("emergency",), links=(("IN_SESSION", "session", ("session",)),)),
    "documents": Entity("measure_document", MEASURE | {"version": ("VersionDescription", "Version")}, {"url": ("DocumentUrl", "Url"), "created": ("CreatedDate",)}, dates=("created",), links=(("VERSION_OF", "measure", ("session", "prefix", "number")),)),
    "history": Entity("measure_action", MEASURE | {"action": ("MeasureHistoryId", "Id")}, {"text": ("ActionText", "Action"), "acted": ("ActionDate", "Date"), "chamber": ("Chamber",)}, dates=("acted",), links=(("ACTION_ON", "measure", ("session", "prefix", "number")),)),
    "sponsors": Entity("sponsorship", MEASURE | {"sponsor": ("LegislatoreCode", "LegislatorCode", "CommitteeCode")}, {"level": ("SponsorLevel", "Level")}, links=(("SPONSORS", "measure", ("session", "prefix", "number")),)),
    "committees": Entity("committee", {"session": SESSION, "committee": ("CommitteeCode", "Code")}, {"name": ("CommitteeName", "Name")}, links=(("IN_SESSION", "session", ("session",)),)),
    "legislators": Entity("legislator", {"session": SESSION, "legislator": ("LegislatorCode", "Code")}, {"name": ("LastName", "Name"), "party": ("Party",), "chamber": ("Chamber",)}, links=(("IN_SESSION", "session", ("session",)),)),
    "meetings": Entity("meeting", {"session": SESSION, "committee": ("CommitteeCode",), "held": ("MeetingDate", "Date")}, {"place": ("Location", "Room")}, links=(("HELD_BY", "committee", ("session", "committee")),)),
    "votes": Entity("vote", MEASURE | {"voter": ("VoteName", "LegislatorCode"), "action": ("MeasureHistoryId", "Id")}, {"vote": ("Vote",)}, links=(("VOTE_ON", "measure", ("session", "prefix", "number")),)),
}


def field(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the names that the rows have and that isn't blank."""
    there = [F.col(f"`{n}`") for n in names if n in rows.columns]
    return first_value(*there) if there else F.lit(None).cast("string")


def entity_rows(rows: DataFrame, entity: Entity) -> DataFrame:
    """id, key parts and fields of each row; rows without a whole key have a null id."""
    parts = {k: field(rows, names) for k, names in entity.key.items()}
    values = {k: field(rows, names) for k, names in entity.fields.items()}
    values |= {k: service_date(values[k]) for k in entity.dates} | {k: value_bool(values[k]) for k in entity.flags}
    whole = F.concat_ws(":", F.lit(entity.kind), *[F.lower(p) for p in parts.values()])
    missing = F.lit(False)
    for p in parts.values():
        missing |= p.isNull()
    return rows.select(F.when(~missing, whole).alias("id"), *[v.alias(k) for k, v in (parts | values).items()])


def entities(rows: DataFrame, name: str) -> DataFrame:
    """The entities with a whole key, each once."""
    return entity_rows(rows, ENTITIES[name]).where("id IS NOT NULL").dropDuplicates(["id"])


def entity_edges(rows: DataFrame, name: str) -> DataFrame:
    """src, dst and type of the entities' links."""
    entity = ENTITIES[name]
    found = entities(rows, name)
    links = F.array(*[F.struct(F.concat_ws(":", F.lit(target), *[F.lower(k) for k in keys]).alias("dst"), F.lit(kind).alias("type")) for kind, target, keys in entity.links])
    return found.select(F.col("id").alias("src"), F.explode(links).alias("l")).select("src", "l.dst", "l.type").distinct()


def diagnostics(rows: DataFrame, name: str) -> DataFrame:
    """One row: rows of the set without a whole key."""
    return entity_rows(rows, ENTITIES[name]).agg(F.count_if(F.col("id").isNull()).alias("without_key"), F.count("*").alias("rows"))
