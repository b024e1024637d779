"""From accepted events to memories: the first definition of an id wins, a later different one is a diagnostic, drops are tombstones in any order.

Ids belong to a producer in a session. The fold is expressed as aggregates over exploded definitions, so a session's history needs no single task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import exprs as X

SESSION = ["source_kind", "source_session_id"]
MAX_DIAGNOSTICS = 100

_ENTRY = "struct<streamId:string,entryId:string>"
_EVENT = (
    "struct<eventId:string,producer:struct<id:string,version:string>,observations:array<struct<id:string,content:string,timestamp:string,relevance:string,tokenCount:double,"
    f"sourceEntries:array<{_ENTRY}>>>,reflections:array<struct<id:string,content:string,tokenCount:double,supportingObservationIds:array<string>>>,observationIds:array<string>>"
)
_CITED = "array<struct<stream_id:string,entry_id:string>>"
OBSERVATION = ["content", "timestamp", "relevance", "token_count", "source_entries"]
REFLECTION = ["content", "token_count", "supporting_observation_ids"]


@dataclass
class Memories:
    observations: DataFrame
    reflections: DataFrame
    diagnostics: DataFrame


def definitions(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observation definitions, reflection definitions, drops) of classified records with record_id."""
    ok = records.where("semantic_status = 'accepted'").withColumn("e", F.from_json("raw_json", _EVENT))
    ok = ok.select(*SESSION, F.col("producer_id").alias("producer"), "ordinal", "record_id", "kind", "e")
    base = [*SESSION, "producer", F.lit(1).alias("origin"), "ordinal", "at"]
    made = [F.col("e.producer.version").alias("producer_version"), F.col("m.id").alias("memory_id"), F.col("e.eventId").alias("recording_event_id"), "record_id", F.lit(None).cast("string").alias("recording_entry_id")]
    o = ok.where("kind = 'observations.recorded'").select("*", F.posexplode("e.observations").alias("at", "m"))
    cited = F.transform("m.sourceEntries", lambda s: F.struct(s["streamId"].alias("stream_id"), s["entryId"].alias("entry_id"))).cast(_CITED)
    o = o.select(*base, *made, F.col("m.content").alias("content"), F.col("m.timestamp").alias("timestamp"), F.col("m.relevance").alias("relevance"), F.col("m.tokenCount").alias("token_count"), cited.alias("source_entries"))
    r = ok.where("kind = 'reflections.recorded'").select("*", F.posexplode("e.reflections").alias("at", "m"))
    r = r.select(*base, *made, F.col("m.content").alias("content"), F.col("m.tokenCount").alias("token_count"), F.col("m.supportingObservationIds").alias("supporting_observation_ids"))
    d = ok.where("kind = 'observations.dropped'").select(*SESSION, "producer", F.explode("e.observationIds").alias("memory_id"))
    return o, r, d


def embedded(entries: DataFrame, user_id: str, producer: str, order: int = 0) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Memory entries inside a session log: (observations, reflections, drops, diagnostics).

    entries(source_kind, source_session_id, ordinal, entry_id, raw_json): records ``type: custom`` of three kinds; their version is schemaVersion, else version, else 1.
    """
    e = entries.withColumn("v", F.try_parse_json("raw_json"))
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    e = e.where(get("$.type") == "custom").withColumn("custom", get("$.customType"))
    kinds = {"om.observations.recorded": "observations", "om.reflections.recorded": "reflections", "om.observations.dropped": "observationIds"}
    e = e.where(F.col("custom").isin(*kinds))
    version = F.coalesce(get("$.data.schemaVersion", "double"), get("$.data.version", "double"), F.lit(1.0))
    item = "array<struct<id:string,content:string,timestamp:string,relevance:string,tokenCount:double,sourceEntryIds:array<string>,supportingObservationIds:array<string>>>"
    data = F.from_json("raw_json", f"struct<data:struct<coversUpToId:string,observations:{item},reflections:{item},observationIds:array<string>>>")["data"]
    e = e.withColumn("d", data).withColumn("version", version)
    number = lambda c: c.isNotNull() & (c >= 0)
    ids = lambda a: F.coalesce((F.size(a) >= 1) & F.forall(a, lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))), F.lit(False))
    text = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    obs_ok = lambda m: X.memory_id_ok(m["id"]) & text(m["content"]) & text(m["timestamp"]) & F.coalesce(m["relevance"].isin("low", "medium", "high", "critical"), F.lit(False)) & ids(m["sourceEntryIds"]) & F.coalesce(number(m["tokenCount"]), F.lit(False))
    ref_ok = lambda m: X.memory_id_ok(m["id"]) & text(m["content"]) & ~F.coalesce(m["content"].rlike("[\\r\\n]"), F.lit(False)) & ids(m["supportingObservationIds"]) & F.coalesce(number(m["tokenCount"]), F.lit(False))
    shape = (
        F.when(F.col("custom") == "om.observations.recorded", F.coalesce(F.forall("d.observations", obs_ok), F.lit(False)))
        .when(F.col("custom") == "om.reflections.recorded", F.coalesce(F.forall("d.reflections", ref_ok), F.lit(False)))
        .otherwise(ids(F.col("d.observationIds")))
    )
    reason = F.when(F.col("version") != 1, "unsupported-version").when(~(text(F.col("d.coversUpToId")) & shape), "invalid-record")
    e = e.withColumn("reason", reason)
    bad = e.where("reason is not null").select(*SESSION, F.lit(producer).alias("producer"), "ordinal", F.col("entry_id").alias("record_id"), "reason")
    good = e.where("reason is null")
    event = X.synthetic_event_id(F.lit(user_id), F.col("source_kind"), F.col("source_session_id"), F.lit(producer), F.col("entry_id"))
    base = [*SESSION, F.lit(producer).alias("producer"), F.lit(order).alias("origin"), "ordinal", "at"]
    made = [F.lit(None).cast("string").alias("producer_version"), F.col("m.id").alias("memory_id"), event.alias("recording_event_id"), F.lit(None).cast("string").alias("record_id"), F.col("entry_id").alias("recording_entry_id")]
    o = good.where("custom = 'om.observations.recorded'").select("*", F.posexplode("d.observations").alias("at", "m"))
    cited = F.transform("m.sourceEntryIds", lambda s: F.struct(F.lit("main").alias("stream_id"), s.alias("entry_id"))).cast(_CITED)
    o = o.select(*base, *made, F.col("m.content").alias("content"), F.col("m.timestamp").alias("timestamp"), F.col("m.relevance").alias("relevance"), F.col("m.tokenCount").alias("token_count"), cited.alias("source_entries"))
    r = good.where("custom = 'om.reflections.recorded'").select("*", F.posexplode("d.reflections").alias("at", "m"))
    r = r.select(*base, *made, F.col("m.content").alias("content"), F.col("m.tokenCount").alias("token_count"), F.col("m.supportingObservationIds").alias("supporting_observation_ids"))
    d = good.where("custom = 'om.observations.dropped'").select(*SESSION, F.lit(producer).alias("producer"), F.explode("d.observationIds").alias("memory_id"))
    return o, r, d, bad


def first_definitions(rows: DataFrame, fields: list[str], what: str) -> tuple[DataFrame, DataFrame]:
    """(the first definition of each id in order of origin, producer, ordinal and place; diagnostics of later ones that differ in any field)."""
    key = [*SESSION, "producer", "memory_id"]
    place = F.struct("origin", "ordinal", "at")
    body = F.struct(*[c for c in rows.columns if c not in key])
    first = rows.groupBy(*key).agg(F.min_by(body, place).alias("b"))
    winners = first.select(*key, "b.*")
    meant = F.sha2(F.to_json(F.struct(*fields)).cast("binary"), 256)
    later = rows.select(*key, "origin", "ordinal", "at", "record_id", meant.alias("meant")).join(winners.select(*key, meant.alias("first")), key).where("meant <> first")
    return winners, later.select(*SESSION, "producer", "origin", "ordinal", "at", "record_id", "memory_id", F.lit("conflicting-memory-definition").alias("reason"), F.lit(what).alias("memory_kind"))


def fold(records: DataFrame, embedded_parts: list[tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = ()) -> Memories:
    """Observations (with dropped), reflections and at most 100 diagnostics a session, of classified records and of embedded memories."""
    o, r, d = definitions(records)
    notes = records.where(~F.col("semantic_status").isin("accepted", "replay")).select(*SESSION, F.col("producer_id").alias("producer"), F.lit(1).alias("origin"), "ordinal", F.lit(0).alias("at"), "record_id", F.lit(None).cast("string").alias("memory_id"), F.explode("diagnostics").alias("reason"), F.lit(None).cast("string").alias("memory_kind"))
    for eo, er, ed, bad in embedded_parts:
        o, r, d = o.unionByName(eo), r.unionByName(er), d.unionByName(ed)
        notes = notes.unionByName(bad.select("*", F.lit(0).alias("origin"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("memory_id"), F.lit(None).cast("string").alias("memory_kind")))
    obs, bad_o = first_definitions(o, OBSERVATION, "observation")
    ref, bad_r = first_definitions(r, REFLECTION, "reflection")
    gone = d.distinct().withColumn("_gone", F.lit(True))
    obs = obs.join(gone, [*SESSION, "producer", "memory_id"], "left").withColumn("dropped", F.coalesce("_gone", F.lit(False))).drop("_gone")
    return Memories(obs, ref, capped(notes.unionByName(bad_o).unionByName(bad_r)))


def capped(diagnostics: DataFrame, most: int = MAX_DIAGNOSTICS) -> DataFrame:
    w = Window.partitionBy(*SESSION).orderBy("origin", "producer", "ordinal", "at", "reason")
    return diagnostics.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def with_urns(memories: DataFrame, user: Column, what: str) -> DataFrame:
    return memories.withColumn("id", X.memory_urn(what, user, F.col("source_kind"), F.col("source_session_id"), F.col("producer"), F.col("memory_id")))


def unresolved(observations: DataFrame, reflections: DataFrame, entries: DataFrame) -> DataFrame:
    """Citations of entries that are not there and supports without an observation of the same producer."""
    cites = observations.select(*SESSION, "producer", "memory_id", F.explode("source_entries").alias("s")).select("*", "s.stream_id", "s.entry_id").drop("s")
    lost = cites.join(entries.select(*SESSION, F.coalesce("stream_id", F.lit("main")).alias("stream_id"), "entry_id"), [*SESSION, "stream_id", "entry_id"], "left_anti")
    supports = reflections.select(*SESSION, "producer", "memory_id", F.explode("supporting_observation_ids").alias("observation_id"))
    loose = supports.join(observations.select(*SESSION, "producer", F.col("memory_id").alias("observation_id")), [*SESSION, "producer", "observation_id"], "left_anti")
    return lost.withColumn("reason", F.lit("unresolved-reference")).unionByName(loose.withColumn("reason", F.lit("unresolved-reference")), allowMissingColumns=True)
