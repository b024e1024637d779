"""Inspection of event envelopes in the JVM: each record is parsed once as a variant, and one chain of conditions in the protocol's order gives the first rule it breaks.

The variant's text is the canonical form (keys in UTF-16 order, no blanks) for records whose canonical form holds nothing that the two write differently. Records of which that is not
certain - numbers that are no short integers, ``\\u`` and ``\\/`` escapes, keys that stand twice, text behind the value, timestamps of unusual form, what does not parse - go through
``sidecar.inspect``, the definition; of the others Python sees nothing but nulls.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from annalist.operators.sidecar import KINDS, LOG, RELEVANCE, SAFE_INTEGER, Locator, inspect

CHECKPOINT = ArrayType(StructType([StructField("streamId", StringType()), StructField("committedBytes", LongType()), StructField("prefixSha256", StringType())]))
INSPECTED = StructType([*(StructField(n, StringType()) for n in ("reason", "event_id", "event_hash", "kind")), StructField("checkpoint", CHECKPOINT)])


def _items(v: Column, path: str, items: str) -> Column:
    """What stands at a path as a list, read to its last field at once; an item that is no object where one is meant is null, and no list is an empty one."""
    return F.coalesce(F.try_variant_get(v, path, f"array<{items}>"), F.array().cast(f"array<{items}>"))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def _whole(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "BIGINT", v.cast("long"))


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _within(s: Column, low: int, high: int) -> Column:
    return F.octet_length(s).between(low, high)


def _host(s: Column) -> Column:
    return _is(_within(s, 1, 512) & ~s.rlike(r"[\x00-\x1f\x7f]"))


def _memory(s: Column) -> Column:
    return _is(s.rlike(r"\A[a-f0-9]{12}\z"))


def _protocol(s: Column) -> Column:
    return _is(s.rlike(r"\A[a-z0-9][a-z0-9._-]{0,127}\z"))


def _usual_time(s: Column) -> Column:
    return _is(_within(s, 1, 64) & s.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z\z") & F.try_to_timestamp(s).isNotNull())


def _odd_time(s: Column) -> Column:
    """Neither plainly a timestamp nor plainly none."""
    return _is(_within(s, 1, 64) & s.endswith("Z")) & ~_usual_time(s)


def _listed(items: Column, check, key) -> Column:
    """1 to 256 valid items, none twice."""
    keys = F.transform(items, key)
    return _is(F.size(items).between(1, 256) & F.forall(items, check) & (F.size(F.array_distinct(keys)) == F.size(keys)))


# What lists hold, with each field read once: texts and whole numbers are null where the value is of another type.

STREAM = "struct<streamId:variant,committedBytes:variant,prefixSha256:variant,selectedLeafEntryId:variant>"
MEMORY = "struct<id:variant,content:variant,timestamp:variant,relevance:variant,tokenCount:variant,sourceEntries:array<struct<streamId:variant,entryId:variant>>,supportingObservationIds:array<variant>>"


def _streams(streams: Column) -> Column:
    leaf = lambda f: F.when(f["selectedLeafEntryId"].isNull(), F.lit("")).when(~F.is_variant_null(f["selectedLeafEntryId"]), F.coalesce(_text(f["selectedLeafEntryId"]), F.lit("")))  # noqa: E731  null: none, empty: not valid
    return F.transform(streams, lambda f: F.struct(_text(f["streamId"]).alias("streamId"), _whole(f["committedBytes"]).alias("committedBytes"), _text(f["prefixSha256"]).alias("prefixSha256"), leaf(f).alias("leaf")))


def _valid_stream(s: Column) -> Column:
    return _is(_host(s["streamId"]) & s["committedBytes"].between(0, SAFE_INTEGER) & s["prefixSha256"].rlike(r"\A[a-f0-9]{64}\z") & (s["leaf"].isNull() | _host(s["leaf"])))


def _cited(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(_text(e["streamId"]).alias("s"), _text(e["entryId"]).alias("e")))


def _memories(items: Column) -> Column:
    """Observations and reflections alike; of the fields that one of them lacks, the lists are null."""
    typed = lambda f: F.struct(
        *[_text(f[c]).alias(c) for c in ("id", "content", "timestamp", "relevance")], _whole(f["tokenCount"]).alias("tokenCount"),
        _cited(f["sourceEntries"]).alias("cited"), F.transform(f["supportingObservationIds"], _text).alias("supports"),
    )
    return F.transform(items, typed)


def _content(m: Column) -> Column:
    return _memory(m["id"]) & _is(_within(m["content"], 1, 65536) & m["tokenCount"].between(0, SAFE_INTEGER))


def _valid_observation(m: Column, names: Column) -> Column:
    cited = lambda c: _host(c["s"]) & _host(c["e"]) & _is(F.array_contains(names, F.coalesce(c["s"], F.lit(""))))
    return _is(_content(m) & _usual_time(m["timestamp"]) & _is(m["relevance"].isin(*RELEVANCE)) & _listed(m["cited"], cited, lambda c: c))


def _valid_reflection(m: Column) -> Column:
    return _is(_content(m) & ~m["content"].rlike(r"[\r\n]") & _listed(m["supports"], _memory, lambda x: x))


@F.pandas_udf(INSPECTED)
def _inspected(raw: pd.Series, kind: pd.Series, session: pd.Series, producer: pd.Series) -> pd.DataFrame:
    """The definition, for the records that are handed on; null for the others."""
    out = {n: [None] * len(raw) for n in INSPECTED.names}
    asked = raw.notna().to_numpy().nonzero()[0]
    for i, r, *key in zip(asked, *(c.iloc[asked] for c in (raw, kind, session, producer)), strict=True):
        e = inspect(r, Locator(*key))
        streams = [{"streamId": s["streamId"], "committedBytes": int(s["committedBytes"]), "prefixSha256": s["prefixSha256"]} for s in e.get("checkpoint") or ()]
        for n, v in zip(INSPECTED.names, (next(iter(e.get("diagnostics", ())), None), e.get("event_id"), e.get("event_hash"), e.get("kind"), streams or None), strict=True):
            out[n][i] = v
    return pd.DataFrame(out, columns=INSPECTED.names, dtype=object)


def inspected(records: DataFrame) -> DataFrame:
    """records(source_kind, source_session_id, producer_id, ordinal, raw_json) -> the same with reason (the first rule that the record breaks by itself; null: none), event_id, event_hash, kind and
    checkpoint, all four null where there is a reason. What ``sidecar.inspect`` says of each record. A null record is malformed."""
    top = "struct<protocolVersion:variant,eventId:variant,kind:variant,producer:struct<id:variant,version:variant>,source:struct<kind:variant,sessionId:variant>,recordedAt:variant,observations:variant,reflections:variant,observationIds:variant>"
    rows = records.select(*LOG, "ordinal", "raw_json", F.try_parse_json("raw_json").alias("v"))
    rows = rows.withColumns({"e": F.try_variant_get("v", "$", top), "text": F.to_json("v")})

    def bare(c: Column, blanks: str = " \t\r\n") -> Column:
        for blank in blanks:
            c = F.replace(c, F.lit(blank))
        return F.octet_length(c)

    # a text behind the value, or an escape that need not be one, makes the record longer than its canonical form, as blanks do (of which that form escapes all but spaces)
    whole = F.when(F.octet_length("raw_json") == F.octet_length("text"), F.lit(True)).otherwise(bare(F.col("raw_json")) == bare(F.col("text"), " "))
    # numbers stand behind a key's colon, in a list, or alone; the character before one is looked for first
    long = r"-?[0-9]+(?:[.eE]|(?<=[0-9]{16}))"
    unsure = F.col("text").rlike(r'[:,\[](?<=":|[\[,])' + long) | (~F.startswith("text", F.lit("{")) & F.col("text").rlike(r"\A" + long))
    plain = F.col("v").isNotNull() & ~F.contains("raw_json", F.lit("\\u")) & whole & ~unsure
    v = F.col("v")
    rows = rows.select(
        *LOG, "ordinal", "raw_json", "text", "e", _is(plain).alias("plain"), _streams(_items(v, "$.sourceCheckpoint.streams", STREAM)).alias("streams"),
        _memories(_items(v, "$.observations", MEMORY)).alias("observations"), _memories(_items(v, "$.reflections", MEMORY)).alias("reflections"), F.transform(_items(v, "$.observationIds", "variant"), _text).alias("observationIds"),
        F.col("e.producer").alias("producer"), F.col("e.source").alias("source"), _text(F.col("e.kind")).alias("kind_"), _text(F.col("e.recordedAt")).alias("at"),
    )
    rows = rows.withColumns({
        "names": F.transform("streams", lambda s: s["streamId"]), "timely": _usual_time(F.col("at")), "event": _text(F.col("e.eventId")),
        "producer": F.struct(_text(F.col("producer.id")).alias("id"), _text(F.col("producer.version")).alias("version")), "source": F.struct(_text(F.col("source.kind")).alias("kind"), _text(F.col("source.sessionId")).alias("sessionId")),
    })
    odd = ~F.col("timely") & _odd_time(F.col("at")) | F.exists("observations", lambda m: _odd_time(m["timestamp"])) | F.exists("names", lambda n: _is(n.rlike(r"[\x{10000}-\x{10FFFF}]")))
    own = {k: F.lit(True) if f is None else {
        "observations": _listed(F.col("observations"), lambda m: _valid_observation(m, F.col("names")), lambda m: m["id"]),
        "reflections": _listed(F.col("reflections"), _valid_reflection, lambda m: m["id"]),
        "observationIds": _listed(F.col("observationIds"), _memory, lambda x: x),
    }[f] for k, f in KINDS.items()}
    payload = F.lit(False)
    for k, f in KINDS.items():
        others = [F.col(f"e.{x}").isNull() for x in KINDS.values() if x and x != f]
        alone = others[0]
        for o in others[1:]:
            alone = alone & o
        payload = F.when(F.col("kind_") == k, alone & own[k]).otherwise(payload)
    valid = (
        _protocol(F.col("producer.id")) & _is(_within(F.col("producer.version"), 1, 128)) & _listed(F.col("streams"), _valid_stream, lambda s: s["streamId"]) & (F.col("names") == F.array_sort("names"))
        & _protocol(F.col("source.kind")) & _host(F.col("source.sessionId")) & _is(F.col("event").rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,255}\z")) & F.col("timely") & payload
    )
    reason = (
        F.when(F.col("e").isNull(), "invalid-envelope")
        .when(~_is(_whole(F.col("e.protocolVersion")) == 1), "unsupported-version")
        .when(~_is(F.col("kind_").isin(*KINDS)), "unsupported-kind")
        .when(~_is(valid), "invalid-envelope")
        .when(~_is(F.col("producer.id") == F.col("producer_id")), "producer-mismatch")
        .when(~_is((F.col("source.kind") == F.col("source_kind")) & (F.col("source.sessionId") == F.col("source_session_id"))), "source-mismatch")
    )
    checkpoint = F.transform("streams", lambda s: F.struct(s["streamId"].alias("streamId"), s["committedBytes"].alias("committedBytes"), s["prefixSha256"].alias("prefixSha256")))
    judged = rows.withColumns({"plain": F.col("plain") & ~odd, "reason": reason})
    judged = judged.withColumn("python", _inspected(F.when(~F.col("plain"), F.coalesce("raw_json", F.lit(""))), *LOG))
    sound = F.col("plain") & F.col("reason").isNull()
    pick = lambda jvm, name: F.when(F.col("plain"), F.when(sound, jvm)).otherwise(F.col(f"python.{name}")).alias(name)
    return judged.select(
        *LOG, "ordinal", "raw_json", F.when(F.col("plain"), F.col("reason")).otherwise(F.col("python.reason")).alias("reason"),
        pick(F.col("event"), "event_id"), pick(F.sha2(F.col("text").cast("binary"), 256), "event_hash"), pick(F.col("kind_"), "kind"), pick(checkpoint, "checkpoint"),
    )

