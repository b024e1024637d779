"""More queries over the driver's tables: rows are first turned into logs, events, graphs or runs of the engine's own shape, and then go through its operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.functions.canonical import canonical_json_udf, fingerprint_column
from annalist.operators import access, derive, evidence, memory, occasions, runs, scope, selection, sidecar, sync
from annalist.plans import catalog, projection
from annalist.plans.file_memory import Graph, file_memory
from annalist.plans.surrogates import Tables, n, query
from annalist.sources import spool

S = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
LIT = F.lit


def memory_hex(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 12)


# Canonical forms


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS event_hash FROM events""")
def canonical_event(t: Tables) -> DataFrame:
    c = canonical_json_udf(F.col("props"))
    return t.events.select("event_id", c.alias("canonical"), X.sha256(c).alias("event_hash"))


@query("SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}') AS fingerprint FROM part")
def snapshot_fingerprint(t: Tables) -> DataFrame:
    raw = F.concat(LIT('{"size":'), S("p_size"), LIT(',"brand":"'), F.col("p_brand"), LIT('"}'))
    return t.part.select("p_partkey", fingerprint_column(raw).alias("fingerprint"))


@query("SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS utf8_bytes, CAST(length(text) AS BIGINT) AS utf16_units FROM conversations")
def text_lengths(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.utf8_bytes("text").alias("utf8_bytes"), X.utf16_units("text").alias("utf16_units"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, o_orderkey % 3 <> 0 AS valid FROM orders")
def timestamp_validity(t: Tables) -> DataFrame:
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.orders.select("o_orderkey", stamp.alias("stamp"), X.timestamp_ok(F.when(F.col("o_orderkey") % 3 != 0, stamp).otherwise(F.translate(stamp, "Z", ""))).alias("valid"))


@query("""SELECT c_custkey, 'urn:annalist:observation:u:' || c_mktsegment || ':' || c_custkey AS observation_urn, 'urn:annalist:file:' || sha256(c_mktsegment || chr(0) || c_name) AS file_urn,
 'pi-' || sha256('u' || chr(0) || c_mktsegment || chr(0) || c_custkey || chr(0) || 'p' || chr(0) || c_name) AS event_id FROM customer""")
def graph_urns(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.memory_urn("observation", LIT("u"), F.col("c_mktsegment"), S("c_custkey")).alias("observation_urn"), X.file_urn(F.col("c_mktsegment"), F.col("c_name")).alias("file_urn"),
                             X.synthetic_event_id(LIT("u"), F.col("c_mktsegment"), S("c_custkey"), LIT("p"), F.col("c_name")).alias("event_id"))


# Logs


def session_lines(t: Tables) -> DataFrame:
    """A session log per conversation: session_id, content (header, then a line a turn, each the child of the one before)."""
    entry = F.concat(LIT('{"type":"message","id":"'), S("turn"), LIT('","parentId":'), F.when(F.col("turn") == 0, LIT("null")).otherwise(F.concat(LIT('"'), (F.col("turn") - 1).cast("string"), LIT('"'))),
                     LIT(',"message":{"role":"'), F.col("role"), LIT('","content":'), X.quoted("text"), LIT('}}\n'))
    lines = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda x: x["e"]), "").alias("body"))
    header = F.concat(LIT('{"type":"session","id":"'), S("conv_id"), LIT('"}\n'))
    return lines.select(S("conv_id").alias("path"), F.concat(header, F.col("body")).cast("binary").alias("content"))


_LINES = """l AS (SELECT conv_id, turn, role, '{"type":"message","id":"' || turn || '","parentId":' || CASE WHEN turn = 0 THEN 'null' ELSE '"' || (turn - 1) || '"' END
 || ',"message":{"role":"' || role || '","content":' || to_json(text) || '}}' AS line, '{"type":"session","id":"' || conv_id || '"}' || chr(10) AS header FROM conversations)"""


@query(f"""WITH {_LINES} SELECT conv_id, turn AS ordinal, role, sha256(line) AS payload_hash, CAST(strlen(line) AS BIGINT) AS payload_bytes,
 CAST(strlen(header) + sum(strlen(line) + 1) OVER w AS BIGINT) AS next_byte_offset, sha256(header || string_agg(line || chr(10), '') OVER w) AS prefix_hash FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def session_log_scan(t: Tables) -> DataFrame:
    from annalist.sources.logs import session_entries

    e = session_entries(session_lines(t))
    return e.select(F.col("session_id").cast("long").alias("conv_id"), "ordinal", "role", "payload_hash", "payload_bytes", "next_byte_offset", "prefix_hash")


@query(f"""WITH {_LINES} SELECT conv_id, count(*) AS entry_count, sha256(any_value(header) || string_agg(line || chr(10), '' ORDER BY turn)) AS log_hash, CAST(max(strlen(line)) AS BIGINT) AS largest_record_bytes FROM l GROUP BY conv_id""")
def session_log_summary(t: Tables) -> DataFrame:
    from annalist.sources.logs import session_summaries

    s = session_summaries(session_lines(t).withColumn("length", F.octet_length("content")))
    return s.select(F.col("session_id").cast("long").alias("conv_id"), F.col("record_count").alias("entry_count"), "log_hash", "largest_record_bytes")


@query(f"""WITH {_LINES}, s AS (SELECT conv_id, turn, line, header, sha256(header || string_agg(line || chr(10), '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS ph FROM l)
SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'conflict' ELSE 'pending' END AS status, CASE WHEN conv_id % 4 = 0 THEN 'prefix-mismatch' END AS reason,
 CAST(count(*) FILTER (WHERE conv_id % 4 <> 0 AND turn > 0) AS BIGINT) AS pending FROM s GROUP BY conv_id""")
def sync_plan(t: Tables) -> DataFrame:
    from annalist.sources.logs import session_scan

    entries, s = session_scan(session_lines(t))
    s = s.withColumnRenamed("record_count", "entry_count")
    bad = F.col("session_id").cast("long") % 4 == 0
    cp = entries.where("ordinal = 0").select("session_id", F.col("ordinal").alias("cp_ordinal"), F.col("next_byte_offset").alias("cp_byte_offset"), F.when(bad, LIT("x")).otherwise(F.col("prefix_hash")).alias("cp_prefix_hash"), LIT(None).cast("string").alias("cp_log_hash"), LIT(None).cast("long").alias("cp_entry_count"))
    plan, pending = sync.plan_sync(s, entries, cp)
    count = pending.groupBy("session_id").agg(n("pending"))
    return plan.join(count, "session_id", "left").select(F.col("session_id").cast("long").alias("conv_id"), "status", "reason", F.coalesce("pending", LIT(0)).alias("pending"))


@query(f"""WITH {_LINES} SELECT conv_id, sha256(any_value(header) || string_agg(line || chr(10), '' ORDER BY turn)) AS log_hash FROM l GROUP BY conv_id""")
def restore_validation(t: Tables) -> DataFrame:
    """What a restored log hashes to, from its entries alone."""
    from annalist.plans.restore import validated
    from annalist.sources.logs import session_scan

    entries, summaries = session_scan(session_lines(t))
    sessions = summaries.select(F.col("session_id").alias("id"), "header_json", F.col("path").alias("source_file"), F.col("record_count").alias("entry_count"), "log_hash", "log_bytes", "has_final_newline")
    return validated(entries, sessions).where("status = 'valid'").select(F.col("session_id").cast("long").alias("conv_id"), F.sha2("log", 256).alias("log_hash"))


def transcript_lines(t: Tables) -> DataFrame:
    """A transcript per conversation, parents first or not: path, content, session_id, stream_id, agent_id."""
    up = F.when(F.col("turn") == 0, LIT("null")).otherwise(F.concat(LIT('"'), (F.col("turn") - 1).cast("string"), LIT('"')))
    line = F.concat(LIT('{"type":"'), F.col("role"), LIT('","uuid":"'), S("turn"), LIT('","parentUuid":'), up, LIT(',"sessionId":"'), S("conv_id"), LIT('","requestId":"q'), F.floor(F.col("turn") / 2).cast("string"),
                    LIT('","message":{"role":"'), F.col("role"), LIT('","content":'), X.quoted("text"), LIT("}}\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("o"), line.alias("e")))), lambda x: x["e"]), "")
    tail = LIT('{"type":"last-prompt","leafUuid":"0"}\n{"unfinished":')
    return t.conversations.groupBy("conv_id").agg(body.alias("b")).select(S("conv_id").alias("path"), F.concat("b", tail).cast("binary").alias("content"), S("conv_id").alias("session_id"), LIT("main").alias("stream_id"), LIT(None).cast("string").alias("agent_id"))


@query("""
WITH l AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS ordinal, '{"type":"' || role || '","uuid":"' || turn || '","parentUuid":' || CASE WHEN turn = 0 THEN 'null' ELSE '"' || (turn - 1) || '"' END
 || ',"sessionId":"' || conv_id || '","requestId":"q' || (turn // 2) || '","message":{"role":"' || role || '","content":' || to_json(text) || '}}' AS line FROM conversations)
SELECT conv_id, ordinal, role, CAST(turn AS VARCHAR) AS entry_id, CASE WHEN turn > 0 THEN CAST(turn - 1 AS VARCHAR) END AS parent_id, 'q' || (turn // 2) AS request_id, sha256(line) AS payload_hash,
 CAST(sum(strlen(line) + 1) OVER (PARTITION BY conv_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS next_byte_offset FROM l""")
def transcript_scan(t: Tables) -> DataFrame:
    """Records of transcripts whose parents stand behind their children, and whose last line is not finished."""
    from annalist.sources.logs import transcript_entries

    e = transcript_entries(transcript_lines(t)).where("record_uuid is not null")
    return e.select(F.col("session_id").cast("long").alias("conv_id"), "ordinal", "role", "entry_id", "parent_id", "request_id", "payload_hash", "next_byte_offset")


@query("""
SELECT conv_id, CAST(count(*) + 1 AS BIGINT) AS records, '0' AS leaf, CAST(14 AS BIGINT) AS waiting FROM conversations GROUP BY conv_id""")
def transcript_summary(t: Tables) -> DataFrame:
    from annalist.sources.logs import transcript_summaries

    s = transcript_summaries(transcript_lines(t))
    return s.select(F.col("session_id").cast("long").alias("conv_id"), F.col("record_count").alias("records"), F.col("current_leaf_id").alias("leaf"), F.col("incomplete_tail_bytes").alias("waiting"))


@query("""
SELECT conv_id, turn, '{"id":"' || turn || '","type":"message","message":{"role":"' || role || '","content":' || CASE WHEN role = 'user' THEN to_json(substr(ltrim(text), 1, 512)) ELSE 'null' END || '},"originMalformed":false}' AS compact FROM conversations""")
def compact_activity(t: Tables) -> DataFrame:
    """Raw records without what occasions do not need."""
    raw = F.concat(LIT('{"type":"message","id":"'), S("turn"), LIT('","extra":{"a":1},"message":{"role":"'), F.col("role"), LIT('","usage":[1],"content":'), X.quoted(F.concat(LIT(" "), "text")), LIT("}}"))
    return t.conversations.select("conv_id", "turn", occasions.compact_json(raw).alias("compact"))


# Events


def event_log(t: Tables) -> DataFrame:
    """An event log per user: ids repeat every 7th event; the repeated event is the same (replay) or another one (conflict); committed bytes grow, but not at every 5th."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = t.events.withColumn("o", (F.row_number().over(w) - 1).cast("long"))
    src = F.when((F.col("o") % 7 == 6) & (F.col("o") < 20), F.col("o") - 1).otherwise(F.col("o"))
    at = F.when(F.col("o") % 5 == 4, LIT(1)).otherwise(src + 10)
    prefix = F.repeat(LIT("a"), 64)
    raw = F.concat(LIT('{"protocolVersion":1,"eventId":"e'), src.cast("string"), LIT('","kind":"source.covered","producer":{"id":"p","version":"1"},"source":{"kind":"pi","sessionId":"'), S("user_id"),
                   LIT('"},"sourceCheckpoint":{"streams":[{"streamId":"main","committedBytes":'), at.cast("string"), LIT(',"prefixSha256":"'), prefix, LIT('","selectedLeafEntryId":null}]},"recordedAt":"2024-01-01T00:00:00Z"}'))
    return e.select(LIT("pi").alias("source_kind"), S("user_id").alias("source_session_id"), LIT("p").alias("producer_id"), F.col("o").alias("ordinal"), raw.alias("raw_json"))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS o FROM events),
s AS (SELECT *, CASE WHEN o % 7 = 6 AND o < 20 THEN o - 1 ELSE o END AS src FROM e),
-- the event before is repeated at 6, 13 and 20-: the same bytes unless it or the repeat is a fifth one
b AS (SELECT *, CASE WHEN o % 5 = 4 THEN 1 ELSE src + 10 END AS bytes FROM s),
p AS (SELECT *, lag(bytes) OVER (PARTITION BY user_id ORDER BY o) AS before, lag(src) OVER (PARTITION BY user_id ORDER BY o) AS src_before FROM b),
c AS (SELECT *, src = src_before AND bytes <> before AS clash FROM p),
l AS (SELECT *, coalesce(max(CASE WHEN clash THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS latched FROM c)
SELECT user_id, o AS ordinal, CASE WHEN latched = 1 THEN 'blocked' WHEN clash THEN 'conflict' WHEN src = src_before THEN 'replay' WHEN o % 5 = 4 THEN 'skipped' ELSE 'accepted' END AS semantic_status FROM l""")
def sidecar_semantics(t: Tables) -> DataFrame:
    return sidecar.classify(event_log(t)).select(F.col("source_session_id").cast("long").alias("user_id"), "ordinal", "semantic_status")


_VALID = """'{"eventId":"e' || event_id || '","kind":"observations.recorded"' || extra || ',"observations":[{"content":' || to_json(event_type || ' ' || props) || ',"id":"' || md5(CAST(event_id AS VARCHAR))[1:12] || '","relevance":"high","sourceEntries":[{"entryId":"e","streamId":"main"}],"timestamp":"2024-01-01T00:00:00.000Z","tokenCount":3}],"producer":{"id":"p","version":"1"},"protocolVersion":1,"recordedAt":"2024-01-01T00:00:00Z","source":{"kind":"pi","sessionId":"' || user_id || '"},"sourceCheckpoint":{"streams":[{"committedBytes":' || (o + 10) || ',"prefixSha256":"' || repeat('a', 64) || '","selectedLeafEntryId":null,"streamId":"main"}]}}'"""


@query(f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS o, event_id % 20 AS v, CASE WHEN event_id % 20 = 14 THEN ',"note":1.5' ELSE '' END AS extra FROM events)
SELECT user_id, o AS ordinal, CASE WHEN v < 14 THEN 'skipped' ELSE 'accepted' END AS semantic_status,
  CASE WHEN v < 2 THEN 'malformed-json' WHEN v = 2 THEN 'invalid-envelope' WHEN v = 3 THEN 'unsupported-version' WHEN v = 4 THEN 'unsupported-kind' WHEN v = 11 THEN 'producer-mismatch' WHEN v = 12 THEN 'source-mismatch'
    WHEN v < 14 THEN 'invalid-envelope' END AS diagnostic,
  CASE WHEN v >= 14 THEN sha256({_VALID}) END AS event_hash FROM e""")
def sidecar_validation(t: Tables) -> DataFrame:
    """An event log per user, of whose records every rule of the envelope stops some: two of three are broken in fourteen ways, and one in twenty is right in a form that only the definition writes alike."""
    from pyspark.sql import Window

    o = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    e = t.events.select("event_id", "user_id", "event_type", "props", o.alias("o"), (F.col("event_id") % 20).alias("v"))
    at = lambda n, broken, right: F.when(F.col("v") == n, LIT(broken)).otherwise(LIT(right))
    observation = F.concat(LIT('{"id":"'), memory_hex(S("event_id")), LIT('","content":'), X.quoted(F.concat("event_type", LIT(" "), "props")), LIT(',"timestamp":"2024-01-01T00:00:00.000Z","relevance":"high","tokenCount":3,"sourceEntries":[{"streamId":"'), at(9, "side", "main"), LIT('","entryId":"e"}]}'))
    reflection = LIT('"reflections":[{"id":"aaaaaaaaaaaa","content":"a\\nb","supportingObservationIds":["bbbbbbbbbbbb"],"tokenCount":1}]')
    payload = F.when(F.col("v") == 10, reflection).otherwise(F.concat(LIT('"observations":['), observation, F.when(F.col("v") == 8, F.concat(LIT(","), observation)).otherwise(""), LIT("]"), at(7, ',"observationIds":["aaaaaaaaaaaa"]', "")))
    raw = F.concat(
        LIT('{"protocolVersion":'), at(3, "2", "1"), LIT(',"eventId":"'), at(5, "a b", "e"), S("event_id"), LIT('","kind":"'), F.when(F.col("v") == 4, "other.kind").when(F.col("v") == 10, "reflections.recorded").otherwise("observations.recorded"),
        LIT('", "producer":{"id":"'), at(11, "q", "p"), LIT('","version":"1"},"source":{"kind":"pi","sessionId":"'), at(12, "x", ""), S("user_id"), LIT('"},"sourceCheckpoint":{"streams":[{"streamId":"main","committedBytes":'), S(F.col("o") + 10),
        LIT(',"prefixSha256":"'), F.repeat(LIT("a"), 64), LIT('","selectedLeafEntryId":null}]},"recordedAt":"2024'), at(6, "", "-01-01T00:00:00Z"), LIT('",'), at(13, '"note":"\\ud800",', ""), at(14, '"note":1.50,', ""), payload, LIT("}"), at(1, " {", ""),
    )
    raw = F.when(F.col("v") == 0, "{").when(F.col("v") == 2, "[]").otherwise(raw)
    log = e.select(LIT("pi").alias("source_kind"), S("user_id").alias("source_session_id"), LIT("p").alias("producer_id"), F.col("o").alias("ordinal"), raw.alias("raw_json"))
    return sidecar.classify(log).select(F.col("source_session_id").cast("long").alias("user_id"), "ordinal", "semantic_status", F.get("diagnostics", LIT(0)).alias("diagnostic"), "event_hash")


def _documents_as_events(t: Tables) -> DataFrame:
    """Producers are sources; each document defines the memory of its text, and toxic ones are dropped."""
    d = t.documents.select("doc_id", F.coalesce("source", LIT("none")).alias("source"), F.coalesce("lang", LIT("xx")).alias("lang"), memory_hex(F.coalesce("text", LIT(""))).alias("m"))
    o = F.concat(LIT('{"eventId":"e","producer":{"id":"'), F.col("source"), LIT('","version":"1"},"observations":[{"id":"'), F.col("m"), LIT('","content":"'), F.col("lang"), LIT('","timestamp":"t","relevance":"low","tokenCount":1,"sourceEntries":[{"streamId":"main","entryId":"'), S("doc_id"), LIT('"}]}]}'))
    gone = F.concat(LIT('{"eventId":"e","producer":{"id":"'), F.col("source"), LIT('","version":"1"},"observationIds":["'), F.col("m"), LIT('"]}'))
    base = lambda kind, raw, at: [LIT("pi").alias("source_kind"), LIT("s").alias("source_session_id"), F.col("source").alias("producer_id"), at.alias("ordinal"), LIT("accepted").alias("semantic_status"), LIT(kind).alias("kind"), raw.alias("raw_json"), S("doc_id").alias("record_id"), F.array().cast("array<string>").alias("diagnostics")]
    toxic = d.join(t.labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return d.select(*base("observations.recorded", o, F.col("doc_id"))).unionByName(toxic.select(*base("observations.dropped", gone, -F.col("doc_id") - 1)))


_MEMORIES = """d AS (SELECT doc_id, coalesce(source, 'none') AS producer, coalesce(lang, 'xx') AS content, md5(coalesce(text, ''))[1:12] AS memory_id FROM documents),
f AS (SELECT producer, memory_id, min(doc_id) AS first_doc, arg_min(content, doc_id) AS content FROM d GROUP BY ALL),
g AS (SELECT DISTINCT producer, memory_id FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


@query(f"WITH {_MEMORIES} SELECT f.producer, f.memory_id, f.content, CAST(first_doc AS VARCHAR) AS record_id, g.memory_id IS NOT NULL AS dropped FROM f LEFT JOIN g USING (producer, memory_id)")
def memory_fold(t: Tables) -> DataFrame:
    return memory.fold(_documents_as_events(t)).observations.select("producer", "memory_id", "content", "record_id", "dropped")


@query(f"""WITH {_MEMORIES}, x AS (SELECT d.producer, CAST(d.doc_id AS VARCHAR) AS record_id, d.memory_id, row_number() OVER (ORDER BY d.producer, d.doc_id) AS r FROM d JOIN f USING (producer, memory_id) WHERE d.doc_id > f.first_doc)
SELECT producer, record_id, memory_id FROM x WHERE r <= 100""")
def memory_conflicts(t: Tables) -> DataFrame:
    # a later definition cites another entry, so it differs from the first
    return memory.fold(_documents_as_events(t)).diagnostics.select("producer", "record_id", "memory_id")


@query("SELECT doc_id, 'unresolved-reference' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unresolved_citations(t: Tables) -> DataFrame:
    o = t.documents.select(LIT("pi").alias("source_kind"), LIT("s").alias("source_session_id"), LIT("p").alias("producer"), S("doc_id").alias("memory_id"), F.array(F.struct(LIT("main").alias("stream_id"), S("doc_id").alias("entry_id"))).alias("source_entries"))
    r = o.select("source_kind", "source_session_id", "producer", "memory_id", F.array().cast("array<string>").alias("supporting_observation_ids"))
    e = t.labels.select(LIT("pi").alias("source_kind"), LIT("s").alias("source_session_id"), LIT(None).cast("string").alias("stream_id"), S("doc_id").alias("entry_id"))
    return memory.unresolved(o, r, e).select(F.col("memory_id").cast("long").alias("doc_id"), "reason")


# Evidence and graph


def _tool_entries(t: Tables) -> DataFrame:
    """A session per order; its lines are tool calls, and for returned ones also results."""
    li = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.max("l_returnflag").alias("flag"))
    call = F.concat(LIT('{"message":{"role":"assistant","content":[{"type":"toolCall","id":"t'), S("l_linenumber"), LIT('","name":"'), F.when(F.col("part") % 2 == 0, "read").otherwise("edit"), LIT('","arguments":{"path":"'), (F.col("part") % 50).cast("string"), LIT('/x.py"}}]}}'))
    back = F.concat(LIT('{"message":{"role":"toolResult","toolCallId":"t'), S("l_linenumber"), LIT('","content":"ok"}}'))
    base = lambda id_, raw, at: [S("l_orderkey").alias("session_id"), id_.alias("entry_id"), at.cast("long").alias("ordinal"), raw.alias("raw_json")]
    return li.select(*base(F.concat(LIT("c"), S("l_linenumber")), call, F.col("l_linenumber"))).unionByName(li.where("flag = 'R'").select(*base(F.concat(LIT("r"), S("l_linenumber")), back, F.col("l_linenumber") + 100)))


_TOUCHES = """x AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, max(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
y AS (SELECT l_orderkey, 'c' || l_linenumber AS entry_id, part % 50 AS d FROM x UNION ALL SELECT l_orderkey, 'r' || l_linenumber, part % 50 FROM x WHERE flag = 'R')"""


@query(f"WITH {_TOUCHES} SELECT l_orderkey, entry_id, 'urn:annalist:file:' || sha256((CASE WHEN d < 10 THEN 'N' || d ELSE 'R' END) || chr(0) || (CASE WHEN d < 10 THEN '' ELSE d || '/' END) || 'x.py') AS file_id FROM y")
def tool_evidence(t: Tables) -> DataFrame:
    roots = t.spark.range(10).select(F.concat(LIT("N"), S("id")).alias("repository_id"), F.concat(LIT("/w/"), S("id")).alias("root"))
    roots = roots.unionByName(t.spark.range(1).select(LIT("R").alias("repository_id"), LIT("/w").alias("root"))).select("*", LIT("c").alias("commit"), LIT(None).cast("string").alias("branch"), LIT(False).alias("dirty"))
    _, touches = evidence.session_evidence(_tool_entries(t), roots, LIT("/w"))
    return touches.select(F.col("session_id").cast("long").alias("l_orderkey"), "entry_id", "file_id")


@query("SELECT conv_id, turn AS child, turn - 1 AS parent FROM conversations WHERE turn > 0")
def parent_edges(t: Tables) -> DataFrame:
    c = t.conversations
    e = c.select(S("conv_id").alias("session_id"), LIT("main").alias("stream_id"), S("turn").alias("entry_id"), F.concat_ws("/", "conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_id"))
    at = lambda c, i: F.element_at(F.split(c, "/"), i).cast("long")
    return projection.parent_edges(e).select(at("child", 1).alias("conv_id"), at("child", 2).alias("child"), at("parent", 2).alias("parent"))


@query("SELECT a.c_custkey AS child, b.c_custkey AS parent FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey - 25 AND a.c_mktsegment = b.c_mktsegment")
def fork_edges(t: Tables) -> DataFrame:
    s = t.customer.select(F.col("c_mktsegment").alias("user_id"), LIT("pi").alias("source_kind"), S("c_custkey").alias("id"), S("c_custkey").alias("source_session_id"), (F.col("c_custkey") - 25).cast("string").alias("parent_session"), F.concat(LIT("/f/"), S("c_custkey"), LIT(".jsonl")).alias("source_file"))
    return projection.fork_edges(s).select(F.col("child").cast("long").alias("child"), F.col("parent").cast("long").alias("parent"))


def _order_graph(t: Tables) -> Graph:
    """Orders are observations of their customers' sessions, parts are files, the priority's order is cited, suppliers are entries."""
    orders = t.orders.select(S("o_orderkey").alias("o"), S("o_custkey").alias("c"), "o_orderstatus", "o_orderpriority")
    li = t.lineitem.select(S("l_orderkey").alias("o"), S("l_partkey").alias("p"), S("l_suppkey").alias("s"), "l_returnflag")
    none = LIT(None).cast("string")
    return Graph(
        sessions=t.customer.select(S("c_custkey").alias("id"), F.col("c_mktsegment").alias("user_id"), LIT("pi").alias("source_kind"), S("c_custkey").alias("source_session_id")),
        observations=orders.select(F.col("o").alias("id"), F.col("c").alias("session_id"), F.col("o").alias("memory_id"), LIT("p").alias("producer"), F.col("o_orderpriority").alias("content"), none.alias("timestamp"), none.alias("relevance"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("dropped")),
        reflections=orders.where("o_orderstatus = 'F'").select(F.concat(LIT("r"), "o").alias("id"), F.col("c").alias("session_id"), F.col("o").alias("memory_id"), LIT("p").alias("producer"), LIT("sum").alias("content")),
        about=li.select(F.col("o").alias("observation_id"), F.col("p").alias("file_id")), supported_by=orders.where("o_orderstatus = 'F'").select(F.concat(LIT("r"), "o").alias("reflection_id"), F.col("o").alias("observation_id")),
        sourced_from=li.where("l_returnflag = 'R'").select(F.col("o").alias("observation_id"), F.col("s").alias("entry_urn")), entries=t.supplier.select(S("s_suppkey").alias("id"), S("s_suppkey").alias("entry_id"), none.alias("stream_id")),
        touches=t.supplier.where("s_acctbal > 0").select(S("s_suppkey").alias("entry_urn"), LIT("7").alias("file_id"), LIT("abc").alias("commit"), none.alias("branch"), LIT(False).alias("dirty")),
        files=t.part.select(S("p_partkey").alias("id"), F.col("p_brand").alias("repository_id"), S("p_partkey").alias("relative_path")),
    )


@query("""
WITH o AS (SELECT DISTINCT o_orderkey, o_orderstatus, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' JOIN lineitem ON l_orderkey = o_orderkey AND l_partkey = 7),
e AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS entry_ids, count(DISTINCT CASE WHEN s_acctbal > 0 THEN l_suppkey END) AS contexts FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY 1),
u AS (SELECT 'observation' AS kind, CAST(o_orderkey AS VARCHAR) AS memory_id, o_orderpriority AS content, o_orderkey FROM o WHERE o_orderstatus <> 'F' UNION ALL SELECT 'reflection', CAST(o_orderkey AS VARCHAR), 'sum', o_orderkey FROM o WHERE o_orderstatus = 'F')
SELECT kind, memory_id, content, coalesce(entry_ids, []) AS entry_ids, CAST(coalesce(contexts, 0) AS BIGINT) AS contexts FROM u LEFT JOIN e ON l_orderkey = o_orderkey ORDER BY kind, memory_id LIMIT 20""")
def file_memory_query(t: Tables) -> DataFrame:
    g = _order_graph(t)
    repo = t.part.where("p_partkey = 7").first().p_brand
    out = file_memory(g, "BUILDING", repo, "7", limit=20)
    return out.select("kind", "memory_id", "content", "entry_ids", F.size("contexts").cast("long").alias("contexts"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'urn' WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS scope_of, CAST(CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS scopes FROM customer")
def observation_scope(t: Tables) -> DataFrame:
    """A third have file evidence, a third one context, a third two."""
    c = t.customer.select(S("c_custkey").alias("id"), "c_custkey", "c_mktsegment")
    about = c.where("c_custkey % 3 = 0").select(F.col("id").alias("observation_id"), LIT("f").alias("file_id"))
    files = t.spark.range(1).select(LIT("f").alias("id"), LIT("urn").alias("repository_id"))
    worked = c.select(F.col("id").alias("session_id"), F.col("c_mktsegment").alias("repository_id")).unionByName(c.where("c_custkey % 3 = 2").select(F.col("id").alias("session_id"), LIT("second").alias("repository_id")))
    seen = scope.observation_scope(c.select("id", F.col("id").alias("session_id")), about, files, worked)
    return seen.select(F.col("id").cast("long").alias("c_custkey"), F.get("repository_ids", LIT(0)).alias("scope_of"), F.size("repository_ids").cast("long").alias("scopes"))


@query("SELECT DISTINCT p_brand AS normalized_origin FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (3, 4)")
def repository_origins(t: Tables) -> DataFrame:
    sessions = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(S("o_orderkey").alias("id"), S("c_nationkey").alias("user_id"))
    worked = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(S("l_orderkey").alias("session_id"), F.col("p_brand").alias("repository_id"))
    repos = t.part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("normalized_origin")).distinct()
    me = t.spark.range(1).select(LIT("3").alias("reader_id"))
    grants = t.spark.range(1).select(LIT("4").alias("owner_id"), LIT("3").alias("reader_id"), LIT("read").alias("permission"))
    return scope.repository_origins(sessions, worked, repos, access.authorized_owners(me, grants))


# Derivations and runs


def _memories(t: Tables) -> DataFrame:
    """Parts are observations; what an order has of one owner's parts is a reflection of these. Readers see what they may, here owner 3."""
    strings = F.array().cast("array<string>")
    o = t.part.select(F.concat(LIT("p"), S("p_partkey")).alias("id"), (F.col("p_partkey") % 25).cast("string").alias("owner_id"), F.col("p_brand").alias("session_id"), LIT("observation").alias("kind"), (F.col("p_size") > 45).alias("dropped"), LIT(None).cast("array<string>").alias("supporting_memory_ids"), F.array(F.concat(LIT("git@h:o/"), F.col("p_type"))).alias("repository_origins"), F.array(F.concat(LIT("a."), F.when(F.col("p_size") % 2 == 0, "py").otherwise("rs"))).alias("linked_paths"))
    sup = t.lineitem.groupBy("l_orderkey", (F.col("l_partkey") % 25).cast("string").alias("owner_id")).agg(F.array_sort(F.collect_set(F.concat(LIT("p"), S("l_partkey")))).alias("supporting_memory_ids"))
    r = sup.select(F.concat(LIT("o"), S("l_orderkey"), LIT("/"), "owner_id").alias("id"), "owner_id", LIT("s").alias("session_id"), LIT("reflection").alias("kind"), LIT(None).cast("boolean").alias("dropped"), "supporting_memory_ids", strings.alias("repository_origins"), strings.alias("linked_paths"))
    return o.unionByName(r)


@query("""
WITH o AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 25 IN (3, 4) AND p_size <= 45 AND p_size % 2 = 0 AND p_partkey % 25 = 3 OR p_partkey % 25 = 4 AND p_size <= 45 AND p_size % 2 = 0)
SELECT id, ['evidence'] AS roles FROM o""")
def selected_input(t: Tables) -> DataFrame:
    grants = t.spark.range(1).select(LIT("4").alias("owner_id"), LIT("3").alias("reader_id"), LIT("read").alias("permission"))
    return selection.select_input(_memories(t), "3", grants, filter_kind="language", filter_value="python").memories.select("id", "roles")


@query("""
WITH r AS (SELECT DISTINCT 'o' || l_orderkey || '/' || (l_partkey % 25) AS id, 'p' || l_partkey AS sup FROM lineitem WHERE l_partkey % 25 = 3), o AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 25 = 3 AND p_size <= 45),
u AS (SELECT DISTINCT id, 'evidence' AS role FROM r UNION SELECT id, 'evidence' FROM o UNION SELECT sup, 'historical-support' FROM r)
SELECT id, list_sort(list(role)) AS roles FROM u GROUP BY id""")
def selected_roles(t: Tables) -> DataFrame:
    grants = t.spark.range(0).select(LIT("4").alias("owner_id"), LIT("3").alias("reader_id"), LIT("read").alias("permission"))
    return selection.select_input(_memories(t), "3", grants).memories.select("id", "roles")


@query("""
WITH i AS (SELECT DISTINCT o_orderkey, l_partkey % 25 AS owner, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN bool_or(l_partkey % 97 = 0) THEN 'unresolved-evidence' WHEN bool_or(owner NOT IN (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)) THEN 'unauthorized' ELSE 'available' END AS status FROM i GROUP BY 1""")
def run_status(t: Tables) -> DataFrame:
    """Orders are runs, their parts the inputs; every 97th part is gone."""
    li = t.lineitem.select(S("l_orderkey").alias("id"), S("l_partkey").alias("m")).distinct()
    rs = li.groupBy("id").agg(F.collect_list("m").alias("input_memory_ids")).join(t.orders.select(S("o_orderkey").alias("id")), "id", "left_semi")
    used = li.select(F.col("id").alias("run_id"), F.col("m").alias("memory_id"))
    m = t.part.where("p_partkey % 97 <> 0").select(S("p_partkey").alias("id"), (F.col("p_partkey") % 25).cast("string").alias("owner_id"), LIT("s").alias("session_id"))
    grants = t.spark.range(4, 15).select(S("id").alias("owner_id"), LIT("3").alias("reader_id"), LIT("read").alias("permission"))
    return runs.run_status(rs, used, m, "3", grants).select(F.col("id").cast("long").alias("o_orderkey"), "status")


@query("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 97 = 0)")
def repaired_dependencies(t: Tables) -> DataFrame:
    rs = t.lineitem.groupBy(S("l_orderkey").alias("id")).agg(F.collect_set(S("l_partkey")).alias("input_memory_ids"))
    got = runs.dependency_edges(rs, t.part.where("p_partkey % 97 <> 0").select(S("p_partkey").alias("id")))
    return got.select(F.col("run_id").cast("long").alias("l_orderkey"), F.col("memory_id").cast("long").alias("l_partkey"))


@query("SELECT l_orderkey, CASE WHEN bool_or(p_size > 40) THEN 'outdated' ELSE 'current' END AS status FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def run_freshness(t: Tables) -> DataFrame:
    """Dependencies whose part is large have changed since."""
    deps = t.lineitem.groupBy(S("l_orderkey").alias("id")).agg(F.map_from_entries(F.collect_set(F.struct(S("l_partkey"), LIT("v1")))).alias("dependency_fingerprints"))
    now = t.part.select(S("p_partkey").alias("id"), F.when(F.col("p_size") > 40, "v2").otherwise("v1").alias("fingerprint"))
    return derive.changed_dependencies(deps, now).select(F.col("id").cast("long").alias("l_orderkey"), "status")


@query("""
WITH c AS (SELECT o_custkey, o_orderkey FROM orders), s AS (SELECT DISTINCT o_custkey, l_partkey % 7 AS sess, l_suppkey FROM c JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_custkey, count(DISTINCT (sess, l_suppkey)) AS occasions FROM s GROUP BY 1""")
def occasion_counts(t: Tables) -> DataFrame:
    """Customers' conclusions rest on their orders; an order's occasions are its parts' sessions and suppliers."""
    c = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi").groupBy(S("o_custkey").alias("id")).agg(F.collect_set(S("o_orderkey")).alias("supporting_memory_ids"))
    occ = F.struct(F.concat(LIT("urn:x:session:u:pi:"), (F.col("l_partkey") % 7).cast("string")).alias("session_id"), LIT("main").alias("stream_id"), S("l_suppkey").alias("entry_id"))
    m = t.lineitem.groupBy(S("l_orderkey").alias("id")).agg(F.collect_set(occ).alias("source_occasions")).select("id", LIT("observation").alias("kind"), LIT(None).cast("array<string>").alias("supporting_memory_ids"), "source_occasions")
    return selection.occasion_counts(c, m).select(F.col("id").cast("long").alias("o_custkey"), "occasions")


@query("SELECT conv_id, turn, CAST(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS request FROM conversations QUALIFY request IS NOT NULL AND role IN ('user', 'assistant')")
def verified_requests(t: Tables) -> DataFrame:
    """The request behind each turn: the last user turn up to it."""
    c = t.conversations
    parent = F.when(F.col("turn") > 0, F.concat(LIT('"'), (F.col("turn") - 1).cast("string"), LIT('"'))).otherwise(LIT("null"))
    raw = F.concat(LIT('{"type":"message","id":"'), S("turn"), LIT('","parentId":'), parent, LIT(',"message":{"role":"'), F.col("role"), LIT('","content":"x"}}'))
    entries = c.select(S("conv_id").alias("session_id"), LIT("main").alias("stream_id"), S("turn").alias("entry_id"), raw.alias("raw_json"))
    sessions = c.select(S("conv_id").alias("id"), LIT("pi").alias("source_kind"), S("conv_id").alias("source_session_id")).distinct()
    found = occasions.anchors(entries, entries.select("session_id", "stream_id", "entry_id"), sessions)
    return found.select(F.col("session_id").cast("long").alias("conv_id"), F.col("entry_id").cast("long").alias("turn"), F.col("anchor_entry").cast("long").alias("request"))


# Changes to tables


@query("""
WITH o AS (SELECT user_id, max(event_id) AS at FROM events WHERE day(ts) <= 15 GROUP BY 1), f AS (SELECT user_id, max(event_id) - CASE WHEN user_id % 2 = 0 THEN 0 ELSE 100000 END AS at FROM events GROUP BY 1)
SELECT coalesce(o.user_id, f.user_id) AS user_id, CASE WHEN o.at IS NULL OR f.at >= o.at THEN f.at ELSE o.at END AS byte_offset, o.at IS NULL OR f.at >= o.at AS applied FROM o FULL JOIN f USING (user_id)""")
def checkpoint_cas(t: Tables) -> DataFrame:
    cp = lambda df, less: df.groupBy(S("user_id").alias("session_id")).agg((F.max("event_id") - less).alias("byte_offset")).select("session_id", "byte_offset", LIT("h").alias("prefix_hash"), LIT(0).cast("long").alias("ordinal"))
    old, new = cp(t.events.where(F.dayofmonth("ts") <= 15), LIT(0)), cp(t.events, F.when(F.max("user_id") % 2 == 0, 0).otherwise(100000))
    return catalog.advance_checkpoints(old, new).select(F.col("session_id").cast("long").alias("user_id"), "byte_offset", "applied")


@query("SELECT id, count(*) AS old_ids FROM (SELECT c_mktsegment || c_nationkey AS id, c_custkey FROM customer) GROUP BY id HAVING count(*) > 1")
def identity_migration(t: Tables) -> DataFrame:
    _, clash = catalog.rekey(t.customer.select(S("c_custkey").alias("id"), "c_mktsegment", "c_nationkey"), F.concat("c_mktsegment", S("c_nationkey")))
    return clash.select("id", F.col("n").alias("old_ids"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'conflict' WHEN c_custkey % 3 = 0 AND c_custkey % 7 = 0 THEN 'malformed' WHEN c_custkey % 3 <> 0 THEN 'remote' ELSE 'local+remote' END AS status FROM customer")
def import_status(t: Tables) -> DataFrame:
    c = t.customer.select(S("c_custkey").alias("id"), "c_custkey")
    local = c.where("c_custkey % 3 = 0").select("id", LIT("h").alias("log_hash"), F.when(F.col("c_custkey") % 7 == 0, "malformed-json").alias("error"))
    stored = c.select("id", LIT("h").alias("log_hash"), (F.col("c_custkey") % 5 == 0).alias("conflicted"))
    return projection.import_status(local, stored).select(F.col("id").cast("long").alias("c_custkey"), "status")


@query("SELECT user_id, event_type, max(event_id) AS last_id, count(*) AS notifications, min(event_id) AS first_id FROM events GROUP BY 1, 2")
def notification_groups(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", F.col("event_id").alias("id"), F.col("event_id").alias("queued_at"))
    g = spool.groups(e, ["user_id", "event_type"], ["queued_at", "id"])
    return g.select("user_id", "event_type", F.col("id").alias("last_id"), F.size("ids").cast("long").alias("notifications"), F.col("first_place.id").alias("first_id"))


@query("SELECT p_partkey, '/w/' || p_partkey AS root, md5(p_name) AS \"commit\", CASE WHEN p_size % 2 = 0 THEN p_type END AS branch FROM part")
def worktree_listing(t: Tables) -> DataFrame:
    z = F.concat(LIT("worktree /w/"), S("p_partkey"), LIT("\0HEAD "), F.md5(F.col("p_name").cast("binary")), F.when(F.col("p_size") % 2 == 0, F.concat(LIT("\0branch refs/heads/"), "p_type")).otherwise(LIT("\0detached")), LIT("\0\0"))
    got = spool.parse_worktrees(t.part.select(F.col("p_partkey").alias("repository_id"), z.alias("porcelain")))
    return got.select(F.col("repository_id").alias("p_partkey"), "root", "commit", "branch")


@query("SELECT user_id, count(*) = count(DISTINCT event_id) AS ok FROM events GROUP BY 1")
def contiguous_ranges(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    r = t.events.select("user_id", ((F.row_number().over(w) - 1) * 10).alias("start_offset"), (F.row_number().over(w) * 10).alias("end_offset"))
    return sync.contiguous(r, "user_id")


@query("SELECT event_type AS stream_id, user_id AS session_id FROM events WHERE user_id % 4 = 1 GROUP BY ALL")
def missing_streams(t: Tables) -> DataFrame:
    """Transcripts whose files are gone."""
    from annalist.sources.logs import located

    loc = t.events.select("user_id", "event_type").distinct().select(S("user_id").alias("session_id"), F.col("event_type").alias("agent_id"), F.concat_ws("/", LIT("/t"), "user_id", "event_type").alias("transcript_path"), "user_id")
    have = loc.where("user_id % 4 <> 1").select(F.concat(LIT("file:"), F.col("transcript_path")).alias("path"), LIT(b"").alias("content"))
    _, missing = located(have, loc.drop("user_id"))
    return missing.select(F.substring("stream_id", 7, 100).alias("stream_id"), F.col("session_id").cast("long").alias("session_id"))


# Replication, generation input


@query("""
WITH e AS (SELECT user_id, event_id, day(ts) <= 15 AS early FROM events),
s AS (SELECT user_id, max(event_id) FILTER (WHERE early) AS cp, max(event_id) AS last, min(event_id) AS first FROM e GROUP BY 1),
p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM e JOIN s USING (user_id) WHERE event_id > coalesce(cp, -1)),
n AS (SELECT user_id, max(r) AS n FROM p GROUP BY 1),
k AS (SELECT s.*, coalesce(n, 0) AS n, CASE WHEN user_id % 7 = 6 THEN 'missing-source-session' WHEN cp = last THEN NULL WHEN user_id % 7 = 3 AND cp IS NOT NULL THEN 'prefix-mismatch'
 WHEN user_id % 7 = 5 AND first <> last THEN 'payload-mismatch' END AS reason FROM s LEFT JOIN n USING (user_id))
SELECT k.user_id, CASE WHEN user_id % 7 = 6 THEN 'rejected' WHEN cp = last THEN 'unchanged' WHEN reason IS NOT NULL THEN 'conflict' ELSE 'mirrored' END AS status, reason,
 CASE WHEN reason IS NULL THEN n ELSE 0 END AS entries_written, CASE WHEN reason IS NULL THEN (n + 2) // 3 ELSE 0 END AS batches_written,
 CASE WHEN user_id % 7 = 6 THEN NULL WHEN reason IS NULL THEN last WHEN reason = 'prefix-mismatch' OR n <= 3 THEN cp ELSE (SELECT event_id FROM p WHERE p.user_id = k.user_id AND r = 3 * ((k.n - 1) // 3)) END AS checkpoint,
 user_id % 7 <> 6 AND reason IS NOT NULL AS conflicted, CASE WHEN user_id % 7 = 6 THEN NULL ELSE 1 + (cp IS NOT NULL)::INT END::BIGINT AS revision FROM k""")
def replicated_logs(t: Tables) -> DataFrame:
    """Users' events are logs, carried over once up to the middle of the month and then as a whole, by three entries a batch. Some users' logs begin differently the second time, in
    some the last entry takes the first one's id, and some users have no session."""
    from annalist.plans.replicate import replicate
    from annalist.operators.walks import fresh_folder

    e = t.events.select("user_id", "event_id", (F.dayofmonth("ts") <= 15).alias("early"))

    def scanned(rows: DataFrame, again: bool) -> tuple[DataFrame, DataFrame]:
        ends = rows.groupBy("user_id").agg(F.min("event_id").alias("_first"), F.max("event_id").alias("_last"), n("entry_count"))
        changed = LIT(again) & (F.col("user_id") % 7 == 3)
        named = F.when(LIT(again) & (F.col("user_id") % 7 == 5) & (F.col("event_id") == F.col("_last")), F.col("_first")).otherwise(F.col("event_id"))
        entries = rows.join(ends.select("user_id", "_first", "_last"), "user_id").select(
            S("user_id").alias("log_id"), named.cast("string").alias("id"), F.col("event_id").alias("ordinal"), F.md5(S("event_id").cast("binary")).alias("payload_hash"), LIT(100).cast("long").alias("payload_bytes"),
            F.col("event_id").alias("next_byte_offset"), F.concat(F.when(changed, "x").otherwise("h"), S("event_id")).alias("prefix_hash"),
        )
        logs = ends.select(S("user_id").alias("log_id"), S("user_id").alias("session_id"), S("_last").alias("log_hash"), "entry_count", F.col("_last").alias("log_bytes"), LIT(-1).cast("long").alias("header_next_byte_offset"),
                           LIT("head").alias("header_prefix_hash"), LIT(100).cast("long").alias("largest_entry_bytes"), LIT(True).alias("has_final_newline"), F.concat(LIT("/logs/"), S("user_id")).alias("source_file"))
        return logs, entries

    replica = catalog.Catalog(t.spark, fresh_folder(t.spark, "replica"), {"sessions": ("id", 8)})
    replica.write("sessions", e.where("user_id % 7 <> 6").select(S("user_id").alias("id"), LIT(None).cast("long").alias("memory_revision")).distinct())
    replicate(replica, *scanned(e.where("early"), False), limit=300, sessions=True)
    report = replicate(replica, *scanned(e, True), limit=300, sessions=True)
    streams = replica.read("streams").select("log_id", F.when(F.col("ordinal") >= 0, F.col("ordinal")).alias("checkpoint"), "conflicted")
    out = report.join(streams, "log_id", "left").join(replica.read("sessions").select(F.col("id").alias("log_id"), F.col("memory_revision").alias("revision")), "log_id", "left")
    return out.select(F.col("log_id").cast("long").alias("user_id"), "status", "reason", "entries_written", "batches_written", "checkpoint", F.coalesce("conflicted", LIT(False)).alias("conflicted"), "revision")


@query("""
WITH m AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
l AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS paths, count(DISTINCT p_brand) AS brands, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS sources FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
f AS (SELECT m.*, coalesce(paths, 0) AS paths, coalesce(brands, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END) AS repositories, coalesce(brands, 0) AS origins, coalesce(sources, 0) AS sources FROM m LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus = 'F' AS dropped, paths, repositories, origins, sources, 0 AS supports, true AS ok FROM f
UNION ALL SELECT 'r' || o_orderkey, false, paths, repositories, origins, 0, 1, o_orderkey % 5 <> 0 FROM f WHERE o_orderstatus = 'F'""")
def generation_input(t: Tables) -> DataFrame:
    """Orders and their reflections as a reader of two segments gets them; each fifth reflection declares a support that it has no edge to."""
    from annalist.operators import inputs

    g = _order_graph(t)
    strings = LIT(None).cast("array<string>")
    declared = F.when(F.col("memory_id").cast("long") % 5 == 0, F.array("memory_id", LIT("lost"))).otherwise(F.array("memory_id"))
    both = g.observations.select("id", "session_id", "memory_id", "producer", "content", "dropped", LIT("observation").alias("kind"), strings.alias("supporting_observation_ids"))
    both = both.unionByName(g.reflections.select("id", "session_id", "memory_id", "producer", "content", LIT(None).cast("boolean").alias("dropped"), LIT("reflection").alias("kind"), declared.alias("supporting_observation_ids")))
    memories = both.join(g.sessions.select(F.col("id").alias("session_id"), F.col("user_id").alias("owner_id"), "source_kind", "source_session_id"), "session_id")
    cited = g.sourced_from.join(g.entries.select(F.col("id").alias("entry_urn"), "entry_id", "stream_id"), "entry_urn").join(g.observations.select(F.col("id").alias("observation_id"), "session_id"), "observation_id")
    home = g.sessions.select(F.col("id").alias("session_id"), LIT("home").alias("repository_id"))
    worked = home.unionByName(home.where("cast(session_id as long) % 2 = 1").withColumn("repository_id", LIT("second")))
    repositories = t.part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("normalized_origin")).distinct()
    grants = t.spark.range(1).select(LIT("MACHINERY").alias("owner_id"), LIT("BUILDING").alias("reader_id"), LIT("read").alias("permission"))
    rows = inputs.input_rows(inputs.Tables(memories, cited, g.supported_by, g.about, g.files, repositories, worked), "BUILDING", grants)
    size = lambda c: F.size(F.coalesce(c, F.array())).cast("int")
    return rows.select("id", "dropped", size("linked_paths").cast("long").alias("paths"), size("repository_ids").cast("long").alias("repositories"), size("repository_origins").cast("long").alias("origins"),
                       size("source_entries").cast("long").alias("sources"), size("supporting_memory_ids").alias("supports"), "ok")


@query("""SELECT p_partkey, CASE WHEN p_size >= 10 AND p_partkey % 10 < 5 THEN 'N' || (p_partkey % 10) END AS repository_id, p_size < 10 AS nested,
 CASE WHEN p_size < 10 THEN '/w/' || (p_partkey % 10) || '/' || p_size WHEN p_partkey % 10 < 5 THEN '/w/' || (p_partkey % 10) END AS root FROM part""")
def nested_roots(t: Tables) -> DataFrame:
    """Half of the folders of parts are worktrees, and small sizes' folders hold repositories of their own."""
    folder = (F.col("p_partkey") % 10).cast("string")
    locators = t.part.select("p_partkey", LIT("/w").alias("cwd"), F.concat(folder, LIT("/./"), S("p_size"), LIT("/x.py")).alias("path"))
    worktrees = t.spark.range(5).select(F.concat(LIT("N"), S("id")).alias("repository_id"), F.concat(LIT("/w/"), S("id")).alias("root"))
    own = t.part.where("p_size < 10").select(F.concat(LIT("/w/"), folder, LIT("/"), S("p_size")).alias("directory")).distinct()
    boundaries = own.unionByName(worktrees.select(F.col("root").alias("directory")))
    return evidence.file_repositories(locators, worktrees, boundaries).select("p_partkey", "repository_id", "nested", "root")
