"""Queries over graphs of records: selection in branching transcripts, and originals behind chains of forks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.operators import evidence, occasions
from annalist.operators.walks import durable
from annalist.plans.surrogates import Tables, query

S = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")


def branching_transcripts(t: Tables) -> DataFrame:
    """A transcript per conversation: some turns hang on an earlier one than the last or across a boundary, odd turns call, even turns answer, not always in the name of the right one, and four turns
    in a row may share a request."""
    turn = F.col("turn")
    text = F.concat(F.lit('{"type":"text","text":'), X.quoted(F.coalesce("text", F.lit(""))), F.lit("}"))
    block = F.when(turn % 2 == 1, F.concat(F.lit(',{"type":"tool_use","id":"c'), S(turn), F.lit('","name":"Read"}'))).when(turn > 0, F.concat(F.lit(',{"type":"tool_result","tool_use_id":"c'), S(turn - 1), F.lit('"}'))).otherwise("")
    source = F.when((turn % 2 == 0) & (turn > 0), F.concat(F.lit('"sourceToolAssistantUUID":"'), S(F.when((turn % 6 == 0), turn - 3).otherwise(turn - 1)), F.lit('",'))).otherwise("")
    raw = F.concat(F.lit('{"uuid":"'), S(turn), F.lit('",'), source, F.lit('"message":{"content":['), text, block, F.lit("]}}"))
    up = F.when(turn % 5 == 4, turn - 3).when(turn > 0, turn - 1)
    over = (turn % 7 == 3) & (turn % 5 != 4)
    return t.conversations.select(
        S("conv_id").alias("session_id"), F.lit("main").alias("stream_id"), F.col("turn").cast("long").alias("ordinal"), S(turn).alias("record_uuid"), S(F.when(~over, up)).alias("parent_id"), S(F.when(over, turn - 2)).alias("logical_parent_id"),
        F.when(turn % 3 != 1, F.concat(F.lit("q"), S(F.floor(turn / 4)))).alias("request_id"), raw.alias("raw_json"),
    )


@query("""
WITH RECURSIVE n AS (
  SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN turn - 3 WHEN turn % 7 = 3 THEN turn - 2 WHEN turn > 0 THEN turn - 1 END AS up, CASE WHEN turn % 3 <> 1 THEN turn // 4 END AS request,
    CASE WHEN turn % 2 = 0 AND turn > 0 THEN CASE WHEN turn % 6 = 0 THEN turn - 3 ELSE turn - 1 END END AS source FROM conversations),
a(conv_id, turn) AS (
  SELECT conv_id, max(turn) - max(turn) % 3 FROM n GROUP BY conv_id UNION SELECT n.conv_id, n.up FROM a JOIN n USING (conv_id, turn) WHERE n.up IS NOT NULL),
e AS (
  SELECT conv_id, turn AS f, source AS t FROM n WHERE source IS NOT NULL
  UNION SELECT conv_id, source, turn FROM n WHERE source = turn - 1
  UNION SELECT x.conv_id, x.turn, y.turn FROM n x JOIN n y USING (conv_id, request)),
r(conv_id, turn) AS (SELECT conv_id, turn FROM a UNION SELECT e.conv_id, e.t FROM r JOIN e ON e.conv_id = r.conv_id AND e.f = r.turn)
SELECT r.conv_id, r.turn, n.request IS NOT NULL AS in_request FROM r JOIN n USING (conv_id, turn)""")
def selected_transcript(t: Tables) -> DataFrame:
    """Records of branching transcripts that a leaf selects."""
    entries = durable(branching_transcripts(t))
    last = F.max("ordinal")
    leaves = entries.groupBy("session_id").agg(S(last - F.pmod(last, F.lit(3))).alias("current_leaf_id"))
    chosen = evidence.selected_transcript_entries(entries, leaves)
    return chosen.select(F.col("session_id").cast("long").alias("conv_id"), F.col("ordinal").alias("turn"), F.col("request_id").isNotNull().alias("in_request"))


@query("""
SELECT conv_id, turn AS child, CASE WHEN turn % 5 = 4 THEN turn - 3 WHEN turn % 7 = 3 THEN turn - 2 ELSE turn - 1 END AS parent, CASE WHEN turn % 7 = 3 AND turn % 5 <> 4 THEN 'logical' ELSE 'parent' END AS kind FROM conversations WHERE turn > 0""")
def transcript_edges(t: Tables) -> DataFrame:
    """Edges of branching transcripts to parents and, across boundaries, to logical parents."""
    from annalist.plans.projection import parent_edges

    e = durable(branching_transcripts(t).select("session_id", "stream_id", "parent_id", "logical_parent_id", F.col("record_uuid").alias("entry_id"), F.concat_ws("/", "session_id", "record_uuid").alias("id")))
    both = parent_edges(e).withColumn("kind", F.lit("parent")).unionByName(parent_edges(e, "logical_parent_id").withColumn("kind", F.lit("logical")))
    at = lambda c, i: F.element_at(F.split(c, "/"), i).cast("long")
    return both.select(at("child", 1).alias("conv_id"), at("child", 2).alias("child"), at("parent", 2).alias("parent"), "kind")


@query("""
WITH RECURSIVE s AS (
  SELECT vec_id AS k, 'request of ' || (vec_id // 129) || CASE WHEN vec_id % 400 = 77 THEN ' changed' ELSE '' END AS copy, vec_id % 500 = 300 AS entryless, vec_id % 129 = 0 AS first, vec_id % 700 = 650 AS torn, vec_id // 600 AS owner FROM embeddings),
e AS (
  SELECT c.k, c.copy, CASE WHEN c.torn THEN 'break' WHEN c.first THEN 'here' WHEN p.k IS NULL OR p.owner <> c.owner THEN 'break' WHEN p.entryless THEN 'here' WHEN p.copy = c.copy THEN 'up' ELSE 'break' END AS step
  FROM s c LEFT JOIN s p ON p.k = c.k - 1 WHERE NOT c.entryless),
r(k, node, forks) AS (SELECT k, k, 0 FROM e UNION ALL SELECT r.k, r.node - 1, forks + 1 FROM r JOIN e ON e.k = r.node WHERE e.step = 'up' AND forks < 128)
SELECT r.k AS vec_id, r.node AS origin, sha256('request of ' || (r.node // 129)) AS origin_hash FROM r JOIN e ON e.k = r.node WHERE e.step = 'here'""")
def original_occasions(t: Tables) -> DataFrame:
    """Sessions (one for each vector's id) in chains of 128 forks that copy one request: some copies differ or are missing, some sessions have two parents, and owners change within a chain."""
    k = F.col("vec_id")
    request = F.concat(F.lit("request of "), S(F.floor(k / 129)))
    first, torn = k % 129 == 0, k % 700 == 650
    c = t.embeddings.select("vec_id")
    parents = F.when(torn, F.array(S(k - 1), S(k - 2))).when(first, F.array().cast("array<string>")).otherwise(F.array(S(k - 1)))
    sessions = c.select(S(k).alias("id"), S(F.floor(k / 600)).alias("user_id"), F.lit("pi").alias("source_kind"), F.when(~first | torn, S(k - 1)).alias("parent_session"), parents.alias("parent_ids"))
    entries = c.where("vec_id % 500 <> 300").select(S(k).alias("session_id"), F.lit("main").alias("stream_id"), F.concat(F.lit("e"), S(F.floor(k / 129))).alias("entry_id"), F.concat(request, F.when(k % 400 == 77, " changed").otherwise("")).alias("raw_json"))
    anchor = [F.col("stream_id").alias("anchor_stream"), F.col("entry_id").alias("anchor_entry"), F.sha2(F.col("raw_json").cast("binary"), 256).alias("raw_hash")]
    found = occasions.originals(entries.select("session_id", "stream_id", "entry_id", *anchor), entries, sessions)
    origin = F.col("origin_session").cast("long")
    return found.select(F.col("session_id").cast("long").alias("vec_id"), origin.alias("origin"), F.sha2(F.concat(F.lit("request of "), S(F.floor(origin / 129))).cast("binary"), 256).alias("origin_hash"))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
e AS (SELECT l_orderkey AS o, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS entry_ids, count(DISTINCT CASE WHEN s_acctbal > 0 THEN l_suppkey END) AS contexts FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY 1),
m AS (
  SELECT p_partkey, p_brand, c_mktsegment, CASE WHEN o_orderstatus = 'F' THEN 'reflection' ELSE 'observation' END AS kind, CAST(o_orderkey AS VARCHAR) AS memory_id, CASE WHEN o_orderstatus = 'F' THEN 'sum' ELSE o_orderpriority END AS content, o_orderkey AS o
  FROM a JOIN part ON p_partkey = a.p JOIN orders ON o_orderkey = a.o JOIN customer ON c_custkey = o_custkey)
SELECT p_partkey, c_mktsegment AS user_id, CAST(row_number() OVER w AS INT) AS rank, kind, memory_id, content, coalesce(entry_ids, []) AS entry_ids, CAST(CASE WHEN p_partkey = 7 THEN coalesce(contexts, 0) ELSE 0 END AS BIGINT) AS contexts
FROM m LEFT JOIN e USING (o) WINDOW w AS (PARTITION BY p_partkey, c_mktsegment ORDER BY kind, memory_id) QUALIFY row_number() OVER w <= 20""")
def file_memory_index(t: Tables) -> DataFrame:
    """What every user remembers about every file, asked of an index that is built from the graph: the first 20 memories of each."""
    from annalist.operators.walks import fresh_folder
    from annalist.plans.file_index import FileIndex
    from annalist.plans.log_queries import _order_graph

    g = _order_graph(t)
    index = FileIndex.build(g, fresh_folder(t.spark, "file-index"))
    out = index.files_memory(limit=20)
    return out.select(F.col("relative_path").cast("long").alias("p_partkey"), "user_id", "rank", "kind", "memory_id", "content", "entry_ids", F.size("contexts").cast("long").alias("contexts"))


@query("""
WITH p AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(i // ((n + 7) // 8) AS INT) AS page FROM p""")
def keyset_pages(t: Tables) -> DataFrame:
    """All orders in eight pages, each found behind the last key of the one before."""
    from annalist.plans.keyset import Order, pages

    o = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    order = Order(("o_orderpriority", "o_totalprice", "o_orderkey"), frozenset({"o_orderpriority"}))
    out = None
    for i, found in enumerate(pages(o, order, max(1, -(-o.count() // 8)), snapshot="orders")):
        found = found.withColumn("page", F.lit(i))
        out = found if out is None else out.unionByName(found)
    return out


def _digest_of(group: dict) -> str:
    """The work of ``drain_outcomes``: some groups fail."""
    import hashlib

    if int(group["source_session_id"]) % 7 == 0:
        raise ValueError("the log of " + group["source_session_id"])
    return hashlib.sha256(",".join(group["ids"]).encode()).hexdigest()


@query("""
WITH g AS (SELECT user_id, count(*) AS notifications, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) AS ids FROM events GROUP BY user_id)
SELECT user_id, notifications, CASE WHEN user_id % 11 = 0 THEN 'expired' WHEN user_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 7 = 0 THEN 'ValueError: the log of ' || user_id ELSE sha256(ids) END AS detail FROM g""")
def drain_outcomes(t: Tables) -> DataFrame:
    """Events as notifications of their users' logs: a group a log, worked on executors; some groups fail, some waited too long for their source."""
    from annalist.sources.spool import groups
    from annalist.streaming.drain import KEYS, worked

    rows = t.events.select(F.lit("pi").alias("source_kind"), S("user_id").alias("source_session_id"), F.lit("p").alias("producer_id"), S("event_id").alias("id"), S("ts").alias("queued_at"))
    state = F.when(F.col("source_session_id").cast("long") % 11 == 0, "parked").otherwise("pending")
    out = worked(groups(rows, KEYS, ["queued_at", "id"]).withColumn("state", state), _digest_of)
    return out.select(F.col("source_session_id").cast("long").alias("user_id"), "notifications", "status", "detail")
