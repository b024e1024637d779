"""Queries over the driver's tables, each with its SQL: the relational shape of an operation on a table that has that shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import exprs as X
from annalist.operators.walks import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def n(c):
    return F.count(F.lit(1)).alias(c)


# Ordinals, offsets, hashes, summaries of logs


@query("""
SELECT conv_id, turn, row_number() OVER w - 1 AS ordinal, CAST(sum(strlen(coalesce(text, '')) + 1) OVER w AS BIGINT) AS next_byte_offset,
       CAST(sum(strlen(coalesce(text, '')) + 1) OVER w - strlen(coalesce(text, '')) - 1 AS BIGINT) AS byte_offset
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def entry_ordinal_offsets(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.conversations.select("conv_id", "turn", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), end.alias("next_byte_offset"), (end - size).alias("byte_offset"))


@query("SELECT conv_id, turn, sha256(text) AS payload_hash, sha256(CAST(conv_id AS VARCHAR) || chr(0) || CAST(turn AS VARCHAR)) AS record_id FROM conversations")
def payload_hash(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.sha256("text").alias("payload_hash"), X.sha256_nul(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"))


@query("""
SELECT conv_id, count(*) AS entry_count, CAST(sum(strlen(text)) AS BIGINT) AS log_bytes, CAST(max(strlen(text)) AS BIGINT) AS largest_entry_bytes,
       arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def log_summary(t: Tables) -> DataFrame:
    size = X.utf8_bytes("text")
    return t.conversations.groupBy("conv_id").agg(n("entry_count"), F.sum(size).alias("log_bytes"), F.max(size).alias("largest_entry_bytes"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"))


@query("SELECT p_partkey, 'urn:x:' || url_encode(p_name) || ':' || url_encode(p_brand) AS urn FROM part")
def urn_segments(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lit("urn:x:"), X.urn_segment("p_name"), F.lit(":"), X.urn_segment("p_brand")).alias("urn"))


_ORIGIN = """lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)', 1)) || '/' ||
 regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/([^?#]*)', 1), '^/+|/+$', '', 'g'), '\\.git$', '', 'i')"""


@query(f"SELECT page_id, {_ORIGIN} AS origin FROM pages")
def origin_normalize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.normalize_remote("url").alias("origin"))


@query(f"SELECT sha256({_ORIGIN}) AS repository_id, count(*) AS pages FROM pages GROUP BY 1")
def repository_ids(t: Tables) -> DataFrame:
    return t.pages.groupBy(X.sha256(X.normalize_remote("url")).alias("repository_id")).agg(n("pages"))


@query("SELECT conv_id, turn, CASE WHEN length(flat) > 60 THEN substr(flat, 1, 59) || '…' ELSE flat END AS content FROM (SELECT *, trim(regexp_replace(text, '[\\t\\n\\v\\f\\r ]+', ' ', 'g')) AS flat FROM conversations)")
def compact_content(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.compact("text", 60).alias("content"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, list_contains(json_keys(props), 'k') AS has_k, list_contains(json_keys(props), 'z') AS has_z FROM events")
def json_access(t: Tables) -> DataFrame:
    from annalist.sources.logs import has_key

    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), has_key(F.col("props"), "k").alias("has_k"), has_key(F.col("props"), "z").alias("has_z"))


@query("SELECT n AS attempt, CAST(least(60000, 1000 * pow(2, least(20, n - 1))) AS BIGINT) AS delay_ms FROM range(1, 26) r(n)")
def backoff_schedule(t: Tables) -> DataFrame:
    return t.spark.range(1, 26).select(F.col("id").alias("attempt"), X.backoff_ms("id").alias("delay_ms"))


_EXT = "lower(regexp_extract(regexp_extract(url, '^[^?#]*'), '\\.([^./\\\\]+)$', 1))"


@query(f"SELECT page_id, {_EXT} AS extension, {_EXT} IN ('html', 'htm') AS is_html FROM pages WHERE {_EXT} <> ''")
def language_filter(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", "^[^?#]*", 0)
    return t.pages.select("page_id", X.file_extension(path).alias("extension"), X.in_language(path, "html").alias("is_html")).where("extension is not null")


@query("""SELECT o_orderkey, regexp_full_match(o_orderpriority, '[A-Za-z0-9][A-Za-z0-9._-]{0,255}') AS stable_ok, strlen(o_orderpriority) BETWEEN 1 AND 512 AS host_ok,
 regexp_full_match(lower(md5(CAST(o_orderkey AS VARCHAR)))[1:12], '[a-f0-9]{12}') AS memory_ok FROM orders""")
def id_validators(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.stable_id_ok("o_orderpriority").alias("stable_ok"), X.host_id_ok("o_orderpriority").alias("host_ok"), X.memory_id_ok(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 12)).alias("memory_ok"))


# Incremental plans and ordered folds


@query("""
WITH c AS (SELECT user_id, max(event_id) AS cp FROM events WHERE day(ts) <= 15 GROUP BY user_id),
s AS (SELECT user_id, max(event_id) AS last, count(*) AS entries FROM events GROUP BY user_id)
SELECT s.user_id, entries, cp AS checkpoint, CASE WHEN cp IS NULL THEN 'pending' WHEN cp = last THEN 'unchanged' ELSE 'pending' END AS status FROM s LEFT JOIN c USING (user_id)""")
def checkpoint_plan(t: Tables) -> DataFrame:
    plan, _ = _event_plan(t)
    s = t.events.groupBy("user_id").agg(n("entries"), F.max(F.when(F.dayofmonth("ts") <= 15, F.col("event_id"))).alias("checkpoint"))
    return plan.join(s, "user_id").select("user_id", "entries", "checkpoint", "status")


def _event_plan(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A user's events are a log, of which the first half of the month is stored already."""
    from annalist.operators.sync import plan_sync

    text = lambda c: F.col(c).cast("string")
    entries = t.events.select("user_id", F.col("event_id").alias("ordinal"), F.col("event_id").alias("next_byte_offset"), F.sha2(text("event_id"), 256).alias("prefix_hash"))
    logs = entries.groupBy("user_id").agg(F.max("ordinal").alias("last"), n("entry_count"))
    logs = logs.select("user_id", F.sha2(text("last"), 256).alias("log_hash"), "entry_count", F.col("last").alias("log_bytes"), F.lit(0).cast("long").alias("header_next_byte_offset"), F.lit("h").alias("header_prefix_hash"))
    stored = t.events.where(F.dayofmonth("ts") <= 15).groupBy("user_id").agg(F.max("event_id").alias("cp_ordinal"))
    count = logs.select("user_id", F.col("entry_count").alias("cp_entry_count"))  # as if nothing had come since; the log's hash tells
    stored = stored.join(count, "user_id").select("user_id", "cp_ordinal", F.col("cp_ordinal").alias("cp_byte_offset"), F.sha2(text("cp_ordinal"), 256).alias("cp_prefix_hash"), F.sha2(text("cp_ordinal"), 256).alias("cp_log_hash"), "cp_entry_count")
    return plan_sync(logs, entries, stored, "user_id")


@query("SELECT e.user_id, e.event_id FROM events e LEFT JOIN (SELECT user_id, max(event_id) AS cp FROM events WHERE day(ts) <= 15 GROUP BY user_id) c USING (user_id) WHERE e.event_id > coalesce(cp, -1)")
def suffix_entries(t: Tables) -> DataFrame:
    return _event_plan(t)[1].select("user_id", F.col("ordinal").alias("event_id"))


@query("""
WITH RECURSIVE a(conv_id, turn, depth) AS (
  SELECT conv_id, max(turn), 0 FROM conversations GROUP BY conv_id UNION ALL
  SELECT c.conv_id, c.turn, depth + 1 FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1)
SELECT conv_id, turn, CAST(depth AS BIGINT) AS depth FROM a""")
def ancestor_walk(t: Tables) -> DataFrame:
    from annalist.operators.walks import ancestors

    last = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = t.conversations.join(last, "conv_id").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("entry_id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_id"), (F.col("turn") == F.col("last")).alias("is_leaf"))
    return ancestors(c).select(F.col("session_id").cast("long").alias("conv_id"), F.col("entry_id").cast("long").alias("turn"), "depth")


@query("""
WITH RECURSIVE a(conv_id, turn, root, depth) AS (
  SELECT conv_id, turn, turn, 0 FROM conversations UNION ALL
  SELECT a.conv_id, c.turn, root, depth + 1 FROM a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1 WHERE depth < 128)
SELECT conv_id, root AS turn, count(*) AS lineage, CAST(max(depth) AS BIGINT) AS depth FROM a GROUP BY conv_id, root""")
def lineage_closure(t: Tables) -> DataFrame:
    from annalist.operators.walks import lineage

    key = lambda turn: F.concat_ws("/", "conv_id", turn)
    c = t.conversations
    edges = c.where("turn > 0").select(key(F.col("turn")).alias("child"), key(F.col("turn") - 1).alias("parent"))
    found = lineage(c.select(key(F.col("turn")).alias("id")), edges, most=128)
    part = lambda i: F.element_at(F.split("id", "/"), i).cast("long")
    return found.groupBy("id").agg(n("lineage"), F.max("depth").cast("long").alias("depth")).select(part(1).alias("conv_id"), part(2).alias("turn"), "lineage", "depth")


@query("""
SELECT doc_id, text_key, ordinal = 1 AS accepted, ordinal > 1 AND source IS DISTINCT FROM first_source AS conflict FROM (
 SELECT doc_id, sha256(coalesce(text, '')) AS text_key, source, row_number() OVER w AS ordinal, first_value(source) OVER w AS first_source
 FROM documents WINDOW w AS (PARTITION BY coalesce(text, '') ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def first_definition_wins(t: Tables) -> DataFrame:
    from annalist.operators.memory import first_definitions

    lit = lambda v: F.lit(v)
    rows = t.documents.select(lit("pi").alias("source_kind"), lit("s").alias("source_session_id"), lit("p").alias("producer"), X.sha256(F.coalesce("text", F.lit(""))).alias("memory_id"),
                              lit(0).alias("origin"), F.col("doc_id").alias("ordinal"), lit(0).alias("at"), F.col("doc_id").cast("string").alias("record_id"), "source")
    winners, later = first_definitions(rows, ["source"], "observation")
    own = winners.select(F.col("ordinal").alias("first_id"), F.col("memory_id").alias("text_key"))
    clash = later.select(F.col("ordinal").alias("doc_id"), F.lit(True).alias("_clash"))
    out = rows.select(F.col("ordinal").alias("doc_id"), F.col("memory_id").alias("text_key")).join(own, "text_key").join(clash, "doc_id", "left")
    return out.select("doc_id", "text_key", (F.col("doc_id") == F.col("first_id")).alias("accepted"), F.coalesce("_clash", F.lit(False)).alias("conflict"))


@query("""
SELECT event_id, CASE WHEN ordinal = 1 THEN 'accepted' WHEN event_type = first_type THEN 'replay' ELSE 'conflict' END AS status FROM (
 SELECT *, row_number() OVER w AS ordinal, first_value(event_type) OVER w AS first_type FROM events WINDOW w AS (PARTITION BY user_id, props ORDER BY event_id ROWS UNBOUNDED PRECEDING))""")
def replay_detection(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id", "props").orderBy("event_id")
    first = F.first("event_type").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.events.select("event_id", F.when(F.row_number().over(w) == 1, "accepted").when(F.col("event_type") == first, "replay").otherwise("conflict").alias("status"))


@query("""
SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS blocked FROM events""")
def conflict_latch(t: Tables) -> DataFrame:
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.coalesce(F.bool_or(F.col("event_type") == "error").over(before), F.lit(False)).alias("blocked"))


@query("""
SELECT user_id, event_type, island, max(event_id) AS event_id, count(*) AS coalesced FROM (
 SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events)
WHERE event_type <> 'signup' GROUP BY user_id, event_type, island""")
def coalesce_barriers(t: Tables) -> DataFrame:
    from annalist.sources.spool import coalesced

    requests = t.events.select("user_id", "event_id", "event_type", (F.col("event_type") != "signup").alias("automatic"))
    return coalesced(requests, ["user_id"], "event_id", "event_type", "automatic").where("automatic").select("user_id", "event_type", "island", "event_id", "coalesced")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, CAST(strlen(text) AS BIGINT) AS b FROM conversations),
r AS (SELECT conv_id, turn, b, b AS size, CAST(0 AS BIGINT) AS batch FROM c WHERE turn = 0 UNION ALL
 SELECT c.conv_id, c.turn, c.b, CASE WHEN r.size + c.b > 400 THEN c.b ELSE r.size + c.b END, r.batch + CASE WHEN r.size + c.b > 400 THEN 1 ELSE 0 END FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
SELECT conv_id, turn AS ordinal, b AS payload_bytes, batch FROM r""")
def byte_batches(t: Tables) -> DataFrame:
    from annalist.operators.sync import byte_batches as batches

    rows = t.conversations.select("conv_id", F.col("turn").alias("ordinal"), X.utf8_bytes("text").alias("payload_bytes"))
    return batches(rows, ["conv_id"], limit=400).select("conv_id", "ordinal", "payload_bytes", "batch")


@query("SELECT doc_id, source FROM documents d WHERE NOT coalesce((SELECT bool_or(toxic = 1) FROM labels l WHERE l.doc_id = d.doc_id), false)")
def tombstones(t: Tables) -> DataFrame:
    dropped = t.labels.where("toxic = 1").select("doc_id")
    return t.documents.select("doc_id", "source").join(dropped, "doc_id", "left_anti")


# Retrieval


@query("""
WITH m AS (SELECT o.o_custkey, l.* FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
obs AS (
 SELECT 'observation' AS kind, l_orderkey AS memory_id, o_custkey AS owner, l_partkey AS file, list_sort(list(DISTINCT l_suppkey)) AS entries
 FROM m WHERE l_returnflag <> 'R' GROUP BY ALL),
ref AS (
 SELECT 'reflection' AS kind, l_orderkey AS memory_id, o_custkey AS owner, l_partkey AS file, list_sort(list(DISTINCT l_suppkey)) AS entries
 FROM m WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = m.l_orderkey AND o_orderstatus = 'F') GROUP BY ALL),
u AS (SELECT * FROM obs UNION ALL SELECT * FROM ref)
SELECT u.kind, u.memory_id, u.owner, u.file, u.entries FROM u JOIN customer c ON c.c_custkey = u.owner JOIN part p ON p.p_partkey = u.file
WHERE c_mktsegment = 'BUILDING' ORDER BY kind, memory_id, file LIMIT 200""")
def file_memory_surrogate(t: Tables) -> DataFrame:
    owner = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"))
    sessions = t.orders.select(F.col("o_orderkey").alias("memory_id"), F.col("o_custkey").alias("owner"), "o_orderstatus").join(owner, "owner", "left_semi")
    evidence = t.lineitem.select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("file"), "l_suppkey", "l_returnflag")
    m = sessions.join(evidence, "memory_id").join(t.part.select(F.col("p_partkey").alias("file")), "file", "left_semi")
    fold = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), "memory_id", "owner", "file").agg(X.distinct_sorted("l_suppkey").alias("entries"))
    both = fold(m.where("l_returnflag <> 'R'"), "observation").unionByName(fold(m.where("o_orderstatus = 'F'"), "reflection"))
    return both.orderBy("kind", "memory_id", "file").limit(200)  # top-k is the feature


@query("""
SELECT o_orderkey, coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_suppkey IS NOT NULL)), []) AS suppliers
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey""")
def optional_provenance(t: Tables) -> DataFrame:
    back = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(X.distinct_sorted("l_suppkey").alias("suppliers"))
    return t.orders.select("o_orderkey").join(back, "o_orderkey", "left").select("o_orderkey", F.coalesce("suppliers", F.array().cast("array<bigint>")).alias("suppliers"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_per_bucket(t: Tables) -> DataFrame:
    from annalist.plans.catalog import latest

    return latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")])


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) > 25 AS truncated FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25)")
def truncation_probe(t: Tables) -> DataFrame:
    from annalist.operators.runs import read_runs

    runs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("derivation_id"), F.col("o_orderdate").alias("created_at"))
    page, more = read_runs(runs, 25, history=True)
    return t.spark.createDataFrame([(r.id, more) for r in page], "o_orderkey long, truncated boolean")


@query("""
SELECT o_custkey, o_orderkey, (SELECT count(DISTINCT o_custkey) FROM orders) > 40 AS truncated FROM (
 SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) ORDER BY o_orderdate DESC, o_orderkey LIMIT 40""")
def latest_runs_page(t: Tables) -> DataFrame:
    from annalist.operators.runs import read_runs

    runs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("derivation_id"), F.col("o_orderdate").alias("created_at"))
    page, more = read_runs(runs, 40)  # a page of each customer's newest
    return t.spark.createDataFrame([(r.derivation_id, r.id, more) for r in page], "o_custkey long, o_orderkey long, truncated boolean")


@query("""
SELECT coalesce(a.c_custkey, b.c_custkey) AS id, CASE WHEN a.c_custkey IS NULL THEN 'remote' WHEN b.c_custkey IS NULL THEN 'local'
 WHEN a.c_mktsegment <> b.c_mktsegment THEN 'conflict' ELSE 'local+remote' END AS status
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal > 0) b USING (c_custkey)""")
def full_outer_status(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_acctbal")
    a = c.where("id % 3 <> 0").select("id", F.col("c_mktsegment").alias("a"))
    b = c.where("c_acctbal > 0").select("id", F.when(F.col("id") % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("b"))
    status = F.when(F.col("a").isNull(), "remote").when(F.col("b").isNull(), "local").when(F.col("a") != F.col("b"), "conflict").otherwise("local+remote")
    return a.join(b, "id", "full_outer").select("id", status.alias("status"))


@query("""
SELECT r.n_nationkey AS reader, count(*) AS suppliers FROM nation r JOIN supplier s ON EXISTS (
 SELECT 1 FROM nation o WHERE o.n_nationkey = s.s_nationkey AND (o.n_nationkey = r.n_nationkey OR o.n_regionkey = r.n_regionkey)) GROUP BY 1""")
def grants_authz(t: Tables) -> DataFrame:
    from annalist.operators.access import authorized_owners

    nation = t.nation.select("n_nationkey", "n_regionkey")
    grants = nation.select(F.col("n_nationkey").alias("owner_id"), "n_regionkey").join(nation.select(F.col("n_nationkey").alias("reader_id"), "n_regionkey"), "n_regionkey").select("owner_id", "reader_id", F.lit("read").alias("permission"))
    allowed = authorized_owners(nation.select(F.col("n_nationkey").alias("reader_id")), grants)
    return t.supplier.select(F.col("s_nationkey").alias("owner_id")).join(allowed, "owner_id").groupBy(F.col("reader_id").alias("reader")).agg(n("suppliers"))


@query("SELECT doc_id, 'unresolved-reference' AS diagnostic FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unresolved(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti").withColumn("diagnostic", F.lit("unresolved-reference"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphans(t: Tables) -> DataFrame:
    """Repositories (parts) that no session works on (no large order line names) are deleted; these are left."""
    from annalist.plans.catalog import drop_orphans

    worked = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("repository_id"))
    return drop_orphans(t.part.select(F.col("p_partkey").alias("id")), worked).select(F.col("id").alias("p_partkey"))


_ROOTS = "SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[a-z]+)', 1) FROM pages WHERE page_id % 2 = 0"


@query(f"SELECT page_id, root FROM pages, ({_ROOTS}) r WHERE starts_with(regexp_extract(url, '^[^?#]*'), root || '/') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(root) DESC) = 1")
def longest_prefix(t: Tables) -> DataFrame:
    from annalist.operators.containment import closest_root

    host = t.pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"))
    lang = t.pages.where("page_id % 2 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[a-z]+)", 1).alias("root"))
    paths = t.pages.select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    return closest_root(paths, host.union(lang).distinct()).select("page_id", "root")


@query("""
WITH f AS (SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY 1)
SELECT o_orderkey, CASE WHEN brands IS NOT NULL THEN brands WHEN o_custkey % 2 = 0 THEN [n_name] ELSE [] END AS scope
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def scope_fallback(t: Tables) -> DataFrame:
    from annalist.operators.scope import subject_scope

    brands = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    brands = brands.groupBy("o_orderkey").agg(X.distinct_sorted("p_brand").alias("evidenced"))
    home = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    rows = t.orders.select("o_orderkey", "o_custkey").join(home, "o_custkey").join(brands, "o_orderkey", "left")
    contexts = F.when(F.col("o_custkey") % 2 == 0, F.array("n_name")).otherwise(F.array("n_name", F.lit("other")))
    return rows.select("o_orderkey", subject_scope(F.col("evidenced"), contexts).alias("scope"))


@query("""
SELECT doc_id, list_sort(list(DISTINCT role)) AS roles FROM (
 SELECT doc_id, 'evidence' AS role FROM documents WHERE n_chars > 500 UNION ALL SELECT doc_id, 'historical-support' FROM labels WHERE quality = 1
 UNION ALL SELECT doc_id, 'comparison-dependency' FROM labels WHERE toxic = 1) GROUP BY doc_id""")
def roles_union(t: Tables) -> DataFrame:
    from annalist.operators.selection import union_roles

    return union_roles({"evidence": t.documents.where("n_chars > 500").select("doc_id"), "historical-support": t.labels.where("quality = 1").select("doc_id"), "comparison-dependency": t.labels.where("toxic = 1").select("doc_id")}, "doc_id")


@query("SELECT props, count(DISTINCT (user_id, event_type, CAST(ts AS DATE))) AS occasions FROM events GROUP BY props")
def distinct_occasions(t: Tables) -> DataFrame:
    return t.events.groupBy("props").agg(F.count_distinct(F.struct("user_id", "event_type", F.to_date("ts"))).alias("occasions"))


@query("SELECT sha256(text) AS text_key, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicates_having(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").groupBy(X.sha256("text").alias("text_key")).agg(n("copies")).where("copies > 1")


@query("SELECT event_id, CASE WHEN greatest(0, 1704412800000 - epoch_us(ts) // 1000) >= 600000 THEN 'parked' ELSE 'pending' END AS state, greatest(0, 1704412800000 - epoch_us(ts) // 1000) AS age_ms FROM events")
def notification_expiry(t: Tables) -> DataFrame:
    from annalist.sources.spool import expire

    rows = t.events.select("event_id", F.lit("pending").alias("state"), F.unix_millis(F.col("ts").cast("timestamp")).alias("file_mtime_ms"), F.lit(None).cast("string").alias("queued_at"))
    age = X.age_ms(F.lit(1704412800000), F.col("file_mtime_ms"), F.col("queued_at"))
    return expire(rows, 1704412800000, 600_000).select("event_id", "state", age.cast("long").alias("age_ms"))


@query("""
SELECT o_custkey, CAST(min(CASE o_orderstatus WHEN 'O' THEN 3 WHEN 'F' THEN 2 ELSE 1 END) AS BIGINT) AS version FROM orders GROUP BY o_custkey""")
def version_rollup(t: Tables) -> DataFrame:
    from annalist.plans.catalog import effective_version

    version = F.when(F.col("o_orderstatus") == "O", 3).when(F.col("o_orderstatus") == "F", 2)  # others have none
    found = effective_version(t.orders.select(F.col("o_custkey").alias("user_id"), version.alias("code_memory_version")))
    return found.select(F.col("user_id").alias("o_custkey"), F.col("code_memory_version").cast("long").alias("version"))


@query("""
SELECT CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS acknowledged, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed,
 CAST(count(*) FILTER (WHERE event_type = 'signup') AS BIGINT) AS expired, CAST(count(*) FILTER (WHERE event_type NOT IN ('click', 'error', 'signup')) AS BIGINT) AS waiting FROM events""")
def counters(t: Tables) -> DataFrame:
    from annalist.sources.spool import drain_report

    kind = F.col("event_type")
    status = F.when(kind == "click", "ok").when(kind == "error", "failed").when(kind == "signup", "expired").otherwise("waiting")
    outcomes = t.events.groupBy(F.col("user_id").alias("group"), status.alias("status")).agg(n("notifications"))
    return drain_report(outcomes).select(*[F.col(c).cast("long").alias(c) for c in ("acknowledged", "failed", "expired", "waiting")])


@query("SELECT 'lineitem' AS name, count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_keys, count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS is_key FROM lineitem")
def key_uniqueness(t: Tables) -> DataFrame:
    from annalist.plans.catalog import key_report

    return key_report(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"])


@query("""
WITH a AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0), b AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey < 12)
SELECT 'missing' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'extra', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def snapshot_diff(t: Tables) -> DataFrame:
    from annalist.plans.catalog import snapshot_difference

    c = t.customer
    return snapshot_difference(c.where("c_acctbal > 0").select("c_custkey", "c_mktsegment"), c.where("c_nationkey < 12").select("c_custkey", "c_mktsegment"))


@query("""
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice
FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0) o
FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'N' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0) n USING (o_orderkey)""")
def upsert_merge(t: Tables) -> DataFrame:
    from annalist.plans.catalog import merge_rows

    o = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return merge_rows(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"])


# Catalog


@query("""
WITH r AS (SELECT l_partkey AS k, l_suppkey AS p FROM lineitem WHERE l_linenumber > 3), o AS (SELECT l_partkey AS k, l_suppkey AS p FROM lineitem WHERE l_linenumber <= 3),
u AS (SELECT * FROM r UNION ALL SELECT * FROM o WHERE k IN (SELECT k FROM r))
SELECT k AS l_partkey FROM u GROUP BY k HAVING min(p) IS DISTINCT FROM max(p)""")
def insert_conflicts(t: Tables) -> DataFrame:
    """Keys (parts) whose immutable payload (the supplier) differs among new rows or from the stored ones."""
    from annalist.plans.catalog import payload_conflicts

    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_linenumber")
    return payload_conflicts(rows.where("l_linenumber > 3"), rows.where("l_linenumber <= 3"), ["l_partkey"], "l_suppkey")


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'projected' ELSE o_orderstatus END AS state FROM orders WHERE NOT (o_custkey % 3 = 0 AND o_orderstatus = 'F')""")
def projection_replace(t: Tables) -> DataFrame:
    """The orders of every third customer are replaced as a whole, two tables in one commit; only their buckets are written anew."""
    from annalist.plans.catalog import Catalog

    catalog = Catalog(t.spark, fresh_folder(t.spark, "replace"), {"observations": ("o_custkey", 8), "about": ("o_custkey", 8)})
    rows = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state"))
    scope = rows.where("o_custkey % 3 = 0").select("o_custkey").distinct()
    catalog.replace_all({"observations": rows, "about": rows.select("o_custkey", "o_orderkey")}, rows.select("o_custkey").distinct(), ["o_custkey"])
    new = rows.where("o_custkey % 3 = 0 and state <> 'F'").withColumn("state", F.lit("projected"))
    catalog.replace_all({"observations": new, "about": new.select("o_custkey", "o_orderkey")}, scope, ["o_custkey"])
    return catalog.read("observations").join(catalog.read("about"), ["o_custkey", "o_orderkey"], "left_semi").select("o_orderkey", "o_custkey", "state")


@query("""
SELECT c_custkey, 'replica' AS origin, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new', c_mktsegment FROM customer WHERE c_custkey % 2 = 1""")
def insert_if_absent(t: Tables) -> DataFrame:
    """Known keys keep their row, new ones are appended, to a table that a catalog holds."""
    from annalist.plans.catalog import Catalog

    catalog = Catalog(t.spark, fresh_folder(t.spark, "insert"))
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    catalog.insert_new("entries", rows.where("c_custkey % 2 = 0").withColumn("origin", F.lit("replica")), ["c_custkey"], "segment")
    catalog.insert_new("entries", rows.withColumn("origin", F.lit("new")), ["c_custkey"], "segment")
    return catalog.read("entries").select("c_custkey", "origin", "segment")


@query("""
SELECT conv_id, turn, '"' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"' AS quoted FROM conversations""")
def quoted_text(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.quoted("text").alias("quoted"))


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'default' WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS producer,
 substr(s_name, 1, 1) || '***@x.org' AS masked, CASE WHEN s_suppkey % 4 > 0 THEN CASE WHEN s_suppkey % 10 = 0 THEN CAST(s_suppkey // 10 AS VARCHAR) ELSE (s_suppkey // 10) || '.' || (s_suppkey % 10) END || ' ms' ELSE 'n/a' END AS shown FROM supplier""")
def display_forms(t: Tables) -> DataFrame:
    s = t.supplier
    producer = F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.col("s_name"))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "pi").otherwise("other")
    return s.select("s_suppkey", X.input_producer(kind, producer, "default").alias("producer"), X.mask_email(F.concat("s_name", F.lit("@x.org"))).alias("masked"), X.format_ms(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") / 10)).alias("shown"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS path, regexp_extract(url, '^(https?://[^/]+)', 1) AS host FROM pages),
r AS (SELECT DISTINCT host AS root, page_id % 3 AS repository FROM p), s AS (SELECT root, min(repository) AS repository FROM r GROUP BY root)
SELECT page_id, root, repository FROM (SELECT * FROM p UNION ALL SELECT * FROM p WHERE page_id % 2 = 0) JOIN s ON starts_with(path, root || '/')""")
def prefix_ties(t: Tables) -> DataFrame:
    """Equal roots of several repositories, the first of which wins, and paths that stand twice."""
    from annalist.operators.containment import closest_root

    p = t.pages.select("page_id", F.regexp_extract("url", "^[^?#]*", 0).alias("path"))
    roots = t.pages.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"), (F.col("page_id") % 3).alias("repository")).distinct()
    return closest_root(p.unionByName(p.where("page_id % 2 = 0")), roots, order=["repository"]).select("page_id", "root", "repository")
