"""Notification spools: one small JSON file each, naming a log to read. Scanned, validated, grouped, expired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions import exprs as X

#: Bytes of a memory notification, at most.
MAX_NOTIFICATION = 4096
#: A notification waits this long for its source before it is parked.
PARK_AFTER_MS = 600_000

_MEMORY_KEYS = ["id", "producerId", "queuedAt", "sidecarLocator", "sourceKind", "sourceSessionId", "version"]


def scan_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Every notification file of a folder, see ``memory_notifications``."""
    return memory_notifications(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder))


def memory_notifications(raw: DataFrame) -> DataFrame:
    """Files (as ``binaryFile`` rows) -> fields, file_mtime_ms, state (pending or rejected) and rejection_reason. The shape is closed: another key rejects it."""
    body = F.decode("content", "UTF-8")
    v = F.try_parse_json(body)
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.unix_millis("modificationTime").alias("file_mtime_ms"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"), v.alias("v"), F.array_sort(F.json_object_keys(body)).alias("keys"))
    rows = rows.select("*", text("id").alias("id"), F.try_variant_get("v", "$.version", "int").alias("version"), text("sourceKind").alias("source_kind"), text("sourceSessionId").alias("source_session_id"), text("producerId").alias("producer_id"), text("sidecarLocator").alias("locator"), text("queuedAt").alias("queued_at"))
    identity = X.protocol_id_ok("source_kind") & X.host_id_ok("source_session_id") & X.protocol_id_ok("producer_id")
    own = X.locator_path(F.col("source_kind"), F.col("source_session_id"), F.col("producer_id"))
    reason = (
        F.when(F.col("length") > MAX_NOTIFICATION, "too-large")
        .when(~F.col("utf8") | F.col("v").isNull() | F.col("keys").isNull(), "malformed-json")
        .when(F.col("keys") != F.array(*[F.lit(k) for k in _MEMORY_KEYS]), "unexpected-shape")
        .when(F.coalesce(F.col("version"), F.lit(0)) != 1, "unsupported-version")
        .when(~X.uuid_ok("id") | (F.col("name") != F.concat("id", F.lit(".json"))), "invalid-id")
        .when(~identity, "invalid-identity")
        .when(~F.coalesce(F.col("locator").endswith(own), F.lit(False)), "invalid-locator")
        .when(~X.timestamp_ok("queued_at"), "invalid-queued-at")
    )
    return rows.select("id", F.lit("memory").alias("kind"), "source_kind", "source_session_id", "producer_id", "locator", "queued_at", "file_mtime_ms", F.when(reason.isNull(), "pending").otherwise("rejected").alias("state"), reason.alias("rejection_reason"), "name")


def scan_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """Pending transcript notifications in order of name; files that are not JSON objects are left for a later pass."""
    schema = "version int, id string, event string, `session-id` string, `transcript-path` string, cwd string, `queued-at` string, `parent-transcript-path` string, `agent-id` string, _corrupt string"
    raw = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json").json(folder)
    raw = raw.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).where("_corrupt is null")
    return raw.select("name", "id", "event", F.col("`session-id`").alias("session_id"), F.col("`transcript-path`").alias("transcript_path"), "cwd", F.col("`queued-at`").alias("queued_at"), F.col("`parent-transcript-path`").alias("parent_transcript_path"), F.col("`agent-id`").alias("agent_id")).orderBy("name")


def pending(notifications: DataFrame) -> DataFrame:
    return notifications.where("state = 'pending'").orderBy("queued_at", "id")


def expire(notifications: DataFrame, now_ms: int, window_ms: int = PARK_AFTER_MS, missing_sources: DataFrame | None = None) -> DataFrame:
    """Parks pending notifications that waited at least ``window_ms`` (1 s to 24 h) by file time, else by queued_at; with ``missing_sources`` only theirs."""
    if not 1000 <= window_ms <= 86_400_000:
        raise ValueError("the window is 1 second to 24 hours")
    due = (F.col("state") == "pending") & X.expired(X.age_ms(F.lit(now_ms), F.col("file_mtime_ms"), F.col("queued_at")), window_ms)
    rows = notifications
    if missing_sources is not None:
        keys = ["source_kind", "source_session_id"]
        rows = rows.join(missing_sources.select(*keys, F.lit(True).alias("_missing")).distinct(), keys, "left")
        due = due & F.coalesce("_missing", F.lit(False))
    return rows.withColumn("state", F.when(due, "parked").otherwise(F.col("state"))).select(*notifications.columns)


def groups(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last notification of each group, with the ids of all and the place of the first, by which groups are worked off."""
    place = F.struct(*order)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in by]), place)
    return rows.groupBy(*by).agg(last.alias("_l"), F.array_sort(F.collect_list("id")).alias("ids"), F.min(place).alias("first_place")).select(*by, *[F.col(f"_l.{c}").alias(c) for c in rows.columns if c not in by], "ids", "first_place")


def coalesced(requests: DataFrame, queue: list[str], order: str, path: str, automatic: str) -> DataFrame:
    """Waiting requests as they are worked off: automatic ones for one path become the newest of them, in the place of the first, but never across an explicit request; those all stay.

    Adds place (the ``order`` of the first), island (explicit requests up to it) and coalesced (how many it stands for). A queue is sorted by one task; null paths are one path.
    """
    before = Window.partitionBy(*queue).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    barrier = ~F.coalesce(F.col(automatic), F.lit(False))
    rows = requests.withColumn("island", F.count_if(barrier).over(before)).withColumn("_own", F.when(barrier, F.col(order)))
    keys = [*queue, "island", path, "_own"]
    last = F.max_by(F.struct(*[c for c in requests.columns if c not in keys]), F.col(order))
    out = rows.groupBy(*keys).agg(last.alias("_l"), F.min(order).alias("place"), F.count(F.lit(1)).alias("coalesced"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_l.{c}") for c in requests.columns], "island", "place", "coalesced")


def drain_report(outcomes: DataFrame) -> DataFrame:
    """outcomes(group, status: ok, failed, expired, waiting; notifications): one row of counters. A failed group keeps its notifications."""
    count = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("notifications"))), F.lit(0)).alias({"ok": "acknowledged"}.get(s, s))
    return outcomes.agg(*[count(s) for s in ("ok", "failed", "expired", "waiting")])


def latest_locators(rows: DataFrame) -> DataFrame:
    """Manifest of transcripts by session and agent: the last path noted counts."""
    return rows.groupBy("session_id", "agent_id").agg(F.max_by("transcript_path", F.struct("queued_at", "id")).alias("transcript_path")).orderBy("session_id", F.asc_nulls_first("agent_id"))


def parse_worktrees(listing: DataFrame) -> DataFrame:
    """listing(repository_id, porcelain: NUL-separated ``git worktree list --porcelain -z``) -> repository_id, root, commit, branch (null: detached), bare."""
    blocks = listing.select("repository_id", F.posexplode(F.split("porcelain", "\0\0")).alias("at", "block")).where("block <> ''")
    fields = F.split(F.regexp_replace("block", "^\0+|\0+$", ""), "\0")
    value = lambda name: F.get(F.transform(F.filter(fields, lambda f: f.startswith(name + " ")), lambda f: F.substring(f, len(name) + 2, 1 << 20)), F.lit(0))
    return blocks.select("repository_id", value("worktree").alias("root"), value("HEAD").alias("commit"), F.regexp_replace(value("branch"), "^refs/heads/", "").alias("branch"), F.array_contains(fields, "bare").alias("bare")).where("root is not null")


# Changes, made by the driver: files appear whole, under their final name, and repeating a change is harmless


def _put(spark: SparkSession, path: str, body: bytes) -> bool:
    """Write a file next to its place and give it its name; False if the name is taken. Of two writers of one name one has it: a rename takes no name that is there, and
    on a local file system, where it would, a link does not."""
    import uuid

    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    out = fs.create(staged, False)
    try:
        out.write(bytearray(body))
        out.hsync()
    finally:
        out.close()
    if fs.getUri().getScheme() == "file":
        place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(place(target), place(staged))
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        finally:
            fs.delete(staged, False)
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        return False
    return True


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False)


def _body(n: dict) -> bytes:
    import json

    wire = {"version": 1, "id": n["id"], "queuedAt": n["queued_at"], "sourceKind": n["source_kind"], "sourceSessionId": n["source_session_id"], "producerId": n["producer_id"], "sidecarLocator": n["locator"]}
    body = (json.dumps(wire, ensure_ascii=False, separators=(",", ":")) + "\n").encode()
    if len(body) > MAX_NOTIFICATION:
        raise ValueError("the notification is too large")
    return body


def enqueue(spark: SparkSession, folder: str, notification: dict) -> str:
    """A new active notification, named by its id; returns its path."""
    path = f"{folder.rstrip('/')}/{notification['id']}.json"
    if not _put(spark, path, _body(notification)):
        raise FileExistsError(path)
    return path


def park(spark: SparkSession, folder: str, archive: str, notification: dict) -> str:
    """Keep one notification for each locator in the archive (the one that is there wins), then acknowledge it."""
    import hashlib

    path = f"{archive.rstrip('/')}/{hashlib.sha256(notification['locator'].encode()).hexdigest()}.json"
    _put(spark, path, _body(notification))
    acknowledge(spark, folder, notification)
    return path


def requeue(spark: SparkSession, folder: str, parked_path: str, notification: dict, new_id: str) -> str:
    """A fresh active notification for a parked one, which then goes; after a crash in between both are there, which does no harm."""
    made = enqueue(spark, folder, notification | {"id": new_id})
    _drop(spark, parked_path)
    return made


def acknowledge(spark: SparkSession, folder: str, notification: dict) -> None:
    """Remove an active notification; one that is gone already is fine. The id is checked, so that nothing outside the folder can be named."""
    if "/" in notification["id"] or notification["id"] in ("", ".", ".."):
        raise ValueError("no notification of this folder")
    _drop(spark, f"{folder.rstrip('/')}/{notification['id']}.json")
