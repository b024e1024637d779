"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages, the file extensions that mean them, and other names of languages.
LANGUAGE_EXTENSIONS = {
    "python": ["py", "pyi"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "clojure": ["clj", "cljc"],
    "clojurescript": ["cljs", "cljc"],
    "edn": ["edn"],
    "java": ["java"],
    "kotlin": ["kt", "kts"],
    "rust": ["rs"],
    "go": ["go"],
    "ruby": ["rb"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "h"],
    "shell": ["sh", "bash", "zsh"],
    "sql": ["sql"],
    "html": ["html", "htm"],
    "css": ["css"],
    "json": ["json"],
    "yaml": ["yaml", "yml"],
    "markdown": ["md", "markdown"],
}
LANGUAGE_ALIASES = {
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "clj": "clojure",
    "cljs": "clojurescript",
    "c++": "cpp",
    "sh": "shell",
    "yml": "yaml",
    "md": "markdown",
}
#: First part of every identifier.
NAMESPACE = "urn:annalist"
#: White space as the source logs' language sees it: ASCII, no-break, and the Unicode spaces.
SPACES = "[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
SAFE_INTEGER = 9007199254740991


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256(c: str | Column) -> Column:
    c = col(c)
    return F.sha2(c.cast("binary"), 256)


def sha256_nul(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return sha256(F.concat_ws("\0", *[col(p) for p in parts]))


def utf8_bytes(c: str | Column) -> Column:
    return F.octet_length(col(c)).cast("long")


def utf16_units(c: str | Column) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("long")


def utf16_order(c: str | Column) -> Column:
    """A key that sorts as UTF-16 code units do."""
    return F.hex(F.encode(col(c), "UTF-16BE"))


def urn_segment(c: str | Column) -> Column:
    """Percent-encodes everything but ASCII letters, digits and - . _ ~."""
    out = F.url_encode(col(c))
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def normalize_remote(c: str | Column) -> Column:
    """host/path of a Git remote in scp or URL form, without credentials, port, outer slashes and .git; null if it is neither."""
    c = F.trim(col(c))
    url = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]+)?/([^?#]*)"
    scp = r"^(?:[^@/:]+@)?([^/:]+):([^/].*|/.+)$"
    is_url = c.contains("://")
    host = F.when(is_url, F.regexp_extract(c, url, 1)).otherwise(F.regexp_extract(c, scp, 1))
    path = F.when(is_url, F.regexp_extract(c, url, 2)).otherwise(F.regexp_extract(c, scp, 2))
    path = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), r"(?i)\.git$", "")
    return F.when((host != "") & (path != ""), F.concat(F.lower(host), F.lit("/"), path))


def normalize_origin(c: str | Column) -> Column:
    """Like ``normalize_remote``, and a bare host/path is taken as such."""
    c = F.trim(col(c))
    return F.coalesce(normalize_remote(c), F.when(~c.contains("://") & c.contains("/"), normalize_remote(F.concat(F.lit("https://"), c))))


def origin_option(c: str | Column) -> Column:
    """An origin's form for display, free of credentials."""
    return F.concat(F.lit("https://"), normalize_origin(c))


def compact(c: str | Column, limit: int = 500) -> Column:
    """White space collapsed, trimmed, and cut with an ellipsis beyond ``limit`` UTF-16 units."""
    flat = F.regexp_replace(F.regexp_replace(col(c), SPACES + "+", " "), "^ | $", "")
    return F.when(utf16_units(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def file_extension(c: str | Column) -> Column:
    """Lower-case extension of the last path segment; null without one."""
    found = F.regexp_extract(F.lower(col(c)), r"\.([^./\\]+)$", 1)
    return F.when(found != "", found)


def language_name(value: str) -> str:
    low = value.strip().lower()
    return LANGUAGE_ALIASES.get(low, low)


def in_language(path: str | Column, language: str) -> Column:
    language = language_name(language)
    return F.coalesce(file_extension(path).isin(*LANGUAGE_EXTENSIONS[language]), F.lit(False))


def backoff_ms(attempt: str | Column, initial: int = 1000, most: int = 60000) -> Column:
    return F.least(F.lit(float(most)), F.lit(float(initial)) * F.pow(F.lit(2.0), F.least(F.lit(20), col(attempt) - 1))).cast("long")


def age_ms(now: Column, mtime_ms: Column, queued_at: Column) -> Column:
    return F.greatest(F.lit(0), now - F.coalesce(mtime_ms, F.unix_millis(F.try_to_timestamp(queued_at))))


def expired(age: Column, window_ms: int | Column) -> Column:
    return age >= window_ms


def timestamp_ok(c: str | Column) -> Column:
    c = col(c)
    return F.coalesce((F.octet_length(c) <= 64) & c.endswith("Z") & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def matches(c: str | Column, pattern: str) -> Column:
    """Whole-string match; null does not match."""
    return F.coalesce(col(c).rlike(f"^(?:{pattern})\\z"), F.lit(False))


def protocol_id_ok(c: str | Column) -> Column:
    return matches(c, "[a-z0-9][a-z0-9._-]{0,127}")


def stable_id_ok(c: str | Column) -> Column:
    return matches(c, "[A-Za-z0-9][A-Za-z0-9._-]{0,255}")


def host_id_ok(c: str | Column) -> Column:
    c = col(c)
    return F.coalesce(F.octet_length(c).between(1, 512) & ~c.rlike("[\\x00-\\x1f\\x7f]"), F.lit(False))


def memory_id_ok(c: str | Column) -> Column:
    return matches(c, "[a-f0-9]{12}")


def sha256_ok(c: str | Column) -> Column:
    return matches(c, "[a-f0-9]{64}")


def uuid_ok(c: str | Column) -> Column:
    return matches(c, "[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")


def locator_path(kind: Column, session: Column, producer: Column) -> Column:
    return F.concat(kind, F.lit("/"), sha256(session), F.lit("/"), producer, F.lit(".jsonl"))


def mask_email(c: str | Column) -> Column:
    """The first letter and the domain; what has no name before its first @ is hidden whole."""
    found = F.regexp_extract(col(c), r"(?s)^([^@])[^@]*(@.*)$", 0) != ""
    return F.when(found, F.regexp_replace(col(c), r"(?s)^([^@])[^@]*(@.*)$", "$1***$2")).when(col(c).isNotNull(), "***")


def format_ms(ms: str | Column) -> Column:
    """Milliseconds for display, rounded to a tenth that is left out if it is zero; null (never measured) as n/a."""
    tenths = F.floor(col(ms).cast("double") * 10 + 0.5).cast("long")
    shown = F.regexp_replace((tenths / 10).cast("decimal(30,1)").cast("string"), r"\.0$", "")
    return F.coalesce(F.concat(shown, F.lit(" ms")), F.lit("n/a"))


def input_producer(kind: str | Column, producer: str | Column, default: str) -> Column:
    """The producer of a source's input; a blank one of kind pi is the ``default``."""
    blank = F.trim(F.coalesce(col(producer), F.lit(""))) == ""
    return F.when((col(kind) == "pi") & blank, F.lit(default)).otherwise(col(producer))


def quoted(c: str | Column) -> Column:
    """The value as a JSON string in quotes, with controls (also C1, line separators and marks of direction, which JSON leaves alone) escaped."""
    body = F.to_json(F.array(col(c)))
    body = F.substring(body, F.lit(2), F.length(body) - 2)
    bad = F.regexp_extract_all(body, F.lit("([\\x7f-\\x9f\\u2028-\\u202e\\u2066-\\u2069])"))
    escape = lambda out, x: F.replace(out, x, F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(F.encode(x, "UTF-16BE")), 4, "0"))))
    return F.when(col(c).isNull(), F.lit("null")).otherwise(F.aggregate(F.array_distinct(bad), body, escape))


def input_cap(window: Column, *output_caps: Column, configured: Column | None = None) -> Column:
    """Tokens left for input: the window without the smallest output cap and a margin of 1024, at most what is configured."""
    room = window - (F.least(*output_caps) if len(output_caps) > 1 else output_caps[0]) - 1024
    return room if configured is None else F.least(room, configured)


# URNs


def user_urn(user: Column) -> Column:
    return F.concat(F.lit(f"{NAMESPACE}:user:"), user)


def session_urn(user: Column, kind: Column, session: Column) -> Column:
    return F.concat_ws(":", F.lit(f"{NAMESPACE}:session"), user, kind, session)


def stream_urn(user: Column, kind: Column, session: Column, stream: Column) -> Column:
    return F.concat_ws(":", F.lit(f"{NAMESPACE}:stream"), user, kind, session, stream)


def entry_urn(user: Column, kind: Column, session: Column, entry: Column) -> Column:
    return F.concat_ws(":", F.lit(f"{NAMESPACE}:entry"), user, kind, session, entry)


def memory_urn(what: str, *parts: Column) -> Column:
    """``what``: observation or reflection; every part is percent-encoded."""
    return F.concat_ws(":", F.lit(f"{NAMESPACE}:{what}"), *[urn_segment(p) for p in parts])


def repository_urn(origin: Column, user: Column | None = None, root: Column | None = None) -> Column:
    shared = F.concat(F.lit(f"{NAMESPACE}:repository:git:"), sha256(origin))
    if user is None:
        return shared
    return F.coalesce(shared, F.concat(F.lit(f"{NAMESPACE}:repository:local:"), user, F.lit(":"), sha256(root)))


def file_urn(repository: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{NAMESPACE}:file:"), sha256_nul(repository, path))


def identity_urn(email: Column) -> Column:
    return F.concat(F.lit(f"{NAMESPACE}:identity:git-email:"), sha256(F.lower(F.trim(email))))


def synthetic_event_id(user: Column, kind: Column, session: Column, producer: Column, entry: Column) -> Column:
    return F.concat(F.lit("pi-"), sha256_nul(user, kind, session, producer, entry))


def distinct_sorted(c: str | Column) -> Column:
    """Aggregate: the distinct values that are not null, ascending."""
    return F.array_sort(F.collect_set(col(c)))
