"""Derivations: fingerprints of what went in, reuse and freshness tests, the ordered checks of what came out, and the request's wire form.

Memories of one derivation are bounded by the model's input window, so after selection (which is distributed) these work on driver-side rows; fingerprints of
whole tables stay in a UDF.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from annalist.functions import exprs as X
from annalist.functions.canonical import fingerprint, parse_json, snapshot_json

POLICY_VERSION = 3
HEADROOM = 1024
# What counts of a memory, in its payload's names, and which of its lists are sets.
PAYLOAD = (
    "id", "owner-id", "session-id", "kind", "producer", "content", "source-kind", "source-session-id", "timestamp", "relevance", "recording-entry-id", "recording-event-id",
    "recording-record-id", "source-entries", "source-occasions", "supporting-memory-ids", "repository-origins", "repository-ids", "linked-paths", "source-contexts",
)
SETS = ("source-entries", "source-occasions", "supporting-memory-ids", "repository-origins", "repository-ids", "linked-paths", "source-contexts")


def normal_origin(value: object) -> str | None:
    """Driver-side twin of ``exprs.normalize_origin``."""
    if not isinstance(value, str):
        return None
    v = value.strip()
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]+)?/([^?#]*)", v) if "://" in v else re.match(r"^(?:[^@/:]+@)?([^/:]+):([^/].*|/.+)$", v)
    if not m and "://" not in v and re.fullmatch(r"[^/:\s@?#]+/[^\s?#]+", v):
        m = re.match(r"^([^/]+)/(.*)$", v)
    if not m:
        return None
    path = re.sub(r"\.git$", "", m[2].strip("/"), flags=re.IGNORECASE)
    return f"{m[1].lower()}/{path}" if m[1] and path else None


def payload(memory: dict) -> dict:
    """What a fingerprint covers: known keys only, sets without repeats and in a fixed order, origins normalised, dropped false unless true."""
    out = {k: memory[k] for k in PAYLOAD if k in memory}
    out["dropped?"] = bool(memory.get("dropped?"))
    if "repository-origins" in out:
        out["repository-origins"] = [o for o in map(normal_origin, out["repository-origins"] or []) if o]
    for k in SETS:
        if k in out:
            out[k] = [v for _, v in sorted({snapshot_json(v): v for v in out[k] or []}.items())]
    return out


@F.pandas_udf(StringType())
def memory_fingerprint(raw: pd.Series) -> pd.Series:
    """Fingerprint of each memory, given as JSON in the payload's names."""
    return raw.map(lambda t: None if t is None else fingerprint(payload(parse_json(t))))


def derivation_id(reader: str, name: str, filter_: dict, depth: str = "full") -> str:
    return f"{X.NAMESPACE}:derivation:" + fingerprint([reader, name, filter_, *([depth] if depth != "full" else [])])


def input_fingerprint(reader: str, filter_: dict, depth: str, candidate_ids: Iterable[str], evidence: Iterable[dict]) -> str:
    return fingerprint({"reader-id": reader, "filter": filter_, "depth": depth, "candidate-ids": sorted(candidate_ids), "evidence": [payload(m) for m in sorted(evidence, key=lambda m: m["id"])]})


def configuration_fingerprint(recipe: dict) -> str:
    return fingerprint({"policy-version": POLICY_VERSION, "recipe": recipe})


def shown(memories: list[dict], depth: str) -> list[dict]:
    want = {"evidence", "historical-support"} if depth == "full" else {"evidence"}
    return [m for m in memories if want & set(m.get("roles", ()))]


def dependencies_current(run: dict, by_id: dict[str, dict]) -> bool:
    return all(i in by_id and fingerprint(payload(by_id[i])) == run["dependency-fingerprints"].get(i) for i in run["input-memory-ids"])


def reusable(run: dict | None, *, identity: str, depth: str, input_print: str, config_print: str, model: dict, direct_ids: set[str], by_id: dict[str, dict]) -> bool:
    """A saved run stands in for a new one if it is the same derivation, depth, input, configuration and model, has all direct inputs, and no dependency changed."""
    return bool(
        run and run.get("derivation-id") == identity and run.get("depth", "full") == depth and run.get("input-fingerprint") == input_print
        and run.get("configuration-fingerprint") == config_print and run.get("model") == model and direct_ids <= set(run["input-memory-ids"]) and dependencies_current(run, by_id)
    )


def freshness(run: dict, *, identity: str, readable_ids: set[str], input_print: str | None, config_print: str, by_id: dict[str, dict]) -> str:
    """current, outdated, or unavailable (not this derivation's, or an input that the reader may not see). ``input_print`` None: selection fails now."""
    if run.get("derivation-id") != identity or not set(run["input-memory-ids"]) <= readable_ids:
        return "unavailable"
    same = input_print is not None and input_print == run.get("input-fingerprint") and config_print == run.get("configuration-fingerprint")
    return "current" if same and dependencies_current(run, by_id) else "outdated"


def changed_dependencies(runs: DataFrame, memories: DataFrame) -> DataFrame:
    """Over tables: runs(id, dependency_fingerprints map), memories(id, fingerprint) -> id, status: outdated if any dependency is gone or changed, else current."""
    deps = runs.select("id", F.explode_outer("dependency_fingerprints").alias("memory_id", "was"))
    now = memories.select(F.col("id").alias("memory_id"), F.col("fingerprint").alias("is_now"))
    same = F.col("memory_id").isNull() | F.coalesce(F.col("was") == F.col("is_now"), F.lit(False))
    return deps.join(now, "memory_id", "left").groupBy("id").agg(F.when(F.bool_and(same), "current").otherwise("outdated").alias("status"))


# Output checks


class OutputRejected(ValueError):
    """``reason``: the first check that fails."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


_CONCLUSION = {"id", "content", "category", "basis", "scope-type", "scope-subject-ids", "supporting-memory-ids", "conflicting-memory-ids"}
SCOPES = ("personal", "repository", "group", "session")


def _ids(v: object, least: int = 0) -> bool:
    return isinstance(v, list) and len(v) >= least and all(isinstance(x, str) and x.strip() and len(x.encode("utf-8", "surrogatepass")) <= 2048 for x in v) and len(set(v)) == len(v)


def _text(v: object, most: int) -> bool:
    return isinstance(v, str) and bool(v.strip()) and len(v.encode("utf-8", "surrogatepass")) <= most and not re.search("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", v)


def _conclusion(c: object) -> bool:
    if not isinstance(c, dict) or set(c) != _CONCLUSION or c["scope-type"] not in SCOPES or c["basis"] not in ("explicit", "inferred"):
        return False
    subjects = c["scope-subject-ids"]
    enough = _ids(subjects) and (len(subjects) >= 2 if c["scope-type"] == "group" else len(subjects) == 1)
    return (
        enough and _text(c["id"], 128) and _text(c["content"], 65536) and isinstance(c["category"], str) and re.fullmatch("[a-z][a-z0-9_-]{0,63}", c["category"]) is not None
        and _ids(c["supporting-memory-ids"], 1) and _ids(c["conflicting-memory-ids"])
    )


def _link(k: object) -> bool:
    return isinstance(k, dict) and set(k) == {"relation", "from", "to"} and k["relation"] in ("contradicts", "supersedes") and all(isinstance(k[x], str) and k[x] for x in ("from", "to"))


def decode_output(text: str) -> dict:
    try:
        value = parse_json(text)
    except ValueError:
        raise OutputRejected("response-json") from None
    if not isinstance(value, dict) or set(value) != {"conclusions", "links"} or not all(isinstance(value[k], list) and all(isinstance(x, dict) for x in value[k]) for k in value):
        raise OutputRejected("response-wire-shape")
    return value


@dataclass
class Allowed:
    """What a response may name, from the selected memories."""

    candidates: set[str]
    sources: set[str]
    subjects: dict[str, set[str]]
    prior: dict[str, dict]
    occasions: Callable[[list[str]], int]


def allowed(memories: list[dict], candidate_ids: Iterable[str], depth: str, prior: list[dict], occasions: Callable[[list[str]], int]) -> Allowed:
    seen = shown(memories, depth)
    owners = {m["owner-id"] for m in seen}
    subjects = {"personal": owners, "group": owners, "session": {m["session-id"] for m in seen}, "repository": {r for m in seen for r in m.get("repository-ids") or []}}
    return Allowed(set(candidate_ids), {m["id"] for m in seen}, subjects, {c["id"]: c for c in prior}, occasions)


def validate_output(recipe: dict, ok: Allowed, response: dict) -> dict:
    """Raises with the first of eleven reasons, in a fixed order."""
    cs, links = response.get("conclusions"), response.get("links")
    shape = isinstance(cs, list) and isinstance(links, list) and all(map(_conclusion, cs)) and all(map(_link, links)) and len({c["id"] for c in cs}) == len(cs)
    if not shape:
        raise OutputRejected("response-shape")
    new = {c["id"]: c for c in cs}
    known = ok.prior | new
    categories = recipe.get("categories") or {}
    scope = lambda c: (c["scope-type"], frozenset(c["scope-subject-ids"]))
    checks: list[tuple[str, Callable[[], bool]]] = [
        ("category-not-configured", lambda: all(not categories or c["category"] in categories for c in cs)),
        ("scope-not-configured", lambda: all(c["scope-type"] in recipe["scope-types"] for c in cs)),
        ("support-not-eligible", lambda: all(set(c["supporting-memory-ids"]) <= ok.candidates for c in cs)),
        ("conflict-not-eligible", lambda: all(set(c["conflicting-memory-ids"]) <= ok.sources for c in cs)),
        ("subject-not-in-evidence", lambda: all(set(c["scope-subject-ids"]) <= ok.subjects[c["scope-type"]] for c in cs)),
        ("inferred-below-threshold", lambda: all(c["basis"] == "explicit" or ok.occasions(c["supporting-memory-ids"]) >= recipe["inferred-min-distinct-occasions"] for c in cs)),
        ("conclusion-id-collision", lambda: not set(new) & set(ok.prior)),
        ("link-endpoint", lambda: all(k["from"] in new and k["to"] in known and k["from"] != k["to"] for k in links)),
        ("supersedes-target-not-prior", lambda: all(k["relation"] == "contradicts" or k["to"] in ok.prior for k in links)),
        ("link-scope-mismatch", lambda: all(scope(known[k["from"]]) == scope(known[k["to"]]) for k in links)),
    ]
    for reason, holds in checks:
        if not holds():
            raise OutputRejected(reason)
    return response


# Request


class TooLarge(ValueError):
    def __init__(self, measured: int, available: int):
        super().__init__("the complete input exceeds the context or the configured budget")
        self.measured, self.available = measured, available


def aliases(original_ids: Iterable[str]) -> dict[str, str]:
    """Short names i0, i1, ... of sorted ids, leaving out names that are ids themselves."""
    ids = sorted({i for i in original_ids if i})
    taken, out, n = set(ids), {}, 0
    for i in ids:
        while f"i{n}" in taken:
            n += 1
        out[i] = f"i{n}"
        n += 1
    return out


def restore(response: dict, short: dict[str, str], prior: Iterable[str]) -> dict:
    """Names in a response turned back: any id in its lists, and in ids and links only those of prior conclusions."""
    back = {v: k for k, v in short.items()}
    old = {short.get(p, p) for p in prior}
    ref, own = (lambda i: back.get(i, i)), (lambda i: back.get(i, i) if i in old else i)
    fields = ("supporting-memory-ids", "conflicting-memory-ids", "scope-subject-ids")
    return {
        "conclusions": [{**c, "id": own(c.get("id")), **{f: [ref(x) for x in c[f]] for f in fields if isinstance(c.get(f), list)}} for c in response["conclusions"]],
        "links": [{**k, "from": own(k.get("from")), "to": own(k.get("to"))} for k in response["links"]],
    }


def input_cap(recipe: dict, model: dict) -> tuple[int, int]:
    """(input tokens, output tokens) that a request may use."""
    limits = recipe.get("limits", {})
    output = min(limits["max-output-tokens"], model["max-output-tokens"])
    available = model["context-window"] - output - HEADROOM
    return min(available, limits.get("max-input-tokens", available)), output


def utf8_measure(text: str) -> int:
    """Upper bound of tokens where no tokenizer is given."""
    return len(text.encode())


# Providers whose models' tokenizers are known, and the encoding that one of them has for all models it does not name.
ENCODED_PROVIDERS = {"openai": None, "openai-codex": "o200k_base", "azure-openai": None}
ENCODINGS = ("o200k_base", "cl100k_base")


def model_encoding(model: dict, named: Callable[[str], str | None]) -> str | None:
    """The encoding to estimate a model's tokens by, or none. named: an encoding's name by that of a model."""
    if model["provider"] not in ENCODED_PROVIDERS:
        return None
    found = named(model["id"])
    return found if found in ENCODINGS else ENCODED_PROVIDERS[model["provider"]]


def token_estimate(count: Callable[[str], int]) -> Callable[..., int]:
    """A measure by a tokenizer's count over all texts: a fifth more, and 32 tokens of framing."""
    return lambda *texts: 32 + math.ceil(1.2 * sum(map(count, texts)))


def prepare(*, reader: str, name: str, filter_: dict, depth: str, recipe: dict, model: dict, memories: list[dict], candidate_ids: list[str], comparison: dict | None = None, cached: dict | None = None, measure: Callable[[str], int] = utf8_measure) -> dict:
    """Either {status: reused, run} or {status: prepared, request, run, aliases}. memories carry roles."""
    by_id = {m["id"]: m for m in memories}
    seen = shown(memories, depth)
    identity = derivation_id(reader, name, filter_, depth)
    prints = input_fingerprint(reader, filter_, depth, candidate_ids, seen), configuration_fingerprint(recipe)
    key = {k: model[k] for k in ("provider", "id", "context-window", "max-output-tokens")}
    if reusable(cached, identity=identity, depth=depth, input_print=prints[0], config_print=prints[1], model=key, direct_ids={m["id"] for m in seen}, by_id=by_id):
        return {"status": "reused", "run": cached}
    prior = (comparison or {}).get("conclusions", [])
    refs = [x for m in memories for x in (m["id"], m["owner-id"], m["session-id"], *(m.get("repository-ids") or []), *(m.get("supporting-memory-ids") or []))]
    refs += [x for c in prior for x in (c["id"], *c["scope-subject-ids"], *c["supporting-memory-ids"], *c["conflicting-memory-ids"])] + [(comparison or {}).get("id")]
    short = aliases(refs)
    cap, output = input_cap(recipe, model)
    lists, single = ("repository-ids", "supporting-memory-ids", "conflicting-memory-ids", "scope-subject-ids"), ("id", "owner-id", "session-id")
    rename = lambda d: {k: [short.get(x, x) for x in v or []] if k in lists else short.get(v, v) if k in single else v for k, v in d.items()}
    wire = {
        "depth": depth, "configuration": recipe, "filter": filter_, "candidate-memory-ids": [short[i] for i in sorted(candidate_ids)],
        "memories": [rename(payload(m)) for m in sorted(seen, key=lambda m: m["id"])], "comparison": {"id": short.get(comparison["id"]), "conclusions": [rename(c) for c in prior]} if comparison else None,
    }
    text = snapshot_json(wire)
    tokens = measure(text)
    if cap <= 0 or tokens > cap:
        raise TooLarge(tokens, max(0, cap))
    run = {
        "depth": depth, "derivation-id": identity, "configuration-version": recipe.get("version"), "configuration-fingerprint": prints[1], "input-fingerprint": prints[0], "model": key,
        "measured-input-tokens": tokens, "input-memory-count": len(seen), "input-memory-ids": sorted(by_id), "comparison-run-id": (comparison or {}).get("id"),
        "dependency-fingerprints": {i: fingerprint(payload(m)) for i, m in by_id.items()}, "dependency-roles": {i: sorted(m.get("roles", ())) for i, m in by_id.items()},
    }
    return {"status": "prepared", "request": {"payload": text, "max-output-tokens": output, "model": key}, "run": run, "aliases": short, "prior": [c["id"] for c in prior]}


def complete(run: dict, response: dict, token: str, created_at: str) -> dict:
    """The finished run: conclusions get ids of their own, links follow them."""
    run_id = f"{X.NAMESPACE}:derivation-run:{token}"
    own = {c["id"]: f"{X.NAMESPACE}:derived-observation:" + fingerprint([run_id, c["id"]]) for c in response["conclusions"]}
    return {**run, "id": run_id, "created-at": created_at, "conclusions": [{**c, "id": own[c["id"]]} for c in response["conclusions"]], "links": [{**k, "from": own[k["from"]], "to": own.get(k["to"], k["to"])} for k in response["links"]]}


def refresh_all(recipes: dict[str, dict], refresh: Callable[[str, dict], dict], name: str | None = None) -> list[dict]:
    """Every recipe (or the named one) in order of name; one that fails is reported by code and does not stop the others."""
    if name is not None and name not in recipes:
        raise KeyError("unknown-derivation")
    out = []
    for n in [name] if name else sorted(recipes):
        try:
            out.append({**refresh(n, recipes[n]), "name": n})
        except TooLarge as e:
            out.append({"name": n, "status": "failed", "code": "input-too-large", "measured-input-tokens": e.measured, "available-input-tokens": e.available})
        except OutputRejected as e:
            out.append({"name": n, "status": "failed", "code": "invalid-output", "validation-reason": e.reason})
        except Exception as e:  # reported without the text of the error, which may quote sources
            out.append({"name": n, "status": "failed", "code": getattr(e, "code", "executor-failed")})
    return out
