"""Named recipes: a closed configuration document of at most 256 KiB."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Row, SparkSession

MAX_BYTES = 256 * 1024
SCOPES = ("personal", "repository", "group", "session")
NAME = "[a-z][a-z0-9_-]{0,63}"
_KEYS = {"version", "guidance", "categories", "scope-types", "inferred-min-distinct-occasions", "limits", "model"}
_LIMITS = {"max-input-tokens", "max-output-tokens", "timeout-ms"}


class RecipeError(ValueError):
    pass


def _parse(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise RecipeError("the document is not JSON, and no YAML reader is installed") from e
    if re.search(r"(?m)(^|[\s\[{,:-])[&*][A-Za-z0-9_]", text):
        raise RecipeError("aliases are not allowed")
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RecipeError("malformed document") from e


def _positive(v: object) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and v > 0


def _check(name: str, r: object) -> None:
    ok = (
        re.fullmatch(NAME, str(name)) and isinstance(r, dict) and set(r) <= _KEYS and _positive(r.get("version")) and isinstance(r.get("guidance"), str) and r["guidance"].strip()
        and isinstance(r.get("scope-types"), list) and r["scope-types"] and set(r["scope-types"]) <= set(SCOPES) and _positive(r.get("inferred-min-distinct-occasions"))
        and isinstance(r.get("limits"), dict) and set(r["limits"]) <= _LIMITS and _positive(r["limits"].get("max-output-tokens")) and all(map(_positive, r["limits"].values()))
    )
    categories, model = (r.get("categories") or {}, r.get("model")) if isinstance(r, dict) else ({}, None)
    ok = ok and isinstance(categories, dict) and all(re.fullmatch(NAME, str(k)) and isinstance(v, str) for k, v in categories.items())
    if not ok or not (model is None or (isinstance(model, dict) and set(model) == {"provider", "id"})):
        raise RecipeError(f"invalid recipe {name!r}")


def read_recipes(text: str) -> dict[str, dict]:
    if len(text.encode()) > MAX_BYTES:
        raise RecipeError("the document is larger than 256 KiB")
    found = _parse(text)
    if not isinstance(found, dict):
        raise RecipeError("a document maps names to recipes")
    for name, recipe in found.items():
        _check(name, recipe)
    return found


def recipe_table(spark: SparkSession, recipes: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([Row(name=n, recipe_json=json.dumps(r, sort_keys=True)) for n, r in sorted(recipes.items())], "name string, recipe_json string")
