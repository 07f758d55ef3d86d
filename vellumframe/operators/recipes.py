"""Pipelines of named steps, each an operator of this library with described parameters, checked before anything runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.pages import replace_terms
from .classes import classify_simple
from .ordering import split_every_n
from .records import csv_guard, safe_filename
from .sensitive import PRESETS, html_text, pii_redact

MOST_STEPS = 10


@dataclass(frozen=True)
class Parameter:
    """kind: number, text, boolean or select."""

    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    options: tuple[str, ...] = ()

    def error(self, name: str, value: Any) -> str | None:
        if value is None or value == "":
            return f"{name} is required" if self.required else None
        if self.kind == "number":
            try:
                number = float(value) if isinstance(value, int | float | str) and not isinstance(value, bool) else None
            except ValueError:
                number = None
            if number is None or number != number:
                return f"{name} must be a number"
            if self.least is not None and number < self.least:
                return f"{name} cannot be less than {self.least}"
            if self.most is not None and number > self.most:
                return f"{name} cannot exceed {self.most}"
        elif self.kind == "text":
            if not isinstance(value, str):
                return f"{name} must be text"
            if self.required and not value.strip():
                return f"{name} cannot be empty"
        elif self.kind == "boolean":
            if not isinstance(value, bool) and value not in ("true", "false"):
                return f"{name} must be true or false"
        elif isinstance(value, list | dict) or str(value) not in self.options:
            return f"{name} has invalid value {value!r}"
        return None

    def value(self, given: Any) -> Any:
        if given is None or given == "":
            return None
        return {"number": float, "boolean": lambda x: x in (True, "true")}.get(self.kind, str)(given)


@dataclass(frozen=True)
class Tool:
    parameters: dict[str, Parameter]
    run: Callable[..., DataFrame]


COLUMN = Parameter("text")


def _on(f: Callable[..., Column], **parameters: Parameter) -> Tool:
    """A tool that rewrites one column."""
    return Tool({"column": COLUMN, **parameters}, lambda df, column, **rest: df.withColumn(column, f(F.col(column), **rest)))


TOOLS: dict[str, Tool] = {
    "filter_min": Tool({"column": COLUMN, "least": Parameter("number")}, lambda df, column, least: df.filter(F.col(column) >= least)),
    "upper": _on(F.upper),
    "add": _on(lambda c, amount: c + amount, amount=Parameter("number")),
    "to_int": _on(lambda c: c.try_cast("int")),
    "normalize": _on(T.normalize),
    "mask": _on(T.mask_sensitive),
    "redact": _on(lambda c, kind: pii_redact(c, [kind]), kind=Parameter("select", options=tuple(PRESETS))),
    "replace": _on(lambda c, find, to, whole_word: replace_terms(c, [("word" if whole_word else "literal", find, to or "")]), find=COLUMN, to=Parameter("text", required=False), whole_word=Parameter("boolean", required=False)),
    "page_text": _on(html_text),
    "file_name": _on(lambda c, variant: safe_filename(c, variant or "strict"), variant=Parameter("select", required=False, options=("strict", "title", "shared"))),
    "guard": _on(csv_guard, policy=Parameter("select", options=("strict", "numeric", "raw"))),
    "classify": Tool({"column": COLUMN}, lambda df, column: classify_simple(df, column)),
    "split": Tool({"size": Parameter("number", least=1, most=100_000)}, lambda df, size: split_every_n(df, int(size))),
}


def recipe_errors(steps: Any, name: str | None = None) -> list[str]:
    """Everything that is wrong with a recipe's steps, and with its name where one is given."""
    out = ["a recipe needs a name"] if name is not None and not name.strip() else []
    if not isinstance(steps, list) or not 1 <= len(steps) <= MOST_STEPS:
        return [*out, f"a recipe has 1 to {MOST_STEPS} steps"]
    for k, s in enumerate(steps, 1):
        tool = TOOLS.get(s.get("tool")) if isinstance(s, dict) else None
        if tool is None:
            out.append(f"step {k}: unknown tool {s.get('tool') if isinstance(s, dict) else s!r}")
            continue
        given = s.get("parameters") or {}
        found = [p.error(n, given.get(n)) for n, p in tool.parameters.items()]
        out += [f"step {k}, {s['tool']}: {e}" for e in found if e]
    return out


def validate_recipe(steps: list[dict], name: str | None = None) -> list[dict]:
    """The steps; ValueError with all errors if there are any."""
    errors = recipe_errors(steps, name)
    if errors:
        raise ValueError("; ".join(errors))
    return steps


def run_recipe(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Compose validated steps into one plan. A row whose value a step loses keeps `failed_step` (from 1) and its value
    is null; other rows go on."""
    out = df.withColumn("failed_step", F.lit(None).cast("int"))
    for k, s in enumerate(validate_recipe(steps), 1):
        tool, given = TOOLS[s["tool"]], s.get("parameters") or {}
        values = {n: p.value(given.get(n)) for n, p in tool.parameters.items()}
        column = values.get("column")
        if column is None:
            out = tool.run(out, **values)
            continue
        out = tool.run(out.withColumn("_before", F.col(column).isNotNull()), **values)
        lost = F.col("failed_step").isNull() & F.col("_before") & F.col(column).isNull()
        out = out.withColumn("failed_step", F.when(lost, k).otherwise(F.col("failed_step"))).drop("_before")
    return out


def load_recipe(text: str, most_bytes: int = 100_000, depth: int = 5) -> list[dict]:
    """Recipe from JSON of bounded size and depth."""
    if len(text.encode()) > most_bytes:
        raise ValueError("recipe too large")
    got = json.loads(text)

    def deep(x: object) -> int:
        return 1 + max(map(deep, x.values() if isinstance(x, dict) else x), default=0) if isinstance(x, dict | list) else 0

    if deep(got) > depth:
        raise ValueError("recipe nested too deep")
    return validate_recipe(got["steps"], got.get("name", ""))


def dump_recipe(name: str, steps: list[dict]) -> str:
    return json.dumps({"name": name, "steps": validate_recipe(steps, name)})
