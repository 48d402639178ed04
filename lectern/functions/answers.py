"""JSON out of a model's answer, slash commands and texts about sources and filters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL | re.IGNORECASE)
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"?|[{}\[\]]', re.DOTALL)
_CLOSES = {"{": "}", "[": "]"}


def repair_brackets(text: str) -> str:
    """Close what is left open, before a bracket of the other kind and at the end; strings are not looked into."""
    still: list[str] = []

    def fix(m: re.Match) -> str:
        t = m[0]
        if t in _CLOSES:
            still.append(_CLOSES[t])
        elif t in _CLOSES.values():
            missing = ""
            while still and still[-1] != t:
                missing += still.pop()
            if still:
                still.pop()
            return missing + t
        return t

    fixed = _TOKEN.sub(fix, text)
    return fixed + "".join(reversed(still))


def json_text(answer: str | None) -> str | None:
    """The JSON of an answer: a fenced block, else from the first opening to the last closing bracket, else all."""
    if answer is None:
        return None
    text = answer.strip()
    fenced = _FENCE.search(text)
    if fenced:
        return repair_brackets(fenced[1].strip())
    first = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    last = max(text.rfind("}"), text.rfind("]"))
    return repair_brackets(text[first : last + 1] if 0 <= first <= last else text)


@F.pandas_udf(StringType())
def extract_json(answers: pd.Series) -> pd.Series:
    """:func:`json_text` by Arrow batch: the repair keeps a stack, which no built-in function does."""
    return answers.map(json_text, na_action="ignore")


def string_list(answer: Column) -> Column:
    """The non-blank strings of the first ``[...]`` in an answer; no list gives an empty one."""
    held = F.from_json(F.regexp_extract(answer, r"(?s)(\[.*?\])", 1), "array<string>")
    return F.coalesce(F.filter(held, lambda s: s.isNotNull() & (F.trim(s) != "")), F.array().cast("array<string>"))


# Commands and the actions they name.
COMMANDS = {"/cikis": "exit", "/temizle": "clear", "/debug": "toggle_debug", "/yardim": "show_help"}
ASKING = {"/müfettiş": "mufettis", "/mufettis": "mufettis", "/rapor": "rapor"}


def command(raw: Column) -> Column:
    """struct(action, query, source_index, failed) of an input line."""
    low = F.trim(F.lower(raw))
    parts = F.split(low, r"(?U)\s+")
    number = F.get(parts, 1)
    rest = F.regexp_extract(raw, r"(?sU)^\s*\S+\s+(\S.*)$", 1)
    none, nowhere = F.lit(None).cast("string"), F.lit(None).cast("int")

    def row(action: str, query: Column = none, index: Column = nowhere, failed: Column | None = None) -> Column:
        return F.struct(F.lit(action).alias("action"), query.alias("query"), index.alias("source_index"), (F.lit(False) if failed is None else failed).alias("failed"))

    out = F.when(low.isNull() | (low == ""), row("empty"))
    for name, action in COMMANDS.items():
        out = out.when(low == name, row(action))
    is_number = F.coalesce(number.rlike(r"^\d+$"), F.lit(False))
    out = out.when(low.startswith("/kaynak"), row("show_source", none, F.when(is_number, number.try_cast("int") - 1), ~is_number))
    for name, action in ASKING.items():
        out = out.when(low.startswith(name), row(action, F.nullif(rest, F.lit("")), nowhere, rest == ""))
    return out.when(low.startswith("/"), row("unknown_command", failed=F.lit(True))).otherwise(row("normal_query", raw))


def summary(pairs: list[tuple[str, Column]]) -> Column:
    """``key=value`` of the values that are set; null, empty and 0 are left out."""
    text = lambda v: v.cast("string")
    return F.concat_ws(", ", *[F.when(v.isNotNull() & ~text(v).isin("", "0"), F.concat(F.lit(f"{k}="), text(v))) for k, v in pairs])


def filled(*choices: Column) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])
