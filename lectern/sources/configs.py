"""Registries and settings from YAML: read on the driver, since a session has one of each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # optional
    yaml = None


def load(text: str) -> dict:
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package")
    out = yaml.safe_load(text) or {}
    if not isinstance(out, dict):
        raise ValueError("a mapping is needed at the top")
    return out


@dataclass(frozen=True)
class Retrieval:
    """Settings of retrieval; a file may name any of them, and others are passed over."""

    top_k: int = 10
    fetch_k: int = 50
    distance_threshold: float = 1.8
    context_max_chars: int = 1500
    context_total_max_chars: int = 12000


@dataclass(frozen=True)
class Settings:
    retrieval: Retrieval = Retrieval()
    budgets: dict[str, tuple[int, int, int]] = field(default_factory=dict)


def settings(text: str) -> Settings:
    """Typed settings: values take their field's type, a value that does not fit is an error."""
    raw = load(text)
    given = raw.get("retrieval") or {}
    kinds = {"top_k": int, "fetch_k": int, "distance_threshold": float, "context_max_chars": int, "context_total_max_chars": int}
    known = {k: kinds[k](v) for k, v in given.items() if k in kinds and v is not None}
    budgets = {k: (int(b["retrieval"]), int(b["reserve"]), int(b["fetch_k"])) for k, b in (raw.get("budgets") or {}).items()}
    return Settings(Retrieval(**known), budgets)


def collections(spark: SparkSession, text: str) -> DataFrame:
    """(name, model, document_type, dim, weight) of each collection that a registry names, its model's numbers joined in."""
    raw = load(text)
    models = raw.get("models") or {}
    rows = []
    for name, c in (raw.get("collections") or {}).items():
        model = c.get("model")
        if model is not None and model not in models:
            raise ValueError(f"collection {name} names an unknown model {model}")
        rows.append((name, model, c.get("document_type", "custom"), (models.get(model) or {}).get("dim"), float(c.get("weight", 1.0))))
    return spark.createDataFrame(rows, "name string, model string, document_type string, dim int, weight double")


def heading(label: Column, text: Column) -> Column:
    """An atom's text, headings with a mark for each level: ``heading_2`` or a bare ``heading``."""
    level = F.coalesce(F.regexp_extract(label, r"_([0-9]+)$", 1).try_cast("int"), F.lit(1))
    return F.when(F.contains(F.lower(label), F.lit("heading")), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.trim(text))).otherwise(F.trim(text))


def inline_texts(requests: DataFrame, key: str = "dokuman_metni") -> tuple[DataFrame, DataFrame]:
    """Documents whose text stands in their metadata, and the errors of those without one."""
    text = F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit(""))
    read = requests.withColumn("text", text)
    return read.filter(F.col("text") != ""), read.filter(F.col("text") == "").select("document_id", F.lit(f"metadata.{key} is missing").alias("error"))
