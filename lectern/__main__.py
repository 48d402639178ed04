"""Verbs over requests, the manifest and the registry: ``python -m lectern VERB``; rows are printed as JSON lines.

The manifest is a keyed store (``sources.buckets``), the registry a YAML file.
A verb that finds errors, or has nothing to act on, ends with a status of 1.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import manifest as S
from lectern.sources import adapters, buckets, configs, ingest

#: Rows that a verb prints; it says how many more there are.
SHOWN = 1_000


def show(rows: DataFrame, out=None) -> int:
    """Print the first rows as JSON lines and give the number of all."""
    out = out or sys.stdout
    held = rows.limit(SHOWN).toJSON().collect()
    for line in held:
        print(line, file=out)
    n = len(held) if len(held) < SHOWN else rows.count()
    if n > len(held):
        print(json.dumps({"more": n - len(held)}), file=out)
    return n


def registry(spark: SparkSession, path: str) -> DataFrame:
    return configs.collections(spark, Path(path).read_text(encoding="utf-8"))


def validate(spark: SparkSession, a) -> int:
    """Errors of a request: of itself, and of its documents."""
    rows = ingest.ingest_request(spark, a.request)
    known = [r.name for r in registry(spark, a.registry).select("name").collect()]
    if not rows.head(1):
        print(json.dumps({"error": "no documents of a known version"}))
        return 1
    return int(show(S.validate(rows, known, adapters.types()).orderBy("position", "error")) > 0)


def diff(spark: SparkSession, a) -> int:
    """Each document of a request as new, changed or unchanged against the manifest."""
    rows = ingest.ingest_request(spark, a.request).withColumn("content_hash", F.try_element_at("metadata", F.lit("content_hash")))
    states = S.diff(rows.select(*S.KEY, "content_hash"), buckets.read(spark, a.store))
    return int(show(states.select("document_id", "collection", "state").orderBy("collection", "document_id")) == 0)


def status(spark: SparkSession, a) -> int:
    """Documents by collection and status, or with ``--report`` their mean times."""
    rows = buckets.read(spark, a.store)
    for column, value in (("collection", a.collection), ("document_type", a.document_type)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    shown = S.perf_trends(rows) if a.report else S.counts(rows, ["collection", "status"])
    return int(show(shown.orderBy("collection")) == 0)


def delete(spark: SparkSession, a) -> int:
    """Take a document out of the manifest; its bucket alone is rewritten."""
    key = spark.createDataFrame([(a.document, a.collection)], "document_id string, collection string")
    if not buckets.read(spark, a.store).join(key, S.KEY, "left_semi").head(1):
        print(json.dumps({"error": f"no document {a.document} in {a.collection}"}))
        return 1
    batch = max(buckets.versions(spark, a.store), default=-1) + 1
    buckets.merge(a.store, key, batch, S.delete)
    print(json.dumps({"deleted": a.document, "batch": batch}))
    return 0


def list_collections(spark: SparkSession, a) -> int:
    return int(show(registry(spark, a.registry).orderBy("name")) == 0)


def list_types(spark: SparkSession, a) -> int:
    for name in adapters.types():
        print(json.dumps({"document_type": name}))
    return 0


def add_collection(spark: SparkSession, a) -> int:
    """Add a collection to the registry; a registry that would not load is put back as it was."""
    import yaml

    path = Path(a.registry)
    before = path.read_text(encoding="utf-8")
    raw = configs.load(before)
    if a.name in (raw.get("collections") or {}):
        print(json.dumps({"error": f"collection {a.name} is there"}))
        return 1
    raw.setdefault("collections", {})[a.name] = {"model": a.model, "document_type": a.document_type, "weight": a.weight}
    made = path.with_suffix(".new")
    made.write_text(yaml.safe_dump(raw, allow_unicode=True, sort_keys=False), encoding="utf-8")
    os.replace(made, path)
    try:
        added = registry(spark, a.registry).filter(F.col("name") == a.name)
        if a.document_type not in adapters.types():
            raise ValueError(f"unknown document type {a.document_type}; there are {', '.join(adapters.types())}")
        return int(show(added) == 0)
    except Exception as e:
        path.write_text(before, encoding="utf-8")
        print(json.dumps({"error": str(e)}))
        return 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description=__doc__.split("\n", 1)[0])
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *arguments: str, **more) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=(run.__doc__ or name).split("\n", 1)[0])
        for x in arguments:
            p.add_argument(x, required=True) if x.startswith("--") else p.add_argument(x)
        p.set_defaults(run=run)
        return p

    verb("validate", validate, "request", "--registry")
    verb("diff", diff, "request", "--store")
    p = verb("status", status, "--store")
    p.add_argument("--collection")
    p.add_argument("--document-type")
    p.add_argument("--report", action="store_true")
    verb("delete", delete, "document", "--collection", "--store")
    verb("list-collections", list_collections, "--registry")
    verb("list-types", list_types)
    p = verb("add-collection", add_collection, "name", "--registry", "--model", "--document-type")
    p.add_argument("--weight", type=float, default=1.0)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("lectern").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
