"""Adapters by document type: how the documents of a request become texts, and texts become chunks.

An adapter works on all documents of its type at once. A type is added by
registering an adapter under its name; nothing else changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import metadata as D
from lectern.operators import chunking as C

#: Requests (document_id, document_type, document_source, metadata) to the same with a text, null if there is none.
Reader = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Adapter:
    read: Reader
    least: int = 400
    most: int = 1500

    def chunks(self, texts: DataFrame) -> DataFrame:
        """(document_id, chunk, text) of the texts that were read."""
        docs = texts.filter(F.col("text") != "").select(F.col("document_id").alias("doc_id"), "text")
        return C.greedy_pack(docs, self.least, self.most).select(F.col("doc_id").alias("document_id"), "chunk", "text")

    @staticmethod
    def content_hash(text: Column) -> Column:
        return D.text_hash(text)


def inline(key: str) -> Reader:
    """Texts that stand in their request's metadata."""
    return lambda requests: requests.withColumn("text", F.nullif(F.try_element_at("metadata", F.lit(key)), F.lit("")))


def converted(root: str) -> Reader:
    """Texts that a converter left as rows (document_id, text) in Parquet under ``root``."""

    def read(requests: DataFrame) -> DataFrame:
        texts = requests.sparkSession.read.parquet(root).select("document_id", "text")
        return requests.join(texts, "document_id", "left")

    return read


#: The registry. The types whose files need a converter are registered with its output's place.
ADAPTERS: dict[str, Adapter] = {"press_clip": Adapter(inline("dokuman_metni"))}


def register(document_type: str, adapter: Adapter) -> None:
    ADAPTERS[document_type] = adapter


def adapter(document_type: str) -> Adapter:
    if document_type not in ADAPTERS:
        raise ValueError(f"unknown document type {document_type!r}; there are {types()}")
    return ADAPTERS[document_type]


def types() -> list[str]:
    return sorted(ADAPTERS)


def parse(requests: DataFrame, among: dict[str, Adapter] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with their content hash, chunks, errors) of a request's documents, each type by its adapter.

    Documents of an unknown or missing type, and those without a text, are
    errors. The types are few, so the plan has a branch for each.
    """
    among = ADAPTERS if among is None else among
    read = [a.read(requests.filter(F.col("document_type") == t)).select("document_id", "document_type", "text") for t, a in sorted(among.items())]
    texts = reduce(DataFrame.unionByName, read)
    chunks = reduce(DataFrame.unionByName, [a.chunks(r).withColumn("document_type", F.lit(t)) for (t, a), r in zip(sorted(among.items()), read, strict=True)])
    known = F.coalesce(F.col("document_type").isin(*among), F.lit(False))
    unknown = requests.filter(~known).select("document_id", F.concat(F.lit("unknown type "), F.coalesce("document_type", F.lit("?"))).alias("error"))
    empty = texts.filter("text is null").select("document_id", F.lit("no text").alias("error"))
    found = texts.filter("text is not null").withColumn("content_hash", Adapter.content_hash(F.col("text")))
    return found, chunks, unknown.unionByName(empty)
