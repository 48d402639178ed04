"""Readers of ingest requests, press archives, golden sets and collections; sinks by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import buckets

DOCUMENT = (
    "document_id string, document_type string, document_source string, document_date string, year int, period int, legislative_year int, session int, "
    "author string, author_role string, source_name string, title string, topics string, ocr boolean, metadata map<string,string>"
)
GOLDEN = "id string, query string, expected_year int, golden_answer string, tags array<string>, relevant_chunk_ids array<string>, gold_evidence_spans array<struct<document_id:string,char_start:int,char_end:int>>"


def ingest_request(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a request file, with position and collection; other versions give none."""
    raw = spark.read.schema(f"version string, collection string, documents array<struct<{', '.join(f.replace(' ', ':', 1) for f in _top(DOCUMENT))}>>").option("multiLine", True).json(path)
    rows = raw.filter("version = '1.0' and collection is not null").select("collection", F.posexplode("documents").alias("position", "d"))
    return rows.select("position", "collection", "d.*")


def press_csv(spark: SparkSession, path: str, date: str = "TARIH") -> DataFrame:
    """An archive with empty strings for missing values and ISO dates or an empty string."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    iso = F.coalesce(*[F.date_format(F.try_to_timestamp(F.col(date), F.lit(p)), "yyyy-MM-dd") for p in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy")], F.lit(""))
    return (df.withColumn(date, iso) if date in df.columns else df).na.fill("")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a fixture, bare or wrapped in ``{"queries": [...]}``."""
    kind = "struct<" + ",".join(f"{a}:{b}" for a, b in (f.split(" ", 1) for f in _top(GOLDEN))) + ">"
    text = spark.read.option("wholetext", True).text(path)
    bare = F.from_json("value", f"array<{kind}>")
    wrapped = F.from_json("value", f"struct<queries:array<{kind}>>")["queries"]
    return text.select(F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)).alias("q")).select("q.*")


def _top(ddl: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[last:i].strip())
            last = i + 1
    return [*out, ddl[last:].strip()]


def collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The chunks of one collection: a partition that the scan prunes to."""
    return spark.read.parquet(root).filter(F.col("collection") == name)


def _folder(spark: SparkSession, root: str, name: str) -> str:
    return f"{root}/collection={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)}"


def open_collection(spark: SparkSession, root: str, name: str, create: bool = False, schema: str | None = None) -> DataFrame:
    """The chunks of one collection; one that is not there is an error, or with ``create`` made without rows.

    ``schema`` is that of a store without any rows yet.
    """
    if not buckets.exists(spark, root) and not create:
        raise FileNotFoundError(f"there is no store at {root}")
    if not buckets.exists(spark, _folder(spark, root, name)):
        if not create:
            raise ValueError(f"there is no collection {name} at {root}")
        fs, path = buckets.place(spark, _folder(spark, root, name))
        fs.mkdirs(path)
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, collection string")
    return reader.parquet(root).filter(F.col("collection") == name)


def upsert_chunks(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New chunks in place of old ones of the same id; of new ones with one id the greatest row counts.

    A batch that comes again changes nothing, whatever ids repeat in it.
    """
    rest = [c for c, kind in new.dtypes if c != key and "map<" not in kind]
    order = F.struct(*rest) if rest else F.lit(0)
    once = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return old.join(once.select(key), key, "left_anti").unionByName(once)


def delete_document(chunks: DataFrame, document_id: str, by_prefix: bool = False) -> DataFrame:
    """Chunks without a document's, by equality; by prefix also those of ids that extend it."""
    hit = F.col("chunk_id").startswith(f"{document_id}_") if by_prefix else F.col("document_id") == document_id
    return chunks.filter(~F.coalesce(hit, F.lit(False)))


def write_chunks(chunks: DataFrame, root: str) -> None:
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(root)


def lookup(chunks: DataFrame, ids: list[str]) -> DataFrame:
    return chunks.filter(F.col("chunk_id").isin(ids))


def page(chunks: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return chunks.orderBy("chunk_id").offset(offset).limit(limit)


def seeded_sample(chunks: DataFrame, n: int, seed: int, least: int) -> DataFrame:
    """``n`` chunks with at least ``least`` characters, the same for a seed at any partitioning."""
    return chunks.filter(F.length(F.trim("text")) >= least).orderBy(F.xxhash64(F.lit(seed), "chunk_id"), "chunk_id").limit(n)
