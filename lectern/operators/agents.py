"""Relational steps of an answering agent: allocation, session scope, suggestions, sources and spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import answers as A
from lectern.functions import metadata as D
from lectern.functions import text as T
from lectern.operators import retrieval as R
from lectern.operators import splitting as S

# Rows to fetch, and to hold as primary and reserve, by kind of question.
BUDGETS = {
    "fact": (2, 2, 10), "summary": (3, 2, 10), "comparison": (3, 2, 12), "reasoning": (3, 2, 12), "policy": (3, 3, 15),
}
DEFAULT_BUDGET = (2, 2, 10)

# Words that ask for the deep mode, and answers that found nothing.
DEEP = r"(?iU)müfetti[sş]|derin\s+ara[sş]t[ıi]r|detayl[ıi]\s+incele|kapsaml[ıi]\s+(ara|incele)|\brapor\w*"
NOTHING = (
    r"(?iU)bulunamadı|bilgi\s+yok|kaynaklarda\s+yer\s+almıyor|tespit\s+edilemedi|bilgiye\s+ulaşılamadı|mevcut\s+değil|"
    r"yer\s+almamaktadır|bilgi\s+bulunmamaktadır|yanıt\s+veremiyorum"
)


def deep_mode(query: Column, asked: Column) -> Column:
    return F.coalesce((asked == "deep") | query.rlike(DEEP), query.rlike(DEEP), F.lit(False))


def nothing_found(answer: Column) -> Column:
    return F.coalesce(answer.rlike(NOTHING), F.lit(False))


def allocate(plans: DataFrame) -> DataFrame:
    """Plans (query_id, query_type, position, collection) with priority and budgets of their kind."""
    pick = lambda i: F.coalesce(*[F.when(F.col("query_type") == k, b[i]) for k, b in BUDGETS.items()], F.lit(DEFAULT_BUDGET[i]))
    w = Window.partitionBy("query_id").orderBy("position", "collection")
    return plans.select(
        "query_id", "collection", F.row_number().over(w).alias("priority"),
        pick(0).alias("retrieval_budget"), pick(1).alias("reserve_budget"), pick(2).alias("fetch_k"),
    )


def draft_texts(drafts: Column) -> Column:
    """Distinct non-blank drafts, trimmed, in order."""
    return F.array_distinct(F.filter(F.transform(drafts, lambda d: F.trim(F.coalesce(d, F.lit("")))), lambda d: d != ""))


def session_scope(plans: DataFrame, session: DataFrame) -> DataFrame:
    """Plans within their session's collections; a query with none left gets all of its session's.

    ``plans`` and ``session`` have query_id and collection.
    """
    kept = plans.join(session.select("query_id", "collection").distinct(), ["query_id", "collection"], "left_semi").withColumn("fallback", F.lit(False))
    lost = plans.select("query_id").distinct().join(kept, "query_id", "left_anti")
    again = session.select("query_id", "collection").distinct().join(lost, "query_id", "left_semi").withColumn("fallback", F.lit(True))
    return kept.select("query_id", "collection", "fallback").unionByName(again)


def suggest(given: Column, query: Column, fallbacks: list[str], n: int = 3) -> Column:
    """``n`` suggestions: those given that do not echo the query, then fallbacks not among them."""
    kept = F.filter(given, lambda s: s.isNotNull() & (s != query))
    spare = F.filter(F.array(*[F.lit(f) for f in dict.fromkeys(fallbacks)]), lambda f: ~F.array_contains(kept, f) & (f != query))
    return F.slice(F.concat(kept, spare), 1, n)


def source_summary(sources: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, summary): a line for each of the first ``most`` sources, without fields that are absent."""
    w = Window.partitionBy("query_id").orderBy("rank")
    name = A.filled(F.col("source_name"), F.col("source_title"), F.col("title"))
    label = F.concat_ws(" | ", name, A.filled(F.col("date")), A.filled(F.col("author")))
    top = sources.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    line = F.concat(F.lit("  Kaynak "), F.col("_n"), F.lit(": "), F.when(label != "", label).otherwise("(metaveri yok, içerik BAĞLAM'da)"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"])
    return top.groupBy("query_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("summary"))


def structured_context(ranked: DataFrame, max_chars: int, most_distance: float, total: int) -> DataFrame:
    """One row for each chunk in a context: its excerpt without the head line, its distance at 4 places.

    The first chunk stays; from the first that takes the running size past ``total`` on they go.
    """
    kept = ranked.filter(F.col("distance").isNull() | (F.col("distance") <= most_distance)).withColumn("_t", F.substring("text", 1, max_chars))
    w = Window.partitionBy("query_id").orderBy("rank")
    sized = kept.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.sum(F.length("_t")).over(w))
    inside = sized.filter((F.col("_n") == 1) | (F.col("_s") <= total))
    has_head = F.contains("_t", F.lit("\n"))
    excerpt = F.when(has_head, F.regexp_replace("_t", r"^[^\n]*\n", "")).otherwise(F.col("_t"))
    return inside.withColumn("excerpt", F.regexp_replace(excerpt, r"(?U)^\s+|\s+$", "")).withColumn("distance", F.round("distance", 4)).drop("_t", "_n", "_s")


def citations(chunks: DataFrame) -> DataFrame:
    """Chunks with a 1-based index by rank within their query."""
    return chunks.withColumn("citation", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def needs_more(found: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, n, again): whether fewer than ``least`` rows were found; ``n_docs`` holds the counts."""
    return found.groupBy("query_id").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).withColumn("again", F.col("n") < least)


def flatten_results(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parallel arrays of each row as one row an element, with its rank from 1."""
    rest = [c for c in df.columns if c not in columns]
    rows = df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias("_k", "_e"))
    return rows.select(*rest, (F.col("_k") + 1).alias("rank"), *[F.col(f"_e.{c}").alias(c) for c in columns])


def typed_chunks(results: DataFrame) -> DataFrame:
    """Search rows with ids filled in from their collection and rank, and scores from distances."""
    cid = F.coalesce("chunk_id", F.concat_ws("_", "collection", F.col("rank") - 1))
    score = 1 - F.col("distance")
    return results.withColumn("chunk_id", cid).withColumn("document_id", F.coalesce("document_id", "chunk_id")).withColumn("score", score).withColumn("rerank_score", F.coalesce("rerank_score", score))


def resolve_spans(wanted: DataFrame, manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_id, char_start, char_end, error): the span of each wanted chunk, or what failed first.

    ``manifest`` has document_id and document_source, ``chunks`` document_id,
    chunk, char_start and char_end. Errors: format, manifest, cache, index, span.
    """
    doc, k = T.chunk_parts(F.col("chunk_id"))
    w = wanted.select("chunk_id", doc.alias("document_id"), k.alias("chunk"))
    listed = manifest.filter(A.filled(F.col("document_source")).isNotNull()).select("document_id", F.lit(True).alias("_listed"))
    held = chunks.groupBy("document_id").agg(F.count("*").alias("_held"))
    own = chunks.select("document_id", "chunk", "char_start", "char_end", F.lit(True).alias("_own"))
    j = w.join(listed, "document_id", "left").join(held, "document_id", "left").join(own, ["document_id", "chunk"], "left")
    error = (
        F.when(F.col("document_id").isNull(), "format").when(F.col("_listed").isNull(), "manifest").when(F.col("_held").isNull(), "cache")
        .when(F.col("_own").isNull(), "index").when(F.col("char_start").isNull() | F.col("char_end").isNull(), "span")
    )
    return j.select("chunk_id", "document_id", "char_start", "char_end", error.alias("error"))


def routing_accuracy(is_minutes: Column, expected: Column) -> Column:
    right = F.when(expected == "minutes", is_minutes).when(expected == "gazete", ~is_minutes).otherwise(True)
    return right.cast("double")


def date_accuracy(text: Column, expected_year: Column) -> Column:
    """1 if the expected year is among a query's dates, or none is expected."""
    years = F.concat(T.bare_years(text), F.transform(T.exact_dates(text), lambda d: F.substring(d, 1, 4).cast("int")))
    return F.when(expected_year.isNull() | F.array_contains(years, expected_year.cast("int")), 1.0).otherwise(0.0)


def context_share(relevant: Column, included: Column) -> Column:
    """The part of the relevant ids that reached the context; 1 without any."""
    n = F.size(F.array_distinct(relevant))
    return F.when(n > 0, F.size(F.array_intersect(relevant, included)) / n).otherwise(1.0)


def comparison(per_query: DataFrame, metrics: list[str], by: str, names: list[str]) -> DataFrame:
    """A row for each metric with its mean in a column for each of ``names``."""
    long = per_query.unpivot([by], metrics, "metric", "value")
    return long.groupBy("metric").pivot(by, names).agg(F.avg("value"))


def expanded_query(query: Column, expansion: Column) -> Column:
    """A query with what a model added to it, unless that is nothing new."""
    return F.when((expansion != "") & (expansion != query), F.trim(F.concat(query, F.lit(" "), expansion))).otherwise(query)


#: Chunks shown and fetched by a deep report.
REPORT_DEPTH = (40, 150)


def deep_retrieve(queries: DataFrame, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], prefix: list[tuple[str, str]], score: Column | None = None, condition: Column | None = None, skip: str | None = None, texts: DataFrame | None = None, text: Column | None = None) -> DataFrame:
    """What a deep report reads: a query with its expansion, embedded anew, and many chunks for it.

    ``queries`` has query_id, query and expansion; ``embed`` adds qvec to what
    has the combined query. The result is that of ``retrieval.retrieve`` with
    ``expanded``, the expansion if it says something new.
    """
    k, fetch = REPORT_DEPTH
    new = (F.coalesce("expansion", F.lit("")) != "") & (F.col("expansion") != F.col("query"))
    asked = queries.withColumn("expanded", F.when(new, F.col("expansion"))).withColumn("query", expanded_query(F.col("query"), F.coalesce("expansion", F.lit(""))))
    found = R.retrieve(embed(asked.drop("expansion")), chunks, k, fetch, prefix, score, condition, skip, texts, text)
    return found.join(asked.select("query_id", F.col("query").alias("combined"), "expanded"), "query_id")


def agent_rows(hits: DataFrame, collection: str, labels: list[tuple[str, str]]) -> DataFrame:
    """Hits as an agent reads them: the parts near the query's words under a line of labelled metadata.

    ``hits`` have query, text, metadata, distance and rerank_score. Older
    metadata keys get their present names, the collection is noted, and a
    rerank score replaces the distance by what it lacks of one.
    """
    meta = D.canonical(F.col("metadata"))
    named = hits.withColumns({"metadata": meta, "collection": F.lit(collection), "distance": F.coalesce(1 - F.col("rerank_score"), F.col("distance"))})
    line = T.prefix_line([(label, F.try_element_at("metadata", F.lit(key))) for label, key in labels])
    return named.withColumn("text", F.concat(line, S.relevant_windows(F.col("text"), F.col("query"))))
