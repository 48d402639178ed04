"""Exact filtered vector top-k, fusion, assembly and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import nearest
from lectern.operators import splitting as S
from lectern.operators.filters import first_rows
from lectern.sources import scratch

#: Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60
#: Queries that meet a block of chunks in one task.
QUERY_BLOCK = 8_192


def top_k(queries: DataFrame, chunks: DataFrame, k: int, condition: Column | None = None, by: tuple[str, ...] = (), skip: str | None = None, among: tuple[str, str] | None = None) -> DataFrame:
    """(query_id, chunk_id, distance, rank): the ``k`` nearest chunks of each query by cosine distance.

    With ``by``, the ``k`` nearest of each query and each value of those columns.
    The other columns of ``queries`` (query_id, qvec) and ``chunks`` (chunk_id,
    embedding) pass through, and are dealt with them: texts join afterwards.

    Blocks of both meet in cells (:func:`nearest.pairs`), which leave no more
    than the ``k`` nearest of a query, so no pair beyond these is shuffled or
    sorted. ``skip`` is the queries' column of a chunk that they do not see,
    ``among`` a column of arrays with the values of a column of the chunks that
    they see (all, if empty). Any other ``condition`` on a pair is a join in
    which all pairs that meet it are ranked. Rows without a distance come last.
    """
    if condition is None:
        near = nearest.pairs(queries, chunks, k, QUERY_BLOCK, by, skip, among)
        near = near.withColumn("distance", 1 - F.col("similarity")).drop("similarity")
    else:
        if skip is not None:
            condition = condition & (F.col("chunk_id") != F.col(skip))
        if among is not None:
            condition = condition & ((F.size(among[0]) == 0) | F.array_contains(among[0], F.col(among[1])))
        # Lengths are taken once for each vector, not once for each pair.
        q = queries.withColumn("_q", T.doubles(F.col("qvec"))).withColumn("_qn", T.norm(F.col("_q"))).drop("qvec")
        side = chunks.withColumn("_v", T.doubles(F.col("embedding"))).withColumn("_vn", T.norm(F.col("_v"))).drop("embedding")
        met = side.join(q, condition)
        near = met.withColumn("distance", 1 - T.dot(F.col("_q"), F.col("_v")) / (F.col("_qn") * F.col("_vn") + F.lit(1e-9))).drop("_q", "_v", "_qn", "_vn")
    return first_rows(near, ["query_id", *by], [F.round("distance", 9).asc_nulls_last(), F.col("chunk_id")], k)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """The best ``k`` of each query's hits by a scorer's value, squashed to (0, 1)."""
    scored = hits.drop("rank").withColumn("rerank_score", score)
    return first_rows(scored, ["query_id"], [F.desc("rerank_score"), F.col("chunk_id")], k).withColumn("rerank_score", T.sigmoid(F.col("rerank_score")))


def fusion_key(document_id: Column, chunk_index: Column, rank: Column) -> Column:
    """The key under which fusion may know a chunk: its document and index, or where it has none its rank."""
    return F.concat(F.coalesce(document_id, F.lit("")), F.lit("_c"), F.coalesce(chunk_index, rank).cast("string"))


def rrf_sources(ranked: DataFrame, k: int, constant: int = RRF_K, compat: bool = False) -> DataFrame:
    """Fuse (query_id, source_ord, rank, chunk_id, distance) across sources.

    A chunk's score is the sum of reciprocal ranks; its distance is that of the
    last source; ties go to the first seen. With ``compat`` chunks are known by
    :func:`fusion_key` of ``document_id`` and ``chunk_index``, so chunks without
    an index meet by their rank.
    """
    if compat:
        ranked = ranked.withColumn("chunk_id", fusion_key(F.col("document_id"), F.col("chunk_index"), F.col("rank")))
    seen = F.struct("source_ord", "rank")
    fused = ranked.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), F.min(seen).alias("seen"), F.max(F.struct("source_ord", -F.col("rank"), "distance")).alias("last")
    )
    out = first_rows(fused, ["query_id"], [F.desc(F.round("rrf", 12)), F.col("seen"), F.col("chunk_id")], k)
    return out.select("query_id", "chunk_id", "rrf", F.col("last.distance").alias("distance"), "rank")


#: Rows fused and rows of each source, as usual and in the deep mode.
FAN_OUT, DEEP_FAN_OUT = (10, 20), (40, 150)


def fan_out(queries: DataFrame, chunks: DataFrame, sources: list, by: str = "collection", deep: bool = False, condition: Column | None = None, skip: str | None = None) -> DataFrame:
    """The fused best of each query from its nearest chunks in each of ``sources``.

    One pass over the chunks ranks each source by itself; the order of
    ``sources`` is that in which fusion sees them.
    """
    k, each = DEEP_FAN_OUT if deep else FAN_OUT
    hits = top_k(queries, chunks.filter(F.col(by).isin(sources)), each, condition, (by,), skip)
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(by)).cast("int")
    return rrf_sources(hits.withColumn("source_ord", place), k)


def rrf_drafts(ranked: DataFrame, constant: int = RRF_K) -> DataFrame:
    """Fuse across query drafts, keeping each chunk's first instance of best rerank score."""
    best = F.max(F.struct("rerank_score", (-F.col("draft_ord")).alias("d"), (-F.col("rank")).alias("r"))).alias("best")
    fused = ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"), best, F.min(F.struct("draft_ord", "rank")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "seen", "chunk_id")
    return fused.select("query_id", "chunk_id", "rrf", F.col("best.rerank_score").alias("rerank_score"), F.row_number().over(w).alias("rank"))


def slots(ranked: DataFrame, primary: int, reserve: int) -> DataFrame:
    """Primary rows, then reserve rows, by rank; the rest go."""
    slot = F.when(F.col("rank") <= primary, "primary").when(F.col("rank") <= primary + reserve, "reserve")
    return ranked.withColumn("slot", slot).filter("slot is not null")


def balanced(ranked: DataFrame, per_collection: int) -> DataFrame:
    """The first rows of each collection, in the order of collections."""
    got = first_rows(ranked.drop("rank"), ["query_id", "collection"], [F.col("distance"), F.col("chunk_id")], per_collection)
    w = Window.partitionBy("query_id").orderBy("collection", "rank")
    return got.withColumn("position", F.row_number().over(w))


def assemble(ranked: DataFrame, budget: int, per_document: int, total: int) -> DataFrame:
    """Sequential assembly by (priority, rank) with collection, document and total caps.

    Later picks depend on what was taken before, so each query's candidates are
    folded in order. They are one query's retrieval result, bounded by its
    budgets upstream.
    """
    items = F.array_sort(F.collect_list(F.struct("priority", "rank", "chunk_id", "document_id", "collection")))
    kind = "array<struct<priority:int,rank:int,chunk_id:bigint,document_id:string,collection:string>>"
    grouped = ranked.select("query_id", F.col("priority").cast("int"), F.col("rank").cast("int"), F.col("chunk_id").cast("bigint"), F.col("document_id").cast("string"), F.col("collection").cast("string"))
    grouped = grouped.groupBy("query_id").agg(items.alias("items"))

    def take(acc: Column, x: Column) -> Column:
        same_doc = F.size(F.filter(acc, lambda y: y["document_id"] == x["document_id"]))
        same_coll = F.size(F.filter(acc, lambda y: y["collection"] == x["collection"]))
        ok = (F.size(acc) < total) & (same_doc < per_document) & (same_coll < budget)
        return F.when(ok, F.concat(acc, F.array(x))).otherwise(acc)

    folded = grouped.select("query_id", F.aggregate("items", F.array().cast(kind), take).alias("taken"))
    return folded.select("query_id", F.posexplode("taken").alias("pos", "t")).select("query_id", (F.col("pos") + 1).alias("position"), "t.chunk_id", "t.document_id", "t.collection")


def expand(primary: DataFrame, reserve: DataFrame, budget: int) -> DataFrame:
    """Reserve rows of documents not used yet, by the order of collections, up to a budget for each.

    A document that finds its collection full stays free for the next one, so
    each query's reserves are folded in order; they are bounded by its budgets.
    """
    used = primary.groupBy("query_id").agg(F.collect_set(F.col("document_id").cast("string")).alias("used"))
    kind = "array<struct<priority:int,rank:int,chunk_id:bigint,document_id:string,collection:string>>"
    rows = reserve.select("query_id", F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("priority", "int"), ("rank", "int"), ("chunk_id", "bigint"), ("document_id", "string"), ("collection", "string"))]).alias("r"))
    held = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("r")).alias("items")).join(used, "query_id", "left")

    def take(acc: Column, x: Column) -> Column:
        free = ~F.array_contains("used", x["document_id"]) & ~F.exists(acc, lambda y: y["document_id"] == x["document_id"])
        room = F.size(F.filter(acc, lambda y: y["collection"] == x["collection"])) < budget
        return F.when(free & room, F.concat(acc, F.array(x))).otherwise(acc)

    none = F.array().cast("array<string>")
    folded = held.withColumn("used", F.coalesce("used", none)).select("query_id", F.aggregate("items", F.array().cast(kind), take).alias("taken"))
    rows = folded.select("query_id", F.posexplode("taken").alias("pos", "t")).select("query_id", (F.col("pos") + 1).alias("position"), "t.*")
    return rows


def evidence(assembled: DataFrame, queries: DataFrame | None = None, enough: int = 4, coverage: int = 2, band: tuple[int, int] | None = (2, 4)) -> DataFrame:
    """Answer, judge, expand or clarify for each query by how much was found in how many collections.

    A judge takes what is not enough within ``band``, if there is one. Queries
    of ``queries`` without any chunk get a row too, and clarify.
    """
    g = assembled.groupBy("query_id").agg(F.count("chunk_id").alias("n"), F.countDistinct("collection").alias("n_collections"))
    if queries is not None:
        g = queries.select("query_id").distinct().join(g, "query_id", "left").na.fill(0, ["n", "n_collections"])
    n = F.col("n")
    full = (n >= enough) & (F.col("n_collections") >= coverage)
    judged = n.between(*band) if band else F.lit(False)
    action = F.when(n == 0, "clarify").when(full, "answer").when(judged, "judge").otherwise("expand")
    said = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    # What a judge finds missing is in its own words, see ``judgement``.
    missing = F.when(n == 0, said("no_results")).when(full, said()).when(~judged, said("insufficient_chunks"))
    return g.withColumn("action", action).withColumn("confidence", F.when(n == 0, 0.0).when(full, 0.85).otherwise(0.4)).withColumn("missing_aspects", missing)


ACTIONS = ("answer", "expand", "clarify", "refuse")


def judgement(output: Column) -> Column:
    """A judge's output as (sufficient, confidence, action, missing_aspects, judge_type).

    What stands between the first and the last brace must be JSON with a known
    action and a number as confidence; anything else falls back to expanding.
    """
    found = F.regexp_extract(F.coalesce(output, F.lit("")), r"(?s)\{.*\}", 0)
    get = lambda k: F.get_json_object(found, f"$.{k}")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(found)), F.lit("OBJECT")), F.lit(False))
    action, number = F.coalesce(get("action"), F.lit("expand")), F.coalesce(get("confidence"), F.lit("0"))
    listed = F.coalesce(get("missing_aspects"), F.lit("[]"))
    missing = F.from_json(F.when(listed.isin("", "null", "false", "0"), "[]").otherwise(listed), "array<string>")
    said = F.coalesce(get("sufficient"), F.lit("false"))
    usable = is_object & action.isin(*ACTIONS) & number.try_cast("double").isNotNull() & missing.isNotNull()
    row = lambda *xs: F.struct(*[x.alias(n) for x, n in zip(xs, ("sufficient", "confidence", "action", "missing_aspects", "judge_type"), strict=True)])
    own = row(~said.isin("false", "0", "", "null", "[]", "{}"), number.try_cast("double"), action, missing, F.lit("llm"))
    return F.when(F.coalesce(usable, F.lit(False)), own).otherwise(row(F.lit(False), F.lit(0.4), F.lit("expand"), F.array(F.lit("insufficient_chunks")), F.lit("heuristic")))


def orchestrate(queries: DataFrame, ranked: DataFrame, plans: DataFrame, per_document: int = 2, total: int = 12) -> DataFrame:
    """(query_id, action, n_primary, n, expanded, chunk_ids): assembly, evidence, expansion and evidence again.

    ``ranked`` has each collection's hits in rank order and ``plans`` the
    (query_id, collection, priority, retrieval_budget, reserve_budget) that a
    session allows. A query without plans is refused, one without hits is asked
    to clarify. The hits within the budgets are written first, as several
    steps read them: ``ranked`` runs once, when this is called.
    """
    mine = ranked.join(plans, ["query_id", "collection"]).filter(F.col("rank") <= F.col("retrieval_budget") + F.col("reserve_budget"))
    mine = scratch.written(mine, "planned")
    first, rest = mine.filter("rank <= retrieval_budget"), mine.filter("rank > retrieval_budget")
    taken = assemble(first, 1 << 30, per_document, total).select("query_id", "position", "chunk_id", "document_id", "collection")
    before = evidence(taken, queries, band=None).select("query_id", F.col("action").alias("asked"), F.col("n").alias("n_primary"))
    wanting = before.filter("asked = 'expand'").select("query_id")
    limits = plans.select("query_id", "collection", "reserve_budget")
    spare = rest.drop("reserve_budget").join(wanting, "query_id", "left_semi").join(limits, ["query_id", "collection"])
    # Within a collection no more rows are held in reserve than its budget takes.
    more = expand(taken, spare, 1 << 30).select("query_id", (F.col("position") + (1 << 20)).alias("position"), "chunk_id", "document_id", "collection")
    all_rows = taken.unionByName(more)
    after = evidence(all_rows, queries, band=None).select("query_id", "action", "n")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"])
    listed = all_rows.groupBy("query_id").agg(ids.alias("chunk_ids"))
    planned = plans.select("query_id").distinct().withColumn("planned", F.lit(True))
    out = before.join(after, "query_id").join(listed, "query_id", "left").join(planned, "query_id", "left")
    action = F.when(F.col("planned").isNull(), "refuse").otherwise(F.col("action"))
    return out.select("query_id", action.alias("action"), "n_primary", "n", (F.col("n") > F.col("n_primary")).alias("expanded"), F.coalesce("chunk_ids", F.array().cast("array<bigint>")).alias("chunk_ids"))


def merge_results(first: DataFrame, more: DataFrame) -> DataFrame:
    """All of the first rows, then the others whose chunk is new, each once."""
    new = more.join(first.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    once = first_rows(new, ["query_id", "chunk_id"], [F.col("rank")], 1, "_n").drop("_n")
    return first.unionByName(once)


def context(ranked: DataFrame, max_chars: int, most_distance: float, total: int) -> DataFrame:
    """One context text for each query: headed, truncated chunks by rank until the first overflow.

    The header names what is known of ``source``, ``date``, ``period`` and
    ``author``, columns that may be absent, and is cut together with the text.
    Everything before the overflow was accepted, so a running sum finds it; the
    first chunk always stays.
    """
    kept = ranked.filter(F.col("distance").isNull() | (F.col("distance") <= most_distance))
    known = lambda c, lead="": F.when((F.col(c).cast("string") != "") & (F.col(c).cast("string") != "0"), F.concat(F.lit(lead), F.col(c).cast("string"))) if lead else F.when(F.col(c) != "", F.col(c))
    parts = [known(c, "Dönem " if c == "period" else "") for c in ("source", "date", "period", "author") if c in ranked.columns]
    head = F.concat_ws(" | ", *parts) if parts else F.lit("")
    headed = F.concat(F.when(head != "", F.concat(F.lit("["), head, F.lit("]\n"))).otherwise(""), F.substring("text", 1, max_chars))
    block = F.substring(headed, 1, max_chars)
    w = Window.partitionBy("query_id").orderBy("rank")
    run = kept.withColumn("block", block).withColumn("n", F.row_number().over(w)).withColumn("size", F.sum(F.length("block")).over(w))
    over = run.withColumn("over", F.max(F.when((F.col("n") > 1) & (F.col("size") > total), 1).otherwise(0)).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n\n---\n\n")
    return over.filter("over = 0").groupBy("query_id").agg(F.count("*").alias("n_chunks"), joined.alias("context"))


def retrieve(queries: DataFrame, chunks: DataFrame, k: int, fetch: int, prefix: list[tuple[str, str]], score: Column | None = None, condition: Column | None = None, skip: str | None = None, texts: DataFrame | None = None, text: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, rank, distance, shown): filter by said years, rank, rerank, crop and head.

    ``queries`` has query_id, query and qvec; ``chunks`` chunk_id, year, embedding
    and, unless ``texts`` has them by chunk_id, text and the columns that
    ``prefix`` (label, column) shows. ``text`` makes what is cropped of these,
    for the rows found alone. The years of a query's dates and its bare years
    restrict its chunks; a query that names none sees all. With ``score`` the
    ``fetch`` nearest are reranked and the distance is what their score leaves
    of one. The rows found are written when this is called, so their size
    decides how texts join them.
    """
    said = F.col("query")
    dated = F.transform(T.exact_dates(said), lambda s: T.iso_year(s))
    asked = queries.withColumn("years", F.array_distinct(F.concat(T.bare_years(said), dated)))
    slim = chunks.select("chunk_id", "year", "embedding")
    hits = top_k(asked, slim, fetch if score is not None else k, condition, skip=skip, among=("years", "year"))
    if score is not None:
        hits = rerank(hits, score, k).withColumn("distance", 1 - F.col("rerank_score"))
    found = scratch.written(hits.select("query_id", "query", "chunk_id", "rank", "distance"), "found")
    rows = found.join(chunks.drop("embedding") if texts is None else texts, "chunk_id")
    rows = rows if text is None else rows.withColumn("text", text)
    head = T.prefix_line([(label, F.col(c)) for label, c in prefix])
    return rows.select("query_id", "chunk_id", "rank", "distance", F.concat(head, S.relevant_windows(F.col("text"), said)).alias("shown"))
