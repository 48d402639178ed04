"""Author, metadata, evaluation, health and plan queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import metadata as D
from lectern.operators import agents as G
from lectern.operators import authors as U
from lectern.operators import chunking as C
from lectern.operators import evaluation as E
from lectern.operators import filters as P
from lectern.operators import health as H
from lectern.plans.registry import query, table
from lectern.sources import ingest


def _entries(m: Column) -> Column:
    """A map as text, in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


# Heads of turns by kind: a minister, one with a compound title, a deputy, both chairs, and none.
_HEADS = ["DEVLET BAKANI {n} —", "DIŞİŞLERİ BAKANI VE BAŞBAKAN YARDIMCISI {n} -", "{n}  (İzmir) –", "BAŞKAN —", "BAŞKANVEKİLİ —", "{n} dedi ki —", "{n} A. KAYA (Van) —"]


@query(
    "c5_speakers",
    """WITH m AS (SELECT s_suppkey AS k, s_suppkey % 7 AS c, 'ALİ' || repeat(' KAYA', s_nationkey::INT % 8 + 1) AS name FROM supplier)
    SELECT k, CASE WHEN c IN (0, 1, 2) THEN name WHEN c = 3 THEN 'BAŞKAN' WHEN c = 4 THEN 'BAŞKANVEKİLİ' END AS author,
    CASE c WHEN 0 THEN 'devlet bakani' WHEN 1 THEN 'dişi̇şleri̇ bakani ve başbakan yardimcisi' WHEN 2 THEN 'milletvekili' WHEN 3 THEN 'başkan' WHEN 4 THEN 'başkanveki̇li̇' END AS role, CASE WHEN c = 2 THEN 'İzmir' END AS constituency,
    CASE WHEN c < 3 THEN CASE WHEN length(name) > 35 THEN 0.5 ELSE 1 END WHEN c < 5 THEN 1 END::DOUBLE AS confidence FROM m""",
)
def speakers(spark, d):
    """Heads of minutes with a name of growing length."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("ALİ"), F.repeat(F.lit(" KAYA"), (F.col("s_nationkey") % 8 + 1).cast("int")))
    heads = F.element_at(F.array(*[F.replace(F.lit(h + " Sayın"), F.lit("{n}"), name) for h in _HEADS]), (k % 7 + 1).cast("int"))
    found = table(spark, d, "supplier").select(k.alias("k"), C.speaker(heads).alias("s"))
    return found.select("k", "s.author", "s.role", "s.constituency", "s.confidence")


@query(
    "c5_c8_detected_authors",
    """WITH s AS (SELECT s_suppkey AS k, 'Ali Kay' || repeat('a', s_nationkey::INT % 5 + 1) AS name FROM supplier), m AS (SELECT *, k % 6 AS c FROM s)
    SELECT k, CASE WHEN c < 5 THEN name END AS author, CASE c WHEN 0 THEN 'köşe yazarı' WHEN 1 THEN 'muhabir' WHEN 2 THEN 'milletvekili' WHEN 3 THEN 'imzacı' WHEN 4 THEN 'milletvekili' END AS role,
    CASE c WHEN 2 THEN 'co_signers_count=' || k || ';constituency=Konya' WHEN 3 THEN 'signatories=' || name || ', Can Er' WHEN 4 THEN 'constituency=İzmir' WHEN 5 THEN NULL ELSE '' END AS extra FROM m""",
)
def detected_authors(spark, d):
    """Head lines of every kind, with a name made from each supplier's nation."""
    tail = F.repeat(F.lit("a"), (F.col("s_nationkey") % 5 + 1).cast("int"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("Ali Kay"), tail).alias("name"))
    kind, name, k = F.col("k") % 6, F.col("name"), F.col("k")
    text = (
        F.when(kind == 0, F.concat(F.lit("  yazan: "), name, F.lit(". Dün akşam")))
        .when(kind == 1, F.concat(name, F.lit(" — Milliyet, ikinci sayfa")))
        .when(kind == 2, F.concat(F.lit("Konya Milletvekili "), name, F.lit(" ve "), k, F.lit(" arkadaşının teklifi")))
        .when(kind == 3, F.concat(F.lit("Teklif ( İmza: "), name, F.lit(" ; Can Er, )")))
        .when(kind == 4, F.concat(F.lit("Madde 1. İzmir Milletvekili "), name, F.lit(", gerekçe")))
        .otherwise(F.concat(F.lit("Yazan: "), name))
    )
    types = F.when(kind < 2, "press_clip").when(kind < 5, "kanun_teklifi").otherwise("pdf_report")
    found = rows.select("k", U.detect(types, text).alias("a"))
    return found.select("k", "a.author", "a.role", F.when(F.col("a").isNotNull(), _entries(F.col("a.extra"))).alias("extra"))


_LINES = "WITH RECURSIVE a AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS p FROM documents), x AS (SELECT doc_id, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS i FROM a)"


@query(
    "c4_page_pack",
    _LINES
    + """, st(doc_id, i, chunk, size) AS (SELECT doc_id, i, 0, length(t) FROM x WHERE i = 1 UNION ALL
    SELECT s.doc_id, x.i, CASE WHEN s.size >= 300 AND s.size + 2 + length(x.t) > 900 THEN s.chunk + 1 ELSE s.chunk END,
    CASE WHEN s.size >= 300 AND s.size + 2 + length(x.t) > 900 THEN length(x.t) ELSE s.size + 2 + length(x.t) END FROM st s JOIN x ON x.doc_id = s.doc_id AND x.i = s.i + 1)
    SELECT doc_id, chunk, min((i - 1) // 3)::INT AS page, count(DISTINCT (i - 1) // 3) AS n_pages, md5(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS h FROM st JOIN x USING (doc_id, i) GROUP BY ALL""",
)
def page_pack(spark, d):
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    atoms = F.transform(lines, lambda s, i: F.struct(s.alias("text"), F.array(F.floor(i / 3).cast("int")).alias("pages")))
    packed = U.pack_pages(table(spark, d, "documents").select("doc_id", atoms.alias("atoms")), 300, 900)
    return packed.select("doc_id", "chunk", "page", F.size("pages").cast("long").alias("n_pages"), F.md5("text").alias("h"))


def _tagged_turns(spark, d):
    who = F.when(F.col("role") != "system", F.struct(F.col("role").alias("author"), F.substring("role", 1, 1).alias("role")))
    t = C.tag(table(spark, d, "conversations"), ["conv_id"], "turn", who)
    page = F.array((F.col("turn") % 3).cast("int"))
    rows = t.select(F.col("conv_id").alias("doc_id"), "turn", "text", F.col("tagged.author").alias("author"), F.col("tagged.role").alias("role"), "segment", "is_continuation", page.alias("pages"))
    return U.gathered(rows, ["text", "author", "role", "segment", "is_continuation", "pages"], "turn")


@query(
    "c10_c11_author_pack",
    """WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, role = 'system' AS cont, CASE WHEN role <> 'system' THEN role END AS who FROM conversations),
    x AS (SELECT *, last_value(who IGNORE NULLS) OVER w AS author, sum((NOT cont)::INT) OVER w AS segment FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    st(conv_id, i, chunk, size) AS (SELECT conv_id, i, 0, length(text) FROM x WHERE i = 1 UNION ALL
      SELECT s.conv_id, x.i, CASE WHEN s.size >= 300 AND (NOT x.cont OR s.size + 2 + length(x.text) > 500) THEN s.chunk + 1 ELSE s.chunk END,
      CASE WHEN s.size >= 300 AND (NOT x.cont OR s.size + 2 + length(x.text) > 500) THEN length(x.text) ELSE s.size + 2 + length(x.text) END FROM st s JOIN x ON x.conv_id = s.conv_id AND x.i = s.i + 1),
    j AS (SELECT * FROM st JOIN x USING (conv_id, i)), p AS (SELECT conv_id, chunk, author, sum(length(text)) AS n, min(i) AS f FROM j WHERE author IS NOT NULL GROUP BY ALL),
    b AS (SELECT conv_id, chunk, string_agg(author, ',' ORDER BY f) AS authors, first(author ORDER BY n DESC, f) AS author FROM p GROUP BY ALL)
    SELECT conv_id, chunk, b.author, b.author[1] AS author_role, coalesce(authors, '') AS authors, count(DISTINCT segment) AS n_segments, min(turn % 3)::INT AS page, coalesce(first(cont AND j.author IS NOT NULL ORDER BY i), false) AS mid,
    md5(CASE WHEN first(cont AND j.author IS NOT NULL ORDER BY i) THEN '[' || first(j.author ORDER BY i) || ' (' || first(j.author ORDER BY i)[1] || ') devam ediyor]' || chr(10) ELSE '' END || string_agg(text, chr(10) || chr(10) ORDER BY i)) AS h
    FROM j LEFT JOIN b USING (conv_id, chunk) GROUP BY conv_id, chunk, b.author, authors""",
)
def author_pack(spark, d):
    packed = U.pack_authors(_tagged_turns(spark, d), 300, 500)
    return packed.select(
        F.col("doc_id").alias("conv_id"), "chunk", "author", "author_role", F.array_join("authors_in_chunk", ",").alias("authors"),
        F.size("segment_indices").cast("long").alias("n_segments"), "page", F.col("starts_mid_segment").alias("mid"), F.md5("text").alias("h"),
    )


@query(
    "c12_chunk_tags",
    r"""WITH p AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS t, unnest(range(0, len(string_split(text, ' ')))) AS i FROM conversations), m AS (SELECT *, CASE WHEN regexp_matches(t, '^[a-d]{1}[a-z]{4}') THEN t[1:2] END AS who FROM p),
    s AS (SELECT *, last_value(who IGNORE NULLS) OVER w AS author, sum((who IS NOT NULL)::INT) OVER w AS seg FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, i)),
    a AS (SELECT conv_id, turn, author, sum(length(t)) AS n, min(i) AS f FROM s WHERE author IS NOT NULL GROUP BY ALL), b AS (SELECT conv_id, turn, first(author ORDER BY n DESC, f) AS author, count(*) AS n_authors FROM a GROUP BY ALL)
    SELECT conv_id, turn, b.author, coalesce(n_authors, 0)::INT AS n_authors, count(DISTINCT seg)::INT AS n_segments, first(who IS NULL ORDER BY i) AND last(s.author ORDER BY i) IS NOT NULL AS mid FROM s LEFT JOIN b USING (conv_id, turn) GROUP BY conv_id, turn, b.author, n_authors""",
)
def chunk_tags(spark, d):
    """Turns as chunks whose words are their paragraphs; some words open a segment."""
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), "text")
    who = lambda t: F.when(t.rlike("^[a-d]{1}[a-z]{4}"), F.struct(F.substring(t, 1, 2).alias("author"), F.lit("r").alias("role"), F.create_map().cast("map<string,string>").alias("extra")))
    tagged = U.tag_chunks(chunks, who, separator=" ")
    return tagged.select(
        F.col("doc_id").alias("conv_id"), F.col("chunk").alias("turn"), "author", F.size("authors_in_chunk").alias("n_authors"), F.size("segment_indices").alias("n_segments"), F.col("starts_mid_segment").alias("mid"),
    )


@query(
    "c16_press_chunks",
    """WITH s AS (SELECT doc_id, text, 'Gazete: ' || source || ' | Tarih: ? | Yazar: Bilinmiyor | Başlık: ' || lang || chr(10) AS h, unnest(range(0, length(text), 1500)) AS a FROM documents)
    SELECT doc_id, (a + length(h))::INT AS char_start, md5(h || substring(text, a::INT + 1, 1500)) AS h FROM s""",
)
def press_chunks(spark, d):
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select("doc_id", "text", U.press_header(F.col("source"), none, none, F.col("lang")).alias("header"))
    windows = C.fixed_windows(docs, keep=("header",)).withColumn("char_end", F.col("char_start") + F.length("text"))
    return U.press_chunks(windows, F.col("header")).select("doc_id", "char_start", F.md5("text").alias("h"))


@query(
    "f9_f11_metadata",
    """SELECT o_orderkey AS k, year(o_orderdate)::VARCHAR AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'B' WHEN o_orderkey % 3 = 0 THEN 'A' END AS source_name, strftime(o_orderdate, '%Y-%m-%d') AS date,
    CASE WHEN o_orderkey % 5 = 0 THEN 'c' || o_custkey ELSE 'own' END AS author, o_orderpriority AS topics, 'kept' AS extra FROM orders""",
)
def merged_metadata(spark, d):
    """Older names are brought to present ones, then merged with the document's and its fallback."""
    k = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.create_map(F.lit("gazete"), F.when(k % 3 == 0, "A"), F.lit("source_name"), F.when(k % 2 == 0, "B"), F.lit("tarih"), date, F.lit("author"), F.when(k % 5 == 0, "").otherwise("own"), F.lit("extra"), F.lit("kept"))
    document = F.create_map(F.lit("topics"), F.col("o_orderpriority"), F.lit("period"), F.lit(None).cast("string"))
    fallback = F.create_map(F.lit("author"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    extra = F.create_map(F.lit("extra"), F.lit("lost"), F.lit("topics"), F.lit("lost"))
    # A generated row computes the map once for all of its columns.
    fields = lambda m: F.struct(*[F.try_element_at(m, F.lit(c)).alias(c) for c in ("year", "source_name", "date", "author", "topics", "extra")])
    return table(spark, d, "orders").select(k.alias("k"), F.inline(F.transform(F.array(D.merged(D.canonical(raw), document, fallback, extra)), fields)))


@query(
    "f10_sanitized",
    """SELECT vec_id, 'label=' || label || ';more={"a":' || label || '};ok=' || (label > 3) || ';parts=' || label || ', None, ' || vec_id AS meta FROM embeddings""",
)
def sanitized(spark, d):
    n = F.col("label")
    e = table(spark, d, "embeddings").select("vec_id", "label", (n > 3).alias("ok"), F.array(n.cast("long"), F.lit(None).cast("long"), F.col("vec_id")).alias("parts"), F.create_map(F.lit("a"), n).alias("more"), F.lit(None).cast("string").alias("gone"))
    return e.select("vec_id", _entries(D.sanitized(e, ["label", "ok", "parts", "more", "gone"])).alias("meta"))


@query(
    "f15_f16_hashes",
    """WITH f AS (SELECT doc_id, lang, encode(CASE WHEN doc_id % 100 = 0 THEN repeat('é' || doc_id, 700000) ELSE text END) AS content FROM documents)
    SELECT doc_id, sha256(content)[1:32] AS content_hash, md5('ocr:' || doc_id || ':' || lang) AS cache_key, sha256(content) AS full_hash, sha256(array_slice(content, 1, 1048576) || encode(octet_length(content)::VARCHAR))[1:32] AS fast_hash FROM f""",
)
def hashes(spark, d):
    """Whole texts, and for one in a hundred a file of more than a megabyte, whose fast hash reads its head."""
    k = F.col("doc_id")
    text = F.when(k % 100 == 0, F.repeat(F.concat(F.lit("é"), k.cast("string")), F.lit(700_000))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", "lang", text.alias("content"))
    raw = F.col("content").cast("binary")
    return docs.select(
        "doc_id", D.text_hash(F.col("content")).alias("content_hash"), D.cache_key(F.lit("ocr"), k.cast("string"), F.col("lang")).alias("cache_key"),
        D.file_hash(raw).alias("full_hash"), D.fast_file_hash(raw, F.octet_length("content")).alias("fast_hash"),
    )


@query(
    "f22_f28_p15_answers",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'q  |  odak: ' || role ELSE 'q' END || CASE WHEN turn % 3 = 0 THEN '  |  tarih aralığı: 1990' ELSE '' END AS composed,
    '1. ' || role || ' 2. ' || CASE WHEN turn % 2 = 0 THEN 'x' ELSE '' END || ' 3. ' AS answer, turn % 2 = 0 AND conv_id % 10 >= 6 AS stopped FROM conversations""",
)
def small_answers(spark, d):
    t = F.col("turn")
    given = F.when(t % 2 == 0, F.array(F.col("role"), F.lit("x"))).otherwise(F.array("role"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", D.report_query(F.lit("q"), F.when(t % 2 == 0, F.col("role")), F.when(t % 3 == 0, "1990").otherwise("")).alias("composed"),
        D.off_domain_answer("1. {suggestion_0} 2. {suggestion_1} 3. {suggestion_2}", given).alias("answer"),
        D.off_domain(F.when(t % 2 == 0, "off_domain"), F.col("conv_id") % 10 / 10).alias("stopped"),
    )


def _golden(spark, d):
    k = F.col("item_id")
    span = F.struct(F.lit("d").alias("document_id"), F.lit(0).alias("char_start"), F.lit(9).alias("char_end"))
    page = F.struct(F.lit("d").alias("document_id"), F.lit(1).alias("page"))
    return table(spark, d, "benchmark").select(
        k.alias("query_id"), F.col("text").alias("query"), F.array(F.concat(F.lit("tag"), (k % 4).cast("string"))).alias("tags"),
        F.when(k % 7 == 0, F.array(page)).alias("relevant_pages"), F.when(k % 5 == 0, F.array(span)).alias("gold_evidence_spans"), F.when(k % 3 == 0, F.array("text")).alias("excerpts"),
        F.when(k % 4 == 0, F.array(k)).alias("relevant_kayit_nos"), F.when(k % 2 == 0, F.array(F.concat(k.cast("string"), F.lit("_0")))).alias("relevant_chunk_ids"),
    )


@query(
    "e14_matcher",
    """SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN 'page_overlap' WHEN item_id % 5 = 0 THEN 'span_overlap' WHEN item_id % 3 <> 0 AND item_id % 2 <> 0 THEN 'none'
    ELSE concat_ws('+', CASE WHEN item_id % 3 = 0 THEN 'token_overlap' END, CASE WHEN item_id % 4 = 0 THEN 'kayit_no' WHEN item_id % 2 = 0 THEN 'chunk_id' END) END AS matcher FROM benchmark""",
)
def matchers(spark, d):
    cols = [F.col(c) for c in ("relevant_pages", "gold_evidence_spans", "excerpts", "relevant_kayit_nos", "relevant_chunk_ids")]
    return _golden(spark, d).select("query_id", E.matcher(*cols).alias("matcher"))


_TURNED = """CASE WHEN item_id % 7 = 0 THEN 'page_overlap' WHEN item_id % 5 = 0 THEN 'span_overlap' WHEN item_id % 3 <> 0 AND item_id % 2 <> 0 THEN 'none'
    ELSE concat_ws('+', CASE WHEN item_id % 3 = 0 THEN 'token_overlap' END, CASE WHEN item_id % 4 = 0 THEN 'kayit_no' WHEN item_id % 2 = 0 THEN 'chunk_id' END) END"""
_RANKED = {"precision": "h / 10.0::DOUBLE", "recall": "least(h, 1)::DOUBLE", "hit_rate": "(h > 0)::INT::DOUBLE", "mrr": "coalesce(1.0::DOUBLE / f, 0)", "ndcg": "CASE WHEN matcher LIKE 'span%' THEN 0 ELSE dcg END"}
_WORDED = {"token_recall": "i / g::DOUBLE", "token_precision": "i / r::DOUBLE", "token_iou": "i / (g + r - i)::DOUBLE"}


@query(
    "e14_by_matcher",
    rf"""WITH q AS (SELECT item_id AS query_id, text, {_TURNED} AS matcher FROM benchmark),
    got AS (SELECT item_id - o AS query_id, o + 1 AS rank, item_id AS chunk, text FROM benchmark, (VALUES (0), (1)) t(o)),
    hits AS (SELECT query_id, matcher, rank, CASE WHEN matcher SIMILAR TO '(page|span).*' THEN 1 ELSE (chunk = query_id)::INT END AS hit FROM q JOIN got USING (query_id) WHERE matcher SIMILAR TO '.*(page|span|kayit|chunk).*'),
    m AS (SELECT query_id, matcher, sum(hit) AS h, min(CASE WHEN hit = 1 THEN rank END) AS f, sum(hit / log2(rank + 1)) AS dcg FROM hits GROUP BY ALL),
    gw AS (SELECT query_id, matcher, w, count(*) AS g FROM (SELECT query_id, matcher, unnest(string_split_regex(lower(text), '\s+')) AS w FROM q WHERE matcher LIKE 'token%') WHERE w <> '' GROUP BY ALL),
    rw AS (SELECT query_id, matcher, w, count(*) AS r FROM (SELECT query_id, matcher, unnest(string_split_regex(lower(got.text), '\s+')) AS w FROM q JOIN got USING (query_id) WHERE matcher LIKE 'token%') WHERE w <> '' GROUP BY ALL),
    t AS (SELECT query_id, matcher, sum(least(coalesce(g, 0), coalesce(r, 0))) AS i, sum(coalesce(g, 0)) AS g, sum(coalesce(r, 0)) AS r FROM gw FULL JOIN rw USING (query_id, matcher, w) GROUP BY ALL),
    v AS ({" UNION ALL ".join([f"SELECT query_id, matcher, '{n}' AS metric, {e} AS value FROM m" for n, e in _RANKED.items()] + [f"SELECT query_id, matcher, '{n}', {e} FROM t" for n, e in _WORDED.items()])}
      UNION ALL SELECT query_id, matcher, 'evidence_coverage', 6 / 9.0::DOUBLE FROM m WHERE matcher LIKE 'span%' UNION ALL SELECT query_id, matcher, NULL, NULL FROM q WHERE matcher = 'none')
    SELECT query_id, matcher, metric, round(value, 6) AS value FROM v""",
)
def by_matcher(spark, d):
    """Every benchmark item against itself and the one after it as retrieved chunks."""
    k = F.col("item_id")
    b = table(spark, d, "benchmark")
    got = b.select(k, "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("o")).select(
        (k - F.col("o")).alias("query_id"), (F.col("o") + 1).alias("rank"), F.concat(k.cast("string"), F.lit("_0")).alias("chunk_id"), F.lit("d").alias("document_id"),
        F.lit(0).alias("char_start"), F.lit(6).alias("char_end"), F.array(F.lit(1)).alias("pages"), "text",
    )
    m = E.by_matcher(got, _golden(spark, d), 10)
    return m.select("query_id", "matcher", "metric", F.round("value", 6).alias("value"))


@query("e23_fixture_counts", "SELECT count(*) AS n_queries, count(*) FILTER (item_id % 5 = 0) AS n_spans, count(*) FILTER (item_id % 2 = 0) AS n_chunk_ids FROM benchmark")
def fixture_counts(spark, d):
    return E.fixture_counts(_golden(spark, d))


@query("p19_browse", "SELECT item_id AS query_id FROM benchmark WHERE contains(lower(text), 'g3') OR item_id % 4 = 3")
def browse(spark, d):
    return E.browse(_golden(spark, d), "G3").select("query_id")


@query(
    "e25_report",
    """WITH m AS (SELECT avg(CASE WHEN quality = 1 THEN toxic END) AS a, avg(quality) AS b FROM labels) SELECT round(a, 6) AS a, round(b, 6) AS b, printf('%.2f', a) AS a_shown, printf('%.2f', b) AS b_shown, '—' AS c_shown,
    (SELECT string_agg(DISTINCT CASE WHEN toxic = 1 THEN '✗' WHEN quality = 1 THEN '✓' ELSE '—' END, '' ORDER BY CASE WHEN toxic = 1 THEN '✗' WHEN quality = 1 THEN '✓' ELSE '—' END) FROM labels) AS marks FROM m""",
)
def report(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, F.col("toxic")).alias("a"), F.col("quality").alias("b"), F.lit(None).cast("double").alias("c"), E.regression_mark(F.when(F.col("toxic") == 1, True).when(F.col("quality") == 1, False)).alias("mark"))
    marks = rows.agg(F.array_join(F.array_sort(F.collect_set("mark")), "").alias("marks"))
    means = E.report_averages(rows, ["a", "b", "c"]).select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "a_shown", "b_shown", "c_shown")
    return means.join(F.broadcast(marks))


@query(
    "v12_e24_window_bench",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT 64 AS max_tokens, vec_id AS chunk, v FROM e UNION ALL SELECT 32, vec_id, v[1:32] || list_transform(range(0, 32), lambda x: 0.0::DOUBLE) FROM e),
    q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % 20 = 0), p AS (SELECT max_tokens, query_id, chunk, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)) + 1e-9), 12) AS cos FROM c, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY max_tokens, query_id ORDER BY cos DESC, chunk) AS rank FROM p),
    h AS (SELECT *, CASE WHEN query_id % 40 = 0 THEN chunk IN (query_id + 1, query_id + 2) ELSE rank = 1 END AS hit, CASE WHEN query_id % 40 = 0 THEN 1 + 1 / log2(3) ELSE 1 END AS ideal FROM r),
    s AS (SELECT max_tokens, query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0) AS mrr, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) / max(ideal) AS ndcg, count(*) FILTER (hit AND rank <= 5) / 5.0::DOUBLE AS p, avg(cos) FILTER (rank <= 5) AS c FROM h GROUP BY ALL)
    SELECT max_tokens, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(p), 6) AS precision, round(avg(c), 6) AS avg_cos FROM s GROUP BY 1""",
)
def window_bench(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    half = F.transform("v", lambda x, i: F.when(i < 32, x).otherwise(0.0))
    chunks = e.select(F.lit(64).alias("max_tokens"), F.col("vec_id").alias("chunk"), F.col("v").alias("vec")).unionByName(e.select(F.lit(32).alias("max_tokens"), F.col("vec_id").alias("chunk"), half.alias("vec")))
    asked = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qvec"))
    truth = asked.filter("query_id % 40 = 0").select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 2)).alias("chunk"))
    b = E.window_bench(asked, chunks, truth)
    return b.select("max_tokens", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg", "precision", "avg_cos")])


@query("m17_m25_trace", "SELECT user_id AS trace_id, count(*) AS n_phases, round(sum(round(value, 1)), 4) AS rounded_ms, round(sum(value), 4) AS total_ms FROM events GROUP BY 1")
def traces(spark, d):
    ev = table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("value").alias("latency_ms"))
    both = H.trace(ev, 1).withColumnRenamed("total_ms", "rounded_ms").join(H.trace(ev).drop("n_phases"), "trace_id")
    return both.select("trace_id", "n_phases", F.round("rounded_ms", 4).alias("rounded_ms"), F.round("total_ms", 4).alias("total_ms"))


def _manifest(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("document_id"), F.col("o_orderstatus").alias("collection"), F.col("o_custkey").alias("n"))


@query("m21_manifest_row", "SELECT 'd' || o_orderkey AS document_id, o_orderstatus AS collection, o_custkey AS n FROM orders WHERE o_orderkey = 7 AND o_orderstatus = (SELECT max(o_orderstatus) FROM orders WHERE o_orderkey = 7)")
def manifest_row(spark, d):
    rows = _manifest(spark, d)
    kinds = [H.manifest_row(rows, "d7", c) for c in ("O", "F", "P")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query("k5_clear", "SELECT o_orderstatus AS collection, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def clear(spark, d):
    return H.clear(_manifest(spark, d), "F").groupBy("collection").agg(F.count("*").alias("n"))


@query(
    "m22_health",
    """WITH c AS (SELECT 'orphans' AS "check", count(*) FILTER (page_id NOT IN (SELECT doc_id FROM documents)) AS orphans, count(*) AS total FROM pages UNION ALL SELECT 'labels', count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)), count(*) FROM labels
    UNION ALL SELECT 'counts', abs(count(*) - (SELECT count(*) FROM labels)), count(*) FROM documents) SELECT "check", orphans = 0 AS ok, total, orphans, (SELECT max(orphans) = 0 FROM c) AS all_ok FROM c""",
)
def health(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    parents = docs.select(F.col("doc_id").alias("document_id"))
    ids = lambda df, c: df.select(F.concat(F.col(c).cast("string"), F.lit("_0")).alias("chunk_id"))
    return H.roll_up([H.parent_parity("orphans", ids(table(spark, d, "pages"), "page_id"), parents), H.parent_parity("labels", ids(labels, "doc_id"), parents), H.count_parity("counts", docs, labels)])


@query(
    "o3_plans",
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'temporal' ELSE 'unknown' END AS intent, CASE WHEN turn % 3 = 0 THEN 'policy' ELSE 'fact' END AS query_type, 1::INT AS n, role AS collection, CASE WHEN turn % 2 = 0 THEN turn ELSE 1 END::INT AS priority, 't' AS draft, CASE WHEN turn % 4 > 0 THEN turn % 4 ELSE 5 END::INT AS top_k FROM conversations""",
)
def plans(spark, d):
    """Answers with a usable resource among broken ones."""
    t = F.col("turn").cast("string")
    text = F.concat(
        F.lit('{"intent": "'), F.when(F.col("turn") % 2 == 0, "temporal").otherwise("odd"), F.lit('", "query_type": '), F.when(F.col("turn") % 3 == 0, '"policy"').otherwise("null"),
        F.lit(', "resources": ["x", {"collection": " "}, {"collection": 5, "query_drafts": [{"text": "t"}]}, {"collection": "c", "query_drafts": [{"text": ""}, 3]}, {"collection": " '), F.col("role"),
        F.lit(' ", "mode": "odd", "priority": '), F.when(F.col("turn") % 2 == 0, t).otherwise(F.concat(F.lit('"'), t, F.lit('"'))), F.lit(', "query_drafts": [{"text": 5}, {"text": " t ", "top_k": '), (F.col("turn") % 4).cast("string"), F.lit("}]}]}"),
    )
    p = table(spark, d, "conversations").select("conv_id", "turn", H.plan(text).alias("p"))
    r = F.get("p.resources", F.lit(0))
    return p.select("conv_id", "turn", "p.intent", "p.query_type", F.size("p.resources").alias("n"), r["collection"].alias("collection"), r["priority"].alias("priority"), r["query_drafts"][0]["text"].alias("draft"), r["query_drafts"][0]["top_k"].alias("top_k"))


@query(
    "u17_u18_contexts",
    """WITH c AS (SELECT conv_id AS query_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text FROM conversations), a AS (SELECT query_id, '[' || n || '] (' || role || '/d' || query_id || '/' || turn || ')' || chr(10) || text AS b, n FROM c),
    l AS (SELECT query_id, turn, role, text, role <> 'user' AS second FROM c WHERE turn % 4 <> 3), m AS (SELECT query_id, md5(string_agg(('[' || role || ']' || chr(10) || text)[1:80], chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY second, turn)) AS merged FROM l GROUP BY 1)
    SELECT query_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY n)) AS cited, any_value(merged) AS merged FROM a LEFT JOIN m USING (query_id) GROUP BY 1""",
)
def contexts(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("role").alias("collection"), F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("document_id"), F.col("turn").cast("string").alias("chunk_id"), "text")
    hits = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("source"), F.lit(None).cast("string").alias("date"), "text", F.when(F.col("turn") % 8 != 3, F.when(F.col("turn") % 4 == 3, 2.5).otherwise(0.5)).alias("distance"))
    merged = H.merged_context([hits.filter("source = 'user'"), hits.filter("source <> 'user'")], 80, 1.8, 10**9)
    return H.cited_context(rows).join(merged.select("query_id", F.md5("context").alias("merged")), "query_id", "left").select("query_id", F.md5("context").alias("cited"), "merged")


@query(
    "e20_judged",
    """SELECT doc_id, round((q + t) / 2.0::DOUBLE, 2) AS faithfulness, round(q / 2.0::DOUBLE, 2) AS relevance, abs(q - t) > 1 OR q > 1 AS noisy FROM (SELECT doc_id, doc_id % 5 AS q, coalesce(toxic, 0) * 3 AS t FROM labels)""",
)
def judged(spark, d):
    """Two runs of a judge for each labelled document; the second lacks a dimension."""
    score = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    q, t = F.col("doc_id") % 5, F.coalesce("toxic", F.lit(0)) * 3
    runs = table(spark, d, "labels").select("doc_id", E.judged(F.concat(F.lit("```json\n"), score(faithfulness=q, relevance=q), F.lit("\n```")), score(faithfulness=t)).alias("j"))
    return runs.select("doc_id", *[F.col(f"j.{c}").alias(c) for c in ("faithfulness", "relevance", "noisy")])


@query(
    "o5_verdicts",
    "SELECT conv_id, turn, turn % 4 = 3 OR turn % 3 <> 0 AS passes, turn % 4 <> 3 AS ran, CASE WHEN turn % 4 <> 3 AND turn % 6 = 0 THEN 'fixed' ELSE text END AS answer FROM conversations",
)
def verdicts(spark, d):
    """A validator's output for each turn: failing, broken, or with a correction."""
    t = F.col("turn")
    given = F.when(t % 4 == 3, "no json").otherwise(
        F.concat(F.lit('{"passes": '), F.when(t % 3 == 0, "false").otherwise("true"), F.lit(', "issues": ["x"], "corrected_answer": '), F.when(t % 2 == 0, '"fixed"').otherwise("null"), F.lit("}"))
    )
    v = table(spark, d, "conversations").withColumn("v", H.verdict(given, F.col("text")))
    return v.select("conv_id", "turn", "v.passes", "v.ran", F.coalesce("v.corrected_answer", "text").alias("answer"))


@query(
    "e17_layers",
    """WITH h AS (SELECT conv_id AS query_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, role, turn % 3 = 0 AS rel, turn % 2 = 0 AS near FROM conversations), n AS (SELECT query_id, count(*) FILTER (rel) AS n FROM h GROUP BY 1)
    SELECT query_id, count(*) FILTER (rel AND rank <= 5) / 5.0::DOUBLE AS precision, CASE WHEN n > 0 THEN round(count(*) FILTER (rel AND rank <= 5) / n::DOUBLE, 6) ELSE 0 END AS recall, CASE WHEN n > 0 THEN round(count(*) FILTER (rel AND near) / n::DOUBLE, 6) ELSE 1 END AS context_coverage
    FROM h JOIN n USING (query_id) GROUP BY query_id, n""",
)
def layers(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    got = c.select(F.col("conv_id").alias("query_id"), "rank", F.col("turn").cast("string").alias("document_id"), F.when(F.col("turn") % 2 == 0, 0.5).otherwise(1.9).alias("distance"))
    rel = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.collect_set(F.when(F.col("turn") % 3 == 0, F.col("turn").cast("string"))).alias("relevant_ids"))
    golden = rel.select("query_id", "relevant_ids", F.lit("1997").alias("query"), F.lit(1997).alias("expected_year"), F.lit(True).alias("is_minutes"), F.lit("both").alias("expected_source"))
    r = E.layers(got, golden, 5)
    return r.select("query_id", "precision", F.round("recall", 6).alias("recall"), F.round("context_coverage", 6).alias("context_coverage"))


@query(
    "v10_v11_agent_rows",
    """SELECT doc_id, 'Kaynak: ' || source || ' | Tarih: 1999-01-01' || chr(10) || substring(text, 1, 3000) AS shown, '1999' AS year, 'docs' AS collection, CASE WHEN doc_id % 2 = 0 THEN 0.75 ELSE 0.5 END AS distance,
    CASE WHEN doc_id % 3 = 0 THEN 'zzzq' ELSE 'zzzq zzzr' END AS expanded FROM documents""",
)
def agent_rows(spark, d):
    """No text holds the query's word, so each shows its start."""
    k = F.col("doc_id")
    meta = F.create_map(F.lit("gazete"), F.col("source"), F.lit("tarih"), F.lit("1999-01-01"))
    rows = table(spark, d, "documents").select("doc_id", F.lit("zzzq").alias("query"), "text", meta.alias("metadata"), F.lit(0.5).alias("distance"), F.when(k % 2 == 0, 0.25).alias("rerank_score"))
    got = G.agent_rows(rows, "docs", [("Kaynak", "source_name"), ("Tarih", "date")])
    return got.select("doc_id", F.col("text").alias("shown"), F.col("metadata")["year"].alias("year"), "collection", "distance", G.expanded_query(F.col("query"), F.when(k % 3 == 0, "zzzq").otherwise("zzzr")).alias("expanded"))


@query("s12_s13_lookup", "SELECT 'p' || page_id AS chunk_id, url, 'lookup' AS how FROM pages WHERE page_id IN (3, 5) UNION ALL (SELECT 'p' || page_id, url, 'page' FROM pages ORDER BY 1 LIMIT 20 OFFSET 10)")
def lookups(spark, d):
    chunks = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("chunk_id"), "url")
    return ingest.lookup(chunks, ["p3", "p5"]).withColumn("how", F.lit("lookup")).unionByName(ingest.page(chunks, 20, 10).withColumn("how", F.lit("page")))


@query("p4_years", "SELECT doc_id FROM (SELECT doc_id, 1990 + doc_id % 30 AS year FROM documents) WHERE year IN (1995, 2001)")
def years(spark, d):
    asked = [int(y) for y in D.filter_years({"$or": [{"year": {"$eq": 1995}}, {"$and": [{"year": {"$eq": 2001}}, {"period": {"$eq": 3}}]}]})]
    return table(spark, d, "documents").withColumn("year", 1990 + F.col("doc_id") % 30).filter(P.year_filter(asked)).select("doc_id")
