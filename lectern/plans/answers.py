"""Agent, splitting, pooling and report queries over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import answers as A
from lectern.functions import text as T
from lectern.operators import agents as G
from lectern.operators import chunking as C
from lectern.operators import filters as P
from lectern.operators import metrics as M
from lectern.operators import pooling as V
from lectern.operators import quality as Q
from lectern.operators import splitting as S
from lectern.plans.registry import query, table
from lectern.sources import ingest


def _talk(spark, d):
    return table(spark, d, "conversations")


@query("c1_c2_recursive_split")
def recursive_split(spark, d):
    """Tests hold it to spans that slice to their chunks and to worked examples."""
    return S.split_with_offsets(table(spark, d, "documents"), 1500, 150)


def _windows(spark, d, size, stride):
    docs = table(spark, d, "documents").filter("length(text) > 0")
    at = docs.select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(stride))).alias("chunk", "char_start"))
    return at.select("doc_id", "chunk", F.expr(f"substring(text, char_start + 1, {size})").alias("text"), "char_start", F.least(F.col("char_start") + size, F.length("text")).alias("char_end"))


MERGE = """WITH RECURSIVE w AS (SELECT doc_id, text, unnest(range(0, length(text), 200)) AS a FROM documents),
c AS (SELECT doc_id, (a // 200)::INT AS k, substring(text, a::INT + 1, 200) AS t, a AS s, least(a + 200, length(text)) AS e FROM w), n AS (SELECT *, len(list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '')) AS n FROM c),
st(doc_id, k, g, size) AS (SELECT doc_id, k, 0, n FROM n WHERE k = 0 UNION ALL SELECT st.doc_id, n.k, CASE WHEN size >= 80 THEN g + 1 ELSE g END, CASE WHEN size >= 80 THEN n.n ELSE size + n.n END FROM st JOIN n ON n.doc_id = st.doc_id AND n.k = st.k + 1)"""


@query("c13_min_token_merge", MERGE + " SELECT doc_id, g AS chunk, min(s) AS char_start, max(e) AS char_end, count(*) AS n_merged, md5(string_agg(t, chr(10) || chr(10) ORDER BY k)) AS h FROM st JOIN n USING (doc_id, k) GROUP BY ALL")
def min_token_merge(spark, d):
    m = S.min_token_merge(_windows(spark, d, 200, 200), 80)
    return m.select("doc_id", "chunk", "char_start", "char_end", "n_merged", F.md5("text").alias("h"))


NORMAL = r"regexp_replace(lower(translate({c}, 'İI', 'iı')), '[!-/:-@\[-`{{-~]', '', 'g')"

# Windows around the words ``ws`` of each text of ``d`` (doc_id, text, flat, ws), by places found one after the other.
WINDOWS = r"""f(doc_id, word, rest, place) AS (SELECT doc_id, word, flat[instr(flat, word) + 1:], instr(flat, word) - 1 FROM (SELECT doc_id, flat, unnest(list_distinct(ws)) AS word FROM d) WHERE contains(flat, word)
      UNION ALL SELECT doc_id, word, rest[instr(rest, word) + 1:], place + instr(rest, word) FROM f WHERE contains(rest, word)),
    hits AS (SELECT DISTINCT d.doc_id, length(text) AS n, place FROM f JOIN d USING (doc_id)),
    w AS (SELECT doc_id, n, place, greatest(0, place - 800) AS a, place + 800 AS b, lag(place + 800) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM hits),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM w),
    s AS (SELECT doc_id, island, min(a) AS a, least(max(b), any_value(n)) AS b FROM i GROUP BY doc_id, island),
    c AS (SELECT *, 3000 - coalesce(sum(b - a) OVER (PARTITION BY doc_id ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s),
    shown AS (SELECT c.doc_id, string_agg(text[(a + 1)::BIGINT:(a + least(b - a, room))::BIGINT], chr(10) || '[...]' || chr(10) ORDER BY island) AS shown FROM c JOIN d ON d.doc_id = c.doc_id WHERE b - a <= room OR room > 200 GROUP BY c.doc_id)"""


@query(
    "f7_relevant_windows",
    rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {NORMAL.format(c="coalesce(text, '')")} AS flat,
      list_filter(string_split_regex({NORMAL.format(c="coalesce(array_to_string(string_split(text, ' ')[3:5], ' '), '')")}, '\s+'), lambda w: length(w) > 2) AS ws FROM documents),
    {WINDOWS}
    SELECT d.doc_id, coalesce(shown.shown, d.text[1:3000]) AS shown FROM d LEFT JOIN shown USING (doc_id)""",
)
def relevant_windows(spark, d):
    """Each document against three of its own words."""
    q = F.concat_ws(" ", F.slice(F.split("text", " "), 3, 3))
    return table(spark, d, "documents").select("doc_id", S.relevant_windows(F.col("text"), q).alias("shown"))


def _tokens(spark, d):
    w = _windows(spark, d, 24, 25)
    vec = F.array((F.col("chunk") % 5 + 1).cast("double"), (F.col("chunk") % 3).cast("double"), (F.col("doc_id") % 7).cast("double"))
    return w.select("doc_id", F.col("chunk").alias("pos"), F.col("char_start").alias("t_start"), F.col("char_end").alias("t_end"), vec.alias("vec"))


TOKENS = """t AS (SELECT doc_id, a // 25 AS pos, a AS t0, least(a + 24, n) AS t1, [a // 25 % 5 + 1, a // 25 % 3, doc_id % 7]::DOUBLE[] AS v FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 25)) AS a FROM documents)),
s AS (SELECT doc_id, a // 300 AS k, a AS c0, least(a + 400, n) AS c1 FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 300)) AS a FROM documents))"""
UNIT = "round(x / sqrt(x*x + y*y + z*z), 5) AS x, round(y / sqrt(x*x + y*y + z*z), 5) AS y, round(z / sqrt(x*x + y*y + z*z), 5) AS z"


def _xyz(df):
    return df.select("doc_id", "chunk", *[F.round(F.col("vec")[k], 5).alias(n) for k, n in enumerate("xyz")])


@query(
    "v3_late_pool",
    f"WITH {TOKENS}, p AS (SELECT s.doc_id, k, avg(v[1]) AS x, avg(v[2]) AS y, avg(v[3]) AS z FROM s JOIN t ON t.doc_id = s.doc_id AND greatest(t0, c0) < least(t1, c1) GROUP BY ALL) SELECT doc_id, k::INT AS chunk, {UNIT} FROM p",
)
def late_pool(spark, d):
    return _xyz(V.late_pool(_tokens(spark, d), _windows(spark, d, 400, 300), 3))


@query(
    "v4_late_pool_windowed",
    f"""WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), w0 AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n > 50 THEN ceil((n - 50) / 40.0)::BIGINT ELSE 0 END + 1)) AS w FROM n),
    tw AS (SELECT t.*, w FROM w0 JOIN t ON t.doc_id = w0.doc_id AND pos >= w * 40 AND pos < w * 40 + 50), e AS (SELECT doc_id, w, min(t0) AS e0, max(t1) AS e1 FROM tw GROUP BY ALL),
    sw AS (SELECT s.doc_id, k, w, greatest(c0, e0) AS c0, least(c1, e1) AS c1 FROM s JOIN e ON e.doc_id = s.doc_id AND greatest(c0, e0) < least(c1, e1)),
    p AS (SELECT sw.doc_id, k, sw.w, avg(v[1]) AS x, avg(v[2]) AS y, avg(v[3]) AS z FROM sw JOIN tw ON tw.doc_id = sw.doc_id AND tw.w = sw.w AND greatest(t0, c0) < least(t1, c1) GROUP BY ALL)
    SELECT doc_id, k::INT AS chunk, round(avg(x / sqrt(x*x + y*y + z*z)), 5) AS x, round(avg(y / sqrt(x*x + y*y + z*z)), 5) AS y, round(avg(z / sqrt(x*x + y*y + z*z)), 5) AS z FROM p GROUP BY ALL""",
)
def late_pool_windowed(spark, d):
    return _xyz(V.late_pool_windowed(_tokens(spark, d), _windows(spark, d, 400, 300), 3, 60, 10))


@query("v5_embed_mode", "SELECT doc_id, CASE WHEN count(*) FILTER (p % 40 = 39) > 0 THEN 'standard' ELSE 'late' END AS mode FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS p FROM documents) GROUP BY 1")
def embed_mode(spark, d):
    """Every 40th line of a document stands for a chunk without a span."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t"))
    return V.embed_mode(lines.withColumn("char_start", F.when(F.col("p") % 40 != 39, F.col("p"))))


@query("f19_extract_json", """SELECT conv_id, turn, '{"turn": ' || turn || ', "role": ["' || role || '"]}' AS json FROM conversations""")
def extract_json(spark, d):
    """An answer around a fenced object whose list is left open comes back as the closed object."""
    said = F.concat(F.lit('Yanıt:\n```json\n{"turn": '), F.col("turn"), F.lit(', "role": ["'), F.col("role"), F.when(F.col("turn") % 2 == 0, F.lit('"}\n```\nson')).otherwise('"\n```'))
    return _talk(spark, d).select("conv_id", "turn", A.extract_json(said).alias("json"))


@query("e26_string_list", "SELECT conv_id, turn, role || '|b' AS items FROM conversations")
def string_list(spark, d):
    said = F.concat(F.lit('liste: ["'), F.col("role"), F.lit('", " ", "b"] ve [1]'))
    return _talk(spark, d).select("conv_id", "turn", F.array_join(A.string_list(said), "|").alias("items"))


@query(
    "f21_commands",
    """SELECT conv_id, turn, ['normal_query', 'show_source', 'exit', 'rapor', 'unknown_command', 'show_source', 'empty'][(turn + conv_id) % 7 + 1] AS action,
    CASE (turn + conv_id) % 7 WHEN 0 THEN role WHEN 3 THEN role || ' Ankara' END AS query, CASE (turn + conv_id) % 7 WHEN 1 THEN turn END::INT AS source_index, (turn + conv_id) % 7 IN (4, 5) AS failed FROM conversations""",
)
def commands(spark, d):
    k, role = (F.col("turn") + F.col("conv_id")) % 7, F.col("role")
    raw = F.when(k == 0, role).when(k == 1, F.concat(F.lit("/kaynak "), F.col("turn") + 1)).when(k == 2, "  /CIKIS ").when(k == 3, F.concat(F.lit("/rapor  "), role, F.lit(" Ankara"))).when(k == 4, "/nedir").when(k == 5, "/kaynak x").otherwise(" ")
    return _talk(spark, d).select("conv_id", "turn", A.command(raw).alias("c")).select("conv_id", "turn", "c.*")


@query(
    "f24_source_summary",
    """WITH s AS (SELECT s_nationkey AS query_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS n, CASE WHEN s_suppkey % 2 = 0 THEN '2001-01-01' END AS dt FROM supplier)
    SELECT query_id, string_agg('  Kaynak ' || r || ': ' || CASE WHEN n IS NULL AND dt IS NULL THEN '(metaveri yok, içerik BAĞLAM''da)' ELSE concat_ws(' | ', n, dt) END, chr(10) ORDER BY r) || chr(10) AS summary FROM s WHERE r <= 5 GROUP BY 1""",
)
def source_summary(spark, d):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    s = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("query_id"), k.alias("rank"), F.lit("").alias("source_name"), none.alias("source_title"),
        F.when(k % 3 > 0, F.col("s_name")).alias("title"), F.when(k % 2 == 0, "2001-01-01").alias("date"), none.alias("author"),
    )
    return G.source_summary(s)


@query("f25_years", "SELECT o_orderstatus, string_agg(DISTINCT year(o_orderdate)::VARCHAR, ',' ORDER BY year(o_orderdate)::VARCHAR) AS years FROM orders GROUP BY 1")
def years(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("years"))


@query("f27_filter_summary", "SELECT doc_id, concat_ws(', ', CASE WHEN doc_id % 5 > 0 THEN 'period=' || doc_id % 5 END, CASE WHEN source <> '' THEN 'author=' || source END) AS summary FROM documents")
def filter_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", A.summary([("period", F.col("doc_id") % 5), ("author", F.col("source"))]).alias("summary"))


@query(
    "u7_allocation",
    """SELECT n_regionkey AS query_id, n_name AS collection, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS priority, [2, 3, 3, 3, 3][n_regionkey + 1] AS retrieval_budget, [2, 2, 2, 2, 3][n_regionkey + 1] AS reserve_budget,
    [10, 10, 12, 12, 15][n_regionkey + 1] AS fetch_k FROM nation""",
)
def allocation(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("other", "summary", "comparison", "reasoning", "policy")])
    n = table(spark, d, "nation")
    return G.allocate(n.select(F.col("n_regionkey").alias("query_id"), F.element_at(kinds, (F.col("n_regionkey") + 1).cast("int")).alias("query_type"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("collection")))


@query(
    "p18_session_scope",
    """WITH p AS (SELECT DISTINCT s_nationkey AS q, s_suppkey % 4 AS c FROM supplier), s AS (SELECT n_nationkey AS q, unnest([n_nationkey % 4, 9]) AS c FROM nation), k AS (SELECT * FROM p SEMI JOIN s USING (q, c))
    SELECT q AS query_id, c AS collection, false AS fallback FROM k UNION ALL SELECT q, c, true FROM s WHERE q IN (SELECT q FROM p) AND q NOT IN (SELECT q FROM k)""",
)
def session_scope(spark, d):
    plans = table(spark, d, "supplier").select(F.col("s_nationkey").alias("query_id"), (F.col("s_suppkey") % 4).alias("collection")).distinct()
    key = F.col("n_nationkey")
    return G.session_scope(plans, table(spark, d, "nation").select(key.alias("query_id"), F.explode(F.array(key % 4, F.lit(9).cast("long"))).alias("collection")))


@query(
    "u20_suggestions",
    """WITH t AS (SELECT conv_id, turn, list_filter([role, 'x' || turn, 'c'], lambda s: s <> 'x2') AS k FROM conversations)
    SELECT conv_id, turn, array_to_string(list_slice(list_concat(k, list_filter(['b', 'c', 'x2', 'd'], lambda f: NOT list_contains(k, f) AND f <> 'x2')), 1, 4), ',') AS items FROM t""",
)
def suggestions(spark, d):
    given = F.array(F.col("role"), F.concat(F.lit("x"), F.col("turn")), F.lit("c"))
    return _talk(spark, d).select("conv_id", "turn", F.array_join(G.suggest(given, F.lit("x2"), ["b", "c", "x2", "d"], 4), ",").alias("items"))


RANKED = "r AS (SELECT conv_id AS query_id, turn AS rank, 'baş' || chr(10) || ' ' || text AS text, CASE WHEN turn % 4 <> 3 THEN (turn % 5) / 2.0::DOUBLE + 0.00004 END AS distance FROM conversations)"


def _ranked(spark, d):
    t = F.col("turn")
    return _talk(spark, d).select(F.col("conv_id").alias("query_id"), t.alias("rank"), F.concat(F.lit("baş\n "), F.col("text")).alias("text"), F.when(t % 4 != 3, (t % 5) / 2 + 0.00004).alias("distance"))


@query(
    "u15_structured_context",
    f"""WITH {RANKED}, k AS (SELECT *, substring(text, 1, 120) AS t FROM r WHERE distance IS NULL OR distance <= 1.8), s AS (SELECT *, row_number() OVER w AS n, sum(length(t)) OVER w AS s FROM k WINDOW w AS (PARTITION BY query_id ORDER BY rank))
    SELECT query_id, rank, round(distance, 4) AS distance, md5(regexp_replace(substring(t, 5), '^\\s+|\\s+$', '', 'g')) AS h FROM s WHERE n = 1 OR s <= 300""",
)
def structured_context(spark, d):
    return G.structured_context(_ranked(spark, d), 120, 1.8, 300).select("query_id", "rank", "distance", F.md5("excerpt").alias("h"))


@query("u12_u16_citations", f"WITH {RANKED} SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation FROM r WHERE distance IS NULL OR distance <= 1.8")
def citations(spark, d):
    return G.citations(P.within(_ranked(spark, d), 1.8)).select("query_id", "rank", "citation")


@query("u19_more", "SELECT conv_id AS query_id, count(*) AS n, count(*) < 3 AS again FROM conversations GROUP BY 1")
def more(spark, d):
    return G.needs_more(_talk(spark, d).select(F.col("conv_id").alias("query_id"), F.lit(1).alias("n_docs")))


@query("u21_flatten", "SELECT vec_id, i AS rank, embedding[i] AS x, embedding[i] * 2 AS y FROM embeddings, unnest(range(1, 65)) AS u(i)")
def flatten_results(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.transform("embedding", lambda v: v * 2).alias("y"))
    return G.flatten_results(e, ["x", "y"])


@query(
    "u23_typed_chunks",
    """WITH c AS (SELECT *, 'c' || l_linenumber || '_' || (l_linenumber - 1) AS gen FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'k' || l_orderkey ELSE gen END AS chunk_id,
    CASE WHEN l_linenumber % 3 = 0 THEN 'd' || l_orderkey WHEN l_linenumber % 2 = 0 THEN 'k' || l_orderkey ELSE gen END AS document_id, round(1 - l_discount, 6) AS score, round(CASE WHEN l_tax > 0.04 THEN l_tax ELSE 1 - l_discount END, 6) AS rerank_score FROM c""",
)
def typed_chunks(spark, d):
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("c"), n).alias("collection"), n.alias("rank"), F.when(n % 2 == 0, F.concat(F.lit("k"), key)).alias("chunk_id"),
        F.when(n % 3 == 0, F.concat(F.lit("d"), key)).alias("document_id"), F.col("l_discount").alias("distance"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("rerank_score"),
    )
    t = G.typed_chunks(rows)
    return t.select("l_orderkey", "l_linenumber", "chunk_id", "document_id", *[F.round(c, 6).alias(c) for c in ("score", "rerank_score")])


@query(
    "e6_e8_accuracies",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (lang = 'en')::INT WHEN 1 THEN (lang <> 'en')::INT ELSE 1 END::DOUBLE AS routing, CASE WHEN doc_id % 4 = 0 OR 1990 + doc_id % 30 = 2000 + doc_id % 5 THEN 1 ELSE 0 END::DOUBLE AS dates,
    CASE WHEN doc_id % 6 = 0 THEN 1 ELSE len(list_intersect([doc_id % 2, 5], [1, doc_id % 6])) / 2 END::DOUBLE AS coverage FROM documents""",
)
def accuracies(spark, d):
    k = F.col("doc_id")
    want = F.element_at(F.array(F.lit("minutes"), F.lit("gazete"), F.lit("both")), (k % 3 + 1).cast("int"))
    text = F.concat(F.lit("1"), F.lit(" Mart "), 1990 + k % 30, F.lit(" günü"))
    relevant = F.when(k % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 2, F.lit(5).cast("long")))
    return table(spark, d, "documents").select(
        "doc_id", G.routing_accuracy(F.col("lang") == "en", want).alias("routing"), G.date_accuracy(text, F.when(k % 4 != 0, 2000 + k % 5)).alias("dates"),
        G.context_share(relevant, F.array(F.lit(1).cast("long"), k % 6)).alias("coverage"),
    )


@query(
    "e19_comparison",
    """SELECT metric, round(avg(v) FILTER (o = 'F'), 4) AS "F", round(avg(v) FILTER (o = 'O'), 4) AS "O", round(avg(v) FILTER (o = 'P'), 4) AS "P" FROM
    (SELECT o_orderstatus AS o, 'price' AS metric, o_totalprice AS v FROM orders UNION ALL SELECT o_orderstatus, 'half', o_totalprice / 2 FROM orders) GROUP BY 1""",
)
def comparison(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 2).alias("half"))
    return G.comparison(o, ["price", "half"], "o_orderstatus", ["F", "O", "P"]).select("metric", *[F.round(c, 4).alias(c) for c in "FOP"])


@query(
    "e21_regressions",
    "WITH o AS (SELECT o_orderkey AS query_id, greatest(o_custkey % 9 - o_orderkey % 7, 3 - o_orderkey % 5) AS d FROM orders) SELECT query_id, d AS drop, d > 1 AS regressed FROM o",
)
def regressions(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "query_id")
    now = o.select("query_id", (F.col("query_id") % 7).alias("relevance"), (F.col("query_id") % 5).alias("faithfulness"))
    golden = o.select("query_id", (F.col("o_custkey") % 9).alias("relevance"), F.lit(3).alias("faithfulness"))
    return M.regressions(now, golden, ["relevance", "faithfulness"])


@query(
    "e22_resolve_spans",
    """WITH w AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'bad' || o_orderkey ELSE 'o' || o_orderkey || '_' || (o_orderkey % 6) END AS chunk_id FROM orders), n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
    c AS (SELECT l_orderkey AS k, l_linenumber - 1 AS i, min(CASE WHEN l_linenumber <> 4 THEN l_partkey END) AS a FROM lineitem GROUP BY ALL)
    SELECT chunk_id, CASE WHEN w.k % 11 <> 0 THEN 'o' || w.k END AS document_id, CASE WHEN w.k % 11 <> 0 THEN a END AS char_start, CASE WHEN w.k % 11 <> 0 THEN a + 10 END AS char_end,
    CASE WHEN w.k % 11 = 0 THEN 'format' WHEN w.k % 7 = 0 THEN 'manifest' WHEN n IS NULL THEN 'cache' WHEN c.k IS NULL THEN 'index' WHEN a IS NULL THEN 'span' END AS error
    FROM w LEFT JOIN n ON n.k = w.k LEFT JOIN c ON c.k = w.k AND c.i = w.k % 6""",
)
def resolve_spans(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    doc = F.concat(F.lit("o"), k)
    wanted = o.select(F.when(k % 11 == 0, F.concat(F.lit("bad"), k)).otherwise(F.concat_ws("_", doc, k % 6)).alias("chunk_id"))
    manifest = o.select(doc.alias("document_id"), F.when(k % 7 == 0, "").otherwise("file").alias("document_source"))
    at = F.min(F.when(F.col("l_linenumber") != 4, F.col("l_partkey")))
    lines = table(spark, d, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey")).alias("document_id"), (F.col("l_linenumber") - 1).alias("chunk")).agg(at.alias("char_start"))
    return G.resolve_spans(wanted, manifest, lines.withColumn("char_end", F.col("char_start") + 10))


@query(
    "m14_m24_confidence",
    "SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN 0.5 WHEN o_orderkey % 3 = 1 THEN (o_custkey % 10 + 2) / 2.0 END::DOUBLE, 6) AS confidence FROM orders",
)
def confidence(spark, d):
    k = F.col("o_orderkey")
    nan = F.lit(float("nan"))
    cells = F.when(k % 3 == 1, F.array((F.col("o_custkey") % 10).cast("double"), nan, F.lit(2.0))).otherwise(F.array(nan))
    return table(spark, d, "orders").select("o_orderkey", F.round(Q.mean_confidence(F.when(k % 3 == 0, 0.5), cells), 6).alias("confidence"))


@query(
    "m15_packer_report",
    """WITH RECURSIVE a AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS p FROM documents), x AS (SELECT doc_id, unnest(p) AS t, unnest(range(1, len(p) + 1)) AS i FROM a),
    st(doc_id, i, chunk, size) AS (SELECT doc_id, i, 0, length(t) FROM x WHERE i = 1 UNION ALL SELECT s.doc_id, x.i, CASE WHEN s.size >= 400 AND s.size + 2 + length(x.t) > 1500 THEN s.chunk + 1 ELSE s.chunk END,
      CASE WHEN s.size >= 400 AND s.size + 2 + length(x.t) > 1500 THEN length(x.t) ELSE s.size + 2 + length(x.t) END FROM st s JOIN x ON x.doc_id = s.doc_id AND x.i = s.i + 1),
    c AS (SELECT count(*) AS m, avg(n) AS mean, median(n) AS median FROM (SELECT max(size) AS n FROM st GROUP BY doc_id, chunk)), b AS (SELECT count(*) AS n, 100.0 * count(*) FILTER (length(t) < 400) / count(*) AS short, avg(length(t)) AS mean, median(length(t)) AS median FROM x)
    SELECT b.n AS n_atoms, round(short::DOUBLE, 4) AS short_pct, round(b.mean, 4) AS atom_mean, b.median::DOUBLE AS atom_median, m AS n_chunks, round(100.0::DOUBLE * (b.n - m) / b.n, 4) AS reduction_pct, round(c.mean, 4) AS chunk_mean, c.median::DOUBLE AS chunk_median FROM b, c""",
)
def packer_report(spark, d):
    docs = table(spark, d, "documents")
    n = F.length("text")
    before = C.atoms(docs).agg(F.count("*").alias("n_atoms"), F.round(100 * F.count_if(n < 400) / F.count("*"), 4).alias("short_pct"), F.round(F.avg(n), 4).alias("atom_mean"), F.percentile(n, F.lit(0.5)).alias("atom_median"))
    after = C.greedy_pack(docs).agg(F.count("*").alias("n_chunks"), F.round(F.avg(n), 4).alias("chunk_mean"), F.percentile(n, F.lit(0.5)).alias("chunk_median"))
    # Both sides are one row of totals.
    both = before.withColumn("_one", F.lit(1)).join(after.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("reduction_pct", F.round(100 * (F.col("n_atoms") - F.col("n_chunks")) / F.col("n_atoms"), 4))


@query("m19_engines", "SELECT source AS engine, count(*) AS n_documents, sum(length(text)) AS n_chars, sum(ceil(length(text) / 1500.0))::BIGINT AS n_chunks FROM documents GROUP BY 1")
def engines(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").groupBy(F.col("source").alias("engine")).agg(F.count("*").alias("n_documents"), F.sum(n).alias("n_chars"), F.sum(F.ceil(n / 1500)).alias("n_chunks"))


@query(
    "m20_provenance",
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS i, min(l_partkey) AS a, min(l_partkey) + min(l_suppkey) % 3 * 30 AS b FROM lineitem GROUP BY ALL), g AS (SELECT *, a - lag(b) OVER (PARTITION BY k ORDER BY i) AS gap FROM s)
    SELECT k AS doc_id, count(*) AS n, count(*) FILTER (b <= a) AS "empty", count(*) FILTER (gap > 50) AS gaps FROM g GROUP BY 1""",
)
def provenance(spark, d):
    a = F.min("l_partkey")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk")).agg(a.alias("char_start"), (a + F.min("l_suppkey") % 3 * 30).alias("char_end"))
    return Q.provenance_gaps(lines)


@query("p12_p16_answer_modes", "SELECT conv_id, turn, turn % 3 = 0 OR role = 'user' AS deep, role = 'assistant' AS nothing FROM conversations")
def answer_modes(spark, d):
    asked = F.when(F.col("turn") % 3 == 0, "deep")
    said = F.when(F.col("role") == "user", "Kapsamlı  incele").when(F.col("role") == "assistant", "Bu konuda bilgi  yok").otherwise("Merhaba")
    return _talk(spark, d).select("conv_id", "turn", G.deep_mode(said, asked).alias("deep"), G.nothing_found(said).alias("nothing"))


@query("k1_k2_chunk_store", "SELECT 'd' || (o_orderkey % 50) || '_' || o_orderkey AS chunk_id, 'd' || (o_orderkey % 50) AS document_id, o_orderkey % 3 = 0 AS renewed FROM orders WHERE o_orderkey % 50 <> 7")
def chunk_store(spark, d):
    """A third of the chunks is written anew, then one document is deleted."""
    k = F.col("o_orderkey")
    doc = F.concat(F.lit("d"), k % 50)
    rows = table(spark, d, "orders").select(F.concat_ws("_", doc, k).alias("chunk_id"), doc.alias("document_id"), "o_orderkey")
    new = rows.filter(k % 3 == 0).drop("o_orderkey").withColumn("renewed", F.lit(True))
    new = new.unionByName(new)  # a batch that holds its rows twice
    return ingest.delete_document(ingest.upsert_chunks(rows.drop("o_orderkey").withColumn("renewed", F.lit(False)), new), "d7")


@query("f26_pages", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS pages FROM lineitem GROUP BY 1")
def item_pages(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")), ",").alias("pages"))
