"""Pages read as atoms, and the keyed store."""

import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.operators import manifest as S
from lectern.operators import structure
from lectern.sources import buckets, html, ingest

OPTIONAL = {"p", "li", "td", "th", "tr"}


def _tree(r, depth=0):
    """A random page as HTML and the atoms that it was made of."""
    word = lambda: "".join(r.choice("abcdé&<ß") for _ in range(r.randint(1, 5)))
    words = lambda: " ".join(word() for _ in range(r.randint(1, 4)))
    shown = lambda t: t.replace("&", "&amp;").replace("<", r.choice(["&lt;", "&#60;"])).replace(" ", r.choice([" ", "\n ", "<b> ", " </i>", "<!-- <p>x</p> --> "]))
    out, atoms = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["p", "h", "ul", "table", "div", "script", "nav", "pre"])
        if kind == "p":
            t = words()
            out.append(f'<P class="a>b">{shown(t)}' + r.choice(["</p>", ""]))
            atoms.append(("text", 0, t))
            if not out[-1].endswith("</p>"):
                out.append("<div></div>")  # ends it
        elif kind == "h":
            k, t = r.randint(1, 6), words()
            out.append(f"<h{k}>{shown(t)}</h{k}>")
            atoms.append((f"heading_{k}", k, t))
        elif kind == "ul":
            items = [words() for _ in range(r.randint(1, 3))]
            out.append("<ul>" + "".join(f"<li>{shown(t)}" + r.choice(["</li>", ""]) for t in items) + "</ul>")
            atoms += [("list_item", 0, t) for t in items]
        elif kind == "table":
            rows = [[words() for _ in range(2)] for _ in range(2)]
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{shown(t)}" + r.choice(["</td>", ""]) for t in row) + r.choice(["</tr>", ""]) for row in rows) + "</table>")
            atoms += [("table_cell", 0, t) for row in rows for t in row]
        elif kind == "div" and depth < 4:
            inner, more = _tree(r, depth + 1)
            out.append(f"<div>{inner}</div>")
            atoms += more
        elif kind == "script":
            out.append('<script>if (a<b) x="</p><p>no";</script>')
        elif kind == "nav":
            out.append("<nav><ul><li>no<p>no</ul></nav>")
        elif kind == "pre":
            out.append("<pre>a\n  b</pre>")
            atoms.append(("code", 0, "a\n  b"))
    return "".join(out), atoms


def test_atoms_are_what_pages_were_made_of(spark):
    r = random.Random(2)
    made = [_tree(r) for _ in range(400)]
    pages = spark.createDataFrame([(k, h, "x") for k, (h, _) in enumerate(made)], "page_id long, html string, text string").repartition(3)
    got = {}
    for row in html.atoms(pages).orderBy("page_id", "pos").collect():
        assert row.pos == len(got.setdefault(row.page_id, []))
        got[row.page_id].append((row.label, row.level, row.text))
    for k, (h, want) in enumerate(made):
        assert got.get(k, []) == want, h


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("plain & simple", [("text", 0, "plain & simple")]),
        ("<nav>never closed<p>no", []),
        ("<p>cut off <a href='x", [("text", 0, "cut off <a href='x")]),
        ("<script>never closed <p>a</p>", []),
        ("</p></div>a</h1><p>b", [("text", 0, "a"), ("text", 0, "b")]),
        ("a<!-- never closed <p>b</p>", [("text", 0, "ab")]),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", [("list_item", 0, t) for t in "abcd"]),
        ("<h1>a<p>b</h1>c", [("heading_1", 1, "a"), ("text", 0, "b"), ("text", 0, "c")]),
        ("<footer><p>x<br>y</footer>", [("page_footer", 0, "x\ny")]),
        ("<p>" * 3000 + "x", [("text", 0, "x")]),
        ("<!--" * 20000 + "<a " * 20000, None),
    ],
)
def test_odd_pages(page, want):
    got = html.page_atoms(page or "")
    assert want is None or got == want


def test_atoms_know_their_headings(spark):
    page = "a<h2>B</h2>b<h3>C</h3>c<h3>D</h3>d<h1>E</h1>e<h3>F</h3>f<h2>G</h2>g"
    rows = html.under_headings(html.atoms(spark.createDataFrame([(1, page)], "page_id int, html string"))).orderBy("pos").collect()
    got = {r.text: r.path for r in rows if not r.level}
    assert got == {"a": [], "b": ["B"], "c": ["B", "C"], "d": ["B", "D"], "e": ["E"], "f": ["E", "F"], "g": ["E", "G"]}
    assert [r.path for r in rows if r.text == "G"] == [["E", "G"]]


def _digests(root):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root).rglob("part-*")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    root = f"{tmp_path}/store"
    rows = spark.range(300).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit(0).alias("v"))
    buckets.create(spark, root, rows.schema, ["chunk_id"], 16)
    with pytest.raises(Exception, match="exist"):
        buckets.create(spark, root, rows.schema, ["chunk_id"], 16)
    assert buckets.read(spark, root).count() == 0
    assert buckets.merge(root, rows, 0, ingest.upsert_chunks) == set(range(16))
    before = _digests(root)
    one = spark.createDataFrame([("c7", 1), ("new", 2)], rows.schema)
    met = buckets.merge(root, one, 1, ingest.upsert_chunks)
    assert len(met) in (1, 2) and before.items() <= _digests(root).items()
    got = {r.chunk_id: r.v for r in buckets.read(spark, root).collect()}
    assert got == {f"c{k}": int(k == 7) for k in range(300)} | {"new": 2}
    # The batch comes again, whole or after a failure before its version was written.
    assert buckets.merge(root, one, 1, ingest.upsert_chunks) == set()
    (Path(root) / "versions/version=1/_SUCCESS").unlink()
    assert len(buckets.read(spark, root).filter("v > 0").collect()) == 0
    buckets.merge(root, one, 1, ingest.upsert_chunks)
    assert {r.chunk_id: r.v for r in buckets.read(spark, root).collect()} == got
    # Deleting leaves an empty bucket that is not read.
    gone = buckets.read(spark, root).select("chunk_id", F.lit(9).alias("v"))
    buckets.merge(root, gone, 2, lambda old, new: old.join(new.select("chunk_id"), "chunk_id", "left_anti"))
    assert buckets.read(spark, root).count() == 0 and buckets.read(spark, root, before=2).count() == 301
    assert buckets.vacuum(spark, root, keep=1) > 0
    assert buckets.versions(spark, root) == [2] and buckets.read(spark, root).count() == 0
    buckets.merge(root, one, 3, ingest.upsert_chunks)
    assert buckets.read(spark, root).count() == 2


def test_a_batch_that_fails_is_not_seen(spark, tmp_path):
    root = f"{tmp_path}/store"
    rows = spark.range(50).select(F.col("id").cast("string").alias("chunk_id"), F.lit(0).alias("v"))
    buckets.create(spark, root, rows.schema, ["chunk_id"], 4)
    buckets.merge(root, rows, 0, ingest.upsert_chunks)

    def broken(old, new):
        return new.withColumn("v", F.raise_error(F.lit("broken")).cast("int"))

    with pytest.raises(Exception, match="broken"):
        buckets.merge(root, rows, 1, broken)
    with pytest.raises(ValueError, match="buckets"):
        buckets.merge(root, rows.limit(1), 1, lambda old, new: rows)
    assert buckets.versions(spark, root) == [0] and buckets.read(spark, root).agg(F.sum("v")).first()[0] == 0


def test_null_keys_and_empty_batches(spark, tmp_path):
    root = f"{tmp_path}/store"
    schema = "document_id string, collection string, status string"
    buckets.create(spark, root, spark.createDataFrame([], schema).schema, S.KEY, 4)
    assert buckets.merge(root, spark.createDataFrame([], schema), 0, S.upsert) == set()
    buckets.merge(root, spark.createDataFrame([(None, "a", "x"), ("b", None, "y")], schema), 1, lambda old, new: old.unionByName(new))
    assert buckets.read(spark, root).count() == 2


def test_sections_that_fit_are_one_chunk(spark):
    page = (
        "<p>intro</p><h1>A</h1><p>a1</p><h2>B</h2><p>b1</p><h3>C</h3><p>c1</p><h2>D</h2><p>" + "d1 " * 9 + "</p><p>d2 d2</p><p>d3 d3 d3 d3 d3 d3</p><h1>E</h1><h3>F</h3><p>f1</p>"
    )
    pages = spark.createDataFrame([(1, page), (2, "<p>x</p><h1>Y</h1>z"), (3, ""), (4, "<p>" + "w " * 30)], "page_id int, html string")
    got = {(r.page_id, r.pos): (r.path, r.text, r.size, r.n_atoms) for r in structure.structural_chunks(html.atoms(pages), 8).collect()}
    assert got == {
        (1, 0): ([], "intro", 1, 1),
        (1, 1): (["A"], "# A\n\na1", 2, 2),
        (1, 3): (["A", "B"], "## B\n\nb1\n\n### C\n\nc1", 4, 4),
        (1, 7): (["A", "D"], "## D", 1, 1),
        (1, 8): (["A", "D"], ("d1 " * 9).strip(), 9, 1),
        (1, 9): (["A", "D"], "d2 d2\n\nd3 d3 d3 d3 d3 d3", 8, 2),
        (1, 11): (["E"], "# E\n\n### F\n\nf1", 3, 3),
        (2, 0): ([], "x\n\n# Y\n\nz", 3, 3),
        (4, 0): ([], ("w " * 30).strip(), 30, 1),
    }


def test_collections_are_opened_or_created(spark, tmp_path):
    root = f"{tmp_path}/chunks"
    with pytest.raises(FileNotFoundError, match="no store"):
        ingest.open_collection(spark, root, "a")
    made = ingest.open_collection(spark, root, "a: b/c", create=True, schema="chunk_id string")
    assert made.count() == 0
    ingest.write_chunks(spark.createDataFrame([("1", "a: b/c"), ("2", "d")], "chunk_id string, collection string"), root)
    assert [r.chunk_id for r in ingest.open_collection(spark, root, "a: b/c").collect()] == ["1"]
    with pytest.raises(ValueError, match="no collection e"):
        ingest.open_collection(spark, root, "e")
    assert ingest.open_collection(spark, root, "e", create=True).count() == 0
    assert [r.chunk_id for r in ingest.open_collection(spark, root, "d", create=True).collect()] == ["2"]


@pytest.mark.parametrize(("page", "want"), [("<p>a &amp; b &#60; &#x3e; &eacute;</p>", "a & b < > é"), ("<p>cut &amp", "cut &amp"), ("&ampx &lt &unknown; &", "&ampx &lt &unknown; &"), ("&amp;lt;", "&lt;")])
def test_references_end_with_a_semicolon(page, want):
    """What is cut off, or no known name, stays as it stands in the page."""
    assert [t for _, _, t in html.page_atoms(page)] == [want]
