"""Verbs over requests, the manifest and the registry."""

import json

import pytest

from lectern.__main__ import main
from lectern.operators import manifest as S
from lectern.sources import adapters, buckets

pytest.importorskip("yaml")
REGISTRY = "models:\n  small: {dim: 8}\ncollections:\n  press: {model: small, document_type: press_clip, weight: 0.5}\n"


@pytest.fixture
def run(spark, capsys):
    def call(*argv):
        code = main([str(x) for x in argv], spark)
        return code, [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    return call


def _request(path, *documents, version="1.0"):
    path.write_text(json.dumps({"version": version, "collection": "press", "documents": list(documents)}))
    return path


def _doc(i, kind="press_clip", **more):
    return {"document_id": i, "document_type": kind, "document_source": "", "metadata": more}


def test_validate(run, tmp_path):
    registry = tmp_path / "models.yaml"
    registry.write_text(REGISTRY)
    assert run("validate", _request(tmp_path / "a.json", _doc("1"), _doc("2")), "--registry", registry) == (0, [])
    code, rows = run("validate", _request(tmp_path / "b.json", _doc("1"), _doc("1"), _doc(""), _doc("x", "none")), "--registry", registry)
    assert code == 1 and [(r["position"], r["error"]) for r in rows] == [(1, "duplicate id"), (2, "missing id"), (3, "unknown type")]
    assert run("validate", _request(tmp_path / "c.json", version="2.0"), "--registry", registry)[0] == 1


@pytest.fixture
def store(spark, tmp_path):
    root = f"{tmp_path}/store"
    schema = "document_id string, collection string, status string, document_type string, content_hash string, chunk_count int, quality_json string, perf_json string, ingest_time string"
    rows = [("1", "press", "done", "press_clip", "h1", 3, None, '{"total_ms": 20}', "t"), ("2", "press", "failed", "press_clip", "h2", 0, None, None, "t"), ("1", "other", "done", "report", "h", 1, None, None, "t")]
    df = spark.createDataFrame(rows, schema)
    buckets.create(spark, root, df.schema, S.KEY, 4)
    buckets.merge(root, df, 0, S.upsert)
    return root


def test_diff_and_status(run, tmp_path, store):
    request = _request(tmp_path / "a.json", _doc("1", content_hash="h1"), _doc("2", content_hash="new"), _doc("3"))
    code, rows = run("diff", request, "--store", store)
    assert code == 0 and {r["document_id"]: r["state"] for r in rows} == {"1": "unchanged", "2": "changed", "3": "new"}
    code, rows = run("status", "--store", store)
    assert code == 0 and {(r["collection"], r["status"]): r["n"] for r in rows} == {("press", "done"): 1, ("press", "failed"): 1, ("other", "done"): 1}
    assert [r["n"] for r in run("status", "--store", store, "--collection", "other")[1]] == [1]
    assert run("status", "--store", store, "--collection", "absent") == (1, [])
    assert run("status", "--store", store, "--report", "--document-type", "press_clip")[1][0]["total_ms"] == 20.0


def test_delete(run, spark, store):
    code, rows = run("delete", "1", "--collection", "press", "--store", store)
    assert (code, rows) == (0, [{"deleted": "1", "batch": 1}])
    assert sorted((r.document_id, r.collection) for r in buckets.read(spark, store).collect()) == [("1", "other"), ("2", "press")]
    assert run("delete", "1", "--collection", "press", "--store", store)[0] == 1


def test_collections_are_added_or_left_as_they_were(run, tmp_path):
    registry = tmp_path / "models.yaml"
    registry.write_text(REGISTRY)
    add = lambda name, model="small", kind="press_clip": run("add-collection", name, "--registry", registry, "--model", model, "--document-type", kind)
    code, rows = add("minutes")
    assert code == 0 and rows[0] == {"name": "minutes", "model": "small", "document_type": "press_clip", "dim": 8, "weight": 1.0}
    assert [r["name"] for r in run("list-collections", "--registry", registry)[1]] == ["minutes", "press"]
    held = registry.read_text()
    for wrong in (("minutes",), ("third", "no model"), ("third", "small", "no type")):
        assert add(*wrong)[0] == 1 and registry.read_text() == held
    assert [r["document_type"] for r in run("list-types")[1]] == adapters.types()
