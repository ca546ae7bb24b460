import json
from datetime import datetime

import pytest

from spindrift import embedding
from spindrift.config import Config
from spindrift.errors import ConfigError, EngineError, LockTimeout, ProviderError, as_response
from spindrift.plans.engine import Engine
from spindrift.sources.repo import find_root, listing, read_repository
from spindrift.sources.snapshots import Snapshots
from spindrift.streaming.increments import savings_by_window, upsert_stream


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    files = {
        "src/billing.py": "def charge(card):\n    return validate(card)\n\n\ndef validate(card):\n    x = 1\n    return x\n",
        "src/__init__.py": "def package_entry():\n    return charge(1)\n",
        "src/_private/tool.py": "def tool():\n    pass\n",
        "tests/test_billing.py": "def check_charge():\n    a = charge(2)\n    return a\n",
        "app/billing.ts": "export function chargeView() {\n  const a = 1;\n  return a;\n}\n",
        "node_modules/x.js": "function no() {}\n",
        "gen/out.py": "def no():\n    pass\n",
        ".gitignore": "# generated\ngen/\n",
        "README.md": "no",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".git").mkdir()
    return root


def test_listing(spark, repo):
    expected = ["app/billing.ts", "src/__init__.py", "src/_private/tool.py", "src/billing.py", "tests/test_billing.py"]
    assert listing(repo) == expected
    assert listing(repo, ("*.ts",)) == expected[1:]
    assert find_root(repo / "src" / "_private") == repo
    rows = read_repository(spark, repo).collect()
    assert sorted(r["file_path"] for r in rows) == expected and all(len(r["file_hash"]) == 64 for r in rows)


def test_engine(spark, repo, tmp_path):
    engine = Engine(spark, str(repo), str(tmp_path / "home"))
    stats = engine.reindex()
    assert (stats["files_scanned"], stats["files_indexed"], stats["chunks_created"]) == (5, 5, 6)
    assert stats["languages"] == {"python": 4, "typescript": 1}
    again = engine.reindex()
    assert (again["files_indexed"], again["chunks_created"]) == (0, 0)
    exact = engine.search_exact("charge").orderBy("rank").collect()
    assert exact and exact[0]["chunk_type"] == "function"
    hybrid = engine.search_hybrid(["charge card validate", "login"]).collect()
    assert {"charge"} <= {r["name"] for r in hybrid if r["qid"] == 0}
    assert any(r["file_path"] == "tests/test_billing.py" for r in hybrid if r["qid"] == 0)
    assert engine.search_semantic("validate card").count() >= 0
    assert {r["category"] for r in engine.audit_search("charge card").collect()} <= {"both", "semantic_only", "exact_only"}
    (repo / "src" / "billing.py").write_text("def charge(card):\n    return 2\n")
    (repo / "app" / "billing.ts").unlink()
    assert "[STALE]" in engine.get_file("src/billing.py")
    assert engine.inspect_index()["stale_listed"] == ["src/billing.py"]
    stats = engine.reindex()
    assert (stats["files_indexed"], stats["files_deleted"]) == (1, 1)
    assert engine.inspect_index()["chunks"] == 4 and "[STALE]" not in engine.get_file("src/billing.py")
    assert engine.inspect_index("src/billing.py")["chunks"][0]["name"] == "charge"
    assert engine.reindex(force=True)["chunks_created"] == 4
    with pytest.raises(EngineError, match="no file"):
        engine.get_file("nope.py")
    body = json.loads(engine.respond("exact", "charge"))
    assert body["results"] and body["tokens_saved"]["without"] > 0 and "charge" in body["summary"]
    assert engine.inspect_index()["total_queries"] == 1
    assert json.loads(engine.respond("exact", "zzzz"))["summary"].startswith("No results")


def test_answers(spark, repo, tmp_path):
    engine = Engine(spark, str(repo), str(tmp_path / "home"))
    assert json.loads(engine.answer("reindex"))["result"]["files_scanned"] == 5
    assert engine.get_file(str(repo / "src" / "billing.py")) == engine.get_file("src/billing.py")
    assert json.loads(engine.answer("inspect_index"))["result"]["bytes"] > 0
    assert json.loads(engine.answer("get_callers", "charge"))["result"] == ["check_charge", "package_entry"]
    assert {r["category"] for r in json.loads(engine.answer("audit_search", "charge"))["result"]} <= {"both", "semantic_only", "exact_only"}
    for tool, args in (("get_file", ("nope.py",)), ("search_exact", ("x", -1)), ("drop", ()), ("get_file", (3,)), ("search_hybrid", ())):
        assert set(json.loads(engine.answer(tool, *args))) == {"error", "suggestion"}
    assert json.loads(engine.answer("delete_file", "src/billing.py"))["result"] == 2
    assert "isn't in the index" in json.loads(engine.answer("get_file", "src/billing.py"))["error"]
    assert engine.get_callers("validate") == [] and engine.reindex()["files_indexed"] == 1


def test_a_dead_writer_and_old_versions(spark, tmp_path):
    a = Snapshots(spark, str(tmp_path / "s"), timeout=2, poll=0.1, expiry=1.0, history=2)
    (tmp_path / "s" / "LOCK").write_text("gone")
    import os

    os.utime(tmp_path / "s" / "LOCK", (1, 1))
    for n in range(6):
        with a.lock():
            a.commit(t=spark.range(n), **({"u": spark.range(1)} if n == 0 else {}))
    assert a.table("t", "id long").count() == 5 and a.table("u", "id long").count() == 1
    assert len(list((tmp_path / "s").glob("v-*"))) == 4  # two that are named, two of the past
    a.append("x", spark.range(2))
    a.append("x", spark.range(2))
    assert a.log("x", "id long").count() == 4 and a.log("y", "id long").count() == 0


def test_one_writer(spark, tmp_path):
    a = Snapshots(spark, str(tmp_path / "s"), timeout=0.3, poll=0.1)
    with a.lock(), pytest.raises(LockTimeout), Snapshots(spark, str(tmp_path / "s"), timeout=0.3, poll=0.1).lock():
        pass
    with a.lock():
        a.commit(t=spark.range(3))
    assert a.table("t", "id long").count() == 3


def test_streams(spark, tmp_path):
    schema = "file_path string, version long, content string"
    first = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema)
    first.write.parquet(str(tmp_path / "in"))
    store = Snapshots(spark, str(tmp_path / "store"))

    def go():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_stream(stream, store, "files", spark.createDataFrame([], schema).schema, str(tmp_path / "cp")).awaitTermination()
        return sorted(tuple(r) for r in store.table("files", schema).select("file_path", "version", "content").collect())

    assert go() == [("a", 2, "y"), ("b", 1, "z")]
    spark.createDataFrame([("a", 1, "old"), ("c", 5, "w")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert go() == [("a", 2, "y"), ("b", 1, "z"), ("c", 5, "w")]


def test_savings_by_window(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), m) for m in (1, 5, 12)]
    spark.createDataFrame(rows, "queried_at timestamp, saved int").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("queried_at timestamp, saved int").parquet(str(tmp_path / "log"))
    q = savings_by_window(stream).writeStream.format("memory").queryName("saved_by_window").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["saved"], r["queries"]) for r in spark.table("saved_by_window").collect()) == [(6, 2), (12, 1)]


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("top_k: 7\nembedding:\n  mode: quality\nindexing:\n  extra_ignore: [a, b]\n")
    got = Config.load(f, {"CTS_TOP_K": "9", "CTS_SCORE_THRESHOLD": "0.3"})
    assert (got.top_k, got.embedding_mode, got.extra_ignore, got.score_threshold) == (9, "quality", ("a", "b"), 0.3)
    f.write_text("embedding:\n  provider: sk-123\n")
    with pytest.raises(ConfigError):
        Config.load(f, {})
    with pytest.raises(ConfigError):
        Config.load(None, {"CTS_TOP_K": "x"})
    assert Config.load(tmp_path / "absent.yaml", {}) == Config()


def test_providers(monkeypatch):
    p = embedding.create(Config())
    a, b, c = p.embed_texts(["load user profile", "loadUserProfile", "zebra"])
    assert len(a) == p.dimension == 384 and sum(x * x for x in a) == pytest.approx(1)
    assert sum(x * y for x, y in zip(a, b, strict=True)) > 0.9 > 0.3 > sum(x * y for x, y in zip(a, c, strict=True))
    assert p.embed_query("q") is p.embed_query("q")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ProviderError):
        embedding.create(Config(embedding_provider="openai")).embed_texts(["x"])
    with pytest.raises(ProviderError):
        embedding.create(Config(embedding_provider="none"))
    assert "error" in as_response(ProviderError("x")) and "suggestion" in as_response(ProviderError("x"))


def test_golden_set(spark, repo, tmp_path, monkeypatch):
    from spindrift.operators import evaluation
    from spindrift.plans import golden

    monkeypatch.setenv("CTS_REPO_PATH", str(repo))
    engine = Engine.from_environment(spark, str(tmp_path / "home"))
    found = [{"file": "src/billing.py", "name": "charge", "relevance": 3}]
    one = {"id": "a", "category": "exact_name", "difficulty": "easy", "query": "charge", "expected_results": found, "coverage_dirs": ["src"]}
    each, report, took = golden.run_golden(engine, golden.load_golden({"queries": [one, one | {"id": "b", "query": "validate card"}]}), 5, ("exact",))
    rows = {r["id"]: r for r in each.collect()}
    assert rows["a"]["mrr"] > 0 and rows["a"]["recall"] == 1.0 and rows["a"]["coverage"] == 1.0 and rows["a"]["ter"] > 0
    assert {(r["method"], r["category"], r["difficulty"]) for r in report.collect()} == {("exact", None, None), ("exact", "exact_name", None), ("exact", None, "easy")}
    assert set(took) == {"exact"}
    golden.save_baseline(each, tmp_path / "base", "1")
    golden.save_baseline(each, tmp_path / "base", "2")
    assert (tmp_path / "base" / "archive" / "1.json").exists()
    gate = evaluation.regressions(golden.by_metric(each), golden.load_baseline(spark, tmp_path / "base"))
    assert gate.count() == 7 and gate.filter("failed").count() == 0
    with pytest.raises(EngineError, match="top_k"):
        engine.search_exact("x", top_k="many")
    for bad in ({}, {"queries": [{"id": "a"}]}, {"queries": [one, one]}, {"queries": [one | {"difficulty": "odd"}]}):
        with pytest.raises(ConfigError):
            golden.load_golden(bad)


def test_file_filter(spark, repo, tmp_path, monkeypatch):
    engine = Engine(spark, str(repo), str(tmp_path / "home"))
    engine.reindex()
    files = lambda **given: {r["file_path"] for r in engine.search_exact("billing charge", **given).collect()}
    assert files(file_filter="*.ts") == {"app/billing.ts"} and files(file_filter="tests/") == {"tests/test_billing.py"}
    assert files(file_filter="*.ts", extension="py") == files(extension="py") != set()
    asked = []

    def chunks(extension=None, prefix=None):
        asked.append((extension, prefix))
        raise InterruptedError

    monkeypatch.setattr(engine, "chunks", chunks)
    for search in (engine.search_semantic, engine.search_hybrid):
        for value in (".py", "src/"):
            with pytest.raises(InterruptedError):
                search("charge", file_filter=value)
    assert asked == [(".py", None), (None, "src/")] * 2
