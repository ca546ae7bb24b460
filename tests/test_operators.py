import pytest
from pyspark.sql import functions as F

from spindrift.operators import evaluation, expansion, lookups, ranking, reporting, retrieval

CHUNK = "chunk_id long, file_path string, dir string, name string, chunk_type string, language string, line_start int, norm string, filled int"


def chunk(i, path, name, kind="function", language="python", line=1, norm=None, filled=5):
    return i, path, path.rpartition("/")[0] or ".", name, kind, language, line, norm or name, filled


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        chunk(1, "a/x.py", "alpha"),
        chunk(2, "a/y.py", "beta"),
        chunk(3, "a/z.py", "Gamma", "class"),
        chunk(4, "b/x.ts", "alphaView", language="typescript", norm="alpha_view"),
        chunk(5, "tests/test_x.py", "test_alpha"),
        chunk(6, "a/sub/w.py", "delta", filled=1),
        chunk(7, "b/k.py", "beta", line=9),
    ]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture(scope="module")
def results(spark, chunks):
    scores = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 2, 0.8)], "qid int, pos int, chunk_id long, score double")
    return scores.join(chunks, "chunk_id")


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame([(1, 0, "beta"), (1, 1, "Gamma"), (2, 0, "delta"), (2, 1, "nowhere"), (6, 0, "alpha"), (5, 0, "alpha")], "chunk_id long, at int, callee string")


def test_fusion_numbers(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid int, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 7, 1), (1, 9, 2)], "qid int, chunk_id long, rank int")
    got = {r["chunk_id"]: (r["score"], r["rank"]) for r in retrieval.rank_fusion(a, b, 10, 5).collect()}
    assert got == {7: (0.033333, 1), 8: (0.030478, 2), 9: (0.030478, 3)}


def test_vector_search(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid int, vector array<double>")
    got = [(r["chunk_id"], r["score"], r["rank"]) for r in retrieval.vector_top_k(c, q, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (2, 1.0, 2), (3, 0.0, 3)]
    assert [r["chunk_id"] for r in retrieval.vector_top_k(c, q, 3, F.col("chunk_id") > 1).orderBy("rank").collect()] == [2, 3]
    with pytest.raises(Exception, match="dimensions"):
        retrieval.vector_top_k(c, spark.createDataFrame([(1, [1.0])], "qid int, vector array<double>")).collect()


def test_text_search(spark):
    c = spark.createDataFrame([(1, "billing service", "tests/billing_test.py"), (2, "other words", "src/user.py")], "chunk_id long, content string, path string")
    index = retrieval.postings(c, {"content": F.col("content"), "path": F.col("path")})
    q = spark.createDataFrame([(1, "billing_test"), (2, "zzz"), (3, None), (4, "user words")], "qid int, query string")
    got = {(r["qid"], r["chunk_id"]) for r in retrieval.text_top_k(index, 2, q, 5).collect()}
    assert got == {(1, 1), (4, 2)}
    assert retrieval.text_top_k(index, 2, q, 5, c.filter("chunk_id = 2")).select("qid").collect()[0][0] == 4


def test_text_search_over_nothing(spark):
    c = spark.createDataFrame([], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "x")], "qid int, query string")
    assert retrieval.text_top_k(retrieval.postings(c, {"content": F.col("content")}), 0, q).collect() == []


def test_callees(results, calls, chunks):
    got = expansion.via_calls(results, calls, chunks, 4).orderBy("pos").collect()
    assert [(r["name"], r["score"]) for r in got] == [("Gamma", 0.72), ("delta", 0.64)]
    assert expansion.via_calls(results, calls, chunks, 2).count() == 1


def test_callers(spark, results, calls, chunks):
    index = expansion.callers_index(calls, chunks)
    got = expansion.via_callers(results, index, chunks).orderBy("pos").collect()
    assert [(r["name"], r["score"], r["caller_of"]) for r in got] == [("delta", 0.675, "alpha"), ("test_alpha", 0.675, "alpha")]
    many = spark.createDataFrame([("alpha", f"c{i}", 1) for i in range(50)], "callee string, caller string, times long")
    assert expansion.via_callers(results, many, chunks).collect() == []


def test_siblings(results, chunks):
    got = expansion.siblings(results, chunks).orderBy("pos").collect()
    assert [(r["file_path"], r["score"]) for r in got] == [("a/z.py", 0.63), ("a/sub/w.py", 0.63)]


def test_cross_layer(results, chunks):
    got = expansion.cross_layer(results, chunks).collect()
    assert [(r["name"], r["score"]) for r in got] == [("alphaView", 0.63)]


def test_tests_of_files(results, chunks):
    got = expansion.test_files(results, chunks).collect()
    assert [(r["file_path"], r["score"], r["test_for"]) for r in got] == [("tests/test_x.py", 0.54, "a/x.py")]


def test_rerank(spark):
    rows = [(1, 1, 10, "a/f.py", "a", 2, 0.8), (1, 2, 11, "a/f.py", "a", 9, 0.7), (1, 3, 12, "a/f.py", "a", 9, 0.6), (1, 4, 13, "b/g.py", "b", 9, 0.65)]
    df = spark.createDataFrame(rows, "qid int, pos int, chunk_id long, file_path string, dir string, filled int, score double")
    got = [(r["chunk_id"], r["score"]) for r in ranking.rerank(df).orderBy("rank").collect()]
    assert got == [(11, 0.735), (13, 0.65), (12, 0.63)]


def test_boost_and_type_order(spark):
    df = spark.createDataFrame([(1, 1, "method", 0.9), (1, 2, "class", 0.6), (1, 3, "x", 0.5)], "qid int, rank int, chunk_type string, score double")
    assert sorted(r["score"] for r in ranking.boosted(df).collect()) == [0.5, 0.69, 0.855]
    assert [r["chunk_type"] for r in ranking.by_type(df).orderBy("rank").collect()] == ["class", "method", "x"]


def test_diff_and_staleness(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "file_path string, file_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file_path string, file_hash string")
    assert {tuple(r) for r in reporting.reindex_diff(old, new).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "new")}
    assert {tuple(r) for r in lookups.staleness(old, new).collect()} == {("a", False), ("b", True), ("d", True)}


def test_audit(spark):
    s = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "qid int, file_path string, name string")
    e = spark.createDataFrame([(1, "b", "y"), (1, "c", "z")], "qid int, file_path string, name string")
    assert {(r["name"], r["category"]) for r in reporting.audit(s, e).collect()} == {("x", "semantic_only"), ("y", "both"), ("z", "exact_only")}


def test_savings(spark):
    r = spark.createDataFrame([(1, "a", "12345678"), (1, "a", "1234"), (1, "b", "")], "qid int, file_path string, payload string")
    f = spark.createDataFrame([("a", 101)], "file_path string, size_bytes long")
    assert tuple(reporting.savings(r, f).first()) == (1, 26, 5, 21, 80.8)
    assert tuple(reporting.cumulative(spark.createDataFrame([], "saved long, queried_at timestamp")).first()) == (0, 0, None)


def test_coverage(spark, chunks):
    r = spark.createDataFrame([(1, "python", 0.9), (1, "typescript", 0.8), (2, "python", 0.1)], "qid int, language string, score double")
    q = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a")], "qid int, query string")
    got = {x["qid"]: (x["missing"], x["confidence"], x["suggest"]) for x in reporting.coverage(r, chunks, q).collect()}
    assert got == {1: ("", "high", False), 2: ("typescript", "partial", True), 3: ("python,typescript", "low", False)}


def test_lookups(chunks):
    assert lookups.by_name(chunks, "beta").first()["chunk_id"] == 2
    assert [r["chunk_id"] for r in lookups.by_directory(chunks, "a").collect()] == [6, 1, 2, 3]
    assert lookups.by_directory(chunks, ".").count() == 0


def test_calls_from_json(spark):
    df = spark.createDataFrame([('["a","b"]',), ("oops",), (None,)], "calls_json string")
    assert [r[0] for r in df.select(lookups.calls_from_json()).collect()] == [["a", "b"], [], []]


def test_measures(spark):
    r = spark.createDataFrame([(1, "m", 1, "x"), (1, "m", 2, "y"), (1, "m", 3, "z")], "qid int, method string, rank int, item string")
    e = spark.createDataFrame([(1, "y", 3), (1, "z", 1), (1, "w", 2)], "qid int, item string, grade int")
    got = evaluation.measures(r, e, 3).first()
    assert (got["precision"], got["recall"], got["f1"], got["mrr"]) == (0.3333, 0.5, 0.4, 0.5)
    assert got["ndcg"] == pytest.approx((7 / 1.58496 + 1 / 2) / (7 + 3 / 1.58496 + 1 / 2), abs=1e-4)
    need = spark.createDataFrame([(1, "src"), (1, "lib")], "qid int, directory string")
    paths = spark.createDataFrame([(1, "m", "src/a"), (2, "m", "x")], "qid int, method string, file_path string")
    assert {(x["qid"], x["coverage"]) for x in evaluation.directory_coverage(paths, need).collect()} == {(1, 0.5), (2, 1.0)}
    sent = spark.createDataFrame([(1, "m", 4000)], "qid int, method string, characters long")
    assert evaluation.token_efficiency(evaluation.measures(r, e, 3), sent).first()["ter"] == 2.0


def test_gates(spark):
    now = spark.createDataFrame([("m", "f1", 0.4), ("m", "precision", 0.72)], "method string, metric string, value double")
    base = spark.createDataFrame([("m", "f1", 0.5), ("m", "precision", 0.74)], "method string, metric string, value double")
    assert {(r["metric"], r["failed"]) for r in evaluation.regressions(now, base).collect()} == {("f1", True), ("precision", False)}
    assert {(r["metric"], r["passed"]) for r in evaluation.meets_floors(now).collect()} == {("f1", False), ("precision", True)}
