from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.functions.words import STOP_EN, STOP_PT, TERMS


def values(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_stop_words(spark):
    got = values(spark, text.filter_stop_words, ["the a of in on", "how does the getUserName of it work", "the a of in on at", "find my_func in the big file", "", None])
    assert got == ["the a of in on", "getUserName work", "the a of in on at", "find my_func big file", "", None]


def test_technical_query(spark):
    got = values(spark, text.technical_query, ["Onde fica o cache, e o login?", "nothing here", "cache cachear", None])
    assert got == ["cache memoize redis ttl invalidate login auth authenticate session credential", None, "cache memoize redis ttl invalidate store", None]


def test_word_lists():
    assert len(set(STOP_PT)) == 70 or len(STOP_PT) == 72
    assert len(TERMS) == 67 and len(STOP_EN) == len(set(STOP_EN))
    assert len({t for v in TERMS.values() for t in v}) == 139


def test_names(spark):
    got = values(spark, text.normalized_name, ["BillingGuardService", "HTTPServer", "user-profile", "Service", "billingController", "x_state"])
    assert got == ["billing_guard", "http_server", "user_profile", "service", "billing", "x"]
    assert values(spark, text.pascal_name, ["billing_guard"]) == ["BillingGuard"]


def test_paths(spark):
    assert values(spark, text.language_of, ["a/b.PY", "x.tsx", "y.rb", ".py", "a.b/c"]) == ["python", "typescript", None, None, None]
    assert values(spark, text.stem_of, ["src/Test_A.py", "b.spec.ts", "x"]) == ["test_a", "b.spec", "x"]
    assert values(spark, text.directory_of, ["a/b/c.py", "c.py"]) == ["a/b", "."]
    assert text.file_filter("*.py") == (".py", None) and text.file_filter("src/") == (None, "src/") and text.file_filter(".ts", "js") == ("js", None)


def test_lines(spark):
    assert values(spark, lambda c: text.first_lines(c, 2), ["a\nb", "a\nb\nc\nd"]) == ["a\nb", "a\nb\n... (2 more lines)"]
    assert values(spark, text.filled_lines, ["a\n \n\nb", ""]) == [2, 0]


def test_prefix_is_literal(spark):
    df = spark.createDataFrame([("src/a_b/x.py",), ("src/aXb/x.py",)], "p string")
    assert [r[0] for r in df.filter(text.path_filter(F.col("p"), "py", "src/a_b/")).collect()] == ["src/a_b/x.py"]
