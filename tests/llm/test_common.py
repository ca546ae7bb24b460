import pyarrow as pa
from pyspark.sql import functions as F

from spindrift.llm import common, neardup


def test_word_memory_keeps_what_comes_twice():
    m, made = common.WordMemory(8), []

    def values(words):
        made.extend(words)
        return [w * 2 for w in words]

    m.begin()
    m.learn({"a", "b"}, values)
    assert m["a"] == "aa" and "a" not in m and m.get("a") is None
    m.begin()
    m.learn({"a", "c"}, values)
    assert "a" in m and sorted(made) == ["a", "a", "b", "c"] and m["c"] == "cc"
    m.begin()
    m.learn({"a", "b"}, values)
    assert m.fresh == {} and m["a"] == "aa" and m["b"] == "bb" and made.count("a") == 2
    m.update({str(i): i for i in range(9)})
    m.begin()
    assert "a" not in m and len(m) <= 8


def test_slices_follow_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 50)], names=["t"])
    parts = list(common.slices(batch, 5000))
    assert sum(p.num_rows for p in parts) == 50 and max(p.num_rows for p in parts) <= 5
    assert [p.num_rows for p in common.slices(batch, 1)] == [1] * 50


def test_portions_join_and_cut():
    batch = lambda n: pa.RecordBatch.from_arrays([pa.array(["x" * 100] * n)], names=["t"])
    parts = list(common.portions([batch(3), batch(0), batch(4), batch(50), batch(1)], 1100))
    assert sum(p.num_rows for p in parts) == 58 and max(p.num_rows for p in parts) <= 11 and len(parts) <= 8
    assert list(common.portions([])) == [] and [p.num_rows for p in common.portions([batch(2)], 1)] == [1, 1]


def test_sieve_keeps_every_id(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIEVE", 1 << 12)
    rows, ids = spark.range(20_000).withColumn("v", F.lit("x")), spark.range(0, 20_000, 100)
    kept = {r["id"] for r in neardup.sieved(rows, "id", ids).collect()}
    assert {r["id"] for r in ids.collect()} <= kept and len(kept) < 2500
    assert neardup.sieved(rows, "id", ids.limit(0)).count() == 0 and neardup.sieved(rows, "id", ids).columns == ["id", "v"]


def test_held_out_is_crc32_of_the_text(spark):
    import zlib

    got = spark.range(50).withColumnRenamed("id", "doc_id").withColumn("h", common.held_out()).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_written_tables_can_be_dropped(spark):
    df = common.written(spark.range(5))
    assert df.count() == 5


def test_small_batches_leave_a_set_number_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name) if name in spark.conf.getAll else None
    try:
        spark.conf.unset(name)
        common.small_batches(spark)
        assert spark.conf.get(name) == str(common.BATCH)
        spark.conf.set(name, 77)
        common.small_batches(spark)
        assert spark.conf.get(name) == "77"
    finally:
        spark.conf.unset(name)
        if was:
            spark.conf.set(name, was)
    common.let_go()
