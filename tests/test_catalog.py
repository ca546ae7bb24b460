import duckdb
import pytest

from spindrift import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v)[:26] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_matches_its_oracle(spark, con, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_the_same_under_any_partitioning(spark, sf_dir):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = set()
        for n in ("1", "4", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.add(str(sorted(map(tuple, catalog.hybrid(spark, sf_dir).collect()))))
        assert len(seen) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) <= set(e.queries())
