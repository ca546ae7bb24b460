import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import ann


def brute(ids, x, every, k):
    out = {}
    for i in ids[ids % every == 0]:
        score = x @ x[ids == i][0]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(ids[j], score[j]) for j in order]
    return out


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_recall_and_scores(spark, monkeypatch, shift):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERIES", 16)
    monkeypatch.setattr(ann, "PAGE", 5)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 32)) * rng.uniform(0.5, 2, (1500, 1)) + shift
    ids = np.arange(1500) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    want, got = brute(ids, x, 20, 20), {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * 20 * len(want)
    assert all(s == pytest.approx(dict(want[q]).get(i, s)) for q in want for i, s in got[q])


def frame(x, ids=None):
    import pandas as pd

    return pd.DataFrame({"row": np.arange(len(x)), "vec_id": np.arange(len(x)) if ids is None else ids, "vector": list(x)})


def test_codes_bound_the_products():
    """Estimates out of counted bits lie around the products, within the bounds as often as their width says."""
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((2000, 100)), rng.standard_normal((20, 100))
    own = ann.encode(frame(x))
    view = lambda n, kind=np.float64: np.frombuffer(own[n], kind)
    x = view("vectors").reshape(-1, 100)
    codes = view("codes", np.uint8).reshape(len(x), -1)
    rounded = ann.Rounded(q)
    counts = rounded.counts(slice(0, 20), codes.view(np.uint64))
    bits = np.unpackbits(codes, axis=1)[:, :100].astype(float)
    level = np.rint(((q @ ann.rotation(100)) - rounded.low[:, None]) / rounded.step[:, None])
    assert (counts == level @ bits.T).all() and (view("positive", np.int32) == bits.sum(1)).all()
    product = 2 * (rounded.low[:, None] * view("positive", np.int32) + rounded.step[:, None] * counts) - rounded.sum[:, None]
    off = (q @ view("mean"))[:, None] + product * view("scales") - q @ x.T
    bound = ann.WIDTH * np.sqrt((rounded.norm**2)[:, None] * view("errors") ** 2 + 4 * (rounded.error**2)[:, None] * view("scales") ** 2)
    assert (np.abs(off) <= bound).mean() > 0.98 and abs(off.mean()) < 0.2


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_recall_of_cells(spark, spread):
    """Clustered and uniform vectors of unit length, in cells: recall of at least 0.95, and of the clustered ones most blocks aren't visited."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 20_000)] + spread * rng.standard_normal((20_000, 64)) if spread < 1 else rng.standard_normal((20_000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 200 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute(np.arange(len(x)), x.astype(float), 200, 20)
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [3.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (9, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") == 0, k=3).collect())
    assert got == sorted([(1, 0, 3.0), (2, 7, 2.0), (3, 7, 2.0), (1, 7, 6.0), (2, 7, 6.0), (3, 0, 3.0)])


def test_components_near_the_largest_number(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e300, 1.0]), (2, [1.7e308, -1e308]), (3, [0.5, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 1.7e308), (1, 1e300), (3, 0.5)]


def test_few_candidates_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (2, [2.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): (2, 2.0), (0, 2): (2, 2.0), (0, 3): (1, 1.0), (0, 4): (20, 1.0), (20, 1): (2, 2.0), (20, 2): (2, 2.0), (20, 3): (0, 1.0), (20, 4): (1, 1.0)}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [0.6, 0.8, 0.0, 0.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 40).orderBy("rank").collect()]
    assert got == list(range(20))
