import re
from collections import Counter

from spindrift import catalog
from spindrift.sources.tables import calls


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_calls_of_whole_texts(spark, tmp_path):
    texts = ["Alpha " + " ".join(f"w{i % 30}" for i in range(90)) + " tail, TAIL", "beta w29 alpha x", "alpha tail", "one", "...", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    stored(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in enumerate(texts)}
    edges = {i: list(dict.fromkeys(w[1:])) for i, w in words.items()}
    got = {(r["chunk_id"], r["at"], r["callee"]) for r in calls(spark, str(tmp_path)).collect()}
    assert got == {(i, at, c) for i, cs in edges.items() for at, c in enumerate(cs)}
    want = Counter((c, words[i][0]) for i, cs in edges.items() for c in cs)
    found = {(r["callee"], r["caller"]): r["times"] for r in catalog.queries()["callers_index"](spark, str(tmp_path)).collect()}
    assert found == want and found["tail", "alpha"] == 2


def test_every_label_is_asked(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) + 4 * (j == i % 3) for j in range(8)], 1 + i % 3) for i in range(300)]  # no label 0
    stored(spark, tmp_path, "embeddings", rows, "vec_id long, embedding array<float>, label int")
    q = catalog.queries()
    found = q["vector_topk"](spark, str(tmp_path)).collect()
    assert {r["qid"] for r in found} == set(range(0, 300, 100)) and len(found) == 15
    quality = {r["qid"]: r for r in q["retrieval_quality"](spark, str(tmp_path)).collect()}
    assert set(quality) == set(range(0, 300, 100)) and all(0 < r["precision"] <= 0.9 for r in quality.values())  # the vector itself is none of its mates
