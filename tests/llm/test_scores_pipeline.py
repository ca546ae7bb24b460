import os
import random

import numpy as np
import pytest

from spindrift.llm import quality, toxicity
from spindrift.llm.common import held_out

os.environ["TOKENIZERS_PARALLELISM"] = "false"


def labelled(spark, n=600):
    rng = random.Random(2)
    words = [a + b + c for a in ("ka", "lo", "mi", "su") for b in ("ra", "te", "no", "vi") for c in ("da", "pe", "xu")]
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 4 == 0, i % 3 == 0
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["gromble", "Gr0mble", "snarfed", "ѕnarfy"]))
        text = " ".join(w + rng.choice("#$%") * 3 for w in text) if bad else " ".join(text)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, module, label):
    docs, labels = labelled(spark)
    got = module.score(docs, module.learn(docs, labels), 0.5).join(labels, "doc_id").withColumn("held", held_out()).filter("held").toPandas()
    assert len(got) > 60 and (got["predicted"] == got[label]).mean() > 0.95 and got["score"].between(0, 1).all()


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_labels_of_held_out_rows_are_not_seen(spark, module, label):
    docs, labels = labelled(spark, 200)
    from pyspark.sql import functions as F

    turned = labels.withColumn(label, F.when(held_out(), 1 - F.col(label)).otherwise(F.col(label)))
    a, b = module.learn(docs, labels), module.learn(docs, turned)
    assert a == b if module is toxicity else np.array_equal(a.weights, b.weights)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_inputs(spark, docs, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.learn(docs("a"), none)
    rows = module.score(docs("", None, "x " * 100_000, "x", "x", ids=[1, 2, 3, 4, 4]), model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(docs(), model).collect() == []
    odd = spark.createDataFrame([(0, None, None), (None, 1, 1), (0, 7, 7), (0, 1, 0), (0, 0, 1)], "doc_id long, quality int, toxic int")
    module.learn(docs("a", None), odd)


def test_folding():
    assert toxicity.folded("ІDІ0T 1d10t tr@sh STÚPID i​diot ｉｄｉｏｔ") == "idiot idiot trash stupid idiot idiot"


def test_longest_entry_and_phrases_decide():
    built = toxicity.automaton(((" trash", 3.0), (" trashcan ", 0.0)), frozenset([" paper trash "]))
    weigh = lambda t: toxicity.measures(t, built)[0]
    assert (weigh("TRASH talk"), weigh("a trashcan"), weigh("paper trash!"), weigh("ultrash"), weigh("trash trashy")) == (3.0, 0.0, 0.0, 0.0, 6.0)


def test_bucket_hashes_do_not_depend_on_the_batch():
    a, b = quality.buckets_of("some words here"), quality.buckets_of("some words here")
    assert (a == b).all() and a.min() >= 0 and a.max() < quality.BUCKETS
    assert set(quality.buckets_of("alpha beta")[:2]) == set(quality.buckets_of("beta alpha")[:2])
    assert quality.buckets_of("ab")[0] != quality.buckets_of("ba")[0]


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p
    from spindrift.llm import mixing, neardup, pii
    from spindrift.llm.common import load, written

    columns = list(p.COLUMNS)
    docs = load(spark, sf_dir, "documents").selectExpr("*", "doc_id as kept", "lang as spans")
    first = written(p.drop_toxic(spark, docs, sf_dir))
    model = toxicity.learn(docs, load(spark, sf_dir, "labels"))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == clean
    second = written(p.drop_near_duplicates(spark, first, sf_dir))
    kept = {r["doc_id"] for r in neardup.link(first).filter("kept").collect()}
    assert second.columns == columns and sorted(r["doc_id"] for r in second.collect()) == sorted(kept)
    third = written(p.mask_personal_data(spark, second, sf_dir))
    assert third.columns == columns and third.count() == second.count()
    assert pii.find_spans(third).filter("exists(spans, s -> s.kind = 'email')").count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in third.collect())
    fourth = written(p.mix_sources(spark, third, sf_dir))
    assert fourth.columns == columns
    assert {r["doc_id"] for r in fourth.collect()} == {r["doc_id"] for r in mixing.mix(third, rate=p.RATE, alpha=p.ALPHA).filter("mix_kept").collect()}
    from tokenizers import Tokenizer
    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: [*lib.encode(r["text"], add_special_tokens=False).ids, 2] for r in fourth.collect()}
    got: dict = {}
    for r in sorted(p.run(spark, sf_dir).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == want


def test_pipeline_with_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline as p

    df = docs(None, "", "a b c d e f", "a b c d e f", "mail a@b.co " * 3000, ids=[1, 2, 3, 3, 4])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()}
    assert got <= {1, 2, 3, 4}
    df.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []


def test_registered_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
