import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.llm import mixing, pii

KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_base_spans_against_brute_force(spark, docs):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab@.-+ 0123456789()_é😀\n") for _ in range(90)) for _ in range(3000)]
    texts += ["1.2.3.4.5.6.7.8 999.1.2.3.4.5.6.7", "a@b.c_d@e.f", "4539148803436467", "1.1.1.0255", "x" * 50_000 + "@a.b", "9" * 60_000, "+" * 5000, "", None]
    for r in pii.digest(pii.find_spans(docs(*texts))).collect():
        want = brute(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(want.count(k + ":") for k, _ in KINDS)
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_added_kinds_and_context(docs):
    texts = ["pay to DE89370400440532013000", "pay to DE89370400440532013001", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "no 123-45-6789", 'token = "' + "a1" * 20 + '"', "commit " + "a1" * 20]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_spans(docs(*texts)).collect()}
    assert [("iban" in got[i]) for i in range(3)] == [True, False, True]
    assert ("ssn" in got[3], "ssn" in got[4], got[5], got[6]) == (True, False, ["secret"], [])
    scores = {r["doc_id"]: r["spans"][0]["score"] for r in pii.find_spans(docs("call +1 (555) 123-4567", "see +1 (555) 123-4567")).collect()}
    assert scores[0] > scores[1]


def test_redaction(docs):
    got = {r["doc_id"]: (r["text"], r["n_spans"]) for r in pii.redact(docs("mail é a@b.co, 10.0.0.1@x.y!", None, "clean")).collect()}
    assert got == {0: ("mail é [EMAIL], [EMAIL]!", 3), 1: ("", 0), 2: ("clean", 0)}
    assert pii.redact(docs()).collect() == []


def test_texts_of_very_many_spans(docs):
    """Time follows the number of spans: a megabyte of them takes seconds, and is masked as a short text is."""
    import time

    unit = "ip 10.0.0.1 a@b.co +1 (555) 123-4567\n"
    took = []
    for n in (50, 27_000):
        began = time.time()
        found = pii.digest(pii.find_spans(docs(unit * n))).collect()[0]
        assert (found["n_ip"], found["n_email"], found["n_phone"]) == (n, n, n)
        assert pii.redact(docs(unit * n)).collect()[0]["text"] == "ip [IP] [EMAIL] [PHONE]\n" * n
        took.append(time.time() - began)
    assert took[1] < 60


def test_pieces_against_slices(docs):
    """Context windows and masked texts whose places lie around the ends of pieces, beyond the basic plane as well."""
    rng = random.Random(8)
    texts = []
    for _ in range(300):
        fill = "".join(rng.choice("ab 😀é\n") for _ in range(rng.randint(0, 700)))
        texts.append(fill + rng.choice(["card ", "", "tel "]) + "4539148803436467" + rng.choice([" card", "", "x" * 300]) + " a@b.co,10.0.0.1@x.y")
    rows = {r["doc_id"]: r for r in pii.find_spans(docs(*texts)).collect()}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs(*texts)).collect()}
    for i, t in enumerate(texts):
        out, past = [], 0
        for s in rows[i]["spans"]:
            if s["kind"] == "card":
                around = (t[max(0, s["start"] - 40) : s["start"]] + "\n" + t[s["end"] : s["end"] + 40]).lower()
                assert (s["score"] > 0.8) == bool(re.search("(?:^|[^a-z])(?:card|visa|credit|debit|payment)", around))
            if s["start"] >= past:
                out += [t[past : s["start"]], f"[{s['kind'].upper()}]"]
            past = max(past, s["end"])
        assert masked[i] == "".join(out) + t[past:]


def test_no_python_in_the_plans(spark, docs):
    for df in (pii.digest(pii.find_spans(docs("a"))), pii.redact(docs("a")), mixing.mix(docs("a b"))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def rows_of(spark, n=400):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60) + ("| x | y" if i % 5 == 0 else ""), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a"] * 6 + ["b", "c"]), 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_rake_against_numpy(spark):
    import numpy as np

    cells = mixing.rake(mixing.weighed(rows_of(spark)), alpha=0.5).toPandas()
    dims = [f"mix_{d}" for d in mixing.DIMENSIONS]
    w = cells["w0"].to_numpy()
    for _ in range(300):
        for d in dims:
            keys = cells[d].to_numpy()
            share = cells.groupby(d)["w0"].sum() ** 0.5
            target = share / share.sum()
            now = cells.assign(w=w).groupby(d)["w"].sum()
            w = w * np.array([target[k] / now[k] for k in keys])
    assert np.allclose(cells["w"], w, atol=1e-5)
    for d in dims:
        assert np.allclose(cells.groupby(d)["w"].sum(), cells.groupby(d)[f"t_{d[4:]}"].first(), atol=1e-5)


def test_budget_and_draws(spark):
    df = rows_of(spark)
    for rate in (0.05, 0.5, 0.95, 1.0):
        got = mixing.mix(df, rate=rate).toPandas()
        assert (got["mix_tokens"] * got["mix_probability"]).sum() == pytest.approx(rate * got["mix_tokens"].sum(), rel=1e-6)
        assert got["mix_probability"].between(0, 1).all()
    again = mixing.mix(df.repartition(7), rate=0.5).select("doc_id", "mix_kept")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.mix(df, rate=0.5).select("doc_id", "mix_kept").collect()))


def test_stated_targets(spark):
    got = mixing.mix(rows_of(spark), rate=0.2, targets={"lang": {"en": 1, "de": 1}}).toPandas()
    by = (got["mix_tokens"] * got["mix_weight"]).groupby(got["mix_lang"]).sum()
    assert by["en"] == pytest.approx(by["de"], rel=1e-4) and by[""] == 0


def test_odd_rows(docs):
    got = mixing.mix(docs("", None, "a b", "a b", ids=[1, 2, 3, 3])).collect()
    assert sorted(r["mix_tokens"] for r in got) == [0, 0, 2, 2] and len({r["mix_kept"] for r in got if r["doc_id"] == 3}) == 1
    assert mixing.mix(docs()).collect() == []
    assert mixing.mix(docs(None)).select(F.col("mix_probability")).first()[0] == 0.5


def test_ibans_among_other_words(docs):
    be, de, gb = "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    texts = [be, f"{be} OK", f"{be} 2024", f"{be} 2024x", f"{be} ACCOUNT 12", f"{be} {de}", f"é {de} {be} {gb}", f"AB12 CDEF 1234 5678 {be}", f"{de} OK DE89370400440532013000 A", "BE68 5390 0754 7035 OK"]
    want = [[be], [be], [be], [be], [be], [be, de], [de, be, gb], [be], [de, "DE89370400440532013000"], []]
    got = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] for r in pii.find_spans(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert pii.redact(docs(f"to {be} OK")).first()["text"] == "to [IBAN] OK"


def test_raking_goes_on_until_targets_hold(spark, caplog):
    import numpy as np

    # each source in two languages, in a ring, heavy-tailed: 24 sweeps leave 1.6e-4
    r = np.random.default_rng(21)
    n = int(r.integers(3, 8))
    cells = [(i, k) for i in range(n) for k in (i, (i + 1) % n)]
    tokens = np.maximum(1, (300 * r.random(len(cells)) ** 6).astype(int))
    true = tokens * np.exp(r.normal(0, 1.6, len(cells)))  # targets that these weights meet
    rows = [(j, "w " * int(t), f"l{k}", f"s{i}", 1) for j, ((i, k), t) in enumerate(zip(cells, tokens))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    targets = {"source": {}, "lang": {}}
    for (i, k), w in zip(cells, true):
        targets["source"][f"s{i}"] = targets["source"].get(f"s{i}", 0) + float(w)
        targets["lang"][f"l{k}"] = targets["lang"].get(f"l{k}", 0) + float(w)
    got = mixing.rake(mixing.weighed(docs), targets).toPandas()
    for d in ("source", "lang"):
        by = got.groupby(f"mix_{d}")
        assert (by["w"].sum() - by[f"t_{d}"].first()).abs().max() < 1e-6
    assert not caplog.records
    # one source has one language alone, and their targets contradict
    docs = spark.createDataFrame([(0, "w " * 9, "x", "a", 1), (1, "w w w", "y", "b", 1)], docs.schema)
    got = mixing.rake(mixing.weighed(docs), {"source": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}}).toPandas()
    assert got["w"].sum() == pytest.approx(1) and "off its target" in caplog.text


def test_context_behind_a_span(docs):
    key = "a1" * 20
    texts = ["123-45-6789 (SSN)", f"é {key} is my api key", f"{key} {'x' * 35} token", f"{key} {'x' * 33} token", "123-45-6789 assn", "123-45-6789"]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find_spans(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [["ssn"], ["secret"], [], ["secret"], [], []]
    assert pii.redact(docs(texts[0])).first()["text"] == "[SSN] (SSN)"
