import random

import numpy as np
import pytest

import corpus_pipeline
from spindrift.llm import graph, neardup
from spindrift.llm.graph import components, merged
from spindrift.shared import written


def exact(texts):
    """Components over all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    word = lambda: rng.choice(vocabulary)
    texts = ["", None, " \n", "One two", "one TWO", "one two three", "é x y z q", "É x y z q"]
    for size in (5, 6, 8, 12, 40, 200, 1500):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for rate in (0.005, 0.02, 0.05, 0.08):
                copy = [word() if rng.random() < rate else x for x in base]
                texts += [" ".join(copy), " ".join(copy[1:])]
    shared = [word() for _ in range(60)]
    for _ in range(25):  # a passage that many share, around the threshold and below
        texts.append(" ".join([word() for _ in range(rng.choice((5, 12, 30, 60)))] + shared))
    chain = [word() for _ in range(80)]
    for _ in range(20):  # neighbours are alike, ends are not
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return texts


def test_against_all_pairs(docs):
    texts = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == exact(texts)


@pytest.mark.parametrize(("block", "crowd"), [(3, 2), (4096, 2000)])
def test_blocks_change_nothing(docs, monkeypatch, block, crowd):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CROWD", crowd)
    texts = corpus()
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in exact(texts)]


def test_odd_rows(docs, spark):
    df = docs("a b c d e f", "a b c d e f", "a b c d e f", None, None, ids=[5, 5, 7, 9, 9])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.link(df).collect())
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (9, 0, 9, True), (9, 0, 9, True)]
    assert neardup.link(docs()).collect() == []
    shared = docs("a b c d e f", "g h i j k l", "g h i j k l", "a b c d e f", ids=[5, 5, 7, 9])
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.link(shared).collect()) == [(5, 5), (5, 5), (7, 5), (9, 5)]
    lone = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.link(lone).collect()) == [(0, 0, True), (3, 3, True)]


def test_estimates():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.75, 0.9):
        off = []
        for _ in range(60):
            n = 3000
            both = rng.integers(0, 2**64, int(n * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, (n - len(both)) // 2, dtype=np.uint64)])) for _ in range(2))
            value, least = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            off.append(value[0] - true)
        assert abs(np.mean(off)) < 0.02 and least[0] < 0.75


def test_registers_of_small_sets_fill_up():
    regs = neardup.registers(np.unique(neardup.mixed(np.arange(1, 4, dtype=np.uint64))))
    assert 1 <= (regs != 0).sum() <= 3 and (neardup.filled(regs) != 0).all() and len(neardup.band_keys(regs)) == neardup.BANDS
    assert (neardup.filled(np.zeros(neardup.REGISTERS, np.uint16)) == 0).all()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(30)], [(9, i) for i in range(9)] + [(20, 21), (21, 9)], [(3, 3)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in nodes} == root


def test_hubs_alone_are_dealt(spark, monkeypatch):
    """What the dealing of edges makes follows the nodes: it made eight rows a node."""
    monkeypatch.setattr(graph, "HUB", 20)
    made = []
    whole = graph._with

    def counted(edges, least, hubs, how="inner"):
        got = whole(edges, least, hubs, how)
        plain = edges.join(least.select("u", "m"), "u", how)
        assert sorted(map(str, got.select("u", "v", "m").collect())) == sorted(map(str, plain.select("u", "v", "m").collect()))
        made.append((graph._dealt(least, hubs).count(), least.count(), hubs.count()))
        return got

    monkeypatch.setattr(graph, "_with", counted)
    star = [(1, i) for i in range(2, 200)] + [(0, 1)]
    edges = star + [(i, i + 1) for i in range(1000, 1400, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {i + 1: i for i in range(1000, 1400, 2)}
    assert made and all(rows <= nodes + 2 * len(edges) / 20 for rows, nodes, _ in made) and all(n == 1 for *_, n in made[:1])


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already are done: they took a round."""
    tables = []
    monkeypatch.setattr(graph, "written", lambda df: tables.append(1) or written(df))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame([(3, i) for i in range(4, 40)] + [(50, 51)], "a long, b long")).collect()}
    assert got == {i: 3 for i in range(4, 40)} | {51: 50} and len(tables) == 2


@pytest.mark.parametrize("hub", [2, 1000])
def test_merged_equals_all_edges(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(hub)
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    first = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, i) for i in range(401, 420)]
    for more in ([(7, 7)], [(rng.randrange(600), rng.randrange(600)) for _ in range(60)] + [(5, 410), (5, 700), (411, 412)]):
        known = components(frame(first))
        got = sorted(tuple(r) for r in merged(known, frame(more)).select("node", "component").collect())
        assert got == sorted(tuple(r) for r in components(frame(first + more)).select("node", "component").collect())


def test_later_links_alone_are_closed(docs, monkeypatch):
    """Passes after the first hand on what they found: they handed all links on, each pass again."""
    handed = []
    monkeypatch.setattr(neardup, "components", lambda links: handed.append(links.count()) or components(links))
    monkeypatch.setattr(neardup, "merged", lambda labels, links: handed.append(links.count()) or merged(labels, links), raising=False)
    rng, texts = random.Random(4), []
    for f in range(8):  # copies about as like each other as the threshold, so that many don't link with the head
        base = [f"f{f}w{i}" for i in range(200)]
        texts += [" ".join(f"x{rng.random()}" if rng.random() < 0.024 else w for w in base) for _ in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in exact(texts)]
    assert len(handed) > 1 and sum(handed[1:]) < handed[0]


def test_pipeline_stage_deals_a_row_a_node(docs, spark, monkeypatch):
    """The pipeline's stage makes, over all rounds and passes, fewer rows for dealing than one round used to (eight a node)."""
    made = []
    whole = graph._dealt
    monkeypatch.setattr(graph, "_dealt", lambda least, hubs: made.append(whole(least, hubs).count()) or whole(least, hubs))
    rng, texts = random.Random(4), []
    for f in range(8):
        base = [f"f{f}w{i}" for i in range(200)]
        texts += [" ".join(f"x{rng.random()}" if rng.random() < 0.024 else w for w in base) for _ in range(30)]
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs(*texts), "").select("doc_id").collect())
    assert got == sorted({c for _, c in exact(texts)})
    assert made and sum(made) < 8 * len(texts)
