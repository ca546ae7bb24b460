"""Ranked retrieval for batches of queries: vectors by cosine, texts by BM25."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms

#: Query vectors that go to every task at once; more go in several passes over the chunks.
QUERY_BLOCK = 4096
K1, B = 1.2, 0.75
#: Postings that one task scores, about, queries that it scores them for, and chunks whose scores it holds at once.
POSTING_BLOCK, ASKED_BLOCK, SCORED = 2_000_000, 1024, 2048


def ranked(df: DataFrame, by: list, k: int | None = None, key: str = "qid", rank: str = "rank") -> DataFrame:
    """Number rows within a query from 1 and keep k."""
    df = df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*by)))
    return df if k is None else df.filter(F.col(rank) <= k)


def vector_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, digits: int = 4) -> DataFrame:
    """qid, chunk_id, score, rank: the k chunks nearest to each query vector by cosine.

    chunks: chunk_id, embedding; queries: qid, vector.  where filters chunks before they are ranked.  A query
    block of bounded size is sent to all tasks; each keeps k a query in one product of
    matrices, so only tasks * queries * k rows are shuffled.  Null and zero vectors match nothing; a vector of another
    dimension than the query's raises ValueError.
    """
    chunks = (chunks if where is None else chunks.filter(where)).select("chunk_id", "embedding")
    id_type = dict(chunks.dtypes)["chunk_id"]
    total, found = queries.count(), None
    numbered = queries if total <= QUERY_BLOCK else queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(-(-total // (QUERY_BLOCK // 2)))))
    blocks = [numbered] if total <= QUERY_BLOCK else [numbered.filter(F.col("_block") == n) for n in range(-(-total // (QUERY_BLOCK // 2)))]
    for block in blocks:
        rows = [(r["qid"], r["vector"]) for r in block.select("qid", "vector").orderBy("qid").collect() if r["vector"]]
        part = _scan(chunks, [q for q, _ in rows], np.array([v for _, v in rows], float), k, digits, id_type, dict(queries.dtypes)["qid"])
        found = part if found is None else found.unionByName(part)
    return ranked(found, [F.col("score").desc(), "chunk_id"], k)


def _scan(chunks: DataFrame, qids: list, vectors: np.ndarray, k: int, digits: int, id_type: str, qid_type: str) -> DataFrame:
    norms = np.linalg.norm(vectors, axis=1) if len(qids) else np.zeros(0)
    sent = chunks.sparkSession.sparkContext.broadcast((qids, vectors / np.where(norms > 0, norms, np.nan)[:, None] if len(qids) else vectors))

    def run(batches):
        qids, q = sent.value
        for pdf in batches:
            pdf = pdf[pdf["embedding"].notna()]
            if not len(pdf) or not len(qids):
                continue
            x = np.stack(pdf["embedding"].to_numpy()).astype(float)
            if x.shape[1] != q.shape[1]:
                raise ValueError(f"a query has {q.shape[1]} dimensions, the chunks have {x.shape[1]}")
            size = np.linalg.norm(x, axis=1)
            score = np.round(q @ (x / np.where(size > 0, size, np.nan)[:, None]).T, 12)
            score = np.floor(np.abs(score) * 10**digits + 0.5) / 10**digits * np.sign(score)
            score = np.where(np.isnan(score), -np.inf, score)
            ids = pdf["chunk_id"].to_numpy()
            n = min(k, len(ids))
            floor = -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
            r, c = np.nonzero((score >= floor) & np.isfinite(score))
            out = pd.DataFrame({"qid": np.array(qids, dtype=object)[r], "chunk_id": ids[c], "score": score[r, c]})
            out = out.sort_values(["qid", "score", "chunk_id"], ascending=[True, False, True])
            yield out.groupby("qid", sort=False).head(k)

    return chunks.mapInPandas(run, f"qid {qid_type}, chunk_id {id_type}, score double")


def postings(chunks: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """field, term, chunk_id, tf, size: how often each term stands in each field of each chunk, and the field's terms."""
    split = chunks.select("chunk_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), terms(c).alias("terms")) for f, c in fields.items()])).alias("x"))
    rows = split.select("chunk_id", "x.field", F.size("x.terms").alias("size"), F.explode("x.terms").alias("term"))
    return rows.groupBy("field", "term", "chunk_id").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def text_top_k(index: DataFrame, chunk_count: int, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """qid, chunk_id, score, rank: BM25 over the index, summed over fields; any term may match.

    index: as postings() gives it, best written once.  queries: qid, query.  allowed (chunk_id) limits what may be found.  Averages and
    document frequencies count all chunks.  Null and empty queries find nothing.

    Postings of asked terms are dealt by chunk, queries in blocks; a task adds up the scores of its chunks for
    its queries and gives k a query, so no row is made for a query and a document that merely share a word.
    """
    asked = queries.select("qid", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    # a field's terms over all chunks: each posting adds its count
    sizes = index.groupBy("field").agg((F.sum("tf") / F.lit(float(max(1, chunk_count)))).alias("mean"))
    idf = wanted.groupBy("field", "term").agg(F.log(1 + (F.lit(float(chunk_count)) - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    if allowed is not None:
        wanted = wanted.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    weighed = wanted.join(F.broadcast(sizes), "field").join(idf, ["field", "term"])  # one row a field: a few at most
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    parts, blocks = -(-max(1, index.count()) // POSTING_BLOCK), -(-max(1, queries.count()) // ASKED_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = weighed.select("term", "chunk_id", part.alias("part"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("p"), every(blocks).alias("b"))
    right = asked.select("qid", F.col("term").alias("word"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("at"))
    schema = f"qid {dict(queries.dtypes)['qid']}, chunk_id {dict(index.dtypes)['chunk_id']}, score double"
    found = left.groupBy("p", "b").cogroup(right.groupBy("at", "block")).applyInPandas(lambda own, ask: _best_texts(own, ask, k, digits), schema)
    return ranked(found, [F.col("score").desc(), "chunk_id"], k)


def _best_texts(own: pd.DataFrame, ask: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """The k best chunks of each query among some postings: sums of parts over the terms that both hold."""
    empty = pd.DataFrame({"qid": ask["qid"][:0], "chunk_id": own["chunk_id"][:0], "score": np.zeros(0)})
    if not len(own) or not len(ask):
        return empty
    term, words = pd.factorize(own["term"])
    chunk_ids, chunk = np.unique(own["chunk_id"].to_numpy(), return_inverse=True)
    word = pd.Index(words).get_indexer(ask["word"])
    qids, query = np.unique(ask["qid"].to_numpy()[word >= 0], return_inverse=True)
    if not len(qids):
        return empty
    word = word[word >= 0]
    query = query[by := np.argsort(word, kind="stable")]
    ends = np.searchsorted(word[by], np.arange(len(words) + 1))
    order = np.argsort(chunk, kind="stable")
    term, chunk, weight = term[order], chunk[order], own["part"].to_numpy()[order]
    out = []
    for at in range(0, len(chunk_ids), SCORED):
        a, b = np.searchsorted(chunk, [at, at + SCORED])
        many = min(SCORED, len(chunk_ids) - at)
        total = np.zeros(len(qids) * many)
        # each posting counts for the queries of its term; in slices, so that the pairs fit
        times = ends[term[a:b] + 1] - ends[term[a:b]]
        for x in np.split(np.arange(a, b), np.searchsorted(np.cumsum(times), np.arange(4_000_000, times.sum(), 4_000_000))):
            n = times[x - a]
            place = np.repeat(ends[term[x]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            total += np.bincount(query[place] * many + np.repeat(chunk[x] - at, n), np.repeat(weight[x], n), len(total))
        score = np.floor(total.reshape(len(qids), many) * 10**digits + 0.5) / 10**digits
        top = min(k, many)
        least = -np.partition(-score, top - 1, axis=1)[:, top - 1 : top]
        q, c = np.nonzero((score >= least) & (score > 0))
        out.append((q, at + c, score[q, c]))
    q, c, score = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pd.DataFrame({"qid": qids[q[top]], "chunk_id": chunk_ids[c[top]], "score": score[top]})


def rank_fusion(left: DataFrame, right: DataFrame, fetch: int, k: int, constant: int = 60, keys: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """qid, keys, score, rank: reciprocal rank fusion of two ranked lists.

    left, right: qid, keys, rank (from 1).  A key counts at its first place; one that a list lacks counts there at
    place fetch + 1, both from 0.
    """
    tagged = left.select("qid", *keys, F.col("rank").alias("a"), F.lit(None).cast("int").alias("b")).unionByName(
        right.select("qid", *keys, F.lit(None).cast("int").alias("a"), F.col("rank").alias("b"))
    )
    both = tagged.groupBy("qid", *keys).agg(F.min("a").alias("a"), F.min("b").alias("b"))
    place = lambda c: 1.0 / (constant + F.coalesce(F.col(c) - 1, F.lit(fetch + 1)))
    scored = both.withColumn("_raw", place("a") + place("b"))
    out = ranked(scored, [F.round("_raw", 12).desc(), *keys], k)
    return out.select("qid", *keys, F.round("_raw", 6).alias("score"), "rank")


def two_wordings(first: DataFrame, second: DataFrame, fetch: int, k: int) -> DataFrame:
    """qid, chunk_id, score, rank: rankings of queries in one wording, fused with those of their other wording where there is one."""
    both = second.select("qid").distinct()
    fused = rank_fusion(first.join(both, "qid", "left_semi"), second, fetch, k)
    return fused.unionByName(first.join(both, "qid", "left_anti").filter(F.col("rank") <= k).select(*fused.columns))
