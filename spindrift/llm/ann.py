"""Nearest neighbours over randomly rotated one-bit codes.

Rows fall into cells by their nearest centre, and each cell into blocks.  A block holds its mean, and for each of its distinct vectors
the signs of the rotated vector's distance from the mean, packed to bits, with correction scalars: how long that distance is,
how well the signs stand for it, and how many signs are positive.  A query is rotated as well and rounded to four bits a
dimension; bits of both, combined and counted, estimate every inner product of a block, and bounds on the
error choose the vectors that are reranked on their original components.

A query first visits the block whose mean is nearest, which tells what score its result has to reach, and then
every block whose own bound reaches that.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Rows in an index block, about; queries in a query block; blocks that a query block is compared with by their means in one task.
BLOCK, QUERIES, PAGE = 4096, 4096, 2048
#: Rows that centres are fitted on, about, and centres at most: the only part that doesn't read every row. Rows of more cells lie in further blocks.
SAMPLE, CELLS = 32_768, 512
#: Width of the error bounds, in standard errors: of the one-bit code of a vector, and of the best inner product in a block.
WIDTH, REACH = 2.6, 5.0
#: Bits of a rounded query component.
PLANES = 4
#: Queries whose estimates are made together.
TILE = 32
INDEX = "block long, dim int, n int, mean binary, spread double, codes binary, scales binary, errors binary, positive binary, vectors binary, offsets binary, ids binary, rows binary"
FOUND = "query_row long, query_id long, vec_id long, row long, score double"


@lru_cache(maxsize=2)
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same for one dimension and seed everywhere; made once in a worker."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, vector) of every row with an id, without null, zero, empty or non-finite vectors; components keep their type."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col("vector")
    found = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    big = F.lit(1.7976931348623157e308)
    good = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= big)) & F.exists(v, lambda x: x != 0)
    return found.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & good).withColumn("row", F.monotonically_increasing_id())


def centres(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Centres of each dimension's cells, fitted on a sample of about SAMPLE rows by hash of the row."""
    part = 1 << 20
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(part)) < max(1, min(part, part * SAMPLE // max(1, count))))

    def fit(pdf):
        x = np.stack(pdf["vector"]).astype(float)
        rows_of_dim = count * len(x) / min(count, SAMPLE)
        k = max(1, min(CELLS, len(x) // 16, round(rows_of_dim / BLOCK)))
        own = x[np.random.default_rng(3).choice(len(x), k, replace=False)]
        for _ in range(6 if k > 1 else 0):
            at = cells_of(x, own)
            sums = np.zeros_like(own)
            np.add.at(sums, at, x)
            size = np.bincount(at, minlength=k)
            own = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], own)
        return pd.DataFrame({"dim": [x.shape[1]], "k": [k], "own": [own.tobytes()]})

    fitted = some.withColumn("dim", F.size("vector")).groupBy("dim").applyInPandas(fit, "dim int, k int, own binary").collect()
    return {r["dim"]: np.frombuffer(r["own"]).reshape(r["k"], r["dim"]) for r in fitted}


def cells_of(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    return np.argmin((own**2).sum(1) - 2 * (x @ own.T), axis=1)


def build_index(rows: DataFrame) -> DataFrame:
    """Index rows over (row, vec_id, vector): every row in one block of about BLOCK rows of one cell and dimension."""
    count = rows.count()
    own = centres(rows, count)

    def assign(batches):
        for pdf in batches:
            size = pdf["vector"].map(len)
            cell = np.zeros(len(pdf), np.int32)
            for dim in size.unique():
                if dim in own and len(own[dim]) > 1:
                    at = np.flatnonzero(size == dim)
                    cell[at] = cells_of(np.stack(pdf["vector"].iloc[at]).astype(float), own[dim])
            yield pdf.assign(dim=size.astype("int32"), cell=cell)

    kind = dict(rows.dtypes)["vector"]
    dealt = written(rows.select("row", "vec_id", "vector").mapInPandas(assign, f"row long, vec_id long, vector {kind}, dim int, cell int"))
    # a row for each cell: at most CELLS a dimension
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = dealt.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))

    def block(key, pdf):
        return pd.DataFrame([encode(pdf)])

    return dealt.groupBy("dim", "cell", "part").applyInPandas(block, INDEX).withColumn("block", F.monotonically_increasing_id())


def encode(pdf: pd.DataFrame) -> dict:
    """An index row: equal vectors share one code, their rows stand in order of their ids."""
    pdf = pdf.sort_values(["vec_id", "row"])
    every = np.stack(pdf["vector"])
    x, back = np.unique(every, axis=0, return_inverse=True)
    back = back.ravel()
    order = np.argsort(back, kind="stable")
    dim = x.shape[1]
    with np.errstate(all="ignore"):  # components near the largest number overflow; what isn't a number is reranked
        mean = every.astype(float).mean(0)
        apart = x - mean
        turned = apart @ rotation(dim)
        norms = np.linalg.norm(turned, axis=1)
        fits = np.abs(turned).sum(1) / (np.sqrt(dim) * np.maximum(norms, 1e-300))
        fits = np.where(norms > 0, fits, 1.0)
        spread = np.sqrt(max(0.0, np.linalg.eigvalsh(apart.T @ apart / len(x))[-1])) if np.isfinite(norms).all() else np.inf
        spread = min(REACH * spread, norms.max()) if np.isfinite(spread) else np.inf
        scales = norms / fits / np.sqrt(dim)
        errors = norms * np.sqrt(np.maximum(1 - fits**2, 0)) / fits / np.sqrt(max(dim - 1, 1))
    bits = np.zeros((len(x), -(-dim // 64) * 64), bool)
    bits[:, :dim] = turned >= 0
    return {
        "block": 0,
        "dim": dim,
        "n": len(x),
        "mean": mean.tobytes(),
        "spread": float(spread),
        "codes": np.packbits(bits, axis=1).tobytes(),
        "scales": scales.tobytes(),
        "errors": errors.tobytes(),
        "positive": bits.sum(1).astype(np.int32).tobytes(),
        "vectors": x.tobytes(),
        "offsets": np.searchsorted(back[order], np.arange(len(x) + 1)).astype(np.int64).tobytes(),
        "ids": pdf["vec_id"].to_numpy(np.int64)[order].tobytes(),
        "rows": pdf["row"].to_numpy(np.int64)[order].tobytes(),
    }


class Rounded:
    """Rotated queries, rounded to PLANES bits a dimension: planes of packed bits, and what turns counts back to inner products."""

    def __init__(self, q: np.ndarray):
        turned = q @ rotation(q.shape[1])
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**PLANES - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.sum = self.low * q.shape[1] + self.step * level.sum(1)
        bits = np.zeros((len(q), PLANES, -(-q.shape[1] // 64) * 64), bool)
        for p in range(PLANES):
            bits[:, p, : q.shape[1]] = level >> p & 1
        self.planes = np.packbits(bits, axis=2).view(np.uint64)
        self.norm = np.linalg.norm(q, axis=1)
        # rounding moves a component by step / sqrt(12), one standard error
        self.error = np.sqrt(q.shape[1] / 12) * self.step

    def counts(self, some: slice, codes: np.ndarray) -> np.ndarray:
        """Sums over the positive signs of each code of the rounded components."""
        planes = self.planes[some]
        total = np.zeros((len(planes), len(codes)), np.int32 if codes.shape[1] > 32 else np.uint16)
        for w in range(codes.shape[1]):
            own = np.ascontiguousarray(codes[:, w])
            for p in range(PLANES):
                total += np.bitwise_count(planes[:, p, w, None] & own).astype(total.dtype) << p
        return total


def scan(block, qrows: np.ndarray, qids: np.ndarray, q: np.ndarray, reach: np.ndarray, k: int, kind) -> pd.DataFrame:
    """Of a block, the rows that may be among the k best of each query, reach being the score that a query's result has to reach.

    An upper bound is a sum of products of what belongs to the query and what belongs to the code, and of scale * step * count, so beside
    the counting it takes one thin product of matrices.  The error of code and rounding together is a root; its tangent at
    the block's mean, which lies above it, parts into such products.
    """
    dim = q.shape[1]
    view = lambda name, kind=np.float64: np.frombuffer(getattr(block, name), kind)
    x, codes = view("vectors", kind).reshape(-1, dim).astype(float), view("codes", np.uint8).reshape(block.n, -1).view(np.uint64)
    scales, positive, offsets, ids, rows = view("scales"), view("positive", np.int32), view("offsets", np.int64), view("ids", np.int64), view("rows", np.int64)
    rounded, centre = Rounded(q), q @ view("mean")
    least, found = reach.copy(), []
    with np.errstate(all="ignore"):
        ratio = np.where(scales > 0, view("errors") / scales, 0.0) ** 2
        middle = ratio.mean()
        root = np.sqrt(rounded.norm**2 * middle + 4 * rounded.error**2)
        unit = 2 * rounded.step
        of_code = np.stack([np.ones(len(scales)), scales * positive, scales, scales * (ratio - middle)]).astype(np.float32)
        narrow = scales.astype(np.float32)
        for at in range(0, len(q), TILE):
            some = slice(at, min(at + TILE, len(q)))
            counts = rounded.counts(some, codes)
            own = np.stack([centre[some], 2 * rounded.low[some], -rounded.sum[some], np.zeros(len(counts))], 1)
            for i in np.flatnonzero(~np.isfinite(least[some])):  # nothing is known yet: the likeliest tell what has to be reached
                first = min(k, block.n)
                estimate = (own[i] / unit[at + i]).astype(np.float32) @ of_code + narrow * counts[i]
                likely = np.argpartition(-estimate, first - 1)[:first]
                if first == k:
                    least[at + i] = np.einsum("ij,j->i", x[likely], q[at + i]).min()
            own[:, 0] -= least[some]
            own[:, 0] += 1e-6 * np.abs(least[some])
            own[:, 2] += WIDTH * root[some]
            own[:, 3] = WIDTH * rounded.norm[some] ** 2 / (2 * root[some])
            upper = (own / unit[some, None]).astype(np.float32) @ of_code
            upper += narrow * counts
            may = ~(upper < 0)
            for i in range(len(may)):
                c = np.flatnonzero(may[i])
                score = np.einsum("ij,j->i", x[c], q[at + i])
                good = ~(score < least[at + i])
                found.append((c[good], score[good]))
    r = np.repeat(np.arange(len(q)), [len(c) for c, _ in found])
    c, score = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    # of equal vectors the k smallest ids are enough
    take = np.minimum(offsets[c + 1] - offsets[c], k)
    one = np.repeat(np.arange(len(c)), take)
    place = offsets[c][one] + np.arange(len(one)) - np.repeat(np.cumsum(take) - take, take)
    r, score, vec, row = r[one], score[one], ids[place], rows[place]
    order = np.lexsort((row, vec, -score, r))
    r, score, vec, row = r[order], score[order], vec[order], row[order]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    r = r[top]
    return pd.DataFrame({"query_row": qrows[r], "query_id": qids[r], "vec_id": vec[top], "row": row[top], "score": score[top]})


def _query_blocks(queries: DataFrame) -> DataFrame:
    """(qblock, qdim, qrows, qids, qvectors): queries of one dimension packed by QUERIES."""

    def run(batches):
        held: dict[int, list] = {}
        pack = lambda rows, dim: pd.DataFrame(
            {"qblock": [0], "qdim": [dim]} | {n: [np.array([r[i] for r in rows], "<i8").tobytes()] for i, n in enumerate(("qrows", "qids"))} | {"qvectors": [np.stack([r[2] for r in rows]).astype(float).tobytes()]}
        )
        for pdf in batches:
            for row, i, v in zip(pdf["row"], pdf["vec_id"], pdf["vector"], strict=True):
                held.setdefault(len(v), []).append((row, i, v))
                if len(held[len(v)]) == QUERIES:
                    yield pack(held.pop(len(v)), len(v))
        for dim, rows in held.items():
            yield pack(rows, dim)

    # as few blocks as hold them: each takes a copy of the index blocks that it visits
    dealt = queries.select("row", "vec_id", "vector").repartition(-(-max(1, queries.count()) // QUERIES), "row")
    packed = dealt.mapInPandas(run, "qblock long, qdim int, qrows binary, qids binary, qvectors binary")
    return packed.withColumn("qblock", F.monotonically_increasing_id())


def _visits(packed: DataFrame, stats: DataFrame, pages: int, reach: DataFrame | None) -> DataFrame:
    """(block, qblock, qrows, qids, qvectors, reach): which queries visit which block.

    Without reach each query's nearest block of a page; with it (qblock, query_row, score) all others whose bound reaches it.
    One row for a query block and an index block, whatever the number of queries in it.
    """
    met = packed.join(stats.select(F.col("dim").alias("qdim"), "page").distinct(), "qdim")
    left = met if reach is None else met.join(reach.groupBy("qblock").agg(F.collect_list(F.struct("query_row", "score")).alias("known")), "qblock", "left")
    right = stats.withColumnRenamed("page", "at").join(packed.select(F.col("qblock").alias("with"), F.col("qdim").alias("dim")), "dim")

    def run(key, query, blocks):
        columns = ("block", "qblock", "qrows", "qids", "qvectors", "reach")
        if not len(query) or not len(blocks):
            return pd.DataFrame({c: [] for c in columns})
        query = query.iloc[0]
        q = np.frombuffer(query["qvectors"]).reshape(-1, query["qdim"])
        qrows, qids = np.frombuffer(query["qrows"], np.int64), np.frombuffer(query["qids"], np.int64)
        blocks = blocks.sort_values("block")
        with np.errstate(all="ignore"):
            centre = q @ np.stack([np.frombuffer(m) for m in blocks["mean"]]).T
            home = np.argmax(np.nan_to_num(centre, nan=np.inf), axis=1)
            if "known" not in query:
                least = np.full(len(q), -np.inf)
                goes = np.arange(len(blocks)) == home[:, None]
            else:
                known = {k["query_row"]: k["score"] for k in (query["known"] if query["known"] is not None else ())}
                least = np.array([known.get(r, -np.inf) for r in qrows.tolist()])
                goes = ~(centre + np.linalg.norm(q, axis=1)[:, None] * blocks["spread"].to_numpy() < least[:, None])
                goes[np.arange(len(q)), home] = False
        rows = [(b, query["qblock"], qrows[g].tobytes(), qids[g].tobytes(), q[g].tobytes(), least[g].tobytes()) for b, g in zip(blocks["block"], goes.T, strict=True) if g.any()]
        return pd.DataFrame(rows, columns=columns)

    schema = "block long, qblock long, qrows binary, qids binary, qvectors binary, reach binary"
    return left.groupBy("qblock", "page").cogroup(right.groupBy("with", "at")).applyInPandas(run, schema)


def _visited(visits: DataFrame, index: DataFrame, k: int, kind) -> DataFrame:
    """What scan() finds on each visit: a task holds one index block and one query block at a time."""
    blocks = index.join(visits.select("block", F.col("qblock").alias("with")), "block").withColumnRenamed("block", "at")

    def run(key, own, query):
        if not len(own) or not len(query):
            return pd.DataFrame({"qblock": [], "query_row": [], "query_id": [], "vec_id": [], "row": [], "score": []})
        q, block = query.iloc[0], next(own.itertuples(index=False))
        view = lambda name, kind=np.int64: np.frombuffer(q[name], kind)
        found = scan(block, view("qrows"), view("qids"), view("qvectors", np.float64).reshape(-1, block.dim), view("reach", np.float64), k, kind)
        return found.assign(qblock=key[1])[["qblock", *(c for c in found.columns)]]

    return blocks.groupBy("at", "with").cogroup(visits.groupBy("block", "qblock")).applyInPandas(run, f"qblock long, {FOUND}")


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_row, query_id, rank (from 1), vec_id, score: each query row's k nearest by inner product, itself left out.

    queries: row, vec_id, vector.  Queries meet vectors of their own dimension.  Fewer candidates than k give fewer rows; ties go to
    the smaller id.
    """
    kind = np.float32 if dict(queries.dtypes)["vector"] == "array<float>" else np.float64
    index, packed = written(index), written(_query_blocks(queries))
    stats = index.select("block", "dim", "mean", "spread")
    pages = -(-max(1, index.count()) // PAGE)
    stats = stats.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(pages)))
    # one more than asked for: the query itself is among them
    first = written(_visited(written(_visits(packed, stats, pages, None)), index, k + 1, kind))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    reach = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k + 1).select("qblock", "query_row", "score")
    second = _visited(written(_visits(packed, stats, pages, written(reach))), index, k + 1, kind)
    others = first.unionByName(second).filter("row <> query_row")
    return others.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: search() of the rows that satisfy is_query against all other rows.

    Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows without an id.  Rows
    that share an id are rows of their own: each is a candidate of the others, and each that is a query brings k rows under its id.
    Equal vectors tie, the smaller id first; an empty table gives an empty result; other columns are not read.
    """
    rows = written(usable(vectors, id_col, vector_col))
    return search(build_index(rows), rows.filter(is_query), k).drop("query_row")
