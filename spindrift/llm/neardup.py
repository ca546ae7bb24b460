"""Near duplicates by HyperMinHash.

A document's distinct word shingles fall into buckets by hash; a bucket keeps, of
its least hash, the count of leading zeros and some mantissa bits: a register of 16 bits.
Registers, four to a band, make the keys under which documents meet.  Documents that meet are
compared by the share of equal registers, less what chance collisions add, and those that
may reach the threshold are confirmed on their full shingle sets.  Links are then closed to components.

Work follows the rows, not the pairs: documents with equal sets become one before banding; a key
compares its documents with its most central one, that which meets most others over all keys; only keys whose
documents still lie in several components are looked into again, in blocks of bounded size.  There, what two documents have in common is
bounded exactly: inside the central document's set by the smaller share of it, outside by what both add to it, so
copies with edits of their own need no closer look.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, map_texts, slices, written
from .graph import components, merged

SHINGLE = 5
#: Registers (2**7), bits of mantissa, registers in a band.
BITS, MANTISSA, ROWS = 7, 10, 4
REGISTERS = 1 << BITS
BANDS = REGISTERS // ROWS
#: Jaccard similarity of a link, as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: Standard errors by which an estimate may lie below the threshold and still be confirmed.
SLACK = 4.0
#: Documents of one key that one task compares with as many others; what it holds is bounded by its square.
BLOCK = 1024
#: Pairs of one document, about, that one task confirms; one that more are compared with is dealt to several.
CROWD = 2000
#: Distance from the central document up to which what a document adds to it is kept (beyond, registers alone decide).
NEAR = 0.5
#: Bits of the sieve that keeps texts without a partner from being moved.
SIEVE = 1 << 22

_LOW = np.uint64((1 << (64 - BITS)) - 1)
_BOUNDS = np.arange(1, REGISTERS, dtype=np.uint64) << np.uint64(64 - BITS)
# for each empty bucket, the order in which it asks the others: fixed, and independent between buckets
_PROBES = np.stack([np.random.default_rng([11, b]).permutation(REGISTERS) for b in range(REGISTERS)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, ascending.

    A-Z is lower-cased; words are runs without blank and control white space; fewer words than a shingle
    count as one; no words give none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(len(words), SHINGLE)
    key = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        key = key * _STEP + h[k : len(h) - n + 1 + k]
    return np.unique(mixed(key))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of ascending hashes; 0 is an empty one."""
    at = np.searchsorted(hashes, np.concatenate([np.zeros(1, np.uint64), _BOUNDS]))
    end = np.append(at[1:], len(hashes))
    full = end > at
    out = np.zeros(REGISTERS, np.uint16)
    least = (hashes[at[full]] & _LOW) | np.uint64(1)
    length = np.floor(np.log2(least.astype(np.float64))).astype(np.int64) + 1
    zeros = np.minimum(64 - BITS - length, 61)
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> shift) & np.uint64((1 << MANTISSA) - 1)
    out[full] = ((np.maximum(zeros, 0) + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with each empty one borrowed from the first full bucket in its own order."""
    full = regs != 0
    if full.all() or not full.any():
        return regs
    empty = np.flatnonzero(~full)
    order = _PROBES[empty]
    source = order[np.arange(len(empty)), full[order].argmax(1)]
    out = regs.copy()
    out[empty] = regs[source]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each band."""
    own = np.ascontiguousarray(filled(regs)).view(np.uint64)
    return mixed(own + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _STEP).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows a and b (broadcast over rows) with set sizes n and m, and how low they may be for a link.

    Of the registers that either holds, those that agree count, less the expected chance agreements:
    0.1699 * 2**-mantissa a register for sets of equal size, fewer as sizes part.
    """
    used = ((a != 0) | (b != 0)).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    part = n / np.maximum(m, 1)
    chance = 0.169919487 * 2.0**-MANTISSA * 4 * part / (1 + part) ** 2 * used
    used = np.maximum(used, 1)
    t = NUMERATOR / DENOMINATOR
    return np.maximum(same - chance, 0) / used, t - SLACK * np.sqrt(t * (1 - t) / used) - 0.5 / used


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set) and registers of each row."""

    def work(ids, texts):
        sets = [shingles(t) for t in texts]
        return {
            "doc_id": ids,
            "n_shingles": [len(s) for s in sets],
            "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "registers": [registers(s).tobytes() for s in sets],
        }

    return map_texts(docs, lambda: work, "doc_id long, n_shingles long, set_key binary, registers binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, band, node): the band keys of each node."""

    def run(batches):
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column(1).to_pylist()]
            if keys:
                node, band = np.repeat(batch.column(0).to_numpy(), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(band), pa.array(node)], names=["key", "band", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "key long, band int, node long")


def _met(nodes: DataFrame) -> DataFrame:
    """(key, band, node, head) for the keys of two nodes or more; head is the key's most central node.

    Central is what shares its keys with most others; ties go to the smaller node.  Near copies of one text differ from each other more
    than from the text itself, which therefore meets most of them.
    """
    bands = _bands(nodes)
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(bands.join(sizes, "key"))
    central = shared.groupBy("node").agg(F.sum("size").alias("met"))
    heads = shared.select("key", "node").join(central, "node").groupBy("key").agg(F.max(F.struct(F.col("met"), (-F.col("node")).alias("turned"))).alias("top"))
    return written(shared.join(heads, "key").select("key", "band", "node", (-F.col("top.turned")).alias("head")))


def sieved(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows whose column may be among the ids (one long column): a semi join that moves no row, with some others left in.

    Ids mark bits of a table of SIEVE / 64 words at most, which is what goes to every task however many ids there are.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    slot = bit(F.col(ids.columns[0]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = ids.groupBy(F.floor(slot / 64).alias("_word")).agg(F.bit_or(one).alias("_mask"))
    marked = rows.withColumn("_bit", bit(F.col(column))).withColumn("_word", F.floor(F.col("_bit") / 64))
    kept = marked.join(F.broadcast(words), "_word").filter(F.getbit("_mask", (F.col("_bit") % 64).cast("int")) == 1)
    return kept.select(*rows.columns)


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that may be links by their registers."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
            value, least = estimate(a, b, n, m)
            keep = np.flatnonzero((value >= least) & (DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, distance, link, added) for the pairs: Jaccard distance of their full sets, whether it makes a link, and a's hashes that b lacks.

    Only texts that the sieve lets through move, by id and once for both sides; then those of a pair meet at b, whose
    set is made once in a run of its pairs.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = sieved(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), "id", ends)
    # a document that a crowd is compared with takes its text to several tasks; of pairs only ids move to find that out
    crowds = pairs.groupBy("b").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("tasks")).filter("tasks > 1")
    dealt = pairs.join(crowds, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("tasks")).cast("int"), F.lit(0)).alias("task"))
    left = dealt.join(texts, dealt["a"] == texts["id"]).select("a", "b", "task", F.col("text").alias("text_a"))
    right = dealt.select("b", "task").distinct().join(texts, F.col("b") == F.col("id")).select("b", "task", F.col("text").alias("text_b"))

    def run(batches):
        last, own = None, None
        for batch in batches:
            for part in slices(batch):
                distances, links, added = [], [], []
                a, b = part.column(2).to_pylist(), part.column(3).to_pylist()
                for x, y in zip(a, b, strict=True):
                    if y != last:
                        last, own = y, shingles(y or "")
                    other = shingles(x or "")
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    union = len(own) + len(other) - common
                    distances.append(1 - common / max(1, union))
                    added.append(np.setdiff1d(other, own, assume_unique=True).tobytes() if distances[-1] <= NEAR else None)
                    links.append(bool(common) and DENOMINATOR * common >= NUMERATOR * union)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(distances, pa.float64()), pa.array(links, pa.bool_()), pa.array(added, pa.binary())], names=["a", "b", "distance", "link", "added"])
                del a, b, added, part
            del batch
            let_go()

    return left.join(right, ["b", "task"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, distance double, link boolean, added binary")


def _crossing(met: DataFrame, nodes: DataFrame, labels: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a key, lie in two components and may be links, and whether they are spare.

    Keys with one component are done.  Documents of the others are dealt to blocks, and each pair of blocks is
    compared in one task: by sizes and distances from the head, then by registers, then by what both add to the
    head; of the keys that a pair shares, the first alone counts.  A pair is
    spare when pairs that look safer already tie its components: it needs a look only if these prove to be no links.
    """
    placed = met.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = placed.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).filter("size > 2 and low < high")
    open_keys = open_keys.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(open_keys, "key")
    known = tested.select(F.col("a").alias("node"), F.col("b").alias("head"), "distance", "added")
    rows = rows.join(known, ["node", "head"], "left").withColumn("distance", F.when(F.col("node") == F.col("head"), 0.0).otherwise(F.col("distance")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each document goes to every pair of blocks that holds its own
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "band", "node", "component", "distance", "added", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(nodes.select("node", "n", "registers"), "node")

    def compare(pdf):
        import pandas as pd

        within = pdf["i"].iat[0] == pdf["j"].iat[0]
        band, far = pdf["band"].iat[0], 1 - NUMERATOR / DENOMINATOR + 1e-9
        regs = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(-1, REGISTERS)
        keys = np.stack([filled(r).view(np.uint64) for r in regs])
        size, part, node, away = (pdf[c].to_numpy() for c in ("n", "component", "node", "distance"))
        added = [None if x is None else frozenset(np.frombuffer(x, np.uint64).tolist()) for x in pdf["added"]]
        left = np.flatnonzero(pdf["own"].to_numpy() == pdf["i"].iat[0])
        right = left if within else np.flatnonzero(pdf["own"].to_numpy() == pdf["j"].iat[0])
        pairs = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in left:
            apart = np.abs(away[right] - away[k])
            sizes = DENOMINATOR * np.minimum(size[right], size[k]) >= NUMERATOR * np.maximum(size[right], size[k])
            may = right[(part[right] != part[k]) & sizes & ~(apart > far) & ((node[right] > node[k]) | (not within))]
            if not len(may):
                continue
            same = keys[may] == keys[k]
            may = may[(same.argmax(1) == band) & same[:, band]]
            if not len(may):
                continue
            value, least = estimate(regs[may], regs[k][None, :], size[may], np.full(len(may), size[k]))
            ok = value >= least
            if added[k] is not None:
                for n in np.flatnonzero(ok):
                    m = may[n]
                    if added[m] is not None:
                        most = min(size[k] - len(added[k]), size[m] - len(added[m])) + len(added[k] & added[m])
                        ok[n] = DENOMINATOR * most >= NUMERATOR * (size[k] + size[m] - most)
            pairs.append((value[ok], np.full(ok.sum(), k), may[ok]))
        value, x, y = (np.concatenate([p[i] for p in pairs]) for i in range(3))
        a, b = np.maximum(node[x], node[y]), np.minimum(node[x], node[y])
        root: dict[int, int] = {}

        def top(c):
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        spare = np.ones(len(a), bool)
        for n in np.lexsort((b, a, -value)).tolist():
            c, d = top(part[x[n]]), top(part[y[n]])
            if c != d:
                spare[n] = False
                if value[n] >= NUMERATOR / DENOMINATOR:
                    root[c] = d
        del keys, regs, added, pairs
        let_go()
        return pd.DataFrame({"a": a, "b": b, "spare": spare})

    found = rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long, spare boolean").groupBy("a", "b").agg(F.min("spare").alias("spare"))
    both = tested.select("a", "b").unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return found.join(both, ["a", "b"], "left_anti")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    component_id is the smallest doc_id reachable over links (75 of 100 shingles in common), kept whether it is
    the document's own.  Null and empty texts have no shingles and no links; rows without a doc_id have no
    component and are kept; repeated rows are copies of each other; texts that share a doc_id are one document's, so what is
    like any of them is reachable from it; an empty table gives an empty result; other
    columns are not read.
    """
    sketches = written(sketch(docs))
    own = sketches.filter("n_shingles > 0 and doc_id is not null")
    nodes = own.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    nodes = written(nodes)
    met = _met(nodes)
    pairs = met.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    tested = written(_confirmed(written(_estimated(pairs, nodes)), docs))
    labels = components(tested.filter("link"))
    crossing = written(_crossing(met, nodes, labels, tested))
    safest = crossing.filter("not spare").select("a", "b")
    for pairs in (safest, None):
        if pairs is None:  # spare pairs whose components are still apart
            part = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
            spare = crossing.filter("spare").join(part("a"), "a", "left").join(part("b"), "b", "left")
            pairs = written(spare.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
        if not pairs.isEmpty():
            found = written(_confirmed(pairs, docs).filter("link").select("a", "b"))
            if not found.isEmpty():
                labels = merged(labels, found)
    placed = nodes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(placed, "set_key", "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
