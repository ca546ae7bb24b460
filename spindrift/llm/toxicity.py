"""Toxicity: a weighted lexicon, matched by Aho-Corasick after folding, normalised by length.

Folding lower-cases, drops accents and invisible characters, and maps
homoglyphs of other scripts and digits or signs inside words to the letters they stand
for.  The lexicon holds word beginnings and whole words with weights learned from labelled
documents; the longest entry at a word decides, so longer harmless words override a shorter
entry, and learned exception phrases (a word and the one before it) cancel
hits inside them.  A logistic curve over the weight per word and in all gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, written

#: The curve where labels don't teach one.
UNTAUGHT = (-5.0, 1.0, 16.0, 14.0)
#: Labelled documents that a model is fitted on, at most (by hash of the id).
SAMPLE = 12_000
#: Documents of the sample that must hold an entry or a phrase, and by how much more often toxic ones must hold an entry. What the
#: lexicon collects follows from the sample alone, SUPPORT documents a candidate; there is no other bound on it.
SUPPORT, LIFT = 6, 4.0
#: Candidates that a task holds before it hands them on.
HELD = 150_000
#: Word beginnings of these lengths are candidates, next to whole words.
SHORTEST, LONGEST = 4, 9

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝѵзкмнтвγαεικνορτυχβηωσ", "aeopcyxijshdqwv3kmhtbyaeiknoptuxbnwo", strict=True))
DIGITS = dict(zip("0134578", "oieastb", strict=True))
SIGNS = dict(zip("@$!|", "asil", strict=True))
#: Whole words that count at this weight before anything is learned; labels may overrule them.
SEED, SEED_WEIGHT = (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile retard dumbass "
    "bastard bitch asshole shithead fucker fuck shit wanker twat vermin filth subhuman scumbag"
).split(), 3.0
SIGN_INSIDE = re.compile(r"(?<=[a-z])[@$!|](?=[a-z])")
WORDS = re.compile(r"[^\W_]+").findall
GAPS = re.compile(r"[\W_]+")


@lru_cache(maxsize=1)
def table() -> dict[int, str | None]:
    """Folding of single characters: accents and compatibility forms by Unicode decomposition, then homoglyphs and digits."""
    fold: dict[int, str | None] = {}
    for c in [*range(0x80, 0x2000), *range(0x2070, 0x2190), *range(0x2460, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF60), *range(0x1D400, 0x1D800)]:
        plain = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        plain = "".join(HOMOGLYPHS.get(x, x) for x in plain)
        if plain != chr(c):
            fold[c] = plain
    for c in [0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF]:
        fold[c] = None
    return fold | {ord(k): v for k, v in DIGITS.items()}


ASCII_DIGITS = str.maketrans(DIGITS)


def folded(text: str) -> str:
    text = text.lower()
    text = text.translate(ASCII_DIGITS) if text.isascii() else text.translate(table())
    if any(s in text for s in SIGNS):
        text = SIGN_INSIDE.sub(lambda m: SIGNS[m[0]], text)
    return text


def line(text: str) -> str:
    """Folded words with one blank around each."""
    return f" {GAPS.sub(' ', folded(text)).strip()} "


@dataclass(frozen=True)
class Model:
    """Entries (" word" begins a word, " word " is one) to weights; exception phrases; weights of the curve."""

    entries: dict[str, float]
    phrases: frozenset[str]
    curve: tuple[float, ...]


@lru_cache(maxsize=1)
def automaton(entries: tuple, phrases: frozenset):
    import ahocorasick

    built = ahocorasick.Automaton()
    for entry, weight in entries:
        built.add_word(entry, (len(entry), weight, 0))
    for phrase in phrases:
        built.add_word(phrase, (len(phrase), 0.0, 1))
    if len(built):
        built.make_automaton()
    return built


def hits(words: str, built) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the deciding entry at each word that has one, in a line(); exception phrases cancel those inside them."""
    best: dict[int, tuple[int, float]] = {}
    exempt: list[tuple[int, int]] = []
    if not len(built):
        return []
    for end, (n, weight, phrase) in built.iter(words):
        start = end - n + 1
        if phrase:
            exempt.append((start, end))
        elif start not in best or n > best[start][0]:
            best[start] = (n, weight)
    if exempt:
        # a phrase starts at the blank before its first word and ends at that after its second
        for a, b in exempt:
            for at in [s for s in (a, words.find(" ", a + 1)) if 0 <= s < b]:
                best.pop(at, None)
    return [(s, s + n, w) for s, (n, w) in best.items()]


def measures(text: str, built) -> tuple[float, float]:
    """(weight in all, words) of a text."""
    words = line(text)
    return sum(w for _, _, w in hits(words, built)), words.count(" ") - 1.0


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    weight = np.maximum(weight, 0.0)
    density = weight / np.maximum(words, 1.0)
    return np.stack([np.ones_like(weight), np.log1p(weight), np.sqrt(density), density], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; without both labels, the prior alone."""
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[0] = -4.0 if len(y) == 0 or y.max() == 0 else 4.0
        return w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """doc_id, text and label of at most `bound` labelled documents that aren't held out, chosen by hash of the id.

    Labels other than 0 and 1 are left out; of a document's several labels the largest counts, of its several rows one.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    usable = usable.filter(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # at most `bound` pairs of numbers: small enough to send everywhere
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def _counts(sample: DataFrame, keys_of, name: str) -> DataFrame:
    """(key, pos, neg): each task adds up its documents' distinct keys, in tables of bounded size."""

    def run(batches):
        import pandas as pd

        total: tuple[Counter, Counter] = (Counter(), Counter())

        def emptied():
            for label in (0, 1):
                held = total[label]
                keys = pd.Series(list(held), dtype=object)
                yield pd.DataFrame({name: keys, "label": np.full(len(keys), label, np.int32), "n": np.fromiter(held.values(), np.int64, len(keys))})
                held.clear()

        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                total[label].update(keys_of(text or ""))
                if len(total[0]) + len(total[1]) > HELD:
                    yield from emptied()
        yield from emptied()

    raw = sample.select("text", "label").mapInPandas(run, f"{name} string, label int, n long")
    return raw.groupBy(name).agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))


def beginnings(text: str) -> set[str]:
    """Distinct candidates of a text: word beginnings and whole words."""
    out = set()
    for w in set(WORDS(folded(text))):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """A model from at most `bound` labelled documents; without labels of both kinds, the seed words under a set curve."""
    sample = sampled(docs, labels, label, bound).persist()
    try:
        sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
        pos, neg = sizes.get(1, 0), sizes.get(0, 0)
        if not pos or not neg:
            return Model({f" {w} ": SEED_WEIGHT for w in SEED}, frozenset(), UNTAUGHT)
        log_odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
        often = _counts(sample, beginnings, "entry").filter((F.col("pos") >= SUPPORT) | (F.col("neg") >= SUPPORT) | F.col("entry").isin([f" {w} " for w in SEED]))
        found = written(often).withColumn("w", log_odds)
        top = found.filter((F.col("pos") >= SUPPORT) & (F.col("w") >= math.log(LIFT)))
        rows = top.collect()
        seen = {r["entry"]: r["w"] for r in found.filter(F.col("entry").isin([f" {w} " for w in SEED])).collect()}
        learned = prune({r["entry"]: (r["pos"], r["neg"], r["w"]) for r in rows})
        seeds = {f" {w} ": SEED_WEIGHT for w in SEED if seen.get(f" {w} ", 1.0) > 0 and not any(f" {w} ".startswith(e) for e in learned)}
        entries = seeds | learned
        # longer words under an entry that don't mark toxic documents override it
        stems = tuple(e for e in entries if not e.endswith(" "))
        harmless = found.filter((F.col("neg") >= SUPPORT) & (F.col("w") < math.log(LIFT) / 2) & F.col("entry").rlike(" $"))
        under = F.lit(False)
        by_length: dict[int, list[str]] = {}
        for s in stems:
            by_length.setdefault(len(s), []).append(s)
        for n, group in by_length.items():
            under = under | F.substring("entry", 1, n).isin(group)
        for r in harmless.filter(under).collect():
            entries[r["entry"]] = 0.0
        raw = tuple(sorted(entries.items()))

        def around(text: str) -> set[str]:
            built, words = automaton(raw, frozenset()), line(text)
            out = set()
            for start, _, weight in hits(words, built):
                before = words.rfind(" ", 0, start)
                if weight and before >= 0:
                    out.add(words[before : words.find(" ", start + 1) + 1])
            return out

        exempt = _counts(sample, around, "phrase").withColumn("w", log_odds).filter((F.col("neg") >= SUPPORT) & (F.col("w") < math.log(LIFT) / 2))
        phrases = frozenset(r["phrase"] for r in exempt.collect())

        def measure(batches):
            import pandas as pd

            built = automaton(raw, phrases)
            for pdf in batches:
                got = [measures(t or "", built) for t in pdf["text"]]
                yield pd.DataFrame({"label": pdf["label"], "weight": [g[0] for g in got], "words": [g[1] for g in got]})

        got = sample.select("text", "label").mapInPandas(measure, "label int, weight double, words double").toPandas()
        got = got.sort_values(["label", "weight", "words"])
        curve = fit_curve(features(got["weight"].to_numpy(float), got["words"].to_numpy(float)), got["label"].to_numpy(float))
        return Model(entries, phrases, tuple(curve.tolist()))
    finally:
        sample.unpersist()


def prune(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Entries that say more than a shorter one already kept: weight by entry."""
    kept: dict[str, float] = {}
    stats: dict[str, tuple[int, float]] = {}
    for entry in sorted(found, key=lambda e: (len(e), e)):
        pos, _, w = found[entry]
        shorter = next((entry[:k] for k in range(len(entry) - 1, SHORTEST, -1) if entry[:k] in stats), None)
        if shorter is None or abs(w - stats[shorter][1]) > 1.0 and pos >= SUPPORT:
            kept[entry] = float(w)
            stats[entry] = (pos, w)
    return kept


def score(docs: DataFrame, model: Model, threshold: float = 0.5, *keep: str) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= threshold), n_hits, and the columns named in keep, of every row of docs.

    Null and empty texts score as texts without hits; repeated rows stay repeated; an empty table gives
    an empty result; other columns are not read.
    """
    entries, phrases, curve = tuple(sorted(model.entries.items())), model.phrases, np.array(model.curve)

    def make():
        built = automaton(entries, phrases)

        def work(ids, texts, *rest):
            weight, words, n = np.zeros(len(texts)), np.zeros(len(texts)), []
            for k, text in enumerate(texts):
                own = line(text)
                found = hits(own, built)
                weight[k], words[k] = sum(h[2] for h in found), own.count(" ") - 1.0
                n.append(sum(1 for h in found if h[2] > 0))
            p = 1 / (1 + np.exp(-np.clip(features(weight, words) @ curve, -30, 30)))
            out = {"doc_id": ids, "score": p.tolist(), "predicted": (p >= threshold).astype(int).tolist(), "n_hits": n}
            return out | {"text": texts} | dict(zip(keep, rest, strict=True)) if with_text else out

        return work

    with_text = bool(keep)
    schema = "doc_id long, score double, predicted int, n_hits long"
    if keep:
        types = dict(docs.dtypes)
        schema += ", text string" + "".join(f", `{c}` {types[c]}" for c in keep)
    return map_texts(docs, make, schema, *keep)
