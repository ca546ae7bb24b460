"""Token counts by rank-synchronous array merging.

A piece model of the byte-pair kind merges, in a text, the adjacent pair whose
union scores best, leftmost first, until no pair is a piece.  No merge crosses
a place whose two characters stand side by side in no piece, so a text falls
into pre-tokens that merge on their own.  Distinct pre-tokens of a batch are
held as one ragged numpy array; in each round every sequence applies its
lowest-rank pair wherever it stands, and what survives is counted.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import WordMemory, map_texts

#: Bytes of text that a worker counts at a time: rounds over more words at once cost less for each.
PORTION = 8_000_000

SPACE = "▁"
#: Slots of a block; a round looks at the least rank of each block, and at the slots of those blocks alone that hold its sequence's best.
BLOCK = 16
NONE = np.int64(1) << 62


class PieceCounter:
    """Counts the pieces that a byte-pair piece model gives for a text.

    It takes models with identity normalisation, a dummy space in front, byte
    fallback and no user-defined symbols; others raise ValueError at loading.
    """

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        known = [
            (lib.id_to_piece(i), lib.get_score(i))
            for i in range(lib.get_piece_size())
            if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))
        ]
        self.ids = {piece: n for n, (piece, _) in enumerate(known)}
        self.base = len(known) + 1  # the id len(known) stands for any character that is no piece
        # equal scores share a rank, so that among them the leftmost pair goes first
        order = {s: n for n, s in enumerate(sorted({s for _, s in known}, reverse=True))}
        keys, ranks, made = [], [], []
        for piece, score in known:
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.base + right)
                    ranks.append(order[score])
                    made.append(self.ids[piece])
        by = np.argsort(np.array(keys, np.int64))
        self.keys = np.concatenate([np.array(keys, np.int64)[by], [np.iinfo(np.int64).max]])
        self.ranks = np.concatenate([np.array(ranks, np.int64)[by], [0]])
        self.made = np.concatenate([np.array(made, np.int64)[by], [0]])
        if any(SPACE in p.lstrip(SPACE) for p, _ in known):
            raise ValueError("a piece holds a space after another character; pre-tokens can't be cut at spaces")
        lines = not any("\n" in p for p, _ in known)
        self.split = re.compile(r" +[^ \n]*|[^ \n]+|\n+" if lines else r" +[^ ]*|[^ ]+").findall
        self.cache = WordMemory()
        probes = ["", " ", "a  b", "  x\n\n y ", "<s>hi</s>", "über ﬁ ① 日本\U0001f600", "1234 ## aaaaaaa\t\r\n", " x​y"]
        if [self.count(t) for t in probes] != [len(x) for x in lib.encode(probes, num_threads=1)]:
            raise ValueError(f"{path}: its normalisation or symbols are not of the kind that this counter follows")
        self.cache = WordMemory()

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair makes no piece) and made piece of each pair."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def count_words(self, words: list[str]) -> np.ndarray:
        """Pieces of each pre-token."""
        unknown = self.base - 1
        counts = np.zeros(len(words), np.int64)
        rows, symbols, sizes = [], [], []
        get = self.ids.get
        for n, word in enumerate(words):
            own = [get(c, unknown) for c in word.replace(" ", SPACE)]
            if unknown in own:  # byte fallback: an unknown character counts its bytes, of which one is counted as a symbol
                counts[n] += sum(len(c.encode()) - 1 for c, k in zip(word.replace(" ", SPACE), own, strict=True) if k == unknown)
            if own:
                rows.append(n)
                sizes.append(len(own))
                symbols += own
        if rows:
            counts[rows] += self._by_rounds(np.array(symbols, np.int64), np.array(sizes, np.int64))
        return counts

    def _by_rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence; every round applies the best pair of each sequence that still has one.

        All places of the best pair go at once, from the left and without overlap, up to the first merge that makes a
        pair as good: what is behind that waits for the next round, as it would where pairs go one by one.
        Sequences lie in blocks of slots, linked to their neighbours, so a round costs a look at each
        block and work on what it merges, however long a sequence is.
        """
        blocks = -(-sizes // BLOCK)
        first_block = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(sizes)), blocks)
        begin = first_block[:-1] * BLOCK
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(symbols))
        symbol = np.zeros(first_block[-1] * BLOCK, np.int64)
        symbol[at] = symbols
        after, before = np.full(len(symbol), -1), np.full(len(symbol), -1)
        inner = np.flatnonzero(np.diff(np.repeat(np.arange(len(sizes)), sizes)) == 0)
        after[at[inner]], before[at[inner + 1]] = at[inner + 1], at[inner]
        rank = np.full(len(symbol), NONE)
        rank[at[inner]], _ = self.lookup(symbols[inner], symbols[inner + 1])
        by_block = rank.reshape(-1, BLOCK)
        least = by_block.min(1)
        left = sizes.copy()
        live, look = np.arange(len(sizes)), np.arange(len(least))
        while True:
            starts = np.concatenate([[0], np.cumsum(blocks[live])[:-1]])
            best = np.minimum.reduceat(least[look], starts)
            on = best < NONE
            if not on.all():  # finished sequences leave
                look, live, best = look[np.repeat(on, blocks[live])], live[on], best[on]
            if not len(live):
                return left
            goal = np.repeat(best, blocks[live])
            holds = least[look] == goal
            row, column = np.nonzero(by_block[look[holds]] == goal[holds, None])
            here = look[holds][row] * BLOCK + column
            # of places that overlap, every second one from the left
            linked = np.concatenate([[False], after[here[:-1]] == here[1:]])
            place = np.arange(len(here))
            here = here[(place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0]
            there = after[here]
            _, made = self.lookup(symbol[here], symbol[there])
            ahead, behind = before[here], after[there]
            # a neighbour on the left that goes in this round is what it becomes, one on the right is what it still is
            beside = symbol[ahead]
            beside[1:] = np.where(ahead[1:] == there[:-1], made[:-1], beside[1:])
            risky = (ahead >= 0) & (self.lookup(beside, made)[0] <= rank[here])
            risky |= (behind >= 0) & (self.lookup(made, symbol[behind])[0] <= rank[here])
            if risky.any():
                seq = owner[here // BLOCK]
                earlier = np.cumsum(risky) - risky
                keep = earlier == earlier[np.searchsorted(seq, seq)]
                here, there, made = here[keep], there[keep], made[keep]
            symbol[here] = made
            behind = after[there]
            after[here] = behind
            some = behind >= 0
            before[behind[some]] = here[some]
            rank[there] = NONE
            left -= np.bincount(owner[here // BLOCK], minlength=len(left))
            rank[here] = NONE
            ahead = before[here]
            for one in (here[some], ahead[ahead >= 0]):
                rank[one], _ = self.lookup(symbol[one], symbol[after[one]])
            touched = np.concatenate([here, there, ahead[ahead >= 0]]) // BLOCK
            least[touched] = by_block[touched].min(1)

    def cut(self, text: str) -> list[str]:
        return self.split(" " + text.replace(SPACE, " ")) if text else []

    def count_texts(self, texts: list[str]) -> list[int]:
        """Pieces of each text."""
        cache = self.cache
        cache.begin()
        cut = [self.cut(t) for t in texts]
        found = [list(map(cache.get, words)) for words in cut]
        lacking = [n for n, parts in enumerate(found) if None in parts]
        cache.learn({w for n in lacking for w in cut[n]}, lambda new: self.count_words(new).tolist())
        for n in lacking:
            found[n] = map(cache.__getitem__, cut[n])
        return [sum(parts) for parts in found]

    def count(self, text: str) -> int:
        return self.count_texts([text])[0]


@lru_cache(maxsize=2)
def counter(model: str) -> PieceCounter:
    """One for each worker process, kept over its tasks."""
    return PieceCounter(model)


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts count 0 bytes and 0 tokens; repeated rows stay repeated; an
    empty table gives an empty result; other columns are not read.
    """

    def make():
        count_texts = counter(model).count_texts

        def work(ids, texts):
            n = count_texts(texts)
            return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return map_texts(docs, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", most=PORTION)
