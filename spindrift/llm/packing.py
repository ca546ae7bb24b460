"""Packing by power-of-two decomposition.

A document of n tokens becomes pieces whose lengths are the binary digits of n,
largest first, with nothing above the longest sequence.  Pieces of one length share a
bucket, and every piece is a sequence of its own: no sequence crosses
documents, and none holds padding, as each length is a power of two.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import REMEMBERED, WordMemory, map_texts

#: Bytes of text that a worker cuts at a time: of words that come twice in them, one is merged.
PORTION = 8_000_000
#: The id that ends each document.
END = 2


#: In Latin-1 texts: what the tokenizer's Unicode classes hold, after lower-casing.
BLANK, LETTER, DIGIT = "\t\n\x0b\x0c\r \x85\xa0", "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{BLANK}{LETTER}{DIGIT}]+").findall


class ChunkEncoder:
    """Token ids by the tokenizers library, remembered by pre-token (Latin-1 texts) or by chunk between blanks (others).

    The tokenizer lower-cases, drops white space and never joins what its pre-tokenizer
    parts, so the ids of a text are those of its parts in turn; loading compares probes with
    the library and raises ValueError for a tokenizer of another kind.  A text that may hold a special
    string isn't lower-cased here: the library looks for those before it changes case.
    """

    def __init__(self, path: str, remember: int = REMEMBERED):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.merge = whole.encode_batch_fast, whole.model.tokenize
        # the model sees bytes as characters: printable ones as they are, others above 255 in order
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        as_char = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(other)}
        self.shown = {c: "".join(as_char[b] for b in chr(c).encode()) for c in range(256)}
        self.cache = WordMemory(remember)
        probes = ["It's  a Test\n\tof <|endoftext|>x, 12 34\r\n café", " a ", "", "ÀÉ'LL''s.\x1c.½ÿ <|EndOfText|>", "日本 x\x85y\xa0ªº'"]
        if [x.tolist() for x in self.ids(probes)] != [e.ids for e in self.encode(probes, add_special_tokens=False)]:
            raise ValueError(f"{path}: not a tokenizer whose parts can be encoded on their own")

    @staticmethod
    def cut(text: str) -> tuple[list[str], bool]:
        """The parts of a text, and whether they are pre-tokens."""
        if "<|" not in text:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return PRETOKENS(text.lower()), True
        return text.replace("\n", " ").replace("\t", " ").split(" "), False

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, by the tokenizer's model alone."""
        out = []
        for word in words:
            own = [t.id for t in self.merge(word.translate(self.shown))]
            out.append(pack_ids(f"<{len(own)}I", *own))
        return out

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), 20_000):
            out += [pack_ids(f"<{len(e.ids)}I", *e.ids) for e in self.encode(chunks[at : at + 20_000], add_special_tokens=False)]
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cache = self.cache
        cache.begin()
        cut = [self.cut(t) for t in texts]
        found = [list(map(cache.get, words)) for words, _ in cut]
        lacking = [n for n, parts in enumerate(found) if None in parts]
        cache.learn({w for n in lacking if cut[n][1] for w in cut[n][0]}, self._merged)
        cache.learn({w for n in lacking if not cut[n][1] for w in cut[n][0]}, self._encoded)
        for n in lacking:
            found[n] = list(map(cache.__getitem__, cut[n][0]))
        return [np.frombuffer(b"".join(parts), "<u4") for parts in found]


@lru_cache(maxsize=2)
def encoder(path: str, remember: int) -> ChunkEncoder:
    """One for each worker process, kept over its tasks."""
    return ChunkEncoder(path, remember)


def lengths_of(n: int, longest: int) -> list[int]:
    """Powers of two that sum to n: as many of `longest` as fit, then the binary digits of the rest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = 4096, with_ids: bool = True, remember: int = REMEMBERED, portion: int = PORTION) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and ids on request.

    longest is a power of two; remember bounds the words that a worker keeps ids of, portion the bytes of text it takes at a time (memory against speed).  bucket is log2 of the length: sequences of one bucket batch
    together without padding.  Each piece is one sequence at offset 0.  A null or empty text
    is the end id alone; repeated rows are packed each; an empty table packs to nothing;
    other columns are not read.  sequence_id is unique and, for one input layout, the
    same on a rerun of any task.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def make():
        encode = encoder(tokenizer, remember).ids

        def work(ids, texts):
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            kept = []
            for doc, own in zip(ids, encode(texts), strict=True):
                own = np.append(own, np.uint32(END)).astype("<u4")
                data, start = own.tobytes(), 0
                for n in lengths_of(len(own), longest):
                    out["doc_id"].append(doc)
                    out["start"].append(start)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(data[4 * start : 4 * (start + n)]))
                    out["doc_tokens"].append(len(own))
                    start += n
                if with_ids:
                    kept.append(own)
            if with_ids:
                ends = np.cumsum([0, *out["length"]]).astype(np.int32)
                flat = np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            return out

        return work

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return (
        map_texts(docs, make, schema, most=portion)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
        .withColumn("bucket", F.log2(F.col("length")).cast("int"))
    )
