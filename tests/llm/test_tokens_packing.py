import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from spindrift.llm.packing import ChunkEncoder, lengths_of, pack  # noqa: E402
from spindrift.llm.tokens import PieceCounter, count_tokens  # noqa: E402

PIECE, WORD = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b\n\n", "<s>x</s>", "é" * 900, "a" * 3000, "日本語 😀 ﬁ", "\x00\x1c\x85 ​▁x", "It's we'LL 12½ <|endoftext|>y", "the " * 200, " \t\r\n", "İΣς ÀÉ'LL"]


def noise(n):
    random.seed(7)
    signs = " \n\t▁aabcdeghinorst'sSLlé日½12.,-<|>_\x1c\xa0ÀÇ"
    return ["".join(random.choice(signs) for _ in range(random.randint(0, 70))) for _ in range(n)]


def test_counts_are_the_librarys():
    import sentencepiece

    lib, texts = sentencepiece.SentencePieceProcessor(model_file=PIECE), ODD + noise(3000)
    assert PieceCounter(PIECE).count_texts(texts) == [len(x) for x in lib.encode(texts, num_threads=1)]


def test_runs_of_any_length():
    import base64

    import sentencepiece

    random.seed(3)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    runs = ["".join(random.choice(signs) for _ in range(n)) for signs in ("ab", "=-*#", "abcdefghijklmnopqrstuvwxyz") for n in (15, 16, 17, 767, 768, 769, 5000)]
    runs += ["ab" * 100, "the" * 120, "x" * 300, "=" * 40_000, base64.b64encode(random.randbytes(60_000)).decode()]
    assert PieceCounter(PIECE).count_texts(runs) == [len(x) for x in lib.encode(runs, num_threads=1)]


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    lib, texts = Tokenizer.from_file(WORD), ODD + noise(3000)
    assert [x.tolist() for x in ChunkEncoder(WORD).ids(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_lengths():
    assert lengths_of(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1] and lengths_of(1, 4096) == [1] and lengths_of(4095, 4096)[0] == 2048
    assert all(sum(lengths_of(n, 64)) == n for n in range(1, 500))


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    lib, texts = Tokenizer.from_file(WORD), [*ODD, None, "word " * 9000, "same text", "same text"]
    rows = pack(docs(*texts), WORD).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert all(r["length"] == 1 << r["bucket"] and r["doc_tokens"] == len(ids) for r in own)
        assert own[0]["ids_crc32"] == zlib.crc32(np.array(own[0]["ids"], "<u4").tobytes())
    assert pack(docs(), WORD).collect() == [] and "ids" not in pack(docs(), WORD, with_ids=False).columns
    with pytest.raises(ValueError):
        pack(docs(), WORD, longest=100)


def test_count_operator(docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(docs("é b", None, "x " * 5000), PIECE).collect()}
    assert got[0] == (4, 2, False) and got[1] == (0, 0, False) and got[2][2]
    assert count_tokens(docs(), PIECE).collect() == []
