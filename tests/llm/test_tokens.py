"""Token counts and packing against the tokenizer libraries themselves."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from quarry.llm.packing import encoder, pack, plan
from quarry.llm.token_counts import PieceCounter, count_tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "\n", "<s>", "\t x", "▁a", "h\u0000x", "a   ", "漢字😀", "<|endoftext|> x<|endoftext|>", "don't 12 34's", "x" * 5000, "naïve\r\n\r\n  y"]


def noise(n: int) -> list[str]:
    rng = random.Random(5)
    return ["".join(rng.choice("ab cé \n\t▁漢😀<s>'.,thein12\r") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_merging_counts_as_the_library_does():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(PIECES))
    counter = PieceCounter(str(PIECES), most=50)  # small, so that parts are forgotten too
    for text in ODD + noise(3000):
        assert counter.count(text) == len(model.encode(text)), text


def test_encoder_gives_the_library_ids():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(str(BYTES)), encoder(str(BYTES))
    for text in ODD + noise(3000):
        assert own(text) == library.encode(text, add_special_tokens=False).ids, text


def test_count_tokens_rows(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, None), (3, "")], "doc_id long, text string").selectExpr("*", "'x' as i", "1 as n", "2 as t")
    got = sorted(map(tuple, count_tokens(docs, str(PIECES), 1).collect()), key=str)
    assert got == sorted([(1, 7, 2, True), (1, 7, 2, True), (None, 0, 0, False), (3, 0, 0, False)], key=str)
    assert count_tokens(docs.limit(0), str(PIECES), 1).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    for window in (16, 64):
        lengths = np.concatenate([rng.integers(1, window + 1, 300), np.full(200, 7)])
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
        got = plan(histogram, window)
        assert got.groupby("length")["n"].sum().to_dict() == histogram
        cells = [(s + k, o, x) for x, n, s, o in got[["length", "n", "sequence", "offset"]].itertuples(index=False) for k in range(n)]
        for _, g in pd.DataFrame(cells, columns=["s", "o", "x"]).sort_values(["s", "o"]).groupby("s"):
            assert (g.o.to_numpy() == np.concatenate([[0], g.x.cumsum()[:-1]])).all() and g.x.sum() <= window


@pytest.mark.parametrize("window", [16, 64])
def test_pack_keeps_every_id_once(spark, window):
    from tokenizers import Tokenizer

    texts = [*ODD, None, *noise(60), *["the same tail"] * 80]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "0 as length", "0 as salt")
    got = pack(docs, str(BYTES), window=window).toPandas()
    library = Tokenizer.from_file(str(BYTES))
    for k, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == k].sort_values("start")
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length, strict=True)] == list(mine.ids_crc32)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all() and g.length.sum() <= window
    filled = got.groupby("sequence_id").length.sum()
    assert filled.sum() / (len(filled) * window) > 0.9
    assert pack(docs.limit(0), str(BYTES)).count() == 0
