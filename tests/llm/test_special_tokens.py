import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_tokens import BYTES, ODD, WORDS, random_texts
from valograph.llm import catalog
from valograph.llm.tokens import Encoder

HELD = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>  x", "A<|startoftext|>b \n<|endoftext|>\n\n c", "<|ENDOFTEXT|> <|endoftext", "é<|endoftext|>́ y", "<|endoftext|> " * 50]


def unmodified(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_ids_equal_those_of_an_unmodified_tokenizer(path, spaced, monkeypatch):
    monkeypatch.setattr("valograph.llm.tokens.REMEMBERED", 40)
    e = Encoder(path, spaced, special=True)
    for texts in (HELD, ODD + random_texts(), HELD[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [unmodified(path, t) for t in texts]


def test_capitals_before_combining_marks_are_composed_first():
    texts = ["H\u0331", "T\u0308 t\u0308", "xW\u030a A", "Y\u030a\u0301 Y", "J\u030c <|endoftext|>J\u030c", "T\u0344", "T\u0321\u0308", "E\u0301 PLAIN"]
    found = Encoder(WORDS, False, special=True).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [unmodified(WORDS, t) for t in texts]


def test_queries_give_special_tokens_their_ids(spark, tmp_path):
    rows = list(enumerate(HELD + ["plain text"]))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda path, end: {i: zlib.crc32(np.array([*unmodified(path, t), end], "<u4").tobytes()) for i, t in rows}
    assert {x.doc_id: x.ids_crc32 for x in catalog.op3_best_fit_packing(spark, str(tmp_path)).collect()} == crc(BYTES, 0)
    assert {x.doc_id: x.ids_crc32 for x in catalog.op10_token_id_output(spark, str(tmp_path)).collect()} == crc(WORDS, 2)
