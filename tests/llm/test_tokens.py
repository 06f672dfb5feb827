import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from valograph.llm.packing import packed, pieces, plan, sequences
from valograph.llm.shared import written
from valograph.llm.simple8b import BLOCK, decode, encode
from valograph.llm.tokenfiles import read_tokens, write_tokens
from valograph.llm.tokens import Encoder, public_path

BYTES, WORDS = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string"
ODD = ["", " ", "  a  b ", "\n\n x\n y  z　 w ", "it's I'LL 'S", "<|endoftext|> <|startoftext|>", "é ́x ÉÈ Σας ΣΑΣ İ", "a\tb\r\nc\x0bd\x0ce\x1cf\x85g", "…  … x", "x" * 9000, "日本語 テスト 1234567 12.5%", "tail   ", "​ z"]


def whole(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def random_texts(n=60):
    r = random.Random(9)
    parts = ["the", "The", " ", "  ", "\n", "\n\n", "\t", "é", "1", "99", ".", "...", "'s", "don't", " ", "ß", "日本", "\r\n", "_", "-"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("path,spaced", [(BYTES, True), (WORDS, False)])
def test_chunks_encode_like_the_whole_text(path, spaced):
    texts = ODD + random_texts()
    found = Encoder(path, spaced).encode([*texts, None])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [whole(path, t, 0)[:-1] for t in [*texts, ""]]


def rows():
    r = random.Random(2)
    texts = ODD + random_texts() + [" ".join(f"word{r.randrange(99)}" for _ in range(r.randrange(1, 1500))) for _ in range(40)]
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)] + [(3, None), (None, "no id"), (3, "again"), (3, "again")]


def test_packing_places_every_piece_once_and_tightly(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("offset", F.lit(1))
    got = packed(written(pieces(df, BYTES), "cut")).collect()
    by_doc, by_sequence = {}, {}
    for p in got:
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        assert len(ids) == p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault(p.doc_id, []).append((p.piece, p.start, ids))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    total = sum(p.length for p in got)
    assert len(by_sequence) <= total // 2048 + 2
    for doc_id, text in rows():
        if doc_id not in (3, None):
            parts = sorted(by_doc[doc_id])
            assert sum((ids for *_, ids in parts), []) == whole(BYTES, text, 0)
            assert all(len(ids) == 2048 for *_, ids in parts[1:])
    assert sum(len(v) for k, v in by_doc.items() if k == 3) == 3 + sum(d == 3 for d, _ in rows()[:-4])
    full = sequences(packed(written(pieces(df, BYTES), "cut"))).collect()
    assert sum(len(bytes(s.ids)) // 4 for s in full) == total


def test_plan_is_as_tight_as_best_fit_one_by_one():
    r = random.Random(1)
    for _ in range(30):
        counts = {r.randrange(1, 65): r.randrange(1, 40) for _ in range(r.randrange(1, 30))}
        rooms = []
        opened = 0
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = [x for x in rooms if x >= length]
                if fit:
                    rooms.remove(min(fit))
                    rooms.append(min(fit) - length)
                else:
                    opened += 1
                    rooms.append(64 - length)
        used = {}
        for length, rank, slots, first, many, offset in plan(counts, 64):
            for k in range(slots):
                used.setdefault(first + k % many, []).append((offset + length * (k // many), length))
        assert len(used) <= opened
        assert sum(map(len, used.values())) == sum(counts.values())
        for parts in used.values():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 64
    assert plan({}) == []


def test_simple8b_round_trip():
    r = np.random.default_rng(3)
    for n in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 20_000):
        v = (r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) >> r.integers(0, 64, n).astype(np.uint64)
        v[n // 3 : n // 2] = 0
        words, per_block, escapes, _ = encode(v)
        assert (decode(words, per_block, escapes, n) == v).all()


def test_token_files_round_trip(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("n_ids", F.lit("x")).repartition(5)
    got = read_tokens(write_tokens(df, WORDS)).collect()
    assert sorted((x.doc_id, zlib.crc32(bytes(x.ids))) for x in got if x.doc_id not in (None,)) == sorted((d, zlib.crc32(np.array(whole(WORDS, t, 2), "<u4").tobytes())) for d, t in rows() if d is not None)
    got.sort(key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((d for d, _ in rows() if d is not None)) + [None]
    assert [x.start for x in got] == [sum(y.n_tokens for y in got[:i]) for i in range(len(got))]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert read_tokens(write_tokens(empty, WORDS)).count() == 0
    assert packed(written(pieces(empty, BYTES), "cut")).count() == 0


def test_rows_of_one_id_have_the_same_places_in_every_run(spark):
    rows = [(7, f"text number {i % 40} of many") for i in range(120)] + [(None, f"nameless {i}") for i in range(30)] + [(3, None), (3, ""), (9, "last")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    runs = []
    for parts in (1, 5, 3):
        manifest = write_tokens(frame.repartition(parts), public_path("word_bpe_49k.json"))
        runs.append(sorted((x.start, x.doc_id is None, x.doc_id, bytes(x.ids)) for x in read_tokens(manifest).collect()))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)
    ids = [x[2] for x in runs[0]]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
