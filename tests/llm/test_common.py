import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.llm import byte_bpe, tokens
from scorewright.llm.common import ENTRY_BYTES, PieceCache, Scratch, offsets, only, row_slices, word_hashes


def test_memo_keeps_what_was_used_lately():
    made = []
    cache = PieceCache(lambda x: made.append(x) or x * 2, "test", 3 * (ENTRY_BYTES + 3))
    assert [cache[k] for k in ("1", "2", "3", "4", "2", "5", "6", "7", "2")] == ["11", "22", "33", "44", "22", "55", "66", "77", "22"]
    assert made.count("2") == 1 and len(cache) <= 3 and len(cache.old) <= 3


def test_memo_is_bounded_by_bytes():
    """Long pieces leave nothing behind, and the estimate of an entry's size is not below what Python takes."""
    cache = PieceCache(lambda x: x.encode(), "test", 1 << 20)
    for k in range(300):
        assert len(cache["x" * 20_000 + str(k)]) >= 20_000
    assert not cache and not cache.old
    for k in range(50_000):
        cache[f"piece {k}"]
    taken = sum(sys.getsizeof(d) + sum(sys.getsizeof(x) + sys.getsizeof(y) for x, y in d.items()) for d in (cache, cache.old))
    assert 0 < taken < 2.2 * (1 << 20)
    only("another")
    assert not cache and not cache.old and not cache.held


def test_blank_free_texts_stay_out_of_the_encoders_memos():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    rng = np.random.default_rng(1)
    texts = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 3000)) for _ in range(20)]
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tool = tokens.Encoder(f.read())
    for text in texts:
        tool.encode(text)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        matrix = byte_bpe.ByteBpe(byte_bpe.read_ranks(f.read()), public_tokenizers.PATTERN)
    matrix.encode(texts)
    assert all(m.held == 0 and not m.old for m in (tool.cache, tool.after_blank, matrix.memo))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(st.sampled_from("ab AB\t\x0b\n\x85é 1.")), max_size=8))
def test_word_hashes(texts):
    coded = [t.encode() for t in texts]
    hashes, counts = word_hashes(coded)
    words = [w for t in coded for w in t.lower().split()]
    assert counts.tolist() == [len(t.lower().split()) for t in coded] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
    assert (np.concatenate([word_hashes([t])[0] for t in [b"", *coded]]) == hashes).all()


def test_word_hashes_of_long_texts():
    text = b"word and another " * 20_000
    hashes, (count,) = word_hashes([text])
    assert count == 60_000 and len(set(hashes.tolist())) == 3


def test_slices_hold_few_rows_and_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 1000] * 10 + ["b" * 100_000] * 3 + ["c"] * 10})
    parts = list(row_slices(iter([batch, batch.slice(0, 0)]), rows=8, chars=50_000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert all(p.num_rows == 1 or (p.num_rows <= 8 and p.nbytes <= 50_000) for p in parts)


def test_offsets_and_scratch(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.createDataFrame([(3, 5), (1, 2), (2, 7)], "part long, n long"), "t")
    assert {tuple(r) for r in offsets(kept, "part", "n", "before").collect()} == {(1, 0), (2, 2), (3, 9)}
    assert offsets(kept.limit(0), "part", "n", "before").collect() == []
    scratch.keep(kept.withColumn("k", F.col("part") % 2), "u", by=("k",))
    assert spark.read.parquet(scratch.path("u")).filter("k = 1").count() == 2
    scratch.drop("t", "u")
