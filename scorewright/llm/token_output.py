"""Token ids of whole documents as Simple-8b segments in doc_id order, and back.

The documents are range-partitioned by doc_id and sorted; each task tokenises its run of documents and emits
segments of bounded size. A segment row holds the coded ids and the documents' ids and lengths, so its place in the
global stream needs only the totals of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import simple8b
from scorewright.llm.common import Scratch, offsets, row_slices, shuffle_parts
from scorewright.llm.tokens import encoder, read_definition

#: Ids after which a segment is closed at the next document's end.
SEGMENT_IDS = 1 << 18
SEGMENT_SCHEMA = "part long, seq int, first long, n_ids long, doc_ids array<long>, lengths array<long>, ids binary"


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written segments (SEGMENT_SCHEMA), (part, seq) in doc_id order; `first` counts the ids of the part before the segment.

    Null text: the end id alone. Null doc_id: sorts first. Repeated ids: each row is a document of its own, ordered by
    text hash. Empty table: no segments. A text of any length lies whole in one segment.
    Other columns, whatever their names, are ignored."""
    definition = read_definition(docs.sparkSession, tokenizer_path)
    end = np.array([end_id], "<u4").tobytes()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, part, seq, first = encoder(definition.value), TaskContext.get().partitionId(), 0, 0
        doc_ids, streams, held = [], [], 0

        def close() -> pa.RecordBatch:
            lengths = [len(x) // 4 for x in streams]
            ids = np.frombuffer(b"".join(streams), "<u4")
            row = {"part": [part], "seq": [seq], "first": [first], "n_ids": [len(ids)], "doc_ids": [list(doc_ids)], "lengths": [lengths], "ids": [simple8b.encode(ids)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int64()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())]))

        for rows in row_slices(batches):
            coded = tool.encode_all([text or "" for text in rows.column(1).to_pylist()])
            for doc_id, ids in zip(rows.column(0).to_pylist(), coded, strict=True):
                doc_ids.append(doc_id)
                streams.append(ids + end)
                held += len(streams[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield close()
                    doc_ids, streams, seq, first, held = [], [], seq + 1, first + held, 0
        if doc_ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(shuffle_parts(docs.sparkSession), *keys).sortWithinPartitions(*keys)
    return scratch.keep(ordered.mapInArrow(code, SEGMENT_SCHEMA), "segments", "none")


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian uint32) of every document in written segments.

    As they were written: null and repeated doc_ids are a row each, empty texts have their end id alone, a document of any length is put together
    from its segments in order. No segments: no rows."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    located = segments.join(F.broadcast(offsets(totals, "part", "n_ids", "before")), "part")  # a row for each range partition
    schema = "doc_id long, start long, ids binary"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_slices(batches, 1):
            (r,) = rows.to_pylist()
            ids = simple8b.decode(r["ids"]).astype("<u4")
            stop = np.cumsum(np.array(r["lengths"], np.int64))
            begin = stop - np.array(r["lengths"], np.int64)
            out = [ids[a:b].tobytes() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(begin + r["before"] + r["first"], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "start", "ids"])

    return located.select("before", "first", "doc_ids", "lengths", "ids").mapInArrow(decode, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    segments = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 1, Scratch(spark, "tokens"))
    n = (F.octet_length("ids") / 4).cast("long")
    return read_tokens(segments).select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


