"""Texts in compressed blocks: single rows that can be shuffled and met by what is known of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: Stands for a null id: never smaller than another.
NO_ID = (1 << 63) - 1


def pack_blocks(docs: DataFrame) -> DataFrame:
    """Rows (block, ids, sizes, blob) of documents (id, text binary), in each block by id."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        zip_up = zstandard.ZstdCompressor(level=3).compress

        def closed() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            name = (TaskContext.get().partitionId() << 32) + number
            return pa.record_batch([
                pa.array([name], pa.int64()), pa.array([[i for i, _ in held]], pa.list_(pa.int64())),
                pa.array([[len(t) for _, t in held]], pa.list_(pa.int64())),
                pa.array([zip_up(b"".join(t for _, t in held))], pa.binary())], names=["block", "ids", "sizes", "blob"])

        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                held.append((NO_ID if i is None else i, text or b""))
                size += len(held[-1][1])
                if size >= BLOCK_BYTES:
                    yield closed()
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    return docs.mapInArrow(pack, "block bigint, ids array<bigint>, sizes array<bigint>, blob binary")


def unpack(blob: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, size))
