"""Token ids in Arrow stream files of fixed-size lists.

A file is one Arrow IPC stream of record batches with equal numbers of
equal-length sequences, so sequence ``i`` is row ``i % rows`` of batch
``i // rows`` and can be read from a memory map or any buffer without a copy.
Its columns are the ids, a bit mask of the places that hold a token, and a bit
mask of the places where a document ends.  Documents never cross files.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.store import materialize, scratch_path
from .chunk_ids import HELD_BYTES, Generations, byte_letters, encode_lists, even, split_at_spaces, with_others
from .common import buckets, documents, in_worker, python_ready, text_or_empty

#: Ids in a sequence, sequences in a record batch, and ids after which a file is closed.
LENGTH, BATCH_SEQUENCES, FILE_IDS = 1024, 256, 4 << 20


#: A word, with the space before it, and the marks after it: the byte-level pattern always cuts between the two.
WORD_AND_MARKS = re.compile(r"( ?[^\W\d_]+)([!-&(-/:-@\[-`{-~]+)?")


class LibraryEncoder:
    """A tokenizer of the tokenizers library; its byte-level kind gets every distinct chunk once.

    The ids are those of ``encode(text, add_special_tokens=False)``: a text that holds the string of an added token
    gets that token's id, so it goes to the library whole, as do texts with two white-space characters in a row.
    """

    def __init__(self, tokenizer_json: str, held_bytes: int = HELD_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        told = json.loads(tokenizer_json)
        split = told.get("pre_tokenizer") or {}
        self.added = "|".join(re.escape(t["content"]) for t in told.get("added_tokens", ()))
        self.chunked = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
            and split.get("use_regex", True) and not told.get("normalizer"))
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.letters = byte_letters()
        self.words = Generations(held_bytes, self._letters)
        self.others = Generations(held_bytes, self._library)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        shown = "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _ids(self, chunk: str) -> bytes:
        cut = WORD_AND_MARKS.fullmatch(chunk)
        if not cut or not cut[1].lstrip(" ").isalpha():
            return self.others[chunk]
        word, marks = cut.groups()
        return self.words[word] + self.others[marks] if marks else self.words[word]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin; nulls have none."""
        texts = pc.fill_null(texts, "")
        fit = even(texts, self.added) if self.chunked else np.zeros(len(texts), bool)
        ids, starts = encode_lists(split_at_spaces(pc.if_else(pa.array(fit), texts, "")), self._ids)
        ids, starts = with_others(ids, starts, {
            i: np.frombuffer(self._library(texts[i].as_py()), "<u4") for i in np.flatnonzero(~fit).tolist()})
        return ids.astype(self.width), starts


def pack_file(docs: list[tuple[object, np.ndarray]], start: int, part: int, number: int, length: int = LENGTH) -> bytes:
    """The bytes of one file; ``start`` counts the part's ids before it."""
    sizes = [len(ids) for _, ids in docs]
    total = sum(sizes)
    rows = max(1, -(-total // length))
    ids = np.zeros(rows * length, docs[0][1].dtype if docs else np.uint16)
    ids[:total] = np.concatenate([x for _, x in docs]) if docs else 0
    mask, ends = np.zeros((2, rows * length), bool)
    mask[:total] = True
    ends[np.cumsum(sizes, dtype=np.int64) - 1] = True
    bits = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(x)), length // 8)
    told = {"start": start, "part": part, "number": number, "length": length, "docs": [d for d, _ in docs]}
    table = pa.record_batch(
        [pa.FixedSizeListArray.from_arrays(pa.array(ids), length), bits(mask), bits(ends)], names=["ids", "mask", "ends"],
        metadata={"sequences": json.dumps(told)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        for at in range(0, rows, BATCH_SEQUENCES):
            out.write_batch(table.slice(at, BATCH_SEQUENCES))
    return sink.getvalue().to_pybytes()


class SequenceFile:
    """Random access to the sequences of one file: any buffer, bytes, or a memory map."""

    def __init__(self, source):
        reader = pa.ipc.open_stream(source)
        self.about = json.loads(reader.schema.metadata[b"sequences"])
        self.batches = list(reader)
        self.length = self.about["length"]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _row(self, column: int, i: int) -> np.ndarray:
        batch = self.batches[i // BATCH_SEQUENCES].column(column)
        width = batch.type.list_size
        at = (batch.offset + i % BATCH_SEQUENCES) * width
        return batch.values.to_numpy(zero_copy_only=True)[at:at + width]

    def ids(self, i: int) -> np.ndarray:
        return self._row(0, i)

    def mask(self, i: int) -> np.ndarray:
        return np.unpackbits(self._row(1, i)).view(bool)

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """(id, ids before it in its part, ids) of every document, from the masks."""
        whole = lambda c: np.concatenate([b.column(c).flatten().to_numpy() for b in self.batches])
        mask, ends = (np.unpackbits(whole(c)).view(bool) for c in (1, 2))
        ids, stops = whole(0)[mask], np.flatnonzero(ends[mask]) + 1
        start = 0
        for doc, stop in zip(self.about["docs"], stops.tolist()):
            yield doc, self.about["start"] + start, ids[start:stop]
            start = stop


def write_token_files(docs: DataFrame, tokenizer_json: str, path: str, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append ``end_id``, and write files in ascending id order.

    Parts are ranges of ids, each written by one task; rows that tie in their id are ordered
    by a hash of their text, which also splits an id that many rows share.
    Null and empty texts are one ``end_id``; null ids come first; no rows give no files.
    Each file is one row of Spark's text writer, whose line end follows the
    stream's end mark and is never read; so any store that Spark writes will
    do, and files of a lost or repeated task are not committed.
    """
    spark = docs.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = in_worker(("tokenizer", hash(shared.value)), lambda: LibraryEncoder(shared.value))
        part = TaskContext.get().partitionId()
        end = np.array([end_id], own.width)
        held, held_ids, start, number = [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([pack_file(held, start, part, number)], pa.binary())], names=["file"])

        for batch in batches:
            found, starts = own.encode(batch["text"])
            for doc, a, b in zip(batch["id"].to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                held.append((doc, np.concatenate([found[a:b], end])))
                held_ids += b - a + 1
                if held_ids >= FILE_IDS:
                    yield closed()
                    start, number, held, held_ids = start + held_ids, number + 1, [], 0
        if held:
            yield closed()

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    tie = F.xxhash64("text")
    files = (
        rows.repartitionByRange(buckets(spark), F.col("id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("id").asc_nulls_first(), tie).mapInArrow(pack, "file binary")
    )
    files.select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The only thing gathered is one total for each part, as many as there were writing tasks.
    """
    python_ready(spark)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                file = SequenceFile(content.as_buffer())
                rows = [(file.about["part"], doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for doc, start, ids in file.documents()]
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "id", "start", "n_tokens", "ids_crc32"), r)) for r in rows])

    files = spark.read.format("binaryFile").load(path).select("content")
    told = materialize(files.mapInArrow(
        unpack, f"part bigint, id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"), "tokens")
    totals = told.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r["n"] for r in totals], dtype=np.int64)]).tolist()
    offsets = spark.createDataFrame(
        [(r["part"], b) for r, b in zip(totals, before)], "part bigint, before bigint")
    return told.join(offsets, "part").select(
        "id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    path = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), tokenizer, path)
    return read_token_files(spark, path).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_token_files": op4_token_files}
