"""Token ids in binary files that can be read document by document.

A file is a sequence of zstandard frames, so any zstandard reader can expand it:

* data frames: the ids of some consecutive documents, little endian, each frame on its own
  and with a content checksum;
* a skippable frame (``INDEX_MAGIC``) with the documents: a JSON head and a compressed
  table of document ids and lengths;
* a skippable frame with the seek table, in the layout of zstandard's seekable format:
  compressed size, size and checksum (low 32 bits of XXH64) of each data frame, then the
  number of frames, a descriptor byte and a magic number.

Every record is followed by an empty skippable frame, which Spark's text writer puts there
as its line separator. So the files go through Spark's own commit protocol to any file
system it can write to, and a lost or repeated task leaves no half file behind.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.arrow import in_batches, map_rows
from statloom.llm.vocabulary import vocabulary

# Fixed values of the zstandard formats.
SKIPPABLE_MAGIC = 0x184D2A50
INDEX_MAGIC = 0x184D2A51
SEEK_MAGIC = 0x184D2A5E
SEEKABLE_FOOTER = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0).decode("ascii")
GAP = len(SEPARATOR)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int | None = 0, frame_tokens: int = 1 << 16, level: int = 3) -> None:
    """Encode every whole text and write the ids in ascending order of ``key``, one file per range of keys.

    A NULL text counts as empty, ``end_id`` ends every document. Documents with a NULL key
    come first; rows that repeat a key are kept, in the order of a hash of their texts. A frame holds
    whole documents, at least ``frame_tokens`` ids unless the file ends; a longer document
    is a frame of its own. The number of files follows the shuffle partitions, which
    adaptive execution sizes; an empty table writes no data frame.
    """
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # the sample that cuts the ranges goes through the driver: numbers, no texts
    ordered = ordered.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.binary())])
        for batch in in_batches(((r,) for r in _records(batches, tokenizer, end_id, frame_tokens, level)), schema, 16):
            yield batch

    records = ordered.mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def _records(batches, tokenizer: str, end_id: int | None, frame_tokens: int, level: int) -> Iterator[bytes]:
    """The records of one file."""
    import xxhash
    import zstandard

    vocab = vocabulary(tokenizer)
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
    keys, lengths, frame_docs, seek = [], [], [], []
    held, held_docs, held_tokens = [], 0, 0

    def frame() -> bytes:
        raw = b"".join(held)
        packed = packer.compress(raw)
        seek.append(struct.pack("<III", len(packed) + GAP, len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        frame_docs.append(held_docs)
        return packed

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = vocab.encode(text)
            if end_id is not None:
                ids = np.append(ids, np.uint32(end_id))
            keys.append(key)
            lengths.append(len(ids))
            held.append(ids.astype(vocab.width).tobytes())
            held_docs, held_tokens = held_docs + 1, held_tokens + len(ids)
            if held_tokens >= frame_tokens:
                yield frame()
                held, held_docs, held_tokens = [], 0, 0
    if held:
        yield frame()
    if not keys:
        return
    head = json.dumps({"docs": len(keys), "frame_docs": frame_docs, "nulls": sum(k is None for k in keys), "width": vocab.width.itemsize}).encode()
    table = np.array([0 if k is None else k for k in keys], dtype="<i8").tobytes() + np.array(lengths, dtype="<u4").tobytes()
    body = struct.pack("<I", len(head)) + head + packer.compress(table)
    yield struct.pack("<II", INDEX_MAGIC, len(body)) + body
    tail = b"".join(seek) + struct.pack("<IBI", len(seek), HAS_CHECKSUMS, SEEKABLE_FOOTER)
    yield struct.pack("<II", SEEK_MAGIC, len(tail)) + tail


class TokenFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, content):
        import zstandard

        self._data = memoryview(content)
        self._unpack = zstandard.ZstdDecompressor()
        self._frame: tuple[int, bytes] = (-1, b"")
        end = len(self._data) - GAP
        frames, flags, magic = struct.unpack_from("<IBI", self._data, end - 9)
        if magic != SEEKABLE_FOOTER or flags != HAS_CHECKSUMS:
            raise ValueError("not a token file")
        start = end - 9 - 12 * frames
        self.seek = [struct.unpack_from("<III", self._data, start + 12 * i) for i in range(frames)]
        self.offsets = np.cumsum([0, *(s[0] for s in self.seek)]).tolist()
        magic, size = struct.unpack_from("<II", self._data, self.offsets[-1])
        if magic != INDEX_MAGIC or self.offsets[-1] + 8 + size + GAP + 8 != start:
            raise ValueError("the index of the token file is damaged")
        at = self.offsets[-1] + 8
        (n,) = struct.unpack_from("<I", self._data, at)
        head = json.loads(bytes(self._data[at + 4 : at + 4 + n]))
        table = self._unpack.decompress(self._data[at + 4 + n : at + size], max_output_size=12 * head["docs"])
        keys = np.frombuffer(table, "<i8", head["docs"])
        self.keys = [None] * head["nulls"] + keys[head["nulls"] :].tolist()
        self.lengths = np.frombuffer(table, "<u4", head["docs"], 8 * head["docs"]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._width = np.dtype(f"<u{head['width']}")
        self._first = np.cumsum([0, *head["frame_docs"]])

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, position: int) -> np.ndarray:
        """Ids of the document at a position; only its frame is decompressed, and checked."""
        import xxhash

        n = int(np.searchsorted(self._first, position, side="right")) - 1
        if self._frame[0] != n:
            packed, size, checksum = self.seek[n]
            raw = self._unpack.decompress(self._data[self.offsets[n] : self.offsets[n] + packed - GAP], max_output_size=size)
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {n} fails its checksum")
            self._frame = (n, raw)
        skip = int(self.starts[position] - self.starts[self._first[n]])
        return np.frombuffer(self._frame[1], self._width, int(self.lengths[position]), skip * self._width.itemsize)


def read_token_files(spark: SparkSession, path: str, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, file, offset, n_tokens, ids_crc32, ids) of the files in a folder.

    With ``wanted``, a list of keys, only the frames that hold them are decompressed.
    ``offset`` counts the ids of the documents before it in its file, ``ids_crc32`` is the checksum of the ids as little-endian unsigned 32-bit integers;
    ``ids`` stays NULL without ``with_ids``. Files without a document give no row.
    """
    asked = None if wanted is None else set(wanted)

    def run(columns):
        for name, content in zip(columns["file"], columns["content"]):
            file = TokenFile(content)
            for i, key in enumerate(file.keys):
                if asked is None or key in asked:
                    raw = file.ids(i).astype("<u4")
                    yield key, name, int(file.starts[i]), int(file.lengths[i]), zlib.crc32(raw.tobytes()), raw.tolist() if with_ids else None

    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(name.alias("file"), "content")
    return map_rows(files, run, "doc_id long, file string, offset long, n_tokens long, ids_crc32 long, ids array<long>", 2048)


def with_starts(docs: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: the offset in the file plus the files before.

    Only the totals of the files, one small row each, are summed in a single ordered pass.
    """
    from pyspark.sql import Window

    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("file", (F.sum("_n").over(Window.orderBy("file")) - F.col("_n")).alias("_before"))
    return docs.join(before, "file").withColumn("start", F.col("_before") + F.col("offset")).drop("_before")
