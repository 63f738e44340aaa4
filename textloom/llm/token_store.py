"""A binary store of token ids: one independent zstandard frame per document, a trailing seek table, checksums.

A file is: frames; a skippable frame with the document index; a skippable frame with the seek table, laid out as the
public zstandard seekable format does (per frame: compressed size, size, low 32 bits of the content's XXH64; then the
number of frames, a descriptor byte and the format's magic number). Each frame also carries zstandard's own checksum.
The index (itself a zstandard frame) has, per document in file order: id, whether it is null, number of ids, number of
frames. Ids are 16-bit little endian. Documents beyond FRAME_IDS ids span several frames.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.tokens import ID_BYTES, checksum, default_tokenizer, encoder

#: Ids in one frame at most: what a reader must hold at once.
FRAME_IDS = 1 << 18
# Fixed values of the public formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
SEEK_ENTRY = "<III"
SEEK_FOOTER = "<IBI"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system that executors reach by URI: local, HDFS, S3 or GCS."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


class StoreWriter:
    """Writes documents one after another to a binary stream."""

    def __init__(self, stream, level: int = 3) -> None:
        import zstandard

        self.stream = stream
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        step = FRAME_IDS * ID_BYTES
        parts = [ids[i : i + step] for i in range(0, len(ids), step)]
        for part in parts:
            frame = self.packer.compress(part)
            self.stream.write(frame)
            self.entries.append((len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // ID_BYTES, len(parts)))

    def close(self) -> None:
        table = np.array(self.docs, "<i8").reshape(-1, 4)
        index = self.packer.compress(table.tobytes())
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = b"".join(struct.pack(SEEK_ENTRY, *e) for e in self.entries) + struct.pack(SEEK_FOOTER, len(self.entries), 0x80, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class StoreReader:
    """Reads a file's tables from its end, then only the frames of the documents asked for."""

    def __init__(self, file, size: int) -> None:
        import zstandard

        self.file = file
        self.unpacker = zstandard.ZstdDecompressor()
        foot = struct.calcsize(SEEK_FOOTER)
        n, _, magic = struct.unpack(SEEK_FOOTER, self._read(size - foot, foot))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        table = n * struct.calcsize(SEEK_ENTRY)
        self.seek = np.frombuffer(self._read(size - foot - table, table), "<u4").reshape(-1, 3).astype("i8")
        self.at = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        kind, length = struct.unpack("<II", self._read(int(self.at[-1]), 8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        self.docs = np.frombuffer(self.unpacker.decompress(self._read(int(self.at[-1]) + 8, length)), "<i8").reshape(-1, 4)
        self.first = np.concatenate([[0], np.cumsum(self.docs[:, 3])])

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, row: int) -> np.ndarray:
        """The ids of the file's row-th document; decompresses its frames alone and checks them."""
        import xxhash

        out = []
        for k in range(int(self.first[row]), int(self.first[row + 1])):
            part = self.unpacker.decompress(self._read(int(self.at[k]), int(self.seek[k, 0])))
            if len(part) != self.seek[k, 1] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.seek[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            out.append(part)
        return np.frombuffer(b"".join(out), "<u2")

    def find(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        """The ids of the documents asked for that the file has; of repeated ids the first row."""
        known = np.flatnonzero(self.docs[:, 1] == 0)
        out = {}
        for d in doc_ids:
            k = np.searchsorted(self.docs[known, 0], d)
            if k < len(known) and self.docs[known[k], 0] == d:
                out[d] = self.ids(int(known[k]))
        return out


def write_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1) -> list[dict]:
    """Writes documents in ascending id order (null first; repeated ids by a hash of the text) to files under
    ``folder`` and returns the manifest: per file, in that order, file, docs, tokens and start (ids in files before it).

    One range shuffle of texts by id gives each task a range, sorted within; a task writes one file, streaming. A file's
    name is unique to its task attempt and the manifest names only files of attempts that succeeded, so lost executors
    and repeated tasks do no harm. The manifest, a row per task, is all that comes to the driver.

    Null or empty text: the end id alone. Empty table: no file. Other columns are not read.
    """
    path = tokenizer or default_tokenizer()
    end = int(end_id).to_bytes(ID_BYTES, "little")
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        fs, base = _open(folder)
        writer, name, tokens, first = None, f"part-{uuid.uuid4().hex}.tokens", 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if writer is None:
                        stream = fs.open_output_stream(f"{base}/{name}")
                        writer, first = StoreWriter(stream), doc_id
                    ids = encode(text or "") + end
                    tokens += len(ids) // ID_BYTES
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"first": first, "file": name, "docs": len(writer.docs), "tokens": tokens}],
                                             pa.schema([("first", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    manifest = [r.asDict() for r in ranged.mapInArrow(run, "first long, file string, docs long, tokens long").collect()]
    manifest.sort(key=lambda r: (r["first"] is not None, r["first"] or 0))
    start = 0
    for r in manifest:
        r["start"] = start
        start += r["tokens"]
    return manifest


def read_store(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """Reads every document back from the files: doc_id, start, n_tokens, ids_crc32. A task per file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for name, start in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                with fs.open_input_file(f"{base}/{name}") as file:
                    reader = StoreReader(file, file.size())
                    starts = start + np.concatenate([[0], np.cumsum(reader.docs[:, 2])])
                    for at in range(0, len(reader.docs), 2000):
                        some = range(at, min(at + 2000, len(reader.docs)))
                        part = reader.docs[some.start : some.stop]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part[:, 0], mask=part[:, 1] == 1), pa.array(starts[some.start : some.stop]), pa.array(part[:, 2]),
                             pa.array([checksum(reader.ids(k)) for k in some], pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(r["file"], r["start"]) for r in manifest], "file string, start long")
    return files.repartition(len(manifest)).mapInArrow(run, schema)
