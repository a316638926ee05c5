"""Token-id files: all ids one after another, with Elias-Fano coded document boundaries.

Documents are dealt out by ranges of doc_id, so shard k holds smaller ids than shard k+1
and a text moves once. A task encodes its range and streams one file to the shared folder:

    magic "SHEAFTK1" | ids, 2 or 4 bytes each, little-endian | boundaries | doc ids | footer

Boundaries (n + 1 of them) and doc ids are Elias-Fano coded; the footer has their places
and the number of leading documents without an id. A file is written under a name of its
attempt, and the manifest, a table that is committed when all tasks are done, names the attempts that count: a lost
executor or a second attempt leaves at most a file that no manifest names.
A shard's first position comes from the running sum over shards, one row for each file.

Nulls: a null text is empty (its document holds the end id only); rows with a null doc_id
come first, in the order of their texts. Repeated doc_ids stay as they are, ordered by
text. An empty table gives no files and no rows. Only doc_id and text are read, so other
columns of any name do not matter.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.chunk_encoder import WordEncoder, simple_spacing, split_at
from sheaf.llm.common import materialize, new_folder, shuffle_parts
from sheaf.llm.elias_fano import EliasFano

MAGIC = b"SHEAFTK1"
FOOTER = struct.Struct("<QQQQQB7x")
MANIFEST = "shard long, path string, n_docs long, n_ids long"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


_encoders: dict[tuple, WordEncoder] = {}


def byte_level_encoder(tokenizer_path: str, width: int) -> WordEncoder:
    """Kept by the Python worker from task to task."""
    if (tokenizer_path, width) not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        kind = f"<u{width}"
        [newline] = tokenizer.encode("\n", add_special_tokens=False).ids

        def whole(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def words(prefix: str):
            def encode(new: list[str]) -> list[bytes]:
                parts = [new[i : i + 1000] for i in range(0, len(new), 1000)]
                found = tokenizer.encode_batch_fast([prefix + f"\n{prefix}".join(p) for p in parts], add_special_tokens=False)
                return [x for e in found for x in split_at(e.ids, newline, kind)]

            return encode

        def simple(text: str) -> bool:
            # A special token's string may reach over a space: such a text goes to the library whole.
            return simple_spacing(text) and not any(s in text for s in special)

        _encoders[tokenizer_path, width] = WordEncoder(words(""), words(" "), whole, np.array([newline], kind).tobytes(), simple, limit=500_000)
    return _encoders[tokenizer_path, width]


class ShardWriter:
    """Streams one shard; keeps only the boundaries and doc ids in memory."""

    def __init__(self, folder: str, shard: int, width: int):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.width, self.folder, self.shard = f"{root}/shard-{shard:08d}-{uuid.uuid4().hex[:12]}.tok", width, folder, shard
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.ends, self.doc_ids, self.total, self.nulls = [np.zeros(1, np.int64)], [], 0, 0

    def write(self, doc_ids: list[int | None], ids: list[bytes], end: bytes) -> None:
        lengths = np.array([len(x) + len(end) for x in ids], np.int64) // self.width
        self.ends.append(self.total + np.cumsum(lengths))
        self.total += int(lengths.sum())
        self.nulls += sum(d is None for d in doc_ids)
        self.doc_ids.append(np.array([d for d in doc_ids if d is not None], np.int64))
        self.out.write(end.join(ids) + end)

    def close(self) -> tuple[int, str, int, int]:
        ends, docs = (EliasFano.build(np.concatenate(x)).to_bytes() for x in (self.ends, [np.zeros(0, np.int64), *self.doc_ids]))
        at = len(MAGIC) + self.total * self.width
        n = sum(map(len, self.ends)) - 1
        self.out.write(ends + docs + FOOTER.pack(n, self.total, self.nulls, at, at + len(ends), self.width))
        self.out.close()
        return self.shard, f"{self.folder}/{os.path.basename(self.path)}", n, self.total


class ShardReader:
    """Reads single documents by select, or all in slices of bounded size."""

    def __init__(self, path: str):
        self.fs, self.root = file_system(path)
        size = self.fs.get_file_info(self.root).size
        self.file = self.fs.open_input_file(self.root)
        self.n, self.total, self.nulls, ends_at, docs_at, self.width = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.ends = EliasFano.from_bytes(self._read(ends_at, docs_at - ends_at))
        self.docs = EliasFano.from_bytes(self._read(docs_at, size - FOOTER.size - docs_at))

    def _read(self, at: int, length: int) -> bytes:
        return self.file.read_at(length, at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self._read(len(MAGIC) + start * self.width, (stop - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.ends.select(i), self.ends.select(i + 1))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.docs.select(i - self.nulls)

    def slices(self, most: int = 4_000_000) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """Doc ids, boundaries within the file, and the ids between the first and last of them."""
        ends, docs = self.ends.all(), [None] * self.nulls + self.docs.all().tolist()
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
            yield docs[i:j], ends[i : j + 1], self.ids(int(ends[i]), int(ends[j]))
            i = j


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, width: int = 2, shards: int | None = None) -> DataFrame:
    """Encodes every text and writes one file for each range of doc ids. Returns the manifest, one row for each file.

    ``width``: bytes an id; 2 holds vocabularies below 65,536. ``shards``: number of files, by default the shuffle partitions.
    """
    end = int(end_id).to_bytes(width, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = byte_level_encoder(tokenizer_path, width), None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if not part.num_rows:
                    continue
                writer = writer or ShardWriter(folder, TaskContext.get().partitionId(), width)
                texts = [t or "" for t in part.column("text").to_pylist()]
                writer.write(part.column("doc_id").to_pylist(), encoder.encode(texts), end)
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in writer.close()], names=["shard", "path", "n_docs", "n_ids"])

    n = shards or shuffle_parts(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(encode, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files of ``manifest``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist(), strict=True):
                for docs, ends, ids in ShardReader(path).slices():
                    wide, at = ids.astype("<u4"), ends - ends[0]
                    crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends[:-1] + first), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each file, however many documents it holds: the running sum needs no split.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = first.select("shard", "path", "first").repartition(shuffle_parts(manifest.sparkSession), "shard")
    return spread.select("path", "first").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    return read_token_files(write_token_files(docs, new_folder(spark, "token-files"), tokenizer_path, end_id))
