"""Documents and run files as a Spark data source: ``spark.read.format("sheaf")`` and ``df.write.format("sheaf")``.

Reading gives (path, text, error) as ``files.read_documents`` does. Files are dealt out by size: a partition has about
``partitionBytes`` of them, so many small files are few tasks and large ones do not share one. Files of no
bytes are documents with an empty text.

Writing takes (run_dir, file_name, content) and gives files of exactly these names. Tasks write below a folder of the
run, each file under a name of its attempt; the commit moves the files of the attempts that count to their places, the abort deletes the
folder. A run that fails before its commit leaves nothing. Where a name occurs twice, the file of the last partition stays.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "sheaf"
PARTITION_BYTES = 64 << 20
#: Files that are moved at a time.
MOVES = 32


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def by_size(sizes: list[tuple[str, int]], most: int) -> list[tuple[str, ...]]:
    """Paths in groups of about ``most`` bytes: neighbours together, in order."""
    out: list[list[str]] = []
    held = 0
    for path, size in sorted(sizes):
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return [tuple(x) for x in out]


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = _system(self.root)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and not os.path.basename(f.path).startswith((".", "_"))]
        return [Files(x) for x in by_size(files, self.most)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from sheaf.operators.validation import BLANKS
        from sheaf.sources.files import pdf_text

        system, _ = _system(self.root)
        for path in partition.paths:
            text = error = None
            try:
                with system.open_input_stream(path) as f:
                    content = f.read()
                if path.lower().endswith(".pdf"):
                    text = pdf_text(content).strip(BLANKS) or None
                    error = None if text else f'No text could be extracted from "{path}"'
                else:
                    text = content.decode("utf-8", "replace")
            except Exception as e:  # noqa: BLE001 - one bad file is one bad row
                error = f'Could not read file "{path}": {e}'
            yield pa.RecordBatch.from_pydict({"path": [path], "text": [text], "error": [error]}, schema=pa.schema([(c, pa.string()) for c in ("path", "text", "error")]))


@dataclass
class Written(WriterCommitMessage):
    moves: tuple[tuple[str, str], ...]


class RunFileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.root, self.run = options["path"], f".run-{uuid.uuid4().hex[:12]}"

    def write(self, rows: Iterator) -> Written:
        from sheaf.sources.sinks import pretty

        system, root = _system(self.root)
        moves = []
        folder = f"{root}/{self.run}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        for k, row in enumerate(rows):
            content = pretty(row["content"]) if row["file_name"].endswith(".json") else row["content"]
            with system.open_output_stream(f"{folder}/{k}") as f:
                f.write(content.encode())
            moves.append((f"{folder}/{k}", os.path.normpath(f"{root}/{row['run_dir']}/{row['file_name']}")))
        return Written(tuple(moves))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _system(self.root)
        places = {final: at for m in messages if m for at, final in m.moves}
        for parent in {os.path.dirname(p) for p in places}:
            system.create_dir(parent, recursive=True)

        def move(final: str, at: str) -> None:
            if system.get_file_info(final).type != fs.FileType.NotFound:  # some file systems refuse to move onto a file
                system.delete_file(final)
            system.move(at, final)

        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(move, *zip(*places.items(), strict=True))) if places else None
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, root = _system(self.root)
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.run}")


class SheafDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, text string, error string"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(self._options())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        missing = {"run_dir", "file_name", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        return RunFileWriter(self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheafDataSource)
