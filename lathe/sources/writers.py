"""A file for each row: cleaned files, markdown and HTML, written by the executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_each(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """SNK4, SNK5: writes content (binary, or a string in UTF-8) as folder/name and returns path and bytes of each file; names with parts leading out of the folder are refused.

    folder is a URI that pyarrow can open, or a path shared by all executors. A file appears under its name only when it is whole; running again replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for b in batches:
            paths, sizes = [], []
            for one, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not one or ".." in one.split("/") or one.startswith("/"):
                    raise ValueError(f"not a name of a file in the folder: {one!r}")
                path, part = f"{base}/{one}", f"{base}/{one}.{uuid.uuid4().hex}.part"
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(part, compression=None) as out:
                    out.write(data or b"")
                files.move(part, path)
                paths.append(path)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return rows.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "path string, bytes long")
