"""A data source for code trees: prunes folders while listing, and large files before reading.

The module is pickled by value, so workers need no copy of the package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    Filter,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

SCHEMA = "filename STRING, size BIGINT, content BINARY"
PARTITION_BYTES = 32 << 20
PARTITION_FILES = 2_000
BATCH_BYTES = 4 << 20


def store_of(root: str):
    """The file system of a local path or a URI that Arrow knows, and the path in it."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root if "://" in root else "file://" + root[5:])
    return fs.LocalFileSystem(), root


def put_files(root: str, files: Iterator[tuple[str, str]]) -> int:
    """Write texts below a root; a file that is written again is replaced."""
    store, base = store_of(root)
    count = 0
    for name, content in files:
        path = f"{base.rstrip('/')}/{name}"
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(path) as stream:
            stream.write((content or "").encode())
        count += 1
    return count


class Files(InputPartition):
    """Paths below the root that one task reads."""

    def __init__(self, paths: list[tuple[str, int]]) -> None:
        self.paths = paths


class CodeTreeReader(DataSourceReader):
    """Lists on the driver, folder by folder; pruned folders are never opened."""

    def __init__(self, root: str, extensions: tuple[str, ...], pruned: frozenset[str]) -> None:
        self.root, self.extensions, self.pruned = root, extensions, pruned
        self.most_bytes: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes upper bounds of ``size``; Spark applies all other filters."""
        for found in filters:
            if isinstance(found, (LessThan, LessThanOrEqual)) and found.attribute == ("size",):
                most = found.value - isinstance(found, LessThan)
                self.most_bytes = most if self.most_bytes is None else min(most, self.most_bytes)
            else:
                yield found

    def listed(self) -> Iterator[tuple[str, int]]:
        """(path below the root, bytes) of every file that is wanted, in path order by folder."""
        from pyarrow import fs

        store, base = store_of(self.root)
        base = base.rstrip("/")
        folders = [base]
        while folders:
            folder = folders.pop()
            found = sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name)
            for info in found:
                if info.type == fs.FileType.Directory:
                    if info.base_name not in self.pruned:
                        folders.append(info.path)
                elif info.base_name.endswith(self.extensions) and (
                    self.most_bytes is None or info.size <= self.most_bytes
                ):
                    yield info.path[len(base) + 1 :], info.size

    def partitions(self) -> list[Files]:
        """Files in runs of bounded bytes and number; a folder's files stay together where they fit."""
        out: list[Files] = []
        run: list[tuple[str, int]] = []
        held = 0
        for path, size in self.listed():
            if run and (held + size > PARTITION_BYTES or len(run) >= PARTITION_FILES):
                out.append(Files(run))
                run, held = [], 0
            run.append((path, size))
            held += size
        return [*out, Files(run)] if run else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, base = store_of(self.root)
        names, sizes, contents, held = [], [], [], 0
        for path, size in partition.paths:
            with store.open_input_stream(f"{base.rstrip('/')}/{path}") as stream:
                contents.append(stream.read())
            names.append(path)
            sizes.append(size)
            held += size
            if held >= BATCH_BYTES:
                yield self._batch(names, sizes, contents)
                names, sizes, contents, held = [], [], [], 0
        if names:
            yield self._batch(names, sizes, contents)

    @staticmethod
    def _batch(names: list[str], sizes: list[int], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())],
            names=["filename", "size", "content"],
        )


class CodeTree(DataSource):
    """``spark.read.format("code_tree")`` with options ``path``, ``extensions`` and ``pruned``."""

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CodeTreeReader:
        return CodeTreeReader(
            self.options["path"], tuple(self.options["extensions"].split(",")),
            frozenset(self.options.get("pruned", "").split(",")),
        )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
