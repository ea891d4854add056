"""Archives of named tensors: zip files with a pickled dictionary and one raw entry for each storage.

The driver reads each archive's directory and its pickle (names, types and shapes; a few hundred bytes), and
tasks read ranges of the raw entries.  Nothing but tensor descriptions is unpickled: any other name in the
pickle is an error.  A tensor of two dimensions gives an array column, one of one dimension a scalar; rows are
told apart by ``archive`` and ``row``.
"""

from __future__ import annotations

import collections
import io
import pickle
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from basinflow.sources.shared import arrow_folder

#: Fixed values of the format: storage names, element types, and what Spark calls them.
STORAGES = {"FloatStorage": ("<f4", "float"), "DoubleStorage": ("<f8", "double"), "LongStorage": ("<i8", "long"), "IntStorage": ("<i4", "int"), "ShortStorage": ("<i2", "short"), "CharStorage": ("<i1", "byte")}
#: Bytes of a task's share of an archive.
SPLIT_BYTES = 32 << 20


@dataclass(frozen=True)
class Tensor:
    """Where a tensor lies: its storage's entry and type, the first element, and its shape (row-major)."""

    entry: str
    storage: str
    offset: int
    shape: tuple[int, ...]

    @property
    def row_bytes(self) -> int:
        return np.dtype(STORAGES[self.storage][0]).itemsize * int(np.prod(self.shape[1:], dtype=int))


def _tensor(storage: tuple[str, str], offset: int, shape: tuple[int, ...], stride: tuple[int, ...], *_) -> Tensor:
    plain = tuple(int(np.prod(shape[k + 1 :], dtype=int)) for k in range(len(shape)))
    if tuple(stride) != plain:
        raise ValueError("only tensors in row order can be read by ranges")
    if not 1 <= len(shape) <= 2:
        raise ValueError("tensors must have one or two dimensions")
    return Tensor(storage[1], storage[0], offset, tuple(shape))


class _Descriptions(pickle.Unpickler):
    """Reads tensors as descriptions of where they lie."""

    def find_class(self, module: str, name: str):
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if (module, name) == ("collections", "OrderedDict"):
            return collections.OrderedDict
        if module == "torch" and name in STORAGES:
            return name
        raise ValueError(f"{module}.{name} is not a part of a tensor archive")

    def persistent_load(self, pid: tuple) -> tuple[str, str]:
        return pid[1], pid[2]


def describe(system: fs.FileSystem, path: str) -> tuple[dict[str, Tensor], dict[str, int]]:
    """The tensors of an archive by name, and the position of each storage's first byte."""
    with system.open_input_file(path) as source, zipfile.ZipFile(source) as archive:
        entries = {i.filename: i for i in archive.infolist()}
        main = next(n for n in entries if n.endswith("/data.pkl"))
        tensors = _Descriptions(io.BytesIO(archive.read(main))).load()
        found = {}
        for tensor in tensors.values():
            info = entries[f"{main[: -len('data.pkl')]}data/{tensor.entry}"]
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError("storages must not be compressed")
            source.seek(info.header_offset)
            name, extra = struct.unpack("<HH", source.read(30)[26:30])
            found[tensor.entry] = info.header_offset + 30 + name + extra
    if len({t.shape[0] for t in tensors.values()}) > 1:
        raise ValueError("all tensors of an archive must have one length")
    return dict(tensors), found


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    rows: int
    tensors: dict[str, Tensor]
    places: dict[str, int]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def archives(self) -> list[str]:
        system, path = arrow_folder(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        return sorted(i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File and i.base_name.endswith(".pt"))

    def partitions(self) -> list[Range]:
        system, _ = arrow_folder(self.path)
        out = []
        for path in self.archives():
            tensors, places = describe(system, path)
            count = next(iter(tensors.values())).shape[0] if tensors else 0
            step = max(1, self.split_bytes // max(1, sum(t.row_bytes for t in tensors.values())))
            out += [Range(path, at, min(step, count - at), tensors, places) for at in range(0, count, step)]
        return out or [Range("", 0, 0, {}, {})]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        system, _ = arrow_folder(self.path)
        names = ["archive", "row"]
        columns = [pa.array([part.archive.rsplit("/", 1)[-1]] * part.rows), pa.array(np.arange(part.start, part.start + part.rows))]
        with system.open_input_file(part.archive) as source:
            for name, tensor in part.tensors.items():
                kind = np.dtype(STORAGES[tensor.storage][0])
                raw = source.read_at(part.rows * tensor.row_bytes, part.places[tensor.entry] + tensor.offset * kind.itemsize + part.start * tensor.row_bytes)
                values = pa.array(np.frombuffer(raw, dtype=kind))
                if len(tensor.shape) == 2:
                    values = pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * tensor.shape[1]), values)
                names.append(name)
                columns.append(values)
        yield pa.RecordBatch.from_arrays(columns, names=names)


class TensorArchive(DataSource):
    """Format ``tensor_archive``: ``path`` is an archive, or a folder of archives (``*.pt``) with the same tensors;
    ``split_bytes`` bounds what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "tensor_archive"

    def _reader(self) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def schema(self) -> str:
        system, _ = arrow_folder(self.options["path"])
        archives = self._reader().archives()
        if not archives:
            raise ValueError(f"no archive below {self.options['path']}")
        tensors, _ = describe(system, archives[0])
        kinds = [f"`{n}` {STORAGES[t.storage][1] if len(t.shape) == 1 else f'array<{STORAGES[t.storage][1]}>'}" for n, t in tensors.items()]
        return ", ".join(["archive string", "row long", *kinds])

    def reader(self, schema) -> ArchiveReader:
        return self._reader()


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``archive, row`` and a column for each tensor."""
    spark.dataSource.register(TensorArchive)
    return spark.read.format("tensor_archive").option("path", path).option("split_bytes", split_bytes).load()


def _text(value: str) -> bytes:
    raw = value.encode()
    return b"X" + struct.pack("<I", len(raw)) + raw  # BINUNICODE


def _whole(value: int) -> bytes:
    raw = value.to_bytes(9, "little", signed=True)
    return b"\x8a" + bytes([len(raw)]) + raw  # LONG1


def archive_bytes(tensors: dict[str, np.ndarray], name: str = "archive") -> bytes:
    """An archive of arrays; the pickle is put together from opcodes, as the classes it names are not here."""
    storages = {np.dtype(kind): storage for storage, (kind, _) in STORAGES.items()}
    main = [b"\x80\x02}("]  # PROTO 2, EMPTY_DICT, MARK
    for number, (key, array) in enumerate(tensors.items()):
        strides = [int(np.prod(array.shape[k + 1 :], dtype=int)) for k in range(array.ndim)]
        storage = b"(" + _text("storage") + f"ctorch\n{storages[array.dtype]}\n".encode() + _text(str(number)) + _text("cpu") + _whole(array.size) + b"tQ"  # TUPLE, BINPERSID
        shapes = [b"(" + b"".join(_whole(x) for x in part) + b"t" for part in (array.shape, strides)]
        main.append(_text(key) + b"ctorch._utils\n_rebuild_tensor_v2\n(" + storage + _whole(0) + b"".join(shapes) + b"\x89ccollections\nOrderedDict\n)RtR")  # NEWFALSE, REDUCE
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr(f"{name}/data.pkl", b"".join(main) + b"u.")  # SETITEMS, STOP
        for number, array in enumerate(tensors.values()):
            archive.writestr(f"{name}/data/{number}", np.ascontiguousarray(array).tobytes())
        archive.writestr(f"{name}/version", b"3\n")
    return out.getvalue()


def write_archives(points: DataFrame, folder: str, archive_rows: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> int:
    """Write ``ids``, ``encodings`` and ``labels`` as archives of at most ``archive_rows`` rows each, one file a piece; returns
    their number.  Vectors of a task must have one length and no nulls, ids and labels no nulls (an error)."""
    rows = points.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<float>"), F.col(label_col).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = arrow_folder(folder)
        system.create_dir(path, recursive=True)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, vectors, labels = (c.chunk(0) for c in table.columns)
            if ids.null_count or vectors.null_count or labels.null_count or vectors.flatten().null_count or len(set(np.diff(vectors.offsets.to_numpy()).tolist())) > 1:
                raise ValueError("an archive holds vectors of one length, and no nulls")
            target = f"{path}/{uuid.uuid4().hex}"
            with system.open_output_stream(f"{target}.tmp") as out:
                out.write(archive_bytes({"ids": ids.to_numpy(), "encodings": vectors.flatten().to_numpy().reshape(len(ids), -1), "labels": labels.to_numpy()}))
            return pa.RecordBatch.from_arrays([pa.array([target])], names=["file"])

        for batch in batches:
            for at in range(0, batch.num_rows, archive_rows):
                piece = batch.slice(at, archive_rows)
                if size + piece.num_rows > archive_rows and held:
                    yield flush()
                    held, size = [], 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield flush()

    files = [r["file"] for r in rows.mapInArrow(run, "file string").collect()]  # a name for each archive
    system, _ = arrow_folder(folder)
    for file in files:  # only the pieces of tasks that counted get their name
        system.move(f"{file}.tmp", f"{file}.pt")
    return len(files)
