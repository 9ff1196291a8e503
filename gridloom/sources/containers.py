"""Raster containers: files of several variables over named axes, in the classic NetCDF format, as a Spark data source.

    register(spark)
    spark.read.format("containers").option("variables", "rain|RAIN|data,lat,lon").load(path)

gives a row for each line of a variable: (path, variable, dims, shape, line, values, error). ``variables`` names what is wanted,
each with further names under which files may have it; the first that a file has is read, and of a file only the header and
the bytes of these variables. Filters on ``variable`` are not pushed into the source: Spark 4.1 keeps a pushed filter with the
relation, so that a table that is used twice with different filters would give both uses the rows of one. Files are listed once and dealt to tasks, a task for
some files and one variable, or for some files where no variable is named.

Writing takes the same rows (without ``error``), the lines of a file next to each other in one task (``write_containers`` sees to it).
A task writes under temporary names, and the commit on the driver renames what complete tasks have written; a task that is
lost or runs twice leaves nothing behind that a reader sees.

Functions that run in tasks are shipped by value, so that executors need not have this package.
"""

from __future__ import annotations

import fnmatch
import io
import json
import struct
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, variable string, dims array<string>, shape array<int>, line int, values array<double>, error string"
#: Fixed values of the format: tags of its lists, and its types with their sizes.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
#: Bytes that are read for a header at first; longer ones are read in doubling steps.
HEAD = 1 << 14
#: Names that are axes or pictures of a scale, not data.
NOT_DATA = {"lat", "lon", "latitude", "longitude", "x", "y", "time", "height", "depth"}


@dataclass
class Variable:
    name: str
    dims: list[str]
    shape: list[int]
    dtype: str
    begin: int
    record: int  # bytes from a record to the next, 0 if it isn't a record variable
    attributes: dict


class Short(Exception):
    """The header goes on beyond the bytes at hand."""


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Short
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str = ">I") -> int:
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]

    def padded(self, n: int) -> bytes:
        return self.take(-(-n // 4) * 4)[:n]

    def name(self) -> str:
        return self.padded(self.number()).decode()

    def listed(self, tag: int) -> int:
        found, n = self.number(), self.number()
        if found not in (tag, 0) or (found == 0 and n):
            raise ValueError(f"tag {found} where {tag} should be")
        return n

    def attributes(self) -> dict:
        out = {}
        for _ in range(self.listed(ATTRIBUTE)):
            name, kind, n = self.name(), self.number(), self.number()
            raw = self.padded(n * np.dtype(TYPES[kind]).itemsize)
            out[name] = raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).astype(float).tolist()
        return out


def header(data: bytes) -> tuple[dict[str, Variable], dict]:
    """Variables by name and global attributes; raises Short if ``data`` ends too early."""
    c = _Cursor(data)
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    records = c.number()
    dims = [(c.name(), c.number()) for _ in range(c.listed(DIMENSION))]
    attributes = c.attributes()
    found = []
    for _ in range(c.listed(VARIABLE)):
        name = c.name()
        axes = [dims[c.number()] for _ in range(c.number())]
        own, kind, size, begin = c.attributes(), c.number(), c.number(), c.number(">Q" if magic[3] == 2 else ">I")
        is_record = bool(axes) and axes[0][1] == 0
        shape = [records if k == 0 and is_record else n for k, (_, n) in enumerate(axes)]
        found.append((Variable(name, [d for d, _ in axes], shape, TYPES[kind], begin, 0, own), is_record, size))
    step = sum(size for _, is_record, size in found if is_record)
    for v, is_record, _ in found:
        v.record = step if is_record else 0
    return {v.name: v for v, _, _ in found}, attributes


def values_of(file, variable: Variable) -> np.ndarray:
    """The numbers of a variable: only its bytes are read. Fill values become 0, scale and offset are applied."""
    dtype = np.dtype(variable.dtype)
    count = int(np.prod(variable.shape, dtype=np.int64))

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        raw = file.read(n * dtype.itemsize)
        if len(raw) < n * dtype.itemsize:
            raise ValueError(f"{variable.name} is cut off")
        return raw

    if variable.record:
        each = count // max(variable.shape[0], 1)
        raw = b"".join(read(variable.begin + k * variable.record, each) for k in range(variable.shape[0]))
    else:
        raw = read(variable.begin, count)
    data = np.frombuffer(raw, dtype).reshape(variable.shape)
    if dtype.kind == "S":
        raise ValueError(f"{variable.name} holds characters")
    fill = [variable.attributes[a][0] for a in ("_FillValue", "missing_value") if a in variable.attributes]
    out = data.astype(float)
    for name, change in (("scale_factor", np.multiply), ("add_offset", np.add)):
        if name in variable.attributes:
            out = change(out, variable.attributes[name][0])
    for value in fill:
        out[data == value] = 0.0
    return out


def flattened(data: np.ndarray, dims: list[str]) -> tuple[np.ndarray, list[str]]:
    """Two axes at most: leading axes of length 1 go, further ones before the last two are averaged."""
    while data.ndim > 2 and data.shape[0] == 1:
        data, dims = data[0], dims[1:]
    if data.ndim > 2:
        data, dims = data.reshape(-1, *data.shape[-2:]).mean(axis=0), dims[-2:]
    return data, dims


def resolved(variables: dict[str, Variable], attributes: dict, names: list[str]) -> Variable | np.ndarray | None:
    """The first of ``names`` that the file has, in any case; an axis that only its corners (name_ul, name_lr) give is made of them."""
    lower = {n.lower(): n for n in variables}
    for name in names:
        if name in variables or name.lower() in lower:
            return variables[name if name in variables else lower[name.lower()]]
    flat = next((v for v in variables.values() if len(v.shape) >= 2), None)
    for name in names:
        ends = [attributes.get(f"{name}_{c}") for c in ("ul", "lr")]
        if name in ("lat", "lon") and flat and all(ends):
            return np.linspace(ends[0][0], ends[1][0], flat.shape[-2 if name == "lat" else -1])
    return None


def first_data(variables: dict[str, Variable]) -> Variable | None:
    """The first variable that is neither an axis nor a palette."""
    return next((v for v in variables.values() if v.name.lower() not in NOT_DATA and "palette" not in v.name.lower()), None)


def container_decoder(content: bytes) -> dict[str, np.ndarray]:
    """All variables of a file that is at hand as bytes, for ``read_rasters``; a .npy file has one, ``data``."""
    if content[:6] == b"\x93NUMPY":
        return {"data": np.load(io.BytesIO(content), allow_pickle=False)}
    variables, _ = header(content)
    file = io.BytesIO(content)
    return {n: flattened(values_of(file, v), v.dims)[0] for n, v in variables.items() if v.dtype != "S1"}


def encode(variables: dict[str, tuple[list[str], np.ndarray]], attributes: dict[str, list[float] | str] | None = None) -> bytes:
    """A file of the 64-bit variant: variables by name with the names of their axes."""
    dims: dict[str, int] = {}
    for name, (axes, data) in variables.items():
        if len(axes) != data.ndim:
            raise ValueError(f"{name}: {data.ndim} axes, {len(axes)} names")
        for axis, n in zip(axes, data.shape):
            if dims.setdefault(axis, n) != n or n == 0:
                raise ValueError(f"axis {axis} has length {n} and {dims[axis]}")
    codes = {np.dtype(t).str: k for k, t in TYPES.items()}
    coded = {}
    for name, (_, data) in variables.items():
        kind = np.dtype(data.dtype).newbyteorder(">").str if data.dtype.itemsize > 1 else np.dtype(data.dtype).str
        if kind not in codes:
            raise ValueError(f"{name}: the format has no type for {data.dtype}")
        coded[name] = (codes[kind], np.ascontiguousarray(data, kind).tobytes())

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def some(tag: int, rows: list[bytes]) -> bytes:
        return struct.pack(">II", tag if rows else 0, len(rows)) + b"".join(rows)

    def attribute(name: str, value) -> bytes:
        if isinstance(value, str):
            return text(name) + struct.pack(">I", 2) + text(value)
        return text(name) + struct.pack(">II", 6, len(value)) + np.array(value, ">f8").tobytes()

    place = {axis: k for k, axis in enumerate(dims)}

    def head(begins: list[int]) -> bytes:
        rows = []
        for (name, (axes, _)), begin in zip(variables.items(), begins):
            code, raw = coded[name]
            size = min(-(-len(raw) // 4) * 4, 2**32 - 1)
            rows.append(text(name) + struct.pack(f">I{len(axes)}I", len(axes), *(place[a] for a in axes)) + some(ATTRIBUTE, []) + struct.pack(">IIQ", code, size, begin))
        known = [attribute(k, v) for k, v in (attributes or {}).items()]
        return b"CDF\x02" + struct.pack(">I", 0) + some(DIMENSION, [text(a) + struct.pack(">I", n) for a, n in dims.items()]) + some(ATTRIBUTE, known) + some(VARIABLE, rows)

    at, begins = len(head([0] * len(variables))), []
    for _, raw in coded.values():
        begins.append(at)
        at += -(-len(raw) // 4) * 4
    return head(begins) + b"".join(raw + b"\0" * (-len(raw) % 4) for _, raw in coded.values())


def _rows(path: str, file, names: list[list[str]] | None) -> Iterator[tuple]:
    """Rows of the wanted variables of an open file; the first name of each list is what a row calls it."""
    size = HEAD
    while True:
        file.seek(0)
        data = file.read(size)
        try:
            variables, attributes = header(data)
            break
        except Short:
            if len(data) < size:
                raise ValueError("the header is cut off") from None
            size *= 2
    if names is None:
        wanted = [(n, v) for n, v in variables.items() if v.dtype != "S1"]
    else:
        wanted = [(n[0], first_data(variables) if n == ["*"] else resolved(variables, attributes, n)) for n in names]
    for name, found in wanted:
        if found is None:
            continue
        data, dims = (found, [name]) if isinstance(found, np.ndarray) else flattened(values_of(file, found), found.dims)
        for line, values in enumerate(data if data.ndim == 2 else data.reshape(1, -1)):
            yield path, name, dims, list(data.shape), line, values, None


class ContainerPartition(InputPartition):
    def __init__(self, files: list[str], names: list[list[str]] | None):
        self.files, self.names = files, names


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        asked = options.get("variables")
        self.names = [[x.strip() for x in one.split("|")] for one in asked.split(",")] if asked else None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        disk, top = fs.FileSystem.from_uri(self.options["path"])
        found = disk.get_file_info(fs.FileSelector(top, recursive=True))
        pattern = self.options.get("pattern", "*.nc")
        hidden = lambda p: any(x[:1] in "_." for x in p[len(top) :].split("/") if x)
        files = sorted(f.path for f in found if f.type == fs.FileType.File and not hidden(f.path) and fnmatch.fnmatch(f.base_name, pattern))
        each = int(self.options.get("files", "16"))
        groups = [files[k : k + each] for k in range(0, len(files), each)]
        return [ContainerPartition(g, n) for g in groups for n in ([None] if self.names is None else [[x] for x in self.names])]

    def read(self, partition: ContainerPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        disk, _ = fs.FileSystem.from_uri(self.options["path"])
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.float64()), pa.string()]
        for path in partition.files:
            try:
                with disk.open_input_file(path) as file:
                    rows = list(_rows(path, file, partition.names))
            except Exception as wrong:  # a row, not a failed job
                rows = [(path, partition.names[0][0] if partition.names else None, None, None, None, None, f"{type(wrong).__name__}: {wrong}"[:300])]
            for k in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1024]), kinds)], ["path", "variable", "dims", "shape", "line", "values", "error"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ContainerWriter(DataSourceArrowWriter):
    """Files are encoded one after another in a task; a file is held in memory as a whole."""

    def __init__(self, options: dict):
        self.options, self.job = options, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        disk, top = fs.FileSystem.from_uri(self.options["path"])
        dtype = self.options.get("dtype", "f4")
        attributes = json.loads(self.options.get("attributes", "{}"))
        done, own, current, lines = [], f"{top}/_job-{self.job}/{uuid.uuid4().hex}", None, {}

        def finish() -> None:
            if current is None:
                return
            variables = {}
            for name, (dims, shape, rows) in sorted(lines.items()):
                data = np.zeros(shape, dtype)  # lines that don't come are 0
                for k, row in rows.items():
                    if len(row) != shape[-1]:
                        raise ValueError(f"{current}: a line of {name} has {len(row)} numbers, its shape says {shape[-1]}")
                    data.reshape(-1, shape[-1])[k] = row
                variables[name] = (dims, data)
            disk.create_dir(own, recursive=True)
            part = f"{own}/{len(done)}"
            with disk.open_output_stream(part, compression=None) as out:
                out.write(encode(variables, attributes))
            done.append((part, f"{top}/{current}"))

        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("path", "variable", "dims", "shape", "line", "values")]
            for path, variable, dims, shape, line, values in zip(*columns):
                if path != current:
                    finish()
                    current, lines = path, {}
                lines.setdefault(variable, (dims, shape, {}))[2][line] = values
        finish()
        return Written(done)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        disk, top = fs.FileSystem.from_uri(self.options["path"])
        targets = [f for m in messages if m is not None for f in m.files]
        if len({t for _, t in targets}) != len(targets):
            self.abort(messages)
            raise ValueError("the lines of a file came from several tasks")
        for part, target in targets:
            disk.create_dir(target.rsplit("/", 1)[0], recursive=True)
            if disk.get_file_info(target).type != fs.FileType.NotFound:
                disk.delete_file(target)
            disk.move(part, target)
        self._clean(disk, top)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        self._clean(*fs.FileSystem.from_uri(self.options["path"]))

    def _clean(self, disk, top: str) -> None:
        from pyarrow import fs

        if disk.get_file_info(f"{top}/_job-{self.job}").type == fs.FileType.Directory:
            disk.delete_dir(f"{top}/_job-{self.job}")


class Containers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session."""
    spark.dataSource.register(Containers)


def read_containers(spark: SparkSession, path: str, variables: list[list[str]] | None = None, pattern: str = "*.nc") -> DataFrame:
    """Rows of SCHEMA; ``variables``: names of each wanted variable, ["*"] for the first that is neither an axis nor a palette."""
    register(spark)
    reader = spark.read.format("containers").option("pattern", pattern)
    return (reader.option("variables", ",".join("|".join(v) for v in variables)) if variables else reader).load(path)


def write_containers(lines: DataFrame, path: str, dtype: str = "f4", attributes: dict | None = None) -> None:
    """Lines (path, variable, dims, shape, line, values) to files below ``path``; the lines of a file come together, so a file must fit in a task."""
    spark = lines.sparkSession
    register(spark)
    rows = lines.select("path", "variable", "dims", "shape", F.col("line").cast("int").alias("line"), F.col("values").cast("array<double>").alias("values"), F.lit(None).cast("string").alias("error"))
    placed = rows.repartition("path").sortWithinPartitions("path", "variable", "line")
    placed.write.format("containers").mode("append").option("dtype", dtype).option("attributes", json.dumps(attributes or {})).save(path)


def dense_lines(pixels: DataFrame, keys: list[str], height: int, width: int, v: str = "v") -> DataFrame:
    """(keys, line, values) of sparse pixels (keys, i, j, v): all lines of all frames, 0 where there is no pixel."""
    filled = pixels.groupBy(*keys, F.col("i").cast("int").alias("line")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), F.col(v).cast("double")))).alias("m"))
    frames = pixels.select(*keys).distinct().withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    cells = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return frames.join(filled, [*keys, "line"], "left").select(*keys, "line", cells.alias("values"))


def to_pixels(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, v) of all numbers of the lines."""
    return lines.where("error IS NULL").select(*keys, F.col("line").cast("long").alias("i"), F.posexplode("values").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def read_points(spark: SparkSession, path: str, kinds: list[str], fields: tuple[str, ...] = ("lat", "lon", "energy"), pattern: str = "*.nc") -> DataFrame:
    """(path, kind, fields) of points that files hold as lists of equal length, one variable ``<kind>_<field>`` for each kind and field."""
    rows = read_containers(spark, path, [[f"{k}_{f}"] for k in kinds for f in fields], pattern).where("error IS NULL")
    named = rows.select("path", F.substring_index("variable", "_", 1).alias("kind"), F.substring_index("variable", "_", -1).alias("field"), "values")
    lists = named.groupBy("path", "kind").agg(*[F.max(F.when(F.col("field") == f, F.col("values"))).alias(f) for f in fields])
    return lists.select("path", "kind", F.inline(F.arrays_zip(*[F.col(f) for f in fields])))
