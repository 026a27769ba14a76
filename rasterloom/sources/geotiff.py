"""GeoTIFF as a Spark data source: pixels of a window of a file for each task, decoded in numpy.

Baseline and tiled TIFF, classic and BigTIFF, both byte orders; 8- to 64-bit integers and 32- and 64-bit floats; no compression, deflate, LZW and PackBits; predictors 1, 2
and 3; bands in chunky or planar order. Georeferencing from the model tags (scale and tie point, or transformation) and the geographic or projected EPSG key. Anything else raises ValueError.

A task opens its file by a range-reading client (local and mounted paths, file:, s3:, s3a:, gs:, hdfs:) and fetches the blocks of its
window alone. Other stores are read by Spark's binaryFile reader, a whole file a task. Headers are read on the driver, in any store, by
ranges. write_geotiffs() is the sink: a file for each strip of rows, written by the tasks that hold them.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..grid import Grid, Raster
from ..session import Files, ready

#: Rows and columns of a window: what one task of the data source decodes.
WINDOW = 4000
SCHEMA = "path string, band int, yi int, xi int, value double"
_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


def _lzw(data: bytes) -> bytes:
    out, table, size = bytearray(), [], 9
    pos, total, old = 0, len(data) * 8, None
    number = int.from_bytes(data, "big")
    while pos + size <= total:
        code = number >> (total - pos - size) & ((1 << size) - 1) if total < 4096 else int.from_bytes(data[pos // 8 : (pos + size + 7) // 8], "big") >> (-(pos + size) % 8) & ((1 << size) - 1)
        pos += size
        if code == 256:
            table, size, old = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        if old is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else old + old[:1]
            table.append(old + entry[:1])
        out += entry
        old = entry
        if len(table) + 1 >= 1 << size and size < 12:
            size += 1
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i] if data[i] < 128 else data[i] - 256
        if n >= 0:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n != -128:
                out += data[i + 1 : i + 2] * (1 - n)
            i += 2
    return bytes(out)


@dataclass
class Tiff:
    """The first image of a file."""

    tags: dict[int, Any]
    order: str

    @staticmethod
    def open(f: BinaryIO) -> Tiff:
        head = f.read(16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF file")
        o = "<" if head[:2] == b"II" else ">"
        version = struct.unpack(o + "H", head[2:4])[0]
        if version == 42:
            at, count, entry, inline = struct.unpack(o + "I", head[4:8])[0], "H", o + "HHI", 4
        elif version == 43:
            at, count, entry, inline = struct.unpack(o + "Q", head[8:16])[0], "Q", o + "HHQ", 8
        else:
            raise ValueError("not a TIFF file")
        f.seek(at)
        n = struct.unpack(o + count, f.read(struct.calcsize(o + count)))[0]
        size = struct.calcsize(entry) + inline
        block = f.read(n * size)
        tags: dict[int, Any] = {}
        for k in range(n):
            raw = block[k * size : (k + 1) * size]
            tag, kind, length = struct.unpack(entry, raw[: size - inline])
            if kind not in _SIZES:
                continue
            form = _SIZES[kind]
            item = struct.calcsize(o + form)
            data = raw[size - inline :]
            if item * length > inline:
                f.seek(struct.unpack(o + ("I" if inline == 4 else "Q"), data)[0])
                data = f.read(item * length)
            data = data[: item * length]
            tags[tag] = data if form == "s" else struct.unpack(o + form * length, data)
        return Tiff(tags, o)

    def one(self, tag: int, default: Any = None) -> Any:
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def width(self) -> int:
        return self.one(256)

    @property
    def height(self) -> int:
        return self.one(257)

    @property
    def bands(self) -> int:
        return self.one(277, 1)

    @property
    def dtype(self) -> np.dtype:
        bits, kind = self.one(258, 1), self.one(339, 1)
        if bits not in (8, 16, 32, 64) or (kind == 3 and bits < 32) or kind not in (1, 2, 3):
            raise ValueError(f"samples of {bits} bits and format {kind} aren't supported")
        return np.dtype(f"{self.order}{'uif'[kind - 1]}{bits // 8}")

    @property
    def nodata(self) -> float | None:
        raw = self.tags.get(42113)
        try:
            return float(raw.rstrip(b"\0 ").decode()) if raw else None
        except ValueError:
            return None

    def grid(self) -> Grid:
        crs = "EPSG:4326"
        keys = self.tags.get(34735, ())
        for k in range(4, len(keys) - 3, 4):
            if keys[k] in (2048, 3072) and keys[k + 1] == 0 and keys[k + 3] not in (0, 32767):
                crs = f"EPSG:{keys[k + 3]}"
        if 34264 in self.tags:
            m = self.tags[34264]
            if m[1] or m[4]:
                raise ValueError("rotated rasters aren't supported")
            return Grid(m[3], m[7], m[0], m[5], self.width, self.height, crs)
        if 33550 not in self.tags or 33922 not in self.tags:
            raise ValueError("the file has no georeference")
        sx, sy = self.tags[33550][:2]
        i, j, _, x, y = self.tags[33922][:5]
        return Grid(x - i * sx, y + j * sy, sx, -sy, self.width, self.height, crs)

    def _decode(self, data: bytes, rows: int, cols: int, samples: int) -> np.ndarray:
        how = self.one(259, 1)
        if how in (8, 32946):
            data = zlib.decompress(data)
        elif how == 5:
            data = _lzw(data)
        elif how == 32773:
            data = _packbits(data)
        elif how != 1:
            raise ValueError(f"compression {how} isn't supported")
        dtype, predictor = self.dtype, self.one(317, 1)
        n = rows * cols * samples
        if predictor == 3:
            b = np.frombuffer(data, np.uint8, n * dtype.itemsize).reshape(rows, cols * dtype.itemsize, samples)
            b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * samples)
            return np.ascontiguousarray(b.transpose(0, 2, 1)).view(f">f{dtype.itemsize}").reshape(rows, cols, samples)
        a = np.frombuffer(data, dtype, n).reshape(rows, cols, samples)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=dtype.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} isn't supported")
        return a

    def read(self, f: BinaryIO, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
        """(bands, y1 - y0, x1 - x0), reading only the blocks that the window meets."""
        tiled = 322 in self.tags
        w, h = (self.one(322), self.one(323)) if tiled else (self.width, min(self.one(278, self.height), self.height))
        offsets, counts = (self.tags[324], self.tags[325]) if tiled else (self.tags[273], self.tags[279])
        across, down = -(-self.width // w), -(-self.height // h)
        planar = self.one(284, 1) == 2
        samples = 1 if planar else self.bands
        out = np.zeros((self.bands, y1 - y0, x1 - x0), self.dtype.newbyteorder("="))
        for plane in range(self.bands if planar else 1):
            for r in range(y0 // h, -(-y1 // h)):
                for c in range(x0 // w, -(-x1 // w)):
                    k = (plane * down + r) * across + c
                    f.seek(offsets[k])
                    data = f.read(counts[k])
                    if not counts[k]:
                        continue
                    rows = h if tiled else min(h, self.height - r * h)
                    block = self._decode(data, rows, w, samples)
                    ya, yz, xa, xz = max(y0, r * h), min(y1, r * h + rows, self.height), max(x0, c * w), min(x1, (c + 1) * w, self.width)
                    part = block[ya - r * h : yz - r * h, xa - c * w : xz - c * w].transpose(2, 0, 1)
                    out[plane if planar else slice(None), ya - y0 : yz - y0, xa - x0 : xz - x0] = part[0] if planar else part
        return out


def _rows(path: str, t: Tiff, f: BinaryIO, y0: int, y1: int, x0: int, x1: int) -> Iterator[pa.RecordBatch]:
    """Pixels of a window, some rows at a time; no data and NaN as null."""
    # in steps of whole blocks, so that none is decoded twice
    high = t.one(323) if 322 in t.tags else min(t.one(278, t.height), t.height)
    step = max(1, (1 << 18) // max(1, (x1 - x0) * high)) * high
    a = y0
    while a < y1:
        z = min(y1, (a // high) * high + step)
        values = t.read(f, a, z, x0, x1).astype(float)
        missing = np.isnan(values) if t.nodata is None else np.isnan(values) | (values == t.nodata)
        band, yi, xi = np.indices(values.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([path] * values.size), pa.array(band.ravel()), pa.array(yi.ravel() + np.int32(a)), pa.array(xi.ravel() + np.int32(x0)), pa.array(values.ravel(), mask=missing.ravel())], names=["path", "band", "yi", "xi", "value"])
        a = z


#: Stores whose files a Python worker reads by ranges.
RANGED = ("file", "s3", "s3a", "gs", "hdfs")


def _scheme(path: str) -> str:
    return path.partition(":")[0] if re.match(r"[a-z][a-z0-9+.-]+:/", path) else "file"


def open_file(path: str, write: bool = False) -> BinaryIO:
    """A file of a store in RANGED, for reading by ranges or for writing."""
    if _scheme(path) == "file":
        return open(_plain(path), "wb" if write else "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_output_stream(inner) if write else store.open_input_file(inner)


class _Ranges(io.RawIOBase):
    """A file read in pieces by read(start, size)."""

    def __init__(self, read, piece: int = 1 << 16) -> None:
        self.get, self.piece, self.at, self.start, self.held = read, piece, 0, 0, b""

    def seek(self, at: int, whence: int = 0) -> int:
        self.at = at
        return at

    def read(self, size: int = -1) -> bytes:
        if not self.start <= self.at <= self.at + size <= self.start + len(self.held):
            self.start, self.held = self.at, self.get(self.at, max(size, self.piece))
        out = self.held[self.at - self.start : self.at - self.start + size]
        self.at += len(out)
        return out


def open_header(spark: SparkSession, path: str) -> Tiff:
    """The header of a file in any store, without its pixels."""
    files = Files(spark)
    return Tiff.open(_Ranges(lambda start, size: files.read(path, start, size)))


@dataclass
class _Window(InputPartition):
    path: str
    y0: int
    y1: int
    x0: int
    x1: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["files"]) if "files" in options else options["path"].split(",")
        self.window = int(options.get("window", WINDOW))

    def partitions(self) -> list[_Window]:
        out = []
        for path in self.paths:
            with open_file(path) as f:
                t = Tiff.open(f)
            # windows of whole blocks
            w, h = (t.one(322), t.one(323)) if 322 in t.tags else (1, min(t.one(278, t.height), t.height))
            across, down = -(-self.window // w) * w, -(-self.window // h) * h
            out += [_Window(path, y, min(y + down, t.height), x, min(x + across, t.width)) for y in range(0, t.height, down) for x in range(0, t.width, across)]
        return out

    def read(self, partition: _Window) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as f:
            yield from _rows(partition.path, Tiff.open(f), f, partition.y0, partition.y1, partition.x0, partition.x1)


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff").option("window", n).load(path): files that every executor can open by their path."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_local(spark: SparkSession, *paths: str, window: int = WINDOW) -> DataFrame:
    """Files on a file system that all executors mount, a task for each window."""
    return read_windows(spark, [os.path.abspath(p) for p in paths], window)


def read_windows(spark: SparkSession, paths: list[str], window: int = WINDOW) -> DataFrame:
    """Files of stores in RANGED, a task for each window; no file is read whole and nothing is shuffled."""
    ready(spark).dataSource.register(GeoTiffSource)
    return spark.read.format("geotiff").option("window", window).option("files", json.dumps(paths)).load()


def read_geotiffs(spark: SparkSession, paths: list[str], window: int = WINDOW) -> DataFrame:
    """(path, band, yi, xi, value) of files in any store that Spark reads. Those of RANGED stores have a task for each window; of others a task takes one or more whole files, each of which must fit in an executor's memory (2 GB at most). path is as it was given."""
    if all(_scheme(p) in RANGED for p in paths):
        return read_windows(spark, paths, window)
    names = {_plain(p): p for p in paths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = io.BytesIO(content.as_buffer())
                t = Tiff.open(f)
                yield from _rows(names.get(_plain(path), path), t, f, 0, t.height, 0, t.width)

    return ready(spark).read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, SCHEMA)


def _plain(path: str) -> str:
    return path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file:") else path


def tiff_grid(spark: SparkSession, path: str) -> Grid:
    """The grid of a file: georeference and size, from its header."""
    return open_header(spark, path).grid()


def write_geotiffs(raster: Raster, folder: str, rows: int = 256, nodata: float = -1.0, compress: str = "deflate") -> DataFrame:
    """(path, y_lo, ny): a file for each strip of `rows` rows of a static raster of one variable, written by the task that holds the strip. Cells without a value hold nodata. folder: of a store in RANGED that the executors can write."""
    r = raster.select()
    spark, grid, v = ready(r.pixels.sparkSession), r.grid, r.variables[0]
    if _scheme(folder) not in RANGED:
        raise ValueError(f"no writer for {folder}")
    kind = {"tinyint": "int16", "smallint": "int16", "int": "int32", "float": "float32"}.get(dict(r.pixels.dtypes)[v], "float64")

    def write(key: tuple, part: pa.Table) -> pa.Table:
        k = int(key[0].as_py())
        y_lo, ny = k * rows, min(rows, grid.ny - k * rows)
        values = part["v"].drop_null() if part.num_rows else part["v"]
        ok = part["v"].is_valid().to_numpy()
        a = np.full((1, ny, grid.nx), nodata, kind)
        a[0, part["yi"].to_numpy()[ok] - y_lo, part["xi"].to_numpy()[ok]] = values.to_numpy()
        path = f"{folder}/strip_{k}.tif"
        data = tiff_bytes(a, grid.window(0, grid.nx - 1, y_lo, y_lo + ny - 1), nodata, None, compress)
        if _scheme(folder) == "file":  # a second attempt at the same strip may run beside the first
            os.makedirs(_plain(folder), exist_ok=True)
            temporary = f"{_plain(path)}.{uuid.uuid4().hex}"
            with open(temporary, "wb") as f:
                f.write(data)
            os.replace(temporary, _plain(path))
        else:
            with open_file(path, write=True) as f:
                f.write(data)
        return pa.table({"path": [path], "y_lo": pa.array([y_lo], pa.int32()), "ny": pa.array([ny], pa.int32())})

    strips = r.pixels.select(F.floor(F.col("yi") / rows).alias("strip"), "yi", "xi", F.col(v).alias("v"))
    return strips.groupBy("strip").applyInArrow(write, "path string, y_lo int, ny int")


def write_tiff(path: str, bands: np.ndarray, grid: Grid, nodata: float | None = None, tile: int | None = None, compress: str = "none", predictor: int = 1) -> None:
    """One local file, see tiff_bytes()."""
    with open(path, "wb") as f:
        f.write(tiff_bytes(bands, grid, nodata, tile, compress, predictor))


def tiff_bytes(bands: np.ndarray, grid: Grid, nodata: float | None = None, tile: int | None = None, compress: str = "none", predictor: int = 1) -> bytes:
    """A file of (bands, rows, columns), in strips of 64 rows or tiles; compress none or deflate."""
    bands = np.asarray(bands)
    b, rows, cols = bands.shape
    chunky = np.ascontiguousarray(bands.transpose(1, 2, 0)).astype(bands.dtype.newbyteorder("<"))
    w, h = (tile, tile) if tile else (cols, 64)
    blocks = []
    for y in range(0, rows, h):
        for x in range(0, cols, w):
            part = chunky[y : y + h, x : x + w]
            if tile:
                full = np.zeros((h, w, b), part.dtype)
                full[: part.shape[0], : part.shape[1]] = part
                part = full
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            raw = np.ascontiguousarray(part).tobytes()
            blocks.append(zlib.compress(raw) if compress == "deflate" else raw)
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    code = int(grid.crs.split(":")[1])
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if code == 4326 else 1, 2048 if code == 4326 else 3072, 0, 1, code)
    tags: list[tuple[int, str, tuple]] = [(256, "I", (cols,)), (257, "I", (rows,)), (258, "H", (bands.dtype.itemsize * 8,) * b), (259, "H", (8 if compress == "deflate" else 1,)), (262, "H", (1,)), (277, "H", (b,)), (284, "H", (1,)), (317, "H", (predictor,)), (339, "H", (kind,) * b), (33550, "d", (abs(grid.dx), abs(grid.dy), 0.0)), (33922, "d", (0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0)), (34735, "H", keys)]
    tags += [(322, "I", (w,)), (323, "I", (h,))] if tile else [(278, "I", (h,))]
    if grid.dy > 0:
        tags = [t for t in tags if t[0] not in (33550, 33922)] + [(34264, "d", (grid.dx, 0.0, 0.0, grid.x0, 0.0, grid.dy, 0.0, grid.y0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0))]
    at, offsets = 8, []
    for x in blocks:
        offsets.append(at)
        at += len(x) + len(x) % 2
    tags += [(324 if tile else 273, "I", tuple(offsets)), (325 if tile else 279, "I", tuple(map(len, blocks)))]
    raw_tags = [(t, {"H": 3, "I": 4, "d": 12}[k], len(v), struct.pack("<" + k * len(v), *v)) for t, k, v in tags]
    if nodata is not None:
        text = f"{nodata:g}\0".encode()
        raw_tags.append((42113, 2, len(text), text))
    raw_tags.sort()
    end = at + 2 + 12 * len(raw_tags) + 4
    body, extra = b"", b""
    for tag, kind_, n, raw in raw_tags:
        if len(raw) <= 4:
            value = raw.ljust(4, b"\0")
        else:
            value = struct.pack("<I", end + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        body += struct.pack("<HHI", tag, kind_, n) + value
    return b"".join([struct.pack("<2sHI", b"II", 42, at), *(x + b"\0" * (len(x) % 2) for x in blocks), struct.pack("<H", len(raw_tags)), body, struct.pack("<I", 0), extra])
