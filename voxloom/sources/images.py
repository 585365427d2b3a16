"""Camera containers as a Spark data source, format("gclf"), and the decoding of pixels.

A container is a chunk stream: a GCLF header, then IHDR and IDAT in turn, each with a four-byte type and
a size.  A partition is a file, whose task walks the chunks; a wrong type, a size that does not fit the raster or an unknown
encoding is an error, and so is a container without images.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from voxloom.sources.files import Part, Times, listed, opened

#: The layout and the encodings of the container, and those of messages.
CHUNK = struct.Struct("<4sI")
IHDR = struct.Struct("<q4IQ2iI")
RGB8, MONO8, MONO16 = 1, 2, 4
MESSAGE_RGB8, MESSAGE_MONO8, MESSAGE_BGR8, MESSAGE_MONO16 = 1, 2, 3, 4


def to_rgb(data: bytes, width: int, height: int, encoding: int) -> bytes:
    """Tightly packed pixels of a container as RGB8; of MONO16 the high byte counts."""
    per = {RGB8: 3, MONO8: 1, MONO16: 2}.get(encoding)
    if per is None:
        raise ValueError(f"unsupported encoding {encoding}")
    if len(data) != width * height * per:
        raise ValueError(f"{len(data)} bytes for {width} x {height} pixels of encoding {encoding}")
    px = np.frombuffer(data, dtype=np.uint8).reshape(-1, per)
    return data if encoding == RGB8 else np.repeat(px[:, -1:], 3, axis=1).tobytes()


def message_to_rgb(data: bytes, width: int, height: int, encoding: int, step: int) -> bytes | None:
    """Pixels of a message, whose rows are `step` bytes long, as RGB8; None where they cannot be read."""
    per = {MESSAGE_RGB8: 3, MESSAGE_MONO8: 1, MESSAGE_BGR8: 3, MESSAGE_MONO16: 2}.get(encoding)
    if per is None or width <= 0 or height <= 0 or step < width * per or len(data) < step * (height - 1) + width * per:
        return None
    rows = np.zeros((height, step), dtype=np.uint8)
    flat = np.frombuffer(data, dtype=np.uint8)[: height * step]
    rows.ravel()[: len(flat)] = flat
    px = rows[:, : width * per].reshape(height, width, per)
    if encoding == MESSAGE_BGR8:
        px = px[:, :, ::-1]
    return (px if per == 3 else np.repeat(px[:, :, -1:], 3, axis=2)).tobytes()


def luma(rgb: np.ndarray, bits: int = 8) -> np.ndarray:
    """Grey values of RGB8, 0.299 R + 0.587 G + 0.114 B; 16 bits are scaled by 255."""
    y = rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114
    return y.astype(np.uint8) if bits == 8 else (y * 255).astype(np.uint16)


def walk(f: pa.NativeFile, size: int, path: str) -> Iterator[tuple[int, int]]:
    """(offset of the IHDR chunk, time in ns) of each image; one cut off at the end is left out."""
    head, any_ = f.read(CHUNK.size), False
    if len(head) < CHUNK.size or (kind := CHUNK.unpack(head))[0] != b"GCLF":
        raise ValueError(f"{path}: not a camera container")
    start = CHUNK.size + kind[1]
    while start + CHUNK.size <= size:
        f.seek(start)
        kind, n = CHUNK.unpack(f.read(CHUNK.size))
        if kind != b"IHDR" or n < 8:
            raise ValueError(f"{path}: no image header at byte {start}")
        (t,) = struct.unpack("<q", f.read(8).ljust(8, b"\0"))
        f.seek(start + CHUNK.size + n)
        head = f.read(CHUNK.size)
        if len(head) < CHUNK.size:
            break
        kind, m = CHUNK.unpack(head)
        if kind != b"IDAT":
            raise ValueError(f"{path}: no image data after byte {start}")
        yield start, t
        any_, start = True, start + 2 * CHUNK.size + n + m
    if not any_:
        raise ValueError(f"{path}: no images")


def index(path: str) -> list[tuple[int, int]]:
    ((_, size),) = listed(path)
    with opened(path) as f:
        return list(walk(f, size, path))


def encode(images: list[dict]) -> bytes:
    """A container of images {t_ns, sensor, height, width, encoding, seq, data}."""
    out = [CHUNK.pack(b"GCLF", 12), bytes(12)]
    for x in images:
        head = IHDR.pack(x["t_ns"], x.get("sensor", 0), x["height"], x["width"], x["encoding"], x.get("seq", 0), 0, 0, 0)
        out += [CHUNK.pack(b"IHDR", len(head)), head, CHUNK.pack(b"IDAT", len(x["data"])), x["data"]]
    return b"".join(out)


NAMES = ("idx", "t_ns", "sensor_id", "height", "width", "encoding", "seq", "exposure", "gain", "rgb")
KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.times = options["path"], Times(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds of t_ns: other images are not read."""
        for f in filters:
            if not self.times.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Part(p, n) for p, n in listed(self.path)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as f:
            for k, (start, t) in enumerate(walk(f, part.size, part.path)):
                if not self.times.lo <= t <= self.times.hi:
                    continue
                f.seek(start)
                _, n = CHUNK.unpack(f.read(CHUNK.size))
                t, sensor, h, w, enc, seq, exposure, gain, _ = IHDR.unpack_from(f.read(n))
                _, m = CHUNK.unpack(f.read(CHUNK.size))
                data = f.read(m)
                if len(data) < m:
                    raise ValueError(f"{part.path}: the image at byte {start} is cut off")
                row = (k, t, sensor, h, w, enc, seq, exposure, gain, to_rgb(data, w, h, enc))
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, KINDS, strict=True)], names=list(NAMES))


class CameraContainer(DataSource):
    """Options: path (file or folder), fromNs and toNs (both included)."""

    @classmethod
    def name(cls) -> str:
        return "gclf"

    def schema(self) -> str:
        return "idx int, t_ns long, sensor_id long, height int, width int, encoding int, seq long, exposure int, gain int, rgb binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # readers that take filters need it
    spark.dataSource.register(CameraContainer)
