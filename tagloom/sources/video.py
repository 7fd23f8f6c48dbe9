"""Frames of uncompressed video files (YUV4MPEG2) as a data source.

Frames of such files have one size, so any frame is found by arithmetic. A file is split by bytes; a task reads the
header and then only the frames that its range, the step of sampling and the pushed conditions on filename, frame_index
and timestamp_ms leave; what is left out is never read. Files lie in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import images

SCHEMA = "filename string, frame_index long, timestamp_ms long, width int, height int, fps double, sharpness double, luma binary"
META = "filename string, width int, height int, fps double, frame_count long, duration_ms long"
#: Fixed values of the format: bytes of a frame for each pixel, by colour space.
PIXEL_BYTES = {"mono": (1, 1), "420": (3, 2), "422": (2, 1), "444": (3, 1)}
MARK = b"FRAME\n"
#: Bytes of a file that one task takes, and frames of a batch.
SPLIT, BATCH = 64 << 20, 32


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    fps: float
    begin: int
    frame: int

    @property
    def step(self) -> int:
        """Bytes from one frame to the next."""
        return len(MARK) + self.frame

    def count(self, size: int) -> int:
        return max(0, size - self.begin) // self.step

    def timestamp(self, index: int) -> int:
        return round(index * 1000 / self.fps)


def header_of(head: bytes) -> Header:
    line, end, _ = head.partition(b"\n")
    if not line.startswith(b"YUV4MPEG2 ") or not end:
        raise ValueError("no YUV4MPEG2 header")
    f = {x[:1]: x[1:] for x in line.decode("ascii").split(" ")[1:]}
    w, h = int(f["W"]), int(f["H"])
    over, under = (int(x) for x in f["F"].split(":"))
    times, per = next(v for k, v in PIXEL_BYTES.items() if f.get("C", "420").startswith(k))
    return Header(w, h, over / under if under else 20.0, len(line) + 1, w * h * times // per)


class Range(InputPartition):
    """Bytes of a file, those in which its frames begin."""

    def __init__(self, path: str, size: int, lo: int, hi: int):
        self.path, self.size, self.lo, self.hi = path, size, lo, hi


class VideoReader(DataSourceReader):
    """Shared by frames and their files' descriptions."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.names: set[str] | None = None

    def files(self) -> list[pafs.FileInfo]:
        fs, base = pafs.FileSystem.from_uri(self.root)
        info = fs.get_file_info(base)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(base, recursive=True))
        return [x for x in found if x.is_file and x.extension == "y4m" and (self.names is None or x.base_name in self.names)]

    def open(self, part: Range) -> tuple[pa.NativeFile, Header]:
        fs, _ = pafs.FileSystem.from_uri(self.root)
        f = fs.open_input_file(part.path)
        return f, header_of(f.read_at(min(4096, part.size), 0))


class MetaReader(VideoReader):
    def partitions(self) -> list[Range]:
        return [Range(x.path, x.size, 0, x.size) for x in self.files()]

    def read(self, part: Range) -> Iterator[tuple]:
        f, h = self.open(part)
        with f:
            n = h.count(part.size)
        yield posixpath.basename(part.path), h.width, h.height, h.fps, n, round(n / h.fps * 1000)


class FrameReader(VideoReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.sample_fps, self.pixels = float(options.get("sample_fps", 0)), options.get("pixels", "true") != "false"
        self.bounds: dict[str, tuple[float, float]] = {"frame_index": (0, np.inf), "timestamp_ms": (-np.inf, np.inf)}
        self.read_frames = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "filename" and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = asked if self.names is None else self.names & asked
            elif column in self.bounds and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                lo, hi = self.bounds[column]
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    lo = max(lo, f.value + isinstance(f, GreaterThan))  # both columns are whole numbers
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    hi = min(hi, f.value - isinstance(f, LessThan))
                self.bounds[column] = lo, hi
            else:
                yield f

    def partitions(self) -> list[Range]:
        return [Range(x.path, x.size, lo, min(lo + self.split, x.size)) for x in self.files() for lo in range(0, x.size, self.split)]

    def wanted(self, part: Range, h: Header) -> Iterator[int]:
        """Frames that begin in the range and that conditions and sampling leave."""
        step = max(1, round(h.fps / self.sample_fps)) if self.sample_fps > 0 else 1
        first = max(0, -(-(part.lo - h.begin) // h.step), int(min(self.bounds["frame_index"][0], 1 << 60)))
        end = min(h.count(part.size), -(-(part.hi - h.begin) // h.step), int(min(self.bounds["frame_index"][1], 1 << 60)) + 1)
        lo, hi = self.bounds["timestamp_ms"]
        return (k for k in range(-(-first // step) * step, end, step) if lo <= h.timestamp(k) <= hi)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        f, h = self.open(part)
        name, rows = posixpath.basename(part.path), []
        with f:
            for k in self.wanted(part, h):
                sharp = luma = None
                if self.pixels:
                    raw = f.read_at(len(MARK) + h.width * h.height, h.begin + k * h.step)
                    self.read_frames += 1
                    if not raw.startswith(MARK):
                        raise ValueError(f"{name}: frame {k} has parameters or isn't where its size puts it")
                    luma = raw[len(MARK) :]
                    sharp = images.sharpness(np.frombuffer(luma, np.uint8).reshape(h.height, h.width))
                rows.append((name, k, h.timestamp(k), h.width, h.height, h.fps, sharp, luma))
                if len(rows) == BATCH:
                    yield self.batch(rows)
                    rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary())
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class VideoFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)


class VideoMeta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "video_meta"

    def schema(self) -> str:
        return META

    def reader(self, schema) -> MetaReader:
        return MetaReader(self.options)


def read_frames(spark: SparkSession, path: str, sample_fps: float = 0, pixels: bool = True) -> DataFrame:
    """A row for each frame of the .y4m files at a path. sample_fps > 0: every round(fps / sample_fps)-th. Conditions on filename, frame_index and timestamp_ms reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VideoFrames)
    return spark.read.format("video_frames").option("sample_fps", sample_fps).option("pixels", str(pixels).lower()).load(path)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Size, rate, frames and duration of the .y4m files at a path, from their headers and sizes."""
    spark.dataSource.register(VideoMeta)
    return spark.read.format("video_meta").load(path)


def video_files(frames: DataFrame, width: int, height: int, fps: int, number: Column, luma: Column) -> DataFrame:
    """Rows for write_named: each video's frames (filename, number from 0 without gaps, luma: binary of width * height) as a file."""
    body = frames.select(F.col("filename").alias("path"), number.cast("long").alias("at"), F.concat(F.lit(MARK), luma).alias("content"))
    head = f"YUV4MPEG2 W{width} H{height} F{fps}:1 Ip A1:1 Cmono\n".encode()
    return body.unionByName(frames.select(F.col("filename").alias("path")).distinct().select("path", F.lit(-1).cast("long").alias("at"), F.lit(head).alias("content")))
