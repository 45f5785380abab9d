"""Raw frame files as a Spark source and sink: frames of a fixed size end to end, one file a video, no header.

    spark.dataSource.register(RawFrames)
    spark.read.format("raw_frames").options(path=folder, width=320, height=180).load()

A file is read in ranges that begin and end with whole frames, so any number of tasks gives the same frames; a stream reads what files have grown by. A tail that
is no whole frame is left where it is: ``tails`` reports it, and a stream reads it once the rest has come.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FRAME = "video string, frame long, t double, width int, height int, channels int, pixels binary"
SUFFIX = ".raw"


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class _Wrote(WriterCommitMessage):
    drafts: list


class _Shape:
    """The options: ``width``, ``height``, ``channels`` (1 grey, 3 blue-green-red), ``fps`` and ``frames_per_part``."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("raw_frames needs a path")
        self.path = options["path"]
        self.width, self.height, self.channels = int(options.get("width", 0)), int(options.get("height", 0)), int(options.get("channels", 1))
        self.fps, self.per_part = float(options.get("fps", 1.0)), int(options.get("frames_per_part", 256))
        self.size = self.width * self.height * self.channels
        if self.size < 1 or self.fps <= 0 or self.per_part < 1:
            raise ValueError("raw_frames needs a width and a height, and fps and frames_per_part above 0")

    def store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def files(self) -> list[tuple[str, int]]:
        """(path in the store, size) of the folder's frame files, in order of names."""
        fs, root = self.store()
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(SUFFIX))

    def cut(self, path: str, first: int, last: int) -> list[_Range]:
        return [_Range(path, a, min(a + self.per_part, last)) for a in range(first, last, self.per_part)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = self.store()
        video = posixpath.basename(part.path).removesuffix(SUFFIX)
        some = max(1, min(32, (8 << 20) // self.size))
        with fs.open_input_file(part.path) as f:
            f.seek(part.first * self.size)
            for at in range(part.first, part.last, some):
                n = min(some, part.last - at)
                raw = [f.read(self.size) for _ in range(n)]
                if any(len(x) < self.size for x in raw):
                    raise OSError(f"{part.path} has become shorter")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([video] * n), pa.array(range(at, at + n), pa.int64()), pa.array([i / self.fps for i in range(at, at + n)], pa.float64()), *(pa.array([v] * n, pa.int32()) for v in (self.width, self.height, self.channels)), pa.array(raw, pa.binary())],
                    names=[x.split()[0] for x in FRAME.split(", ")],
                )


class _Reader(DataSourceReader):
    def __init__(self, shape: _Shape):
        self.shape = shape

    def partitions(self) -> list[_Range]:
        return [r for path, size in self.shape.files() for r in self.shape.cut(path, 0, size // self.shape.size)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        return self.shape.read(part) if isinstance(part, _Range) else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets say for each file how many frames have been read."""

    def __init__(self, shape: _Shape):
        self.shape = shape

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: size // self.shape.size for path, size in self.shape.files()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [r for path, n in sorted(end.items()) for r in self.shape.cut(path, start.get(path, 0), n)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        return self.shape.read(part)

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceWriter):
    """Rows come with a video's frames in order in one task; a task's files get their names once all tasks are done."""

    def __init__(self, shape: _Shape):
        self.shape = shape

    def write(self, rows: Iterator) -> _Wrote:
        import uuid

        fs, root = self.shape.store()
        fs.create_dir(root, recursive=True)
        drafts, out, now, due = [], None, None, 0
        try:
            for r in rows:
                if out is None or r["video"] != now:
                    if out is not None:
                        out.close()
                    now, due = r["video"], 0
                    draft = f"{root}/.{now}-{uuid.uuid4().hex}"
                    drafts.append((draft, f"{root}/{now}{SUFFIX}"))
                    out = fs.open_output_stream(draft)
                if len(r["pixels"]) != self.shape.size or r["frame"] != due:
                    raise ValueError(f"{now}: frame {r['frame']} of {len(r['pixels'])} bytes, where frame {due} of {self.shape.size} is due")
                out.write(bytes(r["pixels"]))
                due += 1
        finally:
            if out is not None:
                out.close()
        return _Wrote(drafts)

    def commit(self, messages: list) -> None:
        fs, _ = self.shape.store()
        for m in messages:
            for draft, name in m.drafts if m else []:
                fs.move(draft, name)

    def abort(self, messages: list) -> None:
        fs, _ = self.shape.store()
        for m in messages:
            for draft, _ in m.drafts if m else []:
                fs.delete_file(draft)


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Shape(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(_Shape(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(_Shape(self.options))


def read_frames(spark: SparkSession, path: str, width: int, height: int, channels: int = 1, fps: float = 1.0, frames_per_part: int = 256) -> DataFrame:
    spark.dataSource.register(RawFrames)
    return spark.read.format("raw_frames").options(path=path, width=width, height=height, channels=channels, fps=fps, frames_per_part=frames_per_part).load()


def stream_frames(spark: SparkSession, path: str, width: int, height: int, channels: int = 1, fps: float = 1.0, frames_per_part: int = 256) -> DataFrame:
    spark.dataSource.register(RawFrames)
    return spark.readStream.format("raw_frames").options(path=path, width=width, height=height, channels=channels, fps=fps, frames_per_part=frames_per_part).load()


def write_frames(frames: DataFrame, path: str, width: int, height: int, channels: int = 1) -> None:
    """``frames(video, frame, pixels)``, numbered from 0 without gaps, to a file a video; a video's file is written by one task, a frame at a time."""
    frames.sparkSession.dataSource.register(RawFrames)
    rows = frames.select("video", "frame", "pixels").repartition("video").sortWithinPartitions("video", "frame")
    rows.write.format("raw_frames").options(path=path, width=width, height=height, channels=channels).mode("append").save()


def tails(spark: SparkSession, path: str, width: int, height: int, channels: int = 1) -> DataFrame:
    """(video, frames, tail_bytes): whole frames of each file and what is left behind them, which is 0 unless the file was cut off."""
    shape = _Shape({"path": path, "width": width, "height": height, "channels": channels})
    rows = [(posixpath.basename(p).removesuffix(SUFFIX), n // shape.size, n % shape.size) for p, n in shape.files()]
    return spark.createDataFrame(rows, "video string, frames long, tail_bytes long")
