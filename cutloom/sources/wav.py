"""WAV files as a source: their facts, by walking the chunks of each file with ranged reads. Sound is never read.

    spark.dataSource.register(WavSource)
    spark.read.format("wav_facts").option("path", "file:///recordings").load()

Every file has a row; one that is no such file, or a broken one, has its ``fault`` instead of facts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FACTS = "path string, bytes long, codec int, channels int, sample_rate long, bits int, data_bytes long, duration_s double, fault string"
#: Files that a task reads the headers of.
FILES = 64
#: Chunks of a file that are walked before it counts as broken.
MOST_CHUNKS = 10_000
EXTENSIBLE, UNKNOWN_SIZE = 0xFFFE, 0xFFFFFFFF


def facts(source: BinaryIO, size: int) -> tuple:
    """(codec, channels, sample_rate, bits, data_bytes, duration_s, fault) of an open file of ``size`` bytes.

    RIFF and RF64 (or BW64) files; chunks come in any order, their sizes are padded to even ones. The codec of an extensible format is the one that its
    sub-format begins with. A data chunk that is longer than the file, as of a recording that was cut off, counts as far as the file goes.
    """
    head = source.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64", b"BW64") or head[8:] != b"WAVE":
        return None, None, None, None, None, None, "no_wave"
    at, form, data, large = 12, None, None, None
    for _ in range(MOST_CHUNKS):
        source.seek(at)
        label = source.read(8)
        if len(label) < 8:
            break
        name, length = label[:4], struct.unpack("<I", label[4:])[0]
        if name == b"ds64":
            held = source.read(24)
            large = struct.unpack("<QQQ", held)[1] if len(held) == 24 else None
        elif name == b"fmt ":
            form = source.read(min(length, 40))
        elif name == b"data":
            length = large if length == UNKNOWN_SIZE and large is not None else length
            data = min(length, max(0, size - at - 8))
        if form is not None and data is not None:
            break
        at += 8 + length + length % 2
    if form is None or len(form) < 16:
        return None, None, None, None, data, None, "no_format"
    codec, channels, rate, per_second, _, bits = struct.unpack("<HHIIHH", form[:16])
    if codec == EXTENSIBLE and len(form) >= 26:
        codec = struct.unpack("<H", form[24:26])[0]
    if data is None:
        return codec, channels, rate, bits, None, None, "no_data"
    return codec, channels, rate, bits, data, data / per_second if per_second else None, None


def located(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path or address, the path in it, and what stands before that in an address."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    system, inside = pafs.FileSystem.from_uri(path)
    return system, inside, path[: path.index(inside)]


def read_facts(path: str) -> tuple:
    """The row of one file; what goes wrong in reading it is its fault."""
    try:
        system, inside, _ = located(path)
        with system.open_input_file(inside) as source:
            size = source.size()
            return path, size, *facts(source, size)
    except OSError as wrong:
        return path, *[None] * 7, f"unreadable: {type(wrong).__name__}"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Files]:
        """All files below the path whose names end as ``suffix`` says, a few to a task."""
        path, suffix = self.options["path"], self.options.get("suffix", "").lower()
        system, inside, before = located(path)
        one = system.get_file_info(inside)
        found = system.get_file_info(pafs.FileSelector(inside, recursive=True)) if one.type == pafs.FileType.Directory else [one]
        paths = sorted(before + f.path for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(suffix))
        return [Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from map(read_facts, partition.paths)


class WavSource(DataSource):
    """``wav_facts``: option ``path``, a file or folder; option ``suffix``, how names end (all files by default)."""

    @classmethod
    def name(cls) -> str:
        return "wav_facts"

    def schema(self) -> str:
        return FACTS

    def reader(self, schema) -> WavReader:  # noqa: ANN001
        return WavReader(self.options)


def wav_facts(files: DataFrame) -> DataFrame:
    """The facts of ``files`` (path), which Spark has listed (as ``sources.logs.files`` does): more of them than a driver should list are read this way. Its listing passes over files of no length."""

    def read(rows: Iterator) -> Iterator:
        import pandas as pd

        names = [f.split(" ")[0] for f in FACTS.split(", ")]
        for batch in rows:
            yield pd.DataFrame([read_facts(p) for p in batch["path"]], columns=names).astype({n: "Int64" for n in ("bytes", "codec", "channels", "sample_rate", "bits", "data_bytes")})

    return files.select("path").mapInPandas(read, FACTS)


def silence(channels: int, sample_rate: int, bits: int, frames: int) -> bytes:
    """A WAV file of so many silent frames."""
    width = channels * bits // 8
    form = struct.pack("<HHIIHH", 1, channels, sample_rate, sample_rate * width, width, bits)
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", frames * width) + b"\0" * (frames * width)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def write_silence(files: DataFrame, root: str) -> int:
    """Writes a silent file below ``root`` for each of ``files`` (name, channels, sample_rate, bits, frames), as fixtures of timelines need them; their number. A file is in a task's memory while it is written."""

    def write(rows: Iterator) -> Iterator:
        import pandas as pd

        system, inside, _ = located(root)
        system.create_dir(inside, recursive=True)
        for batch in rows:
            for name, channels, rate, bits, frames in batch.itertuples(index=False):
                with system.open_output_stream(f"{inside}/{name}") as out:
                    out.write(silence(channels, rate, bits, frames))
            yield pd.DataFrame({"n": [len(batch)]})

    written = files.select("name", "channels", "sample_rate", "bits", "frames").mapInPandas(write, "n long")
    return written.agg({"n": "sum"}).first()[0] or 0
