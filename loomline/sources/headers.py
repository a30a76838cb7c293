"""Camera headers of picture files, and folders of binary files, as Spark data sources that read no more than they must."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from loomline.sources.shared import ship

# Numbers of the tags, sizes and layouts of the value types, the marks at the start of a file.
TAGS = {271: "make", 272: "model", 306: "datetime", 36867: "datetime_original", 33434: "exposure", 33437: "fnumber", 34855: "iso", 37386: "focal"}
DIRECTORY = 34665
KINDS = {2: "text", 3: "H", 4: "I", 5: "II", 9: "i", 10: "ii"}
MARKS = {b"II": (b"*\0", b"RO", b"RS", b"OR"), b"MM": (b"\0*", b"RO", b"RS", b"OR")}
SCHEMA = "path string, length long, make string, model string, datetime string, exposure double, fnumber double, iso long, focal double"
#: Directories lie near the start of a file; no more of it is read. A directory of more entries than this is damaged.
HEAD_BYTES, MOST_ENTRIES, MOST_DIRECTORIES = 1 << 20, 512, 8
FILES_PER_PARTITION = 256


def tiff_part(head: bytes) -> bytes:
    """What of a file's head is laid out as TIFF: the head itself, or in a JPEG the Exif segment; empty if neither."""
    if head[:2] in MARKS:
        return head
    at = 2 if head[:2] == b"\xff\xd8" else len(head)
    while at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        if head[at + 1] == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            return head[at + 10 : at + 2 + size]
        at += 2 + max(size, 2)
    return b""


def entries(data: bytes, order: str, offset: int) -> Iterator[tuple[int, int, int, int]]:
    """(tag, kind, count, place of the value) of a directory; entries whose value lies outside the data are passed over."""
    if not 0 < offset <= len(data) - 2:
        return
    (n,) = struct.unpack_from(order + "H", data, offset)
    for place in range(offset + 2, min(offset + 2 + 12 * min(n, MOST_ENTRIES), len(data) - 11), 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        layout = KINDS.get(kind, "B")
        size = count * (1 if layout == "text" else struct.calcsize(order + layout))
        value = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
        if count and value + size <= len(data):
            yield tag, kind, count, value


def header(head: bytes) -> dict[str, object]:
    """The known tags of a file's head by name; what is missing, empty or damaged is left out.

    Texts end at the first zero byte; a ratio over zero is 0. Directories that a directory names are read too, later
    ones decide, each place once, so offsets that lead back end. The time when the picture was taken goes before that of the file.
    """
    data, found = tiff_part(head), {}
    if len(data) < 8 or data[2:4] not in MARKS.get(data[:2], ()):
        return found
    order = "<" if data[:2] == b"II" else ">"
    todo, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo and len(seen) < MOST_DIRECTORIES:
        offset = todo.pop(0)
        if offset in seen:
            continue
        seen.add(offset)
        for tag, kind, count, at in entries(data, order, offset):
            layout = KINDS.get(kind)
            if tag == DIRECTORY and at + 4 <= len(data):
                todo.append(struct.unpack_from(order + "I", data, at)[0])
            elif tag in TAGS and layout == "text":
                found[TAGS[tag]] = data[at : at + count].split(b"\0")[0].decode("latin-1").strip()
            elif tag in TAGS and layout:
                numbers = struct.unpack_from(order + layout, data, at)
                found[TAGS[tag]] = numbers[0] if len(numbers) == 1 else numbers[0] / numbers[1] if numbers[1] else 0.0
    taken = found.pop("datetime_original", None)
    return {k: v for k, v in (found | ({"datetime": taken} if taken else {})).items() if v != ""}


def header_bytes(fields: dict[str, object], order: str = "<") -> bytes:
    """A TIFF head with these fields, as renders carry them over: texts and the time in the first directory, the exposure in one of its own."""
    number = {name: tag for tag, name in TAGS.items()}

    def directory(values: dict[int, object], start: int) -> bytes:
        table, beyond = struct.pack(order + "H", len(values)), b""
        rest = start + 2 + 12 * len(values) + 4
        for tag, value in sorted(values.items()):
            if isinstance(value, str):
                kind, held = 2, value.encode("latin-1", "replace") + b"\0"
                count = len(held)
            elif isinstance(value, float):
                ratio = Fraction(value).limit_denominator(1 << 20)
                kind, count, held = 5, 1, struct.pack(order + "II", ratio.numerator, ratio.denominator)
            else:
                kind, count, held = 4, 1, struct.pack(order + "I", value)
            table += struct.pack(order + "HHI", tag, kind, count)
            if len(held) <= 4:
                table += held.ljust(4, b"\0")
            else:
                table += struct.pack(order + "I", rest + len(beyond))
                beyond += held + b"\0" * (len(held) % 2)
        return table + b"\0" * 4 + beyond

    first = {number[k]: v for k, v in fields.items() if k in ("make", "model", "datetime") and v is not None}
    second = {number[k]: v for k, v in fields.items() if k not in ("make", "model", "datetime") and v is not None}
    length = len(directory(first | {DIRECTORY: 0}, 8))
    mark = {"<": b"II*\0", ">": b"MM\0*"}[order]
    return mark + struct.pack(order + "I", 8) + directory(first | {DIRECTORY: 8 + length}, 8) + directory(second, 8 + length)


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int]]
    folder: str | None = None


class _HeaderReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.uri, self.endings, self.names = options["path"], tuple(options.get("endings", "").split()), names

    def _kept(self, found: list) -> list[tuple[str, int]]:
        return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(".") and (not self.endings or f.base_name.lower().endswith(self.endings)))

    def partitions(self) -> list[_Files]:
        """The files of the folder itself by number, and each folder in it, which the task that gets it lists."""
        import pyarrow.fs

        fs, path = _place(self.uri)
        found = fs.get_file_info(pyarrow.fs.FileSelector(path))
        files, folders = self._kept(found), sorted(f.path for f in found if f.type == pyarrow.fs.FileType.Directory)
        return [_Files(files[i : i + FILES_PER_PARTITION]) for i in range(0, len(files), FILES_PER_PARTITION)] + [_Files([], f) for f in folders] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, _ = _place(self.uri)
        files = partition.files
        if partition.folder is not None:
            files = self._kept(fs.get_file_info(pyarrow.fs.FileSelector(partition.folder, recursive=True)))
        for i in range(0, len(files), FILES_PER_PARTITION):
            yield self._batch(fs, files[i : i + FILES_PER_PARTITION])

    def _batch(self, fs: pa.fs.FileSystem, files: list[tuple[str, int]]) -> pa.RecordBatch:
        wanted = [n for n in self.names if n not in ("path", "length")]
        kinds = {"iso": pa.int64(), "exposure": pa.float64(), "fnumber": pa.float64(), "focal": pa.float64()}
        rows: dict[str, list] = {n: [] for n in self.names}
        for path, size in files:
            known = {}
            if wanted:  # else nothing is opened
                with fs.open_input_file(path) as f:
                    known = header(f.read(min(size, HEAD_BYTES)))
            known |= {"path": path, "length": size}
            for n in self.names:
                rows[n].append(_typed(known.get(n), n))
        return pa.RecordBatch.from_arrays([pa.array(rows[n], pa.int64() if n == "length" else kinds.get(n, pa.string())) for n in self.names], self.names)


def _typed(value: object, name: str) -> object:
    """The value if it is of its column's kind, as far as it can be taken so; else null."""
    if value is None or name in ("path", "length"):
        return value
    if name in ("make", "model", "datetime"):
        return value if isinstance(value, str) else None
    return None if isinstance(value, str) else int(value) if name == "iso" else float(value)


class PictureHeaders(DataSource):
    """``spark.read.format("picture_headers").load(folder)``: a row per file; only the columns of a given schema are looked for.

    Option ``endings`` keeps files with one of these endings, separated by spaces. Files of the folder
    itself are dealt to tasks by number, folders in it one by one, each listed by its task. Of each file no more than its first MB is read, whatever its size; if only path and length are asked for,
    none is opened.
    """

    @classmethod
    def name(cls) -> str:
        return "picture_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(dict(self.options), schema.fieldNames())


class _FileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.uri = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        fs, path = _place(self.uri)
        fs.create_dir(path, recursive=True)
        made = {path}
        for row in iterator:
            place = f"{path}/{row['name']}"
            folder = place.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{uuid.uuid4().hex}.part"
            with fs.open_output_stream(part) as f:
                f.write(row["content"] or b"")
            fs.move(part, place)  # a task that is run again replaces the file by the same one
        return WriterCommitMessage()


class BinaryFiles(DataSource):
    """``df.write.format("binary_files").mode("append").save(folder)``: a file for each row (name, content), seen only when it is whole."""

    @classmethod
    def name(cls) -> str:
        return "binary_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PictureHeaders)
    spark.dataSource.register(BinaryFiles)


def picture_headers(spark: SparkSession, folder: str, schema: str = SCHEMA, endings: str = "") -> DataFrame:
    """Make, model, time and exposure of the files below ``folder``, of the columns in ``schema``.

    Damaged heads, other kinds of files and offsets that lead nowhere or back give nulls. An empty folder gives no rows.
    """
    register(spark)
    return spark.read.format("picture_headers").schema(schema).option("endings", endings).load(folder)


def write_files(df: DataFrame, folder: str) -> None:
    """A file for each row (name, content), in folders where the name has them; a null content is an empty file. Of two rows with one name either may stay."""
    register(df.sparkSession)
    df.select("name", "content").write.format("binary_files").mode("append").save(folder)
