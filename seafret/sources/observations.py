"""Raw observation files: CSV (any Java charset) and zipped CSV."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from typing import IO
from urllib.parse import quote

import pandas as pd
from pyarrow import NativeFile
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seafret.functions.columns import slot
from seafret.schema import OBS_SCHEMA, RAW_HEADERS, TS
from seafret.session import in_threads, materialize

UTF8 = "UTF-8"
KOREAN = "EUC-KR"
ZIP_BATCH = 100_000
READ_BYTES = 1 << 20
#: Most tasks that members of archives are dealt to, for each core.
TASKS_PER_CORE = 16


def _allow_charset(spark: SparkSession, encoding: str) -> None:
    if encoding.upper() != UTF8:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def _raw_cells(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Cells of all files as text, by header name whatever the order of a file's columns.

    The header of each file is read by a small job of its own; files with one header are then read together.
    """
    _allow_charset(spark, encoding)
    reader = spark.read.option("header", True).option("encoding", encoding)
    files = reader.csv(path).inputFiles()
    headers: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(in_threads(lambda f: tuple(reader.csv(f).columns), files), files):
        if header:
            headers.setdefault(header, []).append(file)
    parts = [reader.csv(same).select(*[F.col(f"`{h}`") for h in RAW_HEADERS if h in header]) for header, same in headers.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _cast(header: str) -> Column:
    types = {f.name: f.dataType for f in OBS_SCHEMA.fields}
    return F.col(f"`{header}`").try_cast(types[RAW_HEADERS[header]])


def read_obs(spark: SparkSession, path: str | list[str], encoding: str = UTF8) -> DataFrame:
    """Observation CSV by header name, with declared types; empty and bad cells are null (`bad_cells` counts the latter)."""
    raw = _raw_cells(spark, path, encoding)
    return raw.select(*[_cast(h).alias(n) for h, n in RAW_HEADERS.items() if h in raw.columns])


def bad_cells(spark: SparkSession, path: str | list[str], encoding: str = UTF8) -> DataFrame:
    """Per column, cells that hold something which `read_obs` cannot read and makes null."""
    raw = _raw_cells(spark, path, encoding)
    held = {h: F.coalesce(F.trim(F.col(f"`{h}`")) != "", F.lit(False)) for h in raw.columns}
    return raw.agg(*[F.count_if(held[h] & _cast(h).isNull()).alias(RAW_HEADERS[h]) for h in raw.columns])


def _member_rows(stream: IO[bytes], encoding: str) -> Iterator[pd.DataFrame]:
    """Rows of one CSV, inflated and parsed in small batches."""
    names = [f.name for f in OBS_SCHEMA.fields]
    texts = {"station", "source"}
    for part in pd.read_csv(stream, encoding=encoding, dtype=str, chunksize=ZIP_BATCH):
        part = part.rename(columns=RAW_HEADERS).reindex(columns=names)
        for c in names:
            if c == TS:
                part[c] = pd.to_datetime(part[c], errors="coerce")
            elif c in texts:
                part[c] = part[c].astype(object)
            else:
                part[c] = pd.to_numeric(part[c], errors="coerce")
        yield part


def _files_of(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [m for m in archive.infolist() if not m.is_dir() and m.file_size]


def _unzip(batches: Iterator[pd.DataFrame], encoding: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in _files_of(archive):
                    with archive.open(member) as stream:
                        yield from _member_rows(stream, encoding)


def _without_nan(rows: DataFrame) -> DataFrame:
    numbers = [f.name for f in OBS_SCHEMA.fields if f.dataType.typeName() == "double"]
    return rows.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in numbers})


def parse_zipped(files: DataFrame, encoding: str = UTF8) -> DataFrame:
    """Rows of zipped CSV files given as (path, content); a file is read in small batches."""
    return _without_nan(files.select("content").mapInPandas(lambda it: _unzip(it, encoding), OBS_SCHEMA))


class _Seekable(io.RawIOBase):
    """A file of Arrow that answers a seek before its start with OSError, as zipfile expects of tiny archives."""

    def __init__(self, file: NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        try:
            self.file.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def _opened(path: str) -> IO[bytes]:
    """A file open for reading at any place, no more than a buffer of it held."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        path = "/" + rest.lstrip("/")
    elif rest:
        path = f"{scheme}:{quote(rest)}"
    system, name = FileSystem.from_uri(path)
    return io.BufferedReader(_Seekable(system.open_input_file(name)), READ_BYTES)


def zip_members(archives: DataFrame) -> DataFrame:
    """(path, member, size) of every file in the archives given by path, read from the directory at an archive's end."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _opened(path) as file, zipfile.ZipFile(file) as archive:
                    found = [(path, m.filename, m.file_size) for m in _files_of(archive)]
                if found:
                    yield pd.DataFrame(found, columns=["path", "member", "size"])

    return archives.select("path").mapInPandas(listed, "path string, member string, size long")


def parse_members(members: DataFrame, encoding: str = UTF8) -> DataFrame:
    """Rows of the members given by (path, member); each is found by its offset and inflated as a stream."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, member in zip(batch["path"], batch["member"]):
                with _opened(path) as file, zipfile.ZipFile(file) as archive, archive.open(member) as stream:
                    yield from _member_rows(stream, encoding)

    return _without_nan(members.select("path", "member").mapInPandas(rows, OBS_SCHEMA))


def read_obs_zip(spark: SparkSession, path: str, encoding: str = UTF8, by_member: bool = True) -> DataFrame:
    """All `.csv.zip` files below a folder.

    The archives' directories are read first; then every member is a unit of work, dealt over the tasks, whatever archive it lies in, and no
    archive is held. Members that are empty or folders have no rows. `by_member=False` is for file systems that Arrow does not know: an
    archive is then one task and held whole (Spark reads binary files up to 2 GB).
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.csv.zip")
        .option("recursiveFileLookup", True)
        .load(path)
    )
    if not by_member:
        return parse_zipped(files, encoding)
    members = materialize(zip_members(files), "members")
    tasks = max(1, min(members.count(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    return parse_members(members.repartition(tasks), encoding)


def write_raw_merged(df: DataFrame, path: str, encoding: str = KOREAN, file_seconds: int = 366 * 86400) -> None:
    """Merged raw series per port as CSV with the raw headers, one file per port and year."""
    _allow_charset(df.sparkSession, encoding)
    short = {n: h for h, n in RAW_HEADERS.items()}
    parts = slot(F.col(TS), file_seconds)
    out = df.repartition("station", parts).sortWithinPartitions("station", TS)
    out = out.select(F.col("station").alias("port"), *[F.col(c).alias(short[c]) for c in df.columns])
    out.write.mode("overwrite").partitionBy("port").option("header", True).option("encoding", encoding).csv(path)
