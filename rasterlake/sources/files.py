"""Image files: a distributed source over binaryFile, decoding and encoding of rows, and a sink of one file a row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from rasterlake.functions.formats import format_of_bytes, format_of_path
from rasterlake.sources.codecs import ENCODERS, decode

DECODED = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("rgba", T.BinaryType()), T.StructField("error", T.StringType())])


def read_files(spark: SparkSession, path: str, detect_by: str = "extension") -> DataFrame:
    """path, length, content and format of the files under path. The format comes from the extension, or from the first
    bytes if detect_by is 'content'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = format_of_bytes(F.col("content")) if detect_by == "content" else format_of_path(F.col("path"))
    return files.select("path", "length", "content", kind.alias("format"))


def decode_frames(files: DataFrame, content: str = "content", kind: str = "format") -> DataFrame:
    """files with width, height, rgba and error. A file that cannot be decoded gets its error, and nulls; others go on."""

    def run(data: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        out = []
        for d, k in zip(data, kinds, strict=True):
            try:
                px = decode(k, d)
                out.append((px.shape[1], px.shape[0], px.tobytes(), None))
            except Exception as e:  # any malformed file; the row says so
                out.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=DECODED.names)

    keep = [c for c in files.columns if c not in DECODED.names]
    return files.select(*keep, F.pandas_udf(run, DECODED)(content, kind).alias("__d")).select(*keep, "__d.*")


def encode_frames(frames: DataFrame, kind: str) -> DataFrame:
    """frames with content, the bytes of a file of one format that holds the frame."""
    if kind not in ENCODERS:
        raise ValueError(f"no encoder for {kind}")

    def run(rgba: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else ENCODERS[kind](np.frombuffer(b, np.uint8).reshape(h, w, 4)) for b, w, h in zip(rgba, width, height, strict=True)], dtype=object)

    return frames.withColumn("content", F.pandas_udf(run, T.BinaryType())("rgba", "width", "height"))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are staged, and their names."""

    files: list[tuple[str, str]]


class ImageFileWriter(DataSourceWriter):
    """Tasks write under a staging folder, and the driver moves what the tasks that count have written into place, so that a
    task that fails or runs twice leaves nothing behind."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.staging = f".staging-{uuid.uuid4().hex}"

    def place(self):
        """(file system, folder) of the target; paths without a scheme are of a folder that all executors mount."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder or self.folder.startswith("file:") else "file://" + self.folder)

    def write(self, rows: Iterator[Row]) -> Written:
        system, folder = self.place()
        out = []
        for n, row in enumerate(rows):
            name = row["name"]
            if name.startswith("/") or ".." in name.split("/") or not name:
                raise ValueError(f"not a name within the folder: {name}")
            staged = f"{folder}/{self.staging}/{uuid.uuid4().hex}-{n}"
            system.create_dir(f"{folder}/{self.staging}", recursive=True)
            with system.open_output_stream(staged) as to:
                to.write(row["content"])
            out.append((staged, name))
        return Written(out)

    def clear(self) -> None:
        """Removes what is in the folder if it is to be overwritten."""
        from pyarrow import fs

        system, folder = self.place()
        for old in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if self.overwrite else []:
            if old.base_name != self.staging:
                (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)

    def move(self, files: list[tuple[str, str]]) -> None:
        """Staged files to their names; what is gone has been moved by another task of the same work."""
        from pyarrow import fs

        system, folder = self.place()
        for parent in {name.rsplit("/", 1)[0] for _, name in files if "/" in name} | {""}:
            system.create_dir(f"{folder}/{parent}".rstrip("/"), recursive=True)
        for staged, name in files:
            if system.get_file_info(staged).type != fs.FileType.NotFound:
                system.move(staged, f"{folder}/{name}")
            elif system.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
                raise FileNotFoundError(f"neither staged nor in place: {name}")

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("several rows have the same name")
        self.clear()
        self.move(files)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = self.place()
        if system.get_file_info(f"{folder}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{self.staging}")


class ImageFileSource(DataSource):
    """df (name, content).write.format('image_files').mode('append').save(folder): a file for each row, which the driver moves into
    place. write_files moves them by tasks.

    Names may hold folders, and must differ; mode 'overwrite' removes what is in the folder. The folder must be one that all
    executors share."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> ImageFileWriter:
        return ImageFileWriter(self.options, overwrite)


def write_files(encoded: DataFrame, folder: str, mode: str = "append") -> None:
    """A file for each row (name, content) of encoded under folder, which all executors share; the driver moves none.

    Tasks stage files under names of their own and tell them in a table, which only tasks that count reach; a second job moves
    these files into place, and may move one twice. Names may hold folders; several rows of one name are an error, as is a
    name that leaves the folder, and nothing is in place then. mode 'overwrite' removes what is in the folder before.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be append or overwrite")
    spark, writer = encoded.sparkSession, ImageFileWriter({"path": folder}, mode == "overwrite")

    def stage(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = writer.write(rows.to_dict("records"))
            yield pd.DataFrame(done.files, columns=["staged", "name"])

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            writer.move(list(rows.itertuples(index=False, name=None)))
            yield rows[["name"]]

    system, place = writer.place()
    try:
        system.create_dir(f"{place}/{writer.staging}", recursive=True)
        told = f"{folder.rstrip('/')}/{writer.staging}/told"
        told = told if "://" in told or told.startswith("file:") else f"file://{told}"
        encoded.select("name", "content").mapInPandas(stage, "staged string, name string").write.parquet(told)
        files = spark.read.schema("staged string, name string").parquet(told)
        if files.groupBy("name").count().where("count > 1").limit(1).count():
            raise ValueError("several rows have the same name")
        writer.clear()
        files.mapInPandas(move, "name string").write.format("noop").mode("overwrite").save()
    finally:
        writer.abort([])
