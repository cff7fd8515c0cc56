"""A sink of lines that are compressed only where that makes a file smaller, and seen only once all of them are written.

A task writes its lines, as they are and compressed, into a folder of the job whose name begins with an underscore, so that no reader takes its files, and keeps the
smaller of each two. When all tasks have succeeded the kept files are moved to their places, and then, if the job overwrites, the files go that
were there before. A job that fails leaves these as they were. Files of attempts that were given up or lost go with the job's folder;
a task that is still writing while its job is aborted may leave some there, which no reader takes. While files are moved, one after another,
a reader may see some of the new beside the old, but never a part of a file.

Paths are those of any store that pyarrow's file systems know, and that the driver and all executors see.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

LEVEL = 6
#: Kinds of columns by which files are put in folders: their texts need no escapes in a path.
PLAIN = ("boolean", "tinyint", "smallint", "int", "bigint", "date")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Written(WriterCommitMessage):
    """Names of a task's files, below the job's folder."""

    files: list[str]


class PackedWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.suffix, self.level = options.get("suffix", ".json"), int(options.get("level", LEVEL))
        self.job = f"_job-{uuid.uuid4().hex}"

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Written:
        store, base = self.store()
        task = TaskContext.get()
        part, files = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}{self.suffix}", []
        for folder, rows in groupby(iterator, key=lambda r: r["folder"]):
            name = f"{folder}/{part}" if folder else part
            store.create_dir(f"{base}/{self.job}/{folder}", recursive=True)
            plain = f"{base}/{self.job}/{name}"
            with store.open_output_stream(plain, compression=None) as raw, store.open_output_stream(plain + ".gz", compression=None) as out, gzip.GzipFile("", "wb", self.level, out, 0) as packed:
                for row in rows:
                    line = (row["value"] or "").encode() + b"\n"
                    raw.write(line)
                    packed.write(line)
            sizes = [store.get_file_info(p).size for p in (plain, plain + ".gz")]
            smaller = ".gz" if sizes[1] < sizes[0] else ""
            store.delete_file(plain if smaller else plain + ".gz")
            files.append(name + smaller)
        return Written(files)

    def commit(self, messages: list) -> None:
        store, base = self.store()
        store.create_dir(base, recursive=True)
        seen = store.get_file_info(fs.FileSelector(base, recursive=True)) if self.overwrite else []
        below = lambda info: info.path[len(base) :].strip("/").split("/")
        old = [i.path for i in seen if i.type == fs.FileType.File and not any(p[0] in "_." for p in below(i))]
        new = [name for m in messages if m is not None for name in m.files]
        for folder in sorted({name.rpartition("/")[0] for name in new}):
            store.create_dir(f"{base}/{folder}", recursive=True)
        for name in new:
            store.move(f"{base}/{self.job}/{name}", f"{base}/{name}")
        for path in old:
            store.delete_file(path)
        kept = {"", *(name[: k] for name in new for k, c in enumerate(name) if c == "/")}
        for i in sorted(seen, key=lambda i: -len(i.path)):  # folders that hold nothing any more
            if i.type == fs.FileType.Directory and "=" in below(i)[-1] and "/".join(below(i)) not in kept and not store.get_file_info(fs.FileSelector(i.path)):
                store.delete_dir(i.path)
        self.clear()

    def abort(self, messages: list) -> None:
        self.clear()

    def clear(self) -> None:
        store, base = self.store()
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


class PackedFiles(DataSource):
    """Rows of folder and value; a task's rows of one folder must come together."""

    @classmethod
    def name(cls) -> str:
        return "packed_lines"

    def schema(self) -> str:
        return "folder string, value string"

    def writer(self, schema, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options, overwrite)


def write_packed(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Writes JSON lines, a folder for each value of ``by`` (as Spark's own partitioned tables have them), which Spark reads back in either form.

    Texts are made by Spark and only bytes pass through Python. Rows are sorted by folder within their partitions, so that a task has one file open.
    """
    kinds = dict(df.dtypes)
    if odd := [c for c in by if kinds[c] not in PLAIN]:
        raise ValueError(f"no folders by {odd}: only by columns of {', '.join(PLAIN)}")
    folder = F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE))) for c in by))
    lines = df.select(folder.alias("folder"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in by))).alias("value"))
    df.sparkSession.dataSource.register(PackedFiles)
    (lines.sortWithinPartitions("folder") if by else lines).write.format("packed_lines").mode(mode).save(path)
