"""Files through Hadoop's file systems, so that artefacts can lie wherever Spark reads."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def dumps(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, default=str)


def staging_of(target: str) -> str:
    return f"{target}._staging_{uuid.uuid4().hex[:8]}"


class FileSystem:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def qualified(self, p: str) -> str:
        """The path with its scheme, as a URI."""
        return str(self.fs.makeQualified(self.path(p)).toUri().toString()).replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)

    def make(self, p: str) -> None:
        if not self.fs.mkdirs(self.path(p)):
            raise OSError(f"{p} can't be made")

    def exists(self, p: str) -> bool:
        return bool(self.fs.exists(self.path(p)))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"{a} can't be moved to {b}")

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p)))

    def is_dir(self, p: str) -> bool:
        return self.exists(p) and bool(self.fs.getFileStatus(self.path(p)).isDirectory())

    def write_bytes(self, p: str, data: bytes) -> None:
        out = self.fs.create(self.path(p), True)
        try:
            out.write(data, 0, len(data))
        finally:
            out.close()

    def write_text(self, p: str, text: str) -> None:
        self.write_bytes(p, text.encode())

    def read_text(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def swap(self, staging: str, target: str) -> None:
        """Puts a complete staging folder in the target's place; the old target goes last, so a crash loses neither."""
        if self.exists(target):
            old = f"{target}._old_{uuid.uuid4().hex[:8]}"
            self.rename(target, old)
            self.rename(staging, target)
            self.delete(old)
        else:
            self.rename(staging, target)


def write_single_csv(fs: FileSystem, df: DataFrame, path: str) -> None:
    """One CSV file with a header: tasks write parts, whose bytes are joined in order without passing through Python."""
    folder = f"{path}._parts"
    df.write.mode("overwrite").option("header", False).csv(folder)
    out = fs.fs.create(fs.path(path), True)
    try:
        head = bytearray((",".join(df.columns) + "\n").encode())
        out.write(head, 0, len(head))
        for name in fs.names(folder):
            if name.startswith("part-"):
                part = fs.fs.open(fs.path(f"{folder}/{name}"))
                try:
                    fs.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
    finally:
        out.close()
    fs.delete(folder)
