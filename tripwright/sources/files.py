"""Files of any file system that Spark reads, a range of bytes at a time, on the driver."""

from __future__ import annotations

import io

from pyspark.sql import SparkSession


class RangeFile(io.RawIOBase):
    """A file, opened through Spark's file systems, of which only what is asked for is read."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__()
        self._stream = None
        self._jvm = spark._jvm
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        status = system.getFileStatus(at)
        if status.isDirectory():  # the first of its files stands for all
            names = sorted(str(x.getPath()) for x in system.listStatus(at) if x.isFile() and not x.getPath().getName().startswith((".", "_")))
            if not names:
                raise FileNotFoundError(path)
            at = self._jvm.org.apache.hadoop.fs.Path(names[0])
            status = system.getFileStatus(at)
        self.size, self._at, self._stream = int(status.getLen()), 0, system.open(at)

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = max(0, offset + (0, self._at, self.size)[whence])
        return self._at

    def read(self, size: int = -1) -> bytes:
        many = max(0, self.size - self._at) if size is None or size < 0 else max(0, min(size, self.size - self._at))
        if not many:
            return b""
        self._stream.seek(self._at)
        data = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._stream, many))
        self._at += len(data)
        return data

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed and self._stream is not None:
            self._stream.close()
        super().close()


def first_bytes(spark: SparkSession, path: str, many: int = 4) -> bytes:
    """The first bytes of a file, or of the first file of a folder."""
    with RangeFile(spark, path) as file:
        return file.read(many)
