"""Small files of a folder on this machine or at a URI that Spark's file systems know."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import SparkSession


class Place:
    """A folder; local unless its path names a scheme other than file."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://").rstrip("/") or "/"
        self.local = "://" not in self.path

    @property
    def uri(self) -> str:
        """The folder for Spark's readers and writers."""
        return f"file://{os.path.abspath(self.path)}" if self.local else self.path

    def file(self, *parts: str) -> str:
        return os.path.join(self.path, *parts) if self.local else "/".join((self.path, *parts))

    def _hadoop(self, *parts: str):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError(f"{self.path} needs a running session")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.file(*parts))
        return jvm, conf, path, path.getFileSystem(conf)

    def read(self, name: str) -> str | None:
        """The text of a file; nothing if it isn't there."""
        if self.local:
            try:
                with open(self.file(name), encoding="utf-8") as f:
                    return f.read()
            except OSError:
                return None
        jvm, _, path, fs = self._hadoop(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Puts a file in place of what was there, at once: readers see the old text or the new one."""
        if self.local:
            os.makedirs(self.path, exist_ok=True)
            with open(self.file(f"{name}.new"), "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(self.file(f"{name}.new"), self.file(name))
            return
        jvm, conf, new, fs = self._hadoop(f"{name}.new")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        kinds = SparkSession.getActiveSession().sparkContext._gateway.new_array(rename, 1)
        kinds[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, self._hadoop(name)[2], kinds)

    def exists(self, *parts: str) -> bool:
        if self.local:
            return os.path.exists(self.file(*parts))
        _, _, path, fs = self._hadoop(*parts)
        return fs.exists(path)

    def names(self, *parts: str) -> list[str]:
        """What a folder holds."""
        if not self.exists(*parts):
            return []
        if self.local:
            return os.listdir(self.file(*parts))
        _, _, path, fs = self._hadoop(*parts)
        return [x.getPath().getName() for x in fs.listStatus(path)]

    def remove(self, *parts: str) -> None:
        """Removes a file or a folder with all in it, if it is there."""
        if not self.local:
            _, _, path, fs = self._hadoop(*parts)
            fs.delete(path, True)
        elif os.path.isdir(self.file(*parts)):
            shutil.rmtree(self.file(*parts), ignore_errors=True)
        elif os.path.exists(self.file(*parts)):
            os.remove(self.file(*parts))
