"""Small files on whatever file system Spark has for a path, through the driver's JVM."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(text.encode())
            stream.hsync()
        finally:
            stream.close()

    def move_new(self, source: str, target: str) -> bool:
        """Rename, unless the target exists: of several writers of one name, one wins."""
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getDeclaringClass(), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.path(source), self.path(target), none)
        except Exception as e:  # the JVM's exception for a target that exists
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def move(self, source: str, folder: str) -> None:
        """Move a file or folder into another folder, which is made."""
        self.fs.mkdirs(self.path(folder))
        self.fs.rename(self.path(source), self.path(f"{folder}/{source.rsplit('/', 1)[1]}"))

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def exists(self, name: str) -> bool:
        return bool(self.fs.exists(self.path(name)))
