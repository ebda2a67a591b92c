"""Small files on whatever file system the store's path names, through Hadoop's client."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Reads, writes, lists and removes small control files."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def status(self, folder: str) -> list[tuple[str, int, int]]:
        """(path, bytes, modification time in ms) of the files below a folder."""
        if not self.exists(folder):
            return []
        found, out = self._fs.listFiles(self._path(folder), True), []
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return out

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Writes a new file as a whole; False if there is one of this name already.

        The data go to a file of another name, which is then renamed without overwriting."""
        import uuid

        target = self._path(name)
        self._fs.mkdirs(target.getParent())
        draft = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(none, 0, options.NONE)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, target, none)
        except Exception as e:  # noqa: BLE001  py4j wraps Java's exceptions
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(target):
                return False
            raise
        return True

    def delete(self, name: str, path: bool = False) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(name) if path else self._path(name), True)
