"""Versioned tables in one folder: writers make a new version and then move a pointer."""

from __future__ import annotations

import hashlib
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import LockTimeout, StoreError


def index_folder(base: str, repository: str) -> str:
    """A folder of its own for each repository."""
    return f"{base.rstrip('/')}/indices/{hashlib.sha256(repository.encode()).hexdigest()[:16]}"


class Snapshots:
    """Tables by name; a version is a set of Parquet folders that the file CURRENT names.

    Plain Parquet has no merge, so a change writes the table anew; readers keep the version they began
    with.  One writer at a time holds the file LOCK, made by an exclusive create; a lock older than `expiry` seconds is that of
    a writer that died, and falls.  Of versions that nothing names any more the newest `history` stay, for readers that began with them.
    """

    def __init__(self, spark: SparkSession, folder: str, timeout: float = 10.0, poll: float = 0.5, expiry: float = 7200.0, history: int = 5):
        self.spark, self.folder, self.timeout, self.poll = spark, folder.rstrip("/"), timeout, poll
        self.expiry, self.history = expiry, history
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = self._fs.makeQualified(self._path(self.folder)).toString()
        self._fs.mkdirs(self._path(self.folder))

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        out = self._fs.create(self._path(f"{self.folder}/{name}"), overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    @contextmanager
    def lock(self):
        """Hold the store, or raise LockTimeout."""
        end, name = time.time() + self.timeout, "LOCK"
        while True:
            try:
                self._write(name, uuid.uuid4().hex, False)
                break
            except Exception as e:
                at = self._path(f"{self.folder}/{name}")
                try:
                    made = self._fs.getFileStatus(at).getModificationTime() / 1000
                except Exception:  # noqa: BLE001
                    if time.time() >= end:
                        raise StoreError(f"{self.folder} can't be written: {e}") from e
                    made = time.time()  # its holder has just let go
                if time.time() - made > self.expiry:
                    self._fs.delete(at, False)
                    continue
                if time.time() >= end:
                    raise LockTimeout(f"another writer holds {self.folder}") from e
                time.sleep(self.poll)
        try:
            yield
        finally:
            self._fs.delete(self._path(f"{self.folder}/{name}"), False)

    def version(self) -> dict[str, str]:
        """Folder of each table of the current version."""
        text = self._read("CURRENT")
        return dict(line.split("=", 1) for line in text.splitlines()) if text else {}

    def table(self, name: str, schema: StructType | str) -> DataFrame:
        """A table of the current version, empty where it has none."""
        at = self.version().get(name)
        if at is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}")

    def commit(self, **tables: DataFrame) -> None:
        """Write tables and make them current, the others staying as they are; all or nothing.  Call it under lock()."""
        now, stamp = self.version(), f"{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/v-{stamp}/{name}")
            now[name] = f"v-{stamp}/{name}"
        # the pointer is replaced by a rename, which the file system does as one step
        self._write("NEXT", "\n".join(f"{k}={v}" for k, v in now.items()), True)
        jvm = self.spark._jvm
        option = jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(option, 1)
        over[0] = option.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._path(f"{self.folder}/NEXT"), self._path(f"{self.folder}/CURRENT"), over)
        self._forget()


    def append(self, name: str, df: DataFrame) -> None:
        """Add rows to a table without versions, such as a log; what is there isn't written anew."""
        df.write.mode("append").parquet(f"{self.folder}/log-{name}")

    def log(self, name: str, schema: StructType | str) -> DataFrame:
        """A table that append() writes, empty where there is none."""
        at = f"{self.folder}/log-{name}"
        if not self._fs.exists(self._path(at)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(at)

    def size(self) -> int:
        """Bytes of the current version."""
        return sum(self._fs.getContentSummary(self._path(f"{self.folder}/{at}")).getLength() for at in self.version().values())

    def _forget(self) -> None:
        named = {at.split("/")[0] for at in self.version().values()}
        old = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName().startswith("v-"))
        for name in [n for n in old if n not in named][: -self.history or None]:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)


def upserted(stored: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "file_path") -> DataFrame:
    """stored without the keys in gone, and fresh."""
    kept = stored.join(gone.select(F.col(key)).distinct(), key, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)
