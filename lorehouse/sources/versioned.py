"""A table that is replaced as a whole: written beside the old one, which stays in force until the new one is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """Parquet under ``path``/schema=S/version=N; the newest complete version of schema S counts.

    A write that fails leaves the version before it in force. Tables of an older schema are not read, so what is derived
    is made anew; one of a newer schema refuses to be opened.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, schema: int = 1, kept: int = 2):
        self.spark, self.path, self.columns, self.schema, self.kept = spark, path.rstrip("/"), columns, schema, kept
        if newer := [s for s in self._numbers(self.path, "schema=") if s > schema]:
            raise ValueError(f"{self.path} is of schema {max(newer)}, this is {schema}")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)  # the file system that Spark itself uses for the path
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, path: str, prefix: str) -> list[int]:
        fs, p = self._fs(path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def _folder(self, version: int) -> str:
        return f"{self.path}/schema={self.schema}/version={version}"

    def _complete(self, version: int) -> bool:
        fs, p = self._fs(f"{self._folder(version)}/_SUCCESS")
        return fs.exists(p)

    def versions(self) -> list[int]:
        return [v for v in self._numbers(f"{self.path}/schema={self.schema}", "version=") if self._complete(v)]

    def revision(self) -> int:
        return max(self.versions(), default=0)

    def read(self) -> DataFrame:
        done = self.versions()
        reader = self.spark.read.schema(self.columns)
        return reader.parquet(self._folder(done[-1])) if done else self.spark.createDataFrame([], self.columns)

    def write(self, df: DataFrame) -> int:
        """Put ``df`` in force; versions before the last ``kept`` go, and so do those that never became complete."""
        new = self.revision() + 1
        names = [f.name for f in self.spark.createDataFrame([], self.columns).schema]
        df.select(*names).write.mode("overwrite").parquet(self._folder(new))
        for v in self._numbers(f"{self.path}/schema={self.schema}", "version="):
            if v <= new - self.kept or (v < new and not self._complete(v)):
                fs, p = self._fs(self._folder(v))
                fs.delete(p, True)
        return new
