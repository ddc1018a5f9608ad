"""A store of text files under one root, on any file system that Spark knows.

A file is written beside its place and renamed, so that nobody reads half of
it.  References are relative and can't leave the root.
"""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.functions.identity import canonical_dumps

MARKER = "artifacts/corpus-manifest.json"


class StoreError(ValueError):
    """A file can't be read, written or trusted."""


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.setWriteChecksum(False)

    def _path(self, ref: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{ref}" if ref else self.root)

    def path_for(self, ref: str) -> Any:
        """The place of a reference; absolute and climbing ones are refused."""
        if not ref or ref.startswith(("/", "~")) or "\\" in ref or "://" in ref or re.match(r"[A-Za-z]:", ref) or any(part in ("", ".", "..") for part in ref.split("/")):
            raise StoreError(f"unsafe reference {ref!r}")
        return self._path(ref)

    def exists(self, ref: str) -> bool:
        return self._fs.exists(self.path_for(ref))

    def read_bytes(self, ref: str) -> bytes:
        path = self.path_for(ref)
        if not self._fs.exists(path) or not self._fs.getFileStatus(path).isFile():
            raise StoreError(f"no file {ref}")
        stream = self._fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_text(self, ref: str, sha256: str | None = None) -> str:
        """UTF-8 text; with a checksum, only if it has it."""
        data = self.read_bytes(ref)
        if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256.lower():
            raise StoreError(f"checksum of {ref}")
        try:
            return data.decode("utf-8-sig")
        except UnicodeDecodeError as e:
            raise StoreError(f"{ref} is no UTF-8") from e

    def write_text(self, ref: str, text: str, sha256: str | None = None) -> str:
        """Writes a file as a whole and returns its checksum, which must be the given one."""
        data = text.encode()
        own = hashlib.sha256(data).hexdigest()
        if sha256 is not None and own != sha256.lower():
            raise StoreError(f"checksum of {ref}")
        path, part = self.path_for(ref), self._path(f"{ref}.{own[:12]}.part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        if self._fs.exists(path):
            self._fs.delete(path, False)
        if not self._fs.rename(part, path):
            raise StoreError(f"can't write {ref}")
        return own

    def read_json(self, ref: str) -> Any:
        try:
            return json.loads(self.read_text(ref))
        except ValueError as e:
            raise StoreError(f"{ref} is no JSON") from e

    def write_json(self, ref: str, value: Any) -> str:
        return self.write_text(ref, canonical_dumps(value) + "\n")

    def write_ledger(self, ref: str, table: DataFrame) -> None:
        """A table as a folder of Parquet files, in place of an earlier one."""
        table.write.mode("overwrite").parquet(f"{self.root}/{ref}" if self.path_for(ref) else "")

    def read_ledger(self, ref: str) -> DataFrame:
        self.path_for(ref)
        return self.spark.read.parquet(f"{self.root}/{ref}")

    def delete(self, ref: str) -> None:
        self._fs.delete(self.path_for(ref), True)

    def names(self) -> list[str]:
        """Files and folders right under the root; none if it doesn't exist."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if self._fs.exists(self._path("")) else []

    def claim(self, corpus_id: str, manifest: Any) -> None:
        """Takes the root for a corpus: it must be empty or hold an earlier build of the
        same corpus."""
        if self.names():
            if not self.exists(MARKER):
                raise StoreError("the output folder isn't empty and holds no build")
            if self.read_json(MARKER).get("id") != corpus_id:
                raise StoreError("the output folder belongs to another corpus")
        self.write_json(MARKER, manifest)

    def write_documents(self, documents: DataFrame) -> dict[str, str]:
        """Writes (path, text, sha256) rows one by one; returns the checksums by path.
        A document is one file, so its text must fit in memory."""
        return {r.path: self.write_text(r.path, r.text, r.sha256) for r in documents.orderBy("path").toLocalIterator()}


def checksums(store: ArtifactStore, refs: list[str]) -> DataFrame:
    """(path, sha256) of those references that are files."""
    rows = [(r, hashlib.sha256(store.read_bytes(r)).hexdigest()) for r in refs if store.exists(r)]
    return store.spark.createDataFrame(rows, "path string, sha256 string").select("path", F.col("sha256"))
