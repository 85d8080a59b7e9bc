"""Files of an index on any Hadoop file system: snapshot metadata, published whole and once, and marks of staged segments."""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Storage:
    """A root folder. Relative names only; metadata files are small and read by the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def list(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def delete(self, name: str) -> None:
        """Nothing happens where there is no such file."""
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise FileNotFoundError(self.path(name))
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Whole or not at all; fails where the file is there already, also if two try at once.

        On a local disk by a hard link, which never replaces a file, elsewhere by a rename, which HDFS refuses where the
        target exists.
        """
        draft = f".{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._at(draft), False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        try:
            if self._fs.getScheme() == "file":
                self._fs.mkdirs(self._at(name).getParent())
                os.link(self._local(draft), self._local(name))
            elif self.exists(name) or not self._fs.rename(self._at(draft), self._at(name)):
                raise FileExistsError(self.path(name))
        finally:
            self.delete(draft)

    def _local(self, name: str) -> str:
        return unquote(urlparse(self._at(name).toUri().toString()).path)

    @property
    def key(self) -> str:
        """Tells one index from another in this process."""
        return self.root

    # Segments that writers have made and not published.

    def stage(self, segment: str) -> None:
        self.write_new(f"staged/{segment}", "")

    def unstage(self, segment: str) -> None:
        self.delete(f"staged/{segment}")

    def staged(self) -> set[str]:
        return set(self.list("staged"))

    # Snapshots: v{N}.json, the highest N being the current one.

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.list() if (m := re.fullmatch(r"v(\d+)\.json", n)))

    def load(self, version: int | None = None) -> dict:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no index at {self.root}")
        return json.loads(self.read(f"v{versions[-1] if version is None else version}.json"))

    def publish(self, meta: dict) -> None:
        self.write_new(f"v{meta['version']}.json", json.dumps(meta, indent=1))


class MemoryFiles:
    """The same interface for small files held by the driver."""

    def __init__(self) -> None:
        self.files: dict[str, str] = {}

    def exists(self, name: str) -> bool:
        return name in self.files

    @property
    def key(self) -> str:
        return f"memory-{id(self)}"

    def list(self, name: str = "") -> list[str]:
        under = f"{name}/" if name else ""
        return sorted({f.removeprefix(under).split("/")[0] for f in self.files if f.startswith(under)})

    def delete(self, name: str) -> None:
        self.files.pop(name, None)

    def read(self, name: str) -> str:
        if name not in self.files:
            raise FileNotFoundError(name)
        return self.files[name]

    def write_new(self, name: str, text: str) -> None:
        if name in self.files:
            raise FileExistsError(name)
        self.files[name] = text

    versions, load, publish, root = Storage.versions, Storage.load, Storage.publish, "memory"
    stage, unstage, staged = Storage.stage, Storage.unstage, Storage.staged
