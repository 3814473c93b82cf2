"""Numbered manifests in a folder: the appearance of a manifest is a commit, and of two writers of one number one fails."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

from lumenrank.session import local_path


class Manifests:
    """The manifests of one folder; a manifest is a JSON object."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.names() if n.startswith("manifest-") and n.endswith(".json"))

    def names(self) -> list[str]:
        """Everything in the folder."""
        if not self.store.exists(self.paths(self.path)):
            return []
        return [f.getPath().getName() for f in self.store.listStatus(self.paths(self.path))]

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(self._file(number), wholetext=True).first()[0])

    def last(self) -> tuple[int, dict | None]:
        """The number of the last commit (0: none) and its manifest."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, None)

    def commit(self, number: int, manifest: dict) -> None:
        """Put the manifest under the number, whole and at once; fails if another writer has done so.

        On a local folder that is a hard link, on HDFS a rename, which both refuse an existing target. Other stores
        must refuse to create an object that exists.
        """
        text = json.dumps(manifest)
        if not self._put(number, text):
            raise RuntimeError(f"{self.path} was changed meanwhile")

    def remove(self, name: str) -> None:
        self.store.delete(self.paths(f"{self.path}/{name}"), True)

    def _file(self, number: int) -> str:
        return f"{self.path}/manifest-{number:010d}.json"

    def _put(self, number: int, text: str) -> bool:
        held, target, scheme = f"{self.path}/.manifest-{uuid.uuid4().hex}", self._file(number), self.store.getScheme()
        if scheme == "file":
            held, target = local_path(held), local_path(target)
            os.makedirs(os.path.dirname(held), exist_ok=True)
            with open(held, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(held, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(held)
            return True
        if scheme in ("hdfs", "viewfs"):
            self._write(held, text, True)
            done = self.store.rename(self.paths(held), self.paths(target))
            if not done:
                self.store.delete(self.paths(held), False)
            return done
        if self.store.exists(self.paths(target)):
            return False
        self._write(target, text, False)
        return True

    def _write(self, path: str, text: str, overwrite: bool) -> None:
        out = self.store.create(self.paths(path), overwrite)
        out.write(bytearray(text.encode()))
        out.close()
