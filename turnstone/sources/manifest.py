"""Which folders of a set of tables count: small numbered files, of which the last one holds.

A writer prepares folders that no reader knows and then writes the next number, so readers see all of a change or
none, and whatever is interrupted before leaves no trace but unused folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

KEPT = 5  # earlier numbers stay for readers that are about to open them


@dataclass
class State:
    """Live folders below the root, and what writers must know."""

    folders: list[str] = field(default_factory=list)
    final: dict[str, int] = field(default_factory=dict)  # by writer: the last batch that can no longer change
    settings: dict[str, int] = field(default_factory=dict)


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.folder = f"{root}/_manifest"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self.files().exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self.files().listStatus(self._path(self.folder))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> State:
        stream = self.files().open(self._path(f"{self.folder}/{number}.json"))
        try:
            return State(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def read(self) -> State:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else State()

    def change(self, edit: Callable[[State], None]) -> State:
        """Make ``edit`` of the present state the next one. Who loses a race to that number must start over."""
        files, numbers = self.files(), self._numbers()
        state = self._load(numbers[-1]) if numbers else State()
        edit(state)
        aside, target = (self._path(f"{self.folder}/{n}") for n in (f".{uuid.uuid4().hex}", f"{(numbers or [0])[-1] + 1}.json"))
        stream = files.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(vars(state)).encode()))
        finally:
            stream.close()
        if files.exists(target) or not files.rename(aside, target):
            files.delete(aside, False)
            raise OSError(f"another writer made {target} meanwhile")
        for old in numbers[:-KEPT]:
            files.delete(self._path(f"{self.folder}/{old}.json"), False)
        return state
