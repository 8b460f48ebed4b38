"""Claims on a key in a shared folder: one holder at a time, and another takes over from one that died.

A claim is a file that only one can create, numbered by generation. Its holder touches it from time to time; one that was
not touched for the lease is dead, and whoever creates the next generation's file holds the key. A holder that was
thought dead finds a later generation and must stop: it asks before each step that others see.

Creation is exclusive in HDFS and in local file systems. A store of objects without conditional writes is not fit for claims.
"""

from __future__ import annotations

import threading
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


class LoadBusy(RuntimeError):
    """The key is held by another load that is alive."""


class ClaimLost(RuntimeError):
    """Another load took the key over."""


class Folder:
    """The few calls of a Hadoop file system that loads need."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str) -> bool:
        """Make an empty file unless it is there; of many that try at once, one succeeds."""
        if self.fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
            local = self.jvm.java.io.File(self.path(name).toUri().getPath())
            local.getParentFile().mkdirs()
            return local.createNewFile()
        try:
            self.fs.create(self.path(name), False).close()
            return True
        except Exception:
            if self.fs.exists(self.path(name)):
                return False
            raise

    def names(self) -> list[str]:
        if not self.fs.exists(self.path("")):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))]

    def touched(self, name: str) -> float:
        return self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def touch(self, name: str, at: float) -> None:
        self.fs.setTimes(self.path(name), int(at * 1000), -1)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def move(self, source: str, target: str) -> None:
        """``source`` in the place of ``target``, which goes if it is there."""
        self.fs.delete(self.path(target), True)
        self.fs.mkdirs(self.path(target).getParent())
        if not self.fs.rename(self.path(source), self.path(target)):
            raise OSError(f"{source} could not be moved to {target}")


class Claim:
    """A key that is held; :meth:`check` raises once another has taken it over."""

    def __init__(self, folder: Folder, key: str, generation: int):
        self.folder, self.key, self.generation = folder, key, generation
        self.name = _name(key, generation)

    def check(self) -> None:
        if max(_generations(self.folder, self.key), default=-1) != self.generation:
            raise ClaimLost(f"another load took over {self.key}")


def _name(key: str, generation: int) -> str:
    return f"{key}.{generation:06d}"


def _generations(folder: Folder, key: str) -> list[int]:
    return [int(n.rpartition(".")[2]) for n in folder.names() if n.rpartition(".")[0] == key and n.rpartition(".")[2].isdigit()]


def _now(folder: Folder) -> float:
    """The file system's own time, so that clocks need not agree."""
    name = f"clock-{uuid.uuid4().hex}"
    folder.create(name)
    at = folder.touched(name)
    folder.fs.delete(folder.path(name), False)
    return at


@contextmanager
def claimed(spark: SparkSession, path: str, key: str, lease: float = 60.0):
    """Hold ``key`` (letters and digits) in the folder ``path``; :class:`LoadBusy` if a holder that is alive has it.

    The claim is let go at the end, whatever happened, by a touch that makes it count as dead at once.
    """
    folder = Folder(spark, path)
    last = max(_generations(folder, key), default=-1)
    if last >= 0 and _now(folder) - folder.touched(_name(key, last)) < lease:
        raise LoadBusy(f"{key} is held")
    claim = Claim(folder, key, last + 1)
    if not folder.create(claim.name):
        raise LoadBusy(f"{key} is held")
    over = threading.Event()

    def beat() -> None:
        while not over.wait(lease / 4):
            folder.touch(claim.name, time.time() if folder.fs.getUri().getScheme() == "file" else _now(folder))

    beating = threading.Thread(target=beat, daemon=True)
    beating.start()
    try:
        yield claim
    finally:
        over.set()
        beating.join()
        folder.touch(claim.name, 0)
