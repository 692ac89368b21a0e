"""A small state under compare-and-swap: numbered files, each written whole, of which only one writer can make the next."""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable
from urllib.parse import unquote, urlparse
from uuid import uuid4

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Other writers were faster, again and again."""


class Versions:
    """Revisions of a JSON state in a folder of any store that Spark writes.

    A revision is a file of the next number that comes to be with all it holds, or not at all if another writer has made it. So
    a change that is worked out from one revision is written as its follower or not at all; it is then worked out anew.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 20):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"

    def numbers(self) -> list[int]:
        at = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _name(self, number: int) -> str:
        return f"{self.folder}/{number:010d}.json"

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """The number and state of a revision, the newest by default; 0 and {} if there is none."""
        if number is None:
            number = (self.numbers() or [0])[-1]
        if not number:
            return 0, {}
        return number, json.loads(self.spark.read.text(self._name(number), wholetext=True).first()[0])

    def create(self, number: int, state: dict) -> bool:
        """Write a revision; False if it is there already."""
        temporary, final = f"{self.folder}/.{uuid4().hex}", self._name(number)
        if self._fs.exists(self._path(final)):
            return False
        out = self._fs.create(self._path(temporary))
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._local:
            # a rename onto a file that is there fails as one step
            done = self._fs.rename(self._path(temporary), self._path(final))
            if not done:
                self._fs.delete(self._path(temporary), False)
            return done
        here = [unquote(urlparse(self._path(name).toUri().toString()).path) for name in (temporary, final)]
        try:
            os.link(*here)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(self._path(temporary), False)
        return True

    def change(self, work: Callable[[dict], dict], tries: int = 100) -> tuple[int, dict]:
        """Write what `work` makes of the newest state as the next revision; where another writer was faster, of that one's. Errors of work go through."""
        for turn in range(tries):
            number, state = self.read()
            new = work(state)
            if self.create(number + 1, new):
                for old in self.numbers()[: -self.keep]:
                    self._fs.delete(self._path(self._name(old)), False)
                return number + 1, new
            time.sleep(random.uniform(0, min(0.5, 0.01 * 2**turn)))
        raise Conflict(f"{self.folder} was changed by others {tries} times")
