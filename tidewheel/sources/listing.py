"""A queue tree listed with what Spark's file reader can't show: names that aren't ASCII, file types, links, reads that fail.

For trees in a file system that every executor has mounted.  A directory below a state is a partition, so
listing scales with the number of shards and buckets.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewheel.runtime import ship
from tidewheel.schema import QueueConfig
from tidewheel.sources.tables import CONFIG, with_names

STATES = ("ready", "leased", "delayed", "receipts", "dead", "quarantine", "tmp")
SCHEMA = (
    "relative_path string, odd_name boolean, stat_failed boolean, irregular boolean, links int, device long, inode long,"
    " length long, modified_us long, open_failed boolean, read_failed boolean, content binary"
)


class _Directory(InputPartition):
    def __init__(self, relative: str):
        self.relative = relative


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.content = options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Every directory of a state's tree; names below are listed by tasks."""
        found = []
        for state in STATES:
            for folder, below, _ in os.walk(os.path.join(self.root, state)):
                below.sort()
                found.append(_Directory(os.path.relpath(folder, self.root)))
        return found or [_Directory("ready")]

    def read(self, partition: _Directory) -> Iterator[tuple]:
        folder = os.path.join(self.root, partition.relative)
        try:
            names = sorted(os.listdir(os.fsencode(folder)))
        except FileNotFoundError:
            return
        for name in names:
            path = os.path.join(os.fsencode(folder), name)
            odd = not name.isascii()
            shown = f"<bytes:{name.hex()}>" if odd else name.decode()
            relative = f"{partition.relative}/{shown}"
            try:
                s = os.lstat(path)
            except OSError:
                yield (relative, odd, True, None, None, None, None, None, None, None, None, None)
                continue
            if stat.S_ISDIR(s.st_mode):
                continue
            regular = stat.S_ISREG(s.st_mode)
            data, open_failed, read_failed = None, False, False
            if regular and self.content and not odd:
                try:
                    f = open(path, "rb")
                except OSError:
                    open_failed = True
                else:
                    with f:
                        try:
                            data = f.read()
                        except OSError:
                            read_failed = True
            yield (relative, odd, False, not regular, s.st_nlink, s.st_dev, s.st_ino, s.st_size, s.st_mtime_ns // 1000, open_failed, read_failed, data)


class TreeListing(DataSource):
    """``spark.read.format("queue_listing").load(root)``; option content=false leaves the bytes out."""

    @classmethod
    def name(cls) -> str:
        return "queue_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def list_tree(spark: SparkSession, root: str, config: QueueConfig = CONFIG, content: bool = True) -> DataFrame:
    """One row an entry, with the fields of its name as ``sources.with_names`` gives them."""
    ship(spark)
    spark.dataSource.register(TreeListing)
    return with_names(spark.read.format("queue_listing").option("content", str(content).lower()).load(root), config)
