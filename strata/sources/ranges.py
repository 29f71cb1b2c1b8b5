"""Records of files of any size and name, read by byte ranges.

A file is cut into ranges of ``range_bytes``; each is a partition of its own.  A
record belongs to the range in which it starts: a task looks for the first start
in its range and reads on past the range's end to the end of its last record.
File names choose no codec, so plain text under a compressed file's name is read
as it is.

Ranges are planned on the driver from the sizes of the files; tasks open files
by the Python file interface, or by Arrow's for ``hdfs``, ``s3``, ``gs`` and the
like.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
CHUNK = 4 << 20
# Longest match of a pattern that marks a record's start.
START_BYTES = 256

# What opening a file costs, in bytes read: small files share a partition.
OPEN_COST = 1 << 20

NAME = "strata_ranges"


@dataclass
class Ranges(InputPartition):
    """Parts of files that one task reads: path, start, end."""

    parts: list[tuple[str, int, int]]


def _open(path: str):
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(unquote(parsed.path) if parsed.scheme else path, "rb")
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def records(file, start: int, end: int, pattern: re.Pattern, at_match: bool, chunk: int = CHUNK) -> Iterator[bytes]:
    """Records that start in ``[start, end)``.

    A record starts where ``pattern`` matches, or with ``at_match`` false where a
    match ends; in the latter case a file also starts with a record.
    """
    # A match that ends in the range may begin before it; one that begins in it may end after it.
    base = max(0, start - START_BYTES)
    file.seek(base)
    held, done = b"", False
    begin = 0 if start == 0 and not at_match else None  # of the record being read, absolute
    look = 0  # of the next search, within what is held
    while True:
        found = pattern.search(held, look)
        # Too near the end of what is held, a match could still change.
        if (found is None or found.end() > len(held) - START_BYTES) and not done:
            if found is None:
                look = max(look, len(held) - START_BYTES)
            keep = look if begin is None else min(look, begin - base)
            held, base, look = held[keep:], base + keep, look - keep
            new = file.read(chunk)
            done = not new
            held += new
            continue
        if found is None:
            if begin is not None and begin < end:
                yield held[begin - base :]
            return
        place = base + (found.start() if at_match else found.end())
        look = max(found.end(), look + 1)
        if place < start or (begin is not None and place == begin):
            continue
        if begin is not None:
            yield held[begin - base : place - base]
        if place >= end:
            return
        begin = place


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.pattern = re.compile(options["pattern"].encode())
        self.at_match = options["at_match"] == "true"
        self.size = int(options["range_bytes"])
        self.most = int(options["most"])
        self.tasks = int(options["tasks"])

    def partitions(self):
        # The first records of a file are found from its start; nothing else is read then.
        size = self.size if not self.most else 1 << 62
        # The reader goes into every task: the list of all files stays behind.
        listed, self.files = self.files, []
        parts = [(p, s, min(s + size, n)) for p, n in listed for s in range(0, n, size)]
        costs = [OPEN_COST + (0 if self.most else e - s) for _, s, e in parts]
        share = min(self.size, sum(costs) // self.tasks)
        packed, held, cost = [], [], 0
        for part, more in zip(parts, costs):
            if held and cost + more > share:
                packed.append(Ranges(held))
                held, cost = [], 0
            held.append(part)
            cost += more
        return [*packed, Ranges(held)]

    def read(self, partition):
        for path, start, end in partition.parts:
            with _open(path) as file:
                found = records(file, start, end, self.pattern, self.at_match)
                for place, record in enumerate(islice(found, self.most or None)):
                    yield path, start, place, record.decode("utf-8", errors="replace")


class RangeSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "path string, start bigint, pos int, value string"

    def reader(self, schema):
        return RangeReader(self.options)


def files(spark: SparkSession, path: str | list[str], glob: str) -> list[tuple[str, int]]:
    """Names and sizes of the files below some paths whose name fits ``glob``, in order; hidden ones are left out.

    A path may hold wildcards; one that is not there stops the job."""
    found: dict[str, int] = {}
    for one in [path] if isinstance(path, str) else path:
        root = spark._jvm.org.apache.hadoop.fs.Path(one)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.globStatus(root):
            raise FileNotFoundError(one)
        # Tasks list the folders; no file is opened for its name and size.
        told = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(one).select("path", "length").toArrow()
        for name, size in zip(told["path"].to_pylist(), told["length"].to_pylist()):
            base = name.rsplit("/", 1)[-1]
            if fnmatch.fnmatchcase(base, glob) and not base.startswith(("_", ".")) and size:
                found[name] = size
    return sorted(found.items())


def read_records(
    spark: SparkSession,
    path: str | list[str],
    glob: str,
    pattern: str,
    at_match: bool = False,
    range_bytes: int = RANGE_BYTES,
    most: int = 0,
    skip: str | None = None,
) -> DataFrame:
    """``path, start, pos, value``: the records of all files below some paths that fit ``glob``.

    ``pattern`` ends a record, or with ``at_match`` starts one; it matches at most
    ``START_BYTES`` bytes.  ``start`` and ``pos`` order the records of a file.
    With ``most`` only so many first records of each file are read.  Files whose
    path the pattern ``skip`` finds are left out.
    """
    spark.dataSource.register(RangeSource)
    found = [f for f in files(spark, path, glob) if not skip or not re.search(skip, f[0])]
    options = {
        "files": json.dumps(found),
        "pattern": pattern,
        "at_match": str(at_match).lower(),
        "range_bytes": str(range_bytes),
        "most": str(most),
        "tasks": str(spark.sparkContext.defaultParallelism),
    }
    return spark.read.format(NAME).options(**options).load()
