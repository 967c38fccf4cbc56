"""A set sorted by score that is polled for its first members, as a stream: `spark.readStream.format("sorted_set")`.

The set is a folder of files of changes, in the order of their names; a file is never changed once it has its name. A line adds a member
(`add`, score, member; an older score is replaced) or removes one (`remove`, member), tab between. A poll takes the first `size` members
as the set stands after the newest file. Its offset is that file's name, so a poll that is run again after a failure sees the same set and
gives the same rows, whatever has come since; without a new file there is no poll. Between polls members stay in the set until they are
removed, so a member may come again: streaming.seen drops those.

Members are dealt to `parts` readers by hash; each goes through the files, keeps its own members and gives its first `size`, and rows()
takes the first of all, at most parts * size rows a poll.

Options: path, size (100), parts (4). Columns: poll (the offset's file), score, member. Defined results: ties of scores go by member; NaN and
lines that can't be read are errors that name the file; an empty folder has no polls.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lumenframe.sources.tfrecord import _at

SCHEMA = "poll string, score double, member string"


def files(path: str) -> list[str]:
    """Names of the files of changes, in order."""
    from pyarrow import fs

    system, at = _at(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return []
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def head(path: str, upto: str, size: int, part: int = 0, parts: int = 1) -> list[tuple[float, str]]:
    """(score, member) of the first members of one part of the set as it stands after the file `upto`."""
    system, at = _at(path)
    held: dict[str, float] = {}
    for name in files(path):
        if name > upto:
            break
        with system.open_input_stream(f"{at}/{name}") as stream:
            for line in stream.read().decode().splitlines():
                what, *rest = line.split("\t")
                if what == "add" and len(rest) == 2 and not math.isnan(score := float(rest[0])):
                    if xxhash.xxh64_intdigest(rest[1]) % parts == part:
                        held[rest[1]] = score
                elif what == "remove" and len(rest) == 1:
                    held.pop(rest[0], None)
                else:
                    raise ValueError(f"{name}: can't read the line {line!r}")
    return nsmallest(size, ((score, member) for member, score in held.items()))


@dataclass
class Part(InputPartition):
    upto: str
    part: int

    def __init__(self, upto: str, part: int) -> None:
        super().__init__((upto, part))
        self.upto, self.part = upto, part


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size, self.parts = options["path"], int(options.get("size", 100)), int(options.get("parts", 4))

    def initialOffset(self) -> dict:
        return {"upto": ""}

    def latestOffset(self) -> dict:
        return {"upto": max(files(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(end["upto"], k) for k in range(self.parts)] if end["upto"] > start["upto"] else [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        found = head(self.path, partition.upto, self.size, partition.part, self.parts) if partition.upto else []
        yield pa.record_batch([pa.array([partition.upto] * len(found), pa.string()), pa.array([s for s, _ in found], pa.float64()), pa.array([m for _, m in found], pa.string())], names=["poll", "score", "member"])

    def commit(self, end: dict) -> None:
        pass


class SortedSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sorted_set"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SortedSet)


def rows(batch: DataFrame, size: int = 100) -> DataFrame:
    """Of a micro-batch, the first `size` members of each poll over all parts."""
    return batch.withColumn("rank", F.row_number().over(Window.partitionBy("poll").orderBy("score", "member"))).filter(F.col("rank") <= size)


def append_changes(df: DataFrame, path: str, file: str, order: str) -> None:
    """Writes changes (columns what, score, member) as files of the set, one for each value of `file` (its name), lines by `order`. A file
    is written by one task under a name that readers skip, and gets its own when it is whole; one that is there already stays."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _at(path)
        system.create_dir(at, recursive=True)
        name = stream = None

        def close() -> None:
            from pyarrow import fs

            stream.close()
            if system.get_file_info(f"{at}/{name}").type == fs.FileType.NotFound:
                system.move(f"{at}/.writing-{run}", f"{at}/{name}")
            else:
                system.delete_file(f"{at}/.writing-{run}")

        for batch in it:
            for own, what, score, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != name:
                    if name is not None:
                        close()
                    name, run = own, uuid.uuid4().hex
                    stream = system.open_output_stream(f"{at}/.writing-{run}")
                stream.write(("\t".join([what, repr(score), member] if what == "add" else [what, member]) + "\n").encode())
        if name is not None:
            close()
        yield pa.record_batch([pa.array([], pa.string())], names=["file"])

    lines = df.select(F.col(file).cast("string").alias("__file"), "what", F.col("score").cast("double").alias("score"), F.col("member").cast("string").alias("member"), F.col(order).alias("__order"))
    dealt = lines.repartition("__file").sortWithinPartitions("__file", "__order").drop("__order")
    dealt.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
