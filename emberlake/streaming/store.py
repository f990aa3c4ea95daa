"""Parquet tables that micro-batches add to: a batch writes partitions of its own, and readers combine the batches.

Nothing that was written before is read or rewritten by a batch, so its cost is its own size. A batch counts for readers
once it is marked, after all its tables were written. Folds put the parts of several batches together, by tiers: a part is
rewritten only with newer ones that are together larger than a share of it, so each row is rewritten a number of times that
grows with the logarithm of the table. A fold replaces its parts only once it is whole, and readers skip what it contains.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from emberlake.sources import shared


class Table:
    """A table under ``root``; only the folders that are asked for are listed and read."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, partitions: Sequence[str]):
        self.spark, self.root, self.path, self.schema, self.partitions = spark, root, f"{root}/{name}", schema, list(partitions)

    def _at(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def values(self) -> list[str]:
        """The values of the first partition column, by the names of folders."""
        store, path = self._at(self.path)
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{self.partitions[0]}="))

    def read(self, values: Sequence[object] | None = None) -> DataFrame:
        """The whole table, or the partitions of some values of the first partition column."""
        known = self.values()
        wanted = known if values is None else sorted({str(v) for v in values} & set(known))
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/{self.partitions[0]}={v}" for v in wanted]
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths).select(*self.schema.names)

    def remove(self, value: object) -> None:
        """Takes out one partition of the first partition column."""
        shared.delete(self.spark, f"{self.path}/{self.partitions[0]}={value}")

    def overwrite(self, rows: DataFrame, order: Sequence[str] = ()) -> None:
        """Replaces the partitions that ``rows`` has, and no other: writing the same rows again changes nothing.

        Rows of a file are in ``order``, so that readers of some values of it skip most of the file.
        """
        # rebalanced: one file for a small partition, several for a large one
        dealt = rows.select(*self.schema.names).hint("rebalance", *self.partitions)
        if order:
            dealt = dealt.sortWithinPartitions(*self.partitions, *order)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.partitions).parquet(self.path)


def span(first: int, last: int) -> str:
    return f"{first:012d}-{last:012d}"


class Commits:
    """Marks of batches whose tables are all written: empty files, and one for all batches up to a number."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/commits"

    def _store(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self) -> list[str]:
        store, path = self._store()
        return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []

    def _write(self, name: str) -> None:
        store, path = self._store(name)
        store.create(path, True).close()

    def mark(self, batch_id: int) -> None:
        self._write(f"batch-{batch_id:012d}")

    def known(self) -> Callable[[int], bool]:
        """Which batches are marked, as of now."""
        names = [n.split("-") for n in self._names()]
        upto = max((int(n) for kind, n in names if kind == "upto"), default=-1)
        single = {int(n) for kind, n in names if kind == "batch"}
        return lambda batch_id: batch_id <= upto or batch_id in single

    def compact(self, upto: int) -> None:
        """One mark for all batches up to ``upto``, which are all marked or left out for good."""
        self._write(f"upto-{upto:012d}")
        for name in self._names():
            kind, n = name.split("-")
            if int(n) < upto or (kind == "batch" and int(n) == upto):
                shared.delete(self.spark, f"{self.path}/{name}")


#: A part is folded with the newer ones if these are together larger than this share of it.
TIER = 0.5


class Batches(Table):
    """Rows by the batches they came with; ``combine`` makes one state of the rows of many (its last column: the batches).

    The first partition column, ``batches``, is the span of batch numbers that a part stands for. With ``commits``, readers
    take the parts of marked batches alone.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: StructType, combine: Callable[[DataFrame], DataFrame], partitions: Sequence[str] = (), commits: Commits | None = None, order: Sequence[str] = ()):
        self.combine, self.columns, self.commits, self.order = combine, list(schema.names), commits, order
        super().__init__(spark, root, name, StructType([*schema.fields, StructField("batches", StringType())]), ["batches", *partitions])

    def put(self, rows: DataFrame, batch_id: int) -> None:
        self.overwrite(rows.withColumn("batches", F.lit(span(batch_id, batch_id))), self.order)

    def take_out(self, batch_id: int) -> None:
        self.remove(span(batch_id, batch_id))

    def parts(self, marked: Callable[[int], bool] | None = None) -> list[tuple[int, int]]:
        """The spans that make up the state: those of marked batches that no other span contains. Folds are of marked batches."""
        if marked is None:
            marked = self.commits.known() if self.commits else lambda batch_id: True
        found = sorted((tuple(map(int, v.split("-"))) for v in self.values()), key=lambda s: (s[0], -s[1]))
        found = [s for s in found if s[0] < s[1] or marked(s[0])]
        out: list[tuple[int, int]] = []
        for first, last in found:
            if not out or last > out[-1][1]:
                out.append((first, last))
        return out

    def _of(self, parts: Sequence[tuple[int, int]]) -> DataFrame:
        return self.combine(self.read([span(*p) for p in parts])).select(*self.columns)

    def state(self, marked: Callable[[int], bool] | None = None) -> DataFrame:
        return self._of(self.parts(marked))

    def folders(self) -> dict[str, list[str]]:
        """The paths of each value of the second partition column, over the parts of the state."""
        out: dict[str, list[str]] = {}
        for p in self.parts():
            store, path = self._at(f"{self.path}/{self.partitions[0]}={span(*p)}")
            for s in store.listStatus(path):
                name, _, value = s.getPath().getName().partition("=")
                if name == self.partitions[1]:
                    out.setdefault(value, []).append(f"{path.toString()}/{name}={value}")
        return out

    def read_folders(self, paths: Sequence[str]) -> DataFrame:
        """All rows of some folders, not combined."""
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths).select(*self.schema.names)

    def _bytes(self, part: tuple[int, int]) -> int:
        store, path = self._at(f"{self.path}/{self.partitions[0]}={span(*part)}")
        return store.getContentSummary(path).getLength()

    def fold(self, upto: int, tier: float = TIER) -> list[tuple[int, int]]:
        """Puts the newest parts up to a batch together, and older ones as long as the newer are more than ``tier`` of them.

        Returns the parts that were rewritten. Parts that stay are each larger than the newer ones by that ratio, so a state
        has few parts, and what is rewritten grows by a factor each time.
        """
        parts = [p for p in self.parts() if p[1] <= upto]
        sizes = [self._bytes(p) for p in parts]
        first, size = len(parts) - 1, sizes[-1] if sizes else 0
        while first > 0 and size > tier * sizes[first - 1]:
            first -= 1
            size += sizes[first]
        parts = parts[max(0, first) :]
        if len(parts) < 2:
            return []
        made = span(parts[0][0], parts[-1][1])
        self.overwrite(self._of(parts).withColumn("batches", F.lit(made)), self.order)
        # contained in the new one from here on, so readers don't miss them
        for v in {span(*p) for p in parts} - {made}:
            self.remove(v)
        return parts
