"""Tables of which an upsert rewrites only the parts that its keys fall into.

Rows lie in parts by a hash of their key.  A write puts the parts it touches into a folder of its own number and then
names, in a manifest of that number, the folder in which each part of the table now lies; a part that was not touched
stays where it was.  Readers go by the newest manifest, so they see a whole write or nothing of it, and a write that
fails leaves folders that no manifest names.  ``vacuum`` removes the folders that the newest manifests do not name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scratch import cut_with, list_dirs, path_exists, remove_path

#: Rows of a part when a table is made, and fewest parts.
ROWS_PER_PART, LEAST_PARTS = 1_000_000, 16
#: Newest versions whose files stay after a write, for those who still read them.
KEPT = 3

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    found = (re.fullmatch(prefix + r"=(\d+)", d) for d in list_dirs(spark, folder))
    return sorted(int(m.group(1)) for m in found if m)


class PartedTable:
    """A table below ``folder`` (shared storage), with unique ``keys``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # -- manifests: rows (part, version) and, the same in all of them, the number of parts, the keys and the schema
    def versions(self) -> list[int]:
        found = _numbers(self.spark, f"{self.folder}/_manifest", "v")
        return [v for v in found if path_exists(self.spark, f"{self.folder}/_manifest/v={v:06d}/_SUCCESS")]

    def last_number(self) -> int:
        """Highest number that any write, finished or not, has used."""
        return max([*_numbers(self.spark, f"{self.folder}/_manifest", "v"), *_numbers(self.spark, self.folder, "p"), 0])

    def _manifest(self, version: int) -> tuple[dict[int, int], int, list[str], StructType]:
        rows = self.spark.read.parquet(f"{self.folder}/_manifest/v={version:06d}").collect()  # one row a part
        about = rows[0]
        where = {r["part"]: r["version"] for r in rows if r["part"] >= 0}
        return where, about["parts"], about["keys"].split(","), StructType.fromDDL(about["columns"])

    def _record(self, version: int, where: dict[int, int], parts: int, keys: list[str], schema: StructType) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        # a row for part -1 stands for the table where no part has rows
        rows = [(part, at, parts, ",".join(keys), columns) for part, at in {-1: 0, **where}.items()]
        data = self.spark.createDataFrame(rows, "part int, version int, parts int, keys string, columns string")
        data.write.parquet(f"{self.folder}/_manifest/v={version:06d}")

    # -- rows --------------------------------------------------------------------------
    def _dealt(self, df: DataFrame, keys: list[str], parts: int) -> DataFrame:
        return df.withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(parts)).cast("int"))

    def _write(self, df: DataFrame, keys: list[str], parts: int, number: int) -> set[int]:
        """Parts of ``df`` as files of write ``number``; which of them have rows."""
        self._dealt(df, keys, parts).repartition("__part").write.partitionBy("__part").parquet(f"{self.folder}/p={number:06d}")
        return set(_numbers(self.spark, f"{self.folder}/p={number:06d}", "__part"))

    def _rows(self, where: dict[int, int], schema: StructType) -> DataFrame:
        paths = [f"{self.folder}/p={at:06d}/__part={part}" for part, at in sorted(where.items())]
        # columns that later writes have added are null in the parts that they did not touch
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        where, _, _, schema = self._manifest(self.versions()[-1] if version is None else version)
        return self._rows(where, schema)

    def create(self, df: DataFrame, keys: list[str], parts: int | None = None, above: int = 0) -> int:
        """Replace the table by ``df`` with new parts, under a number higher than ``above``."""
        if parts is None:
            df, told = cut_with(df, "parted", rows=F.count(F.lit(1)))
            parts = max(LEAST_PARTS, math.ceil(told["rows"] / ROWS_PER_PART))
        number = max(self.last_number(), above) + 1
        written = self._write(df, keys, parts, number)
        self._record(number, dict.fromkeys(written, number), parts, keys, df.schema)
        self.vacuum()
        return number

    def upsert(self, new: DataFrame, merge: Merge) -> int:
        """Put ``merge(old rows, new rows)`` in the place of the parts that the keys of ``new`` fall into."""
        where, parts, keys, schema = self._manifest(self.versions()[-1])
        new = self._dealt(new, keys, parts)
        touched = {r["__part"] for r in new.select("__part").distinct().collect()}  # at most as many as there are parts
        old = self._rows({p: at for p, at in where.items() if p in touched}, schema)
        merged = merge(old, new.drop("__part"))
        number = self.last_number() + 1
        written = self._write(merged, keys, parts, number)
        kept = {p: at for p, at in where.items() if p not in touched}
        added = [f for f in merged.schema if f.name not in schema.names]
        self._record(number, {**kept, **dict.fromkeys(written, number)}, parts, keys, StructType([*schema, *added]))
        self.vacuum()
        return number

    def vacuum(self, keep: int = KEPT) -> list[str]:
        """Remove manifests older than the ``keep`` newest, and the parts and folders that none of these name."""
        known = self.versions()
        stay = known[-keep:]
        used = {(at, part) for v in stay for part, at in self._manifest(v)[0].items()}
        gone = []
        for number in _numbers(self.spark, self.folder, "p"):
            if number > known[-1]:
                continue  # a write under way
            folder = f"{self.folder}/p={number:06d}"
            parts = _numbers(self.spark, folder, "__part")
            unused = [p for p in parts if (number, p) not in used]
            gone += [folder] if len(unused) == len(parts) else [f"{folder}/__part={p}" for p in unused]
        gone += [f"{self.folder}/_manifest/v={v:06d}" for v in known[:-keep]]
        for path in gone:
            remove_path(self.spark, path)
        return gone
