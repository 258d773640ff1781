"""Tables that grow by parts. A state file names the live parts; readers see nothing else,
so a writer that fails before its commit leaves the table as it was."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import drop_folder
from rankloom.sources.guards import try_read

STATE = ("parts array<struct<name: string, kind: string, level: int>>, retired array<string>")
#: States that stay after newer ones, for readers under way.
OLD_STATES = 8


@dataclass(frozen=True)
class Part:
    """One write. Its name starts with the version that brought it in."""

    name: str
    kind: str
    level: int = 0


@dataclass(frozen=True)
class State:
    """Live parts, oldest first, and replaced ones whose folders are still there."""

    version: int = 0
    parts: tuple[Part, ...] = ()
    retired: tuple[str, ...] = ()

    def new_part(self, kind: str, level: int = 0) -> Part:
        return Part(f"{self.version + 1}-{uuid.uuid4().hex}", kind, level)

    def names(self, *kinds: str) -> list[str]:
        return [p.name for p in self.parts if p.kind in kinds]


def read_state(spark: SparkSession, path: str) -> State:
    """The newest state; an empty one when nothing was committed yet."""
    table = try_read(spark, f"{path}/state")
    row = None if table is None else table.orderBy(F.desc("version")).first()
    if row is None:
        return State()
    return State(int(row["version"]), tuple(Part(*p) for p in row["parts"]), tuple(row["retired"]))


def commit(spark: SparkSession, path: str, state: State, parts: list[Part],
           retired: tuple[str, ...] = ()) -> State:
    """Make ``parts`` the live ones. Fails when another writer has followed ``state`` already."""
    following = State(state.version + 1, tuple(parts), tuple(retired))
    row = ([(p.name, p.kind, p.level) for p in parts], list(retired))
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("errorifexists").parquet(
        f"{path}/state/version={following.version}")
    drop_folder(spark, f"{path}/state/version={following.version - OLD_STATES}")
    return following


def part_path(path: str, table: str, name: str) -> str:
    return f"{path}/{table}/part={name}"


def read_parts(spark: SparkSession, path: str, table: str, names: list[str], schema: str) -> DataFrame:
    """Rows of the named parts with ``seq``, the version that brought them in."""
    rows = spark.read.schema(f"{schema}, part string").option("basePath", f"{path}/{table}").parquet(
        *[part_path(path, table, n) for n in names])
    return rows.withColumn("seq", F.split_part("part", F.lit("-"), F.lit(1)).cast("bigint")).drop("part")
