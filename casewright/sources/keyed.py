"""Tables merged by key, partition by partition.

A store holds rows in partitions, and beside them an index: for each key the partition its rows lie in, their number and
a checksum of their content. A merge compares the incoming groups with the index alone; groups that are new, differ or
moved to another partition are changes. Only the partitions that a changed group enters or leaves are read and written
again, and only the buckets of the index that hold one of its keys; a merge without changes writes nothing.

Every merge writes into folders of its own and then publishes a list that maps each partition and bucket to its newest
folder, by one rename. Readers of the version before are not disturbed, and a merge that dies on the way leaves folders
that no list names.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.calendar import wall_clock
from casewright.sources.files import Folder
from casewright.sources.working import working_table

POINTER = "_current"
#: Partition of rows whose partition value is null.
NO_PART = "none"
BUCKETS = 32
_PART, _OLD, _BUCKET = "__part", "__old_part", "__bucket"
_SUMS = ["__rows", "__sum_1", "__sum_2"]


@dataclass(frozen=True)
class MergeReport:
    """What a merge did; ``parts`` and ``buckets`` are those written again."""

    published: bool
    version: str | None
    rows: int
    previous_rows: int
    inserted: int
    changed: int
    moved: int
    parts: tuple[str, ...]
    buckets: tuple[str, ...]
    warning: str | None = None


@dataclass(frozen=True)
class _State:
    """The published list: schema, and for partitions and buckets [folder, name in it, rows]."""

    schema: str
    parts: dict[str, list]
    buckets: dict[str, list]

    def rows(self) -> int:
        return sum(rows for *_, rows in self.parts.values())

    def fields(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


def month_of(day: Column) -> Column:
    """Partition value of a day: its year and month."""
    return F.date_format(day, "yyyy-MM")


def bucket_of(*keys: Column, count: int = 16) -> Column:
    """Partition value for rows without a natural one."""
    return F.lpad(F.pmod(F.xxhash64(*keys), F.lit(count)).cast("string"), 3, "0")


class KeyedStore:
    """A store in the folder ``path`` whose rows belong to groups of one ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.key = spark, key
        self.folder = Folder(spark, path)

    # -- reading ------------------------------------------------------------------------------------

    def _state(self) -> _State | None:
        if not self.folder.exists(POINTER):
            return None
        return _State(**json.loads(self.folder.read_text(self.folder.read_text(POINTER).strip())))

    def exists(self) -> bool:
        return self._state() is not None

    def schema(self) -> T.StructType | None:
        state = self._state()
        return state.fields() if state else None

    def _scan(self, listed: dict[str, list], schema: T.StructType, names: Sequence[str] | None) -> DataFrame:
        wanted = [n for n in (sorted(listed) if names is None else names) if n in listed]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*["/".join([self.folder.path, *listed[n][:2]]) for n in wanted])

    def _rows(self, state: _State, fields: T.StructType, parts: Sequence[str] | None = None) -> DataFrame:
        """Rows with their partition; columns that older files lack are null."""
        return self._scan(state.parts, T.StructType([*fields, T.StructField(_PART, T.StringType())]), parts)

    def read(self, parts: Sequence[str] | None = None) -> DataFrame:
        """The published rows, of some partitions only if they are given."""
        state = self._state()
        if state is None:
            raise FileNotFoundError(f"no published version in {self.folder.path}")
        return self._rows(state, state.fields(), parts).drop(_PART)

    def parts(self) -> dict[str, int]:
        """Rows of each partition."""
        state = self._state()
        return {name: rows for name, (*_, rows) in state.parts.items()} if state else {}

    def files(self) -> set[str]:
        """Folders of the published partitions and buckets."""
        state = self._state()
        return {f"{f}/{d}" for listed in (state.parts, state.buckets) for f, d, _ in listed.values()} if state else set()

    def _index(self, state: _State, buckets: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType(
            [
                T.StructField(self.key, state.fields()[self.key].dataType),
                T.StructField(_PART, T.StringType()),
                T.StructField("__rows", T.LongType()),
                T.StructField("__sum_1", T.DecimalType(38, 0)),
                T.StructField("__sum_2", T.DecimalType(38, 0)),
                T.StructField(_BUCKET, T.StringType()),
            ]
        )
        return self._scan(state.buckets, schema, buckets)

    # -- merging ------------------------------------------------------------------------------------

    def merge(
        self,
        rows: DataFrame,
        part: Column,
        *,
        now: datetime,
        stamp: str | None = None,
        unique: bool = False,
        written: bool = False,
        drop: Sequence[str] = (),
        keep: int = 7,
    ) -> MergeReport:
        """Replaces the groups of the keys in ``rows`` and publishes what came out.

        ``part`` is the partition of a row; all rows of a key must have the same. Keys that are not in ``rows`` stay.
        Columns in ``drop`` serve ``part`` only.
        ``stamp`` names a column that new and changed rows get ``now`` in; unchanged ones keep theirs. ``unique``
        refuses a key with several rows. Rows without a key are left out. Columns that the store does not have yet are
        added, null in rows that stay; leaving one out is an error. ``rows`` is written once first, since it is read
        twice, unless it is a ``written`` table already. One merge runs at a time.
        """
        name = F.coalesce(part.cast("string"), F.lit(NO_PART)).alias(_PART)
        rows = rows.filter(F.col(self.key).isNotNull()).select("*", name).drop(*drop)
        incoming = rows if written else working_table(rows, "merge-rows")
        columns = [c for c in incoming.columns if c != _PART]
        state = self._state()
        groups = self._groups(incoming, [c for c in columns if c != self.key], unique)
        changes = working_table(self._changes(groups, state), "merge-changes")
        told = changes.groupBy(_PART, _OLD, _BUCKET).agg(F.count("*").alias("n")).collect()
        if state is not None and not told:
            return MergeReport(True, None, state.rows(), state.rows(), 0, 0, 0, (), ())
        fresh = incoming.join(changes.select(self.key), self.key, "left_semi").select(*columns, _PART)
        if stamp:
            fresh = fresh.withColumn(stamp, wall_clock(now))
        out = [*columns, *([stamp] if stamp else [])]
        dirty = sorted({r[c] for r in told for c in (_PART, _OLD)} - {None})
        buckets = sorted({r[_BUCKET] for r in told})
        index = changes.drop(_OLD)
        fresh = fresh.select(*out, _PART)
        if state is not None:
            known = state.fields()
            gone = set(known.fieldNames()) - set(out)
            if gone:
                raise ValueError(f"rows lack {', '.join(sorted(gone))} of the store")
            fields = T.StructType([*known, *(f for f in fresh.drop(_PART).schema if f.name not in known.fieldNames())])
            old, touched = self._rows(state, fields, dirty), changes.select(self.key)
            fresh = old.join(touched, self.key, "left_anti").select(old.columns).unionByName(fresh)
            index = self._index(state, buckets).join(touched, self.key, "left_anti").unionByName(index)
        return self._publish(state, fresh, index, dirty, buckets, told, now, keep)

    def _groups(self, rows: DataFrame, values: list[str], unique: bool) -> DataFrame:
        """(key, partition, number of rows, two sums of row hashes, bucket)."""
        content = F.struct(*[F.col(f"`{v}`") for v in sorted(values)]) if values else F.lit(0)
        hashes = [F.sum(F.xxhash64(F.lit(seed), content).cast("decimal(38,0)")) for seed in (1, 2)]
        groups = rows.groupBy(self.key).agg(
            F.min(_PART).alias(_PART),
            F.max(_PART).alias("__last"),
            F.count("*").alias("__rows"),
            *[h.alias(name) for h, name in zip(hashes, _SUMS[1:], strict=True)],
        )
        text = F.col(self.key).cast("string")
        wrong = F.when(F.col("__last") != F.col(_PART), F.raise_error(F.concat(F.lit("two partitions for key "), text)))
        if unique:
            wrong = wrong.when(F.col("__rows") > 1, F.raise_error(F.concat(F.lit("repeated key "), text)))
        bucket = bucket_of(F.col(self.key), count=BUCKETS)
        return groups.filter(wrong.otherwise(F.lit(True))).select(self.key, _PART, *_SUMS, bucket.alias(_BUCKET))

    def _changes(self, groups: DataFrame, state: _State | None) -> DataFrame:
        """Groups that the index lacks or holds otherwise, with the partition they were in."""
        if state is None:
            return groups.withColumn(_OLD, F.lit(None).cast("string"))
        old = self._index(state).select(self.key, *[F.col(c).alias(f"__was{c}") for c in (_PART, *_SUMS)])
        same = F.lit(True)
        for c in (_PART, *_SUMS):
            same = same & F.col(c).eqNullSafe(F.col(f"__was{c}"))
        joined = groups.join(old, self.key, "left").filter(~same)
        return joined.select(*groups.columns, F.col(f"__was{_PART}").alias(_OLD))

    def _publish(
        self,
        state: _State | None,
        rows: DataFrame,
        index: DataFrame,
        dirty: list[str],
        buckets: list[str],
        told: list,
        now: datetime,
        keep: int,
    ) -> MergeReport:
        # Names sort by time; a run that is repeated after a failure gets another one.
        version = f"{now:%Y%m%d_%H%M%S_%f}_{uuid.uuid4().hex[:8]}"
        schema = json.dumps(rows.drop(_PART).schema.jsonValue())
        written: list[dict[str, list]] = []
        for letter, frame, by in (("d", rows, _PART), ("i", index, _BUCKET)):
            # Small partitions share a task, a large one is written by several.
            spread = frame.hint("rebalance", F.col(by)).withColumn("in", F.col(by))
            spread.write.partitionBy("in").parquet(f"{self.folder.path}/{letter}_{version}")
            written.append(self._listed(f"{letter}_{version}", by))
        parts = {n: v for n, v in (state.parts if state else {}).items() if n not in dirty} | written[0]
        listed = {n: v for n, v in (state.buckets if state else {}).items() if n not in buckets} | written[1]
        new = _State(schema, parts, listed)
        self.folder.write_text(f"m_{version}.json", json.dumps(vars(new)))
        self.folder.write_text(POINTER, f"m_{version}.json")
        self._prune(keep)
        count = {k: sum(r["n"] for r in told if test(r)) for k, test in _KINDS.items()}
        return MergeReport(True, version, new.rows(), state.rows() if state else 0, **count, parts=tuple(dirty), buckets=tuple(buckets))

    def _listed(self, folder: str, by: str) -> dict[str, list]:
        """Partitions of a folder: its name, theirs in it, and the rows of the written files."""
        names = [n for n in Folder(self.spark, f"{self.folder.path}/{folder}").children() if n.startswith("in=")]
        if not names:
            return {}
        paths = [f"{self.folder.path}/{folder}/{n}" for n in names]
        counts = dict(map(tuple, self.spark.read.schema(f"{by} string").parquet(*paths).groupBy(by).count().collect()))
        plain = {urllib.parse.unquote(n.split("=", 1)[1]): n for n in names}
        return {name: [folder, inside, counts[name]] for name, inside in plain.items()}

    def _prune(self, keep: int) -> None:
        """Deletes the lists before the newest ``keep``, and what only they, or runs before them that died, wrote."""
        names = self.folder.children()
        lists = [n for n in names if n.startswith("m_")]
        if len(lists) <= keep:
            return
        states = [_State(**json.loads(self.folder.read_text(name))) for name in lists[-keep:]]
        used = {(f, d) for s in states for listed in (s.parts, s.buckets) for f, d, _ in listed.values()}
        for name in lists[:-keep]:
            self.folder.delete(name)
        kept, oldest = {f for f, _ in used}, lists[-keep][2:-5]
        for name in names:
            if name[:2] not in ("d_", "i_") or name[2:] >= oldest:
                continue
            if name not in kept:
                self.folder.delete(name)
                continue
            inside = Folder(self.spark, f"{self.folder.path}/{name}")
            for part in inside.children():
                if part.startswith("in=") and (name, part) not in used:
                    inside.delete(part)


_KINDS = {
    "inserted": lambda r: r[_OLD] is None,
    "changed": lambda r: r[_OLD] == r[_PART],
    "moved": lambda r: r[_OLD] is not None and r[_OLD] != r[_PART],
}
