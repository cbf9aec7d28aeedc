"""A record store that skips what a lookup or a change does not touch.

Ids are dealt in slices of ``SLICE`` ids, as a counter gives them out; a slice is one
file, sorted, with statistics and Bloom filters on the id. So an id names its file, and
nothing has to be searched. A snapshot is a manifest, one row for each slice with the
folder that holds it now. A change writes the slices it touches anew and commits a new
manifest; all other files are in both. Readers take the last committed manifest and see
all of a change or nothing of it.

Small batches first lie beside the base as pending changes, of which there is a bound.
A read sends them to the base as a broadcast if they are few, so the base is not
shuffled, and joins them sorted if the bound lets more of them wait; a batch that would
exceed it is merged, with all that waits, into the slices it touches. The last batch of each stream is part of the manifest, so a batch that is
applied again changes nothing, and one that was killed before its commit is repeated
whole. One writer at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docreg.common import FEW_ROWS, reliable, sorted_if_many
from docreg.operators.registry import latest_records, one_per_id
from docreg.sources.commits import commit, last_version, version_path
from docreg.sources.records import decode_records, encode_records

SLICE = 1 << 20
MANIFEST = "kind string, slice long, path string, high long, n long"
BASE, PENDING, UNKNOWN, SEEN = "base", "pending", "unknown", "seen"
CHANGES = "id long, version long, ts timestamp, fields map<string, string>"
#: Ids that are compared one by one in a scan, so that Bloom filters see them.
_NAMED = 500
#: Tasks that list the folders of slices. Spark takes one for each folder up to ten
#: thousand, and the driver keeps what it knows of every task.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_LISTING_TASKS = 64


def _any_of(ids: list[int]) -> Column:
    """One of some ids, as a flat tree of equalities that reaches the files."""
    tests = [F.col("id") == i for i in ids]
    while len(tests) > 1:
        tests = [reduce(Column.__or__, tests[k : k + 2]) for k in range(0, len(tests), 2)]
    return tests[0]


@dataclass(frozen=True)
class RecordStore:
    """Records (id, created_at, fields) below ``root``. At most ``most_pending`` changes
    wait beside the base; ``key`` encrypts the field maps; ``group_rows`` is the number
    of records that are read or skipped together."""

    spark: SparkSession
    root: str
    slice_ids: int = SLICE
    most_pending: int = 100_000
    group_rows: int = 20_000
    key: str | None = None

    @contextmanager
    def _listed(self) -> Iterator[None]:
        """Folders are listed by few tasks in here."""
        set_before = self.spark.conf.get(_LISTING)
        self.spark.conf.set(_LISTING, str(min(int(set_before), _LISTING_TASKS)))
        try:
            yield
        finally:
            self.spark.conf.set(_LISTING, set_before)

    # --- manifests

    def manifest(self) -> DataFrame:
        last = last_version(self.spark, f"{self.root}/manifest")
        if last is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(version_path(f"{self.root}/manifest", last))

    def _commit(self, manifest: DataFrame) -> None:
        last = last_version(self.spark, f"{self.root}/manifest")
        commit(manifest.coalesce(1), f"{self.root}/manifest", 0 if last is None else last + 1)

    @staticmethod
    def _paths(manifest: DataFrame, kind: str) -> list[str]:
        """Paths of a part of the manifest: as many as Spark's list of files holds."""
        return [r.path for r in manifest.where(F.col("kind") == kind).select("path").orderBy("path").toLocalIterator()]

    def _slice(self, c: str = "id") -> Column:
        return F.floor(F.col(c) / F.lit(self.slice_ids)).cast("long")

    def _stored(self, paths: list[str]) -> DataFrame:
        schema = f"id long, created_at string, version long, payload {'string' if self.key is None else 'binary'}"
        with self._listed():
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _decoded(self, stored: DataFrame) -> DataFrame:
        return decode_records(stored, self.key, also=["version"])

    def _new_path(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"

    # --- writing

    def _write(self, records: DataFrame) -> DataFrame:
        """Write records (id, created_at, version, fields) by slice; their manifest rows."""
        path = self._new_path(BASE)
        encoded = encode_records(records, self.key, also=["version"]).withColumn("slice", self._slice())
        sorted_ = encoded.repartition("slice").sortWithinPartitions("slice", "id")
        sorted_.write.partitionBy("slice").option("parquet.bloom.filter.enabled#id", "true").option(
            "parquet.bloom.filter.expected.ndv#id", str(self.group_rows)
        ).option("parquet.block.row.count.limit", str(self.group_rows)).parquet(path)
        with self._listed():
            written = self.spark.read.schema("id long, slice long").parquet(path).groupBy("slice")
        rows = written.agg(F.max("id").alias("high"), F.count(F.lit(1)).alias("n"))
        return rows.select(F.lit(BASE).alias("kind"), "slice", F.concat(F.lit(f"{path}/slice="), "slice").alias("path"), "high", "n")

    def create(self, records: DataFrame) -> None:
        """The first snapshot, from records with unique ids."""
        self._commit(reliable(self._write(records.withColumn("version", F.lit(None).cast("long")))))

    # --- reading

    def _log(self, manifest: DataFrame, kind: str = PENDING) -> DataFrame:
        paths = self._paths(manifest, kind)
        return self.spark.read.schema(CHANGES).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES)

    @staticmethod
    def _changed(base: DataFrame, latest: DataFrame) -> DataFrame:
        """The base with changes (id, version, fields), one of each id at most: one
        without version counts, else a later one than the record's."""
        change = latest.select("id", F.struct("version", "fields").alias("_change"))
        newer = F.col("_change.version").isNull() | F.col("version").isNull() | (F.col("_change.version") > F.col("version"))
        counts = F.col("_change").isNotNull() & newer
        return base.join(change, "id", "left").select(
            "id", "created_at", F.when(counts, F.coalesce("_change.version", "version")).otherwise(F.col("version")).alias("version"),
            F.when(counts, F.col("_change.fields")).otherwise(F.col("fields")).alias("fields"),
        )

    @staticmethod
    def _waiting(manifest: DataFrame) -> int:
        """The number of pending changes."""
        return manifest.where(F.col("kind") == PENDING).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n

    def _current(self, stored: DataFrame, pending: DataFrame, n_pending: int) -> DataFrame:
        """Stored records with their pending changes, which are sent only if they are few:
        ``most_pending`` may be any number, and the driver holds all that is sent."""
        latest = latest_records(pending).select("id", "version", "fields")
        latest = F.broadcast(latest) if n_pending <= FEW_ROWS else latest.hint("merge")
        return self._changed(self._decoded(stored), latest).select("id", "created_at", "fields")

    def records(self) -> DataFrame:
        """The current records: the base with the latest pending change of each id."""
        manifest = self.manifest()
        return self._current(self._stored(self._paths(manifest, BASE)), self._log(manifest), self._waiting(manifest))

    def rejected(self) -> DataFrame:
        """Changes of batches to ids that no record has."""
        manifest = self.manifest()
        log = self._log(manifest).unionByName(self._log(manifest, UNKNOWN))
        ids = log.select("id").distinct()
        touched = manifest.join(ids.select(self._slice().alias("slice")).distinct(), "slice", "left_semi")
        held = self._stored(self._paths(touched, BASE)).select("id")
        return log.join(ids.join(held, "id", "left_semi"), "id", "left_anti")

    def lookup(self, ids: Iterable[int]) -> DataFrame:
        """The records of some ids. Slices without any of them are not opened, and of
        the others only what statistics and Bloom filters do not rule out is read."""
        asked = sorted(set(ids))
        if len(asked) > _NAMED:
            return self.lookup_all(self.spark.createDataFrame([(i,) for i in asked], "id long"))
        if not asked:
            return self.records().limit(0)
        manifest = self.manifest()
        slices = sorted({i // self.slice_ids for i in asked})
        paths = self._paths(manifest.where(F.col("slice").isin(slices)), BASE)
        return self._current(self._stored(paths).where(_any_of(asked)), self._log(manifest).where(F.col("id").isin(asked)), len(asked))

    def lookup_all(self, ids: DataFrame) -> DataFrame:
        """The records of a table of ids; only their slices are read."""
        manifest = self.manifest()
        touched = manifest.join(ids.select(self._slice().alias("slice")).distinct(), "slice", "left_semi")
        stored = self._stored(self._paths(touched, BASE)).join(ids.select("id").distinct(), "id", "left_semi")
        return self._current(stored, self._log(manifest), self._waiting(manifest))

    def between(self, low: int, high: int) -> DataFrame:
        """The records of a range of ids."""
        manifest, within = self.manifest(), F.col("id").between(low, high)
        slices = manifest.where(F.col("slice").between(low // self.slice_ids, high // self.slice_ids))
        return self._current(self._stored(self._paths(slices, BASE)).where(within), self._log(manifest).where(within), self._waiting(manifest))

    # --- changing

    def _rewritten(self, manifest: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The manifest with the slices that the changes touch written anew, and the
        changes that met no record."""
        ids = changes.select("id", self._slice().alias("slice"))
        touched = reliable(manifest.where(F.col("kind") == BASE).join(ids.select("slice").distinct(), "slice", "left_semi"))
        old = self._decoded(self._stored(self._paths(touched, BASE)))
        unknown = reliable(changes.join(old.select("id"), "id", "left_anti"))
        if touched.isEmpty():
            return manifest, unknown
        new = self._write(self._changed(old, changes))
        kept = manifest.join(touched.select("path"), "path", "left_anti").select(*manifest.columns)
        return reliable(kept.unionByName(new)), unknown

    def upsert(self, changes: DataFrame) -> DataFrame:
        """Apply changes (id, fields; optional version) at once. Returns those that
        were not applied: to unknown ids, or several to one id without a version."""
        settled, repeated = one_per_id(changes.where(F.col("id").isNotNull()))
        if "version" not in changes.columns:
            settled = settled.withColumn("version", F.lit(None).cast("long"))
        manifest, unknown = self._rewritten(reliable(self.manifest()), reliable(settled.select("id", "version", "fields")))
        self._commit(manifest)
        return unknown.select("id", "fields").unionByName(repeated.select("id", "fields"))

    def insert(self, records: DataFrame) -> None:
        """Add records (id, created_at, fields) with new ids; changes that waited for
        one of them are applied."""
        manifest = reliable(self.manifest())
        waited = latest_records(self._log(manifest, UNKNOWN)).select("id", "version", "fields")
        new = reliable(self._changed(records.withColumn("version", F.lit(None).cast("long")), waited))
        slices = new.select(self._slice().alias("slice")).distinct()
        touched = reliable(manifest.where(F.col("kind") == BASE).join(slices, "slice", "left_semi"))
        old = self._decoded(self._stored(self._paths(touched, BASE)))
        written = self._write(old.unionByName(new))
        kept = manifest.join(touched.select("path"), "path", "left_anti").select(*manifest.columns)
        self._commit(reliable(kept.unionByName(written)))

    def _row(self, kind: str, path: str, n: int) -> DataFrame:
        return self.spark.createDataFrame([(kind, None, path, None, n)], MANIFEST)

    def _add(self, kind: str, changes: DataFrame) -> DataFrame:
        """Write changes; their manifest row, none if there are none."""
        path = self._new_path(kind)
        changes.select("id", "version", "ts", "fields").write.parquet(path)
        n = self.spark.read.schema(CHANGES).parquet(path).count()
        return self._row(kind, path, n).where(F.col("n") > 0)

    def apply_batch(self, stream: str, batch: int, changes: DataFrame) -> bool:
        """Take a batch of changes (``CHANGES``) of a stream; batches of a stream rise.
        False if it was taken before. Changes to unknown ids are kept aside once they
        are merged, and wait for ``insert``."""
        manifest = reliable(self.manifest())
        mine = (F.col("kind") == SEEN) & (F.col("path") == stream)
        if not manifest.where(mine & (F.col("n") >= batch)).isEmpty():
            return False
        rest = manifest.where(~mine).unionByName(self._row(SEEN, stream, batch))
        added = reliable(rest.unionByName(self._add(PENDING, changes)))
        if self._waiting(added) <= self.most_pending:
            self._commit(added)
            return True
        log = self._log(added)
        latest = reliable(latest_records(log).select("id", "version", "fields"))
        merged, unknown = self._rewritten(reliable(added.where(F.col("kind") != PENDING)), latest)
        self._commit(merged.unionByName(self._add(UNKNOWN, log.join(sorted_if_many(unknown).select("id"), "id", "left_semi"))))
        return True
