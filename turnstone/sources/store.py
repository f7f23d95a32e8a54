"""Append-only Parquet tables: a folder for each writer, batch and generation, one partition per project.

A writer (a batch job, or one stream) numbers its own batches. A batch that runs again makes a new generation of its own
folder and replaces no other, so replays change nothing. Folders count once the manifest names them: the tables of a batch are
written first and published together, so readers see a batch whole or not at all, and keep the generation they opened.
Sessions are stored as versions and resolved when read. One batch of a store runs at a time.

Beside the messages a batch stores what later batches and searches need of them without reading texts: the keys, partitioned
by a prefix of their hash, and for each project the number of texts and their total length.

``compact`` merges the batches of each writer that can no longer change; ``vacuum`` deletes folders that do not count.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import merge_partials, upsert_sessions
from ..schema import TABLES
from .manifest import Manifest, State

# orders the versions of a session
VERSION = ["seq", "_synced", "writer"]
KEY_PREFIXES = 64
# tables of what a batch's messages hold, and the columns that identify a message there
KEYS = {"messages": ("keys", ("project_slug", "uuid")), "team_messages": ("team_keys", ("uuid",))}
STATS = {"messages": "stats", "team_messages": "team_stats"}
_PARTITIONS = {"keys": "prefix", "team_keys": "prefix", "stats": None, "team_stats": None}
_FOLDER = re.compile(r"(\w+)/writer=(.*)/batch_id=(\d+)/gen=\w+")


def key_prefix(key: tuple[str, ...], prefixes: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(prefixes)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, writer: str = "batch", key_prefixes: int = KEY_PREFIXES):
        """``key_prefixes`` counts for a new store; later it is what the store was made with."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.writer = writer
        self.manifest = Manifest(spark, self.root)
        self._key_prefixes = key_prefixes

    def table_path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def prefixes(self) -> int:
        return self.manifest.read().settings.get("key_prefixes", self._key_prefixes)

    # ------------------------------------------------------------ writing

    def stage(self, table: str, frame: DataFrame, batch_id: int, order: tuple[str, ...] = ()) -> str:
        """Write one batch of a table where no reader looks yet. The rebalance splits a hot project over tasks and
        merges small ones."""
        folder = f"{table}/writer={self.writer}/batch_id={batch_id}/gen={uuid.uuid4().hex}"
        rows = frame.drop("batch_id", "writer")
        by = _PARTITIONS.get(table, "project_slug")
        if by == "prefix":
            rows = rows.repartition("prefix").sortWithinPartitions("prefix", "uuid")
        elif by:
            rows = rows.hint("rebalance", by).sortWithinPartitions(by, *order)
        writer = rows.write.partitionBy(by) if by else rows.write
        writer.parquet(f"{self.root}/{folder}")
        return folder

    def stage_messages(self, table: str, frame: DataFrame, batch_id: int, order: tuple[str, ...] = ()) -> list[str]:
        """The messages of one batch, their keys and their statistics."""
        folder = self.stage(table, frame, batch_id, order)
        return [folder, *self.stage_marks(table, self._scan(table, [folder]), batch_id)]

    def stage_marks(self, table: str, rows: DataFrame, batch_id: int) -> list[str]:
        keys, key = KEYS[table]
        marks = rows.select("uuid", "project_slug", key_prefix(key, self.prefixes()).alias("prefix"))
        sums = rows.groupBy("project_slug").agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("total_len"))
        return [self.stage(keys, marks, batch_id), self.stage(STATS[table], sums.coalesce(1), batch_id)]

    def publish(self, folders: list[str]) -> None:
        """Make staged folders count, each instead of the earlier generation of its batch."""
        batches = {f.rsplit("/", 1)[0] for f in folders}

        def edit(state: State) -> None:
            for folder in folders:
                _, writer, batch = _FOLDER.fullmatch(folder).groups()
                if int(batch) <= state.final.get(writer, -1):
                    raise ValueError(f"batch {batch} of {writer} is compacted and can no longer change")
            state.settings.setdefault("key_prefixes", self._key_prefixes)
            state.folders = [f for f in state.folders if f.rsplit("/", 1)[0] not in batches] + folders

        self.manifest.change(edit)

    def write(self, table: str, frame: DataFrame, batch_id: int, order: tuple[str, ...] = ()) -> None:
        self.publish([self.stage(table, frame, batch_id, order)])

    # ------------------------------------------------------------ reading

    def _live(self, table: str) -> list[tuple[str, str, int]]:
        """Folder, writer and batch of what counts in a table."""
        found = (_FOLDER.fullmatch(f) for f in self.manifest.read().folders)
        return [(m[0], m[2], int(m[3])) for m in found if m[1] == table]

    def _scan(self, table: str, folders: list[str]) -> DataFrame:
        schema = TABLES[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.table_path(table))
        rows = reader.parquet(*[f"{self.root}/{f}" for f in folders])
        return rows.select(*[c for c in rows.columns if c != "gen"])

    def read(self, table: str, only: int | None = None, others: int | None = None) -> DataFrame:
        """All batches of a table; ``only`` one of this writer, or all but that one (``others``)."""
        own = lambda writer, batch, number: writer == self.writer and batch == number
        return self._scan(
            table,
            [
                folder for folder, writer, batch in self._live(table)
                if (only is None or own(writer, batch, only)) and (others is None or not own(writer, batch, others))
            ],
        )

    def stored_keys(self, table: str, asked: DataFrame, others: int) -> DataFrame:
        """Keys of other batches that may be among those of ``asked``: of their prefixes only, without any text."""
        name, key = KEYS[table]
        prefix = key_prefix(key, self.prefixes())
        # at most one row for each prefix
        wanted = [r[0] for r in asked.select(prefix.alias("prefix")).distinct().collect()]
        return self.read(name, others=others).filter(F.col("prefix").isin(wanted))

    def search_stats(self, team: bool = False) -> DataFrame:
        """``project_slug``, ``n_docs``, ``total_len`` of all stored texts, from the sums that each batch left."""
        parts = self.read(STATS["team_messages" if team else "messages"])
        return parts.groupBy("project_slug").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))

    def session_versions(self, team: bool = False) -> DataFrame:
        """Every version of each session; ``seq`` is the batch that said so, also where batches are merged."""
        rows = self.read("team_sessions" if team else "sessions")
        return rows.drop("batch_id").withColumn("_synced", F.col("last_synced_at"))

    def scan_sessions(self, team: bool = False, of: DataFrame | None = None) -> DataFrame:
        """Resolved sessions; with ``of`` only those of its keys, found before their versions meet."""
        key = ("session_id",) if team else ("project_slug", "session_id")
        versions = self.session_versions(team)
        if of is not None:
            versions = versions.join(of.select(*key).distinct(), list(key), "left_semi")
        return upsert_sessions(versions, key, VERSION)

    def scan_messages(self, team: bool = False) -> DataFrame:
        return self.read("team_messages" if team else "messages")

    def list_projects(self) -> DataFrame:
        """Projects that own a store, from folder names alone."""
        live = [f for f, _, _ in self._live("sessions")]
        names = sorted({self._slug_of(p) for f in live for p in self._glob(f"{f}/project_slug=*")})
        return self.spark.createDataFrame([(n,) for n in names], "project_slug string")

    def _glob(self, pattern: str) -> list:
        found = self.manifest.files().globStatus(self.manifest._path(f"{self.root}/{pattern}"))
        return [f.getPath() for f in found or []]

    def _slug_of(self, folder) -> str:
        names = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return names.unescapePathName(folder.getName().split("=", 1)[1])

    # ------------------------------------------------------------ upkeep

    def purge_project(self, slug: str) -> None:
        """Delete every trace of one project: its partitions in all batches of all tables, its keys and statistics."""
        for table, by in _PARTITIONS.items():
            for folder, writer, batch in self._live(table):
                rows = self._scan(table, [folder])
                if rows.filter(F.col("project_slug") == slug).isEmpty():
                    continue
                kept = Store(self.spark, self.root, writer).stage(table, rows.filter(~F.col("project_slug").eqNullSafe(slug)), batch)
                self._replace([folder], [kept])
                self.manifest.files().delete(self.manifest._path(f"{self.root}/{folder}"), True)
        for table in set(TABLES) - set(_PARTITIONS):
            for folder in self._glob(f"{table}/writer=*/batch_id=*/gen=*/project_slug=*"):
                if self._slug_of(folder) == slug:
                    self.manifest.files().delete(folder, True)
        self.spark.catalog.refreshByPath(self.root)

    def _replace(self, old: list[str], new: list[str], final: dict[str, int] | None = None) -> None:
        def edit(state: State) -> None:
            if missing := set(old) - set(state.folders):
                raise OSError(f"changed meanwhile: {sorted(missing)}")
            state.folders = [f for f in state.folders if f not in set(old)] + new
            for writer, batch in (final or {}).items():
                state.final[writer] = max(batch, state.final.get(writer, -1))

        self.manifest.change(edit)

    def compact(self, keep_newest: int = 1) -> dict[str, int]:
        """Merge, for each writer, all batches but the newest ones into one folder a table; these batches are then final.

        Messages and keys stay as they are, statistics add up, partials of transcripts in pieces merge and of whole
        transcripts the last stays, of a session's versions the first and the last stay, and parsed lines go. All tables
        switch in one step, so an interrupted run changes nothing. Returns the last final batch of each writer.
        """
        live = [m.groups() for f in self.manifest.read().folders if (m := _FOLDER.fullmatch(f))]
        final = {}
        for writer in {w for _, w, _ in live}:
            numbers = sorted({int(b) for _, w, b in live if w == writer})
            if len(numbers) > keep_newest:
                final[writer] = numbers[: len(numbers) - keep_newest][-1]
        old, new = [], []
        for writer, last in sorted(final.items()):
            other = Store(self.spark, self.root, writer)
            for table in TABLES:
                folders = [f for f, w, b in self._live(table) if w == writer and b <= last]
                old += folders
                if folders and table != "lines":
                    merged = self._merged(table, self._scan(table, folders))
                    new.append(other.stage(table, merged, last, ("session_id",) if "session_id" in merged.columns else ()))
        if old:
            self._replace(old, new, final)
        return final

    def _merged(self, table: str, rows: DataFrame) -> DataFrame:
        if table in STATS.values():
            return rows.groupBy("project_slug").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")).coalesce(1)
        if table == "partials":
            pieces, whole = rows.filter("in_pieces"), rows.filter("not in_pieces")
            said = [c for c in rows.columns if c not in ("project_slug", "transcript", "batch_id", "writer")]
            last = whole.groupBy("project_slug", "transcript").agg(F.max_by(F.struct(*said), "batch_id").alias("r"))
            merged = merge_partials(pieces).withColumn("in_pieces", F.lit(True))
            return merged.unionByName(last.select("project_slug", "transcript", "r.*"))
        if table in ("sessions", "team_sessions"):
            key = ["session_id"] if table == "team_sessions" else ["project_slug", "session_id"]
            order, row = F.struct("seq", "last_synced_at"), F.struct(*rows.columns)
            ends = rows.groupBy(*key).agg(
                F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"), (F.min(order) == F.max(order)).alias("one")
            )
            return ends.select(F.inline(F.when(F.col("one"), F.array("first")).otherwise(F.array("first", "last"))))
        return rows

    def vacuum(self) -> int:
        """Delete the folders that do not count, of any table. Not while others read or write. Returns how many."""
        live = set(self.manifest.read().folders)
        unused = []
        for folder in self._glob("*/writer=*/batch_id=*/gen=*"):
            table, writer, batch, gen = folder.toString().split("/")[-4:]
            if f"{table}/{writer}/{batch}/{gen}" not in live:
                unused.append(folder)
        for folder in unused:
            self.manifest.files().delete(folder, True)
        return len(unused)


def json_rows(frame: DataFrame) -> DataFrame:
    """Each row as one JSON text, absent values kept as null."""
    return frame.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def emit_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
