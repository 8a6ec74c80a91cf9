"""A versioned Parquet store: immutable folders, and a small pointer file that says which of them make up each table.

A table is a list of parts. A part has rows that are added, or rows that take the place of those with the same key in the
parts before it. So an insert writes its own rows, and an update those that change; after ``MOST_PARTS`` parts a commit
writes the table anew. A commit writes its parts, checks what was asked for on the tables as they would be, and then
publishes the next pointer: it is written aside and moved to its number, without overwriting. A reader that holds a pointer
sees one version; what fails before that is deleted and was never visible; of two writers from one version one fails. The
move is atomic where the file system's rename is (HDFS, local files), not on plain object stores.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import discard

MOST_PARTS = 32
TABLES = {
    "concept": "concept_id string, type string, title string, body string, file_hash string, retired_at timestamp_ntz, concept_type string, description string, resource_uri string, tags array<string>, program string, engine string, scopes array<string>, metadata_json string, stix_id string, ioc_type string, ioc_value string, attack_id string, platform array<string>, kill_chain_phase array<string>, stix_pattern string, valid_until timestamp_ntz, revoked boolean",
    "bundle": "bundle_name string, bundle_path string, title string, description string",
    "containment": "bundle_name string, concept_id string",
    "hierarchy": "parent_id string, child_id string",
    "concept_link": "source_id string, target_id string, link_text string",
    "citation": "source_id string, target_url string, link_text string",
    "agent": "agent_id string",
    "doc_run": "run_id string, actor string, started_at timestamp_ntz",
    "belief": "belief_id string, title string, belief_state string, confidence double, entrenchment string, valid_from timestamp_ntz, valid_to timestamp_ntz, salience double, base_activation double, last_access timestamp_ntz, retrieval_provenance string",
    "episode": "episode_id string, type string, title string, event_time timestamp_ntz, ingest_time timestamp_ntz, consolidation_state string, method string, candidate_count bigint",
    "anomaly": "anomaly_id string, condition string",
    "ownership": "owned string, owner string, visibility string",
    "source_link": "sourced string, run_id string, origin_kind string",
    "derivation": "rel_id string, derived string, source string, derivation_method string",
    "supersession": "superseded string, superseding string, reason string, created_at timestamp_ntz",
    "contradiction_claim": "rel_id string, claim string",
    "rests_on": "resting string, assumption string",
    "prediction": "belief_id string, p double, outcome string, episode_id string",
    "surfaced": "run_id string, retrieval string, concept_id string, similarity double, was_used boolean",
    "informs_synthesis": "retrieval string, synthesized string",
    "typed_edge": "source string, target string, relation string",
    "population": "spec_hash string, spec_dialect string, spec_text string",
    "population_member": "spec_hash string, member string, valid_from timestamp_ntz, valid_to timestamp_ntz, computed_at timestamp_ntz",
    "consolidation_step": "run_id string, episode_id string, action string",
    "belief_edge": "relation string, belief_id string, players map<string,string>, attributes map<string,string>",
}


class Conflict(RuntimeError):
    """Somebody else committed first."""


class Snapshot(Mapping):
    """The tables of one version, each read when it is asked for."""

    def __init__(self, store: Store, parts: dict[str, list[dict]]):
        self.store, self.parts, self.held = store, parts, {}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.held:
            self.held[table] = self.store._fold(table, self.parts.get(table, []))
        return self.held[table]

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


class Pointers:
    """Numbered small files in a folder; the highest number is the latest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def latest(self) -> int:
        folder = self._path(self.path)
        if not self._fs.exists(folder):
            return 0
        return max((int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()), default=0)

    def read(self, version: int) -> dict:
        if not version:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/{version}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: int, held: dict) -> None:
        aside, to = f"{self.path}/.{uuid.uuid4().hex}", f"{self.path}/{version}"
        out = self._fs.create(self._path(aside), False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # its rename overwrites; a link doesn't
                os.link(*(unquote(urlparse(x).path) if x.startswith("file:") else x for x in (aside, to)))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                context.rename(self._path(aside), self._path(to), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            raise Conflict(str(e)) from e
        finally:
            self._fs.delete(self._path(aside), False)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointers = Pointers(spark, f"{self.path}/versions")

    def version(self) -> int:
        return self.pointers.latest()

    def _pointer(self, version: int) -> dict[str, list[dict]]:
        return self.pointers.read(version)

    def _fold(self, table: str, parts: list[dict]) -> DataFrame:
        schema = T._parse_datatype_string(TABLES[table])
        out, waiting = None, []

        def added(out: DataFrame | None) -> DataFrame | None:
            if not waiting:
                return out
            new = self.spark.read.schema(schema).parquet(*waiting)
            waiting.clear()
            return new if out is None else out.unionByName(new)

        for part in parts:
            where = f"{self.path}/{part['at']}"
            if part["key"]:
                new = self.spark.read.schema(schema).parquet(where)
                before = added(out)
                out = new if before is None else before.join(new.select(part["key"]).distinct(), part["key"], "left_anti").select(schema.names).unionByName(new)
            else:
                waiting.append(where)
        out = added(out)
        return self.spark.createDataFrame([], schema) if out is None else out

    def snapshot(self) -> tuple[int, Snapshot]:
        version = self.version()
        return version, Snapshot(self, self._pointer(version))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._fold(table, self._pointer(self.version() if version is None else version).get(table, []))

    def _write(self, table: str, df: DataFrame, key: list[str]) -> dict:
        at = f"data/{table}/{uuid.uuid4().hex}"
        wanted = T._parse_datatype_string(TABLES[table])
        df.select(*(df[f.name].cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted)).write.parquet(f"{self.path}/{at}")
        return {"at": at, "key": key}

    def commit(
        self,
        changes: dict[str, DataFrame],
        base: int,
        expected: dict[str, int] | None = None,
        check: Callable[[Snapshot], None] | None = None,
        adds: dict[str, DataFrame] | None = None,
        patches: dict[str, tuple[DataFrame, list[str]]] | None = None,
    ) -> int:
        """Publish on top of version base, all of it or none: ``changes`` are whole tables, ``adds`` further rows, ``patches``
        rows in place of those with the same key. ``expected``: rows that tables must have then; ``check`` sees the tables as
        they would be, and may raise."""
        parts, written = {t: list(p) for t, p in self._pointer(base).items()}, []

        def put(table: str, df: DataFrame, key: list[str] = ()) -> dict:  # noqa: B006
            written.append(self._write(table, df, [*key]))
            return written[-1]

        try:
            for table, df in changes.items():
                parts[table] = [put(table, df)]
            for table, (df, key) in (patches or {}).items():
                parts.setdefault(table, []).append(put(table, df, key))
            for table, df in (adds or {}).items():
                parts.setdefault(table, []).append(put(table, df))
            for table in {*(adds or {}), *(patches or {})}:
                if len(parts[table]) > MOST_PARTS:
                    parts[table] = [put(table, self._fold(table, parts[table]))]
            after = Snapshot(self, parts)
            for table, n in (expected or {}).items():
                if (found := after[table].count()) != n:
                    raise ValueError(f"{table} would have {found} rows; {n} were expected")
            if check:
                check(after)
            if self.version() != base:
                raise Conflict(f"version {base} isn't the latest any more")
            self.pointers.publish(base + 1, parts)
        except Exception:
            for part in written:
                discard(self.spark, f"{self.path}/{part['at']}")
            raise
        return base + 1
