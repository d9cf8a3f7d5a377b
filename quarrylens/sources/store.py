"""A collection kept as Parquet under a root folder: whole-row saves, deletes, unique keys.

A save writes only what it brings.  A collection is a list of parts; each part is a folder with

    rows/      the rows, in folders and sorted for lookups
    side-*/    a row for each element of the arrays that lookups search in
    keys/      the key index: (key, digest, id) of the id and of every unique key, in ranges
    removed/   the ids whose rows in earlier parts no longer count

and a manifest lists the parts that count.  A manifest is written beside and renamed to its number,
which fails if there is one: the rename is the commit.  What a writer that died has left behind is
in no manifest and stands in nobody's way; a writer that started from an older manifest is told so
(Conflict), and so is one that raced another.  Readers never see half a save.

A save that brings few rows reads only the ranges of the key index that can hold their keys, and
no rows at all.  When there are many parts, or much is removed, a save merges them (``compact``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.codecs import empty_lists, with_document_defaults, with_id, with_source_defaults
from ..operators.steps import delete_folder
from ..schemas import ARTICLE, RAW_DOCUMENT, SOURCE

#: Unique keys of each collection; the first writer keeps the key.
UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "articles": (("raw_document_id",),),
    "raw_documents": (("source_id", "original_uri"), ("source_id", "content_hash")),
    "sources": (("name",),),
}
SCHEMAS: dict[str, StructType] = {"articles": ARTICLE, "raw_documents": RAW_DOCUMENT, "sources": SOURCE}
#: What a save fills in where nothing is given.
DEFAULTS: dict[str, Callable[[DataFrame], DataFrame]] = {"raw_documents": with_document_defaults, "sources": with_source_defaults}
#: Layout for lookups: folders by a column (named apart, so that nested fields work and the rows
#: keep their columns), rows sorted inside files, so that Parquet's minima and maxima skip row groups.
FOLDERS: dict[str, tuple[str, str]] = {"raw_documents": ("by_mime_type", "mime_type"), "articles": ("by_domain", "taxonomy.domain"), "sources": ("by_status", "status")}
SORTED_BY: dict[str, tuple[str, ...]] = {
    "raw_documents": ("acquisition_time DESC", "content_timestamp DESC"),
    "articles": ("taxonomy.sub_domain", "taxonomy.event_type", "metadata.publication_date DESC"),
    "sources": ("priority", "type", "endpoint"),
}
#: Side tables of arrays that lookups search in: a row for each element, sorted by what is searched.
SIDES: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    "articles": {"entities": ("entities", ("normalized_name", "type")), "events": ("events", ("type", "date"))},
    "sources": {"tags": ("tags", ("value",))},
}
#: Of several rows with one id in a save, the last in this order counts; ties by the whole row's hash.
LATEST: dict[str, tuple[str, ...]] = {
    "raw_documents": ("acquisition_time", "content_timestamp"),
    "articles": ("provenance.extraction_time", "metadata.publication_date"),
    "sources": ("last_execution", "last_successful_run"),
}
FEW_KEYS = 1000  # keys of a save up to which the index is pruned by their digests
KEYS_IN_FILE = 1_000_000
MOST_PARTS = 16


class Conflict(RuntimeError):
    """Another writer committed since this one read the collection."""


class DuplicateKey(ValueError):
    """A save would break a unique key."""


class Collection:
    def __init__(
        self, spark: SparkSession, root: str, name: str, schema: StructType | None = None, unique: Sequence[Sequence[str]] | None = None,
        most_parts: int = MOST_PARTS, keys_in_file: int = KEYS_IN_FILE,
    ):
        self.spark, self.name, self.folder = spark, name, f"{root.rstrip('/')}/{name}"
        self.schema = schema or SCHEMAS[name]
        self.unique = UNIQUE.get(name, ()) if unique is None else unique
        self.most_parts, self.keys_in_file = most_parts, keys_in_file

    # --- manifests ---

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the commits that are still listed."""
        log = self._path(f"{self.folder}/log")
        if not self._fs().exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one) consists of; version 0 is the empty collection."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "parts": [], "batches": {}}
        stream = self._fs().open(self._path(f"{self.folder}/log/{version:012}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, seen: dict, parts: list[dict], batches: dict | None = None) -> dict:
        """Makes ``parts`` the version after ``seen``, or raises Conflict if there is one."""
        version = seen["version"] + 1
        now = {"version": version, "parts": parts, "batches": {**seen["batches"], **(batches or {})}}
        beside = self._path(f"{self.folder}/log/_{uuid.uuid4().hex}")
        out = self._fs().create(beside, False)
        try:
            out.write(json.dumps(now).encode())
        finally:
            out.close()
        jvm, whole = self.spark._jvm, self._fs().makeQualified
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole(beside).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(whole(beside), whole(self._path(f"{self.folder}/log/{version:012}.json")), none)
        except Exception as e:  # a Java exception, by name
            files.delete(whole(beside), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.name}: version {version} is there") from None
            raise
        return now

    # --- reading ---

    def _live(self, kind: str, manifest: dict, key: str, schema: StructType | None = None, keep: Column | None = None) -> DataFrame | None:
        """What parts have of ``kind``, without what later parts remove."""
        found = []
        for at, part in enumerate(manifest["parts"]):
            if kind not in part["has"]:
                continue
            rows = (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.folder}/{part['folder']}/{kind}")
            rows = rows if keep is None else rows.filter(keep)
            rows = rows.select(*self.schema.names) if kind == "rows" else rows
            later = [p for p in manifest["parts"][at + 1 :] if "removed" in p["has"]]
            if later:
                gone = self.spark.read.schema("id string").parquet(*[f"{self.folder}/{p['folder']}/removed" for p in later])
                rows = rows.join(gone.select(F.col("id").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")
            found.append(rows)
        return reduce(DataFrame.unionByName, found) if found else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last if none is given; empty if there is none."""
        rows = self._live("rows", self.manifest(version), "id", self.schema)
        return self.spark.createDataFrame([], self.schema) if rows is None else rows

    def side(self, name: str) -> DataFrame:
        """own_id and the fields of every element of an array (entities, events or tags), sorted."""
        rows = self._live(f"side-{name}", self.manifest(), "own_id")
        if rows is None:
            raise ValueError(f"{self.name} has no rows yet")
        return rows

    def in_folder(self, value: str) -> DataFrame:
        """The rows of one folder of the layout (a MIME type, a domain, a status); others aren't read."""
        folder, _ = FOLDERS[self.name]
        rows = self._live("rows", self.manifest(), "id", StructType([*self.schema.fields, StructField(folder, StringType())]), F.col(folder) == value)
        return self.spark.createDataFrame([], self.schema) if rows is None else rows

    # --- writing ---

    def _keys(self, rows: DataFrame) -> DataFrame:
        """key (0 the id, then the unique keys), digest and id; a null in a key exempts from it."""
        digest = lambda names: F.md5(F.to_json(F.array(*[F.col(c).cast("string") for c in names])))
        every = [("id",), *self.unique]
        keys = F.array(*[F.struct(F.lit(k).alias("key"), F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in names]), digest(names)).alias("digest")) for k, names in enumerate(every)])
        return rows.select("id", F.explode(keys).alias("k")).filter("k.digest IS NOT NULL").select("k.key", "k.digest", "id")

    def _write_part(self, rows: DataFrame | None, removed: DataFrame | None) -> dict:
        part = {"folder": f"part-{uuid.uuid4().hex}", "has": [], "rows": 0, "keys": []}
        root = f"{self.folder}/{part['folder']}"
        if rows is not None:
            counted = Observation()
            rows = rows.select(*self.schema.names).observe(counted, F.count(F.lit(1)).alias("n"))
            if self.name in FOLDERS:
                folder, column = FOLDERS[self.name]
                order = [F.expr(c.removesuffix(" DESC")).desc() if c.endswith(" DESC") else F.expr(c) for c in SORTED_BY[self.name]]
                rows.withColumn(folder, F.col(column)).sortWithinPartitions(F.col(folder), *order).write.partitionBy(folder).parquet(f"{root}/rows")
            else:
                rows.write.parquet(f"{root}/rows")
            rows = self.spark.read.schema(self.schema).parquet(f"{root}/rows")  # as written, whatever they come from
            part["rows"] = counted.get["n"]
            for name, (column, order) in SIDES.get(self.name, {}).items():
                flat = rows.select(F.col("id").alias("own_id"), F.explode(column).alias("value"))
                if isinstance(flat.schema["value"].dataType, StructType):
                    flat = flat.select("own_id", "value.*")
                flat.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{root}/side-{name}")
                part["has"].append(f"side-{name}")
            files = max(1, part["rows"] * (1 + len(self.unique)) // self.keys_in_file)
            keys, span = self._keys(rows), Observation()
            at = F.struct("key", "digest")
            limits = [F.min(at).alias("low"), F.max(at).alias("high")]
            if files == 1:
                keys.coalesce(1).sortWithinPartitions("key", "digest").observe(span, *limits).write.parquet(f"{root}/keys")
                found = [("", span.get)] if part["rows"] else []
            else:
                keys.repartitionByRange(files, "key", "digest").sortWithinPartitions("key", "digest").write.parquet(f"{root}/keys")
                index = self.spark.read.parquet(f"{root}/keys").groupBy(F.col("_metadata.file_name").alias("file")).agg(*limits)
                found = [(r["file"], r) for r in index.collect()]
            part["keys"] = [[name, list(x["low"]), list(x["high"])] for name, x in found]  # no name: the whole folder
            part["has"] += ["rows", "keys"]
        if removed is not None:
            removed.select("id").write.parquet(f"{root}/removed")
            part["has"].append("removed")
        return part

    def _known(self, manifest: dict, keys: DataFrame) -> tuple[DataFrame | None, list[str]]:
        """(key, digest, id) that the collection holds for any of ``keys``, and the index files read.

        For few keys only files whose range can hold one of them are read.
        """
        asked = keys.select("key", "digest").distinct().limit(FEW_KEYS + 1).collect()
        some = sorted((r["key"], r["digest"]) for r in asked) if len(asked) <= FEW_KEYS else None
        found, files = [], []
        for at, part in enumerate(manifest["parts"]):
            names = [n for n, low, high in part["keys"] if some is None or any(tuple(low) <= k <= tuple(high) for k in some)]
            if not names:
                continue
            files += [f"{self.folder}/{part['folder']}/keys/{n}" for n in names]
            rows = self.spark.read.schema("key int, digest string, id string").parquet(*files[-len(names) :])
            if some is not None:
                rows = rows.filter(F.col("digest").isin([d for _, d in some]))
            rows = rows.join(keys.select("key", "digest").distinct(), ["key", "digest"], "left_semi")
            later = [p for p in manifest["parts"][at + 1 :] if "removed" in p["has"]]
            if later:
                gone = self.spark.read.schema("id string").parquet(*[f"{self.folder}/{p['folder']}/removed" for p in later])
                rows = rows.join(gone, "id", "left_anti")
            found.append(rows)
        return (reduce(DataFrame.unionByName, found) if found else None), files

    def not_held(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id and the unique keys) of which the collection has neither id nor unique keys."""
        keys = self._keys(rows)
        held, _ = self._known(self.manifest(), keys)
        return rows if held is None else rows.join(keys.join(held.select("key", "digest"), ["key", "digest"]).select("id"), "id", "left_anti")

    def _check(self, manifest: dict, keys: DataFrame, gone: DataFrame | None = None) -> None:
        """Raises if a unique key would be held by two ids; ``gone``: ids that leave with this save."""
        if not self.unique:
            return
        mine = keys.filter("key > 0")
        held, _ = self._known(manifest, mine)
        own = keys.filter("key = 0").select("id")
        if held is not None:
            held = held.join(own if gone is None else own.unionByName(gone), "id", "left_anti")
            mine = mine.unionByName(held)
        twice = mine.groupBy("key", "digest").agg(F.min("id").alias("one"), F.max("id").alias("other")).filter("one <> other").limit(1).collect()
        if twice:
            raise DuplicateKey(f"{self.name}: {', '.join(self.unique[twice[0]['key'] - 1])}")

    def _one_per_id(self, rows: DataFrame, latest: Sequence[str]) -> DataFrame:
        order = F.struct(*[F.expr(c).alias(f"k{k}") for k, c in enumerate(latest)], F.md5(F.to_json(F.struct(*rows.columns))).alias("tie"))
        return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")

    def _add(self, rows: DataFrame, seen: dict, batches: dict, gone: DataFrame | None = None) -> DataFrame:
        """Writes ``rows`` as a part after ``seen`` and commits; returns them as written."""
        part = self._write_part(rows, None)
        root = f"{self.folder}/{part['folder']}"
        stored = self.spark.read.schema(self.schema).parquet(f"{root}/rows")
        try:
            keys = self.spark.read.schema("key int, digest string, id string").parquet(f"{root}/keys")
            self._check(seen, keys, gone)
            if seen["parts"]:
                old = stored.select("id") if gone is None else stored.select("id").unionByName(gone)
                old.distinct().write.parquet(f"{root}/removed")
                part["has"].append("removed")
            now = self._commit(seen, [*seen["parts"], part], batches)
        except (DuplicateKey, Conflict, PySparkException):
            delete_folder(self.spark, root)
            raise
        if len(now["parts"]) > self.most_parts:
            try:
                self.compact()
            except Conflict:  # the other writer's save matters more
                pass
        return stored

    def save(self, rows: DataFrame, latest: Sequence[str] | None = None, batch: tuple[str, int] | None = None, seen: dict | None = None) -> DataFrame:
        """Upserts whole rows by id and returns them as saved.

        Null ids are generated, null lists become empty, and a collection's own defaults are filled
        in (acquisition time of documents, status and priority of sources).  Of several rows with
        one id the last by ``latest`` counts (LATEST, if not given).  Raises DuplicateKey if a unique
        key would be held by two rows (null keys are exempt), and Conflict if another writer has
        committed after ``seen`` (a manifest; the last, if not given).

        batch: (stream, number) of the rows; a number up to the stream's last saved one is skipped,
        so that a stream's batch that is run twice counts once.
        """
        seen = seen or self.manifest()
        if batch and batch[1] <= seen["batches"].get(batch[0], -1):
            return self.spark.createDataFrame([], self.schema)
        rows = with_id(empty_lists(rows.select(*self.schema.names)))
        rows = DEFAULTS.get(self.name, lambda x: x)(rows)
        rows = self._one_per_id(rows, LATEST.get(self.name, ()) if latest is None else latest)
        return self._add(rows, seen, dict([batch]) if batch else {})

    def holds(self, id: str, manifest: dict | None = None) -> bool:
        """Whether there is a row with that id; reads the index only."""
        asked = self.spark.range(1).select(F.lit(id).alias("id"), *[F.lit(None).cast("string").alias(c) for c in {c for k in self.unique for c in k} - {"id"}])
        held, _ = self._known(manifest or self.manifest(), self._keys(asked).filter("key = 0"))
        return held is not None and not held.isEmpty()

    def delete(self, id: str) -> bool:
        """Whether a row was removed."""
        seen = self.manifest()
        if id is None or not self.holds(id, seen):
            return False
        part = self._write_part(None, self.spark.range(1).select(F.lit(id).alias("id")))
        self._commit(seen, [*seen["parts"], part])
        return True

    def replace_children(self, rows: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
        """Delete-then-insert of all rows of the parents that ``rows`` brings (and of ``parents``, which may
        have none left); running twice is the same.  Returns the rows as saved."""
        seen = self.manifest()
        rows = rows.select(*self.schema.names)
        now = self._live("rows", seen, "id", self.schema)
        gone = None if now is None else now.join((rows if parents is None else parents).select(parent).distinct(), parent, "left_semi").select("id")
        return self._add(rows, seen, {}, gone)

    def compact(self) -> None:
        """Merges all parts into one, without what was removed."""
        seen = self.manifest()
        if len(seen["parts"]) > 1:
            self._commit(seen, [self._write_part(self.read(seen["version"]), None)])

    def vacuum(self, keep: int = 1) -> int:
        """Removes parts that none of the last ``keep`` versions has, and older manifests.

        Not to be run beside writers: what they have written but not committed would go.
        Returns the number of folders removed.
        """
        versions = self.versions()
        kept = versions[-keep:] if keep else []
        used = {p["folder"] for v in kept for p in self.manifest(v)["parts"]}
        for v in versions[: len(versions) - len(kept)]:
            self._fs().delete(self._path(f"{self.folder}/log/{v:012}.json"), False)
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(self.folder))]
        gone = [n for n in names if n.startswith("part-") and n not in used]
        for n in gone:
            delete_folder(self.spark, f"{self.folder}/{n}")
        return len(gone)
