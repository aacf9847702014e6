"""Tables of parts whose versions are manifests.

A commit writes the files of the parts that differ to a folder of its own, then a manifest that
names for every part the folder that holds it, and last a marker of the next version, created only if nobody
else has. Nothing is renamed, replaced or moved, and the driver never goes through the parts, so this works on
object stores. A reader goes through the last marker: it sees the old table or the new one.

A manifest keeps each part's row count and digest, a marker the digest of the whole table.
Comparisons go down a level only where digests differ: tables by their markers, then parts by
their manifests, then the rows of the parts that differ.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelens.functions.hashing import WHOLE
from quirelens.operators.diff import fingerprint, snapshot_diff
from quirelens.plans.frames import null_safe_join
from quirelens.plans.lineage import cut, release
from quirelens.sources.sinks import IncompleteOutput, TargetMoved, TooManyParts, part_states, row_hash

_ENTRY = ("slot", "write", "n_rows", "fingerprint")


class PartStore:
    """The versions of one table below ``path``, cut into parts by the column ``part``.

    A null part and an empty one are parts of their own. Values keep their types: the files hold the
    part's column, folders are named by its hash.
    """

    MARKER = ".json"
    # A marker without its content belongs to a commit that is under way, or was broken off so long ago.
    BROKEN_AFTER = 600.0

    def __init__(self, spark: SparkSession, path: str, part: str = "part"):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(path).getFileSystem(self._conf)

    # ---- versions ----

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._hadoop.Path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(self.path))]
        stems = [n.removesuffix(self.MARKER) for n in names if n.endswith(self.MARKER)]
        return sorted(int(n[1:]) for n in stems if n.startswith("v") and n[1:].isdigit())

    def _marker(self, number: int) -> dict | None:
        """What a version's marker says; None while it says nothing whole."""
        stream = self._fs.open(self._file(f"v{number}{self.MARKER}"))
        try:
            content = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(content) | {"version": number}
        except ValueError:
            return None

    def versions(self) -> list[int]:
        """The versions that can be read, in order."""
        return [n for n in self._numbers() if self._marker(n) is not None]

    def head(self, version: int | None = None) -> dict | None:
        """The marker of ``version``, or of the last version; None before the first commit."""
        if version is not None:
            if version not in self._numbers() or (found := self._marker(version)) is None:
                raise ValueError(f"{self.path} has no version {version}")
            return found
        return next((found for n in reversed(self._numbers()) if (found := self._marker(n)) is not None), None)

    # ---- reading ----

    def _manifest(self, head: dict) -> DataFrame:
        kind = T.StructType.fromJson(head["schema"])[self.part].dataType.simpleString()
        entries = f"part {kind}, slot string, write string, n_rows bigint, fingerprint string"
        return self.spark.read.schema(entries).parquet(f"{self.path}/manifests/{head['manifest']}")

    def manifest(self, version: int | None = None) -> DataFrame:
        """part, n_rows and fingerprint of every part."""
        return self._manifest(self._known(version)).select(F.col("part").alias(self.part), "n_rows", "fingerprint")

    def _known(self, version: int | None) -> dict:
        found = self.head(version)
        if found is None:
            raise ValueError(f"{self.path} has no version")
        return found

    def read(self, version: int | None = None, parts: DataFrame | None = None) -> DataFrame:
        """The rows of a version; with ``parts``, of those parts, and no other file is opened.

        The frame stays with the version it was made of until ``vacuum`` gives that one up.
        """
        return self._rows(self._known(version), parts)

    def _rows(self, head: dict, parts: DataFrame | None = None) -> DataFrame:
        schema, write, slot = T.StructType.fromJson(head["schema"]), head["write"], head["slot"]
        live = self._manifest(head)
        if parts is not None:
            live = null_safe_join(live, parts.select(F.col(self.part).alias("part")).distinct(), ["part"], "left_semi")
        # As many names as commits have parts that are still read.
        writes = [r[0] for r in live.select("write").distinct().collect()]
        if not writes:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/data"
        whole = T.StructType([*schema.fields, T.StructField(write, T.StringType()), T.StructField(slot, T.StringType())])
        scan = self.spark.read.schema(whole).option("basePath", base).parquet(*[f"{base}/{write}={w}" for w in writes])
        # Folders of parts that have been replaced, or are not asked for, are pruned when the manifest is known.
        kept = live.filter("n_rows > 0").select(F.col("write").alias(write), F.col("slot").alias(slot))
        return scan.join(kept, [write, slot], "left_semi").select(*schema.names)

    # ---- writing ----

    def slot_of(self, column: Column) -> Column:
        return F.md5(F.to_json(F.struct(column.alias("part")), WHOLE))

    def commit(
        self, new: DataFrame, baseline: DataFrame | None = None, limit: int | None = None, removed: bool = False, stage: bool = True,
    ) -> DataFrame:
        """Make ``new`` the next version, writing only the parts whose content differs. Returns part and status.

        Stored rows are not read: the manifest knows their digests. Every check runs before the first write. ``baseline``
        (part, fingerprint) is what the work began from, parts that ``new`` lacks are refused unless ``removed``, and so are
        more parts than ``limit``. ``new`` is staged first, so that what is written is what was compared, unless it
        is a stored table (``stage=False``). If all parts are equal there is no new version. Of two commits at
        once one wins and the other raises TargetMoved; whatever a commit leaves behind, no reader sees it.
        """
        at = self._numbers()
        head = self.head()
        if at and (head is None or head["version"] != at[-1]):
            age = time.time() - self._fs.getFileStatus(self._file(f"v{at[-1]}{self.MARKER}")).getModificationTime() / 1000
            if age < self.BROKEN_AFTER:
                raise TargetMoved(f"version {at[-1]} is being committed")
        if head is not None and new.schema != T.StructType.fromJson(head["schema"]):
            head_names = T.StructType.fromJson(head["schema"]).simpleString()
            if new.schema.simpleString() != head_names:
                raise ValueError(f"the table holds {head_names}")
        staged = cut(new) if stage else new
        try:
            return self._commit(staged, head, at[-1] + 1 if at else 1, baseline, limit, removed)
        finally:
            if stage:
                release(staged)

    def _commit(self, new, head, number, baseline, limit, removed) -> DataFrame:
        states = part_states(new, self.part).withColumnRenamed(self.part, "part")
        if head is None:
            old = self.spark.createDataFrame([], T.StructType([T.StructField("part", new.schema[self.part].dataType), *[
                T.StructField(c, T.LongType() if c == "n_rows" else T.StringType()) for c in _ENTRY]]))
        else:
            old = self._manifest(head)
        # One row per part: the state it will have, where it lies now, and what happens to it.
        fresh = states.select("part", F.col("n_rows").alias("_rows"), F.col("fingerprint").alias("_new"))
        plan = null_safe_join(old, fresh, ["part"], "full_outer").withColumn("status", (
            F.when(F.col("fingerprint").isNull(), "added").when(F.col("_new").isNull(), "removed")
            .when(F.col("fingerprint") == F.col("_new"), "equal").otherwise("changed")))
        plan = cut(plan)
        if baseline is not None:
            held = plan.filter("status <> 'added'").select(F.col("part").alias(self.part), "fingerprint")
            if not snapshot_diff(baseline, held, [self.part], "fingerprint").filter("status <> 'equal'").isEmpty():
                raise TargetMoved(self.path)
        if not removed and not plan.filter("status = 'removed'").isEmpty():
            raise IncompleteOutput(self.path)
        if limit is not None and (n_parts := plan.filter("status <> 'removed'").count()) > limit:
            raise TooManyParts(f"{n_parts} parts, limit {limit}")
        out = plan.select(F.col("part").alias(self.part), "status")
        if head is not None and plan.filter("status <> 'equal'").isEmpty():
            return out
        write = uuid.uuid4().hex
        names = {"write": head["write"], "slot": head["slot"]} if head else {k: _fresh(new, f"_{k}") for k in ("write", "slot")}
        self._write_data(new, plan, write, names)
        manifest = self._write_manifest(plan, write)
        entries = self.spark.read.parquet(f"{self.path}/manifests/{manifest}")
        # The manifest as written, so that the marker's digest is of what readers will find.
        table = fingerprint(entries.select(F.sha2(F.concat_ws(":", "slot", "fingerprint"), 256).alias("_h")), [], "_h").first()
        self._mark(number, {
            "manifest": manifest, "schema": json.loads(new.schema.json()), "part": self.part, **names,
            "digest": table["fingerprint"] if table else None, "n_parts": table["n_rows"] if table else 0,
        })
        return out

    def _write_data(self, new: DataFrame, plan: DataFrame, write: str, names: dict) -> None:
        todo = plan.filter("status in ('added', 'changed')").select(F.col("part").alias(self.part))
        rows = null_safe_join(new, todo, [self.part], "left_semi").withColumn(names["slot"], self.slot_of(F.col(self.part)))
        # The adaptive rebalance gives a part of any size as many files as its bytes ask for.
        rows = rows.hint("rebalance", F.col(names["slot"]))
        rows.write.partitionBy(names["slot"]).parquet(f"{self.path}/data/{names['write']}={write}")

    def _write_manifest(self, plan: DataFrame, write: str) -> str:
        moved = F.col("status") != "equal"
        entries = plan.filter("status <> 'removed'").select(
            "part", F.when(moved, self.slot_of(F.col("part"))).otherwise(F.col("slot")).alias("slot"),
            F.when(moved, F.lit(write)).otherwise(F.col("write")).alias("write"),
            F.col("_rows").alias("n_rows"), F.col("_new").alias("fingerprint"))
        name = uuid.uuid4().hex
        entries.write.parquet(f"{self.path}/manifests/{name}")
        return name

    def _mark(self, number: int, content: dict) -> None:
        """Create the marker, which fails if the number is taken. Until its content is whole, readers pass it over."""
        try:
            stream = self._fs.create(self._file(f"v{number}{self.MARKER}"), False)
        except Py4JJavaError as error:
            raise TargetMoved(f"version {number} appeared during the commit") from error
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    # ---- comparing ----

    def same(self, a: int, b: int | None = None) -> bool:
        """Whether two versions hold the same rows in every part: two markers tell."""
        return self._known(a)["digest"] == self._known(b)["digest"]

    def part_changes(self, a: int, b: int | None = None) -> DataFrame:
        """Parts that differ between two versions, with status. Reads manifests, and those only if the markers differ."""
        if self.same(a, b):
            return snapshot_diff(self.manifest(a).limit(0), self.manifest(b).limit(0), [self.part], "fingerprint").select(self.part, "status")
        diff = snapshot_diff(self.manifest(a), self.manifest(b), [self.part], "fingerprint")
        return diff.filter("status <> 'equal'").select(self.part, "status")

    def row_changes(self, key: Sequence[str], a: int, b: int | None = None) -> DataFrame:
        """key, part and status of the rows that were added, removed or changed; ``key`` is unique in a part.

        Only the files of parts that differ are opened, on either side.
        """
        key = [self.part, *[k for k in key if k != self.part]]
        differ = cut(self.part_changes(a, b).select(self.part))
        sides = [rows.select(*key, row_hash(rows).alias("_h")) for rows in (self.read(a, differ), self.read(b, differ))]
        return snapshot_diff(*sides, key, "_h").filter("status <> 'equal'").select(*key, "status")

    def verify(self, version: int | None = None, parts: DataFrame | None = None) -> DataFrame:
        """Parts whose stored rows are not what the manifest says: missing or altered."""
        head = self._known(version)
        said = self._manifest(head).select(F.col("part").alias(self.part), "fingerprint")
        if parts is not None:
            said = null_safe_join(said, parts.select(self.part).distinct(), [self.part], "left_semi")
        diff = snapshot_diff(said, part_states(self._rows(head, parts), self.part), [self.part], "fingerprint")
        status = F.when(F.col("status") == "removed", "missing").otherwise("altered")
        return diff.filter("status <> 'equal'").select(self.part, status.alias("status"))

    # ---- giving up old versions ----

    def vacuum(self, keep: int = 2) -> int:
        """Give up all but the last ``keep`` versions and what no kept one needs; returns how many folders went.

        Folders younger than ``BROKEN_AFTER`` that no version names may belong to a commit under way and stay.
        """
        if keep < 1:
            raise ValueError("the last version stays")
        versions = self.versions()
        for number in versions[:-keep]:
            self._fs.delete(self._file(f"v{number}{self.MARKER}"), False)
        kept = [self._known(n) for n in versions[-keep:]]
        if not kept:
            return 0
        used = {h["manifest"] for h in kept}
        for h in kept:
            used |= {f"{h['write']}={r[0]}" for r in self._manifest(h).select("write").distinct().collect()}
        gone = 0
        for folder in ("data", "manifests"):
            for status in self._fs.listStatus(self._file(folder)):
                young = time.time() - status.getModificationTime() / 1000 < self.BROKEN_AFTER
                if status.getPath().getName() not in used and not young:
                    self._fs.delete(status.getPath(), True)
                    gone += 1
        return gone


def _fresh(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
