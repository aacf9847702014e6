"""Stored generations of the trigram index, from building to removed.

A state is entered by creating its file, which fails if somebody else has: that is the compare and set. A
generation goes through building, ready, retired and removed, each once. Searches use the newest
ready one and write nothing. Readers that hold a generation longer than one query take a lease, and
what is leased is not removed.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.operators.fulltext import (
    GRAM, STATES, bucket_digests, bucket_of, bucket_place, direct_scan, gram_lists, query_grams, trigram_index, trigram_search,
)

# Texts of one file of postings.
PART_BYTES = 16 << 20


class WrongState(ValueError):
    """The generation is not in the state that the change starts from, or somebody else made the change."""


class Leased(ValueError):
    """A reader holds the generation."""


class GenerationStore:
    """The generations of one index below ``path``."""

    # A build that has not become ready for so long was broken off and may be removed.
    BROKEN_AFTER = 6 * 3600.0

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", text: str = "text"):
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- small files ----

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _create(self, name: str, content: dict) -> bool:
        """Create a file that must not be there; False if it is."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._at(name)):
                return False
            raise
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def _read(self, name: str) -> dict | None:
        """A file's content; None where there is none, or not all of it yet."""
        try:
            stream = self._fs.open(self._at(name))
        except Py4JJavaError:
            return None
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def _names(self, folder: str = "") -> list[str]:
        where = self._at(folder) if folder else self._hadoop.Path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    # ---- states ----

    def states(self) -> dict[int, str]:
        """The state of every generation."""
        found: dict[int, str] = {}
        for name in self._names():
            number, _, state = name.removeprefix("g").partition(".")
            if number.isdigit() and state in STATES:
                number = int(number)
                if number not in found or STATES.index(state) > STATES.index(found[number]):
                    found[number] = state
        return dict(sorted(found.items()))

    def _enter(self, number: int, state: str, content: dict | None = None) -> None:
        """Compare and set: from the state before ``state`` to it."""
        before = STATES[STATES.index(state) - 1]
        if self.states().get(number) != before or not self._create(f"g{number}.{state}", {"at": time.time()} | (content or {})):
            raise WrongState(f"generation {number} is not {before}, or became {state} just now")

    def begin(self, fence: str) -> int:
        """A number for a new generation, building. Builders at once get numbers of their own."""
        while True:
            number = max(self.states(), default=0) + 1
            if self._create(f"g{number}.building", {"at": time.time(), "fence": fence, "data": f"data-{number}-{uuid.uuid4().hex}"}):
                return number

    def write(self, number: int, docs: DataFrame) -> dict:
        """Write the postings of a generation that is building, and return its digests."""
        if self.states().get(number) != "building":
            raise WrongState(f"generation {number} is not building")
        path = f"{self.path}/{self._read(f'g{number}.building')['data']}"
        lists = gram_lists(self._spread(docs), self.key, self.text).withColumn("bucket", bucket_of("gram"))
        # Texts move, not their postings: each file is sorted by bucket, so that a query reads few pages of it, and
        # a common gram spreads over the files of its documents. Lists are sorted and kept, not single postings.
        lists.sortWithinPartitions(bucket_place("gram")).withColumnRenamed("keys", f"{self.key}_list").write.parquet(path)
        return self._collected(bucket_digests(self._postings(number), self.key))

    def digests(self, docs: DataFrame) -> dict:
        """The digests that the postings of ``docs`` would have; nothing is written."""
        return self._collected(bucket_digests(trigram_index(self._spread(docs), self.key, self.text), self.key))

    def _spread(self, docs: DataFrame) -> DataFrame:
        """The ids and texts in even parts, however the files are cut."""
        docs = docs.select(self.key, self.text)
        size = docs.agg(F.sum(F.octet_length(self.text).cast("bigint"))).first()[0] or 0
        return docs.repartition(max(self.spark.sparkContext.defaultParallelism, -(-size // PART_BYTES)))

    @staticmethod
    def _collected(digests: DataFrame) -> dict:
        return {str(r["bucket"]): r["digest"] for r in digests.collect()}  # BUCKETS rows at most

    def publish(self, number: int, digests: dict) -> bool:
        """Make a generation ready and retire older ones; one that a newer has overtaken retires at once (False)."""
        self._enter(number, "ready", {"digests": digests})
        ready = [n for n, s in self.states().items() if s == "ready"]
        for other in ready:
            if other < max(ready):
                try:
                    self.retire(other)
                except WrongState:
                    pass  # another publisher did
        return number == max(ready)

    def build(self, docs: DataFrame, fence: str) -> int:
        number = self.begin(fence)
        self.publish(number, self.write(number, docs))
        return number

    def retire(self, number: int) -> None:
        self._enter(number, "retired")

    def remove(self, number: int) -> None:
        """Remove a retired generation, or one whose build was broken off long ago, unless a reader holds it.

        The intent is put up before leases are looked at, and a reader looks for it after putting up its
        lease, so one of the two sees the other.
        """
        state = self.states().get(number)
        made = self._read(f"g{number}.building") or {}
        broken = state == "building" and time.time() - made.get("at", 0) > self.BROKEN_AFTER
        if state != "retired" and not broken:
            raise WrongState(f"generation {number} is {state}")
        intent = f"g{number}.removing"
        self._create(intent, {})
        if self.holders(number):
            self._fs.delete(self._at(intent), False)
            raise Leased(f"generation {number}")
        if "data" in made:
            self._fs.delete(self._at(made["data"]), True)
        self._create(f"g{number}.removed", {"at": time.time()})
        self._fs.delete(self._at(intent), False)

    # ---- leases ----

    def holders(self, number: int) -> list[str]:
        """Leases of a generation that have not expired."""
        out = []
        for name in self._names(f"leases-{number}"):
            lease = self._read(f"leases-{number}/{name}")
            # A lease whose content is not there yet counts; its reader is about to look for the intent.
            if lease is None or lease["until"] > time.time():
                out.append(name)
        return out

    @contextmanager
    def lease(self, number: int, seconds: float = 3600.0):
        """Hold a ready or retired generation; it is not removed before the block or the lease ends."""
        name = f"leases-{number}/{uuid.uuid4().hex}"
        self._create(name, {"until": time.time() + seconds})
        try:
            if self.states().get(number) not in ("ready", "retired") or self._fs.exists(self._at(f"g{number}.removing")):
                raise WrongState(f"generation {number} is going or gone")
            yield self._postings(number)
        finally:
            self._fs.delete(self._at(name), False)

    # ---- searching ----

    def _postings(self, number: int) -> DataFrame:
        """The postings of a generation: gram, key and bucket. Files of single postings are read as well."""
        made = self._read(f"g{number}.building")
        rows = self.spark.read.parquet(f"{self.path}/{made['data']}")
        held = f"{self.key}_list"
        return rows.select("gram", F.explode(held).alias(self.key), "bucket") if held in rows.columns else rows

    def ready(self) -> int | None:
        """The newest ready generation."""
        return max((n for n, s in self.states().items() if s == "ready"), default=None)

    def _buckets(self, query: str) -> list[int]:
        grams = self.spark.createDataFrame([(g,) for g in query_grams(query)], "gram string")
        return sorted({r[0] for r in grams.select(bucket_of("gram")).collect()})

    def distrust(self, query: str, number: int | None, fence: str) -> str | None:
        """Why a generation cannot answer, or None. Reads the buckets of the query's grams and nothing else."""
        if number is None:
            return "index missing"
        if len(query) < GRAM:
            return "query too short"
        made, ready = self._read(f"g{number}.building"), self._read(f"g{number}.ready")
        if not made or not ready:
            return "index corrupt"
        if made["fence"] != fence:
            return "index stale"
        try:
            postings = self._postings(number)
            if not {"bucket", "gram", self.key} <= set(postings.columns):
                return "index corrupt"
            touched = self._buckets(query)
            found = bucket_digests(postings.filter(F.col("bucket").isin(touched)), self.key).collect()
        except (PySparkException, Py4JJavaError):
            return "index corrupt" if self._fs.exists(self._at(made["data"])) else "index missing"
        held = {r["bucket"]: r["digest"] for r in found}
        # A posting put under a wrong bucket shows as a bucket that was not asked for.
        wanted = {b: ready["digests"][str(b)] for b in touched if str(b) in ready["digests"]}
        return None if held == wanted else "index corrupt"

    def search(self, docs: DataFrame, query: str, fence: str, number: int | None = None) -> DataFrame:
        """Documents that contain ``query``, from the newest ready generation if it is fresh and the buckets it
        needs are whole, else by scanning; the answer is the same and says why it was scanned. Writes nothing.
        ``number`` asks for a generation that the caller holds by a lease."""
        number = self.ready() if number is None else number
        reason = self.distrust(query, number, fence)
        if reason is None:
            postings = self._postings(number).filter(F.col("bucket").isin(self._buckets(query)))
            found = trigram_search(postings, docs, query, self.key, self.text)
        else:
            found = direct_scan(docs, query, self.text)
        return found.withColumn("fallback_reason", F.lit(reason).cast("string"))
