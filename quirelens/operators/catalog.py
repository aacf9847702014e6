"""Catalog reads: current, eligible and available rows, threads, jobs, content.

Only names and columns of these reads are declared anywhere; the definitions are
this package's own and are given in each docstring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.functions.hashing import key_to_hex, sha256_hex
from quirelens.operators.graph import components, follow, peel
from quirelens.plans.frames import null_safe_join
from quirelens.plans.skew import lookup_join
from quirelens.plans.windows import latest


def active_relations(relations: DataFrame, cancellations: DataFrame, key: str = "relation_uuidv4") -> DataFrame:
    """Relations nobody cancelled."""
    return relations.join(cancellations.select(key).distinct(), key, "left_anti")


def equivalence_closure(relations: DataFrame, members: DataFrame | None, kind: str) -> DataFrame:
    """Members of one kind with the least member they are equivalent to.

    ``relations`` holds entity_kind, left and right; ``members`` holds node, and
    adds those without a relation as their own representative.
    """
    edges = relations.filter(F.col("entity_kind") == kind).select(F.col("left").alias("source"), F.col("right").alias("target"))
    return components(edges.dropna(), members)


def equivalence_closures(relations: DataFrame, members: DataFrame) -> DataFrame:
    """entity_kind, member and the least member it is equivalent to, of all kinds in one run.

    ``relations`` holds entity_kind, left and right, ``members`` holds entity_kind and node; ids of
    different kinds are different. A relation without a kind relates nothing; members without
    one stand for themselves.
    """
    known = relations.dropna(subset=["entity_kind", "left", "right"])
    end = lambda c: F.struct(F.col("entity_kind").alias("kind"), F.col(c).alias("id"))
    found = components(known.select(end("left").alias("source"), end("right").alias("target")))
    found = found.select(F.col("member.kind").alias("entity_kind"), F.col("member.id").alias("member"), F.col("representative.id").alias("representative"))
    every = members.select("entity_kind", F.col("node").alias("member")).distinct()
    return every.join(found, ["entity_kind", "member"], "left").select(
        "entity_kind", "member", F.coalesce("representative", "member").alias("representative"))


def available_objects(objects: DataFrame, object_payloads: DataFrame, payloads: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Objects whose payload is kept and not quarantined."""
    kept = (
        object_payloads.select(
            "git_object_id", F.col("payload_representation").alias("representation"), F.col("payload_sha256").alias("sha256")
        )
        .join(payloads.select("representation", "sha256"), ["representation", "sha256"], "left_semi")
        .join(quarantine.select("sha256"), "sha256", "left_anti")
    )
    return objects.join(kept.select("git_object_id"), "git_object_id", "left_semi")


def available_snapshots(snapshots: DataFrame) -> DataFrame:
    """Complete snapshots."""
    return snapshots.filter(F.col("complete") == 1)


def available_acquisitions(acquisitions: DataFrame, roots: DataFrame, objects: DataFrame) -> DataFrame:
    """Acquisitions every root of which is among the available ``objects``."""
    key = ["object_format", "oid"]
    lost = roots.join(objects.select(*key), key, "left_anti").select("git_acquisition_id").distinct()
    return acquisitions.join(lost, "git_acquisition_id", "left_anti")


def current_snapshots(snapshots: DataFrame) -> DataFrame:
    """Complete snapshots that precede no other, the latest generation of each repository."""
    before = snapshots.select(F.col("predecessor_snapshot_id").alias("snapshot_id")).dropna().distinct()
    heads = available_snapshots(snapshots).join(before, "snapshot_id", "left_anti")
    return latest(heads, ["repository_uuidv4"], [F.desc("generation"), F.asc("snapshot_id")])


def current_coverage(claims: DataFrame, markers: DataFrame, blocked: DataFrame) -> DataFrame:
    """Latest unblocked claim of each scope with the number of its markers.

    Equal times are decided by the higher claim id.
    """
    open_claims = claims.join(blocked.select("coverage_claim_id"), "coverage_claim_id", "left_anti")
    now = latest(open_claims, ["coverage_scope_id"], [F.desc("observed_at_us"), F.desc("coverage_claim_id")])
    n = markers.groupBy("coverage_claim_id").agg(F.count(F.lit(1)).alias("n_markers"))
    return now.join(n, "coverage_claim_id", "left").na.fill(0, ["n_markers"])


def with_eligibility(
    state: DataFrame, blocked: DataFrame, bodies: DataFrame, scope: str, body: str, salt_by: Sequence[str]
) -> DataFrame:
    """State rows with the reason that excludes them, if any: their scope is
    blocked, or the body they refer to is absent."""
    stop = blocked.select(scope).distinct().withColumn("_blocked", F.lit(True))
    have = bodies.select(body).distinct().withColumn("_present", F.lit(True))
    out = lookup_join(lookup_join(state, stop, [scope], "left", salt_by), have, [body], "left", salt_by)
    reason = F.when(F.col("_blocked"), "scope blocked").when(
        F.col(body).isNotNull() & F.col("_present").isNull(), "body missing"
    )
    return out.select(*state.columns, reason.alias("reason"))


def eligible(state, blocked, bodies, scope: str, body: str, salt_by: Sequence[str]) -> DataFrame:
    rows = with_eligibility(state, blocked, bodies, scope, body, salt_by)
    return rows.filter("reason is null").drop("reason")


def diagnostics(state, blocked, bodies, scope: str, body: str, salt_by: Sequence[str]) -> DataFrame:
    return with_eligibility(state, blocked, bodies, scope, body, salt_by).filter("reason is not null")


def observed_names(current: DataFrame, history: DataFrame, key: str, name: str) -> DataFrame:
    """Every name ever seen for a key."""
    return current.select(key, name).unionByName(history.select(key, name)).dropna().distinct()


def valid_facts(facts: DataFrame, objects: DataFrame, key: Sequence[str], fact_id: str) -> DataFrame:
    """Facts about verified objects, one per ``key`` (object and decoder)."""
    sound = objects.filter(F.col("verified") == 1).select("git_object_id")
    return latest(facts.join(sound, "git_object_id", "left_semi"), key, [F.asc(fact_id)])


def valid_ref_captures(refs: DataFrame, snapshots: DataFrame, tags: DataFrame) -> DataFrame:
    """Refs of complete snapshots with their peeled target.

    A captured ref is named by snapshot and raw name together.
    """
    done = available_snapshots(snapshots).select("snapshot_id")
    named = lookup_join(refs, done, ["snapshot_id"], "left_semi", ["raw_ref_name"]).drop("peeled_oid")
    return peel(named.withColumn("ref", F.struct("snapshot_id", "raw_ref_name")), tags).drop("ref")


def ordinal_gaps(df: DataFrame, partition: Sequence[str], ordinal: str) -> DataFrame:
    """Groups whose ordinals are not contiguous or repeat.

    Repeats fold on (group, ordinal) first, so a group is never sorted in one task.
    """
    each = df.groupBy(*partition, ordinal).agg(F.count(F.lit(1)).alias("_n"))
    groups = each.groupBy(*partition).agg(
        F.min(ordinal).alias("first_ordinal"), F.max(ordinal).alias("last_ordinal"),
        F.count(F.lit(1)).alias("n_ordinals"), F.sum(F.col("_n") - 1).alias("n_repeats"),
    )
    missing = (F.col("last_ordinal") - F.col("first_ordinal") + 1 - F.col("n_ordinals")).cast("bigint")
    return groups.withColumn("n_missing", missing).filter("n_missing > 0 or n_repeats > 0")


def gap_starts(df: DataFrame, partition: Sequence[str], ordinal: str) -> DataFrame:
    """Ordinals that another of the group follows, but not directly."""
    seen = df.select(*partition, ordinal).distinct()
    before = seen.select(*partition, (F.col(ordinal) - 1).cast(df.schema[ordinal].dataType).alias(ordinal))
    ends = seen.groupBy(*partition).agg(F.max(ordinal).alias("_end"))
    open_ends = seen.join(before, [*partition, ordinal], "left_anti")
    return (
        lookup_join(open_ends, ends, partition, "inner", [ordinal]).filter(F.col(ordinal) < F.col("_end")).drop("_end")
    )


def cas_references(bodies: DataFrame, key: str, body: str, *keep: str) -> DataFrame:
    """Each owner with the hash of the body it refers to."""
    return bodies.select(key, *keep, sha256_hex(body).alias("sha256"), F.octet_length(body).alias("byte_length"))


def cas_store(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """One row per distinct body: hash, length, its first owner and how many own it.

    Bodies themselves are not shuffled; fetch them by their first owner.
    """
    return store_of(cas_references(bodies, key, body), key)


def store_of(refs: DataFrame, key: str) -> DataFrame:
    """The same from references that are at hand."""
    return refs.groupBy("sha256").agg(
        F.max("byte_length").cast("bigint").alias("byte_length"), F.min(key).alias("first_owner"), F.count(F.lit(1)).alias("n_refs")
    )


def cas_bodies(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """The distinct bodies with their hash. Bodies are fetched by owner, so they are
    shuffled where the store is too large to broadcast."""
    first = cas_store(bodies, key, body).select("sha256", F.col("first_owner").alias(key), "byte_length")
    return first.join(bodies.select(key, body), key).select("sha256", "byte_length", body)


def dedup_ratio(store: DataFrame) -> DataFrame:
    """Stored against referenced bodies and bytes."""
    used = F.sum(F.col("byte_length") * F.col("n_refs"))
    return store.agg(
        F.count(F.lit(1)).alias("n_bodies"), F.sum("n_refs").alias("n_refs"),
        F.sum("byte_length").alias("stored_bytes"), used.alias("referenced_bytes"),
    )


def verify_digests(bodies: DataFrame, key: str, body: str, sha256: str, byte_length: str) -> DataFrame:
    """Bodies to quarantine: their length or hash is not the recorded one."""
    reason = F.when(F.col(body).isNull(), "missing body").when(
        F.octet_length(body) != F.col(byte_length), "length mismatch"
    ).when(sha256_hex(body) != F.col(sha256), "digest mismatch")
    return bodies.select(key, sha256, reason.alias("reason")).filter("reason is not null")


def cleanup_candidates(cache: DataFrame, obligations: DataFrame, key: str) -> DataFrame:
    """Cache entries no incomplete preservation obligation holds back."""
    held = obligations.filter(F.col("complete") != 1).select(key).distinct()
    return lookup_join(cache, held, [key], "left_anti", cache.columns)


def staging_status(staged: DataFrame, admitted: DataFrame, key: str, content: str) -> DataFrame:
    """new, identical or conflict for each staged record.

    Different contents for one key conflict, among the staged ones or with the
    admitted one. Contents are compared by their least and greatest, so a key
    staged very often still folds before its shuffle.
    """
    ends = staged.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_staged"), F.min(content).alias("_lo"), F.max(content).alias("_hi")
    )
    known = admitted.select(key, F.col(content).alias("_admitted"))
    status = (
        F.when(F.col("_lo") != F.col("_hi"), "conflict")
        .when(F.col("_admitted").isNull(), "new")
        .when(F.col("_admitted") == F.col("_lo"), "identical")
        .otherwise("conflict")
    )
    return ends.join(known, key, "left").select(key, "n_staged", status.alias("status"))


def relation_staging_status(staged: DataFrame, relations: DataFrame) -> DataFrame:
    """The same for staged identity relations, by record and content hash."""
    return staging_status(staged, relations, "record_uuidv4", "content_sha256")


def collection_status(pages: DataFrame, members: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Whether each collection is complete.

    ``pages`` holds key, ordinal and has_next; ``members`` and ``expected`` hold
    key and member and must agree with multiplicity. Pages must be contiguous
    and the last one must have no next.
    """
    last = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pages"), F.max_by("has_next", "ordinal").alias("_next")
    )
    gaps = ordinal_gaps(pages, [key], "ordinal").select(key, F.lit(True).alias("_gap"))
    a = members.groupBy(key, "member").agg(F.count(F.lit(1)).alias("_n"))
    b = expected.groupBy(key, "member").agg(F.count(F.lit(1)).alias("_m"))
    off = (
        null_safe_join(a, b, [key, "member"], "full_outer")
        .withColumn("_off", (~F.col("_n").eqNullSafe(F.col("_m"))).cast("bigint"))
        .groupBy(key)
        .agg(F.sum("_off").alias("n_unreconciled"))
    )
    out = null_safe_join(last.join(gaps, key, "left"), off, [key], "full_outer").na.fill(0, ["n_pages", "n_unreconciled"])
    state = (
        F.when(F.col("n_pages") == 0, "no pages")
        .when(F.col("_gap"), "page gap")
        .when(F.col("_next") != 0, "unfinished")
        .when(F.col("n_unreconciled") > 0, "membership differs")
        .otherwise("complete")
    )
    return out.select(key, "n_pages", "n_unreconciled", state.alias("state"))


def with_parent(df: DataFrame, key: Sequence[str], parent_key: Sequence[str], columns: Sequence[str], kind: str | None = None) -> DataFrame:
    """Rows with columns of their parent in the same table.

    ``kind`` keeps only parents of that kind, as a generated key column does.
    """
    parents = df if kind is None else df.filter(F.col("kind") == kind)
    side = parents.select(
        *[F.col(k).alias(p) for k, p in zip(key, parent_key)], *[F.col(c).alias("parent_" + c) for c in columns]
    )
    return lookup_join(df, side, list(parent_key), "left", list(key))


def threads(comments: DataFrame, key: str, reply_to: str) -> DataFrame:
    """Each comment with the comment its thread starts from, and its depth."""
    ends = follow(comments.filter(F.col(reply_to).isNotNull()).select(F.col(key).alias("node"), F.col(reply_to).alias("next")))
    side = ends.select(F.col("node").alias(key), "last", F.col("hops").alias("_depth"))
    return comments.join(side, key, "left").select(
        *comments.columns, F.coalesce("last", key).alias("root"), F.coalesce("_depth", F.lit(0)).alias("depth")
    )


def thread_totals(assembled: DataFrame) -> DataFrame:
    return assembled.groupBy("root").agg(F.count(F.lit(1)).alias("n_comments"), F.max("depth").alias("max_depth"))


def change_totals(files: DataFrame, listing: str) -> DataFrame:
    """Sums and status counts of the file changes of each listing."""
    kinds = ("added", "modified", "removed", "renamed")
    return files.groupBy(listing).agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.sum(c).alias(c) for c in ("additions", "deletions", "changes")],
        *[F.count_if(F.col("status") == k).alias("n_" + k) for k in kinds],
    )


def attempt_status(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each job's current attempt, how often it was tried again, and its wait.

    ``jobs`` may name its current_attempt; without that column it is the last one.
    The attempts of a job are read in one aggregate.
    """
    facts = F.struct("attempt", "state", "created_at_us", "not_before_us")
    named = "current_attempt" in jobs.columns
    if named:
        mine = jobs.select("job_id", F.col("current_attempt").alias("_current"))
        tried = attempts.join(mine, "job_id")
        own = F.max(F.when(F.col("attempt") == F.col("_current"), facts))
    else:
        tried, own = attempts, F.max(facts)
    per_job = tried.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_attempts"), own.alias("_now"))
    current = F.col("current_attempt") if named else F.col("_now.attempt").alias("current_attempt")
    wait = F.greatest(F.col("_now.not_before_us") - F.col("_now.created_at_us"), F.lit(0))
    n = F.coalesce("n_attempts", F.lit(0))
    return jobs.join(per_job, "job_id", "left").select(
        "job_id", "kind", current, F.col("_now.state").alias("state"), n.alias("n_attempts"),
        F.greatest(n - 1, F.lit(0)).alias("n_retries"), wait.alias("wait_us"),
    )


def reservation_balance(reservations: DataFrame, key: str = "job_id") -> DataFrame:
    return reservations.groupBy(key).agg(
        F.sum("reserved").alias("reserved"), F.sum("consumed").alias("consumed"),
        (F.sum("reserved") - F.sum("consumed")).alias("balance"),
    )


def active_leases(leases: DataFrame, key: str = "active_cache_entry_id") -> DataFrame:
    return leases.groupBy(key).agg(F.count(F.lit(1)).alias("n_leases"), F.min("acquired_at_us").alias("oldest_us"))


def rebuild_rate(metrics: DataFrame) -> DataFrame:
    """Documents and bytes per second; null when no time passed."""
    seconds = F.when(F.col("duration_ms") > 0, F.col("duration_ms") / 1000.0)
    return metrics.withColumn("documents_per_second", F.col("documents_indexed") / seconds).withColumn(
        "bytes_per_second", F.col("bytes_indexed") / seconds
    )


def resolve_source_key(docs: DataFrame, git_objects: DataFrame, text_bodies: DataFrame, salt_by: Sequence[str]) -> DataFrame:
    """Search documents with the row their source key means.

    Code and commits name an object as ``git:<id>``; the other kinds name a text
    body by its hex digest.
    """
    is_git = F.col("kind").isin("code", "commits")
    number = F.regexp_extract("source_key", r"^git:([0-9]+)\z", 1)
    one = F.lit(True)
    objects = git_objects.select(
        F.lit("git").alias("_side"), F.col("git_object_id").cast("string").alias("_key"), one.alias("_found")
    )
    bodies = text_bodies.select(F.lit("text").alias("_side"), key_to_hex("sha256").alias("_key"), one.alias("_found"))
    # Both targets meet the documents in one join on a typed key.
    typed = docs.withColumn("_side", F.when(is_git, "git").otherwise("text")).withColumn(
        "_key", F.when(is_git, number).otherwise(F.col("source_key"))
    )
    target = F.when(is_git, "git_objects").otherwise("text_bodies")
    return lookup_join(typed, objects.unionByName(bodies), ["_side", "_key"], "left", salt_by).select(
        *docs.columns, target.alias("target"), F.coalesce("_found", F.lit(False)).alias("resolved")
    )
