"""Jobs and keys as tables: states, retention, ownership, listings, failure limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAILURES, SECONDS = 20, 600
OPEN = ("queued", "running")
MOVES = {"queued": ["running", "failed", "deleted"], "running": ["succeeded", "failed"], "succeeded": ["deleted"], "failed": ["deleted"]}


def states(events: DataFrame) -> DataFrame:
    """job_id, status, code from an event log (job_id, seq, status, code): the last event counts.

    A deletion while a job runs is not an event: it is refused as busy.
    """
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("code", "seq").alias("code"))


def interrupted(jobs: DataFrame) -> DataFrame:
    """After a restart, jobs that were queued or running have failed."""
    open_ = F.col("status").isin(*OPEN)
    return jobs.withColumns({"code": F.when(open_, "INTERRUPTED").otherwise(F.col("code")), "status": F.when(open_, "failed").otherwise(F.col("status"))})


def retention_hours(hours: Column) -> Column:
    return F.least(F.greatest(hours, F.lit(0.1)), F.lit(168.0))


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("expires") < now) & ~F.col("status").isin(*OPEN))


def stale_files(files: DataFrame, now: Column, age: float = 3600.0) -> DataFrame:
    """Left-over temporary files: *.upload, tmp*, sync-* of more than an hour."""
    return files.where(F.rlike("name", F.lit(r"(\.upload|\Atmp.*|\Async-.*)\z")) & (now - F.col("modified") > age))


def visible(jobs: DataFrame, owner: str | None) -> DataFrame:
    """All jobs for an administrator (owner None), else one's own."""
    return jobs if owner is None else jobs.where(F.col("owner") == owner)


def recent(jobs: DataFrame, limit: int) -> DataFrame:
    """Newest first, at most 1 to 100."""
    return jobs.orderBy(F.desc("created"), "id").limit(min(100, max(1, limit)))


def hash_key(key: Column) -> Column:
    return F.sha2(key, 256)


def verify_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests (request_id, key) with the id of the live key they carry, else null."""
    live = keys.where("revoked IS NULL").select("key_hash", F.col("id").alias("key_id"))
    return requests.withColumn("key_hash", hash_key(F.col("key"))).join(live, "key_hash", "left").select("request_id", "key_id")


def new_keys(requests: DataFrame, existing: DataFrame, prefix: str = "key_") -> DataFrame:
    """requests (id, name, secret, created) -> rows of the key table: id, name, prefix, key_hash, created, last_used, revoked.

    Of the secret only the hash is kept, and its first characters for display; names keep 64 characters. A secret whose hash exists, be it of a revoked key,
    gives no row and must be drawn again.
    """
    name = F.coalesce(F.nullif(F.substring(F.trim("name"), 1, 64), F.lit("")), F.lit("unnamed"))
    made = requests.select("id", name.alias("name"), F.substring("secret", 1, len(prefix) + 5).alias("prefix"), hash_key(F.col("secret")).alias("key_hash"), F.col("created").cast("double").alias("created"))
    fresh = made.join(existing.select("key_hash"), "key_hash", "left_anti").dropDuplicates(["key_hash"])
    none = F.lit(None).cast("double")
    return fresh.select("id", "name", "prefix", "key_hash", "created", none.alias("last_used"), none.alias("revoked"))


def revoke(keys: DataFrame, ids: list[str], now: float) -> DataFrame:
    """The key table with some keys revoked; those that were keep their time."""
    return keys.withColumn("revoked", F.when(F.col("id").isin(*ids) & F.col("revoked").isNull(), F.lit(float(now))).otherwise(F.col("revoked")))


def last_used(keys: DataFrame, uses: DataFrame, seconds: float = 60.0) -> DataFrame:
    """The key table with `last_used` after uses (key_id, at): written at most once in so many seconds, so a use counts only if it comes later than
    that after the one written before it. Folded over a key's uses by the second."""
    entry = F.sort_array(F.collect_set(F.col("at").cast("double")))
    own = uses.groupBy(F.col("key_id").alias("id")).agg(entry.alias("__at"))
    step = lambda last, at: F.when(last.isNull() | (at - last > seconds), at).otherwise(last)
    return keys.join(own, "id", "left").withColumn("last_used", F.aggregate(F.coalesce("__at", F.array().cast("array<double>")), F.col("last_used").cast("double"), step)).drop("__at")


def usage(keys: DataFrame, jobs: DataFrame) -> DataFrame:
    """id, active, jobs: whether each key is live, and how many jobs it owns."""
    per = jobs.groupBy(F.col("owner").alias("id")).agg(F.count("*").alias("jobs"))
    return keys.join(per, "id", "left").select("id", F.col("revoked").isNull().alias("active"), F.coalesce("jobs", F.lit(0)).alias("jobs"))


#: Columns that job tables of earlier versions lack.
ADDED = {"owner": "string", "name": "string"}


def migrate(old: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """A job table of an earlier version with the columns it lacks, null for its rows, and the rows of a newer one behind it."""
    full = old.withColumns({c: F.lit(None).cast(t) for c, t in ADDED.items() if c not in old.columns})
    return full if new is None else full.unionByName(new, allowMissingColumns=True)


def over_limit(failures: DataFrame, client: str, at: str, seconds: int = SECONDS, limit: int = FAILURES) -> DataFrame:
    """Failures that find `limit` or more failures of their client in the seconds before: the batch form of the limiter. `at` is in microseconds.

    It counts blocked attempts too, so after a client's first block it may report more than the stateful form. Rows are windowed by client and slice of that
    many seconds, each also standing in the next slice as one of those before: a client with many failures spreads over its slices.
    """
    width = seconds * 1_000_000
    own = F.floor(F.col(at) / width)
    spread = failures.withColumn("__s", F.explode(F.array(F.struct(own.alias("slice"), F.lit(True).alias("own")), F.struct((own + 1).alias("slice"), F.lit(False).alias("own")))))
    by = Window.partitionBy(client, "__s.slice").orderBy(at).rangeBetween(-width, -1)
    return spread.withColumn("before", F.count("*").over(by)).where(F.col("__s.own") & (F.col("before") >= limit)).drop("__s")
