"""Tables published version by version: staged files, then one small pointer file.

A version is a JSON file that says which folder holds each bucket of ids. Writers stage whole buckets in a folder of their
own and publish a version that points to them, so a run that dies before that leaves the version before it as it was, and a
reader never sees half a run. Which of two writers may follow a version is settled by a claim, a file that only one of them
can create.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.schemas import conform
from riskloom.session import cut_lineage
from riskloom.sources.files import age_seconds, exists, names, read_text, rename, write_text

BUCKETS = 256
#: A claim of this age whose version never came is taken to be that of a dead writer.
STALE_SECONDS = 900


class Conflict(RuntimeError):
    """Another writer has published, or is about to publish, a version on the same base."""


def _pointers(root: str) -> str:
    return f"{root.rstrip('/')}/_versions"


def latest_version(spark: SparkSession, root: str) -> int:
    """The number of the newest published version; 0 before the first."""
    return max((int(n.removesuffix(".json")) for n in names(spark, _pointers(root)) if n.endswith(".json")), default=0)


def read_version(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """What a version says, the newest by default; ``None`` before the first."""
    number = latest_version(spark, root) if version is None else version
    return json.loads(read_text(spark, f"{_pointers(root)}/{number:010d}.json")) if number else None


def publish(spark: SparkSession, root: str, base: int, facts: dict, *, stale_seconds: float = STALE_SECONDS) -> int:
    """Publish ``facts`` as the version after ``base``; :class:`Conflict` if another writer came first.

    The claim comes first, then the pointer is written under another name and renamed. A claim without a pointer blocks
    the table until it is ``stale_seconds`` old.
    """
    number = base + 1
    stem = f"{_pointers(root)}/{number:010d}"
    if latest_version(spark, root) != base:
        raise Conflict(f"version {base} of {root} is not the newest any more")
    turn = 0
    while not write_text(spark, f"{stem}.claim-{turn}", ""):
        if exists(spark, f"{stem}.json") or age_seconds(spark, f"{stem}.claim-{turn}") < stale_seconds:
            raise Conflict(f"version {number} of {root} has been claimed by another writer")
        turn += 1
    draft = f"{stem}.{uuid.uuid4().hex}.draft"
    write_text(spark, draft, json.dumps({**facts, "version": number}, sort_keys=True, default=str))
    if exists(spark, f"{stem}.claim-{turn + 1}") or exists(spark, f"{stem}.json") or not rename(spark, draft, f"{stem}.json"):
        raise Conflict(f"version {number} of {root} was taken over by another writer")
    return number


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _stage(rows: DataFrame, root: str, key: str, buckets: int) -> dict[str, str]:
    """Write rows by bucket into a new folder; the folder of each bucket that has rows."""
    folder = uuid.uuid4().hex
    path = f"{root.rstrip('/')}/data/{folder}"
    dealt = rows.withColumn("_bucket", bucket_of(key, buckets)).hint("rebalance", "_bucket")
    dealt.write.partitionBy("_bucket").option("compression", "zstd").parquet(path)
    found = [n.removeprefix("_bucket=") for n in names(rows.sparkSession, path) if n.startswith("_bucket=")]
    return {bucket: folder for bucket in found}


def read_table(spark: SparkSession, root: str, contract: StructType, *, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets; no rows before the first version."""
    facts = read_version(spark, root, version) or {"folders": {}}
    wanted = None if only is None else {str(b) for b in only}
    paths = [f"{root.rstrip('/')}/data/{folder}/_bucket={b}" for b, folder in sorted(facts["folders"].items()) if wanted is None or b in wanted]
    return spark.read.schema(contract).parquet(*paths) if paths else spark.createDataFrame([], contract)


def replace_table(spark: SparkSession, root: str, rows: DataFrame, contract: StructType, *, key: str, buckets: int = BUCKETS) -> int:
    """Publish ``rows`` as the whole table; the new version's number."""
    base = latest_version(spark, root)
    folders = _stage(conform(rows, contract), root, key, buckets)
    return publish(spark, root, base, {"key": key, "buckets": buckets, "folders": folders})


def upsert(spark: SparkSession, root: str, rows: DataFrame, contract: StructType) -> int:
    """Publish a version in which ``rows``, one for each id, replace or join the rows of those ids; its number.

    Only buckets that hold one of the ids are read and written; the other buckets stay the files they are. Without rows
    there is no new version.
    """
    facts = read_version(spark, root)
    if facts is None:
        raise FileNotFoundError(f"no version of a table under {root}")
    key, buckets = facts["key"], facts["buckets"]
    changes = cut_lineage(conform(rows, contract))
    # At most one number for each bucket.
    touched = [r[0] for r in changes.select(bucket_of(key, buckets)).distinct().collect()]
    if not touched:
        return facts["version"]
    before = read_table(spark, root, contract, version=facts["version"], only=touched)
    after = before.join(changes.select(key), key, "left_anti").unionByName(changes)
    staged = _stage(conform(after, contract), root, key, buckets)
    return publish(spark, root, facts["version"], {**facts, "folders": {**facts["folders"], **staged}})
