"""The master table kept up to date by the ids that changed."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.dedup import keep_first
from riskloom.operators.labels import HORIZON_DAYS
from riskloom.plans.silver import FROM_NVD, build_master, newest_scores
from riskloom.schemas import CVE_MASTER
from riskloom.session import cut_lineage
from riskloom.sources import versioned

_SCORES = {"epss_score": "_s", "epss_percentile": "_p", "epss_snapshot_date": "_d"}


def _differs(pairs: dict[str, str]) -> Column:
    """Whether any of the columns differs from its partner, nulls being equal."""
    return reduce(or_, (~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs.items()))


def _first_marks(kev: DataFrame) -> DataFrame:
    known = kev.where("cve_id is not null").select("cve_id", "date_added")
    return keep_first(known, ["cve_id"], ["date_added"], hashed=True)


def changed_ids(stored: DataFrame, nvd: DataFrame | None, kev: DataFrame, epss: DataFrame | None, *, unique: bool = False) -> DataFrame:
    """Distinct ids that landed in ``nvd`` or whose catalog day or score is not what ``stored`` has.

    Of the stored table only the id and the columns compared are read. An id may turn out to be unchanged after all.
    ``unique`` says that ``kev`` and ``epss`` hold an id once.
    """
    first = (kev if unique else _first_marks(kev)).select("cve_id", F.col("date_added").alias("_k"))
    held = stored.select("cve_id", "kev_date_added", *_SCORES).join(first, "cve_id", "left")
    if epss is None:
        other = F.coalesce(*(F.col(c).cast("string") for c in _SCORES)).isNotNull()
    else:
        newest = epss if unique else newest_scores(epss)
        renamed = newest.select("cve_id", F.col("epss_score").cast("float").alias("_s"), F.col("epss_percentile").cast("float").alias("_p"), F.col("snapshot_date").alias("_d"))
        held, other = held.join(renamed, "cve_id", "left"), _differs(_SCORES)
    out = held.where(_differs({"kev_date_added": "_k"}) | other).select("cve_id")
    return out if nvd is None else out.unionByName(nvd.select("cve_id")).distinct()


def changed_rows(
    stored: DataFrame, nvd: DataFrame | None, kev: DataFrame, epss: DataFrame | None, *, horizon_days: int = HORIZON_DAYS
) -> DataFrame:
    """The rows of the new master table that differ from ``stored``, new ids included.

    ``nvd`` holds vulnerability rows that landed since, one for each id; other ids keep the columns they have. ``kev`` is the
    whole catalog and ``epss`` the snapshot in force, or none. Both are brought to one row for each id once, for telling what
    changed and for the new rows.
    """
    first = cut_lineage(_first_marks(kev))
    newest = cut_lineage(newest_scores(epss, hashed=True)) if epss is not None else None
    whole = F.struct(*CVE_MASTER.names)
    ids = changed_ids(stored, nvd, first, newest, unique=True)
    base = stored.join(ids, "cve_id", "left_semi").select("cve_id", whole.alias("_was"))
    own = FROM_NVD[1:]
    if nvd is None:
        base = base.select("cve_id", *(F.col("_was")[c].alias(c) for c in own), "_was")
    else:
        landed = nvd.select("cve_id", F.struct(*(F.col(c).cast(CVE_MASTER[c].dataType).alias(c) for c in own)).alias("_new"))
        fresh = F.col("_new").isNotNull()
        columns = [F.when(fresh, F.col("_new")[c]).otherwise(F.col("_was")[c]).alias(c) for c in own]
        base = base.join(landed, "cve_id", "full").select("cve_id", *columns, "_was")
    made = build_master(base, first, newest, horizon_days=horizon_days, unique=True, keep=["_was"])
    return made.where(~whole.eqNullSafe(F.col("_was"))).select(*CVE_MASTER.names)


def publish_master(spark: SparkSession, root: str, master: DataFrame, *, buckets: int = versioned.BUCKETS) -> int:
    """Publish a whole master table under ``root``; its version."""
    return versioned.replace_table(spark, root, master, CVE_MASTER, key="cve_id", buckets=buckets)


def read_master(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest published master table, or that of ``version``."""
    return versioned.read_table(spark, root, CVE_MASTER, version=version)


def update_master(
    spark: SparkSession,
    root: str,
    nvd: DataFrame | None,
    kev: DataFrame,
    epss: DataFrame | None,
    *,
    horizon_days: int = HORIZON_DAYS,
    buckets: int = versioned.BUCKETS,
) -> int:
    """Bring the published master table up to date; the version in force afterwards.

    The first run publishes what it is given as a whole. Later ones rewrite the buckets of ids whose rows change.
    """
    if versioned.latest_version(spark, root) == 0:
        if nvd is None:
            raise ValueError("the first run needs the vulnerability rows")
        return publish_master(spark, root, build_master(nvd, kev, epss, horizon_days=horizon_days), buckets=buckets)
    rows = changed_rows(read_master(spark, root), nvd, kev, epss, horizon_days=horizon_days)
    return versioned.upsert(spark, root, rows, CVE_MASTER)
