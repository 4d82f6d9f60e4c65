"""The feature frame: one row per key with every ``f_`` column."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import tags, temporal
from riskloom.operators.asof import asof_lookup, value_if_known_by
from riskloom.operators.tabular import tabular_columns

BASE = ("cve_id", "published_date", "exploited_30d", "in_kev", "cvss_v3_base_score")
EPSS = {"f_epss_score": "epss_score", "f_epss_percentile": "epss_percentile"}


def feature_names(df: DataFrame, *, without_epss: bool = False) -> list[str]:
    """Sorted model inputs, optionally without the baseline's own columns."""
    names = sorted(c for c in df.columns if c.startswith("f_"))
    return [c for c in names if not (without_epss and c.startswith("f_epss_"))]


def fill_features(df: DataFrame) -> DataFrame:
    """Null features as 0."""
    return df.fillna(0, subset=feature_names(df))


def epss_as_of(master: DataFrame, history: DataFrame | None) -> DataFrame:
    """Baseline scores known at publication; 0 when there were none.

    Without a history, or with an empty one, the master row's own score counts
    if its snapshot is no later than publication; a master table without score
    columns gives 0.
    """
    own = [*EPSS.values(), "epss_snapshot_date"]
    if all(c in master.columns for c in own):
        known = (F.col("epss_snapshot_date"), F.col("published_date"))
        current = {f: value_if_known_by(F.col(c), *known).cast("float") for f, c in EPSS.items()}
    else:
        current = {f: F.lit(0.0).cast("float") for f in EPSS}
    if history is None:
        return master.select("*", *[value.alias(f) for f, value in current.items()])
    # Whether there is a history at all is a scalar subquery of the same plan.
    empty = history.select("cve_id").limit(1).agg(F.count(F.lit(1)) == 0).scalar()
    # Drop the master's current scores first, so that nothing later can be picked up.
    held = master.withColumns({f"_own_{f}": F.when(empty, value) for f, value in current.items()})
    found = asof_lookup(
        held.drop(*own),
        history,
        on="cve_id",
        left_time="published_date",
        right_time="snapshot_date",
        values=EPSS,
        # The stored history holds one row per id and day.
        right_unique=True,
    )
    zero = F.lit(0.0).cast("float")
    filled = {f: F.coalesce(F.col(f), F.col(f"_own_{f}"), zero).cast("float") for f in EPSS}
    return found.withColumns(filled).drop(*[f"_own_{f}" for f in EPSS])


def epss_current(master: DataFrame) -> DataFrame:
    """Latest baseline scores, null as 0; for live scoring only."""
    zero = F.lit(0.0)
    return master.select(
        "*", *[F.coalesce(F.col(c), zero).cast("float").alias(f) for f, c in EPSS.items()]
    )


def feature_frame(
    master: DataFrame,
    *,
    history: DataFrame | None = None,
    include_tabular: bool = True,
    include_temporal: bool = True,
    include_graph: bool = False,
    point_in_time: bool = True,
    as_of: date | None = None,
) -> DataFrame:
    """Base columns plus the chosen features, each as of publication or as of one anchor.

    Tabular and temporal columns are added in place; only the score history and
    the tag summaries join, both on the key, so the frame shuffles once.
    """
    keep = list(BASE)
    wide = epss_as_of(master, history) if point_in_time else epss_current(master)
    keep += list(EPSS)
    if include_tabular:
        wide = wide.select("*", *tabular_columns())
        keep += [c for c in wide.columns if c.startswith("f_") and c not in keep]
    if include_temporal:
        if point_in_time:
            dated = temporal.temporal_per_row(wide, counted=master)
        else:
            anchor = F.lit(as_of) if as_of else temporal.latest_day(master, "published_date")
            dated = temporal.temporal_as_of(wide, anchor, counted=master)
            if as_of:
                # Rows after the anchor stay in the frame without temporal features.
                later = wide.where(F.col("published_date") > F.lit(as_of))
                dated = dated.unionByName(later, allowMissingColumns=True)
        wide = dated
        keep += list(temporal.FEATURES)
    if include_graph:
        tagged = tags.explode_tags(master, key="cve_id", day="published_date", tags="cwe_ids")
        if point_in_time:
            graph = tags.popularity_per_row(tagged, key="cve_id", day="published_date")
        else:
            anchor = F.lit(as_of) if as_of else temporal.latest_day(master, "published_date")
            graph = tags.popularity_as_of(tagged, anchor, key="cve_id", day="published_date")
        wide = wide.join(graph, "cve_id", "left")
        keep += list(tags.FEATURES)
    return fill_features(wide.select(*keep))
