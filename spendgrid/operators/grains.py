"""Pre-aggregated grains: materialise from the leaf fact and route queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendgrid.functions.measures import MEASURES


def build_grains(leaf: DataFrame, spec: dict[str, list[str]], helpers: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """One aggregate per grain: ``sum`` of the measures by ``sem + cols``, ``min`` of
    helper columns (deterministic, unlike ``first``). Lazy; see :func:`write_grains`."""
    out = {}
    for alias, cols in spec.items():
        extra = [F.min(h).alias(h) for h in (helpers or {}).get(alias, [])]
        out[alias] = leaf.groupBy("sem", *cols).agg(*[F.sum(m).alias(m) for m in MEASURES], *extra)
    return out


def write_grains(leaf: DataFrame, spec: dict[str, list[str]], base: str, helpers: dict[str, list[str]] | None = None,
                 partition_by: str | None = None) -> dict[str, str]:
    """Write each grain of ``spec`` as parquet under ``base/<alias>``; returns the paths.

    The finest grains come first; a grain whose columns an already written one holds is summed
    from that (the smallest such), so the leaf fact is read once per grain that nothing covers.
    Sums are exact decimals, so the way they are summed does not show."""
    helpers = helpers or {}
    written: dict[str, DataFrame] = {}
    paths: dict[str, str] = {}
    for alias in sorted(spec, key=lambda a: (-len(spec[a]), a)):
        need = {*spec[alias], *helpers.get(alias, [])}
        covers = [df for df in written.values() if need <= set(df.columns)]
        source = min(covers, key=grain_size) if covers else leaf
        w = build_grains(source, {alias: spec[alias]}, helpers)[alias].write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(partition_by)
        paths[alias] = f"{base.rstrip('/')}/{alias}"
        w.parquet(paths[alias])
        written[alias] = leaf.sparkSession.read.parquet(paths[alias])
    return paths


# Dimensions that are only stored on the point grain.
FROM_POINT_GRAIN = {"region": "pdc", "zona": "pdc"}


def grain_size(df: DataFrame) -> int:
    """Bytes of a grain as the optimiser knows them: its files' size, or the estimate of its plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pick_grain(needed: list[str], grains: dict[str, DataFrame], alias: str | None = None, filters=(),
               fallback: str = "cuentas") -> tuple[str, DataFrame]:
    """The smallest grain, by size, that holds every needed column.

    Rules: region/zona aliases read the point grain; a filter on the point column counts as a
    needed column, so it moves the query to a grain that has it. If the point grain lacks needed
    columns (grains written by an older spec), the account grain ``fallback`` is read instead
    when it holds them.
    """
    need = set(needed) | {c for c, _ in filters}
    holds = lambda name: name in grains and need <= set(grains[name].columns)
    if alias in FROM_POINT_GRAIN:
        point = FROM_POINT_GRAIN[alias]
        for name in (point, fallback):
            if holds(name):
                return name, grains[name]
    fits = [name for name in grains if holds(name)]
    if not fits:
        raise KeyError(f"no grain holds {sorted(need)}")
    name = min(fits, key=lambda n: (grain_size(grains[n]), n))
    return name, grains[name]
