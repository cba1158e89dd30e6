"""Reports: one folder per output, row counts taken while writing, failures kept apart."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Written:
    name: str
    path: str
    rows: int | None
    error: str | None = None


def write_table(frame: DataFrame, path: str, fmt: str = "parquet", **options: str) -> Written:
    """One table. Rows are counted by the write itself, not by a second run."""
    return _write(frame, os.path.basename(path), path, fmt, (), options)


def write_report(
    outputs: dict[str, DataFrame],
    folder: str,
    fmt: str = "parquet",
    partition_by: tuple[str, ...] = (),
    sort_within: tuple[str, ...] = (),
) -> list[Written]:
    """One folder per output, partitioned by the given columns where an output has them, nulls last.

    Rows are clustered by the partition columns before the write, so that a task does not open a
    file for every partition; a partition column with few values is spread over many tasks by
    the rebalance hint, which splits large ones.
    """
    done = []
    for name, frame in outputs.items():
        keys = tuple(c for c in partition_by if c in frame.columns)
        if keys:
            frame = frame.hint("rebalance", *[F.col(k) for k in keys])
        sort = [F.col(c).asc_nulls_last() for c in (*keys, *sort_within) if c in frame.columns]
        if sort:
            frame = frame.sortWithinPartitions(*sort)
        done.append(_write(frame, name, os.path.join(folder, name), fmt, keys, {}))
    return done


def export_all(queries: dict[str, DataFrame | Callable[[], DataFrame]], folder: str, at_once: int = 4) -> list[Written]:
    """CSV per query with header, ``at_once`` of them side by side, results in the order given.

    Each export runs in a thread of its own and its jobs carry a tag of their own. One that fails is
    reported, whatever jobs it still has are cancelled by its tag, and the others go on. A query may be given
    as a function: it is then planned in its thread, and a failure to plan it is its own too.
    """
    if not queries:
        return []
    run = uuid.uuid4().hex
    with ThreadPoolExecutor(max_workers=max(1, at_once), thread_name_prefix="export") as pool:
        waiting = [pool.submit(_export, name, query, os.path.join(folder, name), f"export-{run}-{i}") for i, (name, query) in enumerate(queries.items())]
        return [future.result() for future in waiting]


def _export(name: str, query: DataFrame | Callable[[], DataFrame], path: str, tag: str) -> Written:
    context = None
    try:
        frame = query() if callable(query) else query
        context = frame.sparkSession.sparkContext
        context.addJobTag(tag)
        return _write(frame, name, path, "csv", (), {"header": "true"})
    except Exception as error:  # noqa: BLE001 - the point is to go on
        if context is not None:
            context.cancelJobsWithTag(tag)
        return Written(name, path, None, (str(error).splitlines() or [type(error).__name__])[0])
    finally:
        if context is not None:
            context.removeJobTag(tag)


def _write(frame: DataFrame, name: str, path: str, fmt: str, keys: tuple[str, ...], options: dict) -> Written:
    seen = Observation(f"rows_{name}")
    writer = frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt)
    if options:
        writer = writer.options(**options)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.save(path)
    return Written(name, path, seen.get["rows"])
