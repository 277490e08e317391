"""Evaluation of queries: which forms run on which pairs of sets, timing with rules to stop, plans, statistics as files."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of a query, seconds after which it isn't repeated, seconds that it may take, pairs that forms
#: which compare all of them may have.
ITERATIONS, NO_REPEAT_AFTER_S, TIMEOUT_S, MOST_PAIRS = 10, 600.0, 86_400.0, 250_000_000
#: Forms of a search; those that compare all pairs are left out beyond MOST_PAIRS.
FORMS = {"grid": False, "bbox": False, "nested_loop": True}


@dataclass(frozen=True)
class Task:
    left: str
    right: str
    form: str
    pairs: int


def tasks(sizes: Mapping[str, int], forms: Mapping[str, bool] | None = None, most_pairs: int = MOST_PAIRS, same: bool = False) -> list[Task]:
    """Ordered pairs of different sets (same: each set with itself) in every form, those of all pairs up to a product of sizes."""
    names = sorted(sizes)
    both = [(a, a) for a in names] if same else [(a, b) for a in names for b in names if a != b]
    out = [Task(a, b, f, sizes[a] * sizes[b]) for a, b in both for f in (forms or FORMS)]
    return [t for t in out if not (forms or FORMS)[t.form] or t.pairs <= most_pairs]


def timed(spark: SparkSession, run: Callable[[], DataFrame], iterations: int = ITERATIONS, no_repeat_after_s: float = NO_REPEAT_AFTER_S, timeout_s: float = TIMEOUT_S, pause_s: float = 1.0) -> list[float]:
    """Seconds of each run, caches cleared between; a long run is the last, and beyond the timeout a run is cancelled (inf)."""
    import threading

    took: list[float] = []
    for _ in range(iterations):
        spark.catalog.clearCache()
        time.sleep(pause_s if took else 0)
        group = f"timed-{id(took)}-{len(took)}"
        spark.sparkContext.setJobGroup(group, "timed", interruptOnCancel=True)
        stop = threading.Timer(timeout_s, spark.sparkContext.cancelJobGroup, [group])
        stop.start()
        began = time.perf_counter()
        try:
            run().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        except Exception:
            if time.perf_counter() - began < timeout_s:
                raise
            took.append(float("inf"))
        finally:
            stop.cancel()
        if took[-1] > no_repeat_after_s:
            break
    return took


def summary(took: Sequence[float]) -> dict[str, float]:
    own = sorted(took)
    return {"n": len(own), "min": own[0], "median": statistics.median(own), "max": own[-1], "mean": statistics.fmean(own), "stdev": statistics.stdev(own) if len(own) > 1 else 0.0}


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What explain prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def write_stats(stats: DataFrame, path: str) -> None:
    """A table of statistics, one file each as CSV with a header and as JSON lines."""
    stats.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def write_model(spark: SparkSession, model: Mapping, path: str) -> None:
    """A linear model as CSV: a row per term with what holds for the whole model beside it."""
    rows = [(k, *map(float, (v["estimate"], v["std_error"], v["p"], model["r2"], model["r2_adjusted"], model["f"]))) for k, v in model["terms"].items()]
    spark.createDataFrame(rows, "term string, estimate double, std_error double, p double, r2 double, r2_adjusted double, f double").coalesce(1).write.mode("overwrite").csv(path, header=True)


def set_sizes(sets: Mapping[str, DataFrame]) -> dict[str, int]:
    return {k: df.agg(F.count("*")).first()[0] for k, df in sets.items()}
