"""Declarative composition of spatial searches into one DataFrame plan.

A shard is a named builder of points (id, lon, lat, ...). A configuration lists searches: left shards,
right shards with payload, limits, and aggregates per pair; all results are joined on the keys.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import with_table_count
from ..operators.spatial_join import ALL, spatial_join, stored

Shards = Mapping[str, Callable[[], DataFrame]]
ALGORITHMS = {"baseline": "nested_loop", "s2": "auto", "boundingBox": "bbox"}
MAX_ROUNDS = 100


def cleaned(name: str) -> str:
    """A shard's file or path as a variable name."""
    return re.sub(r"\W+", "_", Path(name).stem).strip("_")


def chunks(items: Sequence[Any], n: int | None) -> list[Sequence[Any]]:
    """Groups of n; one group for 0 or None."""
    return [items[i : i + n] for i in range(0, len(items), n)] if n else [items]


@dataclass(frozen=True)
class SearchLimits:
    algorithm: str = "s2"
    max_distance: float | None = None
    nearest: int | None = None

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm}")
        for v in (self.max_distance, self.nearest):
            if v is not None and v < 0:
                raise ValueError("limits must not be negative")
        if not (self.max_distance or self.nearest):
            raise ValueError("a search needs a positive distance or number of neighbours")

    def __str__(self) -> str:
        parts = [f"numNearestNeighbors{self.nearest}" if self.nearest else "", f"maxDist{self.max_distance:g}" if self.max_distance else ""]
        return "_".join(filter(None, parts))

    def join(self, left: DataFrame, right: DataFrame, dist: str, payload: Sequence[str] | str) -> DataFrame:
        return spatial_join(left, right, k=self.nearest or None, max_distance_m=self.max_distance or None, left_id="id", right_id="id", payload=payload, left_columns=(), dist_col=dist, strategy=ALGORITHMS[self.algorithm])


@dataclass(frozen=True)
class RightShard:
    shard: str
    payload: tuple[str, ...] = ()

    @property
    def carried(self) -> tuple[str, ...] | str:
        return ALL if ALL in self.payload or "spatialSearch:all" in self.payload else self.payload


@dataclass(frozen=True)
class SpatialSearch:
    """left and right shards, limits, and selectors: output column pattern -> aggregate over dist, count and payload.

    Selectors may have %DIST%, %COUNT% and %NAME%; they are Spark SQL aggregates. group_by: columns of the
    left shard. keep_unmatched keeps left rows without a partner (their aggregates see null).
    """

    left: tuple[str, ...]
    right: tuple[RightShard, ...]
    limits: SearchLimits
    selectors: tuple[tuple[str, str], ...] = (("avg_dist_%NAME%", "avg(%DIST%)"),)
    group_by: tuple[str, ...] = ()
    group_size: int | None = None
    include_count: bool = False
    keep_unmatched: bool = False
    name_template: str = "%LEFT%_%RIGHT%"

    def __post_init__(self) -> None:
        if not self.left or not self.right:
            raise ValueError("a search needs a left and a right shard")

    def name(self, left: str, right: str) -> str:
        n = self.name_template.replace("%LEFT%", cleaned(left) if len(self.left) > 1 else "").replace("%RIGHT%", cleaned(right)).replace("%CONFIG%", str(self.limits))
        return n.strip("_")

    def single(self, shards: Shards, left: str, right: RightShard) -> tuple[str, DataFrame, list[tuple[str, str]]]:
        """(name, pairs joined to the left's keys, aggregates)."""
        name = self.name(left, right.shard)
        a, b = shards[left](), shards[right.shard]()
        dist, count = f"dist_{name}", f"count_{name}"
        if self.include_count:
            b = with_table_count(b, count)
        carried = right.carried if right.carried == ALL else (*right.carried, *([count] if self.include_count else []))
        found = self.limits.join(a, b, dist, carried).drop("left_lon", "left_lat", "right_lon", "right_lat").withColumnRenamed("left_id", "id").withColumnRenamed("right_id", f"id_{name}")
        keys = a.select("id", *self.group_by)
        fill = lambda t: t.replace("%DIST%", f"`{dist}`").replace("%COUNT%", f"`{count}`").replace("%NAME%", name)
        return name, keys.join(found, "id", "left" if self.keep_unmatched else "inner"), list(dict.fromkeys((fill(c), fill(e)) for c, e in self.selectors))

    def dataframe(self, shards: Shards) -> DataFrame:
        """One row per group (or one in all): the aggregates of every pair, groups of right shards stored between."""
        parts: list[DataFrame] = []
        for left in self.left:
            for group in chunks(self.right, self.group_size):
                found = []
                for right in group:
                    _, pairs, select = self.single(shards, left, right)
                    found.append(pairs.groupBy(*self.group_by).agg(*[F.expr(e).alias(c) for c, e in select]))
                one = joined(found, self.group_by)
                parts.append(stored(one) if self.group_size else one)
        return joined(parts, self.group_by)


def joined(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys)) if keys else a.crossJoin(F.broadcast(b)), parts)  # without keys each is one row


@dataclass(frozen=True)
class ReplaceRule:
    search: str
    replace: str | None = None
    replace_file: str | None = None

    def __post_init__(self) -> None:
        if (self.replace is None) == (self.replace_file is None):
            raise ValueError("exactly one of replace and replace_file must be given")

    def text(self, files: Mapping[str, str]) -> str:
        return self.replace if self.replace is not None else files[self.replace_file].replace("\\", "\\\\")


@dataclass(frozen=True)
class Template:
    """Text with replacement rules that are applied again and again until nothing changes."""

    text: str
    rules: tuple[ReplaceRule, ...] = ()

    def render(self, files: Mapping[str, str] | None = None, **parts: str) -> str:
        out = self.text
        for k, v in parts.items():
            out = out.replace(f"%{k.upper()}%", v)
        for _ in range(MAX_ROUNDS):
            before = out
            for r in self.rules:
                out = re.sub(r.search, r.text(files or {}), out)
            if out == before:
                return out
        raise RecursionError("the replacement rules don't come to an end")


def indented(text: str, width: int = 2) -> str:
    """Lines indented by the braces and brackets that are open."""
    out, depth = [], 0
    for line in (x.strip() for x in text.splitlines()):
        code = re.sub(r'"[^"]*"|<[^>\s]*>|#.*', "", line)
        lead = len(re.match(r"[)}\]]*", code)[0])
        out.append((" " * (width * max(0, depth - lead)) + line).rstrip())
        depth += sum(c in "({[" for c in code) - sum(c in ")}]" for c in code)
    return "\n".join(out)


@dataclass(frozen=True)
class ProvidedValues:
    """Values given to a variable from outside. In a query of its own name the variable is called <query>_<variable>_,
    so several queries can be given values side by side."""

    variable: str
    values: tuple[str, ...]

    def name(self, query: str) -> str:
        return f"{query}_{self.variable}_"

    def text(self, query: str, body: str) -> str:
        """The query's text with the variable renamed and an inline table before it, where it occurs; else as it is."""
        old, new = f"?{self.variable}", f"?{self.name(query)}"
        if old not in body:
            return body
        return f"VALUES {new} {{ {' '.join(self.values)} }}\n" + body.replace(old, new)

    def applied(self, df: DataFrame, query: str) -> DataFrame:
        """Solutions joined with the inline table, the variable renamed; a value given twice counts twice. Without the
        variable as they are."""
        if self.variable not in df.columns:
            return df
        given = df.sparkSession.createDataFrame([(v,) for v in self.values], f"`{self.name(query)}` string")
        return df.withColumnRenamed(self.variable, self.name(query)).join(F.broadcast(given), self.name(query))


@dataclass(frozen=True)
class QueryConfig:
    searches: tuple[SpatialSearch, ...]
    keys: tuple[str, ...] = ()
    finish: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if not self.searches:
            raise ValueError("a query needs a search")

    @classmethod
    def load(cls, raw: Mapping[str, Any]) -> QueryConfig:
        """From the JSON form: spatial_searches with left, right, config, selectors and options."""
        searches = []
        for s in raw["spatial_searches"]:
            c = s["spatial_search_config"]
            limits = SearchLimits(c.get("algorithm") or "s2", c.get("maxDistance"), c.get("numNearestNeighbors"))
            right = tuple(RightShard(r["file"], tuple(r.get("payload") or ())) for r in s["right"])
            more = {k: s[k] for k in ("group_size", "include_count", "keep_unmatched", "name_template") if k in s}
            if "selectors" in s:
                more["selectors"] = tuple((c, e) for c, e in s["selectors"].items())
            searches.append(SpatialSearch(tuple(s["left"]), right, limits, group_by=tuple(raw.get("keys", ())), **more))
        return cls(tuple(searches), tuple(raw.get("keys", ())))

    def to_dataframe(self, shards: Shards) -> DataFrame:
        out = joined([s.dataframe(shards) for s in self.searches], self.keys)
        return self.finish(out) if self.finish else out


def load_files(path: str) -> dict[str, str]:
    """Texts of all files in a folder or a zip, by relative path."""
    p = Path(path)
    if p.is_dir():
        return {str(f.relative_to(p)): f.read_text(encoding="utf-8") for f in sorted(p.rglob("*")) if f.is_file()}
    with zipfile.ZipFile(p) as z:
        return {n: z.read(n).decode() for n in z.namelist() if not n.endswith("/")}


def find_configs(files: Mapping[str, str]) -> dict[str, Any]:
    return {n: json.loads(t) for n, t in files.items() if n.endswith("_compose.json")}

