"""Delimited text: scans with all columns as strings, and rows as triples."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import literal, substituted
from ..staging import new_folder

Triples = list[tuple[Column, Column, Column]]
#: Extra triples of a row: gets the frame and the subject, gives (s, p, o) columns; a null object is no triple.
Extra = Callable[[DataFrame, Column], Triples]


@dataclass(frozen=True)
class TableSpec:
    """How a table becomes triples: names of predicates, the key, rules for values.

    columns: header to predicate, None drops the column. values: predicate to (rules, literal?), rules being
    Python-dialect substitutions or a function of a column; without literal the text is put as it is.
    """

    dataset: str
    prefix: str  # of subjects: the key (or a number) is appended
    key: str | None = None
    columns: Mapping[str, str | None] = field(default_factory=dict)
    values: Mapping[str, tuple[Sequence[tuple[str, str]] | Callable[[Column], Column], bool]] = field(default_factory=dict)
    separator: str = ","
    quote: str = '"'
    parent: str | None = None
    extra: Extra | None = None

    @property
    def namespace(self) -> str:
        return self.prefix.split(":")[0]

    def predicate(self, header: str) -> str | None:
        name = self.columns.get(header, header)
        if name is None:
            return None
        name = name if ":" in name else f"{self.namespace}:{name}"
        return name if re.fullmatch(r"(\w+:)?\w+", name) else f'"{name}"'

    def rule(self, header: str) -> tuple[Any, bool]:
        name = self.columns.get(header, header)
        return self.values.get(name, self.values.get(self.predicate(header), ((), True)))


def has_quoted_newlines(spark: SparkSession, path: str | list[str], quote: str) -> bool:
    """Whether a line holds an odd number of quotes, so that a cell may go on in the next."""
    return not spark.read.text(path).filter(F.length(F.regexp_replace("value", f"[^{re.escape(quote)}]", "")) % 2 == 1).isEmpty()


def read_table(spark: SparkSession, path: str | list[str], separator: str = ",", quote: str = '"', skip_lines: int = 0, decimal_comma: bool = False, multi_line: bool | None = None) -> DataFrame:
    """A delimited file with a header, every column as string; blank lines are skipped, short rows filled with null.

    skip_lines drops a preamble of each file before the header; decimal_comma removes dots between digits and turns
    commas between digits into dots in every cell. Files are split between tasks unless cells hold newlines;
    multi_line says whether they do, else it is looked up in a pass of its own.
    """
    if multi_line is None:
        multi_line = has_quoted_newlines(spark, path, quote)
    options = {"header": True, "sep": separator, "quote": quote, "escape": quote, "multiLine": multi_line, "mode": "PERMISSIVE", "encoding": "UTF-8"}
    if skip_lines:
        # the preamble and the header are cut off by file; the rest is parsed as text, quoted newlines and all
        whole = spark.read.text(path, wholetext=True)
        pattern = rf"^﻿?(?:[^\n]*\n){{{skip_lines}}}"
        bodies = whole.select(F.regexp_replace("value", pattern, "").alias("value"))
        folder = new_folder(spark, "without-preamble")
        bodies.write.text(f"{folder}/text", lineSep="\n")
        path = f"{folder}/text"
    out = spark.read.options(**options).csv(path)
    out = out.toDF(*[c.lstrip("﻿") for c in out.columns])
    if decimal_comma:
        clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?<=\d)\.(?=\d)", ""), r"(?<=\d),(?=\d)", ".")
        out = out.select(*[clean(F.col(f"`{c}`")).alias(c) for c in out.columns])
    return out


def mapped(c: Column, rules: Any) -> Column:
    return rules(c) if callable(rules) else substituted(c, rules)


def subject_of(df: DataFrame, spec: TableSpec) -> Column:
    """The key with its rules behind the prefix, or a number."""
    if spec.key is None:
        return F.concat(F.lit(spec.prefix + ("" if spec.prefix.endswith("_") else "_")), F.monotonically_increasing_id().cast("string"))
    return F.concat(F.lit(spec.prefix), mapped(F.col(f"`{spec.key}`"), spec.rule(spec.key)[0]))


def table_triples(df: DataFrame, spec: TableSpec, warn_unmapped: bool = False) -> DataFrame:
    """(s, p, o) of each row: its type, its parent, one per cell that isn't empty, and the extra ones.

    One pass over the table: the triples of a row are an array that is exploded.
    """
    if warn_unmapped and (missing := [c for c in df.columns if c not in spec.columns]):
        warnings.warn(f"{spec.dataset}: no mapping for {', '.join(missing)}", stacklevel=2)
    df = df.withColumn("__s", subject_of(df, spec))
    s = F.col("__s")
    found: Triples = [(s, F.lit("rdf:type"), F.lit(f"{spec.namespace}:{spec.dataset}"))]
    if spec.parent:
        found.append((s, F.lit("rdfs:member"), F.lit(spec.parent)))
    for name in df.columns:
        if name != "__s" and (p := spec.predicate(name)):
            cell, (rules, is_literal) = F.col(f"`{name}`"), spec.rule(name)
            value = mapped(cell, rules)
            found.append((s, F.lit(p), F.when(cell.isNotNull() & (cell != ""), literal(value) if is_literal else value)))
    found += spec.extra(df, s) if spec.extra else []
    rows = F.array(*[F.struct(a.alias("s"), b.alias("p"), c.alias("o")) for a, b, c in found])
    return df.select(F.explode(rows).alias("t")).select("t.*").filter("o is not null and s is not null")
