"""Election bundles: a JSON description of metadata and of the CSV and KML sets that belong to it."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import literal
from ..prefixes import Prefix, Prefixes
from .kml import kml_triples, read_kml
from .tables import TableSpec, read_table, table_triples

META = ("label", "countryname", "wikidata", "osm", "year", "date", "id_prefix")


@dataclass(frozen=True)
class Bundle:
    meta: dict[str, Any]
    prefixes: Prefixes
    csv: list[dict[str, Any]]
    kml: list[dict[str, Any]]
    folder: str

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        """Read a description from any file system; the prefix `election` and a label must be there."""
        raw = json.loads(spark.read.text(path, wholetext=True).first().value)
        given = [Prefix(p["prefix"], p["iri"]) for p in raw["prefixes"]]
        if not any(p.prefix == "election" for p in given):
            raise ValueError("the prefix election is missing")
        meta = raw["election"]
        if missing := [k for k in META if k not in meta]:
            raise ValueError(f"missing in election: {', '.join(missing)}")
        if not meta["label"]:
            raise ValueError("the election has no label")
        common = frozenset(p for p in Prefixes().known if p.prefix not in {g.prefix for g in given})
        return cls(meta, Prefixes(common).add(*given), raw.get("csv", []), raw.get("kml", []), path.rsplit("/", 1)[0])

    def _path(self, item: dict[str, Any]) -> str:
        return f"{self.folder}/{item['store_filename']}"

    def triples(self, spark: SparkSession, warn_unmapped: bool = False) -> DataFrame:
        """(s, p, o) of the metadata and all sets; each entity is a member of the election."""
        me = f"election:{self.meta['id_prefix']}{uuid.uuid4().hex}"
        rows = [(me, "rdf:type", "election:election", False), (me, "rdfs:label", str(self.meta["label"]), True)]
        rows += [(me, f"election:{k}", f"{p}:{self.meta[k]}", False) for k, p in (("wikidata", "wd"), ("osm", "osmrel")) if self.meta[k]]
        rows += [(me, f"election:{k}", str(self.meta[k]), True) for k in ("countryname", "date", "year") if self.meta[k]]
        about = spark.createDataFrame(rows, "s string, p string, o string, l boolean").select("s", "p", F.when(F.col("l"), literal(F.col("o"))).otherwise(F.col("o")).alias("o"))
        parts = [about]
        for item in self.kml:
            parts.append(kml_triples(read_kml(spark, self._path(item)), item["dataset"], f"{item['primary_prefix']}:", me))
        for item in self.csv:
            spec = TableSpec(item["dataset"], f"{item['primary_prefix']}:{self.meta['id_prefix']}", item.get("primary_col"), item.get("column_mapping", {}), {}, parent=me)
            df = read_table(spark, self._path(item), item.get("csv_separator", ","), item.get("csv_quote", '"'), item.get("skip_lines", 0), item.get("decimal_comma", False))
            parts.append(table_triples(df, spec, warn_unmapped))
        return reduce(DataFrame.union, parts)
