"""Prefixes of a triple set, as an explicit immutable registry."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import urlparse

NAME = re.compile(r"\w+")


@dataclass(frozen=True, order=True)
class Prefix:
    prefix: str
    iri: str

    def __post_init__(self) -> None:
        at = urlparse(self.iri)
        if not NAME.fullmatch(self.prefix):
            raise ValueError(f"not a prefix: {self.prefix!r}")
        if at.scheme not in ("http", "https") or not at.netloc or not at.path.startswith("/"):
            raise ValueError(f"not an IRI with host and path: {self.iri!r}")


#: Namespaces of the vocabularies used.
COMMON = tuple(
    Prefix(*line.split())
    for line in """
dcat http://www.w3.org/ns/dcat#
dct http://purl.org/dc/terms/
election http://example.org/election/
foaf http://xmlns.com/foaf/0.1/
geo http://www.opengis.net/ont/geosparql#
gtfs http://vocab.gtfs.org/terms#
osmrel https://www.openstreetmap.org/relation/
rdf http://www.w3.org/1999/02/22-rdf-syntax-ns#
rdfs http://www.w3.org/2000/01/rdf-schema#
schema http://schema.org/
wd http://www.wikidata.org/entity/
xsd http://www.w3.org/2001/XMLSchema#
""".strip().splitlines()
)


@dataclass(frozen=True)
class Prefixes:
    known: frozenset[Prefix] = field(default_factory=lambda: frozenset(COMMON))

    def __post_init__(self) -> None:
        seen: dict[str, str] = {}
        for p in self.known:
            if seen.setdefault(p.prefix, p.iri) != p.iri:
                raise ValueError(f"prefix {p.prefix} has two IRIs")

    def add(self, *more: Prefix) -> Prefixes:
        return Prefixes(self.known | set(more))

    def lines(self) -> list[str]:
        return [f"@prefix {p.prefix}: <{p.iri}> ." for p in sorted(self.known)]
