"""Triple tables (s, p, o) and graph patterns over them.

A pattern compiles to one scan per triple with its constants as pushed filters and to equi-joins on
shared variables; wide tables are kept as they are where possible and unpivoted only for triples.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import natural

SHORT = {"a": "rdf:type"}
#: A literal's parts in its Turtle form: quoted text and datatype.
TURTLE = r'(?s)^"(.*)"(?:\^\^(\S+))?$'


def typed(triples: DataFrame) -> DataFrame:
    """Add kind (iri or lit), datatype, text and the value columns num, flag, day and time of the object.

    Numbers are joined on num: their texts may differ (leading zeros).
    """
    text, kind = F.regexp_extract("o", TURTLE, 1), F.regexp_extract("o", TURTLE, 2)
    is_lit = F.col("o").startswith('"')
    out = triples.withColumns({"kind": F.when(is_lit, F.lit("lit")).otherwise(F.lit("iri")), "datatype": F.when(is_lit & (kind != ""), kind), "text": F.when(is_lit, text).otherwise(F.col("o"))})
    of = lambda *k: F.col("datatype").isin(*k)
    return out.withColumns(
        {
            "num": F.when(of("xsd:integer", "xsd:decimal"), F.col("text").try_cast("double")),
            "flag": F.when(of("xsd:boolean"), F.col("text").try_cast("boolean")),
            "day": F.when(of("xsd:date"), F.to_date(F.try_to_timestamp("text", F.lit("yyyy/MM/dd")))),
            "time": F.when(of("xsd:dateTime"), F.col("text").try_cast("timestamp")),
        }
    )


def pattern(triples: DataFrame, s: str, p: str, o: str, value: str = "o") -> DataFrame:
    """Solutions of one triple pattern. ?x is a variable, [] anything, `a` the type predicate; value is the
    column that an object variable binds (o, num, text, ...)."""
    cond: list[Column] = []
    bind: list[Column] = []
    names: dict[str, str] = {}
    for term, col, shown in ((s, "s", "s"), (p, "p", "p"), (o, "o", value)):
        if term.startswith("?"):
            if term[1:] in names:  # the same variable twice in a pattern
                cond.append(F.col(names[term[1:]]) == F.col(shown))
            else:
                names[term[1:]] = shown
                bind.append(F.col(shown).alias(term[1:]))
        elif term != "[]":
            cond.append(F.col(col) == SHORT.get(term, term))
    out = triples.filter(reduce(lambda a, b: a & b, cond)) if cond else triples
    return out.select(*bind)


def bgp(triples: DataFrame, patterns: Sequence[tuple[str, ...]]) -> DataFrame:
    """Solutions of a basic graph pattern: natural joins, ordered so that each shares a variable with what is there."""
    left = [(set(x[1:] for x in q[:3] if x.startswith("?")), pattern(triples, *q)) for q in patterns]
    seen, out = left.pop(0)
    while left:
        k = next((i for i, (v, _) in enumerate(left) if v & seen), 0)
        v, df = left.pop(k)
        seen, out = seen | v, natural(out, df, cross=not v & seen)
    return out


def unpivoted(df: DataFrame, subject: Column, columns: dict[str, str], type_iri: str | None = None) -> DataFrame:
    """Triples of a wide table: one per cell that isn't null, objects as text, in one pass."""
    rows = [F.struct(subject.alias("s"), F.lit(p).alias("p"), F.col(f"`{c}`").cast("string").alias("o")) for c, p in columns.items()]
    if type_iri:
        rows.insert(0, F.struct(subject.alias("s"), F.lit("rdf:type").alias("p"), F.lit(type_iri).alias("o")))
    return df.select(F.explode(F.array(*rows)).alias("t")).select("t.*").filter("o is not null and o <> ''")
