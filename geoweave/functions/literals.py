"""Typed literals of a triple's object, and regular expressions in Python's dialect as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Datatype names in prefixed form.
INTEGER, DECIMAL, DATE, DATETIME, BOOLEAN, WKT = "xsd:integer", "xsd:decimal", "xsd:date", "xsd:dateTime", "xsd:boolean", "geo:wktLiteral"

# Patterns of typed literals. Checked in this order on the text as it is, the first that fits gives the type.
# (?U) and (?d) give classes and line ends the meaning that they have in Python.
RULES = (
    (r"(?Ud)^-?\d+$", INTEGER),
    (r"(?Ud)^-?\d+(\.\d+)?$", DECIMAL),
    (r"(?Ud)^(\d{2})\.(\d{2})\.(\d{4})$", DATE),
    (r"(?Ud)^(\d{4})/(\d{2})/(\d{2})$", DATE),
    (r"(?Ud)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z", DATETIME),
    (r"(?Ud)^\s*[Pp][Oo][Ii][Nn][Tt]\s*\(\s*(-)?\d+(\.\d+)?\s+(-)?\d+(\.\d+)?\s*\)\s*", WKT),
)
SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


@F.pandas_udf(StringType())
def _json(texts: pd.Series) -> pd.Series:
    return texts.map(json.dumps, na_action="ignore")


def json_string(c: Column) -> Column:
    """A JSON string in ASCII, non-ASCII as \\uXXXX. Printable ASCII without quotes and backslashes stays on the JVM's
    side (Python gets null for it); Python in Arrow batches writes the rest."""
    plain = c.rlike(r'^[ !#-\[\]-~]*\z')
    return F.when(plain, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(_json(F.when(~plain, c)))


def literal_type(c: Column) -> Column:
    """The datatype of a text, or null for a plain string."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(RULES):
        out = F.when(c.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def literal_value(c: Column) -> Column:
    """The lexical form: stripped, DD.MM.YYYY turned to YYYY/MM/DD."""
    return F.when(c.rlike(RULES[2][0]), F.regexp_replace(c, RULES[2][0], "$3/$2/$1")).otherwise(stripped(c))


def literal(c: Column) -> Column:
    """The Turtle form of a text as a typed literal; null gives the empty string literal."""
    kind = literal_type(c)
    quoted = json_string(literal_value(c))
    return F.when(c.isNull(), F.lit('""')).when(kind.isNull(), quoted).otherwise(F.concat(quoted, F.lit("^^"), kind))


def java_pattern(pattern: str) -> str:
    """A Python pattern for Java: named groups, and Unicode classes as in Python."""
    return "(?U)" + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)


def java_replacement(text: str) -> str:
    """A Python replacement for Java: \\g<name> and \\1 as ${name} and $1, other dollars and backslashes literal."""
    out, at = [], 0
    for m in re.finditer(r"\\g<(\w+)>|\\(\d)|\\(.)", text):
        out.append(text[at : m.start()].replace("$", r"\$"))
        if m[1]:
            out.append(f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}")
        else:
            out.append(f"${m[2]}" if m[2] else "\\\\" if m[3] == "\\" else m[3])
        at = m.end()
    return "".join([*out, text[at:].replace("$", r"\$")])


def substituted(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Python-dialect substitutions one after the other."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, java_pattern(pattern), java_replacement(replacement))
    return c


def local_name(c: Column) -> Column:
    """A text whose characters outside \\w are 0x and six hex digits of their code point."""
    esc = lambda x: F.when(x.rlike(r"(?U)^\w$"), x).otherwise(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.ascii(x))), 6, "0")))
    chars = F.regexp_extract_all(c, F.lit(r"(?s)(.)"), F.lit(1))
    return F.when(c.rlike(r"(?U)^\w*$"), c).otherwise(F.array_join(F.transform(chars, esc), ""))


def after(c: Column, mark: str) -> Column:
    """What follows the first mark; the empty string where it is absent."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).otherwise(F.when(c.isNotNull(), F.lit("")))
