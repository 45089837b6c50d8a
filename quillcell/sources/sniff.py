"""Format checks of a delimited matrix from its first lines and its field counts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillcell.operators.filters import MatrixError

# Candidate delimiters in the order in which ties resolve.
DELIMITERS = (" ", "\t", ",")
HEAD_LINES = 11
NUMBER = r"^[0-9]*\.?[0-9]*$"


@dataclass(frozen=True)
class Layout:
    delimiter: str
    header: bool
    id_cell: bool


def has_nul(content: Column) -> Column:
    """True where a NUL byte shows that the content is no text."""
    return F.contains(content.cast("binary"), F.unhex(F.lit("00")))


def delimiter_counts(lines: DataFrame) -> DataFrame:
    """One row: how often each candidate occurs in the lines."""
    names = {" ": "space", "\t": "tab", ",": "comma"}
    n = lambda d: F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))
    return lines.agg(*[F.coalesce(F.sum(n(d)), F.lit(0)).alias(names[d]) for d in DELIMITERS])


def guess_delimiter(head: DataFrame) -> str:
    counts = delimiter_counts(head).first()
    return DELIMITERS[max(range(3), key=lambda i: (counts[i], -i))]


def resolve_delimiter(option: str, head: DataFrame) -> str:
    return {"tab": "\t", "space": " "}.get(option) or guess_delimiter(head)


def all_numbers(fields: Column) -> Column:
    """True where every field is a non-negative decimal; signs and exponents count as text."""
    return F.forall(fields, lambda x: x.rlike(NUMBER) & x.rlike("[0-9]"))


def is_header(line: str, delimiter: str) -> bool:
    """A first line is a header unless every field is a non-negative decimal."""
    return not all(re.fullmatch(r"\d+\.?\d*|\.\d+", x) for x in line.split(delimiter))


def field_counts(lines: DataFrame, delimiter: str) -> DataFrame:
    """Lines per number of fields; a sound matrix has one row."""
    fields = F.size(F.split("value", _literal(delimiter)))
    return lines.filter("value <> ''").groupBy(fields.alias("fields")).agg(F.count("*").alias("lines"))


def _literal(delimiter: str) -> str:
    return "\\Q" + delimiter + "\\E"


def sniff(lines: DataFrame, delimiter: str = "auto", header: str = "auto") -> Layout:
    """Layout from the head of the file; two header fields short of the data is not accepted."""
    head = lines.limit(HEAD_LINES)
    first = [r["value"] for r in head.take(2)]
    if not first or not "".join(first):
        raise MatrixError("the file is empty")
    sep = resolve_delimiter(delimiter, head)
    has = is_header(first[0], sep) if header == "auto" else header == "yes"
    id_cell = len(first) < 2 or len(first[0].split(sep)) == len(first[1].split(sep))
    return Layout(sep, has, id_cell)


def check_columns(lines: DataFrame, layout: Layout) -> None:
    """Raise unless all data lines have one number of fields and the header fits it."""
    body = lines
    width = None
    if layout.header:
        first = lines.first()["value"]
        width = len(first.split(layout.delimiter))
        body = lines.filter(F.col("value") != first)
    if lines.filter(F.contains("value", F.lit("\0"))).limit(1).count():
        raise MatrixError("the file is binary")
    counts = [r["fields"] for r in field_counts(body, layout.delimiter).orderBy("fields").limit(3).collect()]
    if len(counts) > 1 or (counts and width is not None and width not in (counts[0], counts[0] - 1)):
        raise MatrixError(f"lines differ in their number of fields: {counts}")
