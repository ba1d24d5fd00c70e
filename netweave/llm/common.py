"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave import scratch

#: ASCII white space: space and the code points 9 to 13.
SPACE = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]+"


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def text_of(name: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order; an empty array if it has none."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts as text, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The row key as ``__row`` and the given columns alone, so that no other column of ``docs`` can clash."""
    docs = scratch.as_files(docs)
    name = free_name(docs, "__row")
    return scratch.with_row_key(docs, name).select(F.col(name).alias("__row"), *columns)


def join_back(docs: DataFrame, found: DataFrame, how: str = "inner") -> tuple[DataFrame, dict[str, Column]]:
    """``docs``, which read files, joined with ``found`` by its ``__row``; and the other columns of ``found``, by name, under names that ``docs`` does not use."""
    names = {c: free_name(docs, f"__found_{c}") for c in found.columns}
    key = free_name(docs, "__key")
    right = found.select(*[col(c).alias(n) for c, n in names.items()])
    rows = scratch.with_row_key(docs, key).join(right, F.col(key) == F.col(names["__row"]), how)
    return rows, {c: F.col(n) for c, n in names.items()}
