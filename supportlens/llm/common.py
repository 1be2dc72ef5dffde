"""Column expressions and tables that several operators of this folder share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

#: White space that ends a word: blank, tab, newline, vertical tab, form feed, return.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. Texts without other letters take the faster built-in."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    mapped = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(only_ascii, F.lower(text)).otherwise(mapped)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, then ``columns``: no name can clash."""
    quoted = [name.replace("`", "``") for name in docs.columns]
    row = F.struct(*[F.col(f"`{name}`") for name in quoted]).alias("row")
    return docs.select(row, *columns)
