"""Column helpers shared by the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idlens.session import shared_dir

#: Runs of anything but ASCII white space.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, pattern: str = PLAIN_WORD) -> Column:
    """The words of a text in order; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared checkpoint folder, which
    outlives the executors, and later steps read them from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: Column) -> Column:
    """One third of the ids; classifiers never learn from their rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
