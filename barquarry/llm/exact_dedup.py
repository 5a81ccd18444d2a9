"""Exact dedup (native): 128-bit content hash, byte comparison, one row kept per text.

Only DataFrame functions.  Texts are grouped by the MD5 of their normalised form and,
inside a hash, by the bytes themselves: the text is a grouping key, so two texts that
share a hash fall into two classes.  The grouping is combined on the map side, so a
text that a third of the rows hold reaches the shuffle once per task.  Rows are then
joined back to their class by both hashes (16 and 32 bytes), never by text; skewed
classes are left to the skewed-join splitting of adaptive execution.

Defined results: null text counts as empty; a null id never stays beside one that is
not null, and a class with null ids only keeps all its rows; rows that repeat an id and
a text are counted in group_size and share one verdict; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, nothing else. lower() does the same, and faster, on texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def content_hash(text: Column) -> Column:
    """The 128-bit hash by which texts are grouped."""
    return F.unhex(F.md5(text.cast("binary")))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hashed=content_hash):
    """(rows, classes): rows(id, _h, _s) one per input row; classes(_h, _s, keep_id, group_size) one per different text."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_t")).withColumn("_h", hashed(F.col("_t")))
    choose = {"max": F.max, "min": F.min}[keep]
    sha = F.unhex(F.sha2(F.col("_t").cast("binary"), 256))
    rows = base.select("doc_id", "_h", sha.alias("_s"))
    by_bytes = base.groupBy("_h", "_t").agg(choose("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows, by_bytes.select("_h", sha.alias("_s"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hashed=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, classes = text_classes(docs, id_col, text_col, keep, hashed)
    return rows.join(classes, ["_h", "_s"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_s")).alias("text_sha256"),
    )


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    out = exact_dedup(docs, id_col, text_col, keep)
    dropped = out.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    gone = docs[id_col].eqNullSafe(dropped["_gone"]) & (sha == dropped["_sha"])
    return docs.join(dropped, gone, "left_anti")
