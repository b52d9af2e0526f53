"""Sequences as strings, on built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codons that begin and end a coding sequence.
START_CODON = "ATG"
STOP_CODONS = ("TAA", "TGA", "TAG")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def has_start(seq: Column) -> Column:
    return F.upper(F.substring(seq, 1, 3)) == START_CODON


def has_stop(seq: Column) -> Column:
    return F.upper(F.right(seq, F.lit(3))).isin(*STOP_CODONS)


def protein_flags(seq: Column) -> dict[str, Column]:
    """starts with M; holds a stop; is cut by a stop before its end, unless only stops follow; and the
    sequence up to the first stop."""
    at = F.instr(seq, "*")
    return {
        "init": F.startswith(seq, F.lit("M")),
        "term": at > 0,
        "truncated": (at > 0) & ~seq.rlike(r"^[^*]*\*+$"),
        "trimmed": F.when(at > 0, F.substring_index(seq, "*", 1)).otherwise(seq),
    }


def chromosome_name(raw: Column, pad: int = 2, prefix: str = "chr") -> Column:
    """chr01 from the first digits as a number, else chr_ and the cleaned text."""
    raw = F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    number = F.regexp_extract(raw, "([0-9]+)", 1).try_cast("int").cast("string")
    padded = F.when(F.length(number) < pad, F.lpad(number, pad, "0")).otherwise(number)
    return F.when(number.isNotNull(), F.concat(F.lit(prefix), padded)).otherwise(F.concat(F.lit(f"{prefix}_"), F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "_")))


def chromosome_order(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, "([0-9]+)", 1).try_cast("double"), F.lit(1e9))
