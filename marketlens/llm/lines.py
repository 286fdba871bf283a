"""Native pieces shared by the two line operators: normalised lines and their hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]"
WHITE = r"[\x20\x09-\x0D]+"


def normal_line(line: Column) -> Column:
    """A line in lower case, white space made single spaces and trimmed."""
    return F.lower(F.trim(F.regexp_replace(line, WHITE, " ")))


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text that hold a word, in order."""
    return F.filter(F.transform(F.split(text, "\n", -1), normal_line), lambda x: x != "")


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normalised form has one of ``hashes``."""
    return F.array_join(F.filter(
        F.split(text, "\n", -1), lambda x: ~F.array_contains(hashes, F.xxhash64(normal_line(x)))), "\n")


def n_marked_lines(text: Column, hashes: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.array_contains(hashes, F.xxhash64(normal_line(x)))))
