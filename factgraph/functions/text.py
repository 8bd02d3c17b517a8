"""Scalar functions over paths, names and bytes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """Lower case of A-Z alone; other letters stay."""
    return F.translate(x, _UPPER, _LOWER)


def contains_ascii(x: Column, part: str) -> Column:
    """Substring match that ignores the case of A-Z; no character of ``part`` is special."""
    return F.contains(ascii_lower(x), F.lit(part.translate(str.maketrans(_UPPER, _LOWER))))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def direct_child(path: Column, directory: str) -> Column:
    """A nonempty rest without another slash below ``directory``."""
    rest = F.substr(path, F.lit(len(directory) + 2))
    return F.startswith(path, F.lit(directory + "/")) & (F.length(rest) > 0) & ~F.contains(rest, F.lit("/"))


def names_suffix(lookup: Column, name: Column) -> Column:
    """The lookup is the name, or ends with it after ``::`` or a dot."""
    return (lookup == name) | F.endswith(lookup, F.concat(F.lit("::"), name)) | F.endswith(lookup, F.concat(F.lit("."), name))


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path that begin at a segment."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def framed_digest(*fields: Column) -> Column:
    """sha256 over fields, each preceded by its length in bytes, so that no two lists of fields meet."""
    parts = []
    for f in fields:
        x = F.coalesce(f.cast("string"), F.lit(""))
        parts += [F.octet_length(x).cast("string"), F.lit(":"), x]
    return F.sha2(F.concat(*parts), 256)


def weakest(x: Column, order: tuple[str, ...]) -> Column:
    """Aggregate: the weakest value, ``order`` going from strong to weak."""
    rank = F.lit(None).cast("int")
    for i, v in enumerate(order):
        rank = F.when(x == v, i).otherwise(rank)
    return F.element_at(F.array(*[F.lit(v) for v in order]), F.max(rank) + 1)
