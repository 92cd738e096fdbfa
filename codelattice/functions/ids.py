"""Identity rules. Other rows refer to these values, so they are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SEPARATOR = "::"


def path_id(path: Column) -> Column:
    """Id of a file or directory: first 16 hex digits of the SHA-256 of its path."""
    return F.substring(F.sha2(path, 256), 1, 16)


def symbol_id(file_path: Column, name: Column, kind: Column, signature: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", file_path, name, kind, signature), 256)
    return F.concat(F.lit("sym_"), F.substring(digest, 1, 32))


def edge_id(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(EDGE_SEPARATOR), target)


def edge_source(eid: Column) -> Column:
    """Text before the first separator; NULL where the id has none."""
    return F.when(F.instr(eid, EDGE_SEPARATOR) > 0, F.substring_index(eid, EDGE_SEPARATOR, 1))


def edge_target(eid: Column) -> Column:
    start = F.instr(eid, EDGE_SEPARATOR)
    return F.when(start > 0, F.substr(eid, start + F.lit(len(EDGE_SEPARATOR))))
