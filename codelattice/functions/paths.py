"""Path and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source extensions by language, and folders a corpus scan leaves out.
EXTENSION_LANGUAGE = {
    ".go": "go",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mts": "typescript",
    ".cts": "typescript",
}
PRUNED_FOLDERS = ("node_modules", "target", "build")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Folder of a path; ``.`` for a bare name and ``/`` for a file in the root."""
    cut = F.length(path) - F.length(base_name(path))
    return (
        F.when(cut == 0, F.lit("."))
        .when(cut == 1, F.lit("/"))
        .otherwise(F.substr(path, F.lit(1), cut - F.lit(1)))
    )


def extension(path: Column) -> Column:
    """Lower-case suffix from the last dot of the file name, dot included; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    """Language by extension, NULL where no language is known."""
    table = F.create_map(*[F.lit(x) for pair in EXTENSION_LANGUAGE.items() for x in pair])
    return F.element_at(table, extension(path))


def pruned_below(root: str, path: Column, hidden_only: bool = False) -> Column:
    """True if a folder between ``root`` and the file is one a scan skips."""
    names = [r"\.[^/]*"] if hidden_only else [r"\.[^/]*", *PRUNED_FOLDERS]
    below = F.substr(path, F.lit(len(root.rstrip("/")) + 1))
    return F.rlike(below, F.lit("/(" + "|".join(names) + ")/"))


def _folded(path: Column) -> Column:
    """Segments with ``..`` resolved; above the root of an absolute path there is nothing, a relative one keeps its ``..``."""
    absolute = F.startswith(path, F.lit("/"))

    def step(done, name):
        up = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        back = F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(absolute, done).otherwise(F.concat(done, F.array(name)))
        return F.when(name == "..", back).otherwise(F.concat(done, F.array(name)))

    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def normalised(path: Column) -> Column:
    """Collapse ``//`` and ``/./``, resolve ``..`` and drop a trailing slash."""
    clean = ~F.rlike(path, F.lit(r"//|/\./|/\.?$|(^|/)\.\.(/|$)"))  # most paths are, at the cost of one pattern
    return F.when(clean, path).when(F.rlike(path, F.lit(r"(^|/)\.\.(/|$)")), _folded(path)).otherwise(_collapsed(path))


def _collapsed(path: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"/{2,}", "/")
    return F.when(flat == "/", flat).otherwise(F.regexp_replace(flat, r"(/\.?)$", ""))


def within(path: Column, root: str) -> Column:
    """True if the path is ``root`` or lies below it."""
    clean = normalised(path)
    bound = root.rstrip("/")
    return (clean == bound) | F.startswith(clean, F.lit(bound + "/"))


def file_uri(path: Column) -> Column:
    """``file://`` URI with percent-encoding; slashes stay as they are."""
    coded = F.url_encode(path)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%24", "$"), ("%26", "&"),
                     ("%2B", "+"), ("%3D", "="), ("%7E", "~"), ("%2C", ","), ("%3B", ";")):
        coded = F.replace(coded, F.lit(old), F.lit(new))
    return F.concat(F.lit("file://"), coded)


def class_of_label(label: Column) -> Column:
    """Text before the first dot; the whole label if there is no dot or it comes first."""
    return F.when(F.instr(label, ".") > 1, F.substring_index(label, ".", 1)).otherwise(label)


def planned_file_path(directory: Column, label: Column) -> Column:
    """File a planned node is shown under: ``(directory or 'virtual')/Class.virtual``."""
    folder = F.when(F.coalesce(directory, F.lit("")) == "", F.lit("virtual")).otherwise(directory)
    return F.concat(folder, F.lit("/"), F.substring_index(label, ".", 1), F.lit(".virtual"))


def ancestors(path: Column) -> Column:
    """Array of ``struct(depth, path, name)`` for a path's prefixes, shortest first.

    Empty segments are dropped; the path itself is the last element.
    """
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    whole = F.transform(
        parts,
        lambda s, i: F.struct(
            (i + 1).alias("depth"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("path"), s.alias("name")
        ),
    )
    return whole
