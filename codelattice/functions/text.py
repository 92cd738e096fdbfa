"""Text expressions: lines, offsets, counts, normal forms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelattice.functions.rules import FAMILIES


# White space as Unicode defines it.
SPACE = "[\\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EDGE_SPACE = f"^{SPACE}+|{SPACE}+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def lines(text: Column) -> Column:
    """Array of lines; one trailing newline does not make a line."""
    parts = F.split(text, "\n", -1)
    return F.when(F.endswith(text, F.lit("\n")) | (text == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def count_of(text: Column, *needles: str) -> Column:
    """Non-overlapping occurrences of any of ``needles``."""
    return F.regexp_count(text, F.lit("|".join(re.escape(n) for n in needles)))


def normalise_whitespace(text: Column) -> Column:
    """Trim each line and drop blank ones; spaces inside a line stay.

    That is: white space after a line break goes with it, and read from the end, so does what stands before one. The ends count as breaks.
    """
    def cut(t):
        return F.regexp_replace(t, f"\\n{SPACE}*+", "\n")

    both = F.reverse(cut(F.reverse(cut(F.concat(F.lit("\n"), text, F.lit("\n"))))))
    return F.substr(both, F.lit(2), F.length(both) - 2)


def first_line_signature(text: Column, limit: int = 200) -> Column:
    """First line, trimmed, cut at ``limit`` characters with ``...``."""
    return shortened(trimmed(F.substring_index(text, "\n", 1)), F.lit(limit))


def shortened(line: Column, limit: Column) -> Column:
    return F.when(F.length(line) > limit, F.concat(F.substr(line, F.lit(1), limit), F.lit("..."))).otherwise(line)


def line_at(text: Column, offset: Column) -> Column:
    """0-based line of a 0-based character offset."""
    return count_of(F.substr(text, F.lit(1), offset), "\n")


def character_at(text: Column, offset: Column) -> Column:
    """0-based character within its line of a 0-based character offset."""
    return F.length(F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1))


# Comment forms, by language.
COMMENTS = {
    "java": r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/",
    "go": r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/",
    "typescript": r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/",
    "python": r"#[^\n]*",
}
TOKEN = r"\"(?:[^\"\\\n]|\\.)*\"|\w+|[^\w\s]"


def body_hash(body: Column, language: str) -> Column:
    """SHA-256 of the tokens of a body without comments; that of the empty text where there is none."""
    return token_hash(F.regexp_replace(F.coalesce(body, F.lit("")), COMMENTS[language], " "))


def token_hash(code: Column) -> Column:
    """SHA-256 of the tokens of ``code``, a blank between them; what is no token is white space."""
    spaced = F.regexp_replace(F.regexp_replace(code, r"^\s+", ""), rf"({TOKEN})\s*+", "$1 ")
    return F.sha2(F.rtrim(spaced), 256)


def by_language(language: Column, make) -> Column:
    """``make(rule set)`` for the row's language; NULL for one that is not known."""
    out = F
    for name, served in FAMILIES.items():
        out = out.when(language.isin(*served), make(name))
    return out


def split_params(params: Column) -> Column:
    """Array of parameters cut at the commas outside all brackets, trimmed, empty ones dropped.

    Cut at all commas first; pieces are put together again while a bracket is open.
    """
    opened, closed = ("(", "[", "{", "<"), (")", "]", "}", ">")
    flat = F.replace(F.coalesce(params, F.lit("")), F.lit("\n"), F.lit(" "))
    pieces = F.split(flat, ",")

    def walk(depth, piece):
        """Brackets open after ``piece``; one that closes nothing does not count."""
        marks = F.regexp_extract_all(piece, F.lit(r"[()\[\]{}<>]"), F.lit(0))
        return F.aggregate(marks, depth, lambda d, ch: F.when(ch.isin(*opened), d + 1).when(ch.isin(*closed), F.greatest(d - 1, F.lit(0))).otherwise(d))

    def step(acc, piece):
        mark = F.when(acc["depth"] == 0, F.lit("\n")).otherwise(F.lit(","))
        return F.struct(walk(acc["depth"], piece).alias("depth"), F.concat(acc["out"], mark, piece).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    folded = F.split(F.aggregate(pieces, start, step, lambda acc: acc["out"]), "\n")
    # Without brackets all commas separate.
    cut = F.when(F.rlike(flat, F.lit(r"[(\[{<]")), folded).otherwise(pieces)
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def _bare(token: Column) -> Column:
    """A parameter without stars, dots, modifiers and default."""
    t = F.regexp_replace(F.trim(token), r"^(\*+|\.\.\.|readonly |final )", "")
    return F.trim(F.substring_index(t, "=", 1))


def param_name(token: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.substring_index(_bare(token), ":", 1)), r"\?$", ""))


def annotated_type(token: Column) -> Column:
    """Type of a ``name: type`` parameter without spaces; ``_`` where none is given."""
    bare = _bare(token)
    at = F.instr(bare, ":")
    kind = F.regexp_replace(F.substr(bare, at + F.lit(1)), r"\s+", "")
    return F.when((at > 0) & (kind != ""), kind).otherwise(F.lit("_"))


def param_types(params: Column, language: str, member: bool = False) -> Column:
    """Types of a parameter list, as they appear in a symbol name."""
    return types_of(typed_params(split_params(params)), language, member)


def typed_params(params: Column) -> Column:
    """Parameters without the bare marks that Python's lists may hold."""
    return F.filter(params, lambda p: ~p.isin("*", "/"))


def types_of(tokens: Column, language: str, member: bool = False) -> Column:
    if language == "java":
        return F.transform(tokens, lambda p: F.regexp_replace(F.regexp_extract(_bare(p), r"^(.*\S)\s+\S+$", 1), r"\s+", ""))
    if language == "go":
        return F.transform(tokens, lambda p: F.regexp_replace(F.trim(F.regexp_extract(p, r"^\s*\S+\s+(.+)$", 1)), r"\s+", ""))
    if language == "python" and member:
        first = param_name(F.get(tokens, F.lit(0)))
        tokens = F.when(first.isin("self", "cls"), F.slice(tokens, F.lit(2), F.size(tokens))).otherwise(tokens)
    return F.transform(tokens, annotated_type)
