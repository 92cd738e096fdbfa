"""Cutting files into units and reading symbols and calls off them.

Everything works inside a row, on the array of a text's lines, so these jobs read a text once and have no
shuffle. The rules are line patterns, not a parser: a block starts at a line that matches and ends there if
that line closes its braces, else at the first later line that closes it at the same indent. Where none does,
it ends before the next block with no more indent. Python's blocks end before the first line with no more indent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import ids, paths, text
from codelattice.functions.rules import (
    BODY_ON_HEADER, CLASS_LINE, DECLARATION, FAMILIES, FAST_CALL, FIELD_LINE, GO_RECEIVER, NEEDED, NOT_CALLED, STATEMENT_START, STATEMENTS, TYPED, UNIT_LINE, VALUE_LINE, indent_once,
)
from codelattice.operators.skew import first_per_key, skew_join

FIELD = "array<struct<owner:string,line_no:int,end_line:int,header:string,names:array<string>>>"


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, even when a lambda uses them many times."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def explode_lines(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``key, line_no, line``, counting from 1."""
    rows = df.select(key, F.posexplode(text.lines(F.col(column))).alias("pos", "line"))
    return rows.select(key, (F.col("pos") + 1).alias("line_no"), "line")


def let(value: Column, make) -> Column:
    """``make(value)`` with ``value`` computed once, also inside a lambda, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))


def _any_of(line: Column, needles) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | F.contains(line, F.lit(needle))
    return out


def _numbered() -> Column:
    return F.transform("lines", lambda s, i: F.struct((i + 1).alias("line_no"), s.alias("header")))


def _headers(language: str) -> Column:
    """Array of block header lines of ``lines``: ``line_no, name, params, header, is_class, indent``."""
    unit, klass, value = (indent_once(p) for p in (UNIT_LINE[language], CLASS_LINE[language], VALUE_LINE.get(language, "")))

    def bare(s):
        return F.rlike(s, F.lit(r";\s*$")) & ~F.contains(s, F.lit("{")) if language == "java" else F.lit(False)

    def first(s, kind, pattern):
        """Group 1 of ``pattern``, which is never empty where it matches; tried only where the line has the words it needs."""
        if not pattern:
            return F.lit("")
        needed = F.lit(True)
        for needles in NEEDED[language][kind]:
            needed = needed & _any_of(s, needles)
        if language == "java" and kind == "unit":
            # Most lines with a parenthesis are calls; a unit's pattern, tried on one, goes back and forth for long.
            # Before the parenthesis of a unit stands no "=", but in an annotation.
            needed = needed & (~F.contains(F.substring_index(s, "(", 1), F.lit("=")) | F.contains(s, F.lit("@"))) & (~bare(s) | F.rlike(s, F.lit(indent_once(TYPED))))
        return F.when(needed, F.regexp_extract(s, pattern, 1)).otherwise(F.lit(""))

    def names(x):
        s = x["header"]
        return F.struct(
            x["line_no"].alias("line_no"), s.alias("header"), first(s, "class", klass).alias("klass"), first(s, "unit", unit).alias("unit"),
            first(s, "value", value).alias("value"))

    def opening(x):
        name = F.when(x["unit"] != "", x["unit"]).otherwise(x["value"])
        return (x["klass"] != "") | ((name != "") & ~name.isin(*STATEMENTS))

    def parts(x):
        s, of_value = x["header"], F.lit("")
        if value:
            of_value = F.when(x["value"] != "", F.regexp_extract(s, value, 2)).otherwise(F.lit(""))
        of_unit = F.when(x["unit"] != "", F.regexp_extract(s, unit, 2)).otherwise(F.lit(""))
        return F.struct(
            x["line_no"].alias("line_no"), F.when(x["klass"] != "", x["klass"]).when(x["unit"] != "", x["unit"]).otherwise(x["value"]).alias("name"),
            let(of_unit, lambda p: F.when(p != "", p).otherwise(of_value)).alias("params"), s.alias("header"), (x["klass"] != "").alias("is_class"),
            bare(s).alias("bare"), _indent(s).alias("indent"))

    words = sorted({word for kind in NEEDED[language].values() for needles in kind[:1] for word in needles})

    def worth(s):
        return _any_of(s, words) & ~F.rlike(s, F.lit(indent_once(STATEMENT_START)))

    # Numbers of the few lines worth a look, and then those lines: a struct for every line would be copied at each step.
    numbers = F.array_compact(F.transform("lines", lambda s, i: F.when(worth(s), i + 1)))
    likely = F.transform(numbers, lambda n: F.struct(n.alias("line_no"), F.element_at("lines", n).alias("header")))
    return F.transform(F.filter(F.transform(likely, names), opening), parts)


def _indents() -> Column:
    """Indent of each of ``lines``, NULL for a blank one."""
    return F.transform("lines", lambda s: F.when(F.trim(s) != "", _indent(s)))


def _end_line(h: Column, following: Column, indents: Column | None) -> Column:
    """Last line of the block that ``h`` opens, before line ``following``; of Python's, where ``indents`` are given."""
    first, count = h["line_no"] + 1, F.greatest(following - h["line_no"] - 1, F.lit(0))
    if indents is not None:

        def end(inner):
            at = F.array_position(F.transform(inner, lambda n: n <= h["indent"]), F.lit(True)).cast("int")
            block = let(at, lambda a: F.when(a > 0, F.slice(inner, F.lit(1), a - 1)).otherwise(inner))
            return h["line_no"] + F.coalesce(F.array_max(F.transform(block, lambda n, i: F.when(n.isNotNull(), i + 1))), F.lit(0))

        return let(F.slice(indents, first, count), end)

    def count_of(needle):
        return F.length(F.replace(h["header"], F.lit(needle), F.lit("")))

    def found(brace):
        return F.array_position(F.transform(F.slice("lines", first, count), lambda s: F.startswith(s, brace)), F.lit(True)).cast("int")

    at = let(F.concat(F.substr(h["header"], F.lit(1), h["indent"]), F.lit("}")), found)
    closed = count_of("{") >= count_of("}")  # lengths without them
    return F.when(closed, h["line_no"]).otherwise(let(at, lambda a: F.when(a > 0, h["line_no"] + a).otherwise(following - 1)))


def _blocks(headers: Column, indents: Column | None) -> Column:
    """``headers`` with ``end_line``."""
    last = F.size("lines") + 1

    def block(h, i):
        later = F.filter(F.slice(headers, i + 2, F.size(headers)), lambda c: c["indent"] <= h["indent"])
        end = let(F.coalesce(F.get(later, F.lit(0))["line_no"], last), lambda following: _end_line(h, following, indents))
        return h.withField("end_line", end.cast("int"))

    return F.transform(headers, block)


def _around(blocks: Column, line_no: Column) -> Column:
    """Blocks that hold a line, other than as their header; the innermost is last."""
    return F.filter(blocks, lambda c: (c["line_no"] < line_no) & (c["end_line"] >= line_no))


def _last_name(blocks: Column) -> Column:
    return F.coalesce(F.try_element_at(blocks, F.lit(-1))["name"], F.lit(""))


def _owner(h: Column, around: Column, language: str) -> Column:
    """Class a unit belongs to, empty for none; NULL for a line that is no unit after all.

    Java: the innermost class, also from inside a method. A method without a body stands right in a class.
    Python and TypeScript: what is defined inside a function does not count.
    """
    if language == "go":
        return F.regexp_extract(h["header"], GO_RECEIVER, 1)
    in_class = F.coalesce(F.try_element_at(around, F.lit(-1))["is_class"], F.lit(False))
    if language == "java":
        return F.when(~h["bare"] | in_class, _last_name(F.filter(around, lambda c: c["is_class"])))
    return F.when(~F.exists(around, lambda c: ~c["is_class"]), _last_name(around))


def _fields(blocks: Column) -> Column:
    """Field lines of Java classes: those right in a class, at the indent of its members."""

    def likely(x):
        s = x["header"]
        return _any_of(s, ";,=") & F.rlike(s, F.lit(FIELD_LINE)) & ~F.rlike(s, F.lit(STATEMENT_START))

    def placed(x, owner):
        inner = F.slice("lines", owner["line_no"] + 1, F.greatest(owner["end_line"] - owner["line_no"] - 1, F.lit(0)))
        least = F.array_min(F.transform(inner, lambda s: F.when(F.trim(s) != "", _indent(s))))
        member = owner["is_class"] & (least == _indent(x["header"]))
        return F.struct(F.when(member, owner["name"]).alias("owner"), x["line_no"].alias("line_no"), x["header"].alias("header"))

    def field(x):
        rest = F.slice("lines", x["line_no"], F.size("lines"))
        end = F.array_position(F.transform(rest, lambda s: F.rlike(s, F.lit(r";\s*(//.*)?$"))), F.lit(True)).cast("int")
        names = text.split_params(F.regexp_replace(F.regexp_extract(x["header"], FIELD_LINE, 1), r";\s*(//.*)?$", ""))
        return F.struct(
            x["owner"].alias("owner"), x["line_no"].alias("line_no"), (x["line_no"] + F.greatest(end, F.lit(1)) - 1).alias("end_line"),
            F.trim(x["header"]).alias("header"), F.transform(names, lambda n: F.regexp_extract(n, r"^(\w+)", 1)).alias("names"))

    lines = F.transform(F.filter(_numbered(), likely), lambda x: let(F.try_element_at(_around(blocks, x["line_no"]), F.lit(-1)), lambda owner: placed(x, owner)))
    return F.transform(F.filter(lines, lambda f: f["owner"].isNotNull()), field).cast(FIELD)


SHORT, CODED = ("name", "owner", "is_class"), ("name", "owner", "is_class", "start_line", "end_line", "on_header")


def _units(df: DataFrame, fields: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """Source files (no text: an empty one) with ``family``, ``lines`` and the array ``units``, and on request ``fields``, in text order.

    Of a unit ``only`` the parts named are worked out, where not all are needed; Spark does not see that within a lambda.

    Headers and blocks live within one expression: as columns they would be copied into a row at every step.
    """
    family = text.by_language(F.col("language"), F.lit)
    code = F.coalesce("text", F.lit("")).alias("text")
    rows = hold(df.select("file_path", "language", code, family.alias("family")).where(F.col("family").isNotNull()), lines=text.lines(F.col("text")))

    def cut(language):
        def unit(h, around):
            parts = [
                h["name"].alias("name"), _owner(h, around, language).alias("owner"), h["is_class"].alias("is_class"),
                F.exists(around, lambda c: ~c["is_class"]).alias("nested"), h["line_no"].alias("start_line"), h["end_line"].alias("end_line"),
                F.trim(h["header"]).alias("header"), h["params"].alias("params"), F.regexp_extract(h["header"], BODY_ON_HEADER[language], 1).alias("on_header")]
            names = ("name", "owner", "is_class", "nested", "start_line", "end_line", "header", "params", "on_header")
            return F.struct(*[part for part, name in zip(parts, names) if only is None or name in only])

        def parts(blocks):
            units = F.transform(blocks, lambda h: let(_around(blocks, h["line_no"]), lambda around: unit(h, around)))
            found = _fields(blocks) if fields and language == "java" else F.array().cast(FIELD)
            return F.struct(F.filter(units, lambda u: u["owner"].isNotNull()).alias("units"), found.alias("fields"))

        def blocks(headers):
            if language == "python":
                indents = F.when(F.size(headers) > 0, _indents()).otherwise(F.array().cast("array<int>"))  # prose has no header
                return let(indents, lambda indents: let(_blocks(headers, indents), parts))
            return let(_blocks(headers, None), parts)

        return let(_headers(language), blocks)

    held = hold(rows, cut=text.by_language(F.col("family"), cut))
    return held.select("file_path", "language", "text", "family", "lines", "cut.units", *(["cut.fields"] if fields else []))


def _is_init(unit: Column, family: Column) -> Column:
    """True for a constructor."""
    name, owner = unit["name"], unit["owner"]
    member = owner != ""
    return F.when(family == "java", name == owner).when(family == "python", member & (name == "__init__")).when(
        family == "typescript", member & (name == "constructor")).otherwise(F.lit(False))


def _callable(family: Column) -> Column:
    """``units`` without classes and Java's constructors."""
    return F.filter("units", lambda u: ~u["is_class"] & ~((family == "java") & (u["name"] == u["owner"])))


def _inner_code(u: Column) -> Column:
    """Code of a unit below its header, and what the header line itself holds of it."""
    below = F.slice("lines", u["start_line"] + 1, u["end_line"] - u["start_line"])
    return F.array_join(F.concat(F.array(u["on_header"]), below), "\n")


def _with_code(units: Column, code) -> Column:
    """``units`` with their ``code``, cut before each becomes a row, so that no row of a unit holds the whole text."""
    return F.transform(units, lambda u: F.struct(u.alias("unit"), code(u).alias("code")))


def segment_units(files: DataFrame, joined: bool = True) -> DataFrame:
    """Callable units of source files (``file_path, language, text``); ``params`` are ``joined`` by "; ", or an array.

    ``name`` carries the class for Python and TypeScript; Java constructors are not units. ``body`` keeps
    the indent of its first line. ``nested`` units stand inside the body of another unit.
    """
    family = F.col("family")
    rows = _units(files).select("file_path", "language", "family", F.inline(_with_code(
        _callable(family), lambda u: F.array_join(F.slice("lines", u["start_line"], u["end_line"] - u["start_line"] + 1), "\n"))))
    name, owner, header = F.col("unit.name"), F.col("unit.owner"), F.col("unit.header")
    qualified = F.when(family.isin("python", "typescript") & (owner != ""), F.concat(owner, F.lit("."), name)).otherwise(name)
    public = F.when(family == "java", F.rlike(header, F.lit(r"\bpublic\b"))).when(family == "go", F.rlike(name, F.lit("^[A-Z]"))).otherwise(F.lit(True))
    static = family.isin("java", "typescript") & F.rlike(header, F.lit(r"\bstatic\b"))
    params = text.split_params(F.col("unit.params"))
    return rows.select(
        "file_path", "language", qualified.alias("name"), F.col("unit.start_line").alias("start_line"), F.col("unit.end_line").alias("end_line"),
        F.regexp_replace(header, r"\s*[{:]\s*$", "").alias("signature"), F.col("code").alias("body"), static.alias("is_static"), public.alias("is_public"),
        (F.array_join(params, "; ") if joined else params).alias("params"), F.col("unit.nested").alias("nested"))


def without_units(files: DataFrame) -> DataFrame:
    """Paths of source files in which no callable unit was found."""
    return _units(files, only=SHORT).where(F.size(_callable(F.col("family"))) == 0).select("file_path", "language")


SIGNATURE_LIMIT = {"java": 200, "go": 200, "python": 240, "typescript": 240}


def _kind(unit: Column, family: Column) -> Column:
    """Kind of the symbol a unit is."""
    go = family == "go"
    class_kind = F.when(F.rlike(unit["header"], F.lit(r"\binterface\b")), "interface").when(go, "struct").otherwise("class")
    return F.when(unit["is_class"], class_kind).when(_is_init(unit, family), "constructor").when(go & (unit["owner"] == ""), "function").otherwise("method")


def symbol_table(files: DataFrame, kinds: tuple[str, ...] | None = None, params: bool = False) -> DataFrame:
    """Symbols of source files: ``id, name, kind, file_path, line, end_line, signature, body_hash``.

    Names are ``Class.method(types)``, ``Class.<init>(types)``, ``Class.field`` and, for Python and TypeScript
    functions, ``module.function(types)``. Only those of ``kinds``, where given; with ``params``, the array of their parameters.
    """
    family = F.col("family")
    with_fields = kinds is None or "field" in kinds
    cut = _units(files, fields=with_fields)
    units = F.col("units") if kinds is None else F.filter("units", lambda u: _kind(u, family).isin(*kinds))

    # Fields go along as entries without a unit, so that the texts are read once.
    shape = "struct<name:string,line:int,end_line:int,signature:string>"
    entries = F.transform(units, lambda u: F.struct(u.alias("unit"), F.when(~u["is_class"], _inner_code(u)).alias("code"), F.lit(None).cast(shape).alias("field")))
    if with_fields:
        flat = F.flatten(F.transform("fields", lambda f: F.transform(f["names"], lambda n: F.struct(
            F.concat(f["owner"], F.lit("."), n).alias("name"), f["line_no"].alias("line"), f["end_line"].alias("end_line"), f["header"].alias("signature")))))
        entries = F.concat(entries, F.transform(flat, lambda f: F.struct(
            F.lit(None).cast(cut.schema["units"].dataType.elementType).alias("unit"), F.lit(None).cast("string").alias("code"), f.cast(shape).alias("field"))))
    rows = cut.select("file_path", "family", F.inline(entries))

    # From here on plain columns, which Spark compiles; what is used more than once is a column first.
    unit, field, c_like = F.col("unit"), F.col("field"), F.col("family") != "python"
    listed = rows.select(
        "file_path", "family", "unit", "field", _kind(unit, family).alias("_kind"), text.split_params(unit["params"]).alias("params"),
        text.trimmed(F.substring_index(F.coalesce(field["signature"], unit["header"]), "\n", 1)).alias("_line"),
        F.when(c_like, F.regexp_replace(F.coalesce("code", F.lit("")), text.COMMENTS["java"], " ")).otherwise(
            F.regexp_replace(F.coalesce("code", F.lit("")), text.COMMENTS["python"], " ")).alias("_code"))
    listed = listed.withColumn("_typed", text.typed_params(F.col("params")))
    name, owner, typed = unit["name"], unit["owner"], F.col("_typed")
    module = F.regexp_replace(paths.base_name(F.col("file_path")), r"\.[^.]*$", "")
    alone = F.when(family.isin("java", "go"), name).otherwise(F.concat(module, F.lit("."), name))
    qualified = F.when(F.col("_kind") == "constructor", F.concat(owner, F.lit(".<init>"))).when(owner != "", F.concat(owner, F.lit("."), name)).otherwise(alone)
    types = F.when((family == "python") & (owner != ""), text.types_of(typed, "python", member=True)).otherwise(text.by_language(family, lambda k: text.types_of(typed, k)))
    limit = text.by_language(family, lambda k: F.lit(SIGNATURE_LIMIT[k]))
    of_field = field.isNotNull()
    found = listed.select(
        "file_path", "params",
        F.when(of_field, field["name"]).when(unit["is_class"], name).otherwise(F.concat(qualified, F.lit("("), F.array_join(types, ","), F.lit(")"))).alias("name"),
        F.when(of_field, "field").otherwise(F.col("_kind")).alias("kind"),
        F.when(of_field, field["line"]).otherwise(unit["start_line"]).alias("line"), F.when(of_field, field["end_line"]).otherwise(unit["end_line"]).alias("end_line"),
        text.shortened(F.col("_line"), limit).alias("signature"),
        F.when(of_field | unit["is_class"], F.lit("")).otherwise(text.token_hash(F.col("_code"))).alias("body_hash"))
    return found.select(
        ids.symbol_id(F.col("file_path"), F.col("name"), F.col("kind"), F.col("signature")).alias("id"), "name", "kind", "file_path",
        "line", "end_line", "signature", "body_hash", *(["params"] if params else []))


def _code_lines(files: DataFrame, *needles: str) -> DataFrame:
    """``file_path, family, class_name, caller, unit_line, line, code``: each line that holds one of ``needles``, with the innermost unit it is in.

    Of a header line ``code`` is what follows the opening brace; ``caller`` is NULL outside of units. ``unit_line``, where
    the unit starts, tells overloads apart. Lines are chosen within the text's row, so none carries the text's units along.
    """

    def entry(line):
        holding = F.filter("units", lambda u: ~u["is_class"] & (u["start_line"] <= line) & (u["end_line"] >= line))
        return let(F.try_element_at(holding, F.lit(-1)), lambda u: F.struct(
            u["owner"].alias("class_name"), u["name"].alias("caller"), u["start_line"].alias("unit_line"), line.alias("line"),
            F.when(u["start_line"] == line, u["on_header"]).otherwise(F.element_at("lines", line)).alias("code")))

    lines = F.transform(F.array_compact(F.transform("lines", lambda s, i: F.when(_any_of(s, needles), i + 1))), entry)
    return _units(files, only=CODED).select("file_path", "family", F.inline(lines))


def call_candidates(files: DataFrame) -> DataFrame:
    """Calls inside units of Java and Go files, once per line:
    ``file_path, language, class_name, caller, unit_line, line, receiver, method, call_type``.

    ``X::m`` is a method reference, ``new T`` a constructor, ``super.m(`` a super call, a capitalised
    receiver a static one. In Java ``this(`` and ``super(`` call a constructor of the own class and of the one above. A call on the result of another call has no receiver and is left out, and so is a
    conversion to a slice type in Go.
    """
    known = _code_lines(files.where(F.col("language").isin("java", "go")), "(", "::", "new").where(F.col("caller").isNotNull())
    quoted = _any_of(F.col("code"), '"`')
    unquoted = F.when(quoted, F.regexp_replace("code", r"\"(?:[^\"\\]|\\.)*\"|`[^`]*`", '""')).otherwise(F.col("code"))
    plain = F.substring_index(unquoted, "//", 1)  # a line of code holds no line break
    apart = F.regexp_replace(plain, r"\)\s*\.\s*\w+\s*\(|\]\s*\w+\s*\(", ")(")
    java = F.col("family") == "java"

    def parsed(hit):
        # What the pattern leaves before the parenthesis; each step is named, for inside a lambda nothing else is computed once.
        called = F.when(F.endswith(hit, F.lit("(")), F.rtrim(F.substr(hit, F.lit(1), F.length(hit) - 1), F.lit(" \t\n\x0b\f\r"))).otherwise(hit)
        return let(called, lambda dotted: let(F.substring_index(dotted, ".", -1), lambda last: named(hit, dotted, last)))

    def named(hit, dotted, last):
        chained = java & dotted.isin("this", "super") & F.endswith(hit, F.lit("("))
        ref, new = F.contains(hit, F.lit("::")), F.startswith(hit, F.lit("new")) & F.rlike(hit, F.lit(r"^new\s"))
        before = F.substr(dotted, F.lit(1), F.length(dotted) - F.length(last) - 1)
        form = F.when(chained, "chained").when(ref, "ref").when(new, "new").otherwise("plain")

        def call(form):
            receiver = F.when(form == "chained", dotted).when(form == "ref", F.substring_index(hit, "::", 1)).when(
                form == "new", F.regexp_extract(hit, r"^new\s+(\w+)", 1)).when(F.length(last) < F.length(dotted), before).otherwise(F.lit(""))
            method = F.when(form == "ref", F.substring_index(hit, "::", -1)).when(form.isin("new", "chained"), F.lit("<init>")).otherwise(last)
            return let(receiver, lambda r: F.struct(r.alias("receiver"), method.alias("method"), kind(form, r).alias("call_type")))

        return let(form, call)

    def kind(form, receiver):
        return (
            F.when(form == "ref", "method_reference").when((form == "new") | ((form == "chained") & (receiver == "this")), "constructor")
            .when(java & F.startswith(receiver, F.lit("super")), "super").when(F.substr(receiver, F.lit(1), F.lit(1)).between("A", "Z"), "static").otherwise("direct"))

    hits = F.array_distinct(F.transform(F.regexp_extract_all(apart, F.lit(FAST_CALL), F.lit(0)), parsed))
    rows = known.select("file_path", F.col("family").alias("language"), "class_name", "caller", "unit_line", "line", F.inline(hits))
    barred = F.col("method").isin(*STATEMENTS) & (F.col("language") == "java") | F.col("method").isin(*NOT_CALLED) & (F.col("language") == "go")
    return rows.where(~barred)


def declared_types(files: DataFrame) -> DataFrame:
    """``file_path, unit_line, name, type_name`` in Java files: declared locals by the first line of their unit, and fields with 0."""
    lines = _code_lines(files.where(F.col("language") == "java"), "=", ";")
    found = lines.select("file_path", F.coalesce("unit_line", F.lit(0)).alias("unit_line"), F.explode(F.regexp_extract_all("code", F.lit(DECLARATION), F.lit(0))).alias("d"))
    pairs = found.select("file_path", "unit_line", F.regexp_extract("d", DECLARATION, 2).alias("name"), F.regexp_extract("d", DECLARATION, 1).alias("type_name"))
    return first_per_key(pairs, ["file_path", "unit_line", "name"], "type_name")


def resolve_receivers(calls: DataFrame, types: DataFrame) -> DataFrame:
    """``caller_id, callee_id, call_type, file_path, line`` with receivers replaced by their declared type.

    A local of the same unit wins over a field; an unknown name stays. In Java a call without a receiver, or on ``this``, is to the
    own class; in Go it is to a function.
    """
    # One row per name of a file: its declarations are found, and joined, once. They are read off texts, whose size Spark cannot tell,
    # and would be broadcast for the small tables that texts may come from.
    of_name = types.groupBy("file_path", F.col("name").alias("receiver")).agg(
        F.min(F.when(F.col("unit_line") == 0, F.col("type_name"))).alias("_field"),
        F.collect_set(F.when(F.col("unit_line") > 0, F.struct("unit_line", "type_name"))).alias("_locals"))
    known = skew_join(calls.withColumn("receiver", F.regexp_replace("receiver", r"^this\.", "")), of_name.hint("merge"), ["file_path", "receiver"], "left")
    in_unit = F.filter("_locals", lambda t: t["unit_line"] == F.col("unit_line"))
    joined = known.withColumn("_local", F.array_min(F.transform(in_unit, lambda t: t["type_name"])))
    own = F.col("receiver").isin("", "this") & (F.col("language") == "java")
    callee = F.when(own, F.col("class_name")).otherwise(F.coalesce("_local", "_field", "receiver"))
    some = [F.nullif(c, F.lit("")) for c in (F.col("class_name"), callee)]
    return joined.select(
        F.concat_ws(".", some[0], "caller").alias("caller_id"), F.concat_ws(".", some[1], "method").alias("callee_id"), "call_type", "file_path", "line"
    ).distinct()
