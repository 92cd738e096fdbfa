"""Queries on texts: lines, units, symbols, calls, masks, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.functions import rules, scoring, text
from codelattice.operators import masking as M
from codelattice.operators import sessions as Z
from codelattice.operators import text_units as U
from codelattice.plans.registry import oracle_view, query

NL = "chr(10)"
TRIM = f"regexp_replace({{0}}, '{text.EDGE_SPACE}', '', 'g')"


def _count(expr: str, needle: str) -> str:
    return f"cast((length({expr}) - length(replace({expr}, '{needle}', ''))) / {len(needle)} AS int)"


def _complexity(expr: str, language: str) -> str:
    points = " + ".join(_count(expr, op) for op in scoring.OPERATORS[language])
    if language in ("java", "go"):
        return f"{points} + cast(floor({_count(expr, '(')} / 2) AS int)"
    if language == "typescript":
        short = f"replace(replace({expr}, '===', '   '), '!==', '   ')"
        points += f" + {_count(short, '==')} + {_count(short, '!=')}"
    return f"CASE WHEN ({points}) = 0 AND trim({expr}) <> '' THEN 1 ELSE {points} END"


@query("explode_lines", f"""
    SELECT doc_id, line_no, line FROM (
      SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line, len(parts) AS n FROM (
        SELECT doc_id, string_split(text, {NL}) AS parts FROM documents) a) b WHERE NOT (line_no = n AND line = '')""")
def explode_lines(t):
    return U.explode_lines(t.wide("documents"), "doc_id").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("normalise_whitespace", f"""
    SELECT doc_id, sha256(array_to_string([{TRIM.format('x')} for x in string_split(text, {NL}) if {TRIM.format('x')} <> ''], {NL})) AS text_hash FROM documents""")
def normalise_whitespace(t):
    return t.wide("documents").select("doc_id", F.sha2(text.normalise_whitespace(F.col("text")), 256).alias("text_hash"))


SIG = TRIM.format(f"split_part(text, {NL}, 1)")


@query("signature_of", f"SELECT doc_id, CASE WHEN length({SIG}) > 200 THEN concat(substr({SIG}, 1, 200), '...') ELSE {SIG} END AS signature FROM documents")
def signature_of(t):
    return t.wide("documents").select("doc_id", text.first_line_signature(F.col("text"), 200).alias("signature"))


@query("offset_to_position", f"""
    SELECT doc_id, {_count("prefix", chr(10))} AS line, cast(length(split_part(prefix, {NL}, -1)) AS int) AS character
    FROM (SELECT doc_id, substr(text, 1, cast(floor(length(text) * 3 / 4) AS int)) AS prefix FROM documents) x""")
def offset_to_position(t):
    code = F.col("text")
    at = F.floor(F.length(code) * 3 / 4).cast("int")
    return t.wide("documents").select("doc_id", text.line_at(code, at).alias("line"), text.character_at(code, at).alias("character"))


@query("body_fingerprint", f"""
    SELECT doc_id, sha256(array_to_string(regexp_extract_all(regexp_replace(text, '{text.COMMENTS["java"]}', ' ', 'g'), '{text.TOKEN}'), ' ')) AS body_hash FROM documents
    UNION ALL SELECT -1 - doc_id, sha256('') FROM documents""")
def body_fingerprint(t):
    some = t.wide("documents").select("doc_id", text.body_hash(F.col("text"), "java").alias("body_hash"))
    none = t.wide("documents").select((-1 - F.col("doc_id")).alias("doc_id"), text.body_hash(F.lit(None).cast("string"), "java").alias("body_hash"))
    return some.unionByName(none)


@query("complexity_score", f"""
    SELECT page_id, {_complexity("html", "java")} AS java, {_complexity("html", "python")} AS python, {_complexity("html", "typescript")} AS typescript FROM pages
    UNION ALL SELECT -1 - doc_id, {_complexity("text", "java")}, {_complexity("text", "python")}, {_complexity("text", "typescript")} FROM documents""")
def complexity_score(t):
    rows = t.wide("pages").select("page_id", F.col("html").alias("text")).unionByName(t.wide("documents").select((-1 - F.col("doc_id")).alias("page_id"), "text"))
    return rows.select("page_id", *[scoring.complexity(F.col("text"), name).alias(name) for name in ("java", "python", "typescript")])


# --- units ----------------------------------------------------------------------------------------


def _by_language(make) -> str:
    return "CASE language " + " ".join(f"WHEN '{name}' THEN {make(name)}" for name in ("java", "python", "go", "typescript")) + " END"


def _unit_views(source: str, tag: str) -> None:
    oracle_view(f"ox_lines{tag}", f"""
        SELECT file_path, language, line_no, line, length(line) - length(regexp_replace(line, '^[ \\t]+', '')) AS indent FROM (
          SELECT file_path, language, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line, len(parts) AS n FROM (
            SELECT file_path, language, string_split(text, {NL}) AS parts FROM {source}) a) b WHERE NOT (line_no = n AND line = '')""")
    # A head is one line; a block is a head with its last line. Which block a line is in is settled by a join on ranges.
    classed = _by_language(lambda k: f"regexp_extract(line, '{rules.CLASS_LINE[k]}', 1)")
    named = _by_language(lambda k: f"regexp_extract(line, '{rules.UNIT_LINE[k]}', 1)")
    params = _by_language(lambda k: f"regexp_extract(line, '{rules.UNIT_LINE[k]}', 2)")
    rest = _by_language(lambda k: f"regexp_extract(line, '{rules.BODY_ON_HEADER[k]}', 1)")
    skip = ", ".join(f"'{w}'" for w in rules.STATEMENTS)
    value = rules.VALUE_LINE["typescript"]
    oracle_view(f"ox_heads{tag}", f"""
        SELECT *, language = 'java' AND class_name = '' AND regexp_matches(line, ';\\s*$') AND NOT contains(line, '{{') AS bare FROM (
          SELECT file_path, language, line_no, line, indent, {classed} AS class_name, {rest} AS on_header,
            CASE WHEN language = 'typescript' AND {named} = '' THEN regexp_extract(line, '{value}', 1) ELSE {named} END AS unit_name,
            CASE WHEN language = 'typescript' AND {named} = '' THEN regexp_extract(line, '{value}', 2) ELSE {params} END AS params FROM ox_lines{tag}
          WHERE NOT regexp_matches(line, '{rules.STATEMENT_START}')) x
        WHERE class_name <> '' OR (unit_name <> '' AND unit_name NOT IN ({skip})
          AND (language <> 'java' OR regexp_matches(line, '{rules.TYPED}') OR contains(line, '{{') OR NOT regexp_matches(line, ';\\s*$')))""")
    oracle_view(f"ox_blocks{tag}", f"""
        WITH stop AS (SELECT h.file_path, h.line_no, min(n.line_no) AS next_no FROM ox_heads{tag} h JOIN ox_heads{tag} n
            ON n.file_path = h.file_path AND n.line_no > h.line_no AND n.indent <= h.indent GROUP BY 1, 2),
          brace AS (SELECT h.file_path, h.line_no, min(l.line_no) AS close_no FROM ox_heads{tag} h JOIN ox_lines{tag} l
            ON l.file_path = h.file_path AND l.line_no > h.line_no AND starts_with(l.line, concat(substr(h.line, 1, h.indent), '}}')) GROUP BY 1, 2),
          dedent AS (SELECT h.file_path, h.line_no, min(l.line_no) AS out_no FROM ox_heads{tag} h JOIN ox_lines{tag} l
            ON l.file_path = h.file_path AND l.line_no > h.line_no AND trim(l.line) <> '' AND l.indent <= h.indent GROUP BY 1, 2),
          total AS (SELECT file_path, max(line_no) AS n FROM ox_lines{tag} GROUP BY 1)
        SELECT h.*, class_name <> '' AS is_class, CASE WHEN class_name <> '' THEN class_name ELSE unit_name END AS name,
          CASE WHEN h.language = 'python' THEN (SELECT max(l.line_no) FROM ox_lines{tag} l WHERE l.file_path = h.file_path AND trim(l.line) <> ''
              AND l.line_no >= h.line_no AND l.line_no < coalesce(d.out_no, t.n + 1))
            WHEN {_count("h.line", "{")} <= {_count("h.line", "}")} THEN h.line_no
            WHEN b.close_no < coalesce(s.next_no, t.n + 1) THEN b.close_no ELSE coalesce(s.next_no - 1, t.n) END AS end_line
        FROM ox_heads{tag} h JOIN total t ON t.file_path = h.file_path LEFT JOIN stop s ON s.file_path = h.file_path AND s.line_no = h.line_no
          LEFT JOIN brace b ON b.file_path = h.file_path AND b.line_no = h.line_no LEFT JOIN dedent d ON d.file_path = h.file_path AND d.line_no = h.line_no""")
    oracle_view(f"ox_units{tag}", f"""
        WITH up AS (SELECT h.file_path, h.line_no, arg_max(c.name, c.line_no) AS inner_name, arg_max(c.is_class, c.line_no) AS in_class,
            arg_max(c.name, c.line_no) FILTER (WHERE c.is_class) AS class_above, bool_or(NOT c.is_class) AS in_unit
            FROM ox_blocks{tag} h JOIN ox_blocks{tag} c ON c.file_path = h.file_path AND c.line_no < h.line_no AND c.end_line >= h.line_no GROUP BY 1, 2)
        SELECT h.file_path, h.language, h.is_class, h.name, trim(h.line) AS header, h.params, h.on_header, h.line_no AS start_line, h.end_line, coalesce(u.in_unit, false) AS nested,
          CASE WHEN h.language = 'go' THEN regexp_extract(h.line, '{rules.GO_RECEIVER}', 1) WHEN h.language = 'java' THEN coalesce(u.class_above, '')
            ELSE coalesce(u.inner_name, '') END AS owner
        FROM ox_blocks{tag} h LEFT JOIN up u ON u.file_path = h.file_path AND u.line_no = h.line_no
        WHERE CASE h.language WHEN 'java' THEN NOT h.bare OR coalesce(u.in_class, false) WHEN 'go' THEN true ELSE NOT coalesce(u.in_unit, false) END""")
    oracle_view(f"ox_bodies{tag}", f"""
        SELECT u.*, (SELECT string_agg(l.line, {NL} ORDER BY l.line_no) FROM ox_lines{tag} l WHERE l.file_path = u.file_path AND l.line_no BETWEEN u.start_line AND u.end_line) AS body
        FROM ox_units{tag} u""")


_unit_views("fx_source_files", "")
_unit_views("fx_source_files_old", "_old")

QUALIFIED = "CASE WHEN language IN ('python', 'typescript') AND owner <> '' THEN concat(owner, '.', name) ELSE name END"
CALLABLE = "NOT is_class AND NOT (language = 'java' AND name = owner)"
# Commas inside one level of angle or square brackets do not split.
PARAM_LIST = f"""[trim(replace(x, chr(1), ',')) for x in string_split(regexp_replace(regexp_replace(params, '<([^<>,]*),([^<>]*)>', '<\\1' || chr(1) || '\\2>', 'g'), '\\[([^,\\]]*),([^\\]]*)\\]', '[\\1' || chr(1) || '\\2]', 'g'), ',') if trim(x) <> '']"""


@query("segment_units", f"""
    SELECT file_path, language, {QUALIFIED} AS name, cast(start_line AS int) AS start_line, cast(end_line AS int) AS end_line, regexp_replace(header, '\\s*[{{:]\\s*$', '') AS signature,
      sha256(body) AS body_hash, language IN ('java', 'typescript') AND regexp_matches(header, '\\bstatic\\b') AS is_static,
      CASE language WHEN 'java' THEN regexp_matches(header, '\\bpublic\\b') WHEN 'go' THEN regexp_matches(name, '^[A-Z]') ELSE true END AS is_public,
      array_to_string({PARAM_LIST}, '; ') AS params
    FROM ox_bodies WHERE {CALLABLE}""")
def segment_units(t):
    units = U.segment_units(t.wide("fx_source_files"))
    return units.select("file_path", "language", "name", "start_line", "end_line", "signature", F.sha2("body", 256).alias("body_hash"), "is_static", "is_public", "params")


@query("segment_rejects", """
    SELECT concat('doc', doc_id) AS file_path, 'python' AS language FROM documents
    UNION ALL SELECT concat('cut/', file_path), language FROM fx_source_files WHERE language <> 'java'
    UNION ALL SELECT concat('init/', file_path), language FROM fx_source_files WHERE language = 'java'""")
def segment_rejects(t):
    """Prose, code cut off before its first unit, and classes with no more than a constructor; whole files go along."""
    files = t.wide("fx_source_files").select("file_path", "language", "text")
    java = F.col("language") == "java"
    cut = files.where(~java).select(F.concat(F.lit("cut/"), "file_path").alias("file_path"), "language", F.substring_index("text", "(", 1).alias("text"))
    init = files.where(java).select(F.concat(F.lit("init/"), "file_path").alias("file_path"), "language", F.concat(F.substring_index("text", "public static", 1), F.lit("}\n")).alias("text"))
    prose = t.wide("documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_path"), F.lit("python").alias("language"), "text")
    return U.without_units(prose.unionByName(files).unionByName(cut).unionByName(init))


BARE = "trim(split_part(regexp_replace(trim({0}), '^(\\*+|\\.\\.\\.|readonly |final )', ''), '=', 1))"
ANNOTATED = f"CASE WHEN instr({BARE.format('x')}, ':') > 0 THEN regexp_replace(substr({BARE.format('x')}, instr({BARE.format('x')}, ':') + 1), '\\s+', '', 'g') ELSE '_' END"
TYPES = f"""CASE language WHEN 'java' THEN array_to_string([regexp_replace(regexp_extract({BARE.format('x')}, '^(.*\\S)\\s+\\S+$', 1), '\\s+', '', 'g') for x in {PARAM_LIST}], ',')
    WHEN 'go' THEN array_to_string([regexp_replace(regexp_extract(x, '^\\s*\\S+\\s+(.+)$', 1), '\\s+', '', 'g') for x in {PARAM_LIST}], ',')
    ELSE array_to_string([{ANNOTATED} for x in {PARAM_LIST} if NOT (language = 'python' AND owner <> '' AND x = 'self')], ',') END"""
oracle_view("ox_named", f"""
    SELECT *, CASE WHEN is_class THEN name ELSE concat(CASE WHEN (language = 'java' AND name = owner) OR (language = 'python' AND owner <> '' AND name = '__init__') OR (language = 'typescript' AND owner <> '' AND name = 'constructor') THEN concat(owner, '.<init>')
        WHEN owner <> '' THEN concat(owner, '.', name) WHEN language IN ('java', 'go') THEN name
        ELSE concat(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', ''), '.', name) END, '(', {TYPES}, ')') END AS full_name,
      CASE WHEN is_class THEN CASE WHEN regexp_matches(header, '\\binterface\\b') THEN 'interface' WHEN language = 'go' THEN 'struct' ELSE 'class' END
        WHEN language = 'java' AND name = owner THEN 'constructor' WHEN owner = '' AND language = 'go' THEN 'function' ELSE 'method' END AS kind
    FROM ox_bodies""")
INNER = f"concat(on_header, {NL}, CASE WHEN instr(body, {NL}) > 0 THEN substr(body, instr(body, {NL}) + 1) ELSE '' END)"
HASHED = _by_language(lambda k: f"sha256(array_to_string(regexp_extract_all(regexp_replace({INNER}, '{text.COMMENTS[k]}', ' ', 'g'), '{text.TOKEN}'), ' '))")


# A field stands right in a class, as far in as the class's leftmost line; bracketed commas don't separate names.
oracle_view("ox_fields", f"""
    WITH place AS (SELECT l.file_path, l.line_no, arg_max(c.name, c.line_no) AS owner, arg_max(c.is_class, c.line_no) AS in_class, arg_max(c.line_no, c.line_no) AS class_no
        FROM ox_lines l JOIN ox_blocks c ON c.file_path = l.file_path AND c.line_no < l.line_no AND c.end_line >= l.line_no WHERE l.language = 'java' GROUP BY 1, 2),
      inside AS (SELECT c.file_path, c.line_no AS class_no, min(l.indent) AS indent FROM ox_blocks c JOIN ox_lines l
        ON l.file_path = c.file_path AND l.line_no > c.line_no AND l.line_no < c.end_line AND trim(l.line) <> '' WHERE c.is_class GROUP BY 1, 2)
    SELECT l.file_path, p.owner, l.line_no, trim(l.line) AS header, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(
        regexp_extract(l.line, '{rules.FIELD_LINE}', 1), ';\\s*(//.*)?$', ''), '\\([^()]*\\)|<[^<>]*>', '', 'g'), '=[^,]*', '', 'g'), ',')) AS name
    FROM ox_lines l JOIN place p ON p.file_path = l.file_path AND p.line_no = l.line_no AND p.in_class JOIN inside i ON i.file_path = l.file_path AND i.class_no = p.class_no AND i.indent = l.indent
    WHERE regexp_matches(l.line, '{rules.FIELD_LINE}') AND NOT regexp_matches(l.line, '{rules.STATEMENT_START}')""")


@query("symbol_table", f"""
    SELECT concat('sym_', substr(sha256(concat_ws(':', file_path, full_name, kind, header)), 1, 32)) AS id, full_name AS name, kind, file_path, cast(start_line AS int) AS line,
      cast(end_line AS int) AS end_line, header AS signature, CASE WHEN is_class THEN '' ELSE {HASHED} END AS body_hash FROM ox_named
    UNION ALL SELECT concat('sym_', substr(sha256(concat_ws(':', file_path, concat(owner, '.', trim(name)), 'field', header)), 1, 32)), concat(owner, '.', trim(name)), 'field', file_path,
      cast(line_no AS int), cast(line_no AS int), header, '' FROM ox_fields""")
def symbol_table(t):
    return U.symbol_table(t.wide("fx_source_files"))


@query("split_params", f"""
    SELECT file_path, cast(start_line AS int) AS start_line, array_to_string({PARAM_LIST}, '|') AS parts FROM ox_units WHERE NOT is_class
    UNION ALL SELECT concat('doc', doc_id), 0, array_to_string([trim(x) for x in string_split(replace(translate(text, '()[]{{}}<>', ''), {NL}, ' '), ',') if trim(x) <> ''], '|') FROM documents""")
def split_params(t):
    heads = U.segment_units(t.wide("fx_source_files"), joined=False).select("file_path", "start_line", "params")
    # Java's constructors are symbols, but not among the callable units.
    java = t.wide("fx_source_files").where("language = 'java'")
    init = U.symbol_table(java, kinds=("constructor",), params=True).select("file_path", F.col("line").alias("start_line"), "params")
    units = heads.unionByName(init).select("file_path", "start_line", F.array_join("params", "|").alias("parts"))
    flat = F.translate("text", "()[]{}<>", "")
    docs = t.wide("documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file_path"), F.lit(0).alias("start_line"),
                              F.array_join(text.split_params(flat), "|").alias("parts"))
    return units.unionByName(docs)


STRIPPED = "regexp_replace(regexp_replace(regexp_replace(code, '\"(?:[^\"\\\\]|\\\\.)*\"|`[^`]*`', '\"\"', 'g'), '//[^\\n]*', '', 'g'), '\\)\\s*\\.\\s*\\w+\\s*\\(|\\]\\s*\\w+\\s*\\(', ')(', 'g')"
# Each line of code belongs to the unit that starts last among those around it.
oracle_view("ox_code", """
    SELECT l.file_path, l.language, l.line_no, arg_max(u.owner, u.start_line) AS class_name, arg_max(u.name, u.start_line) AS caller,
      CASE WHEN max(u.start_line) = l.line_no THEN arg_max(u.on_header, u.start_line) ELSE any_value(l.line) END AS code
    FROM ox_lines l LEFT JOIN ox_units u ON u.file_path = l.file_path AND NOT u.is_class AND l.line_no BETWEEN u.start_line AND u.end_line
    WHERE l.language IN ('java', 'go') GROUP BY l.file_path, l.language, l.line_no""")
oracle_view("ox_hits", f"""
    SELECT file_path, language, class_name, caller, cast(line_no AS int) AS line, unnest(regexp_extract_all({STRIPPED}, '{rules.CALL}')) AS hit
    FROM ox_code WHERE caller IS NOT NULL""")
oracle_view("ox_candidates", f"""
    SELECT DISTINCT file_path, language, class_name, caller, line, receiver, method,
      CASE WHEN ref THEN 'method_reference' WHEN new THEN 'constructor' WHEN language = 'java' AND starts_with(receiver, 'super') THEN 'super'
        WHEN regexp_matches(receiver, '^[A-Z]') THEN 'static' ELSE 'direct' END AS call_type
    FROM (SELECT *, CASE WHEN ref THEN split_part(hit, '::', 1) WHEN new THEN regexp_extract(hit, '^new\\s+(\\w+)', 1)
          WHEN instr(dotted, '.') > 0 THEN regexp_replace(dotted, '\\.\\w+$', '') ELSE '' END AS receiver,
        CASE WHEN ref THEN split_part(hit, '::', 2) WHEN new THEN '<init>' ELSE split_part(dotted, '.', -1) END AS method
      FROM (SELECT *, contains(hit, '::') AS ref, regexp_matches(hit, '^new\\s') AS new, regexp_replace(hit, '\\s*\\($', '') AS dotted FROM ox_hits) a) b
    WHERE method NOT IN (SELECT unnest(CASE language WHEN 'java' THEN [{", ".join(f"'{w}'" for w in rules.STATEMENTS)}] ELSE [{", ".join(f"'{w}'" for w in rules.NOT_CALLED)}] END))""")


@query("call_candidates", "SELECT * FROM ox_candidates")
def call_candidates(t):
    return U.call_candidates(t.wide("fx_source_files")).drop("unit_line")


# What is called follows from how the files are made: constructors that call others, and overloads with locals of one name.
@query("call_chaining", """
    WITH o AS (SELECT concat('src/chain/O', cast(o_orderkey AS string), '.java') AS file_path, concat('O', cast(o_orderkey AS string)) AS c, o_custkey % 2 = 0 AS even FROM orders)
    SELECT concat(c, '.', c) AS caller_id, 'super.<init>' AS callee_id, 'super' AS call_type, file_path, 4 AS line FROM o
    UNION ALL SELECT concat(c, '.', c), concat(c, '.<init>'), 'constructor', file_path, 7 FROM o
    UNION ALL SELECT concat(c, '.run'), concat(c, CASE WHEN even THEN '.make' ELSE '.build' END), 'direct', file_path, 10 FROM o
    UNION ALL SELECT concat(c, '.run'), 'Bar.go', 'direct', file_path, 11 FROM o
    UNION ALL SELECT concat(c, '.run'), concat(c, '.other'), 'direct', file_path, 14 FROM o
    UNION ALL SELECT concat(c, '.run'), 'Alt.go', 'direct', file_path, 15 FROM o
    UNION ALL SELECT concat(c, '.run'), CASE WHEN even THEN 'super.run' ELSE 'Field.go' END, CASE WHEN even THEN 'super' ELSE 'direct' END, file_path, 18 FROM o""")
def call_chaining(t):
    files = t.wide("fx_chained_files")
    return U.resolve_receivers(U.call_candidates(files), U.declared_types(files)).select("caller_id", "callee_id", "call_type", "file_path", "line")


@query("receiver_type_resolve", f"""
    WITH decl AS (SELECT file_path, coalesce(caller, '') AS caller, unnest(regexp_extract_all(code, '{rules.DECLARATION}')) AS d FROM ox_code WHERE language = 'java'),
      types AS (SELECT file_path, caller, regexp_extract(d, '{rules.DECLARATION}', 2) AS name, min(regexp_extract(d, '{rules.DECLARATION}', 1)) AS t FROM decl GROUP BY 1, 2, 3)
    SELECT DISTINCT concat_ws('.', nullif(c.class_name, ''), c.caller) AS caller_id,
      concat_ws('.', CASE WHEN c.language = 'java' AND c.receiver IN ('', 'this') THEN c.class_name ELSE nullif(coalesce(a.t, b.t, regexp_replace(c.receiver, '^this\\.', '')), '') END, c.method) AS callee_id,
      c.call_type, c.file_path, c.line
    FROM ox_candidates c LEFT JOIN types a ON a.file_path = c.file_path AND a.caller = c.caller AND a.caller <> '' AND a.name = regexp_replace(c.receiver, '^this\\.', '')
      LEFT JOIN types b ON b.file_path = c.file_path AND b.caller = '' AND b.name = regexp_replace(c.receiver, '^this\\.', '')""")
def receiver_type_resolve(t):
    return U.resolve_receivers(U.call_candidates(t.wide("fx_source_files")), U.declared_types(t.wide("fx_source_files")))


oracle_view("ox_fresh", f"SELECT *, {QUALIFIED} AS full_name FROM ox_bodies WHERE {CALLABLE}")
# Of several stored units of a name the last one counts.
oracle_view("ox_stored", f"SELECT file_path, arg_max(body, start_line) AS body, {QUALIFIED} AS full_name FROM ox_bodies_old WHERE {CALLABLE} GROUP BY ALL")
SAME_TEXT = " = ".join(f"array_to_string([trim(x) for x in string_split({side}.body, {NL}) if trim(x) <> ''], {NL})" for side in ("o", "n"))


@query("unchanged_unit_skip", f"""
    SELECT n.file_path, n.full_name AS name FROM ox_fresh n
    WHERE NOT EXISTS (SELECT 1 FROM ox_stored o WHERE o.file_path = n.file_path AND o.full_name = n.full_name AND {SAME_TEXT})""")
def unchanged_unit_skip(t):
    units = U.segment_units(t.wide("fx_source_files"))
    return M.changed_units(units, U.segment_units(t.wide("fx_source_files_old"))).select("file_path", "name")


# --- decisions and masks --------------------------------------------------------------------------


def _points_sql(language: str) -> list[str]:
    out = []
    for rule in rules.DECISIONS[language]:
        if not rule.default:
            continue
        score = f"greatest({_complexity('code', language)}, {rule.least})"
        priority, kind, hint = f"({score}) * {rule.weight} + {rule.fixed}", f"'{rule.kind}'", f"'{rule.hint}'"
        if rule.kind in ("condition", "switch"):
            valid = " OR ".join(f"contains(lower(code), '{w}')" for w in rules.VALIDATION_WORDS[language])
            kind, hint = f"CASE WHEN {valid} THEN 'validation' ELSE 'condition' END", f"CASE WHEN {valid} THEN '{rules.VALIDATION_HINT}' ELSE {hint} END"
            if language == "go" and rule.kind == "condition":
                checked = "contains(code, 'err') AND contains(code, '!=')"
                priority, kind = f"CASE WHEN {checked} THEN 15 ELSE {priority} END", f"CASE WHEN {checked} THEN 'validation' ELSE {kind} END"
                hint = f"CASE WHEN {checked} THEN 'add error check' ELSE {hint} END"
        out.append(f"""
          SELECT file_path, cast(base + instr(line, hit) - 1 + instr(hit, code) - 1 AS int) AS start, code, {kind} AS kind, {hint} AS hint, cast({priority} AS int) AS priority FROM (
            SELECT file_path, line, base, regexp_extract(line, '{rule.pattern}', 0) AS hit, regexp_extract(line, '{rule.pattern}', 1) AS code FROM ox_placed WHERE language = '{language}') z
          WHERE hit <> ''""")
    return out


oracle_view("ox_placed", "SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM ox_lines")
oracle_view("ox_points", "SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY priority DESC, start) AS rn FROM ("
            + " UNION ALL ".join(sql for name in ("java", "python", "go", "typescript") for sql in _points_sql(name)) + ") p WHERE priority >= 1")


@query("decision_points", "SELECT file_path, start, kind, hint, code, priority FROM ox_points")
def decision_points(t):
    rows = M.with_decision_points(t.wide("fx_source_files")).select("file_path", F.explode("points").alias("p"))
    return rows.select("file_path", "p.start", "p.kind", "p.hint", "p.code", "p.priority")


@query("topk_per_unit", """
    SELECT file_path, cast(start_line AS int) AS start_line, cast(start AS int) AS start, priority, cast(rank AS int) AS rank FROM (
      SELECT u.file_path, u.start_line, p.start - l.base AS start, p.priority, row_number() OVER (PARTITION BY u.file_path, u.start_line ORDER BY p.priority DESC, p.start) AS rank
      FROM ox_fresh u JOIN ox_placed l ON l.file_path = u.file_path AND l.line_no = u.start_line
        JOIN ox_points p ON p.file_path = u.file_path AND p.start >= l.base AND p.start < l.base + length(u.body)) x WHERE rank <= 3""")
def topk_per_unit(t):
    units = M.with_decision_points(U.segment_units(t.wide("fx_source_files")), "body")
    rows = units.select("file_path", "start_line", F.posexplode(M.top_points(F.col("points"))).alias("pos", "p"))
    return rows.select("file_path", "start_line", "p.start", "p.priority", (F.col("pos") + 1).alias("rank"))


oracle_view("ox_masks", """
    SELECT p.*, s.text, substr(sha256(concat(p.file_path, ':', s.text)), 1, 32) AS session_id,
      concat('mask_', substr(sha256(concat(p.file_path, ':', p.start, ':', p.code)), 1, 16)) AS mask_id, s.language
    FROM ox_points p JOIN fx_source_files s ON s.file_path = p.file_path WHERE rn <= 3""")


@query("mask_spans", f"""
    SELECT file_path, session_id, mask_id, kind AS type, hint, code AS original_code, {_count("substr(text, 1, start)", chr(10))} AS start_line,
      cast(length(split_part(substr(text, 1, start), {NL}, -1)) AS int) AS start_char, {_count("substr(text, 1, start + length(code))", chr(10))} AS end_line,
      cast(length(split_part(substr(text, 1, start + length(code)), {NL}, -1)) AS int) AS end_char
    FROM ox_masks""")
def mask_spans(t):
    return M.mask_rows(M.mask_texts(t.wide("fx_source_files"), "file_path"), "file_path")


def _cut(at: str, stop: str) -> str:
    return f"substr(text, {at} + 1, {stop} - {at})"


BRACED = "concat('/* [MASK:session=', session_id, ' id=', mask_id, ' hint=\"', hint, '\"] */')"
HASHED_MARK = "concat('# [MASK:session=', session_id, ' id=', mask_id, ' hint=\"', hint, '\"]', chr(10))"
PUT = f"""CASE language WHEN 'java' THEN CASE WHEN kind IN ('condition', 'validation') THEN concat('(true ', {BRACED}, ')') ELSE concat('throw new RuntimeException(); ', {BRACED}) END
    WHEN 'go' THEN concat('(true ', {BRACED}, ')')
    WHEN 'python' THEN CASE WHEN kind IN ('condition', 'validation') THEN 'True' ELSE 'raise Exception("TODO")' END
    ELSE CASE WHEN kind IN ('condition', 'validation') THEN concat('true ', {BRACED}) ELSE concat('throw new Error("TODO"); ', {BRACED}) END END"""
# Pieces between edits, and the edits, glued in order of position.
oracle_view("ox_edits", f"""
    SELECT file_path, text, start AS a, start + length(code) AS b, {PUT} AS put FROM ox_masks
    UNION ALL SELECT file_path, text, spot, spot, concat(regexp_extract(substr(text, spot + 1), '^([ \\t]*)', 1), {HASHED_MARK}) FROM (
      SELECT *, cast(start - length(split_part(substr(text, 1, start), {NL}, -1)) AS int) AS spot FROM ox_masks WHERE language = 'python') m""")


oracle_view("ox_masked", f"""
    SELECT s.file_path, coalesce(e.masked, s.text) AS masked_code FROM fx_source_files s LEFT JOIN (
      SELECT file_path, concat(string_agg(concat({_cut('prev', 'a')}, put), '' ORDER BY a, b), max(substr(text, b + 1)) FILTER (WHERE last)) AS masked FROM (
        SELECT *, coalesce(lag(b) OVER w, 0) AS prev, row_number() OVER w = count(*) OVER (PARTITION BY file_path) AS last FROM ox_edits WINDOW w AS (PARTITION BY file_path ORDER BY a, b)) x GROUP BY file_path) e
    ON e.file_path = s.file_path""")


@query("apply_edits_desc", "SELECT * FROM ox_masked")
def apply_edits_desc(t):
    return M.mask_texts(t.wide("fx_source_files"), "file_path").select("file_path", "masked_code")


@query("mask_sessions", """
    SELECT substr(sha256(concat(s.file_path, ':', s.text)), 1, 32) AS id, s.file_path, s.language, 'pending' AS status, length(s.text) AS chars, sha256(m.masked_code) AS masked
    FROM fx_source_files s JOIN ox_masked m ON m.file_path = s.file_path""")
def mask_sessions(t):
    rows = M.mask_sessions(M.mask_texts(t.wide("fx_source_files"), "file_path"), "file_path")
    return rows.select("id", "file_path", "language", "status", F.length("original_code").cast("bigint").alias("chars"), F.sha2("masked_code", 256).alias("masked"))


@query("reassemble", f"""
    SELECT file_path, string_agg(shown, {NL} ORDER BY line_no) AS out FROM (
      SELECT l.file_path, l.line_no, CASE WHEN u.start_line = l.line_no THEN concat('<', u.name, '>') ELSE l.line END AS shown
      FROM ox_lines l LEFT JOIN (SELECT * FROM ox_units WHERE {CALLABLE} AND NOT nested) u
        ON u.file_path = l.file_path AND l.line_no BETWEEN u.start_line AND u.end_line
      WHERE u.start_line IS NULL OR u.start_line = l.line_no) x GROUP BY file_path""")
def reassemble(t):
    units = U.segment_units(t.wide("fx_source_files")).where("NOT nested")
    short = F.concat(F.lit("<"), F.substring_index("name", ".", -1), F.lit(">"))
    per_file = units.groupBy("file_path").agg(F.collect_list(F.struct("start_line", "end_line", short.alias("body"))).alias("u"))
    joined = U.hold(t.wide("fx_source_files").join(per_file.hint("merge"), "file_path", "left"), lines=text.lines(F.col("text")))
    units_or_none = F.coalesce("u", F.array().cast("array<struct<start_line:int,end_line:int,body:string>>"))
    return U.hold(joined, put=units_or_none).select("file_path", M.reassemble(F.col("lines"), F.col("put")).alias("out"))


@query("mask_changed_units", f"""
    SELECT s.file_path, EXISTS (SELECT 1 FROM ox_fresh n WHERE n.file_path = s.file_path
      AND EXISTS (SELECT 1 FROM ox_points p, ox_placed l WHERE p.file_path = n.file_path AND l.file_path = n.file_path AND l.line_no = n.start_line AND p.start >= l.base AND p.start < l.base + length(n.body))
      AND NOT EXISTS (SELECT 1 FROM ox_stored o WHERE o.file_path = n.file_path AND o.full_name = n.full_name AND {SAME_TEXT})) AS masked
    FROM fx_source_files s""")
def mask_changed_units(t):
    files, _ = M.mask_changed_units(t.wide("fx_source_files"), t.wide("fx_source_files_old"))
    return files.select("file_path", F.contains("masked_text", F.lit("[MASK:session=")).alias("masked"))


# --- markers and sessions -------------------------------------------------------------------------

_MARK = [f"""
    SELECT file_path, conv_id, turn, session_id, mask_id, hint, text, pos FROM (
      SELECT file_path, conv_id, turn, text, unnest(regexp_extract_all(text, '{p}', 1)) AS session_id, unnest(regexp_extract_all(text, '{p}', 2)) AS mask_id,
        unnest(regexp_extract_all(text, '{p}', 3)) AS hint, unnest(regexp_extract_all(text, '{p}', 0)) AS hit,
        generate_subscripts(regexp_extract_all(text, '{p}', 0), 1) AS pos FROM fx_marked_texts) x""" for p in rules.MARKERS]
oracle_view("ox_markers", " UNION ALL ".join(_MARK))


@query("marker_scan", f"""
    SELECT file_path, conv_id, turn, session_id, mask_id, hint, {_count("pre", chr(10))} AS line, cast(length(split_part(pre, {NL}, -1)) AS int) AS character
    FROM (SELECT *, substr(text, 1, instr(text, concat('[MASK:session=', session_id, ' ')) - CASE WHEN hint = 'add check' THEN 3 ELSE 4 END) AS pre FROM ox_markers) y""")
def marker_scan(t):
    return M.scan_markers(t.wide("fx_marked_texts"), ["file_path", "conv_id", "turn"])


@query("marker_sessions", """
    SELECT f.file_path, count(DISTINCT m.session_id) AS sessions, coalesce(bool_or(m.open), false) AS has_markers
    FROM (SELECT DISTINCT file_path FROM fx_marked_texts UNION SELECT DISTINCT file_path FROM fx_symbols) f LEFT JOIN (
      SELECT file_path, session_id, true AS open FROM ox_markers UNION ALL SELECT file_path, id, false FROM fx_mask_sessions) m ON m.file_path = f.file_path
    GROUP BY f.file_path""")
def marker_sessions(t):
    files = t.wide("fx_marked_texts").select("file_path").union(t.fx_symbols.select("file_path"))
    tracked = t.fx_mask_sessions.select("file_path", F.col("id").alias("session_id"))
    return Z.marker_sessions(files, M.scan_markers(t.wide("fx_marked_texts"), ["file_path"]), tracked)


@query("validation_rollup", """
    SELECT session_id, coalesce(bool_and(passed) FILTER (WHERE stage = 'parse'), false) AS passed,
      CASE WHEN coalesce(bool_and(passed) FILTER (WHERE stage = 'parse'), false) THEN 'validated' ELSE 'filled' END AS status
    FROM fx_validation GROUP BY session_id""")
def validation_rollup(t):
    return Z.validation_rollup(t.fx_validation)


@query("diagnostic_counts", """
    SELECT file_path, count(*) FILTER (WHERE severity = 'error') * 2 AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM fx_validation GROUP BY file_path""")
def diagnostic_counts(t):
    one = F.struct("severity", F.lit("m").alias("message"))
    errors = F.when(F.col("severity") == "error", F.array(one, one)).when(F.col("severity") == "warning", F.array(one)).otherwise(F.array().cast("array<struct<severity:string,message:string>>"))
    return Z.diagnostic_counts(t.fx_validation.select("file_path", errors.alias("errors")))


@query("session_transition", """
    SELECT s.id, CASE WHEN v.conv_id IS NULL THEN s.status WHEN length(v.text) % 7 <> 0 AND v.turn % 2 = 0 THEN 'validated' ELSE 'filled' END AS status, coalesce(v.text, '') AS filled_code
    FROM (SELECT concat('s', conv_id) AS id, conv_id, 'pending' AS status FROM (SELECT DISTINCT conv_id FROM conversations) c) s
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE conv_id % 3 <> 0) v ON v.conv_id = s.conv_id AND v.rn = 1""")
def session_transition(t):
    sid = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    sessions = t.conversations.select(sid.alias("id")).distinct().select("id", F.lit("").alias("filled_code"), F.lit("pending").alias("status"))
    sent = t.conversations.where("conv_id % 3 <> 0").select(sid.alias("id"), F.col("turn").alias("seq"), F.col("text").alias("code"))
    return Z.session_transitions(sessions, sent, t.fx_validation.select("session_id", "seq", "stage", "passed"))
