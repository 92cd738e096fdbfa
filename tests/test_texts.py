import hashlib
import re
import time

from pyspark.sql import functions as F

from codelattice.functions import ids, paths, rules, scoring, text
from codelattice.operators import masking as M
from codelattice.operators import report
from codelattice.operators import sessions as Z
from codelattice.operators import text_units as U
from codelattice.plans import texts
from codelattice.plans.views import Tables
from tests.conftest import rows

FILES = "file_path string, language string, text string"
JAVA = """public class UserService {
    private Repository repo;
    private Logger logger;

    public UserService(Repository repo) { this.repo = repo; }

    public void save(User user) {
        logger.info("a"); logger.info("b");
        repo.save(user);
        Cache cache = Cache.of(user);
        cache.put(new Entry(user));
        users.forEach(this::print);
    }
}
"""
PYTHON = """import os

class A:
    def __init__(self, x: int = 1):
        self.x = x

    def get(self, key, *rest):
        def inner():
            return key
        return inner()


def free(a: Dict[str, int], b=2):
    return a

x = 1
"""


def one(frame, expr, value, name="v"):
    return frame("v string", [(value,)]).select(expr.alias("r")).first()["r"]


def test_ids(frame):
    v = F.col("v")
    assert one(frame, ids.path_id(v), "src/A.java") == hashlib.sha256(b"src/A.java").hexdigest()[:16]
    want = "sym_" + hashlib.sha256(b"f:n:k:s").hexdigest()[:32]
    assert one(frame, ids.symbol_id(F.lit("f"), F.lit("n"), F.lit("k"), F.lit("s")), "") == want
    assert one(frame, ids.edge_source(v), "a::b::c") == "a" and one(frame, ids.edge_target(v), "a::b::c") == "b::c"
    assert one(frame, ids.edge_source(v), "ab") is None


def test_paths(frame):
    v = F.col("v")
    assert [one(frame, paths.dir_name(v), p) for p in ("a/b/c.java", "c.java", "/c.java")] == ["a/b", ".", "/"]
    assert one(frame, paths.language_of(v), "x/Y.TSX") == "typescript" and one(frame, paths.language_of(v), "x/y.txt") is None
    assert one(frame, paths.file_uri(v), "/a b/ü+(1).py") == "file:///a%20b/%C3%BC+%281%29.py"
    assert [one(frame, paths.class_of_label(v), p) for p in ("A.b.c", "main", ".x")] == ["A", "main", ".x"]
    assert one(frame, paths.within(v, "/ws"), "/ws//a/./b") and not one(frame, paths.within(v, "/ws"), "/wsx/a")


def test_lines_and_positions(frame):
    v = F.col("v")
    assert [one(frame, text.lines(v), t) for t in ("", "a", "a\n", "a\n\n", "\nb")] == [[], ["a"], ["a"], ["a", ""], ["", "b"]]
    assert one(frame, F.struct(text.line_at(v, F.lit(4)), text.character_at(v, F.lit(4))), "äb\nüc") == (1, 1)
    assert one(frame, text.normalise_whitespace(v), "  a  b \n\n\t c\n") == "a  b\nc"
    assert one(frame, text.first_line_signature(v, 5), "  abcdefg\nx") == "abcde..."
    assert one(frame, text.split_params(v), " a: Map<K, V>, b = f(1, 2), *c,, ") == ["a: Map<K, V>", "b = f(1, 2)", "*c"]


def test_complexity(frame):
    v = F.col("v")
    code = '(email != null && email.contains("@") && age > 0 && age < 150)'
    assert one(frame, scoring.complexity(v, "java"), code) == 8
    assert one(frame, scoring.complexity(v, "python"), "a and b or not c") == 2
    assert one(frame, scoring.complexity(v, "python"), "x") == 1
    assert one(frame, scoring.complexity(v, "typescript"), "a === b && c !== d || e == f") == 5
    assert one(frame, scoring.complexity(v, "java"), "a !== b") == 2


def test_java_units_and_symbols(frame):
    files = frame(FILES, [("src/UserService.java", "java", JAVA), ("README.md", "java", "nothing here")])
    assert rows(U.segment_units(files), "name", "start_line", "end_line", "is_public", "params") == [("save", 7, 13, True, "User user")]
    assert rows(U.without_units(files), "file_path") == [("README.md",)]
    assert rows(U.symbol_table(files), "name", "kind", "line") == [
        ("UserService", "class", 1), ("UserService.<init>(Repository)", "constructor", 5), ("UserService.logger", "field", 3),
        ("UserService.repo", "field", 2), ("UserService.save(User)", "method", 7)]


NESTED = """class A {
  static class B {
    int n;
    int x() { return n; }
  }
  void y(int k) {
    run(k);
  }
  interface C { }
  abstract void z();
}
"""


def test_a_unit_belongs_to_the_class_around_it(frame):
    files = frame(FILES, [("A.java", "java", NESTED)])
    got = U.symbol_table(files).orderBy("line").select("name", "line", "end_line").collect()
    assert [tuple(r) for r in got] == [
        ("A", 1, 11), ("B", 2, 5), ("B.n", 3, 3), ("B.x()", 4, 4), ("A.y(int)", 6, 8), ("C", 9, 9), ("A.z()", 10, 10)]
    assert rows(U.call_candidates(files), "class_name", "caller", "line", "method") == [("A", "y", 7, "run")]


def test_layouts(frame):
    narrow = "class A:\n  def f(self): return 1\n\n  def g(self):\n    def h(): pass\n    return h\n"
    arrow = "export const f = (a: number) => {\n  const g = b => b;\n};\nlet h = x => x;\n"
    files = frame(FILES, [("a.py", "python", narrow), ("a.ts", "javascript", arrow)])
    assert rows(U.segment_units(files), "name", "start_line", "end_line") == [("A.f", 2, 2), ("A.g", 4, 6), ("f", 1, 3), ("h", 4, 4)]
    odd = frame(FILES, [("e.go", "go", ""), ("n.go", "go", None), ("t.txt", "text", "func f() {\n}")])
    assert rows(U.without_units(odd), "file_path") == [("e.go",), ("n.go",)]


def test_go_calls(frame):
    go = "package p\nfunc (s *S) Put(f func(int) int) (int, error) {\n  go s.db.Save(f(1)) // no(1)\n  b := []byte(Max(2))\n  a().b()\n}\n"
    calls = U.call_candidates(frame(FILES, [("a.go", "go", go)]))
    assert rows(calls, "class_name", "caller", "receiver", "method", "call_type", "line") == [
        ("S", "Put", "", "Max", "direct", 4), ("S", "Put", "", "a", "direct", 5), ("S", "Put", "", "f", "direct", 3), ("S", "Put", "s.db", "Save", "direct", 3)]
    types = U.declared_types(frame(FILES, [("a.go", "go", go)]))
    assert ("S.Put", "Max") in rows(U.resolve_receivers(calls, types), "caller_id", "callee_id")


def test_python_units(frame):
    files = frame(FILES, [("pkg/mod.py", "python", PYTHON)])
    assert rows(U.segment_units(files), "name", "start_line", "end_line") == [("A.__init__", 4, 5), ("A.get", 7, 10), ("free", 13, 14)]
    assert rows(U.symbol_table(files), "name", "kind") == [
        ("A", "class"), ("A.<init>(int)", "constructor"), ("A.get(_,_)", "method"), ("mod.free(Dict[str,int],_)", "method")]


def test_body_hash_ignores_layout_and_comments(frame):
    v = F.col("v")
    a, b = "x = 1; // note\n  y();", "x   =  1;\n/* other\n note */ y();"
    assert one(frame, text.body_hash(v, "java"), a) == one(frame, text.body_hash(v, "java"), b)
    assert one(frame, text.body_hash(v, "java"), "") == hashlib.sha256(b"").hexdigest()
    assert one(frame, text.body_hash(v, "java"), "x = 2;") != one(frame, text.body_hash(v, "java"), a)


def test_calls_resolve_receivers_to_types(frame):
    files = frame(FILES, [("src/UserService.java", "java", JAVA)])
    calls = U.resolve_receivers(U.call_candidates(files), U.declared_types(files))
    assert rows(calls, "caller_id", "callee_id", "call_type", "line") == [
        ("UserService.save", "Cache.of", "static", 10), ("UserService.save", "Cache.put", "direct", 11), ("UserService.save", "Entry.<init>", "constructor", 11),
        ("UserService.save", "Logger.info", "direct", 8), ("UserService.save", "Repository.save", "direct", 9),
        ("UserService.save", "UserService.print", "method_reference", 12), ("UserService.save", "users.forEach", "direct", 12)]


def test_constructor_chaining_and_overloads(frame):
    java = "class A extends B {\n  C v;\n  A(int k) {\n    super(k);\n  }\n  A() {\n    this(1); v.go();\n  }\n  void run(int a) {\n    Bar v = f(a);\n    v.go();\n  }\n  void run() {\n    Alt v = g();\n    v.go();\n  }\n}\n"
    files = frame(FILES, [("A.java", "java", java)])
    calls = U.resolve_receivers(U.call_candidates(files), U.declared_types(files))
    assert rows(calls, "caller_id", "callee_id", "call_type", "line") == [
        ("A.A", "A.<init>", "constructor", 7), ("A.A", "C.go", "direct", 7), ("A.A", "super.<init>", "super", 4), ("A.run", "A.f", "direct", 10),
        ("A.run", "A.g", "direct", 14), ("A.run", "Alt.go", "direct", 15), ("A.run", "Bar.go", "direct", 11)]


def test_decision_points_and_masks(frame):
    code = 'void f(String s) {\n  if (s == null) {\n    throw new E("x");\n  }\n  if (a.b > 1 && c) {\n  }\n  int y = n > 3 ? 1 : 2;\n}'
    files = frame(FILES, [("F.java", "java", code)])
    points = M.with_decision_points(files).select(F.explode("points").alias("p")).select("p.*").collect()
    assert [(p.kind, p.code, p.priority) for p in points] == [
        ("condition", "(a.b > 1 && c)", 30), ("validation", "(s == null)", 10), ("condition", "n > 3", 8), ("error", 'throw new E("x");', 7)]
    masked = M.mask_texts(files, "file_path", limit=2)
    out = masked.first()
    assert "if (true /* [MASK:session=" in out.masked_code and 'throw new E("x");' in out.masked_code
    masks = rows(M.mask_rows(masked, "file_path"), "start_line", "start_char", "end_line", "end_char", "original_code")
    assert masks == [(1, 5, 1, 16, "(s == null)"), (4, 5, 4, 19, "(a.b > 1 && c)")]
    again = M.scan_markers(masked.select("file_path", F.col("masked_code").alias("text")), ["file_path"])
    assert rows(again, "hint", "line") == [("add validation check", 1), ("complete the condition", 4)]
    assert M.mask_texts(files, "file_path", limit=0).select(F.size("masked_points")).first()[0] == 4


def test_go_error_checks_and_python_comments(frame):
    go = "func f() {\n  if err != nil {\n    return err\n  }\n}"
    py = "def f(x):\n    if x is not None:\n        raise ValueError(x)\n    return x"
    files = frame(FILES, [("f.go", "go", go), ("f.py", "python", py)])
    got = {r.file_path: r for r in M.mask_texts(files, "file_path").collect()}
    assert [(p.hint, p.priority) for p in got["f.go"].points] == [("add error check", 15)]
    lines = got["f.py"].masked_code.split("\n")
    assert lines[1].startswith("    # [MASK:session=") and lines[2] == "    if True:"
    assert lines[3].startswith("        # [MASK:session=") and lines[4] == '        raise Exception("TODO")'
    assert M.with_decision_points(files, returns=True).where("language = 'go'").select(F.size("points")).first()[0] == 1


def test_edits_apply_from_the_end(frame):
    edits = F.expr("array(named_struct('start', 0, 'stop', 1, 'put', 'XX'), named_struct('start', 2, 'stop', 3, 'put', ''), named_struct('start', 4, 'stop', 4, 'put', '!'))")
    assert one(frame, M.apply_edits(F.col("v"), edits), "abcd") == "XXbd!"


def test_only_changed_units_are_masked_and_put_back(frame):
    old = "class A {\n  void f(int a) {\n    if (a > 1) {\n    }\n  }\n\n  void g(int a) {\n    if (a > 1) {\n    }\n  }\n}\n"
    new = old.replace("  void g(int a) {\n    if (a > 1)", "  void g(int a) {\n    if (a > 2)").replace("  void f(int a) {\n", "  void f(int a) {\n\n")
    out, masked = M.mask_changed_units(frame(FILES, [("A.java", "java", new)]), frame(FILES, [("A.java", "java", old)]))
    assert rows(masked, "name") == [("g",)]
    got = out.first()["masked_text"].split("\n")
    assert got[3] == "    if (a > 1) {" and got[8].startswith("    if (true /* [MASK:session=")
    same, _ = M.mask_changed_units(frame(FILES, [("A.java", "java", old)]), frame(FILES, [("A.java", "java", old)]))
    assert same.first()["masked_text"] == old


def test_reassemble_skips_ranges_outside(frame):
    units = F.expr("array(named_struct('start_line', 2, 'end_line', 3, 'body', 'X\\nY\\nZ'), named_struct('start_line', 9, 'end_line', 12, 'body', 'no'))")
    df = U.hold(frame("v string", [("a\nb\nc\nd",)]), lines=text.lines(F.col("v")), units=units)
    assert df.select(M.reassemble(F.col("lines"), F.col("units")).alias("r")).first()["r"] == "a\nX\nY\nZ\nd"


def test_sessions(frame):
    results = frame("session_id string, stage string, passed boolean, seq int", [("a", "parse", True, 1), ("b", "parse", False, 1), ("c", "semantic", True, 1), ("a", "parse", False, 0)])
    assert rows(Z.validation_rollup(results.where("seq = 1")), "session_id", "passed") == [("a", True), ("b", False), ("c", False)]
    sessions = frame("id string, filled_code string, status string", [(s, "", "pending") for s in "abcd"])
    sent = frame("id string, seq int, code string", [("a", 0, "old"), ("a", 1, "new"), ("b", 1, "bad")])
    assert rows(Z.session_transitions(sessions, sent, results), "id", "filled_code", "status") == [
        ("a", "new", "validated"), ("b", "bad", "filled"), ("c", "", "pending"), ("d", "", "pending")]


def test_overlapping_points_are_masked_once(frame):
    code = "class A {\n  void f() {\n    if ((x = a > 1 && c.d() ? 1 : 0) > 0) {\n      y();\n    }\n  }\n}\n"
    masked = M.mask_texts(frame("path string, language string, text string", [("A.java", "java", code)]), "path", limit=0).persist()
    marks = masked.select(F.regexp_count("masked_code", F.lit("mask_[0-9a-f]{16}"))).first()[0]
    assert M.mask_rows(masked, "path").count() == marks > 0


def test_parent_folders_are_resolved(frame):
    wanted = {"/ws/../etc/x": "/etc/x", "/ws/a/../b": "/ws/b", "/../x": "/x", "../x": "../x", "a/../../x": "../x", "/ws//a/./b/": "/ws/a/b", "/a/..": "/", "/a..b/c": "/a..b/c"}
    df = frame("p string", [(p,) for p in wanted]).select("p", paths.normalised(F.col("p")).alias("n"), paths.within(F.col("p"), "/ws").alias("w"))
    found = {r.p: (r.n, r.w) for r in df.collect()}
    assert {p: n for p, (n, _) in found.items()} == wanted
    assert [p for p, (_, w) in found.items() if w] == ["/ws/a/../b", "/ws//a/./b/"]


def test_numbers_as_sort_keys(frame):
    numbers = [-(2**63), -1234567890123456789, -5, -1, 0, 3, 20, 2**63 - 1]
    df = frame("n long", [(n,) for n in reversed(numbers)]).orderBy(report._sortable(F.col("n")))
    assert [r.n for r in df.collect()] == numbers


def test_texts_of_a_small_file_are_spread_over_the_cores(spark, tmp_path):
    """One small file used to be one task, however much text its rows make."""
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, '1-URGENT' AS o_orderpriority FROM range(100)").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    files = Tables(spark, str(tmp_path)).wide("fx_source_files")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert files.count() == 100


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_declarations_are_looked_for_once(spark, tmp_path):
    """Locals and fields used to be cut from the texts by two jobs beside that of the calls, and broadcast."""
    spark.range(10).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    files = Tables(spark, str(tmp_path)).wide("fx_chained_files")
    plan = _plan(U.resolve_receivers(U.call_candidates(files), U.declared_types(files)))
    assert plan.count("FileScan") == 2 and "Broadcast" not in plan


def test_stored_units_are_not_broadcast(spark, tmp_path):
    """Spark takes the units for as small as the table of texts, so a broadcast held all of them in the driver."""
    spark.range(10).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    files = Tables(spark, str(tmp_path)).wide("fx_chained_files")
    assert "Broadcast" not in _plan(M.changed_units(U.segment_units(files), U.segment_units(files)))
    assert "Broadcast" not in _plan(M.mask_changed_units(files, files)[0])


def test_a_long_indent_is_gone_through_once(spark):
    """A line that is no unit is not tried anew for each blank before it."""
    line = " " * 30_000 + "client.send(order);"
    code = "class A {\n  void run() {\n" + f"{line}\n" * 40 + "  }\n}\n"
    files = spark.createDataFrame([("A.java", "java", code), ("B.java", "java", "class B {\n" + f"{line}\n" * 40 + "}\n")], FILES)
    start = time.monotonic()
    assert U.call_candidates(files).where("receiver = 'client' and method = 'send' and caller = 'run'").count() == 40
    assert rows(U.without_units(files), "file_path") == [("B.java",)]
    assert time.monotonic() - start < 40


def test_words_tried_once_find_the_same_calls(spark):
    found = []
    for code in ("a.b.c (x), new  T(y) X::m new(z) xnew Foo(", "éfoo(1) _a1.b(2) a .b(3) a.(4) this (5) super.x(6)", "X::m::n(a::b(c)) renew New(a) new X::new(", "a..b(c) 1.2.f(x) new\tK.L(m)"):
        df = spark.createDataFrame([(code,)], "code string")
        found.append(df.select(*[F.regexp_extract_all("code", F.lit(p), F.lit(0)) for p in (rules.CALL, rules.FAST_CALL)]).first())
    assert all(slow == fast and slow for slow, fast in found)


def test_constructors_parameters_are_split(frame):
    """Constructors used to be given one fixed parameter list, and a semicolon in a type became a bar."""
    java = "class A {\n  A(int x, Map<K, V> m) {\n  }\n  A() {\n  }\n  void f(int a, int b) {\n  }\n}\n"
    python = "class B:\n    def __init__(self, k=(1, 2)):\n        pass\n"
    script = "function g(o: { a: string; b: number }, p) {\n}\n"

    class T:
        def wide(self, name):
            if name == "documents":
                return frame("doc_id long, text string", [(7, "x, (y), z")])
            return frame(FILES, [("A.java", "java", java), ("b.py", "python", python), ("g.ts", "typescript", script)])

    got = rows(texts.split_params(T()), "file_path", "start_line", "parts")
    assert got == [("A.java", 2, "int x|Map<K, V> m"), ("A.java", 4, ""), ("A.java", 6, "int a|int b"), ("b.py", 2, "self|k=(1, 2)"), ("doc7", 0, "x|y|z"), ("g.ts", 1, "o: { a: string; b: number }|p")]


def test_symbols_of_some_kinds(frame):
    java = "class A {\n  int n, m = 1;\n  A(int x, Map<K, V> m) {\n    n = x;\n  }\n  void f() {\n  }\n}\n"
    files = frame(FILES, [("A.java", "java", java), ("b.py", "python", "class B:\n  def __init__(self, k: int):\n    self.k = k\n")])
    some = U.symbol_table(files, kinds=("constructor", "field"), params=True)
    assert rows(some, "name", "params") == [("A.<init>(int,Map<K,V>)", ["int x", "Map<K, V> m"]), ("A.m", []), ("A.n", []), ("B.<init>(int)", ["self", "k: int"])]
    whole = U.symbol_table(files)
    assert rows(whole.where("kind in ('constructor', 'field')"), *whole.columns) == rows(some, *whole.columns)


def test_tokens_and_lines_equal_plain_versions(frame):
    odd = ["", " ", "\n", " a \n\n\tb  c\u00a0\n", "\u2003x\r\n\x0by\u0085", "no break", "\n\n", "a\n \u3000\nb\n", 'f("a b", \'c\') + "x\\"y" "open\n  z_1 é', "  // c\n g /* d */ h", "\u00a0a"]
    space = "[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    df = frame("k int, t string", list(enumerate([*odd, None])))
    got = {r.k: (r.n, r.h) for r in df.select("k", text.normalise_whitespace(F.col("t")).alias("n"), text.body_hash(F.col("t"), "java").alias("h")).collect()}
    assert got.pop(len(odd)) == (None, hashlib.sha256(b"").hexdigest())
    for k, t in enumerate(odd):
        kept = [s for s in (re.sub(f"^{space}+|{space}+\\Z", "", s) for s in t.split("\n")) if s]
        code = re.sub(r"//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/", " ", t)
        tokens = re.findall(r"\"(?:[^\"\\\n]|\\.)*\"|\w+|[^\w\s]", code, re.ASCII)
        assert got[k] == ("\n".join(kept), hashlib.sha256(" ".join(tokens).encode()).hexdigest()), t


def test_blanks_inside_a_line_are_gone_through_once(frame):
    """Each blank of a line used to be tried anew as the start of its end."""
    df = frame("t string", [("a" + " " * 200_000 + "b\n" + " " * 200_000,)]).select(F.length(text.normalise_whitespace(F.col("t"))).alias("n"))
    start = time.monotonic()
    assert df.first()["n"] == 200_002 and time.monotonic() - start < 20
