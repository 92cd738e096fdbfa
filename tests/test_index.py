from codelattice.operators import index as I
from tests.conftest import rows

SYMBOL = "id string, name string, file_path string, body_hash string, seq int"
CALL = "caller_id string, callee_id string, call_type string, file_path string, line int"
MANIFEST = "file_path string, file_hash string"


def test_delta_keeps_manual_calls_and_drops_stale_ones(frame):
    symbols = frame(SYMBOL, [("callerOld", "a", "/tmp/A.java", "h", 0), ("removedSym", "b", "/tmp/A.java", "h", 0), ("other", "o", "/tmp/B.java", "h", 0)])
    calls = frame(CALL, [
        ("callerOld", "target1", "direct", "/tmp/A.java", 1), ("external", "removedSym", "direct", "/tmp/B.java", 1),
        ("callerOld", "manualTarget", "manual", "", 0)])
    manifest = frame(MANIFEST, [("/tmp/A.java", "old"), ("/tmp/B.java", "b")])
    files = frame(MANIFEST, [("/tmp/A.java", "filehash")])
    new = frame(SYMBOL, [("callerOld", "a", "/tmp/A.java", "newhash", 1), ("newSym", "n", "/tmp/A.java", "x", 1)])
    diff = frame("id string, change string", [("callerOld", "changed"), ("removedSym", "removed")])
    fresh = frame(CALL, [("callerOld", "target2", "direct", "/tmp/A.java", 2)])
    out = I.apply_file_delta(symbols, calls, manifest, files, new, diff, fresh, "seq")
    assert rows(out["symbols"], "id", "body_hash") == [("callerOld", "newhash"), ("newSym", "x"), ("other", "h")]
    assert rows(out["method_calls"], "callee_id") == [("manualTarget",), ("target2",)]
    assert rows(out["manifest"], "*") == [("/tmp/A.java", "filehash"), ("/tmp/B.java", "b")]
    # Applying the same delta again changes the calls of the changed unit only by their new copy.
    again = I.apply_file_delta(out["symbols"], out["method_calls"], out["manifest"], files, new, diff, fresh, "seq")
    assert rows(again["symbols"], "id") == rows(out["symbols"], "id")
    assert rows(again["method_calls"], "*") == rows(out["method_calls"], "*")


def test_delta_with_no_symbols_empties_the_file(frame):
    symbols = frame(SYMBOL, [("a", "a", "A", "h", 0), ("b", "b", "B", "h", 0)])
    none, calls = symbols.limit(0), frame(CALL, [])
    out = I.apply_file_delta(symbols, calls, frame(MANIFEST, []), frame(MANIFEST, [("A", "")]), none, frame("id string, change string", []), calls, "seq")
    assert rows(out["symbols"], "id") == [("b",)] and out["manifest"].count() == 0


def test_delta_over_all_files_equals_replace(frame):
    symbols = frame(SYMBOL, [("a", "a", "A", "h", 0), ("b", "b", "B", "h", 0)])
    calls = frame(CALL, [("a", "b", "direct", "A", 1), ("a", "b", "manual", "", 0)])
    new = frame(SYMBOL, [("a", "a", "A", "h2", 1), ("c", "c", "B", "h", 1)])
    fresh = frame(CALL, [("a", "c", "direct", "A", 1)])
    diff = frame("id string, change string", [("a", "changed"), ("c", "changed"), ("b", "removed")])
    files = frame(MANIFEST, [("A", "1"), ("B", "2")])
    delta = I.apply_file_delta(symbols, calls, frame(MANIFEST, []), files, new, diff, fresh, "seq")
    replaced, recalled = I.replace_index(calls, new, fresh, "seq")
    assert rows(delta["symbols"], "*") == rows(replaced, "*")
    assert rows(delta["method_calls"], "*") == rows(recalled, "*")


def test_replace_twice_is_replace_once(frame):
    calls = frame(CALL, [("a", "b", "manual", "", 0), ("a", "b", "direct", "f", 1)])
    new = frame(SYMBOL, [("a", "one", "A", "h", 1), ("a", "two", "A", "h", 2)])
    fresh = frame(CALL, [("x", "y", "direct", "f", 1)])
    once = I.replace_index(calls, new, fresh, "seq")
    twice = I.replace_index(once[1], new, fresh, "seq")
    assert rows(once[0], "name") == [("two",)]
    assert rows(once[1], "*") == rows(twice[1], "*") == [("a", "b", "manual", "", 0), ("x", "y", "direct", "f", 1)]
    assert rows(I.replace_index(calls, new, fresh, "seq", rebuild=True)[1], "*") == [("x", "y", "direct", "f", 1)]


def test_unit_diff_classes(frame):
    unit = "id string, kind string, body_hash string"
    old = frame(unit, [("same", "method", "1"), ("edited", "method", "1"), ("gone", "constructor", "1"), ("fn", "function", "1"), ("cls", "class", "1")])
    new = frame(unit, [("same", "method", "1"), ("edited", "method", "2"), ("born", "method", "1"), ("fn", "function", "1")])
    assert dict(rows(I.unit_diff(old, new), "id", "change")) == {"same": "same", "edited": "changed", "gone": "removed", "born": "changed", "fn": "same"}
    assert dict(rows(I.unit_diff(old, new, strict_reference=True), "id", "change"))["fn"] == "changed"


def test_upserts(frame):
    table = frame("k string, v string, seq int", [("a", "old", 0), ("b", "kept", 0)])
    batch = frame("k string, v string, seq int", [("a", "first", 1), ("a", "last", 2)])
    assert rows(I.upsert_last_wins(table, batch, ["k"], "seq"), "k", "v") == [("a", "last"), ("b", "kept")]
    writes = frame("k string, v string, seq int, created int", [("a", "x", 1, 10), ("a", "y", 2, 20)])
    folded = I.upsert_keep_created(writes, ["k"], "seq", "created")
    assert rows(folded, "k", "v", "created") == [("a", "y", 10)]


def test_patch_overwrites_only_what_is_given(frame):
    notes = frame("node_id string, description string, ai_remarks string", [("a", "d", "r"), ("b", "d", "r")])
    patches = frame("node_id string, description string, ai_remarks string, seq int", [("a", "", None, 1), ("a", None, "later", 2), ("c", "new", None, 1)])
    got = I.patch_annotations(notes, patches, ["description", "ai_remarks"], "seq")
    assert rows(got, "*") == [("a", "", "later"), ("b", "d", "r"), ("c", "new", "")]


def test_virtual_entities(frame):
    node = "request_id bigint, label string, type string, virtual_class_id string, virtual_directory string"
    made, bad = I.create_virtual_nodes(frame(node, [(1, "A.b", "method", "", "x"), (2, "", "method", "", "")]))
    assert rows(made, "label", "virtual_class_id", "virtual_directory") == [("A.b", None, "x")] and rows(bad, "request_id") == [(2,)]
    dirs = frame("request_id bigint, path string, name string, parent_path string", [(1, "p/a", "a", "p"), (2, "p/a", "a", "p"), (3, "p/b", "b", "")])
    made, bad = I.create_directories(dirs, frame("path string", [("p/b",)]))
    assert rows(made, "path") == [("p/a",)] and rows(bad, "request_id") == [(2,), (3,)]


def test_cache_states(frame):
    old, new = frame(MANIFEST, [("a", "1"), ("b", "1"), ("c", "1")]), frame(MANIFEST, [("a", "1"), ("b", "2"), ("d", "1")])
    assert dict(rows(I.cache_state(old, new), "*")) == {"a": "same", "b": "changed", "c": "gone", "d": "new"}


def test_built_plans_are_marked(frame):
    virtual = frame("id string, label string, materialized boolean", [("v1", "A.b(int)", False), ("v2", "A.b", False), ("v3", "x", True)])
    symbols = frame("name string", [("A.b(int)",)])
    assert rows(I.mark_materialised(virtual, symbols), "id", "materialized") == [("v1", True), ("v2", False), ("v3", True)]
    assert rows(I.mark_materialised(virtual, symbols, ignore_parameters=True), "id", "materialized") == [("v1", True), ("v2", True), ("v3", True)]


def test_patches_keep_other_columns(frame):
    table = frame("node_id string, description string, code string", [("a", "old", "x = 1")])
    patches = frame("node_id string, description string, at long", [("a", "new", 1), ("b", "more", 1)])
    assert rows(I.patch_annotations(table, patches, ["description"], "at"), "node_id", "description", "code") == [("a", "new", "x = 1"), ("b", "more", None)]
