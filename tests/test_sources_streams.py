import os
import time

from pyspark.sql import functions as F

from codelattice import session
from codelattice.sources import corpus, folders, versioned
from codelattice.streaming import feeds as S
from tests.conftest import rows


def test_corpus_read(spark, tmp_path):
    for name in ("a/A.java", "a/b.PY", "a/c.txt", ".git/x.java", "node_modules/y.js", "a/build/z.go", "t.ts"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x ü")
    got = rows(corpus.read_corpus(spark, str(tmp_path)), "path", "language", "text")
    assert [(p.removeprefix(str(tmp_path)), lang) for p, lang, _ in got] == [("/a/A.java", "java"), ("/a/b.PY", "python"), ("/t.ts", "typescript")]
    assert got[0][2] == "x ü"


def test_versions_show_only_committed_saves(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versioned.latest_version(spark, root) == 0
    versioned.save_tables(spark, root, {"a": spark.range(2)}, "one")
    spark.range(9).write.parquet(f"{root}/version=2/a")  # a save that died before its commit
    assert versioned.load_tables(spark, root, ["a"])["a"].count() == 2
    assert versioned.save_tables(spark, root, {"a": spark.range(3)}, "two") == 2
    assert versioned.load_tables(spark, root, ["a"])["a"].count() == 3
    assert versioned.is_committed(spark, root, "one") and not versioned.is_committed(spark, root, "three")


def test_debounce_joins_saves_closer_than_the_gap(spark):
    saves = spark.sql("""SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01 00:00:00.1', 'a.go'), (2, timestamp_ntz'2024-01-01 00:00:00.8', 'a.go'),
        (3, timestamp_ntz'2024-01-01 00:00:01.6', 'a.go'), (4, timestamp_ntz'2024-01-01 00:00:02.6', 'a.go'), (5, timestamp_ntz'2024-01-01 00:00:00.2', 'b.go') AS t(event_id, ts, file_path)""")
    want = [("a.go", 1, 4), ("a.go", 3, 3), ("b.go", 1, 5)]
    assert rows(S.debounce_batch(saves), "file_path", "saves", "last_event") == want
    assert rows(S.debounce(saves, "900 milliseconds"), "file_path", "saves", "last_event") == want


def test_usage_lines_round_trip(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS ts, 'kg.x' AS f, 'ok' AS s, 'a=1, b=two' AS d")
    lines = df.select(S.usage_line(F.col("ts"), F.col("f"), F.col("s"), F.col("d")).alias("line")).union(spark.sql("SELECT 'noise'"))
    got = S.parse_usage(lines).collect()
    assert len(got) == 1 and got[0].feature == "kg.x" and got[0].details == {"a": "1", "b": "two"}


def _feed(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, "file_path string, file_hash string, id string, kind string, body_hash string, seq bigint").coalesce(1).write.mode("append").parquet(folder)


def test_saved_files_are_applied_batch_by_batch_and_once(spark, tmp_path):
    root, folder, state = (str(tmp_path / n) for n in ("store", "feed", "state"))
    start = {
        "symbols": spark.createDataFrame([("a", "method", "A", "1", 0), ("b", "method", "B", "1", 0)], "id string, kind string, file_path string, body_hash string, seq bigint"),
        "method_calls": spark.createDataFrame([("a", "b", "direct", "A", 1), ("b", "a", "direct", "B", 1)], "caller_id string, callee_id string, call_type string, file_path string, line int"),
        "manifest": spark.createDataFrame([("A", "1"), ("B", "1")], "file_path string, file_hash string")}
    versioned.save_tables(spark, root, start)
    _feed(spark, folder, [[("A", "2", "a", "method", "2", 1), ("A", "2", "c", "method", "1", 1)], [("B", "2", "d", "method", "1", 2)]])

    def calls_of(changed):
        return changed.select(F.col("id").alias("caller_id"), F.lit("x").alias("callee_id"), F.lit("direct").alias("call_type"), F.lit("n").alias("file_path"), F.lit(1).alias("line"))

    for _ in range(2):  # the second run finds nothing new
        feed = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
        S.incremental_index(feed, root, calls_of, state)
    got = versioned.load_tables(spark, root, S.INDEX_TABLES)
    assert versioned.latest_version(spark, root) == 3
    assert rows(got["symbols"], "id", "body_hash") == [("a", "2"), ("c", "1"), ("d", "1")]
    assert rows(got["method_calls"], "caller_id", "callee_id") == [("a", "x"), ("c", "x"), ("d", "x")]
    assert rows(got["manifest"], "*") == [("A", "2"), ("B", "2")]


def test_checkpoint_folder_stays_the_same(spark):
    folder = session.checkpoint_dir(spark)
    assert folder and session.checkpoint_dir(spark) == folder
    assert session.cut_lineage(spark.range(5)).count() == 5


def test_own_extractor(spark):
    from codelattice.model import SYMBOLS
    from codelattice.sources.extractors import extract_symbols

    def extract(batches):
        for batch in batches:
            out = batch[["file_path"]].assign(id=batch.file_path, name="n", kind="method", line=1, end_line=2, signature=batch.text, body_hash="", created_at=0)
            yield out[SYMBOLS.names]

    files = spark.createDataFrame([("a.x", "x", "hello")], "file_path string, language string, text string")
    assert rows(extract_symbols(files, extract), "id", "signature") == [("a.x", "hello")]


def test_loose_values(spark):
    from codelattice.functions import coerce

    df = spark.createDataFrame([('{"f": "a", "n": 7.9}',), ('{"f": 3, "n": "7"}',), ("broken",), (None,), ('{"n": -2}',)], "j string")
    got = df.select(coerce.json_text_or_empty(F.col("j"), "$.f").alias("f"), coerce.json_int_or_zero(F.col("j"), "$.n").alias("n")).collect()
    assert [tuple(r) for r in got] == [("a", 7), ("", 0), ("", 0), ("", 0), ("", -2)]
    assert [r[0] for r in spark.sql("SELECT * FROM VALUES ('12'), ('x'), ('-1.5') AS t(v)").select(coerce.int_or_zero(F.col("v"))).collect()] == [12, 0, -1]


def test_folders_are_skipped_before_they_are_listed(spark, tmp_path, monkeypatch):
    for name in ("a/A.java", "a/b.PY", "a/c.txt", ".git/x.java", "node_modules/deep/y.js", "a/build/z.go", "t.ts", "a/b/c/d/e.go"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x ü")
    (tmp_path / "empty" / "inner").mkdir(parents=True)
    root = str(tmp_path)
    got = rows(folders.read_sources(spark, root), "path", "language", "length", "text")
    assert [(p.removeprefix(root), lang) for p, lang, _, _ in got] == [("/a/A.java", "java"), ("/a/b.PY", "python"), ("/a/b/c/d/e.go", "go"), ("/t.ts", "typescript")]
    assert got[0][2:] == (4, "x ü")
    old = rows(corpus.read_corpus(spark, root), "path", "file_hash")
    assert rows(folders.read_sources(spark, root), "path", "file_hash") == old
    (tmp_path / "link").symlink_to(tmp_path)

    listed = []
    plain = folders.Walk.listed
    monkeypatch.setattr(folders.Walk, "listed", lambda self, store, folder: listed.append(folder.removeprefix(root)) or plain(self, store, folder))
    for parts in ("1", "2", "64"):
        reader = folders.FolderReader({"path": root, "skip": r"\..*|node_modules|build", "suffixes": ".go,.ts", "parts": parts})
        shares = reader.partitions()
        assert len(shares) <= int(parts)
        found = [r for s in shares for b in reader.read(s) for r in b.to_pylist()]
        assert sorted(r["path"].removeprefix(root) for r in found) == ["/a", "/a/b", "/a/b/c", "/a/b/c/d", "/a/b/c/d/e.go", "/empty", "/empty/inner", "/t.ts"]
        assert sorted(r["content"] for r in found if not r["is_folder"]) == ["x ü".encode()] * 2
    assert not [f for f in listed if f.startswith(("/.git", "/node_modules", "/a/build", "/link"))]

    dirs, files = folders.list_workspace(spark, root)
    assert [r[0] for r in rows(dirs, "path")] == ["a", "a/b", "a/b/c", "a/b/c/d", "a/build", "empty", "empty/inner", "node_modules", "node_modules/deep"]
    assert [r[0] for r in rows(files, "path")] == ["a/A.java", "a/b.PY", "a/b/c/d/e.go", "a/build/z.go", "node_modules/deep/y.js", "t.ts"]


def test_a_table_in_a_folder_of_files_streams_whole(spark, tmp_path):
    turns = spark.range(40).selectExpr("concat('s', id % 4) AS id", "cast(id AS int) AS seq", "concat('t', id) AS status")
    turns.repartition(20).write.parquet(f"{tmp_path}/turns.parquet")
    turns.coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    events = S.table_stream(spark, str(tmp_path), "turns")
    got = S.update_available(S.latest_status(events), "status", ["id"], "seq")
    assert rows(got, "id", "status", "seq") == [("s0", "t36", 36), ("s1", "t37", 37), ("s2", "t38", 38), ("s3", "t39", 39)]


def test_units_of_one_save_may_lie_in_many_files(spark, tmp_path):
    """More files than a bounded batch held: all units of the save count, not those of the last batch."""
    units = spark.range(40).selectExpr("'a.go' AS file_path", "'h' AS file_hash", "concat('u', id) AS id", "'method' AS kind", "'b' AS body_hash", "id AS seq")
    units.repartition(20).write.parquet(f"{tmp_path}/units.parquet")
    root = f"{tmp_path}/index"
    nothing = spark.createDataFrame([], "caller_id string, callee_id string, call_type string, file_path string, line int")
    old = spark.createDataFrame([("gone", "method", "a.go", "b", 0)], "id string, kind string, file_path string, body_hash string, seq long")
    versioned.save_tables(spark, root, {"symbols": old, "method_calls": nothing, "manifest": spark.createDataFrame([("a.go", "old")], "file_path string, file_hash string")}, "start")
    calls = lambda changed: changed.selectExpr("id AS caller_id", "'x' AS callee_id", "'direct' AS call_type", "'g' AS file_path", "1 AS line")
    S.incremental_index(S.table_stream(spark, str(tmp_path), "units"), root, calls, f"{tmp_path}/state")
    assert rows(versioned.load_tables(spark, root, ["symbols"])["symbols"], "id") == sorted((f"u{k}",) for k in range(40))


def test_a_save_leaves_no_shuffle_files(spark, tmp_path):
    """Shuffles of each save used to stay on disk until the driver collected its plan."""
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f for folder in folders for _, _, found in os.walk(folder) for f in found if f.startswith("shuffle_")}

    before, rows_ = shuffles(), spark.range(20000).selectExpr("id", "id % 97 AS k")
    joined = rows_.hint("merge").join(rows_.groupBy("k").count(), "k")
    versioned.save_buckets(spark, str(tmp_path), {"t": (joined, "id")}, buckets=4)
    versioned.save_tables(spark, f"{tmp_path}/whole", {"t": joined})
    end = time.monotonic() + 10
    while shuffles() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not shuffles() - before and versioned.load_buckets(spark, str(tmp_path), ["t"])["t"].count() == 20000
