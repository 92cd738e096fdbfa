"""Views that give the supplied tables the shape of a code graph.

The SQL is the same for Spark and DuckDB, except for the name of the SHA-256 function.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from codelattice.session import spread

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

NL = "chr(10)"


def _view_sql(sha) -> dict[str, str]:
    views = {}
    views["fx_symbols"] = """
        SELECT concat('p', cast(p_partkey AS string)) AS id,
          concat(replace(p_brand,'#',''), '.', replace(p_name,' ','_'), '(', cast(p_partkey % 40 AS string), ')') AS name,
          CASE WHEN p_partkey % 10 = 0 THEN 'class' WHEN p_partkey % 10 = 1 THEN 'constructor'
               WHEN p_partkey % 10 = 2 THEN 'field' ELSE 'method' END AS kind,
          concat('src/', lower(p_type), '/', replace(p_brand,'#',''), '.java') AS file_path,
          p_size AS line,
          CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE cast(p_size + p_partkey % 10 AS int) END AS end_line,
          concat('void ', p_name) AS signature, md5(p_name) AS body_hash, p_partkey AS seq
        FROM part"""
    views["fx_virtual_nodes"] = """
        SELECT concat('v', cast(s_suppkey AS string)) AS id,
          CASE WHEN s_suppkey % 4 = 0 THEN coalesce(y.name, 'none')
               WHEN s_suppkey % 4 = 1 THEN concat('Planned', cast(s_suppkey % 7 AS string))
               ELSE concat('Brand', cast(s_suppkey % 35 AS string), '.op', cast(s_suppkey AS string)) END AS label,
          CASE WHEN s_suppkey % 4 = 1 THEN 'class' ELSE 'method' END AS type,
          CASE WHEN s_suppkey % 4 = 2 THEN concat('v', cast(s_suppkey - 1 AS string)) END AS virtual_class_id,
          CASE WHEN s_suppkey % 4 = 1 THEN concat('plan/area', cast(s_suppkey % 3 AS string)) END AS virtual_directory,
          CASE WHEN s_acctbal > 3000 THEN 1 ELSE 0 END AS materialized, s_suppkey AS created_at
        FROM supplier x LEFT JOIN fx_symbols y ON y.id = concat('p', cast(x.s_suppkey AS string))"""
    views["fx_method_calls"] = """
        SELECT CASE WHEN l_suppkey % 5 = 0 THEN concat('v', cast(l_suppkey AS string))
                    ELSE concat('p', cast(l_suppkey AS string)) END AS caller_id,
          concat('p', cast(l_partkey + 20 AS string)) AS callee_id,
          CASE l_returnflag WHEN 'R' THEN 'manual' WHEN 'A' THEN 'static' ELSE 'direct' END AS call_type,
          CASE WHEN l_returnflag = 'R' THEN ''
               ELSE concat('src/f', cast(l_orderkey % 50 AS string), '.java') END AS file_path,
          l_linenumber AS line
        FROM lineitem"""
    views["fx_node_annotations"] = """
        SELECT concat('p', cast(c_custkey AS string)) AS node_id, c_mktsegment AS description,
          CASE WHEN c_custkey % 2 = 0 THEN '' ELSE concat('note ', cast(c_custkey AS string)) END AS ai_remarks,
          c_custkey AS updated_at
        FROM customer WHERE c_custkey % 3 = 0"""
    views["fx_edge_annotation_writes"] = """
        SELECT concat('p', cast(o_custkey % 100 AS string), '::p', cast(o_orderkey % 200 AS string)) AS edge_id,
          concat('p', cast(o_custkey % 100 AS string)) AS source_node_id,
          concat('p', cast(o_orderkey % 200 AS string)) AS target_node_id,
          o_orderpriority AS remarks, 1 AS call_count, o_orderkey AS seq
        FROM orders"""
    # One row per edge: the write with the largest seq.
    views["fx_edge_annotations"] = """
        SELECT edge_id, source_node_id, target_node_id, max_by(remarks, seq) AS remarks, 1 AS call_count,
          max(seq) AS updated_at
        FROM fx_edge_annotation_writes GROUP BY edge_id, source_node_id, target_node_id"""
    views["fx_locations"] = """
        SELECT DISTINCT s.file_path, cast(l_quantity AS int) AS line
        FROM lineitem l JOIN fx_symbols s ON s.id = concat('p', cast(l.l_partkey AS string))"""
    views["fx_units_old"] = """
        SELECT concat('d', cast(doc_id AS string)) AS id, source AS file_path,
          CASE WHEN doc_id % 9 = 0 THEN 'class' WHEN doc_id % 4 = 0 THEN 'function' ELSE 'method' END AS kind,
          md5(text) AS body_hash
        FROM documents WHERE doc_id % 7 <> 0"""
    views["fx_units_new"] = """
        SELECT concat('d', cast(doc_id AS string)) AS id, source AS file_path,
          CASE WHEN doc_id % 4 = 0 THEN 'function' ELSE 'method' END AS kind,
          md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, ' edit') ELSE text END) AS body_hash
        FROM documents WHERE doc_id % 11 <> 0"""
    # Saves in three batches: all files; some of them twice, first with units that are gone in the second; some emptied.
    views["fx_saves"] = """
        SELECT 1 AS batch, 1 AS save, source AS file_path, concat('d', cast(doc_id AS string)) AS id, CASE WHEN doc_id % 4 = 0 THEN 'function' ELSE 'method' END AS kind,
          md5(CASE WHEN doc_id % 5 = 0 THEN concat(text, ' edit') ELSE text END) AS body_hash FROM documents WHERE doc_id % 11 <> 0
        UNION ALL SELECT 2, 2, source, concat('t', cast(doc_id AS string)), 'method', md5(text) FROM documents WHERE doc_id % 5 = 0 AND right(md5(source), 1) > '4'
        UNION ALL SELECT 2, 3, source, concat('d', cast(doc_id AS string)), 'method', md5(concat(text, CASE WHEN doc_id % 7 = 0 THEN ' more' ELSE '' END))
          FROM documents WHERE doc_id % 3 <> 0 AND right(md5(source), 1) > '4'
        UNION ALL SELECT DISTINCT 3, 4, source, CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS string) FROM documents WHERE right(md5(source), 1) > 'a'"""
    # Saves of files with their symbols and call sites: some symbols changed, moved or gone, some files emptied.
    views["fx_code_saves"] = """
        SELECT 1 AS batch, 1 AS save, file_path, id, CASE WHEN seq % 5 = 0 THEN 'function' ELSE 'method' END AS kind, CASE WHEN seq % 3 = 0 THEN md5(name) ELSE body_hash END AS body_hash,
          line, end_line, seq FROM fx_symbols WHERE right(md5(file_path), 1) > '7' AND seq % 13 <> 0
        UNION ALL SELECT 2, 2, file_path, id, 'method', CASE WHEN seq % 4 = 0 THEN md5(id) ELSE body_hash END, line + 3, CASE WHEN end_line = 0 THEN 0 ELSE end_line + 3 END, seq
          FROM fx_symbols WHERE right(md5(file_path), 1) > 'b'
        UNION ALL SELECT DISTINCT 3, 3, file_path, CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS string), CAST(NULL AS int), CAST(NULL AS int), 3
          FROM fx_symbols WHERE right(md5(file_path), 1) > 'd'"""
    views["fx_code_sites"] = """
        SELECT DISTINCT concat('p', cast(l.l_partkey AS string)) AS caller_id, s.file_path AS callee_file, s.line + l.l_linenumber - 2 AS callee_line, l.l_linenumber AS line
        FROM lineitem l JOIN fx_symbols s ON s.seq = l.l_suppkey * 7"""
    # Saves, and in between the moments at which the file is taken off the queue.
    views["fx_queue_events"] = """
        SELECT event_id, ts, CASE WHEN event_id % 4 = 0 THEN 'taken' ELSE 'saved' END AS event, concat('src/u', cast(user_id AS string), '.go') AS file_path FROM events"""
    views["fx_session_steps"] = """
        SELECT concat('s', cast(conv_id AS string)) AS id, turn AS seq,
          CASE WHEN turn = 0 AND conv_id % 9 <> 0 THEN 'pending' WHEN (conv_id * 7 + turn * turn) % 5 < 3 THEN 'filled' WHEN (conv_id + turn) % 4 = 0 THEN 'pending' ELSE 'validated' END AS status
        FROM conversations"""
    views["fx_mask_sessions"] = """
        SELECT concat('s', cast(conv_id AS string), '-', cast(turn AS string)) AS id,
          concat('src/c', cast(conv_id % 20 AS string), '.py') AS file_path, text AS original_code,
          CASE WHEN turn % 3 = 0 THEN 'pending' WHEN turn % 3 = 1 THEN 'filled' ELSE 'validated' END AS status,
          turn AS created_at
        FROM conversations"""
    views["fx_save_events"] = """
        SELECT event_id, ts, concat('src/u', cast(user_id AS string), '.go') AS file_path, event_type FROM events"""

    # Further views of our own, same idea.
    views["fx_virtual_directories"] = """
        SELECT concat('vd', cast(c_custkey AS string)) AS id,
          concat('plan/zone', cast(c_nationkey AS string), '/d', cast(c_custkey AS string)) AS path,
          concat('d', cast(c_custkey AS string)) AS name,
          concat('plan/zone', cast(c_nationkey AS string)) AS parent_path, c_custkey AS created_at
        FROM customer WHERE c_custkey % 5 = 0"""
    # Endpoints written as an id, a label, a directory name or a directory hash.
    views["fx_mixed_calls"] = f"""
        SELECT CASE WHEN o.o_orderkey % 3 = 0 THEN coalesce(s.name, 'none') WHEN o.o_orderkey % 3 = 1
                    THEN concat('v', cast(o.o_orderkey % 120 AS string))
                    ELSE concat('p', cast(o.o_custkey AS string)) END AS caller_id,
          CASE WHEN o.o_custkey % 4 = 0 THEN concat('d', cast(o.o_custkey AS string))
               WHEN o.o_custkey % 4 = 1 THEN {sha("concat('plan/zone', cast(c.c_nationkey AS string), '/d', cast(c.c_custkey AS string))", 16)}
               WHEN o.o_custkey % 4 = 2 THEN coalesce(s.name, 'none')
               ELSE concat('p', cast(o.o_orderkey % 300 AS string)) END AS callee_id,
          CASE WHEN o.o_orderstatus = 'O' THEN 'manual' ELSE 'direct' END AS call_type,
          CASE WHEN o.o_orderstatus = 'O' THEN '' ELSE 'src/m.java' END AS file_path,
          cast(o.o_orderkey % 90 AS int) AS line
        FROM orders o LEFT JOIN fx_symbols s ON s.seq = o.o_custkey + 1
          LEFT JOIN customer c ON c.c_custkey = o.o_custkey"""
    views["fx_edge_requests"] = """
        SELECT o_orderkey AS request_id, caller_id AS source_id, callee_id AS target_id, remarks
        FROM (SELECT o_orderkey, concat('p', cast(o_custkey AS string)) AS caller_id,
                CASE WHEN o_orderkey % 3 = 0 THEN concat('v', cast(o_orderkey % 120 AS string))
                     ELSE concat('p', cast(o_orderkey % 2500 AS string)) END AS callee_id,
                CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS remarks
              FROM orders) r"""
    views["fx_call_sites"] = """
        SELECT concat('p', cast(l_suppkey AS string)) AS caller_id, s.file_path AS callee_file,
          cast(l_quantity AS int) AS callee_line, concat('src/f', cast(l_orderkey % 50 AS string), '.java') AS file_path,
          l_linenumber AS line
        FROM lineitem l JOIN fx_symbols s ON s.seq = l.l_partkey"""
    views["fx_paths"] = """
        SELECT page_id, concat('/ws/',
            CASE WHEN page_id % 7 = 0 THEN '.git/' WHEN page_id % 7 = 1 THEN 'node_modules/'
                 WHEN page_id % 7 = 2 THEN 'a/build/' ELSE '' END,
            replace(split_part(url, '/', 3), '.', '/'), '/', split_part(url, '/', 4), '/f', cast(page_id AS string),
            CASE WHEN page_id % 8 = 0 THEN '.java' WHEN page_id % 8 = 1 THEN '.PY' WHEN page_id % 8 = 2 THEN '.ts'
                 WHEN page_id % 8 = 3 THEN '.txt' WHEN page_id % 8 = 4 THEN '' WHEN page_id % 8 = 5 THEN '.d.mts'
                 WHEN page_id % 8 = 6 THEN '.jsx' ELSE '.go' END) AS path
        FROM pages"""
    views["fx_snapshots"] = """
        SELECT concat('sn', cast(c_custkey AS string)) AS id, c_name AS name,
          CASE WHEN c_custkey % 3 = 0 THEN concat('custom ', c_mktsegment) WHEN c_custkey % 3 = 1 THEN '' END AS custom_prompt,
          c_custkey AS created_at
        FROM customer"""
    views["fx_snapshot_nodes"] = f"""
        SELECT concat('sn', cast(cast(floor(o.o_orderkey / 24) AS bigint) AS string)) AS snapshot_id, o.o_orderkey AS seq,
          CASE WHEN o.o_orderkey % 6 = 0 THEN concat('sv', cast(o.o_orderkey AS string))
               WHEN o.o_orderkey % 6 = 3 THEN {sha("coalesce(s.file_path, 'src/gone.java')", 16)}
               WHEN o.o_orderkey % 6 = 4 THEN concat('legacy', cast(o.o_orderkey AS string))
               WHEN o.o_orderkey % 6 = 5 THEN concat('dir', cast(o.o_orderkey AS string))
               ELSE concat('p', cast(o.o_orderkey % 2400 AS string)) END AS id,
          concat('L', cast(o.o_orderkey % 1000 AS string)) AS label,
          CASE WHEN o.o_orderkey % 6 = 0 THEN CASE WHEN o.o_orderkey % 12 = 0 THEN 'class' ELSE 'method' END
               WHEN o.o_orderkey % 6 = 3 THEN 'file' WHEN o.o_orderkey % 6 = 4 THEN 'class'
               WHEN o.o_orderkey % 6 = 5 THEN 'directory' ELSE 'method' END AS type,
          CASE WHEN o.o_orderkey % 6 = 0 THEN ''
               WHEN o.o_orderkey % 6 = 5 THEN replace(coalesce(s.file_path, 'src/gone/x.java'), '/Brand11.java', '')
               ELSE coalesce(s.file_path, 'src/gone.java') END AS file_path,
          CASE WHEN o.o_orderkey % 6 IN (1, 2) THEN cast(1 + o.o_orderkey % 40 AS int) ELSE 0 END AS line,
          o.o_orderkey % 6 = 0 AS is_virtual,
          CASE WHEN o.o_orderkey % 24 IN (6, 12) THEN concat('sv', cast(o.o_orderkey - 6 AS string))
               WHEN o.o_orderkey % 24 = 18 OR o.o_orderkey % 120 = 0 THEN 'svgone' ELSE '' END AS parent_id,
          CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_orderpriority ELSE '' END AS description,
          CASE WHEN o.o_orderkey % 8 = 0 THEN 'seen' ELSE '' END AS ai_remarks
        FROM orders o LEFT JOIN fx_symbols s ON s.seq = o.o_orderkey % 2200"""
    # Edges between neighbouring nodes of a snapshot, some to nodes outside it.
    views["fx_snapshot_edges"] = """
        SELECT n.snapshot_id, n.seq, n.id AS source_id,
          CASE WHEN n.seq % 5 = 0 THEN concat('p', cast(n.seq % 2400 AS string))
               ELSE concat('p', cast((n.seq * 7) % 1900 AS string)) END AS target_id,
          CASE WHEN n.seq % 3 = 0 THEN concat('r', cast(n.seq % 50 AS string)) ELSE '' END AS remarks
        FROM fx_snapshot_nodes n"""
    views["fx_visible"] = """
        SELECT id FROM fx_symbols WHERE seq % 2 = 0
        UNION ALL SELECT id FROM fx_virtual_nodes WHERE created_at % 3 = 0"""
    views["fx_validation"] = """
        SELECT concat('s', cast(conv_id AS string)) AS session_id, turn AS seq,
          CASE WHEN turn % 2 = 0 THEN 'parse' ELSE 'semantic' END AS stage, length(text) % 7 <> 0 AS passed,
          concat('src/c', cast(conv_id % 20 AS string), '.py') AS file_path,
          CASE WHEN length(text) % 3 = 0 THEN 'error' WHEN length(text) % 3 = 1 THEN 'warning' ELSE '' END AS severity
        FROM conversations"""
    views["fx_marked_texts"] = """
        SELECT concat('src/c', cast(conv_id % 20 AS string), '.py') AS file_path, conv_id, turn,
          CASE WHEN turn % 3 = 2 THEN text
               WHEN turn % 3 = 1 THEN concat(text, chr(10), '# [MASK:session=s', cast(conv_id AS string), ' id=m', cast(turn AS string),
                 ' hint="add check"]')
               ELSE concat('/* [MASK:session=s', cast(conv_id AS string), ' id=m', cast(turn AS string),
                 ' hint="complete the condition"] */ ', text, ' /* [MASK:session=t', cast(conv_id AS string), ' id=n',
                 cast(turn AS string), ' hint=""] */') END AS text
        FROM conversations"""
    # One Java file per order: constructors that call others, and overloads with locals of one name.
    views["fx_chained_files"] = """
        SELECT concat('src/chain/O', cast(o_orderkey AS string), '.java') AS file_path, 'java' AS language, concat(
          'class O', cast(o_orderkey AS string), ' extends Base {', chr(10), '  private Field v;', chr(10),
          '  O', cast(o_orderkey AS string), '(int k) {', chr(10), '    super(k);', chr(10), '  }', chr(10),
          '  O', cast(o_orderkey AS string), '() {', chr(10), '    this(', cast(o_custkey AS string), ');', chr(10), '  }', chr(10),
          '  void run(int a) {', chr(10), '    Bar v = ', CASE WHEN o_custkey % 2 = 0 THEN 'make' ELSE 'build' END, '(a);', chr(10), '    v.go();', chr(10), '  }', chr(10),
          '  void run(String s) {', chr(10), '    Alt v = other(s);', chr(10), '    v.go();', chr(10), '  }', chr(10),
          '  void run() {', chr(10), '    ', CASE WHEN o_custkey % 2 = 0 THEN 'super.run();' ELSE 'v.go();' END, chr(10), '  }', chr(10), '}', chr(10)) AS text
        FROM orders"""
    # One Java, Python, Go or TypeScript file per order.
    views["fx_source_files"] = """
        SELECT o_orderkey AS seq,
          concat('src/c', cast(o_custkey % 200 AS string), '/Order', cast(o_orderkey AS string),
            CASE WHEN o_orderkey % 4 = 0 THEN '.java' WHEN o_orderkey % 4 = 1 THEN '.py'
                 WHEN o_orderkey % 4 = 2 THEN '.go' ELSE '.ts' END) AS file_path,
          CASE WHEN o_orderkey % 4 = 0 THEN 'java' WHEN o_orderkey % 4 = 1 THEN 'python'
               WHEN o_orderkey % 4 = 2 THEN 'go' ELSE 'typescript' END AS language,
          CASE WHEN o_orderkey % 4 = 0 THEN concat(
            'package shop;', chr(10), chr(10),
            'public class Order', cast(o_orderkey AS string), ' {', chr(10),
            '  private final CustomerRepo repo;', chr(10),
            '  // priority ', o_orderpriority, chr(10),
            '  public Order', cast(o_orderkey AS string), '(CustomerRepo repo) {', chr(10),
            '    this.repo = repo;', chr(10), '  }', chr(10), chr(10),
            '  public static boolean load(int id, Map<String, Integer> tags) {', chr(10),
            '    Cache cache = new Cache(id);', chr(10),
            '    if (id != null && cache.total(id) > ', cast(o_custkey AS string), ') {', chr(10),
            '      throw new IllegalStateException("', o_orderpriority, '");', chr(10), '    }', chr(10),
            '    cache.save(id); repo.save(id);', chr(10),
            '    tags.forEach(Printer::print);', chr(10), '    return check(id) || id > 0;', chr(10),
            '  }', chr(10),
            '  private int hits, misses = 0;', chr(10), '  static class Inner implements Store {', chr(10), '    protected final List<String> names = new ArrayList<>();', chr(10),
            '    public int size() { return names.size(); }', chr(10), '  }', chr(10), '  interface Store {', chr(10), '    int size() throws StoreError;', chr(10),
            CASE WHEN o_orderkey % 8 = 0 THEN concat('    default boolean isEmpty() {', chr(10), '      return size() == 0;', chr(10), '    }', chr(10)) ELSE '' END,
            '  }', chr(10), '  Runnable task() {', chr(10), '    return new Runnable() {', chr(10), '      public void run() {', chr(10),
            '        repo.touch(', cast(o_custkey AS string), ');', chr(10), '      }', chr(10), '    };', chr(10), '  }', chr(10), '}', chr(10))
          WHEN o_orderkey % 4 = 1 THEN concat(
            '# order ', cast(o_orderkey AS string), chr(10),
            'class Order', cast(o_orderkey AS string), ':', chr(10),
            '    def load(self, key: int, tags: Dict[str, int] = None):', chr(10),
            '        cache = Cache(key)', chr(10),
            '        if key is not None and cache.total(key) > ', cast(o_custkey AS string), ':', chr(10),
            '            raise ValueError("', o_orderpriority, '")', chr(10),
            '        return self.repo.save(key)', chr(10), chr(10),
            'def total(a, *rest):', chr(10), '    return sum(rest) + a', chr(10),
            'class Narrow(Base):', chr(10), '  class Row:', chr(10), '    pass', chr(10), chr(10), '  def one(self): return self.x[1:]', chr(10),
            '  async def two(self, k: int) -> Dict[str, int]:', chr(10), '    def inner(z):', chr(10), '      return z', chr(10), chr(10), '    return inner(k)', chr(10),
            'x = 1', chr(10))
          WHEN o_orderkey % 4 = 2 THEN concat(
            'package shop', chr(10), chr(10),
            'func (o *Order', cast(o_custkey % 50 AS string), ') Load(id int, tags map[string]int) error {', chr(10),
            '  total, err := repo.Total(id)', chr(10), '  if err != nil {', chr(10), '    return err', chr(10),
            '  }', chr(10), '  if total > ', cast(o_custkey AS string), ' || id == 0 {', chr(10),
            '    return repo.Save(id)', chr(10), '  }', chr(10), '  return nil', chr(10), '}', chr(10), chr(10),
            'func Total', cast(o_orderkey % 9 AS string), '(xs ...int) int {', chr(10), '  return len(xs)', chr(10),
            '}', chr(10), chr(10), 'type Pair struct {', chr(10), '  a, b int', chr(10), '}', chr(10), chr(10),
            'func (p Pair) Sum(f func(int) int) (int, error) { return f(p.a) + Max(p.b), nil }', chr(10), chr(10),
            'func run(v interface{}) {', chr(10), '  defer Pool.Put(v) // give(back)', chr(10), '  data := []byte("x(y)")', chr(10),
            '  go func() { store.db.Save(data); log(v) }()', chr(10), '}', chr(10))
          ELSE concat(
            'export class Order', cast(o_orderkey AS string), ' {', chr(10),
            '  async load(id: number, tags: Record<string, number> = {}): Promise<void> {', chr(10),
            '    if (id === null || tags.length > ', cast(o_custkey AS string), ') {', chr(10),
            '      throw new Error("', o_orderpriority, '");', chr(10), '    }', chr(10),
            '    await this.repo.save(id);', chr(10), '  }', chr(10), '}', chr(10), chr(10),
            'export function total(xs: number[]): number {', chr(10),
            '  return xs.length > 0 ? sum(xs) : 0;', chr(10), '}', chr(10), chr(10),
            'export const twice = async (x: number, y = 1) => {', chr(10), '  const inner = (z) => z * 2;', chr(10), '  return inner(x);', chr(10), '};', chr(10),
            'const short = x => x + 1;', chr(10), 'let old = function (a, b) { return a; };', chr(10),
            'const limit = total(', cast(o_custkey AS string), ');', chr(10)) END AS text
        FROM orders"""
    # The state on disk before: every third file is the same, others differ in one number.
    views["fx_source_files_old"] = """
        SELECT seq, file_path, language,
          CASE WHEN seq % 3 = 0 THEN text ELSE replace(text, ' > ', ' >  1') END AS text
        FROM fx_source_files WHERE seq % 10 <> 0"""
    views["fx_usage_log"] = """
        SELECT event_id, ts, event_type AS feature,
          CASE WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 5 = 1 THEN 'called' ELSE 'success' END AS status,
          user_id FROM events"""
    return views


def _spark_sha(expr: str, n: int) -> str:
    return f"substr(sha2({expr}, 256), 1, {n})"


def _duck_sha(expr: str, n: int) -> str:
    return f"substr(sha256({expr}), 1, {n})"


SPARK_VIEWS = _view_sql(_spark_sha)
DUCK_VIEWS = _view_sql(_duck_sha)


def _closure(names, views) -> list[str]:
    """Named views and all views they read, in the order they are defined."""
    need, todo = set(), [n for n in names]
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += [v for v in views if v != name and re.search(rf"\b{v}\b", views[name])]
    return [v for v in views if v in need]


def with_views(body: str, views: dict[str, str] = DUCK_VIEWS) -> str:
    """Prefix ``body`` with the definitions of the views it mentions."""
    used = _closure([v for v in views if re.search(rf"\b{v}\b", body)], views)
    if not used:
        return body
    defs = ",\n".join(f"{v} AS ({views[v]})" for v in used)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {defs},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {defs},\n{body[len('WITH'):]}"
    return f"WITH {defs}\n{body}"


class Tables:
    """The supplied tables of one folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._loaded: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._loaded:
            self._loaded[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._loaded[name].createOrReplaceTempView(name)
        return self._loaded[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name in SPARK_VIEWS:
            if name not in self._loaded:
                self._loaded[name] = self.sql(f"SELECT * FROM {name}")
            return self._loaded[name]
        raise AttributeError(name)

    def wide(self, name: str) -> DataFrame:
        """A table of texts, spread over the cores for per-row work; of a view, the tables it reads, which are smaller than its texts."""
        if name in BASE:
            return spread(self.base(name))
        return self.sql(f"SELECT * FROM {name}", wide=True)

    def sql(self, body: str, wide: bool = False) -> DataFrame:
        text = with_views(body, SPARK_VIEWS)
        for name in BASE:
            if re.search(rf"\b{name}\b", text):
                self.base(name)
                if wide:
                    spread(self.base(name)).createOrReplaceTempView(f"wide_{name}")
                    text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 wide_{name}", text)
        return self.spark.sql(text)
