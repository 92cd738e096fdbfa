"""Registered queries of this folder, with production parameters over whole tables, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import (
    bwt_dedup, chosen_path, content, decontaminate, fagin, langid, lattice, merkle, packing, simhash, sliced, trie_counts, urlmodel)
from codelattice.llm.common import crc_mod, table

PACK_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary(PACK_VOCABULARY))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lattice.score_documents(docs, crc_mod("doc_id", 5) != 1, vocabulary(PIECE_VOCABULARY))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fagin.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.jaccard_join(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlmodel.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliced.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_pack, op3_language, op4_lattice_score, op5_main_text, op6_top_k, op7_token_counts, op8_repeats, op9_near_duplicates, op10_url_filter,
        op11_manifest, op12_simhash, op13_search)
}

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_LEAF = "sha256(" + " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

ORACLES = {
    "op1_decontaminate": f"""
    WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    bw AS (SELECT DISTINCT item, least(len(w), 13) AS size, list_slice(w, k, k + least(len(w), 13) - 1) AS win
           FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM b WHERE len(w) > 0) t),
    sizes AS (SELECT DISTINCT size FROM bw),
    dw AS (SELECT doc_id, k, size, list_slice(w, k, k + size - 1) AS win
           FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size) t),
    hits AS (SELECT DISTINCT doc_id, k, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hits) t GROUP BY doc_id),
    found AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id""",
    "op6_top_k": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 10""",
    "op11_manifest": f"""
    WITH RECURSIVE d AS (
        SELECT *, {_LEAF.format(text='text')} AS leaf,
               list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x:
                   list_reduce(list_prepend(xor(c, x), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
        FROM documents),
    p AS (
        SELECT doc_id, lang, leaf, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE leaf END AS arrived,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
        FROM d),
    t AS (
        SELECT g, 0 AS lvl, CAST(pos AS BIGINT) AS pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
        UNION ALL
        SELECT g, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY g, lvl, n, pos // 8),
    sub AS (SELECT g, h AS subroot, lvl AS height FROM t WHERE n = 1),
    u AS (
        SELECT 0 AS lvl, CAST(g AS BIGINT) AS pos, subroot AS h, count(*) OVER () AS n FROM sub
        UNION ALL
        SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY lvl, n, pos // 8),
    top AS (SELECT h AS root FROM u WHERE n = 1),
    nodes AS (
        SELECT g, lvl, pos, h FROM t WHERE n > 1
        UNION ALL SELECT sub.g, sub.height + u.lvl, u.pos, u.h FROM u, sub WHERE u.n > 1),
    up AS (
        SELECT p.g, p.pos AS leaf_pos, sub.height, x.lvl, CASE WHEN x.lvl < sub.height THEN p.pos // CAST(8 ** x.lvl AS BIGINT) ELSE p.g // CAST(8 ** (x.lvl - sub.height) AS BIGINT) END AS pos
        FROM p JOIN sub USING (g) JOIN (SELECT DISTINCT g, lvl FROM nodes) x USING (g)),
    seg AS (
        SELECT up.g, leaf_pos, up.lvl, coalesce(string_agg(h, '' ORDER BY nodes.pos) FILTER (nodes.pos < up.pos), '') AS l,
               coalesce(string_agg(h, '' ORDER BY nodes.pos) FILTER (nodes.pos > up.pos), '') AS r
        FROM up JOIN nodes ON nodes.g = up.g AND nodes.lvl = up.lvl AND nodes.pos // 8 = up.pos // 8 GROUP BY up.g, leaf_pos, up.lvl),
    proofs AS (SELECT g, leaf_pos, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof FROM seg GROUP BY g, leaf_pos),
    fold AS (
        SELECT g, pos, 0 AS lvl, arrived AS h FROM p
        UNION ALL SELECT fold.g, fold.pos, fold.lvl + 1, sha256(l || h || r) FROM fold JOIN seg ON seg.g = fold.g AND seg.leaf_pos = fold.pos AND seg.lvl = fold.lvl),
    folded AS (SELECT g, pos, max_by(h, lvl) AS h FROM fold GROUP BY g, pos)
    SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = root AS verified
    FROM p JOIN sub USING (g) JOIN folded ON folded.g = p.g AND folded.pos = p.pos LEFT JOIN proofs ON proofs.g = p.g AND proofs.leaf_pos = p.pos, top""",
    "op13_search": f"""
    WITH d AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
    lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
    size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lens),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) t),
    df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, size),
    s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
          FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lens USING (doc_id), size GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) t WHERE rank <= 10""",
}
