"""The operators of this subpackage as queries over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, decontaminate, delta_lloyd, divergence, html_extract, line_dedup, near_dup, sharding, simhash, token_store, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.boilerplate_report(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score_documents(docs, model)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_digest(spark, folder)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(spark, warc.write_archives(_table(spark, sf_dir, "pages")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, run_chars=4_000_000, remembered=400_000)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(_table(spark, sf_dir, "documents"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster_report(_table(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_token_store, op4_warc, op5_bpe, op6_html, op7_decontaminate, op8_ann, op9_near_dup, op10_sharding, op11_divergence, op12_delta_lloyd, op13_simhash)}

def _lloyd_sql(k: int, dims: int, rounds: int) -> str:
    """Plain Lloyd: every vector against every centroid in every round."""
    owner = "SELECT rid, k, d FROM (SELECT x.rid, c.k, CAST(sum((x.c - c.c) * (x.c - c.c)) AS BIGINT) AS d FROM x JOIN {c} c ON x.i = c.i GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1"
    mean = "SELECT a.k, x.i, (sum(x.c) - ((sum(x.c) % count(*)) + count(*)) % count(*)) // count(*) AS c FROM x JOIN {a} a ON x.rid = a.rid GROUP BY ALL"
    steps = [f"a{r} AS MATERIALIZED ({owner.format(c=f'c{r}')}), c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, CAST(coalesce(m.c, c.c) AS BIGINT) AS c FROM c{r} c LEFT JOIN ({mean.format(a=f'a{r}')}) m ON c.k = m.k AND c.i = m.i)" for r in range(rounds)]
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
                  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
        x AS MATERIALIZED (SELECT rid, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM kept),
        start AS MATERIALIZED (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k FROM kept QUALIFY k < {k}),
        c0 AS MATERIALIZED (SELECT s.k, x.i, x.c FROM start s JOIN x ON s.rid = x.rid), {", ".join(steps)},
        last AS MATERIALIZED ({owner.format(c=f"c{rounds}")}),
        named AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY k)
        SELECT p.vec_id, CAST(l.k AS INTEGER) AS cluster, l.d AS distance, CAST(sum(l.d) OVER (PARTITION BY l.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(l.d) OVER () AS BIGINT) AS inertia, n.s AS centroid_sha256 FROM last l JOIN kept p ON l.rid = p.rid JOIN named n ON l.k = n.k"""


ORACLES = {
    "op12_delta_lloyd": _lloyd_sql(delta_lloyd.K, delta_lloyd.DIMS, delta_lloyd.ROUNDS),
    "op1_line_dedup": """
        WITH cut AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents), ws AS (SELECT ' ' || chr(9) || chr(11) || chr(12) || chr(13) AS ws),
        texts AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
        seen AS (SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ws)), lambda x: x <> ''))) AS line FROM texts, ws),
        held AS (SELECT source, line, count(*) AS holding FROM seen GROUP BY ALL HAVING count(*) >= 2),
        total AS (SELECT source, count(*) AS pages FROM texts GROUP BY ALL),
        hot AS (SELECT h.source, list(h.line) AS hot FROM held h JOIN total t ON h.source IS NOT DISTINCT FROM t.source
                WHERE h.holding > CAST(0.1 AS DOUBLE) * t.pages GROUP BY h.source),
        kept AS (SELECT c.doc_id, c.text, c.ls, CASE WHEN h.hot IS NULL THEN c.ls
                   ELSE list_filter(c.ls, lambda x: trim(x, ws) = '' OR NOT list_contains(h.hot, trim(x, ws))) END AS ks
                 FROM cut c CROSS JOIN ws LEFT JOIN hot h ON c.source IS NOT DISTINCT FROM h.source)
        SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(ks) = len(ls) THEN text ELSE coalesce(array_to_string(ks, chr(10)), '') END AS text,
               CASE WHEN text IS NULL THEN 0 ELSE CAST(len(ls) AS BIGINT) END AS n_lines,
               CASE WHEN text IS NULL THEN 0 ELSE CAST(len(ls) - len(ks) AS BIGINT) END AS n_removed
        FROM kept""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
        SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST((CAST('0x' || substr(p.d, (i // 4) * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
               CASE WHEN p.page_id = f.first OR f.first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id = f.first OR f.first IS NULL THEN NULL ELSE f.first END AS refers_to
        FROM p JOIN f ON p.d = f.d""",
    "op7_decontaminate": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item, len, list_slice(w, b, b + len - 1) AS g FROM
                 (SELECT item, w, least(len(w), 10) AS len, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS b FROM iw WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT len FROM win),
        grams AS (SELECT doc_id, len, b, list_slice(w, b, b + len - 1) AS g FROM
                   (SELECT doc_id, w, len, unnest(range(1, len(w) - len + 2)) AS b FROM dw, lens WHERE len(w) >= len)),
        hit AS (SELECT g.doc_id, g.b, g.len, w.item FROM grams g JOIN win w ON g.len = w.len AND g.g = w.g),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + len)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
               coalesce(its.s, sha256('')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
        FROM dw d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op11_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
        used AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        whole AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
        each AS (SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)),
        sized AS (SELECT *, CAST(sum(c) OVER (PARTITION BY lang, source) AS BIGINT) AS n, CAST(sum(c) OVER (PARTITION BY lang, term) AS BIGINT) AS t FROM each),
        shares AS (SELECT s.lang, source, term, c, 1 + 1000000000 * (c + 2) // (n + 2 * v) AS p,
                     1 + 1000000000 * (t + 2) // (CAST(sum(c) OVER (PARTITION BY s.lang) AS BIGINT) + 2 * v) AS q FROM sized s JOIN whole w ON s.lang = w.lang),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
                  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        none AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, 0 AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source ANTI JOIN whole w ON a.lang = w.lang),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE c > 0 AND p > q),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM none UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
}
