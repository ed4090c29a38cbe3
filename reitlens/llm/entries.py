"""The operators' registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reitlens.llm import (bwt_dedup, decontaminate, fill_middle, filter_audit, line_dedup, mixing, pivot_index, quality_lm, recompression, simhash_trie, token_prefix,
                          url_rules, wrapper_html)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query("op1_quality_perplexity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_lm.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select("doc_id", *quality_lm.FIGURES, "base_failed", "kept", "log_perplexity", "low", "high")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = simhash_trie.classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cls.select("doc_id", simhash_trie.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op3_line_dedup", """
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
), t AS (
  SELECT doc_id, line_no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l
), e AS (
  SELECT w, min((doc_id, line_no)) AS first FROM t WHERE len(w) > 0 GROUP BY w
), v AS (
  SELECT w, first, len(w) AS n, i, CASE WHEN i < 0 THEN w ELSE w[1:i] || w[i + 2:] END AS key
  FROM (SELECT w, first, unnest(range(-1, len(w))) AS i FROM e WHERE len(w) >= 5)
), g AS (
  SELECT key, n, i, min(first) AS low FROM v WHERE i >= 0 GROUP BY ALL
), h AS (
  SELECT key, n, min(first) AS low FROM v WHERE i >= 0 GROUP BY ALL
), near AS (
  SELECT v.w FROM v JOIN g ON v.i >= 0 AND v.key = g.key AND v.n = g.n AND v.i = g.i WHERE g.low < v.first
  UNION SELECT v.w FROM v JOIN v AS f ON v.i >= 0 AND f.i < 0 AND f.key = v.key WHERE f.first < v.first
  UNION SELECT v.w FROM v JOIN h ON v.i < 0 AND v.key = h.key WHERE h.low < v.first
), r AS (
  SELECT t.doc_id, t.line_no, t.line, len(t.w) > 0 AS has, len(t.w) > 0 AND (e.first < (t.doc_id, t.line_no) OR near.w IS NOT NULL) AS gone
  FROM t LEFT JOIN e ON t.w = e.w LEFT JOIN near ON t.w = near.w
)
SELECT doc_id, count(*) FILTER (has) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.with_removed(table(spark, sf_dir, "documents", "doc_id", "text"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    with_word = F.size(F.filter(lines, line_dedup.has_word))
    kept = F.coalesce(line_dedup.kept_lines(F.col("text"), F.col("gone__")), F.lit(""))
    return marked.select("doc_id", with_word.cast("long").alias("n_lines"), F.coalesce(F.size("gone__"), F.lit(0)).cast("long").alias("n_removed"),
                         F.sha2(kept, 256).alias("kept_sha256"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = token_prefix.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    counts = token_prefix.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary, budgets=(2048,))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), F.col("cut_2048").alias("chars_within_limit"))


@query("op5_mix_sources", """
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2 * source_size AS cap, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt FROM s
), o AS (
  SELECT *, CAST(sum(cap) OVER a AS DOUBLE) - cap AS cap_before, CAST(sum(wt) OVER b AS DOUBLE) AS wt_from,
         row_number() OVER (ORDER BY cap::DOUBLE / wt, source NULLS LAST) AS rn,
         1.5 * CAST(sum(source_size) OVER () AS DOUBLE) AS wanted
  FROM w WINDOW a AS (ORDER BY cap::DOUBLE / wt, source NULLS LAST ROWS UNBOUNDED PRECEDING),
                b AS (ORDER BY cap::DOUBLE / wt, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT arg_min((wanted - cap_before) / wt_from, rn) AS share FROM o WHERE wt * ((wanted - cap_before) / wt_from) <= cap
), t AS (
  SELECT source, source_size, CASE WHEN share IS NULL OR wt * share > cap THEN CAST(cap AS DOUBLE) ELSE CAST(wt AS DOUBLE) * share END AS target
  FROM w, level
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t
), g AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, h
), c AS (
  SELECT g.source, h, words, CAST(sum(words) OVER (PARTITION BY g.source ORDER BY h) AS DOUBLE) AS upto, target - copies * source_size AS rest
  FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source
), x AS (
  SELECT source, min(h) AS h, arg_min(upto, h) AS upto, arg_min(words, h) AS words, any_value(rest) AS rest FROM c WHERE upto > rest GROUP BY source
), l AS (
  SELECT p.*, CASE WHEN x.h IS NULL THEN 1152921504606846975 WHEN x.upto - x.rest <= x.rest - (x.upto - x.words) THEN x.h ELSE x.h - 1 END AS last
  FROM p LEFT JOIN x ON p.source IS NOT DISTINCT FROM x.source
)
SELECT d.doc_id, d.size, l.source_size, l.target,
       CAST(d.size * (l.copies + CASE WHEN d.h <= l.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op6_substring_dedup", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), k AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
), v AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key FROM k
), f AS (
  SELECT key, min(doc_id) AS low FROM v GROUP BY key
), g AS (
  SELECT v.doc_id, v.i FROM v JOIN f USING (key) WHERE f.low < v.doc_id
), p AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g
), x AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), y AS (
  SELECT x.doc_id, count(*) AS n_words, count(p.i) AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (p.i IS NULL) AS kept
  FROM x LEFT JOIN p ON x.doc_id = p.doc_id AND x.i = p.i GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_decontaminate")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op10_url_filter", """
WITH r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                       ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), q AS (
  SELECT *, row_number() OVER () AS k FROM p
), m AS (
  SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM q JOIN r ON (q.host = r.host OR q.host LIKE '%.' || r.host) AND starts_with(q.path, r.path) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m USING (k)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(table(spark, sf_dir, "pages", "page_id", "url"), url_rules.rules_frame(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = bwt_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_html_wrapper")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = wrapper_html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op11_filter_audit", r"""
WITH t AS (
  SELECT coalesce(doc_id, 9223372036854775807) AS id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t
), f AS (
  SELECT text, min(id) AS first FROM t GROUP BY text
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(w.text) - length(regexp_replace(w.text, '[A-Z]', '', 'g'))) > 2 * length(w.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN f.first < w.id THEN 16 ELSE 0 END AS mask
  FROM w JOIN f ON w.text = f.text LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask
), s AS (
  SELECT part, u.subset, CAST(coalesce(sum(n) FILTER (mask & u.subset = 0), 0) AS BIGINT) AS n, CAST(coalesce(sum(good) FILTER (mask & u.subset = 0), 0) AS BIGINT) AS good,
         CAST(coalesce(sum(toxic) FILTER (mask & u.subset = 0), 0) AS BIGINT) AS toxic
  FROM c CROSS JOIN (SELECT unnest(range(32)) AS subset) u GROUP BY part, u.subset
), b AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT a1.x || a2.x || a3.x || a4.x || a5.x AS filter_order, [a1.bit, a2.bit, a3.bit, a4.bit, a5.bit] AS bits
  FROM b a1 JOIN b a2 ON a2.x <> a1.x JOIN b a3 ON a3.x NOT IN (a1.x, a2.x) JOIN b a4 ON a4.x NOT IN (a1.x, a2.x, a3.x) JOIN b a5 ON a5.x NOT IN (a1.x, a2.x, a3.x, a4.x)
), p AS (
  SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS BIGINT) AS before
  FROM o CROSS JOIN (SELECT unnest(range(1, 6)) AS k)
), g AS (
  SELECT part, filter_order, p.step, p.bit, s2.n AS kept, s1.n - s2.n AS removed, s0.n - sf.n AS fails, su.n - sa.n AS unique_fails,
         s1.good - s2.good AS good_lost, s1.toxic - s2.toxic AS toxic_lost
  FROM p JOIN s s1 ON s1.subset = p.before JOIN s s2 USING (part) JOIN s s0 USING (part) JOIN s sf USING (part) JOIN s su USING (part) JOIN s sa USING (part)
  WHERE s2.subset = p.before + p.bit AND s0.subset = 0 AND sf.subset = p.bit AND su.subset = 31 - p.bit AND sa.subset = 31
), h AS (
  SELECT part, bit, CAST(sum(removed) AS BIGINT) AS shapley FROM g GROUP BY part, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, fails - removed AS redundant, unique_fails, good_lost, toxic_lost, shapley FROM g JOIN h USING (part, bit)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op12_pivot_near_dedup", """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT k, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.k AS x, b.k AS y FROM u a JOIN u b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), r AS (
  SELECT k AS x, k AS y FROM v
  UNION
  SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
), c AS (
  SELECT r.x, min(v.vec_id) AS component_id FROM r JOIN v ON r.y = v.k GROUP BY r.x
), n AS (
  SELECT x, count(*) AS n_links FROM p GROUP BY x
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.k = c.x LEFT JOIN n ON v.k = n.x
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.classes(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@query("op13_fill_middle", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents
), r AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:least(c1, c2)], '') AS a, array_to_string(w[least(c1, c2) + 1:greatest(c1, c2)], '') AS b,
         array_to_string(w[greatest(c1, c2) + 1:], '') AS c
  FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
