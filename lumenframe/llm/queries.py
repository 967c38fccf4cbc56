"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import alignment, decontaminate, neardup, packing, phrases, pieces, pii, quality, spans, substrings, topk, toxicity, urls
from lumenframe.llm.common import table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents"), sentences=3, words=25)


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").filter(_remainder(3) != 1).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.fit(docs, learn))
    return scored.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    learn = table(spark, sf_dir, "labels").filter(_remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, learn))
    return scored.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


#: The rules of the url query: those under net/ and example.com/de/ block, the others allow.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(of(kind) for kind in pii.BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"), length=200)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    csv = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(csv, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, least=10, share=50, top=2000)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.coalesce(F.sha2("groups", 256), F.lit("")).alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_sentence_spans": op2_sentence_spans,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_top_k": op5_top_k,
    "op6_decontaminate": op6_decontaminate,
    "op7_url_filter": op7_url_filter,
    "op8_pii": op8_pii,
    "op9_minhash": op9_minhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_phrases": op12_phrases,
    "op13_alignment": op13_alignment,
    "pipeline": corpus_pipeline.run,
}

_DUCK_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_sentence_spans": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, CASE WHEN regexp_matches(text, '[^\t\n\f\r ]') THEN regexp_extract_all(text, '{spans.SENTENCE}') ELSE [] END AS p FROM documents),
        w AS (SELECT doc_id, text, p, list_transform(p, lambda x: regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\t\n\f\r ]+')) AS s FROM d),
        starts AS (SELECT doc_id, s, len(s) AS n, unnest(range(1, len(s) + 1)) AS i, CAST(coalesce(list_sum(list_transform(s, lambda x: len(x))), 0) AS BIGINT) AS total FROM w),
        runs AS (
            SELECT doc_id, i, k, s[i : i + k - 1] AS run FROM starts, (VALUES (1), (2), (3)) AS t(k)
            WHERE i + k - 1 <= n AND (k = 3 OR len(s[i]) + CASE WHEN k = 2 THEN len(s[i + 1]) ELSE 0 END >= 25)
            UNION ALL SELECT doc_id, 1, n, s FROM starts WHERE i = 1 AND n < 3 AND total < 25),
        placed AS (SELECT doc_id, i, k, first_value(doc_id) OVER x AS source, first_value(i) OVER x AS place FROM runs WINDOW x AS (PARTITION BY run ORDER BY doc_id, i)),
        again AS (SELECT * FROM placed WHERE doc_id <> source OR i <> place),
        gone AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM again) GROUP BY doc_id),
        firsts AS (SELECT doc_id, min(source) AS first_doc_id FROM again GROUP BY doc_id)
        SELECT doc_id, CAST(len(p) AS BIGINT) AS n_sentences, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, first_doc_id,
               CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda j: NOT list_contains(gone, j)), lambda j: p[j]), '') END AS text
        FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN firsts USING (doc_id)
    """,
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.a) + 1), lambda i: q.a[i] * c.a[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_decontaminate": rf"""
        WITH d AS (SELECT doc_id, coalesce({_DUCK_WORDS}, []) AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_DUCK_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, w[s + 1 : s + n] AS gram FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM sized)),
        grams AS (SELECT doc_id, n, s, w[s + 1 : s + n] AS gram FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
        found AS (SELECT doc_id, item_id, s, n FROM grams JOIN windows USING (n, gram)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op7_url_filter": r"""
        WITH p AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r AS (SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
                                    ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) AS t(rule_host, rule_path, rule, verdict)),
        fits AS (SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
                 FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT p.page_id, host, path, fits.rule, coalesce(fits.verdict, 'allow') AS verdict FROM p LEFT JOIN fits ON p.page_id = fits.page_id AND k = 1
    """,
    "op9_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.c, d.doc_id)) AS component_id, least(d.doc_id, coalesce(c.c, d.doc_id)) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op10_suffix_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        strings AS (SELECT doc_id, s, md5(b[s + 1 : s + 200]) AS h FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 199)) AS s FROM d WHERE octet_length(b) >= 200)),
        again AS (SELECT doc_id, s FROM strings JOIN (SELECT h FROM strings GROUP BY h HAVING count(*) > 1) USING (h)),
        fresh AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS first FROM again),
        numbered AS (SELECT doc_id, s, sum(first) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM fresh),
        gone AS (SELECT doc_id, k, min(s) AS a, max(s) + 200 AS z FROM numbered GROUP BY doc_id, k),
        cuts AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, CAST(sum(z - a) AS BIGINT) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
               CASE WHEN a IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda i:
                   hex(b[(CASE WHEN i = 1 THEN 0 ELSE z[i - 1] END) + 1 : CASE WHEN i > len(a) THEN octet_length(b) ELSE a[i] END])), ''))) END AS kept_sha256
        FROM d LEFT JOIN cuts USING (doc_id)
    """,
    "op12_phrases": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
        f AS (
            SELECT lang, k, w[i : i + k - 1] AS run, count(*) AS f FROM starts, (VALUES (1), (2), (3)) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, run, f AS a FROM f WHERE k > 1 AND f >= 10),
        cuts AS (
            SELECT c.lang, c.run, c.a, cut, x.f AS l, y.f AS r, CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.run = c.run[1 : cut] JOIN f y ON y.lang = c.lang AND y.run = c.run[cut + 1 : c.k]),
        worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, run ORDER BY score, cut) AS o FROM cuts) WHERE o = 1),
        inside AS (SELECT lang, run, max(a) AS held FROM (SELECT lang, a, unnest([run[1:2], run[2:3]]) AS run FROM c WHERE k = 3) GROUP BY lang, run),
        kept AS (SELECT worst.* FROM worst LEFT JOIN inside USING (lang, run) WHERE held IS NULL OR 100 * held < 50 * a),
        ranked AS (SELECT lang, array_to_string(run, ' ') AS phrase, a, l, r, score FROM kept),
        placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM ranked)
        SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN n USING (lang) WHERE rank <= 2000
    """,
}
