"""The registered queries: each applies one operator or function to the tables, with its equivalent in SQL where that can be told."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import mathfn, text, vectors
from lumenframe.models import cbow, histogram, nce, registry, textcnn
from lumenframe.operators import batching, lookups, metrics, sampling, trees
from lumenframe.operators.staging import shared_dir, staged
from lumenframe.sources import formats, sinks, sorted_set, tfrecord
from lumenframe.streaming import scoring, seen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass
class Tables:
    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self) -> str:
        """A new folder that executors share."""
        return f"{shared_dir(self.spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name or f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return keep


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def k_of(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("double")


def emb(name: str = "embedding") -> Column:
    return F.col(name).cast("array<double>")


DUCK_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
DUCK_EMB = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
#: Five weights for the first five components of an embedding.
W5 = (0.5, -1.25, 2.0, 0.75, -0.5)
DUCK_LOGIT = "(0.01 * value - 0.02 * date_part('hour', ts) + 0.005 * " + DUCK_K + ")"


def logit() -> Column:
    return 0.01 * F.col("value") - 0.02 * F.hour("ts") + 0.005 * k_of()


# ---------------------------------------------------------------- flagship


def flagship_frame(t: Tables) -> DataFrame:
    """Purchases scored by fixed weights on standardised features, and the score's rank AUC."""
    given = t.events.select((F.col("event_type") == "purchase").cast("int").alias("label"), F.col("value").alias("a"), F.hour("ts").cast("double").alias("b"), k_of().alias("c"))
    stats = given.agg(*(f(x).alias(f"{n}{x}") for x in "abc" for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = given.crossJoin(F.broadcast(stats))  # one row
    parts = [(F.col(x) - F.col(f"m{x}")) / F.col(f"s{x}") for x in "abc"]
    return z.select("label", F.round(mathfn.sigmoid(parts[0] * 0.8 - parts[1] * 0.3 + parts[2] * 0.5 - 1), 6).alias("score"))


@query("""
    WITH g AS (SELECT event_type = 'purchase' AS y, value AS a, CAST(date_part('hour', ts) AS DOUBLE) AS b, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS c FROM events),
    s AS (SELECT avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, avg(c) mc, stddev_pop(c) sc FROM g),
    z AS (SELECT y, round(1 / (1 + exp(-((a - ma) / sa * 0.8 - (b - mb) / sb * 0.3 + (c - mc) / sc * 0.5 - 1))), 6) AS score FROM g, s),
    k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM z)
    SELECT round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc FROM k
""")
def score_auc(t: Tables) -> DataFrame:
    return metrics.auc(flagship_frame(t), "label", "score").select(r(F.col("auc")).alias("auc"))


# ---------------------------------------------------------------- sources

def event_lines() -> Column:
    """Lines of four layouts, by event type."""
    head = F.when(F.col("event_type") == "purchase", "1").otherwise("0")
    k, u = k_of().cast("int").cast("string"), F.col("user_id").cast("string")
    dense = F.concat_ws("\t", head, k, F.concat(u, F.lit(".5")))
    sparse = F.concat_ws(" ", head, F.lit("1000"), F.concat(k, F.lit(":0.5")), F.concat(F.lit("7:"), u))
    return F.when(F.col("event_type") == "click", dense).when(F.col("event_type") == "view", sparse).when(F.col("event_type") == "error", F.concat(F.lit("#id\t"), dense)).otherwise(F.concat_ws(" ", head, F.lit("1000"), k, u))


DUCK_LINES = """SELECT event_id, event_type, CASE event_type
        WHEN 'click' THEN concat_ws(chr(9), h, k, u || '.5') WHEN 'view' THEN concat_ws(' ', h, '1000', k || ':0.5', '7:' || u)
        WHEN 'error' THEN '#id' || chr(9) || concat_ws(chr(9), h, k, u || '.5') ELSE concat_ws(' ', h, '1000', k, u) END AS line
    FROM (SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN '1' ELSE '0' END AS h,
                 CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS k, CAST(user_id AS VARCHAR) AS u FROM events)"""


@query(f"""
    SELECT event_id, CASE WHEN line[1] = '#' THEN 'dense' WHEN strpos(line, ':') > 1 THEN 'sparse' WHEN strpos(line, '.') > 0 THEN 'dense' ELSE 'index_only' END AS kind,
           starts_with(line, '#') AS has_header, CAST(CASE WHEN starts_with(line, '_') OR starts_with(line, '#id') THEN 1 ELSE 0 END AS INTEGER) AS label
    FROM ({DUCK_LINES})
""")
def sniff_format(t: Tables) -> DataFrame:
    return t.events.select("event_id", formats.sniff_column(event_lines()).alias("s")).select("event_id", "s.kind", "s.has_header", "s.label")


@query(f"""
    SELECT event_id, CAST(p[1] AS DOUBLE) AS label, CAST(p[2] AS DOUBLE) AS f0, CAST(p[3] AS DOUBLE) AS f1
    FROM (SELECT event_id, regexp_split_to_array(line, '\\s+') AS p FROM ({DUCK_LINES}) WHERE event_type = 'click')
""")
def parse_dense(t: Tables) -> DataFrame:
    rows = t.events.filter("event_type = 'click'").select("event_id", formats.parse_dense(event_lines()).alias("p"))
    return rows.select("event_id", "p.label", F.get("p.features", F.lit(0)).alias("f0"), F.get("p.features", F.lit(1)).alias("f1"))


@query(f"""
    SELECT event_id, CAST(p[1] AS DOUBLE) AS label, CAST(p[2] AS INTEGER) AS total_features, array_to_string(p[3:], ',') AS ids
    FROM (SELECT event_id, regexp_split_to_array(line, '\\s+') AS p FROM ({DUCK_LINES}) WHERE event_type IN ('purchase', 'signup'))
""")
def parse_index_only(t: Tables) -> DataFrame:
    rows = t.events.filter("event_type in ('purchase', 'signup')").select("event_id", formats.parse_index_only(event_lines()).alias("p"))
    return rows.select("event_id", "p.label", "p.total_features", F.array_join("p.ids", ",").alias("ids"))


@query(f"""
    SELECT event_id, CAST(p[1] AS DOUBLE) AS label, CAST(p[2] AS INTEGER) AS num_features, CAST(len(p) - 2 AS INTEGER) AS n,
           CAST(split_part(p[3], ':', 1) AS INTEGER) AS first_id, CAST(split_part(p[4], ':', 2) AS DOUBLE) AS last_weight
    FROM (SELECT event_id, regexp_split_to_array(line, '\\s+') AS p FROM ({DUCK_LINES}) WHERE event_type = 'view')
""")
def parse_sparse(t: Tables) -> DataFrame:
    rows = t.events.filter("event_type = 'view'").select("event_id", formats.parse_sparse(event_lines()).alias("p"))
    return rows.select("event_id", "p.label", "p.num_features", F.size("p.ids").alias("n"), F.get("p.ids", F.lit(0)).alias("first_id"), F.get("p.weights", F.lit(1)).alias("last_weight"))


@query(f"""
    SELECT event_id, CAST(p[1] AS DOUBLE) AS label, CAST(p[2] AS INTEGER) AS num_features, array_to_string(p[3:], '|') AS tokens
    FROM (SELECT event_id, regexp_split_to_array(line, '\\s+') AS p FROM ({DUCK_LINES}) WHERE event_type = 'view')
""")
def parse_raw(t: Tables) -> DataFrame:
    rows = t.events.filter("event_type = 'view'").select("event_id", formats.parse_raw(event_lines()).alias("p"))
    return rows.select("event_id", "p.label", "p.num_features", F.array_join("p.tokens", "|").alias("tokens"))


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority AS name, o_totalprice AS f0,
           (CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END) || ' 1:' || CAST(o_orderkey % 7 AS VARCHAR) || ' 5:2' AS line, CAST(2 AS INTEGER) AS n, CAST(0 AS INTEGER) AS first_id FROM orders
""")
def libsvm_and_roles(t: Tables) -> DataFrame:
    ids, weights = F.array(F.lit(0), F.lit(4)), F.array(F.col("o_orderkey") % 7, F.lit(2).cast("long"))
    lines = t.orders.select(F.concat_ws("|", "o_orderkey", "o_orderpriority").alias("name"), F.col("o_totalprice").alias("f0"), formats.libsvm_line((F.col("o_orderstatus") == "F").cast("int"), ids, weights).alias("line"))
    return lines.withColumn("p", formats.parse_libsvm(F.col("line"))).select("name", "f0", "line", F.size("p.ids").alias("n"), F.get("p.ids", F.lit(0)).alias("first_id"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def include_exclude(t: Tables) -> DataFrame:
    names = t.lineitem.columns
    return t.lineitem.select(*formats.select_features(names, "e:l_orderkey,e:l_linenumber,r:^l_(quan|disc|tax),i:5", "e:l_tax,s:extended"))


@query("SELECT l_orderkey, l_linenumber, translate(concat_ws(',', l_returnflag, l_linestatus), ',', chr(9)) AS line FROM lineitem")
def delimiter_rewrite(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", formats.comma_to_tab(F.concat_ws(",", "l_returnflag", "l_linestatus")).alias("line"))


@query("SELECT CAST(event_type = 'purchase' AS INTEGER) AS label, user_id AS f0, CAST(1 AS INTEGER) AS width FROM events")
def text_round_trip(t: Tables) -> DataFrame:
    path = t.scratch()
    label = F.col("event_type") == "purchase"
    t.events.select(formats.dense_line(label.cast("int"), F.array(F.concat(F.col("user_id").cast("string"), F.lit(".0")))).alias("value")).write.text(path)
    found = formats.read_instances(t.spark, path)
    return found.df.select(F.col("label").cast("int").alias("label"), F.get("features", F.lit(0)).cast("long").alias("f0"), F.lit(found.num_features).alias("width"))


@query("SELECT label AS label, vec_id AS index, round(embedding[1], 4) AS value FROM embeddings")
def record_round_trip(t: Tables) -> DataFrame:
    path = t.scratch()
    t.embeddings.select(F.col("label").cast("long").alias("label"), F.array("vec_id").alias("index"), F.array(F.get("embedding", F.lit(0))).alias("value")).write.parquet(path)
    rows = formats.read_records(t.spark, path)
    return rows.select(F.col("label").cast("int").alias("label"), F.get("index", F.lit(0)).alias("index"), F.round(F.get("value", F.lit(0)), 4).alias("value"))


@query("SELECT CAST(page_id AS VARCHAR) AS pid, translate(html, chr(10) || chr(13), '  ') AS content FROM pages")
def posts_round_trip(t: Tables) -> DataFrame:
    path = t.scratch()
    posts = t.pages.select(F.col("page_id").cast("string").alias("pid"), F.lit("t").alias("title"), F.col("html").alias("content"))
    sinks.append_posts(posts, path)
    return formats.read_posts(t.spark, path).select("pid", "content")


# ---------------------------------------------------------------- slices and batches

NUMBERED = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row FROM orders"


@query(f"SELECT o_orderkey, row, row // 64 AS batch_id FROM ({NUMBERED})")
def batch_ids(t: Tables) -> DataFrame:
    return batching.batch_ids(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 64).select("o_orderkey", "row", "batch_id")


@query(f"SELECT o_orderkey, row, row // 64 AS batch_id FROM ({NUMBERED}) WHERE row // 64 < (SELECT count(*) // 64 FROM orders)")
def batch_ids_drop_tail(t: Tables) -> DataFrame:
    return batching.batch_ids(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 64, "drop").select("o_orderkey", "row", "batch_id")


@query(f"SELECT o_orderkey, row, row // 50 AS batch_id FROM ({NUMBERED}) WHERE row // 50 < (SELECT (count(*) + 49) // 50 - 1 FROM orders)")
def batch_ids_zip(t: Tables) -> DataFrame:
    return batching.batch_ids(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 50, "zip").select("o_orderkey", "row", "batch_id")


@query(f"SELECT o_orderkey, row FROM ({NUMBERED}) WHERE row >= 100 AND row < (SELECT count(*) FROM orders) - 5")
def slice_range(t: Tables) -> DataFrame:
    return batching.slice_rows(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100, -5).select("o_orderkey", "row")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def limit_rows(t: Tables) -> DataFrame:
    return batching.limit_rows(t.orders, ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "o_totalprice")


def draw_sql(key: str, seed: int = 0) -> str:
    """batching.draw in SQL."""
    return f"(CAST(CAST('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / CAST({2**52} AS DOUBLE))"


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY {draw_sql('o_orderkey', 7)}, o_orderkey) - 1 AS row FROM orders")
def shuffle_rows(t: Tables) -> DataFrame:
    return batching.shuffled(t.orders.select("o_orderkey"), "o_orderkey", 7)


@query("SELECT event_id, value, CAST(event_type = 'purchase' AS INTEGER) AS label, 1 - value AS inverted FROM events WHERE value > 0.5")
def threshold_filter(t: Tables) -> DataFrame:
    return t.events.filter(F.col("value") > 0.5).select("event_id", "value", (F.col("event_type") == "purchase").cast("int").alias("label"), (1 - F.col("value")).alias("inverted"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber >= 3 AS INTEGER) AS label, l_discount > 0 AS positive FROM lineitem")
def positive_label(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") >= 3).cast("int").alias("label"), (F.col("l_discount") > 0).alias("positive"))


def sparse_of() -> tuple[Column, Column]:
    """Ids and weights of an event's two features."""
    return F.array(F.pmod(k_of(), F.lit(10)).cast("int"), F.pmod(F.col("user_id"), F.lit(10)).cast("int")), F.array(k_of(), F.lit(0.5))


DUCK_SPARSE = f"SELECT event_id, CAST({DUCK_K} AS BIGINT) % 10 AS a, user_id % 10 AS b, {DUCK_K} AS k FROM events"


@query(f"""
    SELECT event_id, array_to_string(list_transform(range(10), lambda i: CAST(CAST(CASE WHEN i = b THEN 0.5 WHEN i = a THEN k ELSE 0 END * 10 AS BIGINT) AS VARCHAR)), ',') AS dense FROM ({DUCK_SPARSE})
""")
def sparse_to_dense(t: Tables) -> DataFrame:
    dense = vectors.to_dense(sparse_of()[0], sparse_of()[1], 10)
    return t.events.select("event_id", F.array_join(F.transform(dense, lambda v: (v * 10).cast("long").cast("string")), ",").alias("dense"))


@query(f"""
    SELECT event_id, CAST(0 AS INTEGER) AS pos, CASE WHEN b > 6 THEN 0 ELSE a END AS id, CASE WHEN b > 6 THEN 0 ELSE k END AS weight FROM ({DUCK_SPARSE})
    UNION ALL SELECT event_id, 1, b, 0.5 FROM ({DUCK_SPARSE}) WHERE b <= 6
""")
def sparse_coo(t: Tables) -> DataFrame:
    none = F.pmod(F.col("user_id"), F.lit(10)) > 6
    rows = t.events.select("event_id", F.when(none, F.array().cast("array<int>")).otherwise(sparse_of()[0]).alias("ids"), F.when(none, F.array().cast("array<double>")).otherwise(sparse_of()[1]).alias("weights"))
    return vectors.coordinates(rows, "event_id", "ids", "weights")


# ---------------------------------------------------------------- joins


def lookup_ids() -> Column:
    """Two ids of an event, of which the table may lack some."""
    return F.array(k_of().cast("long"), (F.col("user_id") * 7).cast("long"))


DUCK_IDS = f"SELECT event_id, CAST({DUCK_K} AS BIGINT) AS a, user_id * 7 AS b, {DUCK_K} AS k FROM events"
DUCK_TABLE = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS value FROM embeddings"


@query(f"""
    SELECT event_id, round(coalesce(v.value * k, 0) + coalesce(w.value * 0.5, 0), 6) AS total FROM ({DUCK_IDS}) s
    LEFT JOIN ({DUCK_TABLE}) v ON s.a = v.id LEFT JOIN ({DUCK_TABLE}) w ON s.b = w.id
""")
def sparse_dot(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", lookup_ids().alias("ids"), sparse_of()[1].alias("weights"))
    table = t.embeddings.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return vectors.lookup_sum(rows, "event_id", "ids", table, "weights").select("event_id", r(F.col("total")).alias("total"))


@query(f"""
    SELECT event_id, round(avg(value), 6) AS total FROM (SELECT event_id, unnest([a, b]) AS id FROM ({DUCK_IDS})) LEFT JOIN ({DUCK_TABLE}) USING (id) GROUP BY event_id
""")
def embedding_lookup_mean(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", lookup_ids().alias("ids"))
    table = t.embeddings.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("value"))
    return vectors.lookup_sum(rows, "event_id", "ids", table, combiner="mean").select("event_id", r(F.col("total")).alias("total"))


@query("SELECT e.event_id, d.doc_id, d.lang, d.n_chars FROM events e JOIN documents d ON e.user_id = d.doc_id")
def enrich_posts(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("user_id").alias("doc_id"))
    return lookups.enrich(rows, t.documents.select("doc_id", "lang", "n_chars"), "doc_id")


@query("SELECT event_id, user_id, user_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_known FROM events")
def exists_flag(t: Tables) -> DataFrame:
    known = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return lookups.exists_flag(t.events.select("event_id", "user_id"), known, "user_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def not_seen(t: Tables) -> DataFrame:
    return lookups.not_seen(t.customer.select("c_custkey", "c_name"), t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) ON o_custkey = c_custkey AND k = 1
""")
def first_match(t: Tables) -> DataFrame:
    found = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    return lookups.first_match(t.customer.select("c_custkey"), found, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


COSINE_SQL = f"""
    WITH e AS (SELECT vec_id, {DUCK_EMB} AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id, list_cosine_similarity(q.v, d.v) AS c FROM e q JOIN e d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, neighbor_id) AS rank FROM s)
    SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(c, 6) AS similarity FROM k WHERE rank <= 8
"""


@query(COSINE_SQL)
def cosine_topk(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "embedding")
    return lookups.top_k_cosine(rows, "vec_id", "embedding", rows.filter("vec_id % 20 = 0"), 8).select("query_id", "neighbor_id", "rank", r(F.col("similarity")).alias("similarity"))


# ---------------------------------------------------------------- vectors

W5_SQL = "[" + ", ".join(f"CAST({w} AS DOUBLE)" for w in W5) + "]"


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 6), lambda i: CAST(embedding[i] AS DOUBLE) * {W5_SQL}[i])), 6) AS z FROM embeddings")
def dense_dot(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r(vectors.dot(vectors.section(emb(), 0, 5), F.array(*(F.lit(w) for w in W5)))).alias("z"))


@query("""
    SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 2 + CAST(embedding[2] AS DOUBLE) * 3, 6) AS a, round(CAST(embedding[1] AS DOUBLE) * -1 + CAST(embedding[2] AS DOUBLE) * 4, 6) AS b FROM embeddings
""")
def matrix_product(t: Tables) -> DataFrame:
    p = vectors.matrix_times(vectors.section(emb(), 0, 2), [[2, 3], [-1, 4]])
    return t.embeddings.select("vec_id", p.alias("p")).select("vec_id", r(F.get("p", F.lit(0))).alias("a"), r(F.get("p", F.lit(1))).alias("b"))


@query(f"""
    WITH e AS (SELECT vec_id, {DUCK_EMB} AS v FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(v[1:8], lambda x: greatest(x, 0.1))), 6) AS most, round(list_sum(list_transform(v[1:8], lambda x: x * x + x * 3)), 6) AS mixed,
           CAST(8 AS DOUBLE) AS ones, round(v[1], 6) AS kept, CAST(4 AS INTEGER) AS rows, round(v[4], 6) AS second FROM e
""")
def elementwise(t: Tables) -> DataFrame:
    a = vectors.section(emb(), 0, 8)
    low = F.array_repeat(F.lit(0.1), 8)
    return t.embeddings.select(
        "vec_id", r(vectors.total(vectors.maximum(a, low))).alias("most"), r(vectors.total(vectors.add(vectors.multiply(a, a), vectors.scale(a, 3)))).alias("mixed"),
        vectors.total(vectors.ones_like(a)).alias("ones"), r(vectors.total(vectors.zero_out(a))).alias("kept"), F.size(vectors.reshape(a, 2)).alias("rows"), r(F.get(F.get(vectors.reshape(a, 2), F.lit(1)), F.lit(1))).alias("second"),
    )


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def argmax(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", vectors.argmax(F.col("embedding")).alias("best"))


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform({DUCK_EMB}, lambda x: x * x))), 6) AS norm, CAST(1 AS DOUBLE) AS unit FROM embeddings")
def embedding_norm(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r(vectors.norm(emb())).alias("norm"), r(vectors.norm(vectors.normalised(emb()))).alias("unit"))


@query(f"SELECT vec_id, round(list_sum({DUCK_EMB}), 6) AS total, round(list_sum({DUCK_EMB}) / 64, 6) AS mean FROM embeddings")
def row_sums(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", r(vectors.total(emb())).alias("total"), r(vectors.mean(emb())).alias("mean"))


UNNESTED = "SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings"


@query(f"SELECT CAST(pos AS INTEGER) AS pos, round(sum(CAST(v AS DOUBLE)), 5) AS total FROM ({UNNESTED}) GROUP BY pos")
def axis_sums(t: Tables) -> DataFrame:
    return vectors.column_totals(t.embeddings, "embedding").select("pos", r(F.col("total"), 5).alias("total"))


@query(f"SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS total FROM ({UNNESTED}) GROUP BY label, pos")
def embedding_mean_by_label(t: Tables) -> DataFrame:
    return vectors.column_totals(t.embeddings, "embedding", ("label",), "mean").select("label", "pos", r(F.col("total")).alias("total"))


@query(f"SELECT CAST(pos AS INTEGER) AS pos, round(max(CAST(v AS DOUBLE)), 6) AS total FROM ({UNNESTED}) GROUP BY pos")
def allreduce_max(t: Tables) -> DataFrame:
    return vectors.column_totals(t.embeddings, "embedding", (), "max").select("pos", r(F.col("total")).alias("total"))


@query(f"SELECT CAST(pos AS INTEGER) AS pos, round(sum(m), 5) AS total FROM (SELECT label, pos, max(CAST(v AS DOUBLE)) AS m FROM ({UNNESTED}) GROUP BY label, pos) GROUP BY pos")
def allreduce_sum(t: Tables) -> DataFrame:
    ranks = vectors.column_totals(t.embeddings, "embedding", ("label",), "max")
    return ranks.groupBy("pos").agg(r(F.sum("total"), 5).alias("total"))


@query("SELECT event_id, ~user_id AS flipped FROM events")
def bitwise_not(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.bitwise_not("user_id").alias("flipped"))


@query("SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS minmax, round((p_retailprice - m) / s, 6) AS zscore FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi, avg(p_retailprice) m, stddev_pop(p_retailprice) s FROM part)")
def normalizer(t: Tables) -> DataFrame:
    p = F.col("p_retailprice")
    stats = t.part.agg(F.min(p).alias("lo"), F.max(p).alias("hi"), F.avg(p).alias("m"), F.stddev_pop(p).alias("s"))
    return t.part.crossJoin(F.broadcast(stats)).select("p_partkey", r((p - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("minmax"), r((p - F.col("m")) / F.col("s")).alias("zscore"))


# ---------------------------------------------------------------- probability functions

X = "((value - 50) / 25)"
P = "((CAST(event_id % 997 AS DOUBLE) + 0.5) / 998)"


def x_of() -> Column:
    return (F.col("value") - 50) / 25


def p_of() -> Column:
    return ((F.col("event_id") % 997).cast("double") + 0.5) / 998


@query(f"SELECT event_id, round({mathfn.erf_sql(X)}, 9) AS y FROM events")
def erf(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(mathfn.erf(x_of()), 9).alias("y"))


@query(f"SELECT event_id, round({mathfn.erfc_sql(X)}, 9) AS y FROM events")
def erfc(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(mathfn.erfc(x_of()), 9).alias("y"))


@query(f"SELECT c_custkey, round({mathfn.erfinv_sql('((CAST(c_custkey % 181 AS DOUBLE) - 90) / 100)')}, 7) AS y FROM customer")
def erfinv(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.round(mathfn.erfinv(((F.col("c_custkey") % 181).cast("double") - 90) / 100), 7).alias("y"))


@query(f"SELECT event_id, round({mathfn.probit_sql(P)}, 7) AS y FROM events")
def probit(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(mathfn.probit(p_of()), 7).alias("y"))


@query(f"SELECT event_id, round(1 / (1 + exp(-{X})), 7) AS sigmoid, round((exp(2 * {X}) - 1) / (exp(2 * {X}) + 1), 7) AS tanh, round(greatest({X}, 0), 7) AS relu FROM events")
def activations(t: Tables) -> DataFrame:
    return t.events.select("event_id", *(F.round(mathfn.activation(n, x_of()), 7).alias(n) for n in ("sigmoid", "tanh", "relu")))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings)
    SELECT vec_id, round(exp(z[1]) / list_sum(list_transform(z, lambda x: exp(x))), 7) AS p0, round(exp(z[10]) / list_sum(list_transform(z, lambda x: exp(x))), 7) AS p9 FROM e
""")
def softmax(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", vectors.section(emb(), 0, 10).alias("z")).select("vec_id", mathfn.softmax(F.col("z")).alias("p"))
    return rows.select("vec_id", F.round(F.get("p", F.lit(0)), 7).alias("p0"), F.round(F.get("p", F.lit(9)), 7).alias("p9"))


# ---------------------------------------------------------------- metrics

RANKED = "(sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y))"


@query(f"SELECT round({RANKED}, 6) AS auc FROM (SELECT event_type = 'purchase' AS y, rank() OVER (ORDER BY round(value)) + (count(*) OVER (PARTITION BY round(value)) - 1) / 2.0 AS rk FROM events)")
def auc(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("event_type") == "purchase").cast("int").alias("y"), F.round("value").alias("s"))
    return metrics.auc(rows, "y", "s").select(r(F.col("auc")).alias("auc"))


@query(f"""
    SELECT p_brand, round({RANKED}, 6) AS auc FROM (
        SELECT p_brand, p_size > 25 AS y, rank() OVER (PARTITION BY p_brand ORDER BY round(p_retailprice, -1)) + (count(*) OVER (PARTITION BY p_brand, round(p_retailprice, -1)) - 1) / 2.0 AS rk FROM part)
    GROUP BY p_brand HAVING count(*) FILTER (y) > 0 AND count(*) FILTER (NOT y) > 0
""")
def auc_by_group(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", (F.col("p_size") > 25).cast("int").alias("y"), F.round("p_retailprice", -1).alias("s"))
    return metrics.auc(rows, "y", "s", ("p_brand",)).filter(~F.isnan("auc")).select("p_brand", r(F.col("auc")).alias("auc"))


@query(f"""
    SELECT round(sum(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 4) AS loss_sum, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS loss_mean
    FROM (SELECT {DUCK_LOGIT} AS z, CAST(event_type = 'purchase' AS INTEGER) AS y FROM events)
""")
def logloss(t: Tables) -> DataFrame:
    rows = t.events.select(logit().alias("z"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return metrics.losses(rows, "y", "z").select(r(F.col("loss_sum"), 4).alias("loss_sum"), r(F.col("loss_mean")).alias("loss_mean"))


@query(f"""
    SELECT event_type, round(-sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 4) AS loss
    FROM (SELECT event_type, 1 / (1 + exp(-{DUCK_LOGIT})) AS p, CAST(event_id % 2 AS INTEGER) AS y FROM events) GROUP BY event_type
""")
def direct_logloss(t: Tables) -> DataFrame:
    loss = metrics.log_loss(mathfn.sigmoid(logit()), F.col("event_id") % 2)
    return t.events.groupBy("event_type").agg(r(F.sum(loss), 4).alias("loss"))


LOGITS_SQL = "SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings"


def logits(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", vectors.section(emb(), 0, 10).alias("z"))


@query(f"SELECT round(sum(l), 4) AS softmax_sum, round(avg(l), 6) AS nll FROM (SELECT ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[label + 1] AS l FROM ({LOGITS_SQL}))")
def nll_softmax(t: Tables) -> DataFrame:
    rows = logits(t)
    loss = metrics.softmax_loss(F.col("z"), F.col("label"))
    return rows.select(loss.alias("a"), metrics.nll(mathfn.softmax(F.col("z")), F.col("label")).alias("b")).agg(r(F.sum("a"), 4).alias("softmax_sum"), r(F.avg("b")).alias("nll"))


@query(f"SELECT round(avg(CASE WHEN z[label + 1] >= list_max(z) THEN 1.0 ELSE 0.0 END), 6) AS precision_at_1 FROM ({LOGITS_SQL})")
def precision_at_1(t: Tables) -> DataFrame:
    return metrics.precision_at_1(logits(t), "label", "z").select(r(F.col("precision_at_1")).alias("precision_at_1"))


@query(f"SELECT round(avg(CASE WHEN label <> list_position(z, list_max(z)) - 1 THEN 1.0 ELSE 0.0 END), 6) AS error FROM ({LOGITS_SQL})")
def zero_one(t: Tables) -> DataFrame:
    return metrics.zero_one(logits(t).withColumn("y", vectors.argmax(F.col("z"))), "label", "y").select(r(F.col("error")).alias("error"))


@query(f"""
    WITH n AS (SELECT *, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS b FROM ({LOGITS_SQL})),
    h AS (SELECT b, CASE WHEN z[label + 1] >= list_max(z) THEN 1.0 ELSE 0.0 END AS hit FROM n)
    SELECT (SELECT round(avg(m), 6) FROM (SELECT avg(hit) AS m FROM h GROUP BY b)) AS batch_mean, (SELECT round(avg(hit), 6) FROM h) AS row_mean
""")
def batch_mean_accuracy(t: Tables) -> DataFrame:
    rows = batching.batch_ids(logits(t), ["vec_id"], 64).withColumn("hit", metrics.in_top_1(F.col("z"), F.col("label")))
    return metrics.batch_mean_accuracy(rows, "batch_id", "hit").select(*(r(F.col(c)).alias(c) for c in ("batch_mean", "row_mean")))


@query("SELECT round(sum(abs(c_acctbal)), 2) AS l1, round(sum(c_acctbal * c_acctbal), 1) AS l2_squared FROM customer")
def penalties(t: Tables) -> DataFrame:
    return metrics.penalties(t.customer, "c_acctbal").select(r(F.col("l1"), 2).alias("l1"), r(F.col("l2_squared"), 1).alias("l2_squared"))


@query("SELECT CAST(max(label) + 1 AS INTEGER) AS num_classes, CAST(max(len(embedding)) AS INTEGER) AS longest FROM embeddings")
def dataset_shape(t: Tables) -> DataFrame:
    return metrics.num_classes(t.embeddings, "label").crossJoin(t.embeddings.agg(F.max(F.size("embedding")).alias("longest")))


@query("""
    SELECT event_id, user_id, CAST(sum(CAST(event_type = 'error' AS INTEGER)) OVER w AS BIGINT) AS hits, count(*) OVER w AS seen,
           round(sum(CAST(event_type = 'error' AS INTEGER)) OVER w / count(*) OVER w, 6) AS ratio FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
""")
def running_ratio(t: Tables) -> DataFrame:
    found = metrics.running_ratio(t.events, "event_id", F.col("event_type") == "error", ("user_id",))
    return found.select("event_id", "user_id", "hits", "seen", r(F.col("ratio")).alias("ratio"))


@query("SELECT event_id // 200 AS poll, count(*) FILTER (k = 1) AS num_new, count(*) FILTER (k > 1) AS num_old FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY 1")
def poll_counts(t: Tables) -> DataFrame:
    """A key is new in the poll of its first event alone: a grouped minimum, whatever a key's number of events."""
    poll = lambda c: F.floor(F.col(c) / 200).cast("long").alias("poll")
    new = t.events.groupBy("user_id").agg(F.min("event_id").alias("first")).groupBy(poll("first")).agg(F.count("*").alias("num_new"))
    every = t.events.groupBy(poll("event_id")).agg(F.count("*").alias("n"))
    n_new = F.coalesce("num_new", F.lit(0)).cast("long")
    return every.join(new, "poll", "left").select("poll", n_new.alias("num_new"), (F.col("n") - n_new).alias("num_old"))


@query("SELECT event_id // 2000 AS period, round(avg(value), 6) AS average FROM events GROUP BY 1")
def periodic_average(t: Tables) -> DataFrame:
    return metrics.periodic_average(t.events, "event_id", "value", 2000).select("period", r(F.col("average")).alias("average"))


@query("SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def instance_summary(t: Tables) -> DataFrame:
    q = "l_quantity"
    return t.lineitem.agg(F.count(q).alias("n"), r(F.avg(q)).alias("mean"), r(F.stddev_samp(q)).alias("sd"), F.min(q).alias("low"), F.max(q).alias("high"))


# ---------------------------------------------------------------- text

DUCK_TOKENS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')"
WORDS = f"SELECT doc_id, unnest({DUCK_TOKENS}) AS word FROM documents"
VOCAB = f"SELECT word, CAST(row_number() OVER (ORDER BY cnt DESC, word) AS INTEGER) AS id, cnt FROM (SELECT word, count(*) AS cnt FROM ({WORDS}) GROUP BY word) ORDER BY cnt DESC, word LIMIT 199"


@query(f"SELECT word, id, cnt FROM ({VOCAB}) UNION ALL SELECT 'UNK', 0, (SELECT count(*) FROM ({WORDS})) - (SELECT CAST(sum(cnt) AS BIGINT) FROM ({VOCAB}))")
def vocab_topk(t: Tables) -> DataFrame:
    return text.vocabulary(t.documents, "text", 200).select("word", "id", "cnt")


@query(f"SELECT doc_id, count(*) AS n, count(*) FILTER (id IS NULL) AS unk, CAST(sum(coalesce(id, 0) + 1000) AS BIGINT) AS total FROM ({WORDS}) LEFT JOIN ({VOCAB}) USING (word) GROUP BY doc_id")
def encode_unk(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", text.tokens(F.col("text")).alias("words"))
    ids = text.encode(docs, "doc_id", "words", text.vocabulary(t.documents, "text", 200), offset=1000)
    return ids.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("id") == 1000).alias("unk"), F.sum("id").alias("total"))


def small_cnn() -> textcnn.TextCnn:
    """Filters of widths 3, 5 and 7, two each, over words of four numbers; all weights are quarters or eighths, so that sums are exact."""

    def filters(w: int) -> np.ndarray:
        o, j, f = np.meshgrid(np.arange(w), np.arange(4), np.arange(2), indexing="ij")
        return ((o * 3 + j * 5 + f * 7 + w) % 5 - 2) / 4

    out = [(w + 2 * f) % 3 - 1.0 for w in (3, 5, 7) for f in (0, 1)]
    return textcnn.TextCnn([(filters(w), np.array([0.0, 0.125])) for w in (3, 5, 7)], np.array(out), 0.125)


def word_vectors(t: Tables) -> DataFrame:
    return t.spark.range(16).select("id", F.array(*((F.pmod(F.col("id") * 5 + j * 3, F.lit(7)) - 3) / 4 for j in range(4))).alias("vector"))


@query(f"""
    WITH d AS (SELECT doc_id, list_transform({DUCK_TOKENS}, lambda w: length(w)) AS ids FROM documents),
    p AS (SELECT doc_id, CASE WHEN len(ids) < 7 THEN list_resize(ids, 7, -1) ELSE ids END AS ids FROM d),
    h AS (SELECT doc_id, w, f, list_max(list_transform(range(len(ids) - w + 1), lambda i: greatest(0.0, f / 8.0 + list_sum(list_transform(range(w * 4), lambda q:
        CASE WHEN ids[i + q // 4 + 1] NOT BETWEEN 0 AND 15 THEN 0.0
             ELSE (((ids[i + q // 4 + 1] * 5 + (q % 4) * 3) % 7) - 3) / 4.0 * ((((q // 4) * 3 + (q % 4) * 5 + f * 7 + w) % 5) - 2) / 4.0 END))))) AS best
        FROM p, (VALUES (3), (5), (7)) AS a(w), (VALUES (0), (1)) AS b(f))
    SELECT doc_id, CAST(0.125 + sum(best * ((w + 2 * f) % 3 - 1)) AS DOUBLE) AS score FROM h GROUP BY doc_id
""")
def text_cnn(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.transform(text.tokens(F.col("text")), lambda w: F.length(w)).alias("ids"))
    return small_cnn().score(docs, "doc_id", "ids", word_vectors(t)).select("doc_id", "score")


@query("SELECT vec_id, list_max(list_transform(range(len(v) - 2), lambda i: greatest(0.0, 0.25 + v[i + 1] * 0.5 - v[i + 2] + v[i + 3] * 2.0))) AS best FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x * 64) / 64.0) AS v FROM embeddings)")
def convolution(t: Tables) -> DataFrame:
    whole = F.transform(emb(), lambda x: F.round(x * 64) / 64)  # sums of these are exact
    return t.embeddings.select("vec_id", textcnn.conv_max(whole, [0.5, -1.0, 2.0], 0.25).alias("best"))


@query(f"SELECT v.id, v.word, count(*) AS n FROM ({WORDS}) JOIN ({VOCAB}) v USING (word) GROUP BY v.id, v.word")
def decode_ids(t: Tables) -> DataFrame:
    vocab = text.vocabulary(t.documents, "text", 200)
    docs = t.documents.select("doc_id", text.tokens(F.col("text")).alias("words"))
    ids = text.encode(docs, "doc_id", "words", vocab).filter("id > 0").groupBy("id").agg(F.count("*").alias("n"))
    return ids.join(vocab.select("id", "word"), "id").select("id", "word", "n")


@query(f"""
    WITH d AS (SELECT {DUCK_TOKENS} AS w FROM documents), g AS (SELECT w[i + 1] || ' ' || w[i + 3] AS gram FROM (SELECT w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2))
    SELECT gram, count(*) AS n FROM g GROUP BY gram
""")
def ngram_counts(t: Tables) -> DataFrame:
    grams = t.documents.select(F.explode(text.ngrams(text.tokens(F.col("text")), 2, 1)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


CLEAN = "substr(trim(regexp_replace(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '\\s+', ' ', 'g')), 1, 100)"


@query(f"SELECT page_id, {CLEAN} AS cleaned FROM pages")
def clean_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.clean_text(F.col("html")).alias("cleaned"))


@query("""
    WITH p AS (SELECT page_id, regexp_split_to_array(trim(lower(substr(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1, 100))), '\\s+') AS w FROM pages),
    c AS (SELECT page_id, list_filter(w, lambda x: x <> '') AS w FROM p)
    SELECT page_id, array_to_string(list_concat(list_concat(list_concat(w, ['<cpad/>']), w), list_transform(range(102), lambda i: '<cepad/>'))[1:102], ' ') AS padded FROM c
""")
def pad_tokens(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(text.content_vector(F.col("html")), " ").alias("padded"))


TITLE = f"list_filter(regexp_split_to_array(lower(split_part(text, chr(10), 1)), '\\s+'), lambda w: w <> '')"


@query(f"""
    WITH sides AS (SELECT doc_id, 0 AS side, {TITLE} AS w FROM documents UNION ALL SELECT doc_id, 1, {DUCK_TOKENS} FROM documents),
    words AS (SELECT doc_id, side, unnest(range(len(w))) AS pos, unnest(w) AS word FROM sides),
    vocab AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT word FROM words))
    SELECT doc_id, pos, word, CAST(id + side * 1000000 AS INTEGER) AS id FROM words JOIN vocab USING (word)
""")
def title_content_ids(t: Tables) -> DataFrame:
    """Two id spaces in one vector: a title (the first line) and a content, whose ids are shifted."""
    sides = t.documents.select("doc_id", text.tokens(F.split("text", "\n", 2)[0]).alias("title"), text.tokens(F.col("text")).alias("content"))
    words = sides.select(F.explode(F.concat("title", "content")).alias("word")).distinct()
    vocab = batching.numbered(words, "word").select("word", (F.col("row") + 1).cast("int").alias("id"))
    a, b = text.encode(sides, "doc_id", "title", vocab), text.encode(sides, "doc_id", "content", vocab, offset=1_000_000)
    return a.unionByName(b).withColumn("pos", F.col("pos").cast("long"))


@query(f"""
    WITH p AS (SELECT doc_id, {TITLE} AS w FROM documents)
    SELECT doc_id, array_to_string(list_concat(list_concat(list_concat(w, ['<tpad/>']), w), list_transform(range(72), lambda i: '<tcpad/>'))[1:72], ' ') AS padded FROM p
""")
def title_vector(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(text.title_vector(F.split("text", "\n", 2)[0]), " ").alias("padded"))


@query("SELECT event_id, '[' || CAST(user_id AS VARCHAR) || ' ' || CAST(event_id AS VARCHAR) || ']' || event_type AS content, strftime(to_timestamp(1400000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created FROM events")
def format_content(t: Tables) -> DataFrame:
    return t.events.select("event_id", text.tagged_prefix([F.col("user_id"), F.col("event_id")], F.col("event_type")).alias("content"), text.time_of(F.lit(1400000000) + F.col("event_id")).alias("created"))


#: Letters of the Latin blocks that the character set lacks; they come back as question marks.
LOST = "".join(c for c in map(chr, range(0x80, 0x250)) if c.encode("gbk", "replace") == b"?")


@query(f"SELECT doc_id, translate(text, '{LOST}', '{'?' * len(LOST)}') AS back FROM documents")
def encoding_convert(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.decoded(text.encoded(F.col("text"))).alias("back"))


@query(f"""
    WITH d AS (SELECT doc_id, {DUCK_TOKENS} AS w FROM documents), e AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM d),
    o AS (SELECT doc_id, word, pos + off AS pos FROM e, (VALUES (-2), (-1), (1), (2)) AS t(off))
    SELECT o.word AS center, e.word AS context, count(*) AS n FROM o JOIN e USING (doc_id, pos) GROUP BY ALL
""")
def skipgram_pairs(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w"))
    return text.skipgram_counts(docs, "w", 2)


# ---------------------------------------------------------------- samples


@query(f"SELECT event_id, {draw_sql('event_id', 3)} < CAST(0.7 AS DOUBLE) AS in_bag FROM events")
def bag_oob(t: Tables) -> DataFrame:
    return sampling.bag(t.events.select("event_id"), "event_id", 0.7, 3)


@query(f"SELECT event_id, user_id, CAST(floor({draw_sql('user_id')} * 5) AS INTEGER) AS fold FROM events")
def group_folds(t: Tables) -> DataFrame:
    return sampling.folds(t.events.select("event_id", "user_id"), "user_id", 5)


BAG_STEPS = " + ".join(f"CAST(u >= CAST({step!r} AS DOUBLE) AS BIGINT)" for step in sampling.poisson_steps(0.7))


@query(f"""
    WITH m AS (SELECT event_id, unnest(range(5)) AS member FROM events), d AS (SELECT event_id, member, {draw_sql("CAST(member AS VARCHAR) || ':' || CAST(event_id AS VARCHAR)")} AS u FROM m)
    SELECT CAST(member AS INTEGER) AS member, event_id, n FROM (SELECT member, event_id, {BAG_STEPS} AS n FROM d) WHERE n > 0
""")
def ensemble_sample(t: Tables) -> DataFrame:
    """Five bags drawn with replacement, and how often each row is in each."""
    return sampling.bags(t.events.select("event_id"), "event_id", 0.7, 5, replace=True).groupBy("member", "event_id").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, p_size FROM part WHERE p_size > 0 ORDER BY -ln({draw_sql('p_partkey')} + power(CAST(2 AS DOUBLE), -53)) / p_size, p_partkey LIMIT 64")
def negative_sampling(t: Tables) -> DataFrame:
    return sampling.weighted_sample(t.part.select("p_partkey", "p_size"), "p_partkey", "p_size", 64, 1.0)


# ---------------------------------------------------------------- trees


@query("""
    WITH q AS (SELECT DISTINCT l_quantity AS v FROM lineitem), b AS (SELECT list(v ORDER BY v) AS bounds FROM q)
    SELECT CAST(len(list_filter(bounds, lambda x: x < l_quantity)) AS INTEGER) AS bin, count(*) AS n, l_quantity AS median FROM lineitem, b GROUP BY ALL
""")
def bin_medians(t: Tables) -> DataFrame:
    bounds = trees.bin_bounds(t.lineitem, "l_quantity", 1000)
    return trees.bin_medians(t.lineitem, "l_quantity", bounds).select("bin", "n", "median")


@query("SELECT DISTINCT l_discount AS bound FROM lineitem")
def bin_bounds(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(b,) for b in trees.bin_bounds(t.lineitem, "l_discount", 255)], "bound double")


@query("""
    WITH r AS (SELECT CAST(l_linenumber AS INTEGER) AS a, CAST(l_quantity AS INTEGER) AS b, l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS y FROM lineitem),
    s AS (SELECT 0 AS f, a AS bin, count(*) AS n, sum(y) AS s FROM r GROUP BY a UNION ALL SELECT 1, b, count(*), sum(y) FROM r GROUP BY b),
    c AS (SELECT f, bin, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s FROM s WINDOW w AS (PARTITION BY f ORDER BY bin)),
    g AS (SELECT f, bin, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM c WHERE n > nl)
    SELECT CASE f WHEN 0 THEN 'a' ELSE 'b' END AS feature, CAST(bin AS INTEGER) AS bin FROM g ORDER BY gain DESC, f, bin LIMIT 1
""")
def residual_round(t: Tables) -> DataFrame:
    mean = t.lineitem.agg(F.avg("l_extendedprice").alias("m"))
    rows = t.lineitem.crossJoin(F.broadcast(mean)).select(F.lit(0).alias("node"), F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b"), trees.residual(F.col("l_extendedprice"), F.col("m")).alias("residual"))
    return trees.best_splits(rows, ["a", "b"]).select("feature", "bin")


@query("SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice * 0.1 - 3000, -2000), 2000) AS step FROM lineitem")
def leaf_clamp(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", mathfn.clamp(F.col("l_extendedprice") * 0.1 - 3000, 2000.0).alias("step"))


@query("SELECT CAST(node AS INTEGER) AS node, count(*) AS docs FROM (SELECT l_linenumber - 1 AS leaf FROM lineitem) JOIN (SELECT * FROM (VALUES (0,0),(0,1),(0,2),(0,3),(0,4),(0,5),(0,6),(1,0),(1,1),(2,2),(2,3)) AS t(node, leaf)) USING (leaf) GROUP BY node")
def node_docs(t: Tables) -> DataFrame:
    pairs = [(0, k) for k in range(7)] + [(1, 0), (1, 1), (2, 2), (2, 3)]
    return trees.node_documents(t.lineitem.select((F.col("l_linenumber") - 1).alias("leaf")), t.spark.createDataFrame(pairs, "node int, leaf int"))


@query("""
    WITH n AS (SELECT CAST(least(l_linenumber, 3) AS INTEGER) AS leaf, count(*) AS n, avg(l_quantity) AS o FROM lineitem GROUP BY 1), m AS (SELECT sum(n * o) / sum(n) AS root FROM n),
    i AS (SELECT sum(n * o) / sum(n) AS inner_mean FROM n WHERE leaf > 1), j AS (SELECT 0.7 * inner_mean + 0.3 * root AS mid FROM i, m)
    SELECT leaf, round(0.7 * o + 0.3 * CASE leaf WHEN 1 THEN root ELSE mid END, 6) AS output FROM n, m, j
""")
def leaf_smooth(t: Tables) -> DataFrame:
    stats = {x["leaf"]: x for x in t.lineitem.groupBy(F.least("l_linenumber", F.lit(3)).alias("leaf")).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("o")).collect()}  # three leaves
    leaf = lambda k: trees.Node(stats[k]["n"], stats[k]["o"])
    inner = trees.Node(stats[2]["n"] + stats[3]["n"], 0.0, "l", 2, leaf(2), leaf(3))
    root = trees.Node(0, 0.0, "l", 1, leaf(1), inner)
    root.smoothed(0.3)
    rows = [(1, root.left.output), (2, inner.left.output), (3, inner.right.output)]
    return t.spark.createDataFrame(rows, "leaf int, output double").withColumn("output", r(F.col("output")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 24 THEN 1.75 WHEN l_linenumber <= 3 THEN -0.5 ELSE 4.25 END AS score FROM lineitem")
def leaf_delta(t: Tables) -> DataFrame:
    tree = trees.Node(0, 0.0, "l_quantity", 24, trees.Node(0, 1.5), trees.Node(0, 0.0, "l_linenumber", 3, trees.Node(0, -0.75), trees.Node(0, 4.0)))
    tree.shifted(0.25)
    return t.lineitem.select("l_orderkey", "l_linenumber", tree.column().alias("score"))


@query("""
    WITH g AS (SELECT o_orderkey, o_custkey, sqrt(o_totalprice) - 3 AS d, min(o_totalprice) OVER w AS a, max(o_totalprice) OVER w AS z FROM orders WINDOW w AS (PARTITION BY o_custkey))
    SELECT o_orderkey, round(d - avg(d) OVER (PARTITION BY o_custkey), 6) AS gradient FROM g WHERE a < z
""")
def ranking_gradient(t: Tables) -> DataFrame:
    told = trees.with_order(t.orders, "o_custkey", "o_totalprice")
    rows = told.select("o_orderkey", "o_custkey", trees.residual(F.sqrt("o_totalprice"), F.lit(3)).alias("residual"))
    return trees.pair_residual(rows, "o_custkey").select("o_orderkey", r(F.col("residual")).alias("gradient"))


# ---------------------------------------------------------------- sinks


@query("SELECT user_id, CAST(min(event_id) AS BIGINT) AS event_id FROM events GROUP BY user_id")
def insert_ignore(t: Tables) -> DataFrame:
    path = t.scratch()
    firsts = t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    for part in (firsts.filter("user_id % 2 = 0"), firsts, firsts):
        sinks.insert_ignore(part, path, ["user_id"])
    return t.spark.read.parquet(path)


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def delete_where(t: Tables) -> DataFrame:
    path = t.scratch()
    t.events.select("event_id", "event_type").write.parquet(f"{path}/a")
    sinks.delete_where(t.spark, f"{path}/a", F.col("event_type") == "error", f"{path}/b")
    return t.spark.read.parquet(f"{path}/b")


@query("SELECT CAST(value > 50 AS INTEGER) AS label, value AS score FROM events")
def label_scores(t: Tables) -> DataFrame:
    return sinks.label_scores(t.events.withColumn("y", F.col("value") - 50), "y", "value")


@query("SELECT event_id, user_id, event_type FROM events")
def json_round_trip(t: Tables) -> DataFrame:
    path = t.scratch()
    sinks.write_json(t.events.select("event_id", "user_id", "event_type"), path)
    return t.spark.read.schema("event_id long, user_id long, event_type string").json(path)


SCORED_SQL = "SELECT o_orderkey, '[' || CAST(o_custkey AS VARCHAR) || ' ' || CAST(o_orderkey % 9 AS VARCHAR) || ' ' || CAST(o_orderkey % 1000 AS VARCHAR) || ' 5]' || o_orderstatus AS content, strftime(to_timestamp(1400000000 + o_orderkey) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created FROM orders"


def scored_posts(t: Tables) -> DataFrame:
    created = F.lit(1400000000) + F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("score"), (F.col("o_orderkey") % 9).alias("num_posts"), created.alias("create_time"), (created + F.col("o_orderkey") % 1000).alias("now_time"), F.lit(5).alias("thre"), F.col("o_orderstatus").alias("content"))


@query(SCORED_SQL)
def scored_rows(t: Tables) -> DataFrame:
    return sinks.scored_rows(scored_posts(t)).select("o_orderkey", "content", "created")


@query("SELECT o_orderkey AS thread_id, o_orderkey * 10 AS post_id, CAST(o_totalprice AS DOUBLE) AS score, o_orderstatus AS title, CAST(0.5 AS DOUBLE) AS thre FROM orders")
def scored_posts_file(t: Tables) -> DataFrame:
    """Scored posts in fourteen columns of text, read back by their schema."""
    path, key = t.scratch(), F.col("o_orderkey")
    columns = [key, key * 10, F.lit(1), F.lit(2), F.lit("10.0.0.1"), F.lit(1400000000), F.col("o_totalprice"), F.col("o_orderstatus"), F.lit("text"), F.lit("forum"), F.lit("name"), F.lit(1400000100), F.lit(3), F.lit(0.5)]
    t.orders.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).write.option("sep", "\t").csv(path)
    return formats.read_scored_posts(t.spark, path).select("thread_id", "post_id", "score", "title", "thre")


@query("SELECT CAST(event_id AS VARCHAR) AS thread_id, CAST(event_id + 1 AS VARCHAR) AS post_id, CAST(user_id AS VARCHAR) AS uid, '7' AS forum_id FROM events WHERE event_type = 'error'")
def deletion_requests(t: Tables) -> DataFrame:
    """Requests are written only when they are enabled."""
    path = t.scratch()
    wanted = t.events.filter("event_type = 'error'").select(F.col("event_id").alias("thread_id"), (F.col("event_id") + 1).alias("post_id"), F.col("user_id").alias("uid"), F.lit(7).alias("forum_id"))
    for enabled in (False, True):
        sinks.deletion_requests(wanted, path, enabled)
    return t.spark.read.option("sep", "\t").csv(path, schema="thread_id string, post_id string, uid string, forum_id string")


@query("SELECT event_id AS name, value AS score, user_id AS extra FROM events")
def result_file(t: Tables) -> DataFrame:
    path = t.scratch()
    sinks.write_results(t.events, path, ["event_id"], ["value", "user_id"])
    return t.spark.read.option("sep", "\t").csv(path, schema="name long, score double, extra long")


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 100")
def first_of_sorted(t: Tables) -> DataFrame:
    return formats.first_of_sorted(t.events.select("event_id", "value"), "value", "event_id", 100)


@query("SELECT o_orderkey AS label, o_custkey AS f0 FROM orders")
def cached_parse(t: Tables) -> DataFrame:
    """A file parsed once: the second call reads what the first one kept."""
    path, kept = t.scratch(), t.scratch()
    t.orders.select(F.concat_ws("\t", "o_orderkey", "o_custkey").alias("value")).write.text(path)
    parse = lambda spark, source: spark.read.text(source).select(F.split("value", "\t").alias("p")).select(F.get("p", F.lit(0)).cast("long").alias("label"), F.get("p", F.lit(1)).cast("long").alias("f0"))
    for _ in range(2):
        found = formats.cached_parse(t.spark, path, kept, parse)
    return found


@query("""
    WITH c AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(translate(text, chr(10) || chr(13), '  '), '\\s+'), lambda w: w <> '') AS w FROM conversations),
    e AS (SELECT conv_id, turn, unnest(range(len(w))) AS k, unnest(w) AS word FROM c)
    SELECT row_number() OVER (ORDER BY conv_id, turn, k) - 1 AS pos, word FROM e
""")
def read_words(t: Tables) -> DataFrame:
    """A text file's words, numbered through; the file's order is that of turns."""
    path = t.scratch()
    t.conversations.orderBy("conv_id", "turn").select(text.one_line(F.col("text")).alias("value")).write.text(path)  # parts in order
    return formats.read_words(t.spark, path)


@query("SELECT label, vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, round(CAST(embedding[3] AS DOUBLE), 6) AS third, 'v' || vec_id AS name FROM embeddings")
def tfrecord_round_trip(t: Tables) -> DataFrame:
    tfrecord.register(t.spark)
    path, schema = t.scratch(), "label bigint, vec_id bigint, index array<bigint>, value array<float>, name string"
    index = F.transform("embedding", lambda x, i: i.cast("long"))
    given = t.embeddings.select(F.col("label").cast("long").alias("label"), "vec_id", index.alias("index"), F.col("embedding").alias("value"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"))
    given.repartition(4, "vec_id").write.format("tfrecord").mode("append").option("path", path).save()
    found = t.spark.read.format("tfrecord").schema(schema).option("path", path).load()
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x.cast("double"))
    third = F.element_at(F.map_from_arrays("index", "value"), F.lit(2).cast("long")).cast("double")
    return found.select(F.col("label").cast("int").alias("label"), "vec_id", F.size("index").cast("long").alias("n"), r(total, 4).alias("total"), r(third).alias("third"), "name")


POLLS = 3


@query(f"""
    WITH n AS (SELECT max(event_id) + 1 AS n FROM events),
    e AS (SELECT event_id, user_id, value, event_type, CAST(event_id * {POLLS} // n AS INTEGER) AS part FROM events, n WHERE value IS NOT NULL),
    polls AS (SELECT unnest(range({POLLS})) AS p),
    last AS (SELECT p, user_id, arg_max(value, event_id) AS score, arg_max(event_type, event_id) AS kind FROM polls JOIN e ON part <= p GROUP BY ALL),
    ranked AS (SELECT p, CAST(user_id AS VARCHAR) AS member, score, row_number() OVER (PARTITION BY p ORDER BY score, CAST(user_id AS VARCHAR)) AS rank FROM last WHERE kind <> 'error')
    SELECT 'changes-' || p AS poll, CAST(rank AS INTEGER) AS rank, member, score FROM ranked WHERE rank <= 40
""")
def polled_set(t: Tables) -> DataFrame:
    """Users by their last value, taken out by an error: polled as changes come, each time by a stream started again."""
    sorted_set.register(t.spark)
    folder, out, state = t.scratch(), t.scratch(), t.scratch()
    n = t.events.agg(F.max("event_id") + 1).first()[0]
    what = F.when(F.col("event_type") == "error", "remove").otherwise("add")
    part = F.floor(F.col("event_id") * POLLS / n).cast("int")
    changes = t.events.filter("value is not null").select("event_id", what.alias("what"), F.col("value").alias("score"), F.col("user_id").alias("member"), part.alias("part"), F.concat(F.lit("changes-"), part.cast("string")).alias("file"))
    for k in range(POLLS):
        sorted_set.append_changes(changes.filter(F.col("part") == k), folder, "file", "event_id")
        source = t.spark.readStream.format("sorted_set").option("path", folder).option("size", 40).load()
        keep = lambda batch, _: insert_polls(sorted_set.rows(batch, 40), out)
        source.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).select("poll", "rank", "member", "score")


def insert_polls(polls: DataFrame, path: str) -> None:
    """Adds polls to a table, once each."""
    sinks.insert_ignore(polls, path, ["poll", "rank"])


@query()
def seen_capacity(t: Tables) -> DataFrame:
    """Users of a stream of events, let through once until the set of the seen is full."""
    name, path = f"seen_{uuid.uuid4().hex}", t.scratch()
    kept = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seen.with_store(t.spark)
    passed = seen.unseen(_stream(t, "events").select("event_id", "user_id"), "user_id", "event_id", 80, 4)
    passed.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).queryName(name).start().awaitTermination()
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return t.spark.read.schema("event_id long, user_id long").parquet(f"{path}/out")


@query(f"""
    WITH s AS (SELECT 1 / (1 + exp(-{DUCK_LOGIT})) AS p, CAST(event_type = 'purchase' AS INTEGER) AS y FROM events)
    SELECT CAST(least(greatest(floor(round(p, 9) * 64), 0), 63) AS INTEGER) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM s WHERE p IS NOT NULL GROUP BY 1
""")
def calibration_bins(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.round(mathfn.sigmoid(logit()), 9).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))
    return histogram.merged(*(histogram.histogram(rows.filter(F.col("event_id") % 3 == k), "p", "y", bins=64) for k in range(3)))


@query()
def train_online(t: Tables) -> DataFrame:
    """Scores calibrated by a histogram that took them in day by day."""
    rows = quality_rows(t)
    scored = registry.train("logistic", rows.filter(batching.draw("row", 1) < 0.35), rounds=50).score(rows).persist()
    online = histogram.Online(bins=64)
    for day in range(3):
        online.add(scored.filter((batching.draw("row", 1) >= 0.35) & (batching.draw("row", 1) < 0.7) & (F.col("row") % 3 == day)))
    return online.calibrator().apply(scored, "score").select("row", "label", "score")


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_rows(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("""
    SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INTEGER) AS label, CAST(10 AS INTEGER) AS num_features, CAST(o_orderkey % 7 AS INTEGER) AS first_id, CAST(0.5 AS DOUBLE) AS last_weight FROM orders
""")
def prediction_file(t: Tables) -> DataFrame:
    """Lines of `_id label num_features id:weight ...`."""
    line = F.concat_ws("\t", F.concat(F.lit("_"), F.col("o_orderkey").cast("string")), (F.col("o_orderstatus") == "F").cast("int").cast("string"), F.lit("10"), F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(":1.0")), F.lit("8:0.5"))
    found = t.orders.select(formats.parse_prediction(line).alias("p")).select("p.*")
    return found.select(F.substring("id", 2, 20).cast("long").alias("id"), F.col("label").cast("int").alias("label"), "num_features", F.get("ids", F.lit(0)).alias("first_id"), F.get("weights", F.lit(1)).alias("last_weight"))


# ---------------------------------------------------------------- streams


def _stream(t: Tables, table: str) -> DataFrame:
    """The table as a file stream; its folder is read by name, so that other tables beside it are left alone."""
    schema = getattr(t, table).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


@query("SELECT DISTINCT user_id FROM events WHERE value > 20")
def dedup_stream(t: Tables) -> DataFrame:
    path = t.scratch()
    # No watermark: files of the past come in any order, and rows behind a watermark would be dropped. State grows with the users alone.
    source = _stream(t, "events").filter("value > 20").select("user_id", F.lit(1.0).alias("score"))
    scoring.score_stream(source, None, lambda df: df, 0.5, "user_id", f"{path}/out", f"{path}/state").awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("user_id")


@query(f"""
    SELECT e.event_id, c.c_mktsegment, round(1 / (1 + exp(-{DUCK_LOGIT})), 6) AS score, c.c_custkey IN (SELECT o_custkey FROM orders) AS is_deleted
    FROM events e JOIN customer c ON c.c_custkey = e.event_id WHERE 1 / (1 + exp(-{DUCK_LOGIT})) > 0.6
""")
def stream_score_sink(t: Tables) -> DataFrame:
    path = t.scratch()
    static = t.customer.select(F.col("c_custkey").alias("event_id"), "c_mktsegment")
    deleted = t.orders.select(F.col("o_custkey").alias("event_id"))
    scorer = lambda df: df.select("event_id", "c_mktsegment", mathfn.sigmoid(logit()).alias("score"))
    scoring.score_stream(_stream(t, "events"), static, scorer, 0.6, "event_id", f"{path}/out", f"{path}/state", deleted=deleted).awaitTermination()
    return t.spark.read.parquet(f"{path}/out").select("event_id", "c_mktsegment", r(F.col("score")).alias("score"), "is_deleted")


@query("SELECT count(*) FILTER (event_type = 'error') AS hits, count(*) AS seen, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS ratio FROM events")
def stream_counters(t: Tables) -> DataFrame:
    name, path = f"counters_{uuid.uuid4().hex}", t.scratch()
    counted = scoring.running_counters(_stream(t, "events"), "event_type = 'error'")
    counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return t.spark.table(name).select("hits", "seen", r(F.col("ratio")).alias("ratio"))


# ---------------------------------------------------------------- models


def quality_rows(t: Tables) -> DataFrame:
    """row, label and three features of the labelled documents."""
    words = text.tokens(F.col("text"))
    f = F.array(F.log1p(F.col("n_chars").cast("double")), F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)), F.length("text") / F.greatest(F.size(words), F.lit(1)))
    return t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("row"), F.col("quality").alias("label"), f.alias("features"))


def _trained(kind: str, **params):
    def run(t: Tables) -> DataFrame:
        rows = quality_rows(t)
        train = rows.filter(batching.draw("row", 1) < 0.7)
        return registry.train(kind, train, **params).score(rows).select("row", "label", "score")

    return run


for _name, _kind, _params in (("train_logistic", "logistic", {"rounds": 50}), ("train_svm", "libsvm", {"rounds": 30}), ("train_gbt", "gbdt", {"rounds": 5, "depth": 3}), ("train_mlp", "mlp", {"hidden": (8,), "rounds": 50}), ("train_random", "random", {}), ("train_minibatch", "logistic_sgd", {"rate": 0.5, "batch": 32, "epochs": 6, "parts": 4}), ("train_mlp2", "mlp2", {"hidden": (8, 4), "rounds": 60}), ("train_no_bias", "logistic", {"bias": False, "rounds": 50})):
    query(name=_name)(_trained(_kind, **_params))


@query()
def train_softmax(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("vec_id").alias("row"), "label", emb().alias("features"))
    return registry.train("softmax", rows, rounds=30).score(rows).select("row", "label", vectors.argmax(F.col("score")).alias("predicted"))


def letters(c: Column, letter: str) -> Column:
    """How often a letter is in a text, in either case."""
    low = F.lower(c)
    return F.length(low) - F.length(F.replace(low, F.lit(letter), F.lit("")))


@query()
def train_softmax_sgd(t: Tables) -> DataFrame:
    """The language of a document by letter shares: four classes, one hidden layer, mini-batches."""
    of_letter = F.array(*(letters(F.col("text"), c) / F.greatest(F.length("text"), F.lit(1)) for c in "aeinorstwyàéñßu"))
    names = F.array(*(F.lit(x) for x in ("de", "en", "es", "fr")))
    rows = t.documents.select(F.col("doc_id").alias("row"), (F.array_position(names, F.col("lang")) - 1).cast("int").alias("label"), of_letter.alias("features")).filter("label >= 0")
    rows = staged(rows)  # texts are read once; training, its means and scores read numbers
    train = rows.filter(batching.draw("row", 1) < 0.7)
    found = registry.train("softmax_sgd", train, hidden=16, optimiser="adam", rate=0.01, batch=32, epochs=15, parts=4)
    return found.score(rows).select("row", "label", vectors.argmax(F.col("score")).alias("predicted"))


def quality_ids(t: Tables, size: int, narrow: int | None = None) -> tuple[DataFrame, DataFrame]:
    """row, label, ids of the labelled documents, and the vocabulary; ids are places in the vocabulary of `size` words, 0 for the rest."""
    words = t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("row"), F.col("quality").alias("label"), "text")
    vocab = text.vocabulary(words, "text", size).persist()
    return text.id_lists(words, "row", "text", vocab, keep=("label",)), vocab


@query()
def train_text_cnn(t: Tables) -> DataFrame:
    rows, _ = quality_ids(t, 2000)
    rows = rows.persist()
    train = rows.filter(batching.draw("row", 1) < 0.7)
    model, words, _ = textcnn.fit(train, 2000, dim=8, widths=(2, 3), filters=8, optimiser="adam", rate=0.02, batch=16, epochs=6, parts=4)
    return model.score(rows, "row", "ids", words).select("row", "label", "score")


NCE_WORDS, NCE_DRAWS = 300, 12


@query(f"""
    WITH w AS (SELECT conv_id * 1000 + turn AS row, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS a FROM conversations),
    c AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(a) AS word FROM w) GROUP BY word),
    top AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) AS id FROM c QUALIFY id < {NCE_WORDS}),
    vocab AS (SELECT word, id, cnt FROM top UNION ALL SELECT 'UNK', 0, (SELECT coalesce(sum(cnt), 0) FROM c) - (SELECT coalesce(sum(cnt), 0) FROM top)),
    drawn AS (SELECT CAST(floor({draw_sql("'noise' || k", 3)} * (SELECT count(*) FROM vocab)) AS BIGINT) AS id FROM range({NCE_DRAWS}) t(k)),
    v AS (
        SELECT id, list_transform(range(4), lambda j: {draw_sql("'u' || id || ':' || j", 1)} - 0.5) AS u, list_transform(range(4), lambda j: {draw_sql("'v' || id || ':' || j", 1)} - 0.5) AS v,
               {draw_sql("'b' || id", 1)} - 0.5 AS bias, cnt / (SELECT sum(cnt) FROM vocab) AS chance FROM vocab),
    k AS (SELECT id, u, v, bias - ln({NCE_DRAWS} * chance) AS lift FROM v),
    ids AS (SELECT row, pos, coalesce(vocab.id, 0) AS id FROM (SELECT row, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM w) x LEFT JOIN vocab ON vocab.word = x.word AND vocab.id > 0),
    p AS (SELECT x.id AS center, y.id AS context, count(*) AS n FROM ids x JOIN ids y ON x.row = y.row AND abs(x.pos - y.pos) = 1 GROUP BY ALL),
    dots AS (SELECT center, n, list_sum(list_transform(range(1, 5), lambda j: a.u[j] * b.v[j])) + b.lift AS s FROM p JOIN k a ON a.id = center JOIN k b ON b.id = context),
    pos AS (SELECT center, sum(n) AS pairs, sum(n * (greatest(-s, 0) + ln(1 + exp(-abs(s))))) AS loss FROM dots GROUP BY center),
    neg AS (SELECT a.id AS center, sum(greatest(x, 0) + ln(1 + exp(-abs(x)))) AS against
            FROM (SELECT a.id, list_sum(list_transform(range(1, 5), lambda j: a.u[j] * b.v[j])) + b.lift AS x FROM k a, drawn JOIN k b USING (id)) a GROUP BY a.id)
    SELECT center, CAST(pairs AS BIGINT) AS pairs, round(loss / pairs + against, 6) AS loss FROM pos JOIN neg USING (center)
""")
def nce_loss(t: Tables) -> DataFrame:
    """The sampled loss of fixed vectors and fixed draws, by center."""
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row"), "text", text.tokens(F.col("text")).alias("words"))
    vocab = text.vocabulary(rows, "text", NCE_WORDS)
    n, total = vocab.agg(F.count("*"), F.sum("cnt")).first()
    fixed = lambda kind: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: batching.draw(F.concat(F.lit(kind), F.col("id").cast("string"), F.lit(":"), j.cast("string")), 1) - 0.5)
    known = vocab.select("id", fixed("u").alias("center"), fixed("v").alias("context"), (batching.draw(F.concat(F.lit("b"), F.col("id").cast("string")), 1) - 0.5).alias("bias"), (F.col("cnt") / total).alias("chance"))
    drawn = t.spark.range(NCE_DRAWS).select(F.floor(batching.draw(F.concat(F.lit("noise"), F.col("id").cast("string")), 3) * n).cast("int").alias("id"))
    ids = text.encode(rows, "row", "words", vocab).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    pairs = text.skipgrams(ids, "row", "ids", 1).groupBy("center", "context").agg(F.count("*").alias("n"))
    lost = nce.losses(pairs, drawn, known).join(pairs, ["center", "context"])
    return lost.groupBy(F.col("center").cast("long").alias("center")).agg(F.sum("n").alias("pairs"), r(F.sum(F.col("n") * F.col("loss")) / F.sum("n")).alias("loss"))


@query()
def train_nce(t: Tables) -> DataFrame:
    """Each frequent word's nearest other by vectors trained on all documents."""
    rows = t.documents.select(F.col("doc_id").alias("row"), "text")
    vocab = text.vocabulary(rows, "text", 500).persist()
    ids = text.id_lists(rows, "row", "text", vocab, unknown=-1).filter(F.size("ids") > 0)
    found, _ = nce.fit(ids, vocab, size=12, window=2, draws=32, optimiser="adam", rate=0.1, batch=2, epochs=6, parts=4)
    near = lookups.top_k_cosine(found.filter("id > 0"), "id", "vector", found.filter("id > 0"), 1)
    named = vocab.select("id", "word")
    return near.join(named, near["query_id"] == named["id"]).select("neighbor_id", "word", "similarity").join(named.select(F.col("id").alias("neighbor_id"), F.col("word").alias("neighbor")), "neighbor_id").select("word", "neighbor", "similarity")


@query()
def train_cbow(t: Tables) -> DataFrame:
    rows, vocab = quality_ids(t, 5000)
    rows = rows.persist()
    train = rows.filter(batching.draw("row", 1) < 0.7)
    model = cbow.fit(train, vocab.select("id"), dim=8, rate=0.1, epochs=4, batches=2)
    return model.score(rows).select("row", "label", "score")


@query()
def train_gradient(t: Tables) -> DataFrame:
    rows = quality_rows(t)
    return registry.train("gradient", rows.filter(batching.draw("row", 1) < 0.7), optimiser="adam", rounds=40).score(rows).select("row", "label", "score")


@query(f"""
    WITH g AS (SELECT CAST(event_type = 'purchase' AS INTEGER) AS y, {DUCK_LOGIT} * s.step AS z, s.step FROM events, (VALUES (1), (2)) AS s(step)),
    m AS (SELECT step, avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))) AS loss, avg(CAST((z > 0) = (y = 1) AS INTEGER)) AS accuracy FROM g GROUP BY step)
    SELECT step, 'loss' AS name, round(loss, 6) AS value FROM m UNION ALL SELECT step, 'accuracy', round(accuracy, 6) FROM m
""")
def summaries(t: Tables) -> DataFrame:
    path = t.scratch()
    rows = t.events.select((F.col("event_type") == "purchase").cast("int").alias("y"), logit().alias("z"))
    for step in (1, 2):
        z = F.col("z") * step
        hit = ((z > 0) == (F.col("y") == 1)).cast("int")
        sinks.append_summary(rows.agg(F.avg(metrics.logit_loss(z, F.col("y"))).alias("loss"), F.avg(hit).alias("accuracy")), path, step)
    return t.spark.read.parquet(path).select("step", "name", r(F.col("value")).alias("value"))


@query()
def train_boosted(t: Tables) -> DataFrame:
    rows = quality_rows(t).select("row", "label", *(F.get("features", F.lit(k)).alias(f"f{k}") for k in range(3)))
    model = trees.boost(rows, "label", ["f0", "f1", "f2"], "row", rounds=4, depth=2, rate=0.3, bins=32, bag_fraction=0.8, smoothing=0.05)
    return model.score(rows).select("row", "label", "score")


@query()
def train_ranking(t: Tables) -> DataFrame:
    rows = quality_rows(t).join(t.documents.select(F.col("doc_id").alias("row"), F.col("source").alias("group")), "row")
    train = rows.filter(batching.draw("row", 1) < 0.7)
    return registry.train("gbdt_ranking", train, rounds=6, depth=3, rate=0.5, filter_zero=True).score(rows).select("row", "group", "label", "score")


@query()
def train_lambdarank(t: Tables) -> DataFrame:
    rows = quality_rows(t).join(t.documents.select(F.col("doc_id").alias("row"), F.col("source").alias("group")), "row")
    train = rows.filter(batching.draw("row", 1) < 0.7)
    return registry.train("gbdt_ranking", train, rounds=4, depth=3, rate=0.5, first=20).score(rows).select("row", "group", "label", "score")


@query()
def train_newton(t: Tables) -> DataFrame:
    rows = quality_rows(t)
    train = rows.filter(batching.draw("row", 1) < 0.7)
    return registry.train("gbdt_newton", train, rounds=5, depth=3).score(rows).select("row", "label", "score")


def ranked_documents(t: Tables) -> DataFrame:
    """Labelled documents as rows of ranking groups, with labels 0 to 2 and a fixed score."""
    held = t.labels.groupBy("doc_id").agg(F.max(F.col("quality") + F.col("quality") * (1 - F.col("toxic"))).alias("label"))
    return t.documents.join(held, "doc_id").select("doc_id", F.concat_ws("/", "source", "lang").alias("group"), "label", (F.floor(F.col("n_chars") / 100) / 50.0).alias("score"))


@query("""
    WITH l AS (SELECT doc_id, max(quality + quality * (1 - toxic)) AS y FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, concat_ws('/', source, lang) AS g, y, floor(n_chars / 100) / 50.0 AS s FROM documents JOIN l USING (doc_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, doc_id) AS rank, row_number() OVER (PARTITION BY g ORDER BY y DESC, doc_id) AS best FROM d),
    p AS (SELECT *, CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END AS dis FROM k),
    i AS (SELECT g, sum((pow(2, y) - 1) / log2(best + 1.0)) AS ideal FROM k WHERE best <= 10 GROUP BY g),
    pairs AS (
        SELECT a.g, a.doc_id AS up, b.doc_id AS down, 1 / (1 + exp(a.s - b.s)) AS wrong, abs(pow(2, a.y) - pow(2, b.y)) * abs(a.dis - b.dis) / ideal AS change
        FROM p a JOIN p b ON a.g = b.g AND a.y > b.y JOIN i ON i.g = a.g),
    sums AS (
        SELECT doc_id, sum(pull) AS pull, sum(bend) AS bend
        FROM (SELECT up AS doc_id, wrong * change AS pull, wrong * (1 - wrong) * change AS bend FROM pairs UNION ALL SELECT down, -wrong * change, wrong * (1 - wrong) * change FROM pairs) GROUP BY doc_id)
    SELECT doc_id, round(coalesce(pull, 0), 6) + 0.0 AS residual, round(coalesce(bend, 0), 6) AS curvature FROM d LEFT JOIN sums USING (doc_id)
""")
def lambda_slopes(t: Tables) -> DataFrame:
    found = trees.lambda_slopes(ranked_documents(t), "group", "doc_id", "label", "score", 10)
    return found.select("doc_id", (r(F.col("residual")) + 0.0).alias("residual"), r(F.col("curvature")).alias("curvature"))


@query("""
    WITH e AS (SELECT CAST(event_type = 'purchase' AS INTEGER) AS y, CAST(least(floor(value / 20), 20) AS INTEGER) AS a, CAST(date_part('hour', ts) AS INTEGER) AS b FROM events WHERE value IS NOT NULL),
    q AS (SELECT y, a, b, avg(y) OVER () AS p FROM e),
    g AS (SELECT a, b, y - p AS r, p * (1 - p) AS h FROM q),
    u AS (SELECT 1 AS f, a AS bin, r, h FROM g UNION ALL SELECT 2, b, r, h FROM g),
    s AS (SELECT f, bin, sum(r) AS r, sum(h) AS h, count(*) AS n FROM u GROUP BY f, bin),
    c AS (SELECT f, bin, sum(r) OVER x AS rl, sum(h) OVER x AS hl, sum(n) OVER x AS nl, sum(r) OVER y AS ra, sum(h) OVER y AS ha, sum(n) OVER y AS na FROM s WINDOW x AS (PARTITION BY f ORDER BY bin), y AS (PARTITION BY f)),
    gains AS (SELECT *, rl * rl / (hl + 1) + (ra - rl) * (ra - rl) / (ha - hl + 1) - ra * ra / (ha + 1) AS gain FROM c WHERE nl < na),
    best AS (SELECT * FROM gains ORDER BY round(gain, 9) DESC, f, bin LIMIT 1)
    SELECT CASE f WHEN 1 THEN 'a' ELSE 'b' END AS feature, bin, round(gain, 6) AS gain, round(rl / (hl + 1), 6) AS low, round((ra - rl) / (ha - hl + 1), 6) AS high, CAST(nl AS BIGINT) AS docs FROM best
""")
def newton_split(t: Tables) -> DataFrame:
    """The first split of second-order boosting by logistic loss, and its leaves."""
    given = t.events.filter("value is not null").select((F.col("event_type") == "purchase").cast("int").alias("label"), F.least(F.floor(F.col("value") / 20), F.lit(20)).cast("int").alias("a"), F.hour("ts").alias("b"))
    start = F.lit(trees.LOGISTIC.start(given.agg(F.avg("label")).first()[0]))
    rows = given.select(F.lit("0").alias("node"), "a", "b", trees.LOGISTIC.slope(F.col("label"), start).alias("residual"), trees.LOGISTIC.curvature(F.col("label"), start).alias("curvature"))
    split = trees.best_splits(rows, ["a", "b"], curvature="curvature", ridge=1.0)
    left = F.when(F.col("feature") == "a", F.col("a") <= F.col("bin")).otherwise(F.col("b") <= F.col("bin"))
    met = rows.join(F.broadcast(split), "node")  # one row
    side = lambda c, on: F.sum(F.when(left == on, F.col(c)).otherwise(0.0))
    leaf = lambda on: r(side("residual", on) / (side("curvature", on) + 1.0))
    return met.groupBy("feature", "bin", r(F.col("gain")).alias("gain")).agg(leaf(True).alias("low"), leaf(False).alias("high"), F.count(F.when(left, 1)).alias("docs"))


@query()
def train_ensemble(t: Tables) -> DataFrame:
    rows = quality_rows(t)
    return registry.ensemble(rows, "logistic,gbdt", "2,1", "row").score(rows).select("row", "label", "score")


@query()
def word2vec(t: Tables) -> DataFrame:
    """Frequent words, the length of their vectors, and the nearest other word."""
    turns = t.conversations.select(text.tokens(F.col("text")).alias("words"))
    model = registry.word2vec(turns, "words", size=8, least=5, rounds=3)
    found = staged(model.getVectors().select("word", vector_to_array("vector").alias("vector")))  # else the driver works on each copy itself
    near = lookups.top_k_cosine(found, "word", "vector", found, 1).select(F.col("query_id").alias("word"), F.col("neighbor_id").alias("neighbor"), "similarity")
    return found.select("word", vectors.norm(F.col("vector")).alias("length")).join(near, "word")


@query()
def validation_grid(t: Tables) -> DataFrame:
    """Settings of a trainer, and their AUC on two validation frames."""
    rows = quality_rows(t).persist()
    u = batching.draw("row", 1)
    valid = {"first": rows.filter((u >= 0.7) & (u < 0.85)), "second": rows.filter(u >= 0.85)}
    found = registry.validated("logistic", rows.filter(u < 0.7), valid, [{"reg": 0.0, "rounds": 20}, {"reg": 0.1, "rounds": 20}])
    return t.spark.createDataFrame([(f["reg"], f["first"], f["second"]) for f in found], "reg double, first double, second double")


@query("""
    WITH w AS (SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n, len(embedding) AS size FROM embeddings)
    SELECT vec_id, n < 0.5 * size AS sparse FROM w
""")
def sparse_choice(t: Tables) -> DataFrame:
    above = F.transform("embedding", lambda x: F.greatest(x, F.lit(0.0).cast("float")))
    return t.embeddings.select("vec_id", vectors.is_sparse(above).alias("sparse"))


@query()
def model_roundtrip(t: Tables) -> DataFrame:
    rows, path = quality_rows(t), t.scratch()
    model = registry.train("logistic", rows, rounds=30)
    model.calibrator = registry.calibrate(model.score(rows), "score", "label", "isotonic")
    model.save(path)
    return registry.Model.load(path).score(rows).select("row", "label", "score")
