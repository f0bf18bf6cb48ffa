"""Every registered query of the engine and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import functions as fn
from .operators import aggregates as agg, dml, graph, rag, scans, textsearch
from .operators.predicates import And, Eq, In, Not, Or, Range
from .plans.catalog import Catalog
from .plans.pipes import graph_pipe, pipe
from .plans.sql import Database
from .sources import store
from .streaming import oplog
from .types import NUMBER, ColumnSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- driver tables as virtual tables ------------------------------------------------
def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d):
    """lineitem with whole numbers; lines of an order with one number share their id."""
    return _read(spark, d, "lineitem").select((F.col("l_orderkey").cast("bigint") * 8 + F.col("l_linenumber")).alias("eid"), F.col("l_orderkey").cast("bigint").alias("orderkey"), F.col("l_partkey").cast("bigint").alias("partkey"), F.col("l_suppkey").cast("bigint").alias("suppkey"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("shipped"))


def _customers(spark, d):
    return _read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("eid"), F.col("c_custkey").cast("bigint").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment"))


def _orders(spark, d):
    return _read(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("eid"), F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_custkey").cast("bigint").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day"))


def _nations(spark, d):
    return _read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("eid"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("region"))


def _documents(spark, d):
    return _read(spark, d, "documents").select(F.col("doc_id").alias("eid"), "text", "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"))


def _vectors(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("eid"), "embedding", F.col("label").cast("bigint").alias("label"))


def _ops(spark, d):
    """events as a change log: a user's attribute is tied to each event's id; errors
    untie, and each seventh signup deletes the user."""
    kind = F.expr("case when event_type = 'error' then 'untie' when event_type = 'signup' and event_id % 7 = 0 then 'delete' else 'tie' end")
    return _read(spark, d, "events").select(F.col("event_id").cast("bigint").alias("lsn"), F.expr("unix_micros(cast(ts as timestamp))").alias("wall"), F.col("event_id").cast("bigint").alias("logical"), (F.col("user_id") % 3).cast("bigint").alias("peer"), F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("author"), F.col("user_id").cast("bigint").alias("eid"), F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type")).alias("attribute"), kind.alias("kind"), F.col("event_id").cast("string").alias("value"))


_L = "l AS (SELECT l_orderkey::BIGINT * 8 + l_linenumber AS eid, l_orderkey::BIGINT AS orderkey, l_partkey::BIGINT AS partkey, l_suppkey::BIGINT AS suppkey, l_linenumber::BIGINT AS line, l_quantity::BIGINT AS qty, l_returnflag AS flag, l_linestatus AS status, l_shipdate::DATE AS shipped FROM lineitem)"
_C = "c AS (SELECT c_custkey::BIGINT AS eid, c_custkey::BIGINT AS id, c_name AS name, c_nationkey::BIGINT AS nation, c_mktsegment AS segment FROM customer)"
_O = "o AS (SELECT o_orderkey::BIGINT AS eid, o_orderkey::BIGINT AS id, o_custkey::BIGINT AS customer, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate::DATE AS day FROM orders)"
_OPS = """ops AS (SELECT event_id::BIGINT AS lsn, epoch_us(ts)::BIGINT AS wall, event_id::BIGINT AS logical, (user_id % 3)::BIGINT AS peer, 'w' || (user_id % 5) AS author, user_id::BIGINT AS eid,
  CASE WHEN event_type = 'error' THEN 'click' ELSE event_type END AS attribute,
  CASE WHEN event_type = 'error' THEN 'untie' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'delete' ELSE 'tie' END AS kind, event_id::VARCHAR AS value FROM events)"""


# -- pipes ------------------------------------------------------------------------------
@query("SELECT l_linestatus AS key, sum(l_quantity)::BIGINT AS sum FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber BETWEEN 1 AND 3 GROUP BY 1")
def pipe_group_sum(spark, d):
    return pipe(_lines(spark, d), 'flag:"R" line:1..3 | group status | sum qty')


@query("SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 2")
def pipe_count(spark, d):
    return pipe(_lines(spark, d), 'flag:"A" line:2 | count')


@query("SELECT l_linenumber::BIGINT AS key, (sum(l_quantity::BIGINT) // count(*))::BIGINT AS avg FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def pipe_group_avg(spark, d):
    return pipe(_lines(spark, d), 'status:"O" | group line | avg qty')


@query(f"WITH {_L} SELECT eid FROM l WHERE flag = 'N' AND qty BETWEEN 48 AND 50 AND line = 7")
def pipe_entities(spark, d):
    return pipe(_lines(spark, d), 'flag:"N" qty:48..50 line:7')


@query("SELECT DISTINCT l_linenumber::BIGINT AS value FROM lineitem WHERE l_returnflag = 'A'")
def pipe_distinct(spark, d):
    return pipe(_lines(spark, d), 'flag:"A" | distinct line')


# -- filters -------------------------------------------------------------------------------
@query(f"WITH {_L} SELECT eid, qty FROM l WHERE suppkey = 7")
def scan_eq(spark, d):
    return scans.pull(_lines(spark, d), "suppkey", 7).select("eid", "qty")


@query(f"WITH {_L} SELECT eid FROM l WHERE flag = 'R' AND status = 'F' AND line = 4")
def scan_and(spark, d):
    return scans.query(_lines(spark, d), [("flag", "R"), ("status", "F"), ("line", 4)]).select("eid")


@query(f"WITH {_L} SELECT eid FROM l WHERE partkey IN (3, 5, 8, 13)")
def scan_in(spark, d):
    return scans.pull_in(_lines(spark, d), "partkey", [3, 5, 8, 13, 3]).select("eid")


@query(f"WITH {_L} SELECT eid, qty FROM l WHERE qty BETWEEN 10 AND 12")
def scan_range(spark, d):
    return scans.range_scan(_lines(spark, d), "qty", 10, 12).select("eid", "qty")


@query(f"WITH {_O} SELECT eid, date_diff('day', DATE '2000-01-01', day)::BIGINT AS days FROM o WHERE day BETWEEN DATE '2000-02-28' AND DATE '2000-03-31'")
def scan_dates(spark, d):
    o = _orders(spark, d).where(F.col("day").between("2000-02-28", "2000-03-31"))
    return o.select("eid", fn.date_to_days(F.col("day")).alias("days"))


@query("SELECT d AS days, strftime(DATE '2000-01-01' + d::INT, '%Y-%m-%d') AS day FROM range(0, 9000, 37) AS r(d)")
def days_to_date(spark, d):
    return spark.range(0, 9000, 37).select(F.col("id").alias("days"), fn.days_to_date(F.col("id")).cast("string").alias("day"))


@query(f"WITH {_C} SELECT attribute, value FROM (SELECT unnest(['id', 'name', 'nation', 'segment']) AS attribute, unnest([id::VARCHAR, name, nation::VARCHAR, segment]) AS value FROM c WHERE eid = 42) WHERE value IS NOT NULL")
def read_entity(spark, d):
    return scans.entity(_customers(spark, d), 42).select("attribute", "value")


@query(f"WITH {_C} SELECT id AS eid, coalesce(nation + 1, 0)::BIGINT AS stored FROM (SELECT r AS id, nation FROM range(1, 40000, 97) AS x(r) LEFT JOIN c ON c.eid = r)")
def read_stored_many(spark, d):
    return scans.stored_many(_customers(spark, d), spark.range(1, 40000, 97).withColumnRenamed("id", "eid"), "nation")


@query("SELECT count(DISTINCT l_partkey)::BIGINT AS cardinality FROM lineitem")
def cardinality(spark, d):
    return scans.cardinality(_lines(spark, d), "partkey")


@query("SELECT doc_id AS eid FROM documents WHERE NOT coalesce(nullif(lang, 'de') = 'en' OR n_chars BETWEEN 0 AND 500, FALSE)")
def filter_not_or(spark, d):
    docs = _documents(spark, d).withColumn("lang", F.expr("nullif(lang, 'de')"))
    return docs.where(Not(Or((Eq("lang", "en"), Range("n_chars", 0, 500)))).column()).select("eid")


@query("SELECT doc_id AS eid FROM documents WHERE lang IN ('fr', 'es') AND source IN ('src1', 'src2') AND NOT n_chars < 300")
def filter_algebra(spark, d):
    f = And((In("lang", ("fr", "es")), In("source", ("src1", "src2")), Not(Range("n_chars", 0, 299))))
    return _documents(spark, d).where(f.column()).select("eid")


# -- aggregates -----------------------------------------------------------------------------
@query("SELECT sum(l_quantity)::BIGINT AS sum, count(*) AS count, min(l_quantity)::BIGINT AS min, max(l_quantity)::BIGINT AS max, (sum(l_quantity::BIGINT) // count(*))::BIGINT AS avg FROM lineitem")
def agg_scalars(spark, d):
    df = _lines(spark, d)
    return df.selectExpr("qty").agg(F.coalesce(F.sum("qty"), F.lit(0)).alias("sum"), F.count("*").alias("count"), F.min("qty").alias("min"), F.max("qty").alias("max"), F.expr("sum(qty) div count(qty)").alias("avg"))


for _name, _call, _sql in [
    ("agg_sum", lambda df: agg.sum_(df, "qty"), "SELECT coalesce(sum(qty), 0)::BIGINT AS sum FROM l"),
    ("agg_count_col", lambda df: agg.count_col(df, "qty"), "SELECT count(qty) AS count FROM l"),
    ("agg_min", lambda df: agg.min_(df, "qty"), "SELECT min(qty) AS min FROM l"),
    ("agg_max", lambda df: agg.max_(df, "qty"), "SELECT max(qty) AS max FROM l"),
    ("agg_avg", lambda df: agg.avg(df, "qty"), "SELECT (sum(qty) // count(qty))::BIGINT AS avg FROM l"),
    ("agg_distinct", lambda df: agg.distinct(df, "flag"), "SELECT DISTINCT flag AS value FROM l"),
    ("group_count", lambda df: agg.group_count(df, "suppkey"), "SELECT suppkey AS key, count(*) AS count FROM l GROUP BY 1"),
    ("group_sum", lambda df: agg.group_sum(df, "partkey", "qty"), "SELECT partkey AS key, sum(qty)::BIGINT AS sum FROM l GROUP BY 1"),
    ("group_avg", lambda df: agg.group_avg(df, "flag", "qty"), "SELECT flag AS key, (sum(qty) // count(qty))::BIGINT AS avg FROM l GROUP BY 1"),
    ("group_min", lambda df: agg.group_min(df, "suppkey", "qty"), "SELECT suppkey AS key, min(qty) AS min FROM l GROUP BY 1"),
    ("group_max", lambda df: agg.group_max(df, "suppkey", "qty"), "SELECT suppkey AS key, max(qty) AS max FROM l GROUP BY 1"),
    ("histogram", lambda df: agg.histogram(df, "qty", 5, 44, 7), "SELECT b AS bucket, count(qty) AS count FROM range(7) AS r(b) LEFT JOIN l ON qty BETWEEN 5 AND 44 AND ((qty - 5) * 7) // 40 = b GROUP BY 1"),
]:
    QUERIES[_name] = lambda spark, d, call=_call: call(_lines(spark, d))
    ORACLE[_name] = f"WITH {_L} {_sql}"


@query(f"WITH {_L} SELECT CASE WHEN status = 'F' THEN NULL ELSE flag END AS key, sum(CASE WHEN line = 1 THEN NULL ELSE qty END)::BIGINT AS sum FROM l WHERE CASE WHEN status = 'F' THEN NULL ELSE flag END IS NOT NULL AND line <> 1 GROUP BY 1")
def group_sum_missing(spark, d):
    df = _lines(spark, d).select(F.expr("if(status = 'F', null, flag)").alias("flag"), F.expr("if(line = 1, null, qty)").alias("qty"))
    return agg.group_sum(df, "flag", "qty")


# -- query builder and catalog ---------------------------------------------------------------
@query(f"WITH {_L} SELECT flag AS key, max(qty) AS max FROM l WHERE line IN (2, 4) AND qty >= 10 AND qty < 40 AND status = 'O' GROUP BY 1")
def builder_group_max(spark, d):
    t = Catalog(spark).register("lines", _lines(spark, d).drop("shipped"), "eid")
    return t.query().where_in("line", [2, 4]).where_ge("qty", 10).where_lt("qty", 40).where_eq("status", "O").group_max("flag", "qty")


@query(f"WITH {_O} SELECT eid, customer, status FROM o WHERE status = 'F' AND customer BETWEEN 10 AND 60 ORDER BY eid LIMIT 25")
def builder_find(spark, d):
    t = Catalog(spark).register("orders", _orders(spark, d).drop("day"), "id")
    return t.query().where_eq("status", "F").where_range("customer", 10, 60).limit(25).find().select("eid", "customer", "status")


@query(f"WITH {_C} SELECT eid, name, CASE WHEN id = 5 THEN 3 ELSE NULL END::BIGINT AS score FROM c WHERE nation = 4")
def catalog_evolve(spark, d):
    cat = Catalog(spark)
    t = cat.scope("t1").catalog.register("t1.customer", _customers(spark, d), "id")
    cat.add_column("t1.customer", ColumnSpec("score", NUMBER))
    t.update(5, {"score": 3})
    return cat.scope("t1").table("customer").query().where_eq("nation", 4).find().select("eid", "name", "score")


# -- SQL --------------------------------------------------------------------------------------
def _db(spark, d) -> Database:
    db = Database(spark)
    db.register("customer", _customers(spark, d).drop("eid"), "id")
    db.register("orders", _orders(spark, d).drop("eid", "day"), "id")
    return db


@query(f"WITH {_C} SELECT id, name FROM c WHERE nation >= 3 AND nation <= 9 AND segment = 'BUILDING' ORDER BY id DESC LIMIT 10 OFFSET 5")
def sql_order_limit_offset(spark, d):
    return _db(spark, d).execute("SELECT id, name FROM customer WHERE nation BETWEEN 3 AND 9 AND segment = 'BUILDING' ORDER BY id DESC LIMIT 10 OFFSET 5")


@query("""WITH t AS (SELECT l_orderkey::BIGINT AS id, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity::BIGINT END AS q FROM lineitem)
    SELECT q, count(*) AS n FROM (SELECT q FROM t ORDER BY q DESC NULLS FIRST LIMIT 12000) GROUP BY 1""")
def sql_nulls_desc(spark, d):
    """The first 12,000 lines in descending order: nulls, where there are fewer of them then the greatest."""
    db = Database(spark)
    db.register("t", _lines(spark, d).selectExpr("orderkey as id", "if(line = 3, null, qty) as q"))
    return db.execute("SELECT q FROM t ORDER BY q DESC LIMIT 12000").groupBy("q").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT l_orderkey::BIGINT AS id, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity::BIGINT END AS q FROM lineitem),
    r AS (SELECT q FROM t ORDER BY q DESC NULLS FIRST LIMIT 40), s AS (SELECT q FROM t WHERE q IS NOT NULL ORDER BY q DESC NULLS FIRST LIMIT 40)
    SELECT count(*) - count(q) AS nulls, (SELECT coalesce(sum(q), 0)::BIGINT FROM s) AS sum FROM r""")
def sql_nulls_desc_all(spark, d):
    """All of lineitem: the nulls among the first rows, the sum of the first that are none."""
    db = Database(spark)
    db.register("t", _lines(spark, d).selectExpr("orderkey as id", "if(line = 3, null, qty) as q"))
    nulls = db.execute("SELECT q FROM t ORDER BY q DESC LIMIT 40").agg((F.count("*") - F.count("q")).alias("nulls"))
    return nulls.crossJoin(db.execute("SELECT q FROM t WHERE q IS NOT NULL ORDER BY q DESC LIMIT 40").agg(F.coalesce(F.sum("q"), F.lit(0)).alias("sum")))


@query(f"WITH {_C} SELECT id, name, nation, CASE WHEN id IN (7, 8) THEN 'MOVED' ELSE segment END AS segment FROM c UNION ALL SELECT 99999999, 'new', NULL, 'X'")
def sql_or_replace(spark, d):
    """Rows merged into the whole table: columns that are not named keep their values."""
    db = _db(spark, d)
    db.execute("INSERT OR REPLACE INTO customer (id, segment) VALUES (7, 'MOVED'), (8, 'MOVED'); INSERT INTO customer (id, name, segment) VALUES (99999999, 'new', 'X')")
    return db.execute("SELECT id, name, nation, segment FROM customer")


@query(f"WITH {_C} SELECT id, name, CASE WHEN id = 7 THEN 'MOVED' ELSE segment END AS segment FROM c UNION ALL SELECT 99999999, 'new', 'X'")
def sql_or_replace_all(spark, d):
    """The merge into the whole table."""
    db = _db(spark, d)
    db.execute("INSERT OR REPLACE INTO customer (id, segment) VALUES (7, 'MOVED'); INSERT OR REPLACE INTO customer (id, name, segment) VALUES (99999999, 'new', 'X')")
    return db.execute("SELECT id, name, segment FROM customer")


@query(f"WITH {_O} SELECT id, CASE WHEN status = 'P' THEN 'pending' ELSE status END AS status FROM o WHERE NOT (customer < 100)")
def sql_update_delete(spark, d):
    return _db(spark, d).execute("UPDATE orders SET status = 'pending', priority = NULL WHERE status = 'P'; DELETE FROM orders WHERE customer < 100; SELECT id, status FROM orders")


@query(f"WITH {_C} SELECT count(*) AS n FROM c WHERE segment IS NOT NULL AND 5 < id AND id <= 300")
def sql_predicates(spark, d):
    return _db(spark, d).execute("SELECT * FROM customer WHERE segment IS NOT NULL AND (5 < id) AND id <= 300").agg(F.count("*").alias("n"))


# -- graph ---------------------------------------------------------------------------------------
@query("SELECT o_orderkey::BIGINT AS eid, n_regionkey::BIGINT AS target FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'")
def graph_path(spark, d):
    steps = [(_orders(spark, d), "customer"), (_customers(spark, d), "nation"), (_nations(spark, d), "region")]
    return graph.path(_orders(spark, d).where("status = 'P'"), steps)


@query("SELECT c_nationkey::BIGINT AS eid FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'")
def graph_follow(spark, d):
    o = _orders(spark, d)
    return graph.follow(o.where("priority = '1-URGENT'"), [(o, "customer"), (_customers(spark, d), "nation")])


@query("SELECT DISTINCT o_orderkey::BIGINT AS eid FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def graph_reverse(spark, d):
    return graph.reverse(_customers(spark, d).where("nation = 3"), _orders(spark, d), "customer")


def _tree(spark, d):
    """Customers as a tree: each refers to the one with a third of its number."""
    return _customers(spark, d).selectExpr("eid", "id", "if(id > 2, id div 3, null) as parent")


@query("WITH RECURSIVE t AS (SELECT c_custkey::BIGINT AS eid, CASE WHEN c_custkey > 2 THEN c_custkey::BIGINT // 3 END AS parent FROM customer), b AS (SELECT 0 AS level, 1::BIGINT AS eid UNION ALL SELECT level + 1, t.eid FROM b JOIN t ON t.parent = b.eid WHERE level < 4) SELECT level, eid FROM b")
def graph_bfs(spark, d):
    t = _tree(spark, d)
    return graph.bfs(t.where("eid = 1"), t, "parent", 4)


@query("WITH t AS (SELECT c_custkey::BIGINT AS eid, CASE WHEN c_custkey > 2 THEN c_custkey::BIGINT // 3 END AS parent FROM customer) SELECT count(*) AS count FROM t WHERE parent IN (SELECT eid FROM t WHERE parent = 1)")
def graph_language(spark, d):
    return graph_pipe(_tree(spark, d), "id:1 | reverse parent | reverse parent | count")


@query("SELECT o_orderkey::BIGINT AS eid FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 5)")
def graph_dangling(spark, d):
    return graph.dangling(_orders(spark, d), "customer", _customers(spark, d).where("nation <> 5")).select("eid")


# -- text ------------------------------------------------------------------------------------------
@query("SELECT doc_id AS eid FROM documents WHERE contains(text, 'thing') AND contains(text, 'ing ')")
def text_search(spark, d):
    docs = _documents(spark, d)
    found = textsearch.search(docs, "thing")
    return textsearch.search(docs.join(found, "eid", "left_semi"), "ing ")


@query("SELECT doc_id AS eid FROM documents WHERE contains(text, 'the') AND contains(text, 'hea') AND contains(text, 'ea ')")
def text_candidates(spark, d):
    return _text_candidates(_documents(spark, d), "thea ", 3)


def _text_candidates(docs: DataFrame, q: str, n: int) -> DataFrame:
    """Only the query's grams are exploded, so the index is not built for one query."""
    want = textsearch.query_grams(q, n)
    return textsearch.candidates(docs.select("eid", F.explode(F.array_intersect(fn.grams(F.col("text"), n), F.array(*map(F.lit, want)))).alias("gram")), q, n)


@query("WITH g AS (SELECT DISTINCT doc_id, substr(text, i, 2) AS gram FROM documents, unnest(range(1, length(text))) AS x(i)) SELECT gram, count(*) AS docs FROM g GROUP BY 1")
def text_gram_counts(spark, d):
    return textsearch.index(_documents(spark, d)).groupBy("gram").agg(F.count("*").alias("docs"))


# -- retrieval ---------------------------------------------------------------------------------------
_QV = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QL = "[" + ", ".join(map(str, _QV)) + "]::DOUBLE[]"


def _vector_sql(score: str, where: str = "") -> str:
    return f"SELECT vec_id::BIGINT AS eid, round({score}, 6) AS score FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, {_QL} AS q FROM embeddings) {where} ORDER BY 2, 1 LIMIT 10"


@query(_vector_sql("greatest(0.0, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))))", "WHERE label <> 3"))
def vector_topk_cosine(spark, d):
    return rag.topk(_vectors(spark, d), _QV, 10, "cosine", where=Not(Eq("label", 3)))


@query(_vector_sql("list_sum([power(x - y, 2) for x, y in list_zip(e, q)])").replace("[power(x - y, 2) for x, y in list_zip(e, q)]", "list_transform(list_zip(e, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))"))
def vector_topk_l2(spark, d):
    return rag.topk(_vectors(spark, d), _QV, 10, "l2")


@query(_vector_sql("-list_dot_product(e, q)"))
def vector_topk_dot(spark, d):
    return rag.topk(_vectors(spark, d), _QV, 10, "dot")


_BM25 = r"""
    t AS (SELECT doc_id AS eid, list_filter(string_split_regex(lower(text), '[ \t\n\f\r.,!?;:()\[\]{}"''/\\|\-_~`。、！？「」『』]+'), lambda x: x <> '') AS t FROM documents),
    s AS (SELECT eid, len(t) AS dl, len(list_filter(t, lambda x: x = 'idiot')) AS a, len(list_filter(t, lambda x: x = 'thing')) AS b FROM t WHERE len(t) > 0),
    g AS (SELECT count(*) AS n, greatest(avg(dl), 1.0) AS avgdl, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM s),
    bm AS (SELECT eid, round(2 * ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM s, g WHERE a + b > 0)"""


@query(f"WITH {_BM25} SELECT * FROM bm")
def bm25(spark, d):
    return rag.bm25(_documents(spark, d), "Idiot thing, idiot")


_ALL_HYBRID = "documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings) WHERE lang = 'en'"


@query(f"""WITH {_BM25},
    v AS (SELECT doc_id AS eid, round(greatest(0.0, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))), 6) AS score
          FROM (SELECT doc_id, embedding::DOUBLE[] AS e, {_QL} AS q FROM {_ALL_HYBRID})),
    r AS (SELECT eid, row_number() OVER (ORDER BY score, eid) AS rank FROM v QUALIFY rank <= 40
          UNION ALL SELECT eid, row_number() OVER (ORDER BY score DESC, eid) AS rank FROM bm WHERE eid IN (SELECT doc_id FROM {_ALL_HYBRID}) QUALIFY rank <= 40)
    SELECT eid, round(sum(1.0 / (60 + rank)), 9) AS score FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def rrf_hybrid_all(spark, d):
    """Over all documents and vectors: their number is the modulus."""
    vectors = _vectors(spark, d)
    n = vectors.agg(F.count("*").alias("n"))  # one row
    docs = _documents(spark, d).join(F.broadcast(n)).withColumn("v", F.expr("eid % nullif(n, 0)")).drop("n")
    return rag.hybrid(docs.join(vectors.select(F.col("eid").alias("v"), "embedding"), "v"), _QV, "Idiot thing, idiot", 10, where=Eq("lang", "en"))


@query(ORACLE["rrf_hybrid_all"])
def rrf_hybrid(spark, d):
    return rrf_hybrid_all(spark, d)


@query()
def chunk(spark, d):
    return rag.chunk(_documents(spark, d), 400, 40).select("eid", "position", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("sha256"))


@query()
def hash_embed(spark, d):
    return rag.embed(_documents(spark, d), 16).select("eid", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query(f"WITH {_BM25}, top AS (SELECT eid, score FROM bm ORDER BY score DESC, eid LIMIT 20) SELECT eid, strlen(text)::INT AS bytes FROM top JOIN documents ON doc_id = eid")
def rerank_length(spark, d):
    docs = _documents(spark, d)
    top = rag.bm25(docs, "Idiot thing, idiot").orderBy(F.col("score").desc(), "eid").limit(20)
    return rag.rerank_by_length(top.join(docs.select("eid", "text"), "eid")).select("eid", F.octet_length("text").alias("bytes"))


# -- storage -----------------------------------------------------------------------------------------
@query("SELECT sha256(html) AS sha256, count(*) AS pages FROM pages GROUP BY 1")
def blob_dedupe(spark, d):
    pages = _read(spark, d, "pages")
    blobs = store.put_blobs(pages, "html")
    return pages.select(fn.blob_id(F.col("html")).alias("sha256")).groupBy("sha256").agg(F.count("*").alias("pages")).join(blobs.select("sha256"), "sha256", "left_semi")


@query(f"WITH {_O} SELECT status AS part, count(*) AS rows, CASE WHEN status = 'P' THEN 'changed' END AS change FROM o GROUP BY 1")
def seal_rows(spark, d):
    """A seal's parts, and which of them another version of the table changes: every
    digest is compared."""
    o = _orders(spark, d)
    now = o.withColumn("priority", F.when(F.col("status") == "P", F.lit("none")).otherwise(F.col("priority")))
    old = store.seal(o, "status")
    return old.join(store.seal_diff(old, store.seal(now, "status")), "part", "left").select("part", "rows", "change")


@query()
def seal_digest(spark, d):
    return store.seal(_orders(spark, d))


@query(f"WITH {_C} SELECT eid, nation * 4294967296 + id AS packed, nation AS peer, id AS local FROM c")
def entity_ids(spark, d):
    e = fn.make_eid(F.col("nation"), F.col("id"))
    return _customers(spark, d).select("eid", e.alias("packed")).select("eid", "packed", fn.eid_peer(F.col("packed")).alias("peer"), fn.eid_local(F.col("packed")).alias("local"))


@query(f"WITH {_C} SELECT eid, CASE WHEN nation = 3 THEN 'S3' ELSE segment END AS segment, CASE WHEN nation = 4 THEN NULL ELSE name END AS name FROM c WHERE nation <> 5")
def dml_tie_untie_delete(spark, d):
    df = dml.tie(_customers(spark, d), F.col("nation") == 3, {"segment": "S3"})
    return dml.delete(dml.untie(df, F.col("nation") == 4, "name"), F.col("nation") == 5).select("eid", "segment", "name")


# -- change log ------------------------------------------------------------------------------------------
@query(f"""WITH {_OPS},
    dead AS (SELECT eid, max((wall, logical, peer)) AS d FROM ops WHERE kind = 'delete' GROUP BY 1),
    won AS (SELECT *, row_number() OVER (PARTITION BY eid, attribute ORDER BY wall DESC, logical DESC, peer DESC) AS k FROM ops WHERE kind <> 'delete')
    SELECT won.eid, attribute, value FROM won LEFT JOIN dead USING (eid) WHERE k = 1 AND kind <> 'untie' AND (d IS NULL OR (wall, logical, peer) > d)""")
def lww_merge(spark, d):
    return oplog.merge(_ops(spark, d))


@query(f"WITH {_OPS} SELECT lsn, eid, kind FROM ops WHERE author = 'w2' AND wall BETWEEN 1704500000000000 AND 1705500000000000")
def oplog_audit(spark, d):
    top = (1 << 62)
    return oplog.audit(_ops(spark, d), (1704500000000000, 0, 0), (1705500000000000, top, top), "w2").select("lsn", "eid", "kind")


@query(f"WITH {_OPS}, p AS (SELECT peer, max(lsn) - peer * 50 AS lsn FROM ops GROUP BY 1) SELECT lsn, eid FROM ops WHERE lsn >= (SELECT min(lsn) FROM p)")
def oplog_reclaim(spark, d):
    ops = _ops(spark, d)
    peers = ops.groupBy("peer").agg((F.max("lsn") - F.col("peer") * 50).alias("lsn")).select("peer", "lsn")
    return oplog.reclaim(ops, peers).select("lsn", "eid")


@query(f"WITH {_OPS} SELECT lsn, 1 AS target FROM ops WHERE attribute = 'click' UNION ALL SELECT lsn, 2 FROM ops WHERE eid < 40")
def oplog_subscribe(spark, d):
    return oplog.subscribe(_ops(spark, d), {1: F.col("attribute") == "click", 2: F.col("eid") < 40}).select("lsn", "target")


@query(f"WITH {_OPS} SELECT kind, count(*) AS ops, max(lsn) AS last_lsn FROM ops GROUP BY 1")
def oplog_stats(spark, d):
    return oplog.stats(_ops(spark, d))


@query(f"WITH {_C} SELECT eid FROM c WHERE segment = 'BUILDING' AND nation = 7")
def shard_query(spark, d):
    router = oplog.ShardRouter([1, 2, 3])
    df = _customers(spark, d)
    return router.query({1: df, 2: df, 3: df}, [("segment", "BUILDING"), ("nation", 7)])
