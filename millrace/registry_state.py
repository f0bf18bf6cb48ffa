"""Registered queries of what keeps and changes data: stores, catalogs, text indexes,
retrieval stores and change logs, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import functions as fn
from .operators import dml, rag, scans, textsearch
from .operators.predicates import Eq, In
from .operators.vectorstore import StoreBuilder, VectorStore
from .plans.catalog import Catalog
from .plans.pipes import graph_pipe
from .plans.sql import Database
from .registry import _BM25, _C, _L, _O, _OPS, _QL, _QV, _customers, _documents, _lines, _nations, _ops, _orders, _tree, _vectors
from .sources import store
from .streaming import oplog
from .types import LEAF, NUMBER, TAG, BadValue, ColumnSpec, TableBuilder, Unsupported, checked_number

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_N = "n AS (SELECT n_nationkey::BIGINT AS eid, n_name AS name, n_regionkey::BIGINT AS region FROM nation)"
_P = "p AS (SELECT doc_id AS eid, text, lang, source, n_chars::BIGINT AS n_chars FROM documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, what: str) -> str:
    return f"{store.shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


# -- scans and point reads ------------------------------------------------------------------
@query("SELECT o_orderkey::BIGINT AS eid, o_orderstatus AS status FROM orders")
def store_open(spark, d):
    return store.open_table(spark, f"{d}/orders.parquet", "o_orderkey").select("eid", F.col("o_orderstatus").alias("status"))


@query("SELECT * FROM (VALUES (1, 'a', NULL), (2, NULL, 7), (3, 'c', 9)) AS t(eid, name, n)")
def store_from_rows(spark, d):
    return store.from_rows(spark, [(1, "a", None), (2, None, 7), (3, "c", 9)], "eid int, name string, n int")


@query(f"WITH {_L} SELECT DISTINCT eid FROM l")
def scan_entities(spark, d):
    return scans.entities(_lines(spark, d)).distinct()


@query(f"WITH {_C} SELECT eid FROM c WHERE nation <> 3")
def scan_having(spark, d):
    return scans.having(_customers(spark, d).withColumn("nation", F.expr("nullif(nation, 3)")), "nation")


@query(f"WITH {_L} SELECT eid, qty FROM l WHERE qty BETWEEN 2 AND 4")
def scan_by_value(spark, d):
    return scans.pull_range(_lines(spark, d), "qty", 2, 4, ordered=True).select("eid", "qty")


@query(f"WITH {_C} SELECT nation FROM c WHERE eid = 17")
def read_point(spark, d):
    return scans.point(_customers(spark, d), 17, "nation")


@query(f"WITH {_C} SELECT name FROM c WHERE eid = 23")
def read_text(spark, d):
    return scans.point(_customers(spark, d), 23, "name")


@query("SELECT * FROM (VALUES ('id'), ('name'), ('segment')) AS t(attribute)")
def read_attributes(spark, d):
    return scans.attributes_of(_customers(spark, d).withColumn("nation", F.lit(None).cast("bigint")), 5)


@query(f"WITH {_O} SELECT DISTINCT status AS value FROM o WHERE status = 'P'")
def find_value(spark, d):
    return scans.find_value(_orders(spark, d), "status", "P")


@query(f"WITH {_L} SELECT eid, shipped FROM l WHERE shipped BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'")
def scan_date_range(spark, d):
    return scans.pull_dates(_lines(spark, d), "shipped", "1997-03-01", "1997-03-31").select("eid", "shipped")


@query(f"WITH {_C} SELECT r AS eid, r IN (SELECT eid FROM c) AS live FROM range(0, 40000, 61) AS x(r)")
def entity_live(spark, d):
    return scans.live(_customers(spark, d), spark.range(0, 40000, 61).withColumnRenamed("id", "eid"))


@query(f"WITH {_O} SELECT count(DISTINCT eid) AS entities, max(eid) + 1 AS next_eid, 4294967296 - max(eid) - 1 AS remaining FROM o")
def entity_counters(spark, d):
    return scans.counters(_orders(spark, d))


@query(f"WITH {_C} SELECT eid, name, CASE WHEN segment <> 'BUILDING' THEN segment END AS segment FROM c")
def content_read(spark, d):
    df = _customers(spark, d).withColumn("segment", F.expr("nullif(segment, 'BUILDING')"))
    c = store.content(df, ["name", "segment"])
    return c.select("eid", *(F.col("content").getItem(k).cast("string").alias(k) for k in ("name", "segment")))


# -- storage -----------------------------------------------------------------------------------
@query(f"WITH {_N} SELECT eid, name, region FROM n")
def store_snapshot(spark, d):
    path = _folder(spark, "snapshot")
    store.snapshot(_nations(spark, d), path, ["region"])
    return store.open_table(spark, path).select("eid", "name", F.col("region").cast("bigint").alias("region"))


@query(f"WITH {_C} SELECT eid, name, nation FROM c")
def store_compact(spark, d):
    path = _folder(spark, "compact")
    store.compact(_customers(spark, d), path, 2, "nation")
    return store.open_table(spark, path).select("eid", "name", "nation")


@query("SELECT sha256(n_name) AS sha256, n_name AS text FROM nation UNION ALL SELECT sha256('nobody'), NULL")
def blob_get(spark, d):
    blobs = store.BlobStore(spark, _folder(spark, "blobs"))
    names = _nations(spark, d).select("name")
    blobs.put(names.limit(7), "name")
    ids = blobs.put(names, "name").union(spark.range(1).select(fn.blob_id(F.lit("nobody"))))
    return blobs.get(ids).select("sha256", F.col("data").cast("string").alias("text"))


@query("SELECT sha256(s) AS sha256, s IN (SELECT n_name FROM nation WHERE n_regionkey = 1) AS found FROM (SELECT n_name AS s FROM nation UNION ALL SELECT '')")
def blob_exists(spark, d):
    blobs = store.BlobStore(spark, _folder(spark, "blobs"))
    n = _nations(spark, d)
    blobs.put(n.where("region = 1"), "name")
    return blobs.exists(n.select(fn.blob_id(F.col("name")).alias("sha256")).union(spark.range(1).select(fn.blob_id(F.lit("")))))


@query(f"WITH {_O} SELECT DISTINCT status AS part, CASE status WHEN 'F' THEN 'changed' ELSE 'removed' END AS change FROM o WHERE status IN ('F', 'P') UNION ALL SELECT 'new', 'added'")
def seal_diff(spark, d):
    o = _orders(spark, d)
    now = o.where("status <> 'P'").withColumn("priority", F.when(F.col("status") == "F", F.lit("x")).otherwise(F.col("priority")))
    now = now.union(spark.createDataFrame([(0, 0, 0, "new", None, None)], now.schema))
    return store.seal_diff(store.seal(o, "status"), store.seal(now, "status"))


@query("SELECT vec_id::BIGINT AS eid, len(embedding)::INT AS numbers FROM embeddings")
def vectors_checked(spark, d):
    return store.check_dim(_vectors(spark, d), "embedding", 64).select("eid", F.size("embedding").alias("numbers"))


@query(f"WITH {_C} SELECT eid, id, name, nation, segment FROM c")
def wire_round_trip(spark, d):
    c = _customers(spark, d)
    return store.from_wire(store.to_wire(c), "eid bigint, id bigint, name string, nation bigint, segment string")


@query(f"WITH {_OPS} SELECT lsn, eid, value FROM ops WHERE attribute = 'click' AND (wall, logical, peer) > (1704800000000000, 0, 0)")
def relay_rooms(spark, d):
    """Two rooms of one relay, the first published twice; one is pulled after a cursor."""
    path, ops = _folder(spark, "relay"), _ops(spark, d)
    clicks = ops.where("attribute = 'click'")
    store.publish(clicks, path, "a")
    store.publish(clicks.where("eid < 50"), path, "a")
    store.publish(ops.where("attribute <> 'click'"), path, "b")
    return store.pull(spark, path, "a", oplog.clock() > fn.hlc(F.lit(1704800000000000), F.lit(0), F.lit(0))).select("lsn", "eid", "value")


@query(f"WITH {_OPS} SELECT lsn, eid FROM ops WHERE (wall, logical, peer) > (1705000000000000, 0, 0)")
def transport_rooms(spark, d):
    rooms, ops = oplog.Rooms(), _ops(spark, d)
    rooms.publish(ops)
    rooms.publish(ops.where("eid < 30"))
    rooms.publish(ops.limit(0), "other")
    return rooms.pull(cursor=(1705000000000000, 0, 0)).select("lsn", "eid")


# -- catalog and changes --------------------------------------------------------------------------
def _people(spark, d) -> Catalog:
    cat = Catalog(spark)
    cat.declare(TableBuilder("nation").tag("name").number("region").primary_key("name"), _nations(spark, d))
    cat.declare(TableBuilder("customer").number("id").tag("name").ref_to("nation", "nation").leaf("segment").primary_key("id"), _customers(spark, d))
    return cat


@query("""SELECT * FROM (VALUES ('customer', 'id', 'number', NULL, true), ('customer', 'name', 'tag', NULL, false), ('customer', 'nation', 'ref', 'nation', false),
    ('customer', 'segment', 'leaf', NULL, false), ('nation', 'name', 'tag', NULL, true), ('nation', 'region', 'number', NULL, false)) AS t("table", "column", type, target, key)""")
def catalog_describe(spark, d):
    return _people(spark, d).describe()


@query("SELECT 'customer' AS \"table\", min(c_custkey)::BIGINT AS first, max(c_custkey)::BIGINT AS last, count(*) AS rows FROM customer UNION ALL SELECT 'nation', min(n_nationkey), max(n_nationkey), count(*) FROM nation")
def catalog_ranges(spark, d):
    return _people(spark, d).ranges()


@query("SELECT 'nation' AS target, 'nation' AS name")
def catalog_references(spark, d):
    return spark.createDataFrame([(n, t) for n, t in _people(spark, d).references("customer").items()], "name string, target string")


@query(f"WITH {_C} SELECT eid, name FROM c WHERE nation = 4 UNION ALL SELECT (SELECT max(eid) FROM c) + 1, 'new'")
def catalog_reopen(spark, d):
    """Saved, opened again, changed: declarations and rows are those that were saved."""
    path, cat = _folder(spark, "catalog"), _people(spark, d)
    cat.save(path)
    t = Catalog.open(spark, path).table("customer")
    t.insert({"id": 10**8, "name": "new", "nation": 4})
    return t.query().where_ref("nation", 4).find().select("eid", "name")


@query("SELECT unnest(['declare', 'insert', 'update', 'delete', 'add_column']) AS change, true AS refused")
def catalog_replica(spark, d):
    """What a replica refuses."""
    path = _folder(spark, "catalog")
    _people(spark, d).save(path)
    cat = Catalog.open(spark, path, read_only=True)
    t, out = cat.table("customer"), []
    for name, change in {"declare": lambda: cat.declare(TableBuilder("x").number("n")), "insert": lambda: t.insert({"id": 1}), "update": lambda: t.update(1, {"name": "x"}), "delete": lambda: t.delete(1), "add_column": lambda: cat.add_column("customer", ColumnSpec("n", NUMBER))}.items():
        try:
            change()
            out.append((name, False))
        except Unsupported:
            out.append((name, True))
    return spark.createDataFrame(out, "change string, refused boolean")


@query(f"WITH {_N} SELECT eid, name, region, NULL::BIGINT AS size, NULL AS note FROM n WHERE region = 2")
def catalog_migrate(spark, d):
    cat = _people(spark, d)
    cat.declare(TableBuilder("nation").tag("name").number("region").number("size").leaf("note").primary_key("name"))
    return cat.table("nation").query().where_eq("region", 2).find()


@query(f"WITH {_N} SELECT eid, name, CASE WHEN name = 'NEW' OR eid = 3 THEN 9 ELSE region END AS region FROM (SELECT * FROM n UNION ALL SELECT (SELECT max(eid) FROM n) + 1, 'NEW', 9)")
def catalog_upsert(spark, d):
    cat = _people(spark, d)
    t = cat.table("nation")
    third = t.get(3).first()["name"]
    t.upsert({"name": third, "region": 9})
    t.upsert({"name": "NEW", "region": 8})
    t.upsert({"name": "NEW", "region": 9})
    return t.all()


@query(f"WITH {_N} SELECT eid, name, CASE WHEN eid = 2 THEN 7 ELSE region END AS region FROM n WHERE eid <> 4")
def catalog_update_delete(spark, d):
    t = _people(spark, d).table("nation")
    t.update(2, {"region": 7})
    t.delete(4)
    return t.df.select("eid", "name", "region")


@query("SELECT r AS eid, 'n' || r AS name, r % 3 AS region FROM range(40) AS x(r)")
def catalog_insert(spark, d):
    """Forty changes: the table is written on the way, ids count on."""
    t = Catalog(spark).declare(TableBuilder("t").tag("name").number("region"))
    for i in range(40):
        t.insert({"name": f"n{i}", "region": i % 3})
    return t.df


@query("SELECT 'number' AS attribute, sum(c_custkey)::BIGINT AS total FROM customer")
def numbers_checked(spark, d):
    return _customers(spark, d).select(checked_number(F.col("id")).alias("id")).agg(F.lit("number").alias("attribute"), F.sum("id").alias("total"))


@query(f"WITH {_C} SELECT eid, CASE WHEN nation = 6 THEN date_diff('day', DATE '2000-01-01', DATE '2024-02-29') ELSE id END::BIGINT AS day FROM c")
def tie_date(spark, d):
    c = _customers(spark, d)
    return dml.tie_date(c, F.col("nation") == 6, "id", "2024-02-29").select("eid", F.col("id").alias("day"))


@query(f"WITH {_C} SELECT eid, DATE '2000-01-01' + id::INT AS id FROM c")
def get_date(spark, d):
    return dml.get_date(_customers(spark, d), "id")


@query(f"WITH {_C} SELECT eid, CASE WHEN nation = 2 THEN '00ff' ELSE lower(hex(name)) END AS name FROM c")
def tie_bytes(spark, d):
    c = _customers(spark, d).withColumn("name", F.col("name").cast("binary"))
    return dml.tie_bytes(c, F.col("nation") == 2, "name", b"\x00\xff").select("eid", F.lower(F.hex("name")).alias("name"))


@query(f"WITH {_C} SELECT eid, CASE WHEN segment = 'BUILDING' THEN 11 ELSE nation END AS nation, true AS refused FROM c")
def tie_ref(spark, d):
    c, n, refused = _customers(spark, d), _nations(spark, d), False
    try:
        dml.tie_ref(c, F.lit(True), "nation", 99, n)
    except BadValue:
        refused = True
    return dml.tie_ref(c, F.col("segment") == "BUILDING", "nation", 11, n).select("eid", "nation", F.lit(refused).alias("refused"))


@query(f"WITH {_C} SELECT eid, name FROM c WHERE nation = 12")
def builder_ref(spark, d):
    return _people(spark, d).table("customer").query().where_ref("nation", 12).find().select("eid", "name")


@query(f"WITH {_C} SELECT eid, nation FROM c WHERE id <= 500 AND segment IS NOT NULL ORDER BY eid LIMIT 1")
def builder_find_one(spark, d):
    t = Catalog(spark).register("c", _customers(spark, d), "id")
    return t.query().where_le("id", 500).find_one().select("eid", "nation")


@query(f"WITH {_C} SELECT name FROM c WHERE nation = 1")
def scope_tables(spark, d):
    cat = Catalog(spark)
    cat.scope("a").declare(TableBuilder("c").number("id").tag("name").number("nation").tag("segment"), _customers(spark, d))
    cat.scope("b").declare(TableBuilder("c").number("id"))
    assert cat.scope("a").list_tables() == ["c"]
    return cat.scope("a").table("c").query().where_eq("nation", 1).find().select("name")


@query("SELECT * FROM (VALUES (1, 'a', 5), (2, 'b', NULL), (3, NULL, 7)) AS t(id, name, n)")
def sql_create_insert(spark, d):
    db = Database(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, n INTEGER); CREATE TABLE IF NOT EXISTS t (id INTEGER); INSERT INTO t VALUES (1, 'a', 5), (2, 'b', NULL); INSERT INTO t (id, n) VALUES (3, 7)")
    return db.execute("SELECT * FROM t").select(F.col("id").cast("int").alias("id"), "name", F.col("n").cast("int").alias("n"))


@query(f"WITH {_O} SELECT id, status FROM o WHERE customer < 400 AND id <> 5 UNION ALL SELECT 100000001, NULL")
def sql_reopen(spark, d):
    """A database that is saved, opened again and changed."""
    path, db = _folder(spark, "database"), Database(spark)
    db.register("orders", _orders(spark, d).drop("eid", "day"), "id")
    db.save(path)
    again = Database.open(spark, path)
    return again.execute("DELETE FROM orders WHERE id = 5; INSERT OR REPLACE INTO orders (id, customer) VALUES (100000001, 1); SELECT id, status FROM orders WHERE customer < 400")


# -- graph pipes -------------------------------------------------------------------------------------
_T = "t AS (SELECT c_custkey::BIGINT AS eid, CASE WHEN c_custkey > 2 THEN c_custkey::BIGINT // 3 END AS parent FROM customer)"


@query(f"WITH {_T} SELECT eid FROM t WHERE parent = 9")
def graph_filter(spark, d):
    return graph_pipe(_tree(spark, d), "id:9 | reverse parent | where parent:9")


@query(f"WITH {_T} SELECT eid, eid AS id, parent, NULL::BIGINT AS nothing FROM t WHERE parent IN (1, 2) OR eid = 1 AND false")
def graph_select(spark, d):
    return graph_pipe(_tree(spark, d), "id:1..2 | reverse parent | select id parent nothing")


@query(f"WITH {_T} SELECT parent AS value FROM t WHERE eid <= 40 AND parent IS NOT NULL")
def graph_extract(spark, d):
    return graph_pipe(_tree(spark, d), "id:0..40 | extract parent")


# -- text index ----------------------------------------------------------------------------------------
@query("SELECT doc_id AS eid FROM documents WHERE contains(text, 'tion')")
def text_index_reopen(spark, d):
    docs, path = _documents(spark, d), _folder(spark, "grams")
    textsearch.save(textsearch.index(docs), path)
    return textsearch.search(docs, "tion", postings=textsearch.load(spark, path))


@query("SELECT doc_id AS eid FROM documents WHERE contains(text, 'th') AND lang <> 'de'")
def text_remove(spark, d):
    docs = _documents(spark, d)
    return textsearch.search_postings(textsearch.remove(textsearch.index(docs), docs.where("lang = 'de'")), "th")


@query("WITH g AS (SELECT DISTINCT substr(text, i, 2) AS gram FROM documents, unnest(range(1, length(text))) AS x(i)) SELECT count(*) AS grams FROM g")
def text_gram_count(spark, d):
    return textsearch.gram_count(textsearch.index(_documents(spark, d)))


@query("SELECT DISTINCT substr(text, i, 3) AS gram FROM documents, unnest(range(1, length(text) - 1)) AS x(i) WHERE doc_id = 3")
def text_entry(spark, d):
    return textsearch.entry(textsearch.index(_documents(spark, d), n=3), 3)


@query("SELECT DISTINCT substr(t, i, 2) AS gram FROM (SELECT 'changed text' AS t), unnest(range(1, length(t))) AS x(i)")
def text_readd(spark, d):
    post = textsearch.index(_documents(spark, d))
    return textsearch.entry(textsearch.add(post, spark.createDataFrame([(7, "changed text")], "eid bigint, text string")), 7)


@query("SELECT doc_id AS eid FROM documents WHERE length(text) % 5 = 2")
def text_scan_closure(spark, d):
    return textsearch.scan(_documents(spark, d), lambda t: len(t) % 5 == 2)


# -- retrieval -------------------------------------------------------------------------------------------
def _chunks(spark, d) -> DataFrame:
    """A chunk for each vector, with the text of the document of the same number."""
    v = _vectors(spark, d).select("eid", "embedding", F.col("label").alias("label"))
    return v.join(_documents(spark, d).select("eid", "text", "lang"), "eid")


_CH = "ch AS (SELECT vec_id::BIGINT AS eid, embedding, label::BIGINT AS label, text, lang FROM embeddings JOIN documents ON doc_id = vec_id)"


def _store(spark, d) -> VectorStore:
    return StoreBuilder().dim(64).metric("l2").meta_value("label").meta_symbol("lang").build(spark).insert(_chunks(spark, d))


_L2 = f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {_QL}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query(f"WITH {_CH} SELECT eid, round({_L2}, 6) AS score FROM ch WHERE lang IN ('en', 'fr') AND label = 2 ORDER BY 2, 1 LIMIT 7")
def rag_store_search(spark, d):
    return _store(spark, d).search(_QV, 7, In("lang", ("en", "fr")) & Eq("label", 2))


@query(f"""WITH {_CH}, s AS (SELECT eid, embedding, label, lang FROM ch WHERE eid % 11 <> 0 AND eid % 5 <> 0
      UNION ALL SELECT eid, embedding, NULL, 'xx' FROM ch WHERE eid % 5 = 0)
    SELECT eid, label, lang, round({_L2}, 6) AS score FROM s""")
def rag_store_changes(spark, d):
    """Chunks deleted, others replaced as a whole: fields not given go."""
    ch = _chunks(spark, d)
    s = _store(spark, d).delete(ch.where("eid % 11 = 0"))
    s = s.upsert(ch.where("eid % 5 = 0").select("eid", "text", "embedding", F.lit("xx").alias("lang"))).settled()
    return s.df.select("eid", "label", "lang", F.round(fn.l2(F.col("embedding"), F.array(*(F.lit(x) for x in _QV))), 6).alias("score"))


@query(f"WITH {_CH} SELECT r AS eid, text, lang, label, len(embedding)::INT AS numbers FROM range(0, 2000, 13) AS x(r) LEFT JOIN ch ON eid = r")
def rag_accessors(spark, d):
    s, ids = _store(spark, d), spark.range(0, 2000, 13).withColumnRenamed("id", "eid")
    out = s.texts(ids).join(s.meta(ids, "lang"), "eid").join(s.meta(ids, "label"), "eid").join(s.vectors(ids), "eid")
    return out.select("eid", "text", "lang", "label", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("numbers"))


@query(f"WITH {_CH} SELECT count(*) AS count FROM ch")
def rag_store_reopen(spark, d):
    path, s = _folder(spark, "vectors"), _store(spark, d)
    s.save(path)
    return VectorStore.open(spark, path, s.spec).count()


_WORDS = _BM25.split("s AS (SELECT eid, len(t) AS dl")[0].strip().rstrip(",")


@query(f"WITH {_WORDS}, x AS (SELECT eid, len(t)::INT AS dl, unnest(t) AS term FROM t) SELECT term, count(*) AS tf, count(DISTINCT eid) AS docs, sum(dl)::BIGINT AS dl FROM x GROUP BY 1")
def bm25_index(spark, d):
    t = rag.bm25_terms(_documents(spark, d))
    return t.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("docs"), F.sum(F.col("dl") * F.col("tf")).alias("dl"))


@query(f"WITH {_BM25} SELECT * FROM bm")
def bm25_from_index(spark, d):
    """Scores from postings that are built and written once."""
    return rag.bm25_postings(store.cut(rag.bm25_terms(_documents(spark, d)), "postings"), "Idiot thing, idiot")


@query("SELECT doc_id AS eid, list_transform([length(text), 1, ord(lang[1])], lambda x: x::FLOAT) AS embedding FROM documents")
def rag_embed_hook(spark, d):
    docs = _documents(spark, d).withColumn("text", F.concat_ws("|", "lang", "text"))
    return rag.embed(docs, 3, embedder=lambda t: [float(len(t) - 3), 1.0, float(ord(t[0]))])


@query("SELECT doc_id AS eid, (generate_subscripts(s, 1) - 1)::INT AS position, unnest(s) AS chunk FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents)")
def rag_chunk_hook(spark, d):
    return rag.chunk(_documents(spark, d), 0, splitter=lambda t: t.split(". ")).select("eid", "position", "chunk")


@query(f"WITH {_BM25}, top AS (SELECT eid, score FROM bm ORDER BY score DESC, eid LIMIT 20) SELECT eid, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS rerank FROM top JOIN documents ON doc_id = eid")
def rag_rerank_hook(spark, d):
    docs = _documents(spark, d)
    top = rag.bm25(docs, "Idiot thing, idiot").orderBy(F.col("score").desc(), "eid").limit(20)
    return rag.rerank(top.join(docs.select("eid", "text"), "eid"), lambda t: t.count("e")).select("eid", "rerank")


@query("SELECT vec_id::BIGINT AS eid, round(list_dot_product(e, e), 9) AS length FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)")
def vector_normalize(spark, d):
    v = fn.normalize(F.col("embedding"))
    return _vectors(spark, d).select("eid", v.alias("v")).select("eid", F.round(fn.dot(F.col("v"), F.col("v")), 9).alias("length"))


@query("SELECT n_name AS name, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(n_name) + 1), lambda i: ascii(n_name[i])::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS hash FROM nation")
def fnv_hash(spark, d):
    return _nations(spark, d).select("name", fn.fnv1a_32_col(F.col("name")).alias("hash"))


@query(f"""WITH {_OPS} SELECT lsn, greatest(wall, 1705000000000000, 1704900000000000) AS wall,
    CASE WHEN wall > 1705000000000000 THEN logical + 1 WHEN wall = 1705000000000000 THEN greatest(logical, 7) + 1 ELSE 8 END AS logical, peer FROM ops""")
def hlc_receive(spark, d):
    got = fn.hlc_receive_col(oplog.clock(), fn.hlc(F.lit(1705000000000000), F.lit(7), F.lit(9)), F.lit(1704900000000000))
    return _ops(spark, d).select("lsn", got.alias("c")).select("lsn", "c.*")


# -- change log --------------------------------------------------------------------------------------------
_DONE = "done AS (SELECT * FROM ops WHERE lsn <= (SELECT max(lsn) FROM ops) // 2)"


def _with_commit(spark, d) -> DataFrame:
    """The log with a commit that closes its first half."""
    ops = _ops(spark, d)
    half = ops.agg(F.expr("max(lsn) div 2").alias("lsn"))
    commit = half.selectExpr("lsn", "0L as wall", "0L as logical", "0L as peer", "'w0' as author", "cast(null as bigint) as eid", "cast(null as string) as attribute", "'commit' as kind", "cast(null as string) as value")
    return ops.union(commit.select(ops.columns))


@query(f"WITH {_OPS}, {_DONE} SELECT lsn, kind FROM done")
def oplog_committed(spark, d):
    return oplog.committed(_with_commit(spark, d)).select("lsn", "kind")


@query(f"""WITH {_OPS}, {_DONE}, e AS (SELECT DISTINCT user_id::BIGINT AS eid FROM events WHERE user_id % 2 = 0),
    dead AS (SELECT eid, max((wall, logical, peer)) AS d FROM done WHERE kind = 'delete' GROUP BY 1),
    won AS (SELECT *, row_number() OVER (PARTITION BY eid, attribute ORDER BY wall DESC, logical DESC, peer DESC) AS k FROM done WHERE kind <> 'delete'),
    said AS (SELECT won.eid, attribute, kind, value, d IS NULL OR (wall, logical, peer) > d AS late FROM won LEFT JOIN dead USING (eid) WHERE k = 1 AND attribute IN ('click', 'view')),
    ids AS (SELECT eid FROM e UNION SELECT eid FROM said UNION SELECT eid FROM won),
    r AS (SELECT ids.eid, ids.eid IN (SELECT eid FROM dead) AS gone, ids.eid IN (SELECT eid FROM e) AS had,
      max(CASE WHEN attribute = 'click' AND late AND kind = 'tie' THEN value END) AS click, bool_or(attribute = 'click') AS c,
      max(CASE WHEN attribute = 'view' AND late AND kind = 'tie' THEN value END) AS view, bool_or(attribute = 'view') AS v
      FROM ids LEFT JOIN said ON said.eid = ids.eid GROUP BY ids.eid),
    o AS (SELECT eid, gone, CASE WHEN coalesce(c, false) THEN click WHEN had AND NOT gone THEN 'old' END AS click, CASE WHEN coalesce(v, false) THEN view WHEN had AND NOT gone THEN 'old' END AS view FROM r)
    SELECT eid, click, view FROM o WHERE NOT gone OR click IS NOT NULL OR view IS NOT NULL""")
def log_replay(spark, d):
    base = _ops(spark, d).where("eid % 2 = 0").select("eid").distinct().selectExpr("eid", "'old' as click", "'old' as view")
    return oplog.replay(base, _with_commit(spark, d))


@query(f"WITH {_OPS} SELECT eid, max(wall) AS wall FROM ops WHERE kind = 'delete' GROUP BY 1")
def oplog_tombstones(spark, d):
    return oplog.tombstones(_ops(spark, d)).select("eid", F.col("clock.wall").alias("wall"))


@query(f"WITH {_OPS} SELECT lsn FROM ops WHERE author IN ('w1', 'w3')")
def oplog_members(spark, d):
    return oplog.allowed(_ops(spark, d), spark.createDataFrame([("w1",), ("w3",), ("w9",)], "author string")).select("lsn")


@query(f"WITH {_OPS} SELECT lsn FROM ops WHERE author = 'w1' OR author = 'w2' AND attribute IN ('click', 'view') AND kind <> 'delete'")
def oplog_grants(spark, d):
    grants = spark.createDataFrame([("w1", None), ("w2", "click"), ("w2", "view"), ("w1", "click")], "author string, attribute string")
    return oplog.granted(_ops(spark, d), grants).select("lsn")


@query(f"WITH {_OPS} SELECT lsn FROM ops WHERE (wall, logical, peer) > (1705500000000000, 0, 1)")
def oplog_after(spark, d):
    return oplog.after(_ops(spark, d), (1705500000000000, 0, 1)).select("lsn")


@query(f"WITH {_OPS}, f AS (SELECT min((wall, logical, peer)) AS c FROM ops WHERE author = 'w4' AND attribute = 'purchase') SELECT max((wall, logical, peer))[1] AS wall, max((wall, logical, peer))[2] AS logical FROM ops, f WHERE (wall, logical, peer) < f.c")
def oplog_next_cursor(spark, d):
    ops = _ops(spark, d)
    return oplog.next_cursor(ops, ops.where("author = 'w4' and attribute = 'purchase'")).select("cursor.wall", "cursor.logical")


@query(f"WITH {_OPS} SELECT lsn, author FROM ops")
def oplog_deduplicated(spark, d):
    ops = _ops(spark, d)
    return oplog.deduplicated(ops.union(ops.where("eid < 60"))).select("lsn", "author")


@query("SELECT * FROM (VALUES (1, 70), (2, 40), (3, 5)) AS t(peer, lsn)")
def oplog_ack(spark, d):
    peers = spark.createDataFrame([(1, 50), (2, 40)], "peer int, lsn int")
    return oplog.ack(peers, spark.createDataFrame([(1, 70), (2, 10), (3, 5), (1, 60)], "peer int, lsn int"))


@query(f"WITH {_OPS}, w AS (SELECT min(m) AS m FROM (SELECT max(lsn) AS m FROM ops GROUP BY peer)) SELECT lsn FROM ops, w WHERE lsn > m - 100")
def oplog_pending(spark, d):
    ops = _ops(spark, d)
    at = oplog.watermark(ops.groupBy("peer").agg(F.max("lsn").alias("lsn"))).first()["watermark"]
    return oplog.pending(ops, at - 100).select("lsn")


@query(f"""WITH {_OPS}, m AS (SELECT * FROM ops WHERE author <> 'w4'),
    a AS (SELECT count(DISTINCT eid) AS n FROM m WHERE kind = 'delete' UNION ALL SELECT count(DISTINCT (eid, attribute)) FROM m WHERE kind <> 'delete')
    SELECT (SELECT count(*) FROM ops) + (SELECT count(*) FROM ops WHERE eid < 20) AS received, (SELECT count(*) FROM ops WHERE author = 'w4') + (SELECT count(*) FROM ops WHERE author = 'w4' AND eid < 20) AS rejected,
      (SELECT count(*) FROM m WHERE eid < 20) AS repeated, (SELECT sum(n) FROM a)::BIGINT AS applied, (SELECT count(*) FROM m) - (SELECT sum(n) FROM a)::BIGINT AS skipped""")
def oplog_apply_counts(spark, d):
    ops = _ops(spark, d)
    return oplog.apply_counts(ops.union(ops.where("eid < 20")), spark.createDataFrame([(f"w{i}",) for i in range(4)], "author string"))


@query(f"WITH {_OPS} SELECT lsn, eid, value FROM ops WHERE attribute = 'view'")
def oplog_listen(spark, d):
    """A listener that writes what it is handed."""
    path, out = _folder(spark, "relay"), _folder(spark, "heard")
    ops = _ops(spark, d)
    store.publish(ops.where("attribute = 'view'"), path)
    q = oplog.listen(store.stream(spark, path, oplog.OPS + ", room string", "default"), lambda df, n: df.write.mode("append").parquet(out), _folder(spark, "listener"))
    q.awaitTermination()
    return spark.read.schema(oplog.OPS).parquet(out).select("lsn", "eid", "value")


#: Types that the fixtures above declare, for users who build tables from rows.
__all__ = ["LEAF", "NUMBER", "ORACLE", "QUERIES", "TAG"]
