"""Hand-computed cases: nulls, ties, zero sums, empty inputs, refusals."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import aggregates as agg, dml, graph, rag, scans, textsearch
from millrace.operators.predicates import And, Eq, Not, Or, Range
from millrace.plans.catalog import Catalog
from millrace.plans.pipes import graph_pipe, pipe
from millrace.plans.sql import Database
from millrace.sources import store
from millrace.streaming import oplog
from millrace.types import BadValue, DuplicateKey, EngineError, SchemaConflict, TableBuilder, Unsupported


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, 20 + i, i % 3, 100 + 10 * i, "A" if i < 5 else "B") for i in range(10)], "eid bigint, age bigint, dept bigint, salary bigint, city string").cache()


def test_pipes(people):
    assert rows(pipe(people, 'age:20..24 city:"A" | sum salary')) == [(600,)]
    assert rows(pipe(people, "age:20..29 | group dept")) == [(0, 4), (1, 3), (2, 3)]
    assert rows(pipe(people, "age:20..29 | group dept | avg salary")) == [(0, 145), (1, 140), (2, 150)]
    assert rows(pipe(people, "age:99 | min age")) == [(None,)]
    for bad in ("", "| count", "age:5..1", "age:x", "age:20 | nope", "age:20 | count | count", "age:20 | group dept | nope x"):
        with pytest.raises(BadValue):
            pipe(people, bad)
    with pytest.raises(BadValue):
        pipe(people, 'city:"nowhere" | count', strict=True)
    assert rows(pipe(people, "- 3").select("eid"))[3] == (4,)
    assert rows(pipe(people, '~ 4 age:77').where("eid = 4").select("age")) == [(77,)]
    assert pipe(people, "+ age:1").count() == 11


def test_scans_and_filters(people):
    assert scans.query(people, []).count() == 0
    assert scans.pull(people, "unknown", 1).count() == 0
    assert rows(scans.range_scan(people, "age", 5, 4)) == []
    gaps = people.withColumn("dept", F.expr("nullif(dept, 0)"))
    assert gaps.where(Not(Eq("dept", 1)).column()).count() == 7
    assert gaps.where(And(()).column()).count() == 10 and gaps.where(Or(()).column()).count() == 0
    assert gaps.where((Eq("dept", 1) | Range("age", 20, 20)).column()).count() == 4


def test_aggregates_keep_zero_sums_and_skip_missing(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 5), (3, 7)], "k bigint, x bigint")
    assert rows(agg.group_sum(df, "k", "x")) == [(1, 0), (3, 7)]
    assert rows(agg.sum_(df.limit(0), "x")) == [(0,)] and rows(agg.avg(df.limit(0), "x")) == [(None,)]
    assert rows(agg.histogram(df, "x", 0, 9, 5)) == [(0, 2), (1, 0), (2, 1), (3, 1), (4, 0)]
    assert rows(agg.histogram(df, "x", 5, 4, 5)) == []


def test_catalog(spark):
    cat = Catalog(spark)
    a = cat.declare(TableBuilder("author").number("id").primary_key("id"))
    a.insert({"id": 1}, {"id": 2})
    p = cat.declare(TableBuilder("post").ref_to("by", "author").number("v"))
    p.insert({"by": 0, "v": 5}, {"by": 1, "v": 6}, {"by": 0, "v": 7})
    assert rows(p.query().where_ref("by", 0).sum("v")) == [(12,)]
    assert rows(p.query().where_in("v", [5, 6]).where_gt("v", 5).count()) == [(1,)]
    with pytest.raises(BadValue):
        p.query().where_in("v", [1]).where_in("v", [2])
    with pytest.raises(BadValue):
        p.insert({"v": None})
    a.upsert({"id": 2})
    assert a.df.count() == 2
    with pytest.raises(SchemaConflict):
        cat.declare(TableBuilder("author").tag("id"))
    s = cat.scope("t")
    s.declare(TableBuilder("x").number("n"))
    assert s.list_tables() == ["x"] and "t.x" in cat.list_tables()


def test_sql(spark):
    db = Database(spark)
    db.execute("CREATE TABLE n (key TEXT PRIMARY KEY, at INTEGER, body LEAF); INSERT INTO n VALUES ('a', 3, 'x'), ('b', NULL, 'y'), ('c', 1, NULL)")
    assert [r[0] for r in db.execute("SELECT key FROM n ORDER BY at").collect()] == ["c", "a", "b"]
    assert [r[0] for r in db.execute("SELECT key FROM n ORDER BY at DESC LIMIT 2").collect()] == ["b", "a"]
    with pytest.raises(DuplicateKey):
        db.execute("INSERT INTO n (key) VALUES ('z'), ('a')")
    assert db.execute("SELECT * FROM n").count() == 3
    db.execute("INSERT OR REPLACE INTO n (key, at) VALUES ('a', 9), ('d', 4)")
    assert rows(db.execute("SELECT key, at, body FROM n WHERE at >= 4")) == [("a", 9, "x"), ("d", 4, None)]
    assert db.execute("SELECT * FROM n WHERE body = 'x'").count() == 0
    assert db.execute("SELECT * FROM n WHERE at = NULL").count() == 0
    assert db.execute("SELECT * FROM n WHERE at > 'text'").count() == 0
    db.execute("UPDATE n SET at = NULL; DELETE FROM n WHERE key = 'd'")
    assert rows(db.execute("SELECT at FROM n WHERE at IS NOT NULL")) == [(1,), (9,)]
    for bad in ("SELECT key AS k FROM n", "SELECT * FROM n JOIN n", "SELECT * FROM n WHERE at = 1 OR at = 2", "SELECT count(*) FROM n", "DROP TABLE n", "SELECT * FROM n GROUP BY at"):
        with pytest.raises(Unsupported):
            db.execute(bad)
    with pytest.raises(BadValue):
        db.execute("SELECT * FROM n WHERE at = 4294967295")


def test_graph(spark):
    t = spark.createDataFrame([(0, 1, None), (1, 2, 0), (2, 3, 0), (3, 4, 1), (4, 5, 3)], "eid bigint, type bigint, parent bigint")
    assert rows(graph.bfs(t.where("eid = 0"), t, "parent", 5)) == [(0, 0), (1, 1), (1, 2), (2, 3), (3, 4)]
    assert rows(graph.path(t.select("eid"), [(t, "parent"), (t, "parent")])) == [(0, None), (1, None), (2, None), (3, 0), (4, 1)]
    assert rows(graph_pipe(t, "type:5 | follow parent parent")) == [(1,)]
    assert rows(graph_pipe(t, "type:1 | bfs parent 9 | count")) == [(5,)]
    assert graph.dangling(t, "parent", t.where("eid <> 0")).count() == 2


def test_text_and_retrieval(spark):
    t = spark.createDataFrame([(1, "the quick brown fox"), (2, "lazy dogs"), (3, "fox and dog, dog"), (4, "")], "eid bigint, text string")
    post = textsearch.index(t)
    assert rows(textsearch.search(t, "fox", postings=post)) == [(1,), (3,)] and rows(textsearch.search(t, "")) == []
    with pytest.raises(Unsupported):
        textsearch.search_postings(post, "fox")
    assert [r.eid for r in rag.bm25(t, "fox dog").orderBy(F.col("score").desc()).collect()] == [3, 1]
    assert rag.split_text("aaaa bbbb cccc", 9) == ["aaaa bbbb", "cccc"]
    rng = random.Random(1)
    text = "".join(rng.choice("ab c.\n") for _ in range(500))
    assert all(len(c) <= 40 for c in rag.split_text(text, 40)) and rag.split_text("x" * 10, 4) == ["xxxx", "xxxx", "xx"]
    assert rag.split_text("aaaa bbbb cccc", 9, 2)[-1].endswith("cccc")  # every level puts its overlap in front
    assert abs(sum(x * x for x in rag.hash_vector("a b", 16)) - 1) < 1e-5
    assert fn.fnv1a_32(b"a") == 0xE40C292C and fn.hlc_receive((5, 1, 7), (5, 4, 8), 3) == (5, 5, 7)


def test_merge_against_a_model(spark):
    rng = random.Random(3)
    ops = []
    for n in range(300):
        kind = rng.choice(["tie", "tie", "tie", "untie", "delete"])
        ops.append((n, rng.randrange(60), n, rng.randrange(3), "w", rng.randrange(6), rng.choice("ab"), kind, str(n)))
    want, dead = {}, {}
    for o in sorted(ops, key=lambda o: o[1:4]):
        if o[7] == "delete":
            dead[o[5]] = o[1:4]
        else:
            want[o[5], o[6]] = (o[1:4], o[7], o[8])
    live = sorted((e, a, v) for (e, a), (at, kind, v) in want.items() if kind == "tie" and at > dead.get(e, (-1,)))
    rng.shuffle(ops)
    df = spark.createDataFrame(ops, oplog.OPS)
    assert rows(oplog.merge(df)) == live == rows(oplog.merge(df.repartition(7)))


def test_storage(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "eid bigint, x string")
    assert store.put_blobs(df, "x").count() == 1
    store.snapshot(df, str(tmp_path / "s"))
    assert store.seal(store.open_table(spark, str(tmp_path / "s"))).first() == store.seal(df).first()
    assert rows(dml.insert(df, df.limit(0), "eid")) is not None


D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from pathlib import Path

    if not Path(D).exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def _names():
    from millrace import registry, registry_state

    some = ("pipe_group_sum", "scan_and", "histogram", "graph_follow", "lww_merge", "bm25", "rrf_hybrid", "sql_or_replace", "sql_nulls_desc", "seal_rows", "vector_topk_l2")
    return [*some, *registry_state.ORACLE]


@pytest.mark.parametrize("name", _names())
def test_oracle(spark, duck, name):
    from millrace import registry, registry_state

    got = {**registry.QUERIES, **registry_state.QUERIES}[name](spark, D)
    cols = sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = duck.sql(f"select {quoted} from ({ {**registry.ORACLE, **registry_state.ORACLE}[name] })").fetchall()
    assert sorted(str(tuple(map(plain, r))) for r in got.select(*cols).collect()) == sorted(str(tuple(map(plain, r))) for r in want)


def brute_split(text, most, overlap, separators):
    """Parts are packed one by one, the next as long as it fits."""
    if len(text) <= most:
        return [text]
    separators = [s for s in separators if s]
    if not separators:
        return [text[i : i + most] for i in range(0, len(text), most)]
    sep, out, now = separators[0], [], None
    for part in text.split(sep):
        for p in brute_split(part, most, overlap, separators[1:]):
            if now and len(now) + len(sep) + len(p) <= most:
                now += sep + p
            else:
                out += [now] if now else []
                if len(p) <= most:
                    now = p
                else:
                    out += [p[i : i + most] for i in range(0, len(p), most)]
                    now = None
    out += [now] if now else []
    return [(out[i - 1][-overlap:] if i and overlap else "") + c for i, c in enumerate(out)]


def test_chunks_against_brute_force():
    rng = random.Random(17)
    for _ in range(2000):
        text = "".join(rng.choice("ab c.\n、, ") for _ in range(rng.randrange(200)))
        most = rng.randrange(2, 30)
        overlap = rng.choice([0, rng.randrange(most)])
        ladder = rng.choice([rag.SEPARATORS, rag.MARKDOWN, ("",), (" ",), ("\n", " ", "")])
        assert rag.split_text(text, most, overlap, ladder) == brute_split(text, most, overlap, ladder)


def test_catalog_keeps_types_apart_and_replicas_refuse(spark, tmp_path):
    df = spark.sql("select 1L as eid, date'2020-01-01' as day, true as ok, array(1) as a, 2.5D as x, 'z' as t")
    cat = Catalog(spark)
    assert [c.type for c in cat.register("t", df).spec.columns] == ["leaf", "leaf", "leaf", "number", "tag"]
    cat.save(str(tmp_path / "c"))
    again = Catalog.open(spark, str(tmp_path / "c"), read_only=True)
    assert again.specs == cat.specs and rows(again.table("t").df) == rows(df)
    with pytest.raises(Unsupported):
        again.table("t").delete(1)


def test_sql_without_key_and_bare_offset(spark):
    db = Database(spark)
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER); INSERT INTO t VALUES (1, 5), (2, 6); INSERT OR REPLACE INTO t (n) VALUES (7)")
    assert rows(db.execute("SELECT id, n FROM t")) == [(None, 7), (1, 5), (2, 6)]
    assert rows(db.execute("SELECT n FROM t ORDER BY n OFFSET 1")) == [(6,), (7,)]
    assert rows(db.execute("SELECT n FROM t ORDER BY n LIMIT 0")) == []
    for bad in ("OFFSET -1", "LIMIT -1", "LIMIT NULL", "LIMIT 1 OFFSET 'x'"):
        with pytest.raises(BadValue):
            db.execute(f"SELECT n FROM t {bad}")
    for i in range(20):  # so many versions are written on the way
        db.execute(f"UPDATE t SET n = {i} WHERE id = 1")
    assert rows(db.execute("SELECT n FROM t WHERE id = 1")) == [(19,)]


def test_shared_folder_and_discarded_tables(spark):
    from pathlib import Path

    df, path = store.cut_at(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and spark.sparkContext.applicationId in path
    store.discard(spark, path)
    assert not Path(path).exists()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(EngineError):
        store.shared_dir(Cluster)


def test_merge_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ops = [(1, 1, 0, 1, "w", 5, "a", "tie", "x"), (2, 3, 0, 1, "w", 5, "a", "tie", "y"), (3, 2, 0, 1, "w", 5, "b", "tie", "z"), (4, 4, 0, 1, "w", 6, "a", "tie", "q"), (5, 5, 0, 1, "w", 6, "a", "delete", None)]
    store.publish(spark.createDataFrame(ops, oplog.OPS), str(tmp_path / "r"))
    changes = oplog.merge_stream(store.stream(spark, str(tmp_path / "r"), oplog.OPS + ", room string", "default"))
    q = changes.writeStream.outputMode("update").format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert rows(spark.table("merged").select("eid", "attribute", "live", "value")) == [(5, "a", True, "y"), (5, "b", True, "z"), (6, "a", False, None)]


def test_hash_embed_takes_whole_texts(spark, tmp_path):
    from millrace.registry import QUERIES

    full = (1 << 64) - 1

    def brute(text):
        v = [0.0] * 16
        for w in text.split():
            h = 0xCBF29CE484222325
            for b in w.encode():
                h = (h ^ b) * 0x100000001B3 & full
            for i in range(16):
                h ^= h >> 12
                h = (h ^ (h << 25)) & full
                h ^= h >> 27
                v[i] += (h * 0x2545F4914F6CDD1D & full) / 2**64 * 2 - 1
        if not text.split():
            v[0] = 1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    rng = random.Random(11)
    start = "One two, three four five six seven eight"
    texts = [None, "", " ", "one", start, start + " nine", start + " ten"] + [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (8, 9, 300, 3000)]
    spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.eid: r.embedding for r in QUERIES["hash_embed"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert all(abs(x - y) < 2e-4 for x, y in zip(got[i], brute(t or ""), strict=True)), t and t[:60]
    assert got[4] != got[5] != got[6]


def check_against_sql(spark, d, name, tables):
    duckdb = pytest.importorskip("duckdb")
    from millrace.registry import ORACLE, QUERIES

    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(d))
    cols = sorted(got.columns)
    want = c.sql(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall()
    got = [tuple(r) for r in got.select(*cols).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    return sorted(got)


def test_sql_nulls_desc_sorts_all_rows(spark, tmp_path):
    lines = [(order, 1, 1, line, float(order % 90 + line), "N", "O", "1997-01-01") for order in range(2, 400) for line in range(1, 5)]
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_shipdate string"
    spark.createDataFrame(lines, cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    q = sorted((int(x[4]) for x in lines if x[3] != 3), reverse=True)
    assert check_against_sql(spark, tmp_path, "sql_nulls_desc_all", ["lineitem"]) == [(40, sum(q[:40]))]


def test_rrf_hybrid_ranks_all_vectors(spark, tmp_path):
    rng = random.Random(7)
    from millrace.registry import _QV

    spark.createDataFrame([(i, rng.choice(["idiot", "thing", "sea"]) + " sun" * (i % 9), "en", "s", 9) for i in range(700)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, [float(x) for x in _QV] if i == 650 else [rng.uniform(-1, 1) for _ in range(64)], 1) for i in range(700)]
    spark.createDataFrame(vectors, "vec_id int, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = check_against_sql(spark, tmp_path, "rrf_hybrid_all", ["documents", "embeddings"])
    assert 650 in {eid for eid, _ in got}  # the nearest vector is not among the first 500


def test_whole_merge_and_seal_digest(spark, tmp_path):
    import datetime

    import xxhash

    from millrace.registry import QUERIES

    people = [(i, f"c{i}", i % 25, "BUILDING") for i in range(1, 60)]
    spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(i, i % 7, "F" if i % 3 else None, "1-URGENT", f"1997-01-{i:02}") for i in range(1, 29)]
    table = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate string")
    table.write.parquet(str(tmp_path / "orders.parquet"))
    assert len(check_against_sql(spark, tmp_path, "sql_or_replace_all", ["customer"])) == 60
    total = 0
    for key, customer, status, priority, day in orders:
        days = (datetime.date.fromisoformat(day) - datetime.date(1970, 1, 1)).days
        h = 42
        for x in (key.to_bytes(8, "little"), key.to_bytes(8, "little"), customer.to_bytes(8, "little"), status and status.encode(), priority.encode(), days.to_bytes(4, "little")):
            h = h if x is None else xxhash.xxh64_intdigest(x, h)
        total += h - (1 << 64) if h >> 63 else h
    assert [tuple(r) for r in QUERIES["seal_digest"](spark, str(tmp_path)).collect()] == [(28, str(total))]


def test_embed_takes_a_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    texts = [None, "", "x" * 300, *(f"w{i} " * (i % 9) for i in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "eid int, text string").coalesce(1)
    hook = rag.embed(df, 2, embedder=lambda t: [len(t), 0.5])
    assert hook.schema.simpleString() == "struct<eid:int,embedding:array<float>>"
    assert {r.eid: r.embedding for r in hook.collect()} == {i: [len(t or ""), 0.5] for i, t in enumerate(texts)}
    asked = []
    monkeypatch.setattr(rag, "EMBED_TEXTS", 5)
    monkeypatch.setattr(rag, "EMBED_CHARS", 100)
    make = lambda some: asked.append(some) or rag.hash_vectors(some, 8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["eid", "text"])
    out = [r for b in rag.embed_batches(iter([batch, batch.slice(0, 0)]), make) for r in b.to_pylist()]
    assert all(len(some) <= 5 and sum(map(len, some[:-1])) < 100 for some in asked)
    assert [r["eid"] for r in out] == list(range(len(texts)))
    assert [r["embedding"] for r in out] == [r.embedding for r in rag.embed(df, 8).orderBy("eid").collect()]


def test_index_files_share_a_very_common_gram(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textsearch, "FILE_ROWS", 500, raising=False)
    df = spark.createDataFrame([(i, f"th{i % 3}") for i in range(2000)], "eid bigint, text string")
    path = str(tmp_path / "grams")
    textsearch.save(textsearch.index(df), path)
    post = textsearch.load(spark, path)
    most = post.groupBy(F.input_file_name().alias("f")).count().agg(F.max("count")).first()[0]
    assert most < 1000 and post.count() == 4000
    assert textsearch.search(df, "h1", postings=post).count() == 667
