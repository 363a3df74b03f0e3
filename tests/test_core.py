"""Boundaries, properties and sinks that the SQL comparison does not reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean, pii
from tidemark.operators import alerts, cdc, comply, evolve, govern, lineage, quality, sensitive
from tidemark.plans.registry import Tables
from tidemark.sources import deltas, scan, sinks
from tidemark.streaming import changes

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def log_rows(seed, n=80, keys=9):
    r = random.Random(seed)
    return [(i, r.choice("IUD"), r.randrange(keys) if r.random() < 0.95 else None, r.randrange(1000) if r.random() < 0.9 else None) for i in range(n)]


LOG = "change_id long, operation string, k long, v long"


def naive(start, log):
    state = dict(start)
    for _, op, k, v in sorted(log):
        if k is None:
            continue
        if op == "D":
            state.pop(k, None)
        else:
            state[k] = v
    return state


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_apply_equals_one_change_at_a_time(spark, seed):
    log, start = log_rows(seed), {1: 5, 2: None, 50: 7}
    target = spark.createDataFrame(list(start.items()), "k long, v long")
    got = cdc.apply_changes(target, spark.createDataFrame(log, LOG), ["k"], ["v"])
    assert dict(got.collect()) == naive(start, log)


@pytest.mark.parametrize("cuts", [1, 4, 9])
def test_batches_and_replays_change_nothing(spark, cuts):
    log = log_rows(7)
    state = spark.createDataFrame([], "k long, v long, _change_id long, _deleted boolean")
    parts = [log[i::1][a : a + 80 // cuts + 1] for i in (0,) for a in range(0, 80, 80 // cuts + 1)]
    for part in [*parts, parts[0], parts[-1]]:
        state = spark.createDataFrame(cdc.apply_versioned(state, spark.createDataFrame(part, LOG), ["k"], ["v"]).collect(), state.schema)
    assert {r["k"]: r["v"] for r in state.where("not _deleted").collect()} == naive({}, log)


def test_diff_then_apply_gives_the_new_version(spark):
    t = Tables(spark, SF)
    old, new = t.orders_old, t.orders_new
    log = cdc.diff(old, new, ["o_orderkey"]).withColumn("change_id", F.monotonically_increasing_id())
    parsed = cdc.parse(log.drop("o_orderkey"), "o_orderkey long", "o_custkey long, o_orderstatus string, cents long")
    got = cdc.apply_changes(old, parsed, ["o_orderkey"], ["o_custkey", "o_orderstatus", "cents"])
    assert got.exceptAll(new).count() == 0 and new.exceptAll(got).count() == 0
    assert cdc.diff(new, new, ["o_orderkey"]).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    t = Tables(spark, SF)
    log = t.change_log.drop("change_time", "schema_name", "table_name")
    log.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = changes.read_changes(spark, str(tmp_path / "in"), log._jdf.schema().toDDL(), 1)
    prepare = lambda b: cdc.parse(b, "user_id long", "cents long, kind string").drop("has")
    for _ in range(2):  # a second run finds nothing new
        changes.apply_stream(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"), keys=["user_id"], columns=["cents", "kind"], prepare=prepare).awaitTermination()
    empty = spark.createDataFrame([], "user_id long, cents long, kind string")
    want = cdc.apply_changes(empty, prepare(log), ["user_id"], ["cents", "kind"])
    got = changes.live(spark, str(tmp_path / "table"))
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() > 0


def test_document_stream(spark):
    rows = [(1, "insert", '{"_id": {"$oid": "a"}, "x": 1}'), (2, "delete", '{"_id": {"$oid": "a"}}'), (3, "replace", '{"_id": 7, "x": 2}')]
    got = changes.document_changes(spark.createDataFrame(rows, "change_id long, kind string, doc string"))
    assert [(r["operation"], r["_id"]) for r in got.orderBy("change_id").collect()] == [("U", "a"), ("D", "a"), ("U", "7")]


def test_null_safe_deletes(spark):
    target = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (None, None, "c"), (1, None, "d")], "x int, y int, z string")
    gone = spark.createDataFrame([(1, None), (None, None)], "x int, y int")
    assert [r["z"] for r in cdc.delete_by_key(target, gone, ["x", "y"]).collect()] == ["b"]
    assert sorted(r["z"] for r in cdc.delete_by_image(target, target.where("z = 'a'"), ["x", "y", "z"]).collect()) == ["b", "c", "d"]


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.current(spark, path) is None
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.publish(first, path, 0)
    sinks.publish(sinks.upserted(sinks.current(spark, path), spark.createDataFrame([(2, "c"), (None, "x"), (3, "d")], "k int, v string"), ["k"]), path, 1)
    assert sorted(sinks.current(spark, path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_versions_in_buckets(spark, tmp_path):
    path, names = str(tmp_path / "t"), lambda: sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v"))
    table = lambda rows: spark.createDataFrame(rows, "k int, v string")
    sinks.publish(table([(i, "a") for i in range(40)]), path, 0, keys=["k"], buckets=4)
    before = sinks.placed(spark, path)
    assert set(before) == {0, 1, 2, 3}
    touched = table([(7, "")]).select(sinks.bucket_of(["k"], 4)).first()[0]
    rows = sinks.upserted(sinks.current(spark, path, {touched}), table([(7, "b")]), ["k"])
    sinks.publish(rows, path, 1, keys=["k"], buckets=4, whole=False)
    after = sinks.placed(spark, path)
    assert {b for b in after if after[b] != before[b]} == {touched}
    assert sorted(sinks.current(spark, path).collect()) == [(i, "b" if i == 7 else "a") for i in range(40)]
    (tmp_path / "t" / "manifest" / "m999999999999-lost").mkdir()  # of a job that was lost
    sinks.publish(table([(1, "z")]), path, 2, keys=["k"], buckets=4)
    assert len(names()) == 3
    sinks.prune(spark, path, keep=1)
    assert len(names()) == 1 and sinks.current(spark, path).collect() == [(1, "z")]
    sinks.publish(table([]), path, 3, keys=["k"], buckets=4)
    assert sinks.current(spark, path).count() == 0 and sinks.current(spark, path).columns == ["k", "v"]
    (tmp_path / "t" / "manifest" / "m000000000003-0").mkdir(exist_ok=True)
    spark.createDataFrame([(0, "no/such/folder")], "bucket int, folder string").write.parquet(str(tmp_path / "bad" / "manifest" / "m1-x"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):  # a table that is broken is not taken for an empty one
        sinks.current(spark, str(tmp_path / "bad"))


def test_tombstones_go(spark, tmp_path):
    log = [(1, "I", 1, 5), (2, "I", 2, 6), (3, "D", 1, None), (4, None, 3, 9), (5, "X", 4, 9)]
    spark.createDataFrame(log, LOG).write.parquet(str(tmp_path / "in"))
    stream = changes.read_changes(spark, str(tmp_path / "in"), LOG)
    table = str(tmp_path / "table")
    changes.apply_stream(stream, table, str(tmp_path / "c"), keys=["k"], columns=["v"]).awaitTermination()
    assert deltas.current(spark, table).count() == 2 and [tuple(r) for r in changes.live(spark, table).collect()] == [(2, 6)]
    changes.compact(spark, table, before=3, small=10)
    assert deltas.current(spark, table).count() == 1 and changes.live(spark, table).count() == 1


def test_unknown_operations_say_nothing(spark):
    target = spark.createDataFrame([(1, 5)], "k long, v long")
    log = spark.createDataFrame([(1, None, 7, 9), (2, "Z", 1, 9), (3, "U", 1, 6), (4, None, 1, 8)], LOG)
    assert cdc.apply_changes(target, log, ["k"], ["v"]).collect() == [(1, 6)]


def test_images_are_compared_column_by_column(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, a string, b string")
    assert cdc.diff(rows((1, "x|", "y")), rows((1, "x", "|y")), ["k"]).count() == 1
    assert cdc.diff(rows((1, None, "y"), (None, "a", None)), rows((1, "", "y"), (None, "a", None)), ["k"]).count() == 1
    assert cdc.delete_by_image(rows((1, None, ""), (1, "", None), (1, "", "")), rows((1, "", "")), ["k", "a", "b"]).count() == 2
    got = cdc.diff(rows((1, "a", None)), rows((2, "a", None)), ["k"]).orderBy("operation").collect()
    assert [(r["operation"], r["k"], r["pk_values"]) for r in got] == [("D", 1, '{"k":1}'), ("I", 2, '{"k":2}')]


def test_database_source_and_target(spark, tmp_path):
    """By Spark's own JDBC reader and writer, with the embedded database in Spark's jars."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    orders = Tables(spark, SF).orders.select("o_orderkey", "o_totalprice")
    sinks.write_to(orders, "jdbc", url, "orders_copy", driver=driver)
    sinks.write_to(orders.limit(0), "jdbc", url, "orders_copy", driver=driver)
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    got = scan.read_jdbc(spark, url, "orders_copy", key="o_orderkey", low=low, high=high, partitions=3, driver=driver)
    assert got.rdd.getNumPartitions() == 3
    names = {c.lower(): c for c in got.columns}
    assert sorted(got.select(names["o_orderkey"], names["o_totalprice"]).collect()) == sorted(orders.collect())


def test_table_discovery(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("CREATE DATABASE IF NOT EXISTS sys")
    for schema in ("shop", "sys"):
        spark.range(3).write.mode("overwrite").saveAsTable(f"{schema}.discovered")
    got = scan.catalog_tables(spark).where("table_name = 'discovered'").collect()
    for schema in ("shop", "sys"):
        spark.sql(f"DROP DATABASE {schema} CASCADE")
    assert [(r["schema_name"], r["table_name"], r["kind"]) for r in got] == [("shop", "discovered", "MANAGED")]
    assert scan.folder_tables(spark, SF).where("table_name = 'orders'").count() == 1 and scan.folder_tables(spark, str(tmp_path / "none")).count() == 0


def test_adjacent_personal_data(spark):
    df = spark.createDataFrame([(1, "12345 67890 12345"), (2, "a@b.cc,d@e.ff g@h.iix9@j.kk"), (3, None), (4, "x" * 50_000)], "id int, v string")
    assert {(r["id"], r["category"]): r["n"] for r in sensitive.occurrences(df, "id", "v").collect()} == {(1, "ZIP_CODE"): 3, (2, "EMAIL"): 4}


def test_intermediate_folders_need_a_shared_place(spark, monkeypatch):
    from tidemark.sources import scratch

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.folder(Cluster, "x")


def test_file_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append(df, str(tmp_path / "a"))
    sinks.append(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    sinks.replace(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    sinks.replace(df, str(tmp_path / "p"), partitions=["k"])
    sinks.replace(df.where("k = 2").withColumn("v", F.lit("z")), str(tmp_path / "p"), partitions=["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "a"), (2, "z")]
    for kind in ("csv", "json", "parquet"):
        sinks.write_to(df, kind, str(tmp_path / kind))
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 2
    keep, done = comply.execute(spark.createDataFrame([(1, None), (2, "2020-01-01")], "k int, d string").withColumn("d", F.to_date("d")), "d", F.to_date(F.lit("2021-01-01")), archive=str(tmp_path / "old"))
    assert keep.count() == 1 and done.first()["rows_affected"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "old")).first()["k"] == "2"


def test_score_boundaries(spark):
    assert [one(spark, quality.status(F.lit(x))) for x in (90.0, 89.99, 70.0, 69.99)] == ["PASSED", "WARNING", "WARNING", "FAILED"]
    assert one(spark, quality.score(*[F.lit(x) for x in (0, 0, 0, 0, 0)])) == 100.0
    assert one(spark, quality.score(*[F.lit(x) for x in (10, 1000, 0, 0, 0)])) == 0.0
    assert [one(spark, govern.access_frequency(F.lit(n))) for n in (10001, 10000, 1000, 100, 10, 1, 0)] == ["REAL_TIME", "HIGH", "MEDIUM", "LOW", "RARE", "RARE", "ARCHIVED"]


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert [(r["rows"], r["nulls"], r["null_pct"]) for r in quality.profile(empty).collect()] == [(0, 0, 0.0)] * 2
    got = quality.validate(empty, "e", expected={"b": "int"}, parents=[("a", empty, "a")]).first()
    assert (got["total_rows"], got["quality_score"], got["validation_status"]) == (0, 100.0, "PASSED")
    nulls = spark.createDataFrame([(None, None)] * 3, "a int, b string")
    assert [(r["nulls"], r["distinct_values"], r["mean"]) for r in quality.profile(nulls, exact=False).collect()] == [(3, 0, None)] * 2
    assert quality.governance_nulls(nulls).first()[0] == 100.0 and quality.governance_nulls(empty).first()[0] == 0.0
    assert sensitive.verdicts(nulls, "n").count() == 0
    assert cdc.key_check(nulls, ["a"]).first().asDict() == {"rows": 3, "surplus": 0, "null_keys": 3, "is_key": False}


def test_pii_ratio_is_exclusive(spark):
    at = spark.createDataFrame([("a@b.cc",)] + [("x",)] * 9, "v string")
    above = spark.createDataFrame([("a@b.cc",)] + [("x",)] * 8, "v string")
    assert not sensitive.verdicts(at, "t").first()["contains_pii"] and sensitive.verdicts(above, "t").first()["contains_pii"]


def test_pii_patterns(spark):
    cases = {"a.b@c.org": "EMAIL", "(555) 123-4567": "PHONE", "123-45-6789": "SSN", "90210": "ZIP_CODE", "90210-1234": "SSN", "10.0.0.1": "IDENTIFIER", "é12345": "ZIP_CODE", "a12345": "IDENTIFIER", "": "UNKNOWN"}
    assert {v: one(spark, pii.pii_category(F.lit(v))) for v in cases} == cases
    assert one(spark, pii.pii_by_content(F.lit("10.0.0.1"))) and not one(spark, pii.pii_by_content(F.lit("plain")))
    assert one(spark, pii.phi_by_content(F.lit("E11.9"))) and one(spark, pii.phi_by_content(F.lit("Blood Type O"))) and not one(spark, pii.phi_by_content(F.lit("e11")))


def test_cleaning(spark):
    c = lambda v, t, d="mariadb", s=True: one(spark, clean.clean(F.lit(v), t, d, s))
    assert c("0000-00-00", "DATE") == "1970-01-01" and c("2024-01-05 00:00:00", "TIMESTAMP") == "1970-01-01 00:00:00"
    assert c("2024-01-05 00:00:00", "TIMESTAMP", s=False) == "2024-01-05 00:00:00" and c("", "TEXT", s=False) is None
    assert c("zz", "BYTEA") == "DEFAULT" and len(c("ab" * 700, "BYTEA")) == 1000
    assert c("Y", "BOOLEAN", "mssql") == "true" and c("", "BOOLEAN", "mssql") == "false" and c("1", "BIT", "mssql") == "true"
    assert c("null", "NUMERIC", "oracle") == "0" and c("1900-01-01", "TEXT", "oracle") == "1900-01-01"
    assert c("", "BIGINT", "mongo") == "0" and c(None, "JSONB", "mongo") == "NULL"
    assert one(spark, clean.identifier(F.lit(" 9ab "))) is None and one(spark, clean.identifier(F.lit(" Order-ID "))) == "orderid"
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a-B` int, `9` int")
    assert clean.with_identifiers(df).columns == ["ab", "ab_2", "c9"]
    assert clean.spark_type("numeric") == "decimal(38,18)" and clean.spark_type("GEOMETRY") == "string"


def test_evolution(spark):
    df = spark.createDataFrame([(1, "5", "x")], "id int, n string, gone string")
    out, report = evolve.evolve(df, [("id", "bigint"), ("n", "int"), ("extra", "string")], keys=["id"], defaults={"extra": "d"})
    assert out.first().asDict() == {"id": 1, "n": 5, "extra": "d"}
    assert [(n, a) for n, a, _ in report] == [("id", "MODIFY"), ("n", "MODIFY"), ("extra", "ADD"), ("gone", "DROP")]
    with pytest.raises(ValueError, match="key"):
        evolve.evolve(df, [("n", "int")], keys=["id"])
    pairs = {("INTEGER", "BIGINT"): True, ("BIGINT", "INTEGER"): False, ("VARCHAR(4)", "TEXT"): True, ("JSONB", "TEXT"): True, ("DATE", "TEXT"): False, ("TIMESTAMP", "TIME"): True, ("SMALLINT", "BIGINT"): True}
    assert {p: one(spark, evolve.compatible(F.lit(p[0]), F.lit(p[1]))) for p in pairs} == pairs


def test_rules_and_messages(spark):
    events = Tables(spark, SF).events
    assert alerts.evaluate_rule(spark, "SELECT count(*) > 1 FROM {e}", e=events)
    assert not alerts.evaluate_rule(spark, "SELECT nonsense FROM {e}", e=events) and not alerts.evaluate_rule(spark, "SELECT null FROM {e}", e=events)
    m = lambda *x: one(spark, alerts.message(*map(F.lit, x)))
    assert m("T", "s", "t", "c", "x") == "T - s.t.c - x" and m("T", "", "t", "", "x") == "T - x"


def test_lineage_text(spark):
    rows = [(1, "s", "v", "VIEW", "select * from orders -- from ghost\n join a.b on 'from nothing'"), (2, "s", "w", "VIEW", "select * from s.w"), (3, "s", "p", "PROCEDURE", None)]
    df = spark.createDataFrame(rows, "def_id int, schema_name string, object_name string, object_type string, text string")
    names = lambda clean: sorted(r["target_object_name"] for r in lineage.text_references(df, clean=clean).collect())
    assert names(True) == ["b", "orders"] and names(False) == ["b", "ghost", "nothing", "orders"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "object_name string, target_object_name string")
    assert {(r["a"], r["b"], r["hops"]) for r in lineage.reachable(edges, 2).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "c", 2), ("b", "d", 2)}


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"a": 1, "b": {"$date": 86400000}}'), (2, '{"c": 2.5, "a": "x"}'), (3, "not json"), (4, None)], "id long, doc string")
    assert [(r["field"], r["documents"]) for r in scan.fields(docs, "doc", "id").orderBy("first_seen", "place").collect()] == [("a", 2), ("b", 1), ("c", 1)]
    assert dict(scan.inferred_types(docs.where("id < 3"), "doc").collect()) == {"a": "TEXT", "b": "JSONB", "c": "NUMERIC"}
    assert scan.flatten(docs, "doc", ["a", "b"]).first()["b"] == "1970-01-02 00:00:00"
    bodies = spark.createDataFrame([("[1, {}]",), ('{"data": []}',), ('{"x": 1}',), ("junk",), (None,)], "body string")
    assert [r["record"] for r in scan.payload_rows(bodies, "body").collect()] == ["1", "{}", '{"x": 1}']
    assert scan.find(docs, {"doc": None}).count() == 1


def test_subjects_need_a_name(spark):
    df = spark.createDataFrame([(1, "A@x.y", "Ann Lee"), (2, "b@x.y", "Bo")], "k int, email string, name string")
    requests = spark.createDataFrame([(1, "a@X.y", None), (2, None, "bo"), (3, None, ""), (4, None, None)], "request_id int, email string, full_name string")
    assert comply.forget(df, requests.where("request_id = 1"), ["k"], email=["email"], name=["name"]).count() == 1
    assert comply.forget(df, requests.where("request_id > 2"), ["k"], email=["email"], name=["name"]).count() == 2
    assert sorted(r["request_id"] for r in comply.export(df, requests, email=["email"], name=["name"]).collect()) == [1, 2]
    short = spark.createDataFrame([(5, None, "e"), (6, None, "nn l"), (7, None, "ann lee jr"), (8, None, "zz")], "request_id int, email string, full_name string")
    assert sorted((r["request_id"], r["k"]) for r in comply.subject_matches(df, short, email=["email"], name=["name"]).collect()) == [(5, 1), (6, 1)]


@pytest.mark.parametrize(("cell", "letters"), [(1024, 200_000), (2, 6)])
def test_subjects_and_requests_meet_once(spark, monkeypatch, cell, letters):
    monkeypatch.setattr(comply, "CELL", cell)
    monkeypatch.setattr(comply, "NAME_LETTERS", letters)
    rows = [(i % 9, [None, "", f"{'uU'[i % 2]}{i % 4}@x.y"][i % 3], ["Ann", "ANNA BO", "bo", None, ""][i % 5], [None, "u1@X.y", "ann"][i % 3]) for i in range(40)] * 2
    asked = [(i % 7 if i % 11 else None, [None, "", f"u{i % 4}@X.Y"][i % 3], [None, "", "ann", "Bo", "a", "zz"][i % 6]) for i in range(24)] + [(100 + i, "u1@x.y", "ann") for i in range(9)] + [(200, "u2@x.y", None), (201, None, "BO")]
    df = spark.createDataFrame(rows, "k int, email string, name string, other string")
    requests = spark.createDataFrame(asked + asked[:5], "request_id int, email string, full_name string")
    low = lambda x: None if x is None else x.lower()
    held = lambda r, e, n: (e is not None and low(e) in (low(r[1]), low(r[3]))) or (n not in (None, "") and any(low(n) in low(x) for x in r[2:] if x is not None))
    want = {(q, *r) for q, e, n in asked for r in rows if held(r, e, n)}
    both = {"email": ["email", "other"], "name": ["name", "other"]}
    order = lambda found: sorted(map(str, found))
    assert order(map(tuple, comply.subject_matches(df, requests, **both).collect())) == order(want)
    out = comply.export(df, requests, **both)
    shown = [(r["request_id"], *map(json.loads(r["row"]).get, df.columns)) for r in out.collect()]
    assert order(shown) == order(want)
    assert {tuple(r) for r in comply.forget(df, requests, ["name"], **both).select(df.columns).collect()} == {r for r in rows if r[2] is None or r[2] not in {w[3] for w in want}}
    once = requests.where("request_id >= 100")  # no request looks for more than an address and a name: pairs are not compared
    plan = comply.export(df, once, **both)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
