"""Digest trees, multisets of rows, many-word search, SQL scopes."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import manysearch
from tidemark.functions.sqlscope import table_names
from tidemark.operators import cdc, comply, digest, lineage


def orders(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("c"), F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("id") % 11)).alias("v"))


def test_swapped_rows_are_found(spark):
    old = orders(spark)
    swap = F.when(F.col("k") == 8, F.lit(22)).when(F.col("k") == 22, F.lit(8)).otherwise(F.col("k"))  # two rows of one group change keys
    new = old.withColumn("k", swap.cast("long"))
    assert cdc.reconcile(old, new, ["c"]).where("next_action <> 'IN_SYNC'").count() == 0
    assert {r["k"] for r in digest.diff(old, new, ["k"]).collect()} == {8, 22}
    bad = [r["c"] for r in digest.reconcile(old, new, ["c"]).where("not in_sync").collect()]
    assert bad == ([1] if 8 % 7 == 22 % 7 else sorted({8 % 7, 22 % 7}))
    assert digest.reconcile(old, old.repartition(5), ["c"]).where("not in_sync").count() == 0


def test_digests_add_up_and_equal_parts_are_not_opened(spark, tmp_path):
    old = orders(spark)
    new = old.withColumn("v", F.when(F.col("k") == 42, "changed").otherwise(F.col("v"))).where("k <> 43")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    digest.store(old, a, ["k"])
    digest.store(new, b, ["k"])
    whole = digest.leaves(old, ["k"]).orderBy("node").collect()
    assert digest.added(digest.leaves(old.where("c < 3"), ["k"]), digest.leaves(old.where("c >= 3"), ["k"])).orderBy("node").collect() == whole
    trees = [spark.read.parquet(f"{p}/tree") for p in (a, b)]
    found = digest.differing(*trees)
    assert 1 <= len(found) <= 2
    for path in (tmp_path / "a" / "rows").glob("_part=*/*.parquet"):  # a file of equal leaves cannot even be opened any more
        if int(path.parent.name.split("=")[1]) not in {x >> (digest.BITS - digest.PARTS) for x in found}:
            path.write_bytes(b"broken")
    got = {(r["operation"], r["k"]) for r in digest.stored_diff(spark, a, b, ["k"]).collect()}
    assert got == {("U", 42), ("D", 43)}
    assert digest.differing(trees[0], trees[0]) == [] and digest.stored_diff(spark, a, a, ["k"]).count() == 0


def test_digests_tell_nulls_and_empty_tables_apart(spark):
    ddl = "k int, a string, b string"
    x, y = spark.createDataFrame([(1, None, "t"), (None, "", None)], ddl), spark.createDataFrame([(1, "t", None), (None, None, "")], ddl)
    assert digest.diff(x, y, ["k"]).count() == 2 and digest.diff(x, x, ["k"]).count() == 0
    assert digest.diff(x, x.limit(0), ["k"]).where("operation = 'D'").count() == 2
    assert digest.diff(x.limit(0), x.limit(0), ["k"]).count() == 0
    assert [r["k"] for r in digest.deleted_keys(x, y.where("k = 1"), ["k"]).collect()] == [None]


def test_multisets(spark):
    ddl = "a string, b int"
    old = spark.createDataFrame([("x", 1)] * 3 + [("y", None)] * 2 + [(None, None)], ddl)
    new = spark.createDataFrame([("x", 1)] + [("y", None)] * 4 + [("z", 0)], ddl)
    log = cdc.multiset_diff(old, new)
    assert {(r["a"], r["b"], r["operation"], r["copies"]) for r in log.collect()} == {("x", 1, "D", 2), ("y", None, "I", 2), (None, None, "D", 1), ("z", 0, "I", 1)}
    got = cdc.multiset_apply(old, log)
    assert got.exceptAll(new).count() == 0 and new.exceptAll(got).count() == 0
    assert cdc.multiset_diff(got, new).count() == 0  # nothing left to replay
    assert cdc.multiset_apply(new.limit(0), log).where("a = 'x'").count() == 0
    hot = cdc.numbered(spark.createDataFrame([("h", 12_345), ("i", 1), ("j", 0)], "a string, copies long"))
    assert hot.groupBy("a").agg(F.count("*"), F.countDistinct("nth"), F.max("nth")).orderBy("a").collect() == [("h", 12_345, 12_345, 12_344), ("i", 1, 1, 0)]


@pytest.mark.parametrize("seed", range(8))
def test_automaton_finds_what_contains_finds(seed):
    rnd = random.Random(seed)
    letters = "abcé🙂" if seed % 2 else "".join(chr(0x4E00 + i) for i in range(300)) + "ab"
    words = ["".join(rnd.choices(letters[: rnd.choice([2, len(letters)])], k=rnd.randint(1, 5))) for _ in range(40)]
    texts = ["".join(rnd.choices(letters[: rnd.choice([2, len(letters)])], k=rnd.choice([0, 1, 7, 600, 1500]))) for _ in range(30)] + ["x" * 511 + w for w in words] + ["".join(words)]
    assert manysearch.Automaton(words).found(texts) == [sorted({w for w in words if w in t}) for t in texts]
    assert manysearch.Automaton([]).found(["a", ""]) == [[], []]


def test_names_in_several_automata(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Ann Lee and BOB"), (2, "bo"), (3, None), (4, "x" * 2000 + " ann lee")], "k int, note string")
    names = spark.createDataFrame([(1, "ann lee"), (2, "bo"), (3, "bob"), (4, "ann lee"), (5, ""), (6, None)], "request_id int, _n string")
    want = [(1, 1), (1, 4), (2, 1), (2, 2), (3, 1), (4, 1), (4, 4)]
    for most in (200_000, 4):
        monkeypatch.setattr(comply, "NAME_LETTERS", most)
        assert sorted((r["request_id"], r["k"]) for r in comply.holding(df, "note", names).collect()) == want
    assert comply.holding(df, "note", names.where("request_id > 4")).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("SELECT '--' AS a, b FROM t1", [("t1",)]),
    ("WITH c AS (SELECT * FROM t2) SELECT * FROM c", [("t2",)]),
    ("SELECT \"FROM x\", 'it''s /* ' FROM t3 -- */ FROM t4", [("t3",)]),
    ('SELECT * FROM "My Table" JOIN a.b.c ON 1 = 1', [("My Table",), ("a", "b", "c")]),
    ("SELECT 1 FROM t5, t6", [("t5",), ("t6",)]),
    ("WITH a AS (SELECT 1 FROM x), b (c, d) AS (SELECT * FROM a, y), orders AS (SELECT * FROM orders) SELECT * FROM b JOIN a ON a.i = b.i, orders, z", [("x",), ("y",), ("orders",), ("z",)]),
    ("with recursive r as (select 1 from base union all select * from r join k on true) insert into [Out Put].[t] (a, b) select extract(year from d), substring(x from 2) from r where a is distinct from b", [("base",), ("k",), ("Out Put", "t")]),
    ("MERGE INTO tgt t USING src s ON (t.a = s.a) WHEN MATCHED THEN UPDATE SET a = 1", [("tgt",), ("src",)]),
    ("UPDATE p SET x = 1 FROM q, r; SELECT a FROM (b JOIN c ON b.x = c.x), unnest(z) u, w FOR UPDATE", [("p",), ("q",), ("r",), ("b",), ("c",), ("w",)]),
    ("SELECT * FROM c; WITH c AS (SELECT 1 FROM d) SELECT * FROM c", [("c",), ("d",)]),
    ("SELECT $$ FROM no $$, $x$ FROM no $x$ FROM `a``b`", [("a`b",)]), ("SELECT 'open FROM t", []), ("SELECT /* FROM t", []), (")) FROM t", [("t",)]), ("", []), (None, []),
])
def test_table_names(text, want):
    assert table_names(text) == want


def test_scoped_edges(spark):
    rows = [("s", "v", "VIEW", 'SELECT * FROM "My Table" JOIN a.b.c, v'), ("s", "p", "PROCEDURE", None)]
    got = lineage.text_references(spark.createDataFrame(rows, "schema_name string, object_name string, object_type string, text string"), clean=True)
    assert sorted((r["target_schema_name"], r["target_object_name"]) for r in got.collect()) == [("b", "c"), ("s", "My Table")]
