"""Deduplication of repeated runs of lines, by a suffix array over line ids built with prefix doubling.

The corpus is one sequence of lines for each document (blank lines stand outside). Line ids are ranks of
line hashes. Each doubling sorts the suffixes that are still tied by the ranks of their two halves, in
one range-partitioned sort over the distinct pairs, which gives their ranks at up to twice the depth;
suffixes that have become unique drop out. At depth `min_lines` the suffixes of one rank are a
longest-common-prefix interval: they share a run of at least min_lines lines. Deeper ranks could not
change what is covered, as every longer run is the union of such runs. All copies of a run but the first,
by document id and line, are deleted. Maximal repeated runs are unions of overlapping ones.

Pairs are counted with map-side combining before they are ranked, so a line that a third of the
documents share is one row of the sort; ranks come back by sort-merge joins, which Spark splits.

Defined cases: null and empty texts have no lines and stay as they are. Lines are compared without
surrounding spaces; blank lines are kept. Copies within a document count too. Documents are ordered by
id, null ids last, then by a hash of the text; repeated rows (same id and text) are one document and
lose the same lines. All columns of the input pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, staged

MIN_LINES = 3
PLACE = ["_tm_void", "_tm_id", "_tm_x"]


def place(key: str, text: str) -> list[Column]:
    """A document's place in the order: null ids last, id, hash of the text."""
    return [F.col(key).isNull().alias("_tm_void"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_tm_id"), F.xxhash64(F.col(text)).alias("_tm_x")]


def line_suffixes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """PLACE, i (line number among those not blank) and two hashes a, b, each of the line itself: 128 bits in all."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = docs.select(*place(key, text), F.posexplode(lines).alias("i", "line"))
    return rows.select(*PLACE, "i", F.xxhash64("line").alias("a"), F.xxhash64(F.concat(F.lit("\n"), "line")).alias("b")).dropDuplicates([*PLACE, "i"])


def ranked(suffixes: DataFrame) -> DataFrame:
    """PLACE, i and the rank of (a, b) for the suffixes whose pair is not unique."""
    tied = suffixes.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")
    order = staged(tied.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("r", F.monotonically_increasing_id()))
    return staged(suffixes.join(order, ["a", "b"]).select(*PLACE, "i", "r"))


def repeated_runs(docs: DataFrame, *, key="doc_id", text="text", min_lines: int = MIN_LINES) -> DataFrame:
    """PLACE, i, r: the start of every run of min_lines lines that occurs more than once; r is its interval."""
    tied, depth = ranked(staged(line_suffixes(docs, key, text))), 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        later = tied.select(*PLACE, (F.col("i") - step).alias("i"), F.col("r").alias("b"))
        tied = ranked(staged(tied.withColumnRenamed("r", "a").join(later, [*PLACE, "i"])))
        depth += step
    return tied


def copied_runs(docs: DataFrame, *, key="doc_id", text="text", min_lines: int = MIN_LINES) -> DataFrame:
    """The longest runs that a document has in common with the first place of each of their parts: _tm_id and _tm_x of the
    document, first line and length, from_id and from_line of the copied run, and copies, how often its commonest part occurs."""
    runs = repeated_runs(docs, key=key, text=text, min_lines=min_lines)
    here = F.struct(*PLACE, "i")
    first = staged(runs.groupBy("r").agg(F.min(here).alias("first"), F.count("*").alias("n")))
    later = runs.join(first, "r").where(here > F.col("first")).select(*PLACE, "i", *[F.col("first")[c].alias(f"_f{c}") for c in (*PLACE, "i")], "n")
    along = Window.partitionBy(*PLACE, *[f"_f{c}" for c in PLACE], F.col("i") - F.col("_fi")).orderBy("i")
    marked = later.withColumn("step", F.col("i") - F.col("_fi")).withColumn("island", F.col("i") - F.row_number().over(along))
    found = marked.groupBy(*PLACE, *[f"_f{c}" for c in PLACE], "step", "island").agg(F.min("i").alias("line"), (F.max("i") - F.min("i") + min_lines).alias("length"), F.max("n").alias("copies"))
    named = lambda id, void: F.when(~F.col(void), F.col(id))
    return found.select(named("_tm_id", "_tm_void").alias("id"), F.col("_tm_x").alias("row"), "line", "length", named("_f_tm_id", "_f_tm_void").alias("from_id"), (F.col("line") - F.col("step")).alias("from_line"), "copies")


def deleted_lines(runs: DataFrame, min_lines: int) -> DataFrame:
    """PLACE and the numbers of the lines that later copies of runs cover."""
    here = F.struct(*PLACE, "i")
    first = staged(runs.groupBy("r").agg(F.min(here).alias("first")))  # so that the join can split a hot run
    later = runs.join(first, "r").where(here > F.col("first"))
    covered = F.explode(F.sequence(F.col("i"), F.col("i") + min_lines - 1))
    return later.select(*PLACE, covered.alias("i")).groupBy(*PLACE).agg(F.collect_set("i").alias("_tm_gone"))


def dedup_lines(docs: DataFrame, *, key="doc_id", text="text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with later copies of runs cut from text, and n_lines and n_removed."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    gone = deleted_lines(repeated_runs(docs, key=key, text=text, min_lines=min_lines), min_lines)
    marked = docs.select("*", *place(key, text)).join(gone, PLACE, "left").drop(*PLACE).select(*docs.columns, "_tm_gone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines int, n_removed int"
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text, 8 << 20):
            texts, n, removed = [], [], []
            for value, gone in zip(batch.column(at).to_pylist(), batch.column("_tm_gone").to_pylist(), strict=True):
                lines = value.split("\n") if value else []
                numbers, count = [], 0
                for line in lines:
                    full = line.strip(" ") != ""
                    numbers.append(count if full else -1)
                    count += full
                if gone:
                    drop = set(gone)
                    value = "\n".join(line for line, i in zip(lines, numbers, strict=True) if i not in drop)
                texts.append(value)
                n.append(count)
                removed.append(len(gone or ()))
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(removed, pa.int32())], names=[*names, "n_lines", "n_removed"])

    return marked.mapInArrow(run, schema)


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"))


OP4_SQL = """
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents),
l AS (SELECT doc_id, j, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i FROM raw WHERE trim(line) <> ''),
w AS (SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS run FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT run, min(doc_id) AS d, arg_min(i, (doc_id, i)) AS i FROM w WHERE run IS NOT NULL GROUP BY run),
gone AS (SELECT DISTINCT w.doc_id, w.i + s.s AS i FROM w JOIN f USING (run) CROSS JOIN (VALUES (0), (1), (2)) s(s) WHERE (w.doc_id, w.i) > (f.d, f.i)),
cut AS (SELECT l.doc_id, l.j FROM l JOIN gone USING (doc_id, i)),
kept AS (SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.j) AS text FROM raw LEFT JOIN cut USING (doc_id, j) WHERE cut.j IS NULL GROUP BY raw.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CAST((SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) AS INTEGER) AS n_lines, CAST((SELECT count(*) FROM cut WHERE cut.doc_id = d.doc_id) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""
