"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct shingles (runs of `width` words, A-Z lower-cased). Equal sets are
one class; one document of each class goes on. In every tree a document walks down a path: at each
level the minwise token of its set under that tree's and level's hash is selected, and documents that
select equal tokens stay in one node. Nodes of up to `small` documents are compared exhaustively;
larger ones branch on. Independent trees repeat this: two sets of similarity s meet at the first
level with probability 1 - (1 - s)^trees (0.85 and 12 trees: all but 1e-9).

A node that is still large at the last level holds a dense group, such as thousands of near copies. Its
pairs are never listed: the document with most agreement with the whole node leads, all are compared
with it, and those that differ from it go to the next round, until small nodes are left or `rounds`
leaders were taken. Nodes whose documents are not one component after that are joined exactly, leaders'
members included: every set gives its rarest shingles, so many that linked sets must share one of them,
and documents of different components that do so, where sizes and places allow a link, are candidates.

Candidate pairs pass a sketch of 128 coordinates, whose cut a pair at the threshold misses with a probability
below LOSS, and a bitmap of the set, which bounds what two sets can share; links are confirmed on the full sets, and components follow from them by alternating large and
small stars.

Counts are written before rows are joined with them: between two plain tables Spark can split a hot node.

Defined cases: texts with fewer words than `width` are one shingle, the whole sequence; without words
(or null) they have no shingle and no link. Links are between texts, not ids: of rows with equal id and
different texts each has the component of its own text, named by the smallest id in it; equal rows share
theirs. A null id has no component and is kept. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, bounded, staged, window_hashes

COORDINATES = 128
BUCKETS = 1 << 20  # of shingles that are counted together
BITS = 11  # 2^11 buckets of a set's bitmap
LOSS = 1e-9  # chance that a sketch shows a pair at the threshold below the cut
BLOCK = 4096  # rows of one shingle that are compared with each other in one group
FACTORS = np.random.default_rng(97).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_estimate(percent: int) -> float:
    """The estimate that a pair of this similarity stays below with a probability under LOSS (binomial tail)."""
    match = percent / 100 + (1 - percent / 100) / 256
    below, k = 0.0, -1
    while below < LOSS:
        k += 1
        below += math.comb(COORDINATES, k) * match**k * (1 - match) ** (COORDINATES - k)
    return (k / COORDINATES - 1 / 256) / (1 - 1 / 256) - 1e-9


def shingle_set(text: bytes | None, hashes: WordHashes, width: int) -> np.ndarray:
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z only
    return np.unique(window_hashes(hashes.of(words), min(width, len(words)) or 1)) if words else np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the hash functions."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 4096):
            least = np.minimum(least, (shingles[None, a : a + 4096] * FACTORS[:, None]).min(1))
    return least


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each bucket that holds a shingle."""
    marks = np.zeros(1 << BITS, np.uint8)
    marks[(shingles >> np.uint64(64 - BITS)).astype(np.int64)] = 1
    return np.packbits(marks).tobytes()


def can_link(x: np.ndarray, y: np.ndarray, n_x, n_y, percent: int) -> np.ndarray:
    """Whether sets of these bitmaps (rows of bytes) and sizes can have the similarity: each bit that only one set
    has is an element that only it has. Sets that are similar enough always can."""
    shared = -(-percent * (n_x + n_y) // (100 + percent))
    alone = lambda a, b: np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    return (alone(x, y) <= n_x - shared) & (alone(y, x) <= n_y - shared)


def signatures(texts: DataFrame, width: int, functions: int) -> DataFrame:
    """id, row, n (size of the set), key (of the whole set), tokens (minwise, one a function), sketch and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in bounded(batches, "text", 8 << 20):
            n, keys, rows, bits = [], [], [], []
            for text in as_bytes(batch.column("text")):
                s = shingle_set(text, hashes, width)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                rows.append(minima(s))
                bits.append(bitmap(s))
            m = np.stack(rows)
            tokens = pa.FixedSizeListArray.from_arrays(pa.array(m[:, :functions].copy().view(np.int64).ravel()), functions).cast(pa.list_(pa.int64()))
            sketch = pa.array([x.tobytes() for x in (m & np.uint64(255)).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), tokens, sketch, pa.array(bits, pa.binary())], names=["id", "row", "n", "key", "tokens", "sketch", "bits"])

    return texts.mapInArrow(run, "id long, row long, n long, key binary, tokens array<long>, sketch binary, bits binary")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in bounded(batches, "text", 4 << 20):
            sets = [shingle_set(t, hashes, width) for t in as_bytes(batch.column("text"))]
            ends = np.r_[0, np.cumsum([len(s) for s in sets])]
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["id", "items"])

    return texts.mapInArrow(run, "id long, items array<long>")


def exhaustive(nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs (a < b) within nodes (path, id, n) that are known to be small, where the sizes allow a link."""
    fits = "100 * least(x.n, y.n) >= {p} * greatest(x.n, y.n) and x.id <> y.id".format(p=percent)
    inside = f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> {fits}), y -> struct(least(x.id, y.id) as a, greatest(x.id, y.id) as b))))"
    return nodes.groupBy("path").agg(F.collect_list(F.struct("id", "n")).alias("m")).select(F.explode(F.expr(inside)).alias("p")).select("p.a", "p.b")


def sized(rows: DataFrame) -> DataFrame:
    """rows with c, the size of their node; rows that are alone go."""
    return rows.join(staged(rows.groupBy("path").agg(F.count("*").alias("c")).where("c > 1")), "path")


def candidates(reps: DataFrame, *, percent: int, trees: int, levels: int, small: int, rounds: int) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs (a, b) that meet in a node of some tree or with its leaders; and path and id of the nodes still large."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.slice("tokens", t * levels + 1, levels))
    rows = reps.select("id", "n", F.posexplode(cut).alias("tree", "toks")).withColumn("path", F.xxhash64("tree", F.col("toks")[0]))
    found = None
    for level in range(1, levels + 1):
        live = staged(sized(rows))
        pairs = exhaustive(live.where(F.col("c") <= small), percent)
        found = pairs if found is None else found.unionByName(pairs)
        rows = live.where(F.col("c") > small).drop("c")
        if rows.isEmpty():
            return found.distinct(), None
        if level < levels:
            rows = rows.withColumn("path", F.xxhash64("path", F.col("toks")[level]))
    dense = large = staged(rows.select("path", "id", "n").join(reps.select("id", "sketch"), "id"))
    for _ in range(rounds):
        if dense.isEmpty():
            break
        # The leader agrees most with the commonest values of the node; a mode's buffer holds 256 values at most.
        byte = [F.substring("sketch", 16 * i + 1, 1) for i in range(8)]
        common = staged(dense.groupBy("path").agg(*[F.mode(b).alias(f"m{i}") for i, b in enumerate(byte)]))
        agree = sum((b == F.col(f"m{i}")).cast("int") for i, b in enumerate(byte))
        lead = staged(dense.join(common, "path").select("path", "id", agree.alias("s")).groupBy("path").agg(F.max_by("id", F.struct("s", -F.col("id"))).alias("leader")))
        heads = lead.join(dense.select("path", F.col("id").alias("leader"), F.col("sketch").alias("other")), ["path", "leader"])
        compared = staged(estimated(dense.join(heads, "path").where("id <> leader")))
        found = found.unionByName(compared.where(F.col("estimate") >= least_estimate(percent)).select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")))
        rest = staged(sized(compared.where(F.col("estimate") < percent / 100 + 0.05).select("path", "id", "n", "sketch")))
        found = found.unionByName(exhaustive(rest.where(F.col("c") <= small), percent))
        dense = rest.where(F.col("c") > small).drop("c")
    return found.distinct(), large.select("path", "id")


def unsettled(large: DataFrame, roots: DataFrame) -> DataFrame:
    """id and root of the documents in nodes that are not one component."""
    rows = large.join(roots, F.col("id") == F.col("u"), "left").select("path", "id", F.coalesce("root", "id").alias("root"))
    mixed = staged(rows.groupBy("path").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("path"))
    return rows.join(mixed, "path").select("id", "root").distinct()


def prefixes(members: DataFrame, percent: int, width: int) -> DataFrame:
    """id, root, n, bits and the first shingles (item, at) of every text, rare ones first: sets of the similarity share one of them.

    The order is by the count of the shingle's bucket among members, then by value; any order that all sets share would do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), np.zeros(BUCKETS, np.int64)
        for batch in bounded(batches, "text", 4 << 20):
            for text in as_bytes(batch.column("text")):
                np.add.at(seen, (shingle_set(text, hashes, width) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["bucket", "n"])

    counts = members.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    weight = np.zeros(BUCKETS, np.int64)
    weight[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    shared = members.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weight = WordHashes(), shared.value
        for batch in bounded(batches, "text", 4 << 20):
            firsts, sizes, bits = [], [], []
            for text in as_bytes(batch.column("text")):
                s = shingle_set(text, hashes, width)
                order = np.lexsort((s, weight[(s % np.uint64(BUCKETS)).astype(np.int64)]))
                firsts.append(s[order[: len(s) - -(-percent * len(s) // 100) + 1]])
                sizes.append(len(s))
                bits.append(bitmap(s))
            k = [len(f) for f in firsts]
            owner = pa.array(np.repeat(np.arange(len(k)), k))
            at = np.concatenate([np.arange(x) for x in k])
            n = pa.array(np.repeat(sizes, k), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(owner), batch.column("root").take(owner), n, pa.array(bits, pa.binary()).take(owner), pa.array(np.concatenate(firsts).view(np.int64)), pa.array(at, pa.int64())], names=["id", "root", "n", "bits", "item", "at"])

    return members.mapInArrow(run, "id long, root long, n long, bits binary, item long, at long")


def crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots that share an item of their prefixes, where sizes, places and bitmaps allow a link.

    The rows of an item are dealt into parts of about BLOCK rows, and every two parts meet in a group of their own."""
    counts = staged(rows.groupBy("item").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("item", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")))
    dealt = rows.join(counts, "item").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = dealt.select(F.xxhash64("item", F.least("part", "other"), F.greatest("part", "other")).alias("meet"), (F.col("part") != F.col("other")).alias("across"), "part", "id", "root", "n", "at", "bits")
    columns = grouped.columns

    def pairs(across, part, ids, roots, n, at, bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(n, kind="stable")
        part, ids, roots, n, rest, bits = part[order], ids[order], roots[order], n[order], (n - at - 1)[order], bits[order]
        names, counts = np.unique(roots, return_counts=True)
        top = roots == names[counts.argmax()]
        for i in np.flatnonzero(~top):
            span = slice(*np.searchsorted(n, [-(-percent * n[i] // 100), 100 * n[i] // percent + 1]))
            new = (roots[span] != roots[i]) & (top[span] | (np.arange(span.start, span.stop) > i))
            if across[0]:
                new &= part[span] != part[i]
            fits = new & ((100 + percent) * (1 + np.minimum(rest[span], rest[i])) >= percent * (n[span] + n[i]))
            near = np.flatnonzero(fits) + span.start
            other = ids[near[can_link(bits[near], bits[i], n[near], n[i], percent)]]
            yield np.minimum(other, ids[i]), np.maximum(other, ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        held, found, size = None, [], 0
        for batch in chain(batches, [None]):  # sorted by group: the last one of a batch may go on in the next
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns[:-1]]
                new.append(np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1))
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            starts = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]])
            ends = np.r_[starts[1:], len(held[0])]
            done = len(starts) if batch is None else len(starts) - 1
            several = np.minimum.reduceat(held[4], starts) < np.maximum.reduceat(held[4], starts)
            for j in np.flatnonzero(several[:done]):
                for pair in pairs(*[x[starts[j] : ends[j]] for x in held[1:]]):
                    found.append(pair)
                    size += len(pair[0])
                    if size >= 100_000:
                        yield batch_of(found)
                        found, size = [], 0
            held = [x[starts[done] :] for x in held] if done < len(starts) else None
        if found:
            yield batch_of(found)

    return grouped.repartition("meet").sortWithinPartitions("meet").mapInArrow(run, "a long, b long").distinct()


def estimated(pairs: DataFrame) -> DataFrame:
    """pairs with estimate, the similarity that the columns sketch and other show; other is dropped."""
    names = [c for c in pairs.columns if c != "other"]
    pairs = pairs.select(*names, "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sketch", "other"))
            same = (a == b).mean(1) if len(a) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array((same - 1 / 256) / (1 - 1 / 256))], names=[*names, "estimate"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema[:-1]) + ", estimate double"
    return pairs.mapInArrow(run, schema)


def plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches and bitmaps let pass."""
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
            n_a, n_b, estimate = (batch.column(c).to_numpy() for c in ("n_a", "n_b", "estimate"))
            yield batch.select(["a", "b"]).filter(pa.array((estimate >= least) & can_link(x, y, n_a, n_b, percent)))

    return estimated(pairs).mapInArrow(run, "a long, b long")


def texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """texts (doc, row, text) of nodes (doc, row and others), one row a node, by a merge join at any size: nodes
    grow with the corpus and are never broadcast. Equal rows have one text."""
    return texts.join(nodes.hint("merge"), ["doc", "row"]).dropDuplicates(["doc", "row"])


def confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), "sketch", F.col("bits").alias("bits_a"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("other"), F.col("bits").alias("bits_b"))
    near = staged(plausible(pairs.join(one, "a").join(two, "b"), percent).distinct())
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    sets = staged(full_sets(texts_of(texts, reps.select("id", "doc", "row").join(ids, "id")).select("id", "text"), width))
    both = near.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    meet = both.select("a", "b", (F.size("x") + F.size("y")).alias("t"), F.size(F.array_intersect("x", "y")).alias("i"))
    return meet.where(F.col("i") * 100 >= percent * (F.col("t") - F.col("i"))).select("a", "b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root) of every node of edges (a, b) but the roots; root is the smallest id of the component."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small)
        now = print_of(edges)
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, *, text="text", key="doc_id", width: int = 5, percent: int = 80, trees: int = 12, levels: int = 4, small: int = 16, rounds: int = 6, row: str | None = None) -> DataFrame:
    """id, n_shingles, component_id and kept for every row; with row also the xxhash64 of its text, under that name."""
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    base = staged(signatures(texts.withColumnRenamed("doc", "id"), width, trees * levels))
    able = base.where("id is not null and n > 0")
    # A class is a node of the links; its number is fixed once it is written.
    classes = staged(able.groupBy("key").agg(F.min("id").alias("doc")).withColumn("node", F.monotonically_increasing_id()))
    firsts = able.join(classes.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("id") == F.col("doc")))
    reps = staged(firsts.select(F.col("node").alias("id"), "doc", "row", "n", "tokens", "sketch", "bits").dropDuplicates(["id"]))
    pairs, large = candidates(reps, percent=percent, trees=trees, levels=levels, small=small, rounds=rounds)
    links = staged(confirmed(pairs, reps, texts, percent, width))
    roots = components(links)
    if large is not None:
        left = staged(unsettled(large, roots))
        if not left.isEmpty():
            members = staged(texts_of(texts, left.join(reps.select("id", "doc", "row"), "id")).select("id", "root", "text"))
            pairs = staged(crossing(staged(prefixes(members, percent, width)), percent))
            roots = components(links.unionByName(confirmed(pairs, reps, texts, percent, width)))
    rooted = classes.join(roots, F.col("node") == F.col("u"), "left").select("key", "doc", F.coalesce("root", "node").alias("root"))
    named = rooted.join(staged(rooted.groupBy("root").agg(F.min("doc").alias("component"))), "root").select("key", "component")
    out = base.select("id", "row", "n", "key").join(named, "key", "left")
    component = F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), *([F.col("row").alias(row)] if row else [])).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op7_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, percent=85).withColumnRenamed("id", "doc_id")


#: All links by counting shared shingles, and components by reachability.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w WHERE len(words) >= 5),
x AS (SELECT doc_id, CASE WHEN lead(i, 4) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) END AS s FROM t),
sh AS (SELECT DISTINCT doc_id, s FROM x WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 85 * (na.n + nb.n - p.i)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, sides.b FROM reach JOIN sides ON reach.y = sides.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
