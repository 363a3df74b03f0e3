"""Deduplication of word passages across documents, by level-wise doubling of windows.

A window is `size` consecutive words of one document. A word goes if a window covers it whose words
also start in a document with a smaller id. Whole equal texts are settled first, by one hash. Levels have
windows of a quarter, a half and all of the size (13, 25 and 50 words). The first level takes windows
at the minimizers of their neighbourhood only: every full window contains the same one wherever it stands, so
none is lost. Windows that are in one document alone end there; those repeated are extended to twice the length,
after them or, where the full window ends first, before them; those still repeated are extended again, to
all full windows around them. What is repeated at the full length is covered from its second document on.

Hot windows (a passage in a third of all documents) are counted with map-side combining. The counts are
written before they are joined back: between two plain tables Spark can split the rows of a hot key.

Defined cases: null and empty texts have no words; texts shorter than a window keep theirs. Ties are
between documents, so windows repeated only within one document stay. Rows with equal id count as one
document when windows are compared, but each row, whatever its id, loses only what its own text has in
common with smaller ids. A row with a null id is compared with nothing and keeps its words. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, bounded, mixed, staged, window_hashes

SIZE = 50


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the (leftmost) smallest value of some run of `width` values."""
    if len(h) < width:
        return np.array([], np.int64)
    found = []
    for a in range(0, len(h) - width + 1, 1 << 16):
        runs = sliding_window_view(h[a : a + (1 << 16) + width - 1], width)
        found.append(np.unique(runs.argmin(1) + np.arange(a, a + len(runs))))
    return np.unique(np.concatenate(found))


def text_key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=12).digest()


def to_int64(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lengths(size: int) -> tuple[int, int, int]:
    """Words of a window at each level; each at most twice as long as the one before."""
    half = -(-size // 2)
    return -(-half // 2), half, size


def first_level(texts: DataFrame, size: int) -> DataFrame:
    """id, row, n_words, key (of the word sequence), and places of the minimizers with the hashes of the windows
    there: short, and extended after them and before them (null where the text ends)."""
    short, half, _ = lengths(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in bounded(batches, "text", 8 << 20):
            n, keys, places, found, ends = [], [], [], ([], [], []), [0]
            for text in as_bytes(batch.column("text")):
                words = text.split() if text else []
                n.append(len(words))
                keys.append(text_key(words))
                h = hashes.of(words) if len(words) >= size else np.zeros(0, np.uint64)
                small, large = mixed(window_hashes(h, short), 3), window_hashes(h, half)
                at = minimizers(small, size - short + 1)
                places.append(at)
                found[0].append(small[at])
                for out, start in zip(found[1:], (at, at + short - half), strict=True):
                    there = (start >= 0) & (start < len(large))
                    out.append(np.where(there, large[np.where(there, start, 0)], np.uint64(0)) if len(at) else small[at])
                ends.append(ends[-1] + len(at))
            windows = pa.StructArray.from_arrays([pa.array(np.concatenate(places).astype(np.int32)), *(to_int64(np.concatenate(x)) for x in found)], names=["place", "h", "after", "before"])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), windows)], names=["id", "row", "n_words", "key", "windows"])

    return texts.mapInArrow(run, "id long, row long, n_words long, key binary, windows array<struct<place:int,h:long,after:long,before:long>>")


def full_windows(texts: DataFrame, size: int) -> DataFrame:
    """id, row, start and hash of every full window that contains an anchor: a short window whose extension on the
    side given (after, before) lies in it."""
    short, half, _ = lengths(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in bounded(batches, "text", 4 << 20):
            starts, values = [], []
            for text, after, before in zip(as_bytes(batch.column("text")), batch.column("after").to_pylist(), batch.column("before").to_pylist(), strict=True):
                words = text.split()
                # the extension after an anchor is used by the windows that hold it, else the one before
                near = [np.array(after, np.int64)[:, None] - np.arange(size - half + 1), np.array(before, np.int64)[:, None] - np.arange(size - half + 1, size - short + 1)]
                near = np.unique(np.concatenate([x.ravel() for x in near]))
                near = near[(near >= 0) & (near <= len(words) - size)]
                starts.append(near)
                values.append(window_hashes(hashes.of(words), size)[near])
            owner = pa.array(np.repeat(np.arange(len(starts)), [len(x) for x in starts]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(owner), batch.column("row").take(owner), pa.array(np.concatenate(starts).astype(np.int32)), to_int64(np.concatenate(values))], names=["id", "row", "start", "h"])

    return texts.mapInArrow(run, "id long, row long, start int, h long")


def repeated_elsewhere(rows: DataFrame, key: str, smallest: str) -> DataFrame:
    """key and the smallest id of those keys that two ids or more have."""
    return rows.groupBy(key).agg(F.min("id").alias(smallest), F.max("id").alias("_top")).where(F.col(smallest) < F.col("_top")).drop("_top")


def survivors(rows: DataFrame) -> DataFrame:
    """The windows (id, h and others) whose h other ids have too."""
    return rows.join(staged(repeated_elsewhere(rows, "h", "_least").select("h")), "h", "left_semi")


def covered(docs: DataFrame, *, text="text", key="doc_id", size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Two tables: (id, row, n_words, copy) of every row, copy if a smaller id has the same words; and
    (id, row, starts) of the windows to remove of the others. row is the text's hash."""
    texts = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    base = staged(first_level(texts, size))
    classes = staged(base.where("id is not null and n_words > 0").groupBy("key").agg(F.min("id").alias("original")))
    known = base.select("id", "row", "n_words", "key").join(classes, "key", "left")
    rows = staged(known.select("id", "row", "n_words", F.coalesce(F.col("original") < F.col("id"), F.lit(False)).alias("copy")))
    whole = base.where("id is not null and size(windows) > 0").select("id", "row", "windows")
    alone = whole.join(rows.where("copy").select("id", "row").distinct(), ["id", "row"], "left_anti").dropDuplicates(["id", "row"])
    shorts = staged(alone.select("id", "row", F.inline("windows")))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("later"), F.col("after").alias("h")), F.struct(F.lit(False).alias("later"), F.col("before").alias("h"))))
    halves = staged(survivors(shorts.select("id", "row", "place", "h", "after", "before")).select("id", "row", "place", sides.alias("x")).select("id", "row", "place", "x.later", "x.h").where("h <> 0"))
    places = lambda later: F.sort_array(F.collect_set(F.when(F.col("later") == later, F.col("place"))))
    anchors = survivors(halves).groupBy("id", "row").agg(places(True).alias("after"), places(False).alias("before"))
    found = texts.join(anchors, ["id", "row"]).dropDuplicates(["id", "row"])
    windows = staged(full_windows(found.select("id", "row", "text", "after", "before"), size))
    gone = windows.join(staged(repeated_elsewhere(windows, "h", "least")), "h").where("least < id")
    return rows, gone.groupBy("id", "row").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def mask(n: int, starts, size: int) -> np.ndarray:
    """Which of n words windows of this size cover."""
    edge = np.zeros(n + size + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge)[:n] > 0


def remove(docs: DataFrame, *, text="text", key="doc_id", size: int = SIZE) -> DataFrame:
    """key, n_words, n_removed and kept (the words left, joined by one space) of every row."""
    rows, gone = covered(docs, text=text, key=key, size=size)
    copies = rows.where("copy and n_words >= %d" % size).select("id", "row").distinct().withColumn("copy", F.lit(True))
    texts = docs.select(F.col(key).alias(key), F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("text"))
    marked = gone.join(copies, ["id", "row"], "full_outer").select(F.col("id").alias("_id"), F.col("row").alias("_row"), "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    joined = texts.join(marked, ["_id", "_row"], "left").select(key, "text", "starts", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text", 8 << 20):
            n, removed, kept = [], [], []
            for value, starts, copy in zip(as_bytes(batch.column("text")), batch.column("starts").to_pylist(), batch.column("copy").to_pylist(), strict=True):
                words = value.split() if value else []
                n.append(len(words))
                if copy:
                    words = []
                elif starts:
                    words = [w for w, m in zip(words, mask(len(words), starts, size).tolist(), strict=True) if not m]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pc.cast(pa.array(kept, pa.binary()), pa.string())], names=[key, "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept string")


def op8_substring_dedup(docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
h AS (SELECT doc_id, i, CASE WHEN lead(i, 49) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS h FROM t),
f AS (SELECT h, min(doc_id) AS least FROM h WHERE h IS NOT NULL GROUP BY h),
gone AS (SELECT DISTINCT h.doc_id, h.i + k.k AS i FROM h JOIN f ON h.h = f.h AND f.least < h.doc_id CROSS JOIN range(0, 50) AS k(k)),
kept AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT w.doc_id, cast(len(w.words) AS bigint) AS n_words, cast(coalesce(kept.n_removed, 0) AS bigint) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
