"""Cross-tokenizer alignment: byte ranges of a text as fragments of an associative monoid.

Two vocabularies cut the same bytes into tokens. Where a token of both ends, a group of tokens is complete and its
two last tokens are linked. What a byte range says of the groups is a fragment: the tokens up to the first common
end (they close a group that began before), the groups between common ends, and the tokens after the last one; or, without
a common end, open tokens only. Fragments of neighbouring ranges compose, and in any bracketing to the same.

Both tokenizers always cut between a character and a single space or line feed after it that another character
follows (checked on loading for the second vocabulary; white space on either side rules a cut out). Stretches between
such cuts, mostly words, are tokenized on their own and remembered: each is a fragment with nothing open, so a
text of one range is the product of its words' fragments. A text of more bytes than a range holds is cut into ranges at
fixed distances, wherever that falls in a word; each range goes to another task with the rest of its first and last
word, tokenizes these and keeps the tokens that end in it. A tree of groups of 16 neighbours then composes
the fragments of a text across tasks. A word longer than a range is not cut.

Links are counted over all texts by pairs of ids; the table of pairs is broadcast only when it has at most
`broadcast_pairs` rows, and joined by shuffle otherwise.

Defined cases: null and empty texts, texts that are not UTF-8, and texts whose tokens of either vocabulary do not
spell space + text (those that hold U+2581) have no tokens: zeros, an empty hash, and no part in the counts. Rows
stay as many as they are, equal ones too. The columns in keep pass through, but for those named like a new
column. Special tokens inside texts are plain text. The groups of one text must fit a binary cell (2 GB), as their
hash is taken in order.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded, staged

RANGE = 64 << 10  # bytes of a range
FAN = 16  # fragments composed at a time
BROADCAST_PAIRS = 2_000_000  # rows of a table of pairs that may be broadcast, some 50 MB
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
MARK = "▁"
NONE = np.zeros(0, np.int64)


@dataclass
class Fragment:
    """What a byte range says of the groups. Without a common end (cut) all its tokens are in head."""

    cut: bool = False
    head_a: list[int] = field(default_factory=list)
    head_b: list[int] = field(default_factory=list)
    closed: bytes = b""
    tail_a: list[int] = field(default_factory=list)
    tail_b: list[int] = field(default_factory=list)

    def __mul__(self, other: Fragment) -> Fragment:
        if not self.cut:
            return Fragment(other.cut, self.head_a + other.head_a, self.head_b + other.head_b, other.closed, other.tail_a, other.tail_b)
        tail_a, tail_b = self.tail_a + other.head_a, self.tail_b + other.head_b
        if not other.cut:
            return Fragment(True, self.head_a, self.head_b, self.closed, tail_a, tail_b)
        closed = b";".join(filter(None, (self.closed, written(tail_a, tail_b), other.closed)))
        return Fragment(True, self.head_a, self.head_b, closed, other.tail_a, other.tail_b)

    def whole(self) -> bytes:
        """The groups of a whole text."""
        return b";".join(filter(None, (written(self.head_a, self.head_b), self.closed))) if self.cut else b""


def written(a: Iterable[int], b: Iterable[int]) -> bytes:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()


def fragment(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[Fragment, np.ndarray, np.ndarray]:
    """The fragment of tokens and their ends, and the linked ids on both sides."""
    common, ia, ib = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    a_list, b_list = a.tolist(), b.tolist()
    if not len(common):
        return Fragment(False, a_list, b_list), a[:0], b[:0]
    ja, jb = (ia + 1).tolist(), (ib + 1).tolist()
    closed = b";".join(written(a_list[p:q], b_list[r:s]) for p, q, r, s in zip(ja, ja[1:], jb, jb[1:]))  # noqa: B905
    return Fragment(True, a_list[: ja[0]], b_list[: jb[0]], closed, a_list[ja[-1] :], b_list[jb[-1] :]), a[ia], b[ib]


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both vocabularies, from the contents of their files."""

    def __init__(self, first: str, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        letters = byte_of_letter()
        spelled = {i: bytes(letters[c] for c in token) for token, i in json.loads(first)["model"]["vocab"].items()}
        self.bytes_a = [spelled.get(i, b"") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.encode().replace(MARK.encode(), b" ") for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the second vocabulary must hold space marks at the start of its pieces only, and no line feeds")
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def tokens(self, words: list[str]) -> list[tuple[list[int], list[int], bool]]:
        """Ids of both for stretches between cuts (each with the space or line feed before it), and whether they spell it."""
        raw = [w.encode() for w in words]
        a = self.first_ids(words, raw)
        # A space mark is put in front: for the space of a word, or to be taken off before a line feed.
        b = [ids[1:] if w[0] == "\n" else ids for w, ids in zip(words, self.b.encode([w if w[0] == "\n" else w[1:] for w in words], num_threads=1), strict=True)]
        spelled = [[b"".join([table[i] for i in ids]) for ids in side] for table, side in ((self.bytes_a, a), (self.bytes_b, b))]
        return [(x, y, r == p == q) for x, y, r, p, q in zip(a, b, raw, *spelled, strict=True)]

    def first_ids(self, words: list[str], raw: list[bytes]) -> list[list[int]]:
        """Ids of the byte-level vocabulary. Words that are cut from their neighbours anyway are tokenized some hundred at a
        time, as one text."""
        out: list[list[int]] = [[]] * len(words)
        apart = []
        joined = [i for i, w in enumerate(words) if len(w) > 1 and not w[1].isspace() and not w[-1].isspace() or apart.append(i)]
        groups = [joined[i : i + 500] for i in range(0, len(joined), 500)]
        for some, e in zip(groups, self.a.encode_batch_fast(["".join([words[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            ends, due = self.len_a[ids].cumsum(), np.cumsum([len(raw[i]) for i in some])
            at = np.searchsorted(ends, due)
            if len(ids) and at[-1] < len(ids) and (ends[at] == due).all():
                for i, low, high in zip(some, [0, *(at[:-1] + 1).tolist()], (at + 1).tolist(), strict=True):
                    out[i] = ids[low:high]
            else:
                apart += some
        for i, e in zip(apart, self.a.encode_batch_fast([words[i] for i in apart], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


class Words:
    """Fragments of words, each tokenized once; rare ones are forgotten when they take too much room. Numbers and links of all words
    are held in arrays; a batch of new words is aligned in one go, as if they were one text."""

    def __init__(self, tokenizers: Tokenizers, limit: int = 64 << 20):
        self.tokenizers, self.limit = tokenizers, limit
        n = [len(tokenizers.bytes_a), len(tokenizers.bytes_b)]
        self.base = n[1]
        # how a token is written inside a group and at the end of its side
        self.forms = [[np.array([f"{i}{mark}" for i in range(k)], object) for mark in marks] for k, marks in zip(n, (",|", ",;"), strict=True)]
        self.width = [np.array([len(x) for x in forms[0]], np.int64) for forms in self.forms]
        self.forget()

    def forget(self):
        self.ids: dict[str, int] = {}
        self.closed: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)  # tokens of both, groups, whether it is spelled
        self.first, self.links = np.zeros(1, np.int64), NONE  # the links of word i from first[i] to first[i + 1]
        self.used = NONE  # how many texts each word was in, since room was last made
        self.room = 0

    def make_room(self) -> None:
        """Forget the words that were in one text only, and all of them if that is not half."""
        kept = np.flatnonzero(self.used > 1)
        if 2 * len(kept) > len(self.closed):
            self.forget()
            return
        names, n = np.array(list(self.ids), object)[kept].tolist(), np.diff(self.first)[kept]
        self.links = self.links[np.repeat(self.first[kept], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        self.ids, self.closed, self.counts = dict(zip(names, range(len(kept)), strict=True)), [self.closed[i] for i in kept.tolist()], self.counts[kept]
        self.first, self.used = np.r_[0, np.cumsum(n)], np.zeros(len(kept), np.int64)
        self.room = 300 * len(kept) + sum(map(len, self.closed)) + 8 * len(self.links)

    def learn(self, words: set[str]) -> None:
        if self.room > self.limit:
            self.make_room()
        new = list(words - self.ids.keys())
        if not new:
            return
        t = self.tokenizers
        tokens = t.tokens(new)
        ok = np.array([x[2] for x in tokens])
        self.ids.update(zip(new, range(len(self.closed), len(self.closed) + len(new)), strict=True))
        a, b = (np.fromiter(chain.from_iterable(x[side] for x in tokens if x[2]), np.int64) for side in (0, 1))
        n_a, n_b = (np.array([len(x[side]) if x[2] else 0 for x in tokens], np.int64) for side in (0, 1))
        ends_a, ends_b = t.len_a[a].cumsum(), t.len_b[b].cumsum()
        common, ia, ib = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        groups = np.searchsorted(ia, n_a.cumsum(), side="left")  # groups before the end of each word
        n_groups = np.diff(np.r_[0, groups])
        # write the groups: the tokens of one side after those of the other, in place
        ga, gb = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        at_a, at_b = np.arange(len(a)) + np.r_[0, ib[:-1] + 1][ga] if len(a) else NONE, np.arange(len(b)) + ia[gb] + 1 if len(b) else NONE
        text, width = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
        for (inside, last), ids, at, ends, wide in zip(self.forms, (a, b), (at_a, at_b), (ia, ib), self.width, strict=True):
            text[at] = inside[ids]
            text[at[ends]] = last[ids[ends]]
            width[at] = wide[ids]
        line, stops = "".join(text.tolist()).encode(), np.r_[0, width.cumsum()][(n_a + n_b).cumsum()].tolist()
        self.closed += [line[low : max(low, high - 1)] for low, high in zip([0, *stops], stops)]  # noqa: B905
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, ok], axis=1)])
        self.links = np.concatenate([self.links, a[ia] * self.base + b[ib]])
        self.first = np.r_[self.first, self.first[-1] + groups]
        self.used = np.r_[self.used, np.zeros(len(new), np.int64)]
        self.room += 300 * len(new) + len(line) + 8 * len(ia)

    def texts(self, texts: list[list[str]]) -> list[tuple]:
        """For each text (its words): spelled, tokens of both, groups, linked pairs and how often each is, hash of the groups."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = list(map(self.ids.__getitem__, chain.from_iterable(texts)))
        at, owner = np.array(flat, np.int64), np.repeat(np.arange(len(texts)), sizes)
        sums = np.zeros((len(texts), 4), np.int64)
        np.add.at(sums, owner, self.counts[at]) if len(at) else None
        spelled = (sums[:, 3] == sizes) & (sizes > 0)
        sums[~spelled] = 0
        # words, then pairs, each once a text with the number of its places
        some = spelled[owner]
        used, times = np.unique(owner[some] * len(self.closed) + at[some], return_counts=True)
        who, word = np.divmod(used, max(1, len(self.closed)))
        self.used += np.bincount(word, minlength=len(self.closed))
        n = np.diff(self.first)[word]
        place = np.repeat(self.first[word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.repeat(who, n) * PAIRS + self.links[place]
        pairs, where = np.unique(key, return_inverse=True)
        total = np.bincount(where, weights=np.repeat(times, n), minlength=len(pairs)).astype(np.int64)
        edges = np.searchsorted(pairs, np.arange(len(texts) + 1) * PAIRS).tolist()
        pairs %= PAIRS
        out, low = [], 0
        for i, size in enumerate(sizes.tolist()):
            hashed = hashlib.sha256(b";".join([self.closed[w] for w in flat[low : low + size]])).hexdigest() if spelled[i] else ""
            out.append((bool(spelled[i]), *sums[i, :3].tolist(), pairs[edges[i] : edges[i + 1]], total[edges[i] : edges[i + 1]], hashed))
            low += size
        return out


PAIRS = 1 << 40  # more than there are pairs of ids


def ranges(words: list[str], size: int) -> Iterator[tuple[int, bytes, int, int]]:
    """Byte ranges of a text: number, bytes of the words that it touches, and where it starts and ends in them."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    marks = np.arange(size, int(ends[-1]), size)
    unit = np.searchsorted(ends, marks)  # the word whose bytes go over the mark, or end there
    starts = ends - [len(w) for w in raw]
    marks = marks[(ends - starts)[unit] <= size]
    edges = [0, *marks.tolist(), int(ends[-1])]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):  # noqa: B905
        first, last = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(ends, high))
        yield i, b"".join(raw[first : last + 1]), low - int(starts[first]), high - int(starts[first])


PARTS = "head_a array<int>, head_b array<int>, closed binary, tail_a array<int>, tail_b array<int>"


def lists(columns: list, kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(columns) if columns else NONE
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(c) for c in columns])], pa.int32()), pa.array(flat, kind))


def align(docs: DataFrame, first: str, second: str, *, text="text", keep=("doc_id",), size: int = RANGE, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """keep, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; first and second are the files of the
    byte-level and of the piece vocabulary."""
    spark = docs.sparkSession
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    keep = [c for c in keep if c.lower() not in made]
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))  # two vocabularies, some MB
    n_a, n_b = len(json.loads(files.value[0])["model"]["vocab"]) + 1, Tokenizers(*files.value).b.get_piece_size()
    kind, pair = (pa.int32(), "int") if n_a * n_b < 1 << 31 else (pa.int64(), "long")
    kept = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Tokenizers(*files.value))
        for batch in bounded(batches, "_text", 2 << 20):
            texts: list[list[str]] = []
            for raw in as_bytes(batch.column("_text")):
                try:
                    texts.append(CUT.split(" " + raw.decode()) if raw else [])
                except UnicodeDecodeError:
                    texts.append([])
            long = [t and sum(map(len, t)) > size // 4 and len("".join(t).encode()) > size for t in texts]
            words.learn({w for t, big in zip(texts, long, strict=True) if not big for w in t})
            at = [i for i, big in enumerate(long) if not big]
            out = [(*x, 0, None, 0, 0) for x in words.texts([texts[i] for i in at])]
            for i in [i for i, big in enumerate(long) if big]:
                for n, raw, low, high in ranges(texts[i], size):
                    out.append((None, 0, 0, 0, NONE, NONE, "", n, raw, low, high))
                    at.append(i)
            for a in range(0, len(out), 1024):
                cols = list(zip(*out[a : a + 1024], strict=True))
                side = batch.select(batch.schema.names[:-1]).take(pa.array(at[a : a + 1024]))
                arrays = [pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[1:4]), lists(list(cols[4]), kind), lists(list(cols[5]), pa.int32()), pa.array(cols[6], pa.string()),
                          pa.array(cols[7], pa.int32()), pa.array(cols[8], pa.binary()), pa.array(cols[9], pa.int32()), pa.array(cols[10], pa.int32())]
                yield pa.RecordBatch.from_arrays([*side.columns, *arrays], names=[*side.schema.names, "ok", "n_a", "n_b", "n_groups", "pairs", "times", "groups_sha256", "n", "raw", "low", "high"])

    found = staged(kept.mapInArrow(read, f"{named}, ok boolean, n_a long, n_b long, n_groups long, pairs array<{pair}>, times array<int>, groups_sha256 string, n int, raw binary, low int, high int"))

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(*files.value)
        for batch in batches:
            for r in batch.to_pylist():
                words = CUT.split(r["raw"].decode())
                some = list(dict.fromkeys(words))
                known = dict(zip(some, t.tokens(some), strict=True))
                ok = all(x[2] for x in known.values())
                a, b = (np.concatenate([NONE, *(np.array(known[w][s], np.int64) for w in words)]) for s in (0, 1))
                ends_a, ends_b = t.len_a[a].cumsum(), t.len_b[b].cumsum()
                in_a, in_b = ((r["low"] < e) & (e <= r["high"]) & ok for e in (ends_a, ends_b))
                f, la, lb = fragment(a[in_a], ends_a[in_a], b[in_b], ends_b[in_b])
                pairs, times = np.unique(la * len(t.bytes_b) + lb, return_counts=True)
                row = {"_row": r["_row"], "n": r["n"], "ok": ok, "n_a": int(in_a.sum()), "n_b": int(in_b.sum()), "n_groups": len(la), "pairs": pairs.tolist(), "times": times.tolist(), **vars(f)}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("_row", pa.int64()), ("n", pa.int32()), ("ok", pa.bool_()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups")), ("pairs", pa.list_(kind)), ("times", pa.list_(pa.int32())), *FIELDS]))

    parts = staged(found.where("raw is not null").select("_row", "n", "raw", "low", "high").repartition("_row", "n").mapInArrow(tokenized, f"_row long, n int, ok boolean, n_a long, n_b long, n_groups long, pairs array<{pair}>, times array<int>, cut boolean, {PARTS}"))
    long = parts.groupBy("_row").agg(F.min("ok").alias("ok"), *[F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")])
    long = long.join(hashes(parts.select("_row", "n", "cut", *[name for name, _ in FIELDS[1:]])), "_row").select("_row", "ok", *[F.when(F.col("ok"), F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b", "n_groups")], F.when(F.col("ok"), F.col("groups_sha256")).otherwise("").alias("groups_sha256"))
    long = staged(long)
    links = found.where("ok").select("_row", "pairs", "times").unionByName(parts.join(long.where("ok").select("_row"), "_row").select("_row", "pairs", "times"))
    single = links.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("k"))
    counts = single.groupBy("pair").agg(F.sum("k").alias("count"))
    counts = staged(counts.withColumn("b", F.col("pair") % n_b))
    best = counts.groupBy("b").agg(F.max("count").alias("top"))  # a row an id of the second vocabulary
    table = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("is_best"))
    table = F.broadcast(table) if counts.count() <= broadcast_pairs else table
    scores = single.join(table, "pair").groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("count")).alias("count_sum"))
    short = found.where("raw is null").select(*keep, "_row", "n_a", "n_b", "n_groups", "groups_sha256")
    rest = found.where("raw is not null and n = 0").select(*keep, "_row").join(long.drop("ok"), "_row").select(*short.columns)
    out = short.unionByName(rest).join(scores, "_row", "left")
    return out.select(*keep, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


FIELDS = [("cut", pa.bool_()), ("head_a", pa.list_(pa.int32())), ("head_b", pa.list_(pa.int32())), ("closed", pa.binary()), ("tail_a", pa.list_(pa.int32())), ("tail_b", pa.list_(pa.int32()))]


def hashes(parts: DataFrame) -> DataFrame:
    """_row and groups_sha256 of fragments (_row, n, cut and the rest): a tree that composes 16 neighbours at a time."""
    most = parts.agg(F.max("n")).first()[0] or 0

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                product = Fragment()
                for x in r["parts"]:
                    product = product * Fragment(**{name: x[name] for name, _ in FIELDS})
                yield pa.RecordBatch.from_pylist([{"_row": r["_row"], "n": r["n"], **vars(product)}], schema=pa.schema([("_row", pa.int64()), ("n", pa.int32()), *FIELDS]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                groups = Fragment(**{name: r[name] for name, _ in FIELDS}).whole()
                yield pa.RecordBatch.from_pylist([{"_row": r["_row"], "groups_sha256": hashlib.sha256(groups).hexdigest()}], schema=pa.schema([("_row", pa.int64()), ("groups_sha256", pa.string())]))

    while most > 0:
        near = parts.groupBy("_row", (F.col("n") / FAN).cast("int").alias("g")).agg(F.sort_array(F.collect_list(F.struct("n", *[name for name, _ in FIELDS]))).alias("parts"))
        parts = near.select("_row", F.col("g").alias("n"), "parts").mapInArrow(compose, f"_row long, n int, cut boolean, {PARTS}")
        most //= FAN
    return parts.mapInArrow(finish, "_row long, groups_sha256 string")


def default_paths() -> tuple[str, str]:
    """The vocabularies of the query: public ones in the folder that TOKENIZERS_DIR names (else /opt/tokenizers)."""
    folder = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
    return os.path.join(folder, "byte_bpe_50k.json"), os.path.join(folder, "piece_bpe_32k.model")


def op11_tokenizer_alignment(docs: DataFrame) -> DataFrame:
    return align(docs, *default_paths())
