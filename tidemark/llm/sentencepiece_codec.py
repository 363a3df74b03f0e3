"""Encoding with SentencePiece vocabularies and back, by streaming Viterbi.

The lattice of a text has a boundary after each character and an edge for each piece that ends there.
Unigram models score paths by the sum of piece scores. In BPE models a path is possible only if every
two neighbouring pieces, merged alone from characters by the model's priorities, come out as just these
two; then exactly one path reaches each boundary, and it is the model's encoding (a merge that crossed a
boundary of the path would cross it in the pair around it too). Both run in one window: a boundary is
extended by the longest piece at most, so whenever the paths back from all boundaries that can still
be extended meet in one boundary, the ids before it are final and are given out, and the window moves on.

Pieces that hold the space mark hold it at their start in the usual vocabularies (checked on loading).
Then paths always meet between a word and the mark before the next, so that words met before need no second
search: the new words of a slice go through the lattice once, in order, and a word goes on from the boundary
up to which it equals the one before. Characters that no piece covers become byte pieces, or the unknown id
where the model has none.

Defined cases: a null text has null ids, an empty one no ids. Rows stay as many as they are; the columns in
keep pass through, but for those named like a new column. decode() of null is null; ids that are controls
give nothing; ids out of range raise. Model files of other kinds than BPE and unigram, with pieces defined
by users, rules of normalisation or another treatment of spaces raise on loading.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded

MARK = "▁"
LONG = 256  # characters of a word that is remembered
KINDS = {1: "unigram", 2: "bpe"}  # fixed values: the file format's numbers of model kinds


@dataclass
class Pieces:
    """A vocabulary as plain data, so that tasks need neither the file nor the library."""

    pieces: list[str]
    scores: list[float]
    special: set[int]  # unknown, control and unused ids
    bytes_at: dict[int, int]  # byte -> id
    unknown: int = 0
    kind: str = "bpe"
    ids: dict[str, int] = field(default_factory=dict)
    longest: int = 1
    separable: bool = True
    worst: float = 0.0  # score of a character that no piece covers
    tails: set[str] = field(default_factory=set)  # all endings of pieces
    pairs: dict[tuple[str, str], bool] = field(default_factory=dict)  # which pieces may follow each other, as far as asked

    def __post_init__(self):
        byte_ids = set(self.bytes_at.values())
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in byte_ids}
        self.worst = min(self.scores, default=0.0) - 10
        self.tails = {p[i:] for p in self.ids for i in range(len(p))}
        self.longest = max(map(len, self.ids), default=1)
        self.separable = not any(MARK in p.lstrip(MARK) for p in self.ids)

    @staticmethod
    def load(path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            m.ParseFromString(file.read())
        rules, t = m.normalizer_spec, m.SentencePiece
        if m.trainer_spec.model_type not in KINDS or any(p.type == t.USER_DEFINED for p in m.pieces):
            raise ValueError("only BPE and unigram models without user-defined pieces are supported")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep text as it is and mark spaces in front of words are supported")
        kinds = [p.type for p in m.pieces]
        special = {i for i, kind in enumerate(kinds) if kind in (t.UNKNOWN, t.CONTROL, t.UNUSED)}
        bytes_at = {int(m.pieces[i].piece[1:-1], 16): i for i, kind in enumerate(kinds) if kind == t.BYTE}
        return Pieces([p.piece for p in m.pieces], [p.score for p in m.pieces], special, bytes_at, kinds.index(t.UNKNOWN), KINDS[m.trainer_spec.model_type])


class Lattice:
    """The window of a streaming Viterbi search: characters from boundary `base` on, with the piece that the
    best path to each boundary ends with and that path's score."""

    def __init__(self, model: Pieces, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.restart()

    def restart(self):
        self.base, self.text, self.last, self.best, self.due = 0, "", [""], [0.0], 4 * self.model.longest
        self.final: list[int] = []  # ids given out since the start, or since they were last fetched

    def rewind(self, n: int) -> bool:
        """Forget all but the first n characters; False, and forget all, where the window has left them."""
        if self.base:
            self.restart()
            return False
        self.text = self.text[:n]
        del self.last[n + 1 :], self.best[n + 1 :]
        return True

    def merged(self, text: str) -> list[str]:
        """The symbols that are left when the best adjacent pair is merged again and again."""
        ids, scores = self.model.ids, self.model.scores
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                found = ids.get(s[i] + s[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def fits(self, before: str, piece: str) -> bool:
        """Whether piece may follow before ('' at the start)."""
        pairs = self.model.pairs
        if len(pairs) >= self.limit:
            pairs.clear()
        ok = pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return ok

    def push(self, chars: str) -> None:
        """Extend the paths by chars. Ids that become final are added to `final`."""
        m, last, best = self.model, self.last, self.best
        ids, tails, pairs, scores, bpe, worst = m.ids, m.tails, m.pairs, m.scores, m.kind == "bpe", m.worst
        text, at = self.text + chars, len(self.text)
        while at < len(text):
            start, piece, top, got = at, text[at], -np.inf, ""
            at += 1
            while True:  # from the shortest piece that ends here to the longest
                if piece in ids or start == at - 1:
                    if bpe:
                        ok = pairs.get((last[start], piece))
                        if ok or (ok is None and self.fits(last[start], piece)):
                            got = piece
                            break
                    else:
                        score = best[start] + (scores[ids[piece]] if piece in ids else worst)
                        if score >= top:
                            top, got = score, piece
                start -= 1
                if start < 0 or piece not in tails:
                    break
                piece = text[start:at]
            last.append(got)
            if not bpe:
                best.append(top)
            if at >= self.due:
                keep = self.meeting(at)
                if keep:
                    self.final.extend(self.path(keep))
                    # the piece before the new base still decides what may follow it
                    text, at = text[keep:], at - keep
                    del last[:keep], best[:keep]
                    self.base += keep
                self.due = at + 4 * m.longest
        self.text = text

    def before(self, at: int) -> int:
        """The boundary before `at` on its path; a path ends at the window's first boundary."""
        return max(0, at - len(self.last[at]))

    def meeting(self, end: int) -> int:
        """The last boundary that the paths back from all boundaries that can still be extended have in common."""
        ends = set(range(max(0, end - self.model.longest + 1), end + 1))
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(self.before(top))
        return ends.pop()

    def path(self, end: int) -> list[int]:
        m, out = self.model, []
        while end > 0:
            piece = self.last[end]
            if piece in m.ids:
                out.append(m.ids[piece])
            elif m.bytes_at:
                out.extend(m.bytes_at[b] for b in reversed(piece.encode("utf-8", "surrogatepass")))
            else:
                out.append(m.unknown)
            end = end - len(piece) if end > len(piece) else 0
        out.reverse()
        return out

    def fetch(self) -> list[int]:
        """The ids that became final since the last call."""
        given, self.final = self.final, []
        return given

    def all(self) -> list[int]:
        """The ids not fetched yet, if the text ends here."""
        return self.final + self.path(len(self.text))


def stream(chars: Iterable[str], model: Pieces) -> Iterator[list[int]]:
    """Ids of the text that chars (strings of any lengths) make up, given out as soon as they are final."""
    lattice = Lattice(model)
    for more in chars:
        lattice.push(more)
        if lattice.final:
            yield lattice.fetch()
    yield lattice.all()


class Codec:
    """Encoder and decoder over Pieces. Remembers up to `limit` words as packed ids, some 200 bytes each."""

    def __init__(self, model: Pieces, limit: int = 600_000):
        self.model, self.limit = model, limit
        self.code = "H" if len(model.pieces) <= 1 << 16 else "I"
        self.lattice = Lattice(model)
        self.words: dict[str, bytes] = {}  # a word and the space before it
        self.lines: dict[str, bytes] = {}  # a line after a line feed within a word
        table = [b"" if i in model.special else p.encode() for i, p in enumerate(model.pieces)]
        for b, i in model.bytes_at.items():
            table[i] = bytes([b])
        self.spelled = np.empty(len(table), dtype=object)  # what the decoder joins: the bytes of each id
        self.spelled[:] = table
        # Where no piece holds a line feed, paths meet on both sides of it.
        self.feed = self.pack([model.bytes_at[10]]) if model.bytes_at and not any("\n" in p for p in model.ids) else None

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        return stream(chars, self.model)

    def pack(self, ids: Iterable[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def learn(self, units: Iterable[str], mark: str, found: dict[str, bytes]) -> None:
        """Packed ids of units, each after mark: through the lattice in order, so that units with a common beginning share its work."""
        lattice, before = self.lattice, ""
        for unit in sorted(units):
            n = 0
            for x, y in zip(unit, before):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                n += 1
            if not before or not lattice.rewind(len(mark) + n):
                lattice.restart()
                lattice.push(mark)
                n = 0
            lattice.push(unit[n:].replace(" ", MARK))
            found[unit] = self.pack(lattice.all())
            before = unit
        lattice.restart()

    def lookup(self, words: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """Packed ids of all these words, and which of them are too long to be remembered."""
        new = words - self.words.keys()
        if len(self.words) + len(new) > self.limit:
            self.words, self.lines, new = {}, {}, words
        parts = {} if self.feed is None else {w: w.split("\n") for w in new if "\n" in w}
        lines = {line for p in parts.values() for line in p[1:]} - self.lines.keys()
        self.learn((new - parts.keys()) | ({p[0] for p in parts.values()} - self.words.keys()), MARK, self.words)
        self.learn(lines, "", self.lines)
        for w, (head, *more) in parts.items():
            self.words[w] = self.feed.join([self.words[head], *map(self.lines.__getitem__, more)])
        return self.words, {w for w in chain(new, *parts.values()) if len(w) > LONG}

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text, one for each space that has text after it and one for the start; spaces that
        follow each other belong to the word after them, or end the text."""
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return words
        joined, held = [], ""
        for i, w in enumerate(words):
            if w or i == len(words) - 1:
                joined.append(held + w)
                held = ""
            else:
                held += " "
        return joined

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if not self.model.separable:
            return [np.fromiter(chain.from_iterable(stream([MARK + t.replace(" ", MARK)] if t else [], self.model)), np.int32) if t is not None else None for t in texts]
        words = [self.split(t) if t else () for t in texts]
        known, long = self.lookup(set(chain.from_iterable(words)))
        ids = [None if t is None else np.frombuffer(b"".join(map(known.__getitem__, w)), self.code).astype(np.int32) for t, w in zip(texts, words, strict=True)]
        for w in long:
            self.words.pop(w, None)
            self.lines.pop(w, None)
        return ids

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self.spelled[ids]).replace(MARK.encode(), b" ")
        return text.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model: Pieces, *, text="text", keep=("doc_id",), check: bool = False) -> DataFrame:
    """keep, ids and n_ids; with check also lossless, whether decoding gives the text back."""
    made = ["ids", "n_ids", *["lossless"] * check]
    keep = [c for c in keep if c.lower() not in made]
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]), "ids array<int>", "n_ids int", *["lossless boolean"] * check])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary: some hundred thousand short strings at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in bounded(batches, "_text", 2 << 20):
            texts = batch.column("_text").to_pylist()
            rows = codec.encode_all(texts)
            same = [None if t is None else codec.decode(ids) == t for t, ids in zip(texts, rows, strict=True)] if check else []
            sizes = np.array([0 if r is None else len(r) for r in rows], np.int32)
            void = pa.array([r is None for r in rows])
            flat = np.concatenate([r for r in rows if r is not None]) if any(r is not None for r in rows) else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()), mask=void)
            n = pa.array(sizes, pa.int32(), mask=np.array([r is None for r in rows], bool))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids, n, *[pa.array(same, pa.bool_())] * check], names=[*keep, *made])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: Pieces, *, ids="ids", keep=("doc_id",)) -> DataFrame:
    """keep and text."""
    keep = [c for c in keep if c.lower() != "text"]
    kept = encoded.select(*keep, F.col(ids).alias("_ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[:-1]), "text string"])
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.asarray(x, np.int64)) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return kept.mapInArrow(run, schema)


def default_path() -> str:
    """The vocabulary of the query and the pipeline: the public 32k one in the folder TOKENIZERS_DIR names
    (/opt/tokenizers where it names none); any other .model file can be passed to Pieces.load."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def op3_sentencepiece(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode(docs, Pieces.load(path or default_path()), check=True)
