"""Many words searched in texts at once (M7, M8): an automaton that is run over a whole batch of texts in step.

The words form a trie; each node's row of the table names the node to go to for each class of characters, failing over
to the longest suffix that is a beginning of a word. Texts are cut into strips that overlap by the longest word, and
every step takes one character of all strips, so that a batch costs as many steps as a strip is long."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

CLASSES = 127  # classes of characters; more characters share classes, and then what is found is looked up in the text
STRIP = 512


class Automaton:
    def __init__(self, words: list[str]):
        self.words = sorted({w for w in words if w})
        letters = sorted({c for w in self.words for c in w})
        self.exact = len(letters) <= CLASSES
        self.longest = max(map(len, self.words), default=1)
        self.classes = np.zeros(0x110000, np.uint8)
        for i, c in enumerate(letters):
            self.classes[ord(c)] = 1 + i if self.exact else 1 + ord(c) % CLASSES
        width = 1 + (len(letters) if self.exact else CLASSES)
        children: list[dict[int, int]] = [{}]
        depth, own = [0], [[]]
        for n, w in enumerate(self.words):
            at = 0
            for c in w:
                k = int(self.classes[ord(c)])
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    depth.append(depth[at] + 1)
                    own.append([])
                at = children[at][k]
            own[at].append(n)
        self.own = own
        size = len(children)
        self.table = np.zeros((size, width), np.int32)
        fail = np.zeros(size, np.int64)
        self.link = np.zeros(size, np.int64)  # the longest proper suffix that ends a word, or 0
        ends = np.array([bool(x) for x in own])
        for node in np.argsort(np.array(depth), kind="stable").tolist():
            back = fail[node]
            if node:
                self.table[node] = self.table[back]
                self.link[node] = back if ends[back] else self.link[back]
            for k, child in children[node].items():
                fail[child] = self.table[back, k] if node else 0
                self.table[node, k] = child
        self.hit = ends | (self.link > 0)

    def found(self, texts: list[str]) -> list[list[str]]:
        """The words that each text holds, in order."""
        lengths = np.array([len(t) for t in texts], np.int64)
        codes = self.classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.r_[0, np.cumsum(lengths)[:-1]] if len(texts) else lengths
        n = -(-lengths // STRIP)
        text = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        low = np.maximum(nth * STRIP - self.longest + 1, 0)
        size = np.minimum((nth + 1) * STRIP, lengths[text]) - low
        order = np.argsort(-size, kind="stable")
        text, at, size = text[order], (first[text] + low)[order], size[order]
        state = np.zeros(len(text), np.int64)
        hits = []
        for step in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -step, side="left"))  # strips longer than step
            state[:k] = self.table[state[:k], codes[at[:k] + step]]
            here = np.flatnonzero(self.hit[state[:k]])
            if len(here):
                hits.append(np.unique(text[here] * len(self.table) + state[here]))
        out: list[set[str]] = [set() for _ in texts]
        for code in np.unique(np.concatenate(hits)).tolist() if hits else ():
            t, node = divmod(code, len(self.table))
            while node:
                out[t].update(self.words[w] for w in self.own[node])
                node = int(self.link[node])
        return [sorted(w for w in ws if self.exact or w in t) for t, ws in zip(texts, out, strict=True)]


def finder(spark: SparkSession, words: list[str]):
    """A function of a text column that gives the words it holds (array of strings, empty for null). The caller bounds
    the words: the automaton is broadcast, some 500 bytes a letter at most."""
    shared = spark.sparkContext.broadcast(Automaton(words))

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = shared.value
        for some in texts:
            yield pd.Series(automaton.found(["" if t is None else t for t in some]), index=some.index, dtype=object)

    def find(text: Column) -> Column:
        return run(text)

    return find
