"""Cross-tokenizer alignment: whole texts by the libraries and plain loops against ranges, words and the tree."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from tidemark.llm import alignment as al

FIRST, SECOND = al.default_paths()
TEXTS = [
    None, "", " ", "\n", "a", " a", "Hello world, it's 10 o'clock.\nNew line\n\n  two  spaces \t tab", "<|endoftext|> <s> </s> <0x0A> [UNK]", "▁ mark", "x▁y", "naïve café — “quotes” 日本語のテキスト 한국어 🙂🙂 é", "a b c\x1cd \x85e",
    "\r\nwin\r\nlines\r\n", "word " * 300, "日本語" * 200, "a" * 3000, "1234567890" * 50 + " x", "tail  ", " \n \n", "don't they'll I'd we've", "\x00null\x00 byte", "same text", "same text", "word\n\nword \nword\n word",
]


def plain(texts: list) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and the hash, text by text with the libraries."""
    a, b = tokenizers.Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    letters = al.byte_of_letter()
    rows, counts = [], Counter()
    for text in texts:
        row = None
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
            bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = [np.cumsum([len(t) for t in some]).tolist() for some in (bytes_a, bytes_b)]
                common = sorted(set(ends[0]) & set(ends[1]))
                groups, links, low = [], [], 0
                for high in common:
                    parts = [[i for i, e in zip(ids, where, strict=True) if low < e <= high] for ids, where in zip((x, y), ends, strict=True)]
                    groups.append("|".join(",".join(map(str, p)) for p in parts))
                    links.append((parts[0][-1], parts[1][-1]))
                    low = high
                counts.update(links)
                row = (len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
        rows.append(row)
    top = {}
    for (_, b_id), n in counts.items():
        top[b_id] = max(n, top.get(b_id, 0))
    return [(r[0], r[1], r[2], len(r[3]), sum(counts[p] == top[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]) if r else (0, 0, 0, 0, 0, 0, "") for r in rows]


@pytest.mark.skipif(not os.path.exists(FIRST), reason="needs the public vocabularies")
@pytest.mark.parametrize(("size", "pairs"), [(7, 0), (100, 10**6), (al.RANGE, 10**6)])
def test_ranges_equal_whole_texts(spark, size, pairs):
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a double")
    got = {r["doc_id"]: tuple(r)[1:] for r in al.align(docs.repartition(3), FIRST, SECOND, keep=("doc_id", "n_a"), size=size, broadcast_pairs=pairs).collect()}
    want = plain(TEXTS)
    for i, row in enumerate(want):
        assert got[i] == row, TEXTS[i]
    assert len(got) == len(TEXTS)
    assert al.op11_tokenizer_alignment(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in al.op11_tokenizer_alignment(docs).collect()}
    assert got == dict(zip(texts, plain(list(texts.values())), strict=True))


def test_fragments_are_a_monoid():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 40)
        ends = [np.array(sorted({n, *rnd.sample(range(1, n + 1), rnd.randint(0, n))})) for _ in range(2)]
        ids = [np.array(rnd.choices(range(9), k=len(e))) for e in ends]
        want, _, _ = al.fragment(ids[0], ends[0], ids[1], ends[1])
        cuts = [0, *sorted(rnd.choices(range(n + 1), k=3)), n]
        parts = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            held = [(low < e) & (e <= high) for e in ends]
            parts.append(al.fragment(ids[0][held[0]], ends[0][held[0]], ids[1][held[1]], ends[1][held[1]])[0])
        p, q, r, s = parts
        assert p * q * r * s == p * (q * (r * s)) == (p * q) * (r * s) == al.Fragment() * want == want * al.Fragment()


def test_texts_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'fine'")
    rows = {r["doc_id"]: r["n_a"] for r in al.op11_tokenizer_alignment(docs).collect()}
    assert rows[1] == 0 and rows[2] > 0
