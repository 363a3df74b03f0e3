"""The pipeline's stages, and queries without SQL, against plain Python on whole small tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import common, langid, mixing, sentencepiece_codec, tiff_media, toxicity

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()), key=str)


def without_copied_lines(rows, n=3):
    """Runs of n lines that an earlier document (or place) has are cut; documents left without lines go."""
    seen, out = {}, []
    for doc, text, lang, source, _ in sorted(rows, key=lambda r: r[0]):
        lines = [(i, x.strip(" ")) for i, x in enumerate((text or "").split("\n")) if x.strip(" ")]
        gone = set()
        for k in range(len(lines) - n + 1):
            if seen.setdefault(tuple(x for _, x in lines[k : k + n]), (doc, k)) != (doc, k):
                gone |= {i for i, _ in lines[k : k + n]}
        if not gone or len(gone) < len(lines):
            left = text if not gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            out.append((doc, left, lang, source, None if left is None else len(left)))
    return sorted(out, key=str)


def without_near_copies(rows, percent=80):
    """The smallest id of every group of texts that links reach."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").encode().split() for r in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in words]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            group[find(b)] = find(a)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((r for i, r in enumerate(rows) if r[0] == least[find(i)]), key=str)


def test_stages_against_plain_python(spark):
    import sentencepiece

    docs = common.documents(spark, SF)
    given = rows_of(docs.select(*corpus_pipeline.COLUMNS))
    steps = dict(corpus_pipeline.STAGES)
    first = common.staged(steps["language ID"](spark, docs, SF))
    kept = rows_of(first)
    labelled = {r[0]: r[2] for r in given if r[2] is not None and re.search(r"[^\W\d_]", r[1] or "")}
    assert {r[0] for r in kept} <= {r[0] for r in given if re.search(r"[^\W\d_]", r[1] or "")}
    assert np.mean([dict((r[0], r[2]) for r in kept).get(i) == x for i, x in labelled.items()]) >= 0.97
    second = common.staged(steps["line dedup"](spark, first, SF))
    assert rows_of(second) == without_copied_lines(kept)
    third = common.staged(steps["MinHash near-dedup"](spark, second, SF))
    assert rows_of(third) == without_near_copies(rows_of(second))
    fourth = common.staged(steps["source mixing"](spark, third, SF))
    times, size = Counter(rows_of(fourth)), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert set(times) <= set(rows_of(third)) and max(times.values()) <= 3
    goal = {r["source"]: r["target"] for r in mixing.targets(third.select("source", mixing.word_count(third["text"]).alias("size"))).collect()}
    for source, target in goal.items():
        of = [r for r in times if r[3] == source]
        words, longest = sum(times[r] * size(r[1]) for r in of), max((size(r[1]) for r in of), default=0)
        assert -1 <= words - target <= longest + 1  # whole documents: the last one may go beyond
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_path())
    last = steps["SentencePiece encoding"](spark, fourth, SF).collect()
    ids = {r[0]: library.encode(r[1]) for r in times}
    assert len(last) == sum(times.values()) and all(r["ids"] == ids[r["doc_id"]] for r in last)


def test_run_gives_what_its_stages_give(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_ids", "lossless"]
    assert got.where("not lossless").count() == 0 and got.count() > 50


def test_media_query_against_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in common.documents(spark, SF).collect()}
    got = {r["doc_id"]: r for r in tiff_media.op6_tiff_media(common.documents(spark, SF)).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        raw = (text or "").encode()
        body = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        media = tiff_media.store(body)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest())
        assert (got[i]["tail_crc32"], got[i]["media_bytes"], got[i]["media_sha256"]) == (zlib.crc32(body[-32:]), len(media), hashlib.sha256(media).hexdigest())
        share = [sum(b >> 5 == k for b in body) * 1000 // len(body) for k in range(8)]
        assert got[i]["feature"] == f"48x{len(body) // 48};mean={sum(body) * 1000 // len(body)};hist={','.join(map(str, share))}"


def test_toxicity_scores_against_plain_sums(spark):
    docs, labels = common.documents(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    place = {int(b): j for j, b in enumerate(model.inputs)}
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for r in docs.limit(150).collect():
        words = set(re.findall(r"[^\W\d_]+", (r["text"] or "").lower()))
        found = sorted({place[t] for w in words for t in toxicity.Terms()[w] if t in place})
        margin = model.bias + sum(model.weights[j] for j in found) + sum(float(model.factors[a] @ model.factors[b]) for a, b in itertools.combinations(found, 2))
        assert scored[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)


def test_languages_against_a_plain_search(spark):
    docs = common.documents(spark, SF)
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["n_spans"]) for r in langid.label(docs, model).collect()}
    words = langid.Vocabulary(model)
    for r in docs.limit(60).collect():
        text = langid.LETTERS.findall((r["text"] or "").lower())
        if not text:
            assert got[r["doc_id"]] == ("und", 0.0, 0)
            continue
        ids = [words[w] for w in text]
        words.settle()
        table, back = words.scores[ids[0]].astype(float), []
        for i in ids[1:]:
            stay, best = table, int(table.argmax())
            back.append([s if stay[s] >= table[best] - model.switch else best for s in range(len(table))])
            table = words.scores[i] + np.array([table[b] - model.switch * (b != s) for s, b in enumerate(back[-1])])
        path = [int(table.argmax())]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        letters = Counter()
        for w, s in zip(text, path, strict=True):
            letters[s] += sum(map(str.isalpha, w))
        top = max(letters.values())
        pred = min(s for s, n in letters.items() if n == top)
        assert got[r["doc_id"]] == (model.languages[pred], pytest.approx(top / sum(letters.values())), 1 + sum(a != b for a, b in itertools.pairwise(path)))
