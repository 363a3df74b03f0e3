"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import math

import pytest

import corpus_pipeline
from tidemark.llm import ann, langid, line_dedup, minhash_join, mixing, sentencepiece_codec, substring_dedup, tiff_media, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, h long, size string, bucket int, lang_pred string, tokens string, nth int, key string, a string, path string, copy string, starts int, _id string, media string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ENGLISH = "the quick brown fox and the lazy dog walk over the hill with their friends\nthe sun is out\nthey rest"


def rows(*items):
    return [(*item, *[None] * (20 - len(item))) for item in items]


@pytest.fixture(scope="module")
def odd(spark):
    data = rows(
        (1, ENGLISH, "en", "a", 1), (1, ENGLISH, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", None, "b", 3), (5, LONG, "xx", "c", 9),
        (None, ENGLISH, "en", None, 2), (6, ENGLISH + " more", "en", "a", 1), (7, "1234 !!", "en", "d", 7), (8, "été à la plage\n\n\nété à la plage", "fr", "e", 5), (9, LONG, "xx", "c", 9),
    )
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r.asDict()) for r in df.collect()), key=lambda x: (x[0], str(x[1])))


def test_language(odd, empty):
    got = by_id(langid.op1_language_id(odd))
    assert len(got) == 11
    assert {i for i, r in got if r["lang_pred"] == "und"} == {2, 3, 4, 7}
    assert all(r["score"] == 0 for _, r in got if r["lang_pred"] == "und")
    assert langid.op1_language_id(empty).count() == 0
    labelled = langid.label(odd, langid.fit(odd), spans=True)
    assert labelled.where("doc_id = 5").first()["lang_pred"] == "xx"
    assert labelled.columns.count("lang_pred") == 1
    assert {r["lang_pred"] for r in langid.label(odd, langid.fit(empty)).collect()} == {"und"}


def test_mixing(odd, empty):
    got = by_id(mixing.op2_mixing(odd))
    assert len(got) == 11 and all(0 <= r["taken"] <= 3 * r["size"] for _, r in got)
    assert {r["size"] for i, r in got if i in (2, 3, 4)} == {0}
    assert sum(r["taken"] for _, r in got) == pytest.approx(sum(r["size"] for _, r in got), abs=3)
    assert mixing.op2_mixing(empty).count() == 0


def test_sentencepiece(odd, empty):
    got = by_id(sentencepiece_codec.op3_sentencepiece(odd))
    assert len(got) == 11 and all(r["lossless"] for _, r in got if r["ids"] is not None)
    assert [r["ids"] for i, r in got if i == 2] == [None] and [r["ids"] for i, r in got if i == 3] == [[]]
    assert sentencepiece_codec.op3_sentencepiece(empty).count() == 0


def test_lines(odd, empty):
    got = by_id(line_dedup.op4_line_dedup(odd))
    assert len(got) == 11
    kept = {i: r for i, r in got}
    assert kept[1]["text"] == ENGLISH and kept[2]["text"] is None and kept[3]["text"] == ""
    assert kept[-1]["n_removed"] == 3 and kept[-1]["text"] == ""
    assert kept[6]["n_removed"] == 0  # its last line differs, so that only two lines repeat
    assert line_dedup.op4_line_dedup(empty).count() == 0
    assert set(line_dedup.dedup_lines(odd).columns) == {*odd.columns, "n_lines", "n_removed"}


def test_toxicity(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (None, 1), (5, None), (6, 0), (8, 0), (9, 1)], "doc_id long, toxic int")
    got = by_id(toxicity.op5_toxicity(odd, labels))
    assert len(got) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for _, r in got)
    assert len({r["score"] for i, r in got if i in (2, 3, 4, 7)}) == 1
    assert toxicity.op5_toxicity(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.op5_toxicity(odd, labels.limit(0)).collect()} == {0}


def test_media(odd, empty):
    got = by_id(tiff_media.op6_tiff_media(odd))
    assert len(got) == 11 and all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0 for _, r in got)
    assert len({tuple(sorted(x for x in r.items() if x[0] != "doc_id")) for i, r in got if i in (2, 3)}) == 1
    assert [r["n_pages"] > 1 for i, r in got if i == 5] == [True]
    assert tiff_media.op6_tiff_media(empty).count() == 0


def test_minhash(odd, empty):
    got = by_id(minhash_join.op7_minhash(odd))
    assert len(got) == 11
    found = {(i, r["component_id"], r["kept"]) for i, r in got}
    assert {(1, 1, True), (6, 1, False), (9, 5, False), (5, 5, True), (2, 2, True), (3, 3, True), (4, 4, True), (-1, None, True)} <= found
    assert [r["n_shingles"] for i, r in got if i == 7] == [1]
    assert minhash_join.op7_minhash(empty).count() == 0


def test_substrings(odd, empty):
    got = by_id(substring_dedup.op8_substring_dedup(odd))
    assert len(got) == 11
    assert {i: r["n_removed"] for i, r in got} == {-1: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 60_000}
    assert substring_dedup.op8_substring_dedup(empty).count() == 0


def test_nearest(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, []), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [math.inf, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.op9_nearest(df).collect())
    assert got == [(0, 1, 6, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 6, 0.0)]
    assert ann.op9_nearest(df.limit(0)).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.COM/en/7x?a#b", "https://a.com/en/", "https://acom/en/", "ftp://x.org/es", "http://org/es/#f", "http://a.net?/de/", "a://b.net/de/8://c"]
    df = spark.createDataFrame([(i, u, "allow") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.op10_url_filter(df).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("www.example.com", "/en/7x", "example.com/en/7", "allow"), 5: ("a.com", "/en/", "com/en/", "block"),
        6: ("acom", "/en/", None, "allow"), 7: ("x.org", "/es", None, "allow"), 8: ("org", "/es/", "org/es/", "block"), 9: ("a.net", "", None, "allow"), 10: ("b.net", "/de/8://c", "net/de/", "block"),
    }
    assert url_filter.op10_url_filter(df.limit(0)).count() == 0


def test_stages(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "").cache()
            assert docs.columns == corpus_pipeline.COLUMNS, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("not lossless").count() == 0


def test_stages_keep_rows_without_or_with_shared_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    items = [(1, text("a")), (2, text("b")), (2, text("a")), (None, text("c")), (None, text("d")), (None, text("d")), (3, text("e")), (3, text("e")), (3, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in items], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs, "").cache()
    want = [(-1, text("c")), (-1, text("d")), (-1, text("d")), (1, text("a")), (2, text("b")), (3, text("e")), (3, text("f"))]
    found = lambda df: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in df.collect())
    assert found(left) == want
    assert found(corpus_pipeline.mix_sources(spark, left, "")) == want
