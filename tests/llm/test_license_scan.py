"""License scans: the automaton against regular expressions, defined cases, whole license texts."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import license_scan as ls

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice {}shall be included in all copies or substantial portions of the Software."""


def matches(template: str, words: list[str]) -> dict[int, int]:
    """start -> longest end, by trying every span against the regular expression."""
    full = re.compile(ls.pattern(ls.parse(template)))
    out = {}
    for a in range(len(words)):
        for b in range(a + 1, len(words) + 1):
            if full.fullmatch("".join(w + " " for w in words[a:b])):
                out[a] = b
    return out


@pytest.mark.parametrize("seed", range(12))
def test_automaton_equals_regular_expressions(seed):
    rnd = random.Random(seed)

    def made(depth=0):
        out = []
        for _ in range(rnd.randint(1, 4)):
            k = rnd.random()
            if k < 0.6 or depth > 2:
                out.append(rnd.choice("abc"))
            elif k < 0.8:
                out.append(f"<<beginOptional>>{made(depth + 1)}<<endOptional>>")
            else:
                out.append(f"<<var;name=x;words={rnd.randint(0, 1)}-{rnd.randint(1, 3)}>>")
        return " ".join(out)

    templates = [ls.Template(str(i), f"a {made()}") for i in range(4)]
    automaton = ls.Automaton(templates)
    for _ in range(20):
        words = rnd.choices("abcd", k=rnd.randint(0, 14))
        got = automaton.spans(np.array([automaton.words.get(w.encode(), 0) for w in words], np.int64))
        want = {(n, a, b) for n, t in enumerate(templates) for a, b in matches(t.text, words).items()}
        assert set(got) == want and len(got) == len(want)
        automaton.forget()


@pytest.mark.parametrize("text", ["<<beginOptional>> a", "a <<endOptional>>", "a <<var;name=x>>", "<<var;name=x;words=0-2>> a", "", "<<beginOptional>>a<<endOptional>>"])
def test_wrong_templates_raise(text):
    with pytest.raises(ValueError):
        ls.Automaton([ls.Template("x", text)])


def test_texts_and_defined_cases(spark):
    long = "MIT " * 300_000 + "mit license"
    rows = [(1, MIT.format("")), (2, MIT.format("(including the next paragraph) ")), (3, MIT.format("now ")), (4, None), (5, ""), (6, long), (6, long), (None, "Licence: CC BY-NC 4.0, and GNU General Public License (GNU general public-license!)"), (7, "ccé by; ÉMIT license")]
    docs = spark.createDataFrame([(a, b, 9.0) for a, b in rows], "doc_id long, text string, score double")
    out = [r.asDict(recursive=True) for r in ls.scan(docs, keep=("doc_id", "score")).collect()]
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["labels"] == by[2]["labels"] == "mit-text" and by[1]["score"] == 1.0 and by[1]["base_labels"] == ""
    assert by[3]["labels"] == "" and by[3]["score"] == 0.0
    assert [by[4][k] for k in ("n_words", "n_base", "first_word", "labels", "score", "spans")] == [by[5][k] for k in ("n_words", "n_base", "first_word", "labels", "score", "spans")] == [0, 0, None, "", 0.0, []]
    assert (by[6]["n_words"], by[6]["n_base"], by[6]["first_word"]) == (300_002, 1, 300_000)
    assert by[None]["labels"] == "cc-by,cc-by-nc,gpl" and (by[None]["n_base"], by[None]["first_word"], by[None]["last_word"]) == (3, 1, 11) and by[None]["score"] == 0.9
    assert by[7]["n_base"] == 0
    assert ls.scan(docs.limit(0)).count() == 0
