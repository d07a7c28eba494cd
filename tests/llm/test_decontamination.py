"""Decontamination against a search for every window of every item."""

import random
import re

import pytest

from lodespark.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items, span=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for j, u in items:
            v = words(u)
            n = min(span, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(j))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def made(rnd, n, vocabulary):
    return "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "!? "]) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("more", [{}, {"broadcast_rows": 0}, {"bits": 6}])
def test_equals_plain_search(spark, seed, more):
    rnd = random.Random(seed)
    vocabulary = ["the", "Été", "q9", "ab", "x", "日本", "of"] if seed else ["a", "b"]
    items = [(k, made(rnd, rnd.choice([1, 2, 4, 5, 6, 9, 10, 11, 25]), vocabulary)) for k in range(14)] + [(90, ""), (91, None), (92, "!!"), (93, "lonely")]
    items += [(k + 100, items[k][1]) for k in range(3)]
    docs = []
    for i in range(40):
        t = made(rnd, rnd.randrange(0, 60), vocabulary)
        for _ in range(rnd.randrange(0, 3)):
            u = words(rnd.choice(items[:14])[1])
            a = rnd.randrange(0, len(u))
            t += " " + " ".join(u[a : a + rnd.randrange(1, 30)]).upper() + " " + made(rnd, rnd.randrange(0, 12), vocabulary)
        docs.append((i, t))
    docs += [(40, None), (41, ""), (42, "?!"), (0, docs[0][1]), (None, docs[1][1]), (43, "lonely"), (44, items[8][1]), (45, "w " * 30_000 + (items[13][1] or ""))]
    a = spark.createDataFrame([(*r, "x", "y") for r in docs], "doc_id bigint, text string, hash string, items string")
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id bigint, text string, doc_id string")
    out = D.decontaminate(a, b, **more).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out), key=repr) == plain(docs, items)


def test_spans_are_the_words_hit(spark):
    a = spark.createDataFrame([(1, "zero " + "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11" + " end")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 y")], "item_id bigint, text string")
    r = D.decontaminate(a, b).first()
    assert min(s.a for s in r.spans) == 1 and max(s.b for s in r.spans) == 12 and r.n_hit == 11


@pytest.mark.parametrize("docs, items", [([], [(1, "a b")]), ([(1, "a b")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert [(r.n_words, r.n_hit) for r in out.collect()] == [(2, 0)] * len(docs)


def test_one_word_longer_than_a_block(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from lodespark.llm import words as W

    texts = ["ab " + "x" * 90 + " cd " * 30, "x" * 90, "cd ab"]
    whole = W.words_of(pa.array(texts)).hash
    monkeypatch.setattr(W, "BLOCK", 16)
    assert np.array_equal(W.words_of(pa.array(texts)).hash, whole)
