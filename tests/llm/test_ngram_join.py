"""The Jaccard join against all pairs in plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodespark.llm import ngram_join as J

WORDS = re.compile("[^ \t-\r]+")


def shingles(t, size=4):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain(docs, percent=85, size=4):
    sets = [shingles(t, size) for _, t in docs]
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    name = {}
    for i, (d, _) in enumerate(docs):
        name.setdefault(top(i), []).append(d)
    return sorted(((d, len(sets[i]), min((x for x in name[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(docs)), key=str)


def edited(rnd, words, share):
    out = []
    for w in words:
        if rnd.random() < share:
            kind = rnd.randrange(3)
            out += [] if kind == 0 else [f"n{rnd.randrange(10**6)}"] if kind == 1 else [w, f"n{rnd.randrange(10**6)}"]
        else:
            out.append(w)
    return out


def corpus(seed):
    """Chains of near copies, boilerplate with few own words, short texts at the threshold, unrelated texts."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**7)}" for _ in range(n)]
    texts, board = [], fresh(60)
    for _ in range(12):
        words = fresh(rnd.choice([8, 20, 50, 150, 400]))
        for _ in range(rnd.randrange(2, 14)):
            words = edited(rnd, words, rnd.choice([0, 0.005, 0.01, 0.02, 0.04]))
            texts.append(words)
    original = fresh(120)
    texts += [edited(rnd, original, 0.012) for _ in range(60)]  # many around one text
    texts += [board + fresh(rnd.randrange(0, 14)) for _ in range(60)]  # sets that are common but for a little
    texts += [fresh(rnd.randrange(0, 30)) + board + fresh(40) for _ in range(40)]
    few = fresh(9)
    texts += [rnd.sample(few, rnd.randrange(3, 9)) for _ in range(40)] + [few[:4], few[:3], few[:1]]
    texts += [fresh(rnd.randrange(1, 60)) for _ in range(40)]
    return [(i, rnd.choice([" ", "\n", "  "]).join(w.upper() if rnd.random() < 0.1 else w for w in words)) for i, words in enumerate(texts)]


@pytest.mark.parametrize(("seed", "long", "percent"), [(1, 256, 85), (2, 1, 85), (3, 3, 85), (4, 8, 70), (5, 0, 95)])
def test_against_all_pairs(spark, seed, long, percent, monkeypatch):
    monkeypatch.setattr(J, "POSTED", 16)  # several blocks to a list
    monkeypatch.setattr(J, "MERGED", 64)
    monkeypatch.setattr(J, "TOGETHER", 3)
    docs = corpus(seed)
    got = J.similar_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), percent=percent, long=long).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, percent)


def test_odd_rows(spark):
    same = "a b c d e f g h i j k l m n o p q r s t u v"
    docs = [(5, same), (3, same.upper().replace(" ", "\t")), (3, "x"), (None, same), (9, None), (8, ""), (8, " \n "), (None, "only here"), (7, same + " w"), (6, "z " * 30_000), (2, "z z z z"), (5, same)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("uid", F.lit(1)).withColumn("k", F.lit("a")).withColumn("a.b", F.lit(1)).withColumn("component_id", F.lit(0))
    got = J.similar_documents(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = plain([d for d in docs if shingles(d[1])]) + [(d, 0, d) for d, t in docs if not shingles(t)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert J.similar_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@given(st.lists(st.lists(st.integers(0, 30), max_size=12, unique=True).map(sorted), max_size=9), st.integers(1, 5))
@settings(max_examples=500, deadline=None)
def test_merge_skip(lists, least):
    times = {}
    for own in lists:
        for x in own:
            times[x] = times.get(x, 0) + 1
    assert list(J.merge_skip(lists, least)) == sorted((x, n) for x, n in times.items() if n >= least)


@given(st.integers(1, 3000), st.integers(1, 3000), st.sampled_from([70, 85, 95]))
@settings(max_examples=2000, deadline=None)
def test_a_node_in_few_long_lists_meets_all_partners(a, b, percent):
    if 100 * min(a, b) >= percent * max(a, b):
        assert J.needed(a, b, percent) >= 1
        assert J.needed(a, b, percent) - min(J.spare(a), J.spare(b)) >= 0  # fewer long lists than spare() leave one occurrence or more


@given(st.lists(st.integers(0, 60), min_size=1, max_size=50, unique=True), st.lists(st.integers(0, 60), min_size=1, max_size=50, unique=True))
@settings(max_examples=2000, deadline=None)
def test_prefixes_of_similar_sets_share_enough(a, b):
    a, b, percent = sorted(a), sorted(b), 70
    if 100 * len({*a} & {*b}) >= percent * len({*a} | {*b}):
        first = [{*x[: len(x) - J.rest(len(x), percent)]} for x in (a, b)]
        assert len(first[0] & first[1]) >= J.needed(len(a), len(b), percent)


def test_query(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in J.op11_ngram_jaccard(spark, data).collect()), key=str) == plain(docs)
