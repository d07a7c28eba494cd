"""Fingerprints and their links against plain Python, with buckets cut once, twice and three times."""

import random
import re

import pytest
import xxhash

from lodespark.llm import simhash as S
from lodespark.llm.components import components


def plain_print(t):
    w = re.findall("[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    shingles = ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]) if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(nodes, links):
    up = {n: n for n in nodes}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def near(ps):
    return [(a, b) for i, a in enumerate(ps) for b in ps[i + 1 :] if (a ^ b).bit_count() <= 2]


@pytest.mark.parametrize("cap", [2048, 8, 2])
def test_links_connect_what_is_near(spark, cap):
    rnd = random.Random(cap)
    ps = set()
    for _ in range(8):
        base = x = rnd.getrandbits(64)
        for _ in range(30):
            x ^= 1 << rnd.randrange(64) | (1 << rnd.randrange(64) if rnd.random() < 0.7 else 0)
            ps |= {x, base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)), base ^ (1 << rnd.randrange(16)) ^ (1 << rnd.randrange(16))}
    ps = sorted(ps)
    made = [(r.a, r.b) for r in S.links(spark.createDataFrame([(signed(p),) for p in ps], "print bigint"), cap=cap).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2 for a, b in made)
    assert classes(map(signed, ps), made) == classes(map(signed, ps), [(signed(a), signed(b)) for a, b in near(ps)])


def test_runs_that_span_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        test_links_connect_what_is_near(spark, 8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["Ab", "c", "Été", "x1"], k=rnd.randrange(1, 40))) for _ in range(60)]
    texts += [texts[0], texts[0].upper(), None, "", " \n", "one", "one two", "ONE", "w " * 200_000, texts[5] + " c"]
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(None, texts[0]), (10, texts[0]), (None, "alone here")]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, print int, component_id string")
    out = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=repr)
    ps = {t: plain_print(t) for _, t in rows}
    of = classes(sorted(set(ps.values())), near(sorted(set(ps.values()))))
    name = {c: min((i for i, t in rows if of[ps[t]] == c and i is not None), default=None) for c in of.values()}
    assert out == sorted(((i, f"{ps[t]:016x}", name[of[ps[t]]]) for i, t in rows), key=repr)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_odd_graphs(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(150)]
    star = [(1000, 1000 + i) for i in range(1, 120)]
    mixed = [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(90)]
    links = chain + star + mixed + [(5, 5), (1000, 1001)]
    nodes = {n for x in links for n in x}
    got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3), (4, None)], "a bigint, b bigint")).collect()}
    want = classes(sorted(nodes), links)
    assert {n: got.get(n, n) for n in nodes} == want and set(got) == {n for n in nodes if want[n] != n}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
