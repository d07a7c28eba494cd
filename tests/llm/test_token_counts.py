"""Edited counts against the whole edited text encoded anew by the library."""

import random

import pytest
from tokenizers import Tokenizer

from lodespark.llm import token_counts as T


@pytest.fixture(scope="module")
def pair():
    path, pattern = T.gpt_like()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return T.Counter(path, pattern), library


PARTS = ["the", " a", " ", "\n", "  ", "ing", "'s", "'", "ll", "12", "!", "é", "日", "😀", "<|endoftext|>", "\t", " b", "x" * 30]


def text(rnd, n):
    return "".join(rnd.choice(PARTS) for _ in range(n))


def test_edits_equal_a_new_count(pair):
    own, library = pair
    rnd = random.Random(2)
    for _ in range(300):
        t = text(rnd, rnd.choice([0, 1, 5, 80, 900]))
        tree = T.Tree(*own.leaves(t))
        for _ in range(rnd.randrange(1, 6)):
            at, gone, new = rnd.randrange(0, len(t) + 2), rnd.choice([0, 0, 1, 3, 40, 4000]), text(rnd, rnd.choice([0, 0, 1, 2, 30, 900]))
            want = t[: min(at, len(t))] + new + t[min(at, len(t)) + gone :]
            t, tree, _ = T.edited(own, t, tree, at, gone, new)
            assert t == want and tree.chars[1] == len(t)
            assert tree.tokens[1] == len(library.encode(t, add_special_tokens=False).ids)


def test_a_small_edit_encodes_little(pair):
    own, _ = pair
    t = "some ordinary words in a row, " * 5000
    tree = T.Tree(*own.leaves(t))
    _, _, cost = T.edited(own, t, tree, len(t) // 2, 3, "new")
    assert cost < 2000


def test_table(spark, pair):
    rnd = random.Random(3)
    texts = [None, "", "one", text(rnd, 2000), text(rnd, 300)]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate([*texts, texts[3]])] + [(None, "no id", "x", 7)], "doc_id bigint, text string, seq string, n_leaves int")
    edits = spark.createDataFrame([(3, 2, 10, 5, "abc"), (3, 1, 100, 0, " first"), (4, 1, 0, 10**6, None), (0, 1, 5, 5, "was null")], "doc_id bigint, seq int, at int, removed int, inserted string")
    first = T.count_tokens(docs, *T.gpt_like(), keep_text=True)
    out = {r.doc_id: r for r in T.count_tokens(T.gathered(first, edits), *T.gpt_like(), edits_col="edits", keep_text=True).collect()}
    n = lambda t: len(pair[1].encode(t or "", add_special_tokens=False).ids)
    after = dict(enumerate([*texts, texts[3]])) | {None: "no id", 4: "", 0: "was null"}
    one = texts[3][:100] + " first" + texts[3][100:]
    after[3] = one[:10] + "abc" + one[15:]
    for i, r in out.items():
        assert (r.n_tokens, r.n_tokens_after, r.text) == (n("no id" if i is None else [*texts, texts[3]][i]), n(after[i]), after[i] or "") and r.seq == "x" and sum(r.token_tree.chars) == len(r.text)


def test_a_tree_is_saved_read_again_and_edited(spark, pair, tmp_path):
    rnd = random.Random(4)
    texts = [text(rnd, 3000), text(rnd, 200), "", None]
    docs = spark.createDataFrame([(i, t, i + 10) for i, t in enumerate(texts)], "doc_id bigint, text string, __i int")
    T.count_tokens(docs, *T.gpt_like(), keep_text=True).write.parquet(str(tmp_path / "one"))
    want = [t or "" for t in texts]
    for step in ("one", "two"):
        places = [(i, 1, len(t) // 2, 3, f" {step}'ll ") for i, t in enumerate(want)]
        edits = spark.createDataFrame(places, "doc_id bigint, seq int, at int, removed int, inserted string")
        want = [t[: len(t) // 2] + f" {step}'ll " + t[len(t) // 2 + 3 :] for t in want]
        saved = spark.read.parquet(str(tmp_path / step))
        made = T.count_tokens(T.gathered(saved, edits), *T.gpt_like(), edits_col="edits", keep_text=True)
        made.drop("n_tokens", "chars_reencoded").write.parquet(str(tmp_path / ("two" if step == "one" else "three")))
        rows = made.orderBy("doc_id").collect()
        assert [r["text"] for r in rows] == want
        assert [r["n_tokens_after"] for r in rows] == [len(pair[1].encode(t, add_special_tokens=False).ids) for t in want]
        assert [r["__i"] for r in rows] == [10, 11, 12, 13] and rows[0]["chars_reencoded"] < len(want[0]) / 4


def test_empty_table(spark):
    assert T.count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), *T.gpt_like()).count() == 0
