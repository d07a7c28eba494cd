"""BPE against the tokenizers library, long unsplit texts and cut documents included."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lodespark.llm import bpe


@pytest.fixture(scope="module")
def pair():
    path = bpe.tokenizer_path()
    return bpe.Encoder(path), Tokenizer.from_file(path)


PARTS = [
    list("etaoinshrdlu"), ["the", "ing ", "'s", "!!", "'", "ll", "12", " "], ["the", "é", "ß", "Σ", "İ", "é", "日本", " ", "<|endoftext|>", " ", "😀", "\x1c", "\u0085"],
    ["Ther", "ation", "&&&", "***", " ", "\n", "| "], [chr(c) for c in range(32, 0x500, 7)],
]


@pytest.mark.parametrize("parts", PARTS)
def test_encoder_equals_library(pair, parts):
    own, library = pair
    rnd = random.Random(5)
    for _ in range(120):
        text = "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 3, 40, 700])))
        ids = library.encode(text, add_special_tokens=False).ids
        found = bpe.outputs(own.encode(text), ("ids", "decoded"))
        assert found == [ids, library.decode(ids, skip_special_tokens=False)]


def test_tree_concatenation_of_one_long_word(pair):
    own, library = pair
    for text in ("a" * 5000, "-" * 3001, "thing" * 900, "é" * 999):
        assert bpe.outputs(own.encode(text), ("ids",))[0] == library.encode(text, add_special_tokens=False).ids


def test_documents_cut_into_pieces(spark, pair):
    rnd = random.Random(6)
    texts = [None, "", "word", "x" * 900, "The thing's ''ll!! " * 60, "".join(rnd.choice(["ab", "theing", " ", "!", "'", "'s", "<|endoftext|>", "é"]) for _ in range(900)), "日本語" * 200, "ab'" * 300]
    texts += ["".join(rnd.choice(["then", "ation", "s", "1", " ", "\n"]) for _ in range(300)) for _ in range(10)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "lost id", "x"), (None, "y" * 500, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    out = bpe.encode(docs, bpe.tokenizer_path(), columns=("n_tokens", "ids_sha256", "decoded_sha256"), piece=64).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = pair[1].encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(pair[1].decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"), bpe.tokenizer_path()).count() == 0


VOCABULARIES = [
    ["we've", "they're", "I'll", "'s", "don't", "a", " ", "x'ver'"], ["'", "v", "e", "r", "l", "s", " ", "!"],
    ["é", "ß", "Σ", "é", "İ", "日本", "語", "か", "が", "が", " "], ["<|endoftext|>", "<|", "|>", "we've", " ", "é"],
    ["한국", "각", "각", " ", "a"], ["!!", "''", "...", "123", "4", " "], ["the", "ation", "ing", "\n", "\t", "'re"],
]


@pytest.mark.parametrize("seed", range(5))
def test_pieces_of_any_size_join_as_the_library_splits(pair, seed):
    own, library = pair
    rnd = random.Random(seed)
    for _ in range(2000):
        parts = rnd.choice(VOCABULARIES) + rnd.choice(VOCABULARIES)
        text = "".join(rnd.choice(parts) for _ in range(rnd.choice([5, 20, 60, 150])))
        marks = [0, *bpe.cuts(text, rnd.choice([3, 4, 5, 7, 10, 16, 33, 64]), own.special), len(text)]
        nodes = [own.piece(text[i:j]) for i, j in zip(marks, marks[1:], strict=False)]
        while len(nodes) > 1:
            nodes = [own.joined(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        assert nodes[0].ids.tolist() == library.encode(text, add_special_tokens=False).ids, (text, marks)


def test_contractions_across_a_cut(spark, pair):
    texts = []
    for word in ("we've", "they're", "I'll", "it's", "I'm", "don't", "he'd"):
        for before in range(1, len(word)):
            texts.append("a" * 9 + " " + "x" * (bpe.PIECE - 10 - before) + "!" + word[1:] + " and more " * 3)
            texts.append(("so " * bpe.PIECE)[: bpe.PIECE - before - 1] + " " + word + " and more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r.ids for r in bpe.encode(docs, bpe.tokenizer_path(), columns=("ids",)).collect()}
    for i, t in enumerate(texts):
        assert out[i] == pair[1].encode(t, add_special_tokens=False).ids, i


def test_text_without_spaces_is_cut(pair):
    assert len(bpe.cuts("日本語" * 100, 32, pair[0].special)) == 9
    assert bpe.cuts("a<|endoftext|>b" * 2, 5, pair[0].special) == [14, 29]


def test_other_tokenizers_are_refused(spark):
    import public_tokenizers

    with pytest.raises(ValueError, match="not a lower-casing BPE file"):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
