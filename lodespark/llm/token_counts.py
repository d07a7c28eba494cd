"""Token counts that follow edits.

A document's words (pre-tokens) are grouped, ``LEAF`` at a time, into leaves of a
segment tree with the characters and tokens of each subtree. An edit is found by
descending the tree, the text is split again from the start of the leaf before it
until a leaf's end is met where it was, and only words up to there are encoded;
then the sums above are brought up to date. Two characters before an edit count as
its context, since the splitting pattern looks that far ahead, so counts are those
of the whole edited text encoded anew."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.arrow import map_in_arrow
from .bpe import byte_symbols
from .shared import unused

LEAF, CACHED, AHEAD = 64, 200_000, 2
EDITS = "array<struct<at:int,removed:int,inserted:string>>"


class Counter:
    """Tokens of words under a byte-level tokenizers file; special tokens are ordinary text."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.pattern = regex.compile(pattern)
        self.symbol = [byte_symbols()[b] for b in range(256)]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def tokens(self, words: list[str]) -> int:
        try:
            return sum([self.young[w] for w in words])
        except KeyError:
            if len(self.young) > CACHED:
                self.young, self.old = {}, self.young
            for w in words:
                if w not in self.young:
                    n = self.old.get(w)
                    self.young[w] = n if n else len(self.model.tokenize("".join([self.symbol[b] for b in w.encode()])))
            return sum([self.young[w] for w in words])

    def leaves(self, text: str) -> tuple[list[int], list[int]]:
        """(characters, tokens) of each leaf of a text."""
        words = self.pattern.findall(text)
        parts = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
        return [sum(map(len, p)) for p in parts], [self.tokens(p) for p in parts]


class Tree:
    """A segment tree over leaves; node i has the children 2i and 2i + 1, leaves begin at ``size``."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1
        while self.size < len(chars):
            self.size *= 2
        self.n = len(chars)
        pad = [0] * (self.size - self.n)
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for sums in (self.chars, self.tokens):
            for i in range(self.size - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character, or of the last one that holds any."""
        place, i, first = min(max(place, 0), max(self.chars[1] - 1, 0)), 1, 0
        while i < self.size:
            i *= 2
            if place - first >= self.chars[i]:
                first += self.chars[i]
                i += 1
        return i - self.size, first

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        for sums, value in ((self.chars, chars), (self.tokens, tokens)):
            j, change = i, value - sums[i]
            while j and change:
                sums[j] += change
                j //= 2


def edited(counter: Counter, text: str, tree: Tree, at: int, removed: int, inserted: str) -> tuple[str, Tree, int]:
    """The text after an edit, its tree, and how many characters were encoded for it. Places beyond the text count as its end."""
    at = min(max(at, 0), len(text))
    removed = min(max(removed, 0), len(text) - at)
    after = text[:at] + inserted + text[at + removed :]
    if not text:
        return after, Tree(*counter.leaves(after)), len(after)
    leaf, first = tree.leaf_at(at - AHEAD)
    shift, begin = len(inserted) - removed, first
    words, where = [], begin
    stop, j = first + tree.chars[tree.size + leaf], leaf  # the end of an old leaf behind the edit
    for m in counter.pattern.finditer(after, begin):
        words.append(m[0])
        where = m.end()
        while j < tree.n - 1 and (stop < at + removed or stop + shift < where):
            j += 1
            stop += tree.chars[tree.size + j]
        if stop >= at + removed and stop + shift == where and where >= at + len(inserted):
            break
    else:
        j = tree.n - 1
    if len(words) > 8 * LEAF:  # a long insertion gets leaves of its own
        parts = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
        chars, tokens = (s[tree.size : tree.size + tree.n] for s in (tree.chars, tree.tokens))
        chars[leaf : j + 1], tokens[leaf : j + 1] = [sum(map(len, p)) for p in parts], [counter.tokens(p) for p in parts]
        return after, Tree(chars, tokens), where - begin
    tree.put(leaf, sum(map(len, words)), counter.tokens(words))
    for gone in range(leaf + 1, j + 1):
        tree.put(gone, 0, 0)
    return after, tree, where - begin


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


TREE = "struct<chars:array<int>,tokens:array<int>>"


def count_tokens(docs: DataFrame, path: str, pattern: str, text_col: str = "text", edits_col: str | None = None, keep_text: bool = False) -> DataFrame:
    """``docs`` without its text, with n_tokens and token_tree, the leaves' characters and tokens.

    A token_tree that is there already is taken as that of the text, which then isn't
    encoded. With ``edits_col`` (EDITS, each edit's place being in the text that the
    ones before left) come n_tokens_after and chars_reencoded, and the tree is that of
    the edited text, which replaces the text if ``keep_text``. Null texts count as
    empty, null edits as none; null inserted text is empty. All other columns stay,
    but those named here are replaced."""
    made = ["n_tokens", "token_tree"] + (["n_tokens_after", "chars_reencoded"] if edits_col else [])
    had = "token_tree" in docs.columns
    keep = [c for c in docs.columns if c not in {*made, edits_col} and (keep_text or c != text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for batch in batches:
            texts, rows = [], []
            for i in range(len(batch)):
                text = batch.column(text_col)[i].as_py() or ""
                old = batch.column("token_tree")[i].as_py() if had else None
                tree = Tree(*(old["chars"], old["tokens"]) if old else own.leaves(text))
                before, work = tree.tokens[1], 0
                for e in (batch.column(edits_col)[i].as_py() or ()) if edits_col else ():
                    text, tree, cost = edited(own, text, tree, e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                    work += cost
                leaves = [(c, t) for c, t in zip(tree.chars[tree.size : tree.size + tree.n], tree.tokens[tree.size : tree.size + tree.n], strict=True) if c]
                texts.append(text)
                rows.append((before, {"chars": [c for c, _ in leaves], "tokens": [t for _, t in leaves]}, tree.tokens[1], work))
            kept = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in keep]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))]))]
            columns += [pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3)] if edits_col else []
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *made])

    schema = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(f"n_tokens bigint, token_tree {TREE}" + (", n_tokens_after bigint, chars_reencoded bigint" if edits_col else "")).fields])
    return map_in_arrow(docs, run, schema)


def gathered(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column edits, from a table of (id, seq, at, removed, inserted), in order of seq."""
    (own,) = unused(docs, "__i")
    some = edits.groupBy(F.col(id_col).alias(own)).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("e"))
    some = some.select(own, F.transform("e", lambda x: F.struct(x["at"].cast("int").alias("at"), x["removed"].cast("int").alias("removed"), x["inserted"].alias("inserted"))).alias("edits"))
    return docs.drop("edits").join(some, F.col(id_col) == F.col(own), "left").drop(own)


def gpt_like() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after three edits each, placed by length: an insertion, a removal and a replacement."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = "cast(coalesce(length(text), 0) as int)"
    edits = f"""array(named_struct('at', {n} div 3, 'removed', 0, 'inserted', ' (revised, v2)'), named_struct('at', {n} div 2, 'removed', 9, 'inserted', ''),
      named_struct('at', {n} - {n} div 5, 'removed', 4, 'inserted', concat('\\n  note ', coalesce(doc_id, 0), ': it''s over')))"""
    out = count_tokens(docs.withColumn("edits", F.expr(edits)), *gpt_like(), edits_col="edits")
    return out.select("doc_id", "n_tokens", "n_tokens_after", "chars_reencoded", F.size("token_tree.chars").cast("bigint").alias("n_leaves"))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE: dict[str, str] = {}
