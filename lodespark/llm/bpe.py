"""BPE encoding and decoding with tree concatenation of long unsplit text.

A document of more than ``piece`` characters is cut into pieces, which are encoded
by different tasks; pairs of neighbours are then joined, up a tree. A word (that
is, a pre-token) of more than ``LEAF`` symbols is halved likewise within its task.
At each join the tokens around it are encoded again in growing windows until the
outermost tokens of the window are those that both sides had. A sequence of
tokens is the encoding of its text if each two neighbours are the encoding of
theirs, so the joined sequence is then exactly that of the whole text.

Where words end may change at a join too. The splitting pattern looks at most
``AHEAD`` characters beyond a word's first one, so all words of the left piece
stay that end before those; from the next on, the text up to the first white
space behind the join is split again, until a word ends where one of the right
piece does. From there on both are split alike.

All other words are encoded by the library's model, once per worker and word."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE, LEAF, CACHED = 32_768, 128, 125_000
END = "</w>"
#: Texts of these characters only (ASCII, and Latin letters that NFC leaves alone) are split here; others by the library itself.
LATIN = "À-ÖØ-öø-ÿ"
SIMPLE = re.compile(f"[\t-\r -~{LATIN}]*")
SPLIT = re.compile(f"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9{LATIN}]+")
#: Characters that a contraction has: what the pattern reads ahead of a word's first character.
AHEAD = 3
#: What the splitting above is made for; a file with other settings is refused.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False}


def supported(spec: dict) -> bool:
    """Whether a tokenizers file has the normalizer, splitting pattern, model and special tokens that this module takes apart itself."""
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    parts = splitter.get("pretokenizers") or [{}, {}]
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    return (
        normalizer.get("type") == "Sequence" and normalizer.get("normalizers") == NORMALIZERS
        and splitter.get("type") == "Sequence" and len(parts) == 2
        and parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": PATTERN} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
        and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
        and all(spec["model"].get(k) == v for k, v in MODEL.items())
        and not any(t.get(flag) for t in spec["added_tokens"] for flag in flags)
        and not spec.get("post_processor") and not spec.get("decoder")
    )


def byte_symbols() -> dict[int, str]:
    """Byte-level BPE's symbol for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts as the tokenizer of a file does, special tokens in texts included."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not supported(spec):
            raise ValueError(f"{path} is not a lower-casing BPE file with word ends, which is what this operator takes apart")
        self.tok = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.names = {i: t for t, i in self.tok.get_vocab().items()}
        self.name_bytes = {i: t.encode() for i, t in self.names.items()}
        self.id_bytes = {i: str(i).encode() for i in self.names}
        self.symbol = [byte_symbols()[b] for b in range(256)]
        self.special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special = sorted(self.special_id, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.model = self.tok.model
        spec["model"]["end_of_word_suffix"] = None
        self.plain = Tokenizer.from_str(json.dumps(spec)).model
        #: (ids, names) of the words met last, as joined bytes; by symbols where the library split the text. Two generations each.
        self.known: list[dict[str, tuple]] = [{}, {}]
        self.mapped: list[dict[str, tuple]] = [{}, {}]

    # words of one text

    def words(self, text: str) -> tuple[list[str], list[dict]]:
        """The words of a text without special tokens, and the tables that have them."""
        if SIMPLE.fullmatch(text):
            return SPLIT.findall(text.lower()), self.known
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))], self.mapped

    def symbols(self, word: str, tables: list[dict]) -> str:
        return word if tables is self.mapped or word.isascii() else "".join([self.symbol[b] for b in word.encode()])

    def made(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b" ".join([self.id_bytes[i] for i in ids]), b" ".join([self.name_bytes[i] for i in ids])

    def entries(self, words: list[str], tables: list[dict]) -> list[tuple[bytes, bytes]]:
        young, old = tables
        try:
            return [young[w] for w in words]
        except KeyError:
            if len(young) > CACHED:
                tables[:] = young, old = {}, young
            for w in words:
                if w not in young:
                    young[w] = old.get(w) or self.made(self.word(self.symbols(w, tables)))
            return [young[w] for w in words]

    def encode(self, text: str) -> list[tuple[bytes, bytes]]:
        """An entry for each word of a text, special tokens included."""
        if "<" not in text or self.special is None or not self.special.search(text):
            return self.entries(*self.words(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.entries(*self.words(text[at : m.start()]))
            out.append(self.made([self.special_id[m[0]]]))
            at = m.end()
        return out + self.entries(*self.words(text[at:]))

    # tree concatenation

    def direct(self, text: str, final: bool) -> list[int]:
        return [t.id for t in (self.model if final else self.plain).tokenize(text)]

    def word(self, text: str, final: bool = True) -> list[int]:
        """The ids of one word; final: it ends here, so its last symbol carries the end mark."""
        if len(text) <= LEAF:
            return self.direct(text, final) if text else []
        half = len(text) // 2
        return self.concat(text[:half], self.word(text[:half], False), text[half:], self.word(text[half:], final), final)

    def concat(self, left: str, left_ids: list[int], right: str, right_ids: list[int], final: bool) -> list[int]:
        """The ids of left + right, one word, from those of both; those of left may carry an end mark."""
        a = b = 4
        mark = len(END) * bool(left_ids and self.names[left_ids[-1]].endswith(END) and sum(len(self.names[i]) for i in left_ids) > len(left))
        while True:
            a, b = min(a, len(left_ids)), min(b, len(right_ids))
            near = sum(len(self.names[i]) for i in left_ids[len(left_ids) - a :]) - mark * (a > 0)
            far = len(right) if b == len(right_ids) else sum(len(self.names[i]) for i in right_ids[:b])
            window = left[len(left) - near :] + right[:far]
            again = self.direct(window, final and b == len(right_ids))
            whole_left, whole_right = a == len(left_ids), b == len(right_ids)
            if (whole_left or again[0] == left_ids[-a] and a > 1) and (whole_right or again[-1] == right_ids[b - 1]):
                return left_ids[: len(left_ids) - a] + again + right_ids[b:]
            a, b = a * (1 if whole_left else 2), b * (1 if whole_right else 2)

    def piece(self, text: str) -> Piece:
        """The encoding of a piece of a text. A special token is a word of its own, marked by a negative count."""
        ids, counts, at, runs = [], [], 0, []
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            section = text[at : m.start() if m else len(text)]
            runs.append(self.normalized(section))
            found = self.entries(*self.words(section))
            counts += [e[0].count(b" ") + 1 for e in found]
            ids += [int(i) for e in found for i in e[0].split()]
            if m:
                ids.append(self.special_id[m[0]])
                counts.append(-1)
                at = m.end()
        one = len(runs) == 1 and " " not in runs[0]
        return Piece(np.array(ids, np.int32), np.array(counts, np.int32), runs[0].partition(" ")[0], runs[-1].rpartition(" ")[2], one)

    def normalized(self, text: str) -> str:
        return re.sub(r"\s+", " ", text).lower() if SIMPLE.fullmatch(text) else self.tok.normalizer.normalize_str(text)

    def spans(self, run: str) -> list[tuple[str, int, int]]:
        """(symbols, start, end) of the words of normalized text without white space."""
        if SIMPLE.fullmatch(run):
            return [(self.symbols(m[0], self.known), m.start(), m.end()) for m in SPLIT.finditer(run)]
        return [(w, a, b) for w, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(run)]

    def joined(self, x: Piece, y: Piece) -> Piece:
        """Two neighbouring pieces as one. Without white space between them, the words around the join are split again;
        a word that is one of each side put together is concatenated, others are encoded anew."""
        head, tail = x.head + y.head * x.one, x.tail * y.one + y.tail
        if not x.tail or not y.head:
            return Piece(np.concatenate([x.ids, y.ids]), np.concatenate([x.counts, y.counts]), head, tail, x.one and y.one)
        left, right = self.spans(x.tail), self.spans(y.head)
        sure = max(i for i, (_, a, _) in enumerate(left) if a <= max(0, len(x.tail) - AHEAD))
        start = left[sure][1]
        join = len(x.tail) - start
        ends = {join + a: i for i, (_, a, _) in enumerate(right)} | {join + len(y.head): len(right)}
        words = []
        for w in self.spans(x.tail[start:] + y.head):
            words.append(w)
            if w[2] in ends:
                break
        drop, take = len(left) - sure, ends[words[-1][2]]
        left_ids = x.ids[len(x.ids) - int(x.counts[len(x.counts) - drop :].sum()) :]
        right_ids = y.ids[: int(y.counts[:take].sum())]
        if len(words) == drop == take == 1:
            made = [self.concat(left[sure][0], left_ids.tolist(), right[0][0], right_ids.tolist(), True)]
        else:
            made = [self.word(w) for w, _, _ in words]
        ids = np.concatenate([x.ids[: len(x.ids) - len(left_ids)], np.array([i for m in made for i in m], np.int32), y.ids[len(right_ids) :]])
        counts = np.concatenate([x.counts[: len(x.counts) - drop], np.array([len(m) for m in made], np.int32), y.counts[take:]])
        return Piece(ids, counts, head, tail, x.one and y.one)


@dataclass
class Piece:
    ids: np.ndarray
    counts: np.ndarray  # tokens of each word
    head: str  # normalized text before the first white space or special token
    tail: str  # and after the last one
    one: bool  # there is none


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def inert(c: str) -> bool:
    """Whether normalization leaves a character alone, whatever comes before it: ASCII, and letters and digits but conjoining Korean ones."""
    return c < "\x7f" and (c >= " " or c in "\t\n\r") or c.isalnum() and not "\u1100" <= c <= "\u11ff"


def cuts(text: str, piece: int, special: re.Pattern | None = None) -> list[int]:
    """Where a long text is cut: some ``piece`` characters apart, between two characters that are :func:`inert` and not within
    a special token. Text without such places stays whole."""
    tokens, out, at = [m.span() for m in special.finditer(text)] if special else [], [], piece
    i = 0
    while at < len(text):
        while i < len(tokens) and tokens[i][1] <= at:
            i += 1
        if i < len(tokens) and tokens[i][0] < at:
            at = tokens[i][1]
        elif inert(text[at - 1]) and inert(text[at]):
            out.append(at)
            at += piece
        else:
            at += 1
    return out


PIECE_COLUMNS = ("ids", "counts", "head", "tail", "one")
OUTPUTS = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def outputs(found: list[tuple[bytes, bytes]], columns: tuple[str, ...]) -> list:
    """The columns of one text from the entries of its words."""
    ids, row = b" ".join([e[0] for e in found]), []
    for c in columns:
        if c == "n_tokens":
            row.append(ids.count(b" ") + 1 if ids else 0)
        elif c == "ids":
            row.append([int(i) for i in ids.split()])
        elif c == "ids_sha256":
            row.append(hashlib.sha256(ids).hexdigest())
        else:
            names = b" ".join([e[1] for e in found])
            row.append(hashlib.sha256(names).hexdigest() if c == "decoded_sha256" else names.decode())
    return row


def table_of(rows: list[list], names: list[str], first: list[pa.Array], columns: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}
    made = [pa.array([r[i] for r in rows], kinds[OUTPUTS[c]]) for i, c in enumerate(columns)]
    return pa.RecordBatch.from_arrays([*first, *made], [*names, *columns])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded"), piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: id and the ``columns`` asked for, out of OUTPUTS.

    ``path``: a tokenizers file, at the same place on all nodes. ids and decoded are
    those of the library's encode (no special tokens added, no truncation or padding)
    and decode (special tokens kept). Null texts count as empty, which have no tokens.
    Rows that repeat are each returned. Other columns are ignored, whatever their names."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join(f"{c} {OUTPUTS[c]}" for c in columns)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            made = [outputs(own.encode(t.as_py()), columns) for t in batch.column("text")]
            yield table_of(made, ["id"], [batch.column("id")], columns)

    short = rows.where(F.length("text") <= piece).mapInArrow(whole, f"id {kind}, {schema}")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for row in range(len(batch)):
                text = batch.column("text")[row].as_py()
                marks = [0, *cuts(text, piece, own.special), len(text)]
                parts = [text[i:j] for i, j in zip(marks, marks[1:], strict=False)]
                n = len(parts)
                ids = pa.array([batch.column("id")[row].as_py()] * n, batch.schema.field("id").type)
                keys = pa.array([batch.column("key")[row].as_py()] * n, pa.int64())
                arrays = [ids, keys, pa.array(range(n), pa.int32()), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "i", "part"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for row in range(len(batch)):
                p = own.piece(batch.column("part")[row].as_py())
                one = batch.slice(row, 1)
                arrays = [one.column(c) for c in ("id", "key", "i", "copies")]
                arrays += [pa.array([p.ids]), pa.array([p.counts]), pa.array([p.head]), pa.array([p.tail]), pa.array([p.one])]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "i", "copies", *PIECE_COLUMNS])

    def united(key, group):
        own = encoder(path)
        group = group.sort_by("i")
        rows = [[group.column(c)[i] for c in PIECE_COLUMNS] for i in range(len(group))]
        nodes = [Piece(np.array(ids.values), np.array(counts.values), head.as_py(), tail.as_py(), one.as_py()) for ids, counts, head, tail, one in rows]
        while len(nodes) > 1:  # neighbours in pairs, up the tree
            nodes = [own.joined(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        row = outputs([own.made(nodes[0].ids.tolist())] if len(nodes[0].ids) else [], columns)
        copies = group.column("copies")[0].as_py()
        return pa.Table.from_batches([table_of([row] * copies, ["id"], [pa.array([group.column("id")[0].as_py()] * copies, group.schema.field("id").type)], columns)])

    long = rows.where(F.length("text") > piece).withColumn("key", F.xxhash64("id", "text"))
    parts = long.mapInArrow(cut, f"id {kind}, key bigint, i int, part string")
    # dealt out by piece; rows that repeat are encoded once and returned as often as they came
    parts = parts.groupBy("id", "key", "i").agg(F.first("part").alias("part"), F.count(F.lit(1)).alias("copies"))
    parts = parts.mapInArrow(encoded, f"id {kind}, key bigint, i int, copies bigint, ids array<int>, counts array<int>, head string, tail string, one boolean")
    joined = parts.groupBy("id", "key").applyInArrow(united, f"id {kind}, {schema}")
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLE: dict[str, str] = {}
