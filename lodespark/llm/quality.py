"""Quality scores from compressed sizes.

Two zstandard dictionaries are built from labelled text, one of good and one of
bad documents. A text is compressed with either, in blocks of ``BLOCK`` bytes so
that the dictionary and not the text's own past decides. The difference of the
two sizes per byte is turned into a probability by a logistic curve, fitted on
labelled rows that the dictionaries have not seen; the smaller of the sizes per
byte is the curve's second input, as the same difference says more about text
that hardly shrinks than about text that repeats itself."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.arrow import map_in_arrow

#: Labelled documents used at most, for each label, for the dictionaries and for the curve; each is taken whole.
SAMPLE = 1200
BLOCK, DICT_BYTES, LEVEL = 1024, 110_000, 3
#: Added to the length that the difference is divided by: a few bytes decide little about a short text.
SMOOTH = 200
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]  # of the difference, of the smaller size, and the intercept
    level: int = LEVEL

    def scorer(self):
        """A function from bytes to the score; compressors are made once per worker."""
        good, bad = compressors(self.good, self.bad, self.level)
        return lambda text: float(sigmoid(sum(w * x for w, x in zip(self.weights, (*sizes(text, good, bad), 1.0), strict=True))))


def compressors(good: bytes, bad: bytes, level: int) -> list[zstandard.ZstdCompressor]:
    made = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
    for d in made:
        d.precompute_compress(level=level)
    return [zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False) for d in made]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def sizes(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float]:
    """How much smaller the text gets with the dictionary of good text, and the smaller size, per byte; zeros for an empty text."""
    a = b = 0
    for i in range(0, len(text), BLOCK):
        block = text[i : i + BLOCK]
        a += len(good.compress(block))
        b += len(bad.compress(block))
    return ((b - a) / (len(text) + SMOOTH), min(a, b) / len(text)) if text else (0.0, 0.0)


def fold(id_col: Column, folds: int = 5) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> list[tuple[int, int, str]]:
    """(label, part, text) of at most ``most`` labelled documents per label, spread by a hash of their id.

    The ids are chosen first, so what meets the documents is at most 2 * most rows. Of
    rows that share an id the one with the smallest text counts."""
    known = labels.where(f"{label_col} in (0, 1) and {id_col} is not null").groupBy(id_col).agg(F.max(label_col).alias("label"), F.min(label_col).alias("least")).where("label = least")
    known = known.where(fold(F.col(id_col)) != 0)
    picked = [known.where(F.col("label") == v).select(F.col(id_col).alias("__id"), F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(most) for v in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    found = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(chosen, "__id")
    found = found.groupBy("__id", "label").agg(F.min("t").alias("text"))
    rows = found.select("label", F.pmod(F.xxhash64("__id"), F.lit(2)).cast("int").alias("part"), "text", "__id").orderBy("__id").collect()  # 2 * most at most
    return [(r.label, r.part, r.text) for r in rows]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE, level: int = LEVEL) -> Model:
    """Fit on labelled rows whose crc32(id as text) mod 5 is not 0: half of the sample makes the dictionaries, half the curve.

    With no labelled text of a kind, its dictionary is empty, and with none at all every score is one half."""
    rows = [(v, p, t.encode()) for v, p, t in sampled(docs, labels, id_col, text_col, label_col, most)]
    made = [dictionary([t for v, p, t in rows if v == want and p == 0]) for want in (1, 0)]
    good, bad = compressors(*made, level)
    held = [(*sizes(t, good, bad), v) for v, p, t in rows if p == 1 and t]
    return Model(made[0], made[1], logistic(np.array([x[:2] for x in held], float).reshape(-1, 2), np.array([x[2] for x in held], float)), level)


def dictionary(texts: list[bytes]) -> bytes:
    """The texts themselves where they fit, and else their most useful pieces.

    If zstandard finds nothing to choose by, pieces that lie evenly over all texts."""
    pieces = [t[i : i + 1024] for t in texts for i in range(0, len(t), 1024)]
    total = sum(map(len, pieces))
    if total <= DICT_BYTES:
        return b"".join(pieces)
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, total // 4), pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces[:: -(-total // DICT_BYTES)])[:DICT_BYTES]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights and intercept of the likeliest logistic curve, by Newton's steps on columns of unit deviation."""
    if not len(x) or y.min() == y.max():
        return (*[0.0] * x.shape[1], 0.0 if not len(x) else 2.0 if y[0] else -2.0)
    middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-12
    a = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale).tolist(), float(w[-1] - (w[:-1] / scale * middle).sum()))


def with_score(docs: DataFrame, model: Model, column: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the score of each whole text in a further column, which replaces one of that name.

    Null and empty texts get the score of a difference of zero. Rows that repeat are
    each scored. All other columns stay, whatever their names."""
    keep = [c for c in docs.columns if c != column]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            made = [of((t.as_py() or "").encode()) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(made, pa.float64())], [*keep, column])

    rows = docs.select(*(f"`{c}`" for c in keep))
    return map_in_arrow(rows, run, StructType([*rows.schema.fields, StructField(column, DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score, as of :func:`with_score`."""
    return with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).select(F.col("id").alias(id_col), "score")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
ORACLE: dict[str, str] = {}
