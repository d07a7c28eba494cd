"""N-gram Jaccard join as a T-occurrence search.

Documents with equal shingle sets are one node. Shingles have one order for all:
those that a counting sketch of the whole corpus shows to be common come last, and
otherwise they go by hash. A node's first shingles in that order, a little more
than may differ, are looked for in inverted lists: two sets that reach the
similarity hold at least :func:`needed` of these in common (see there).

DivideSkip: inverted lists are merged per node on a heap, skipping ahead by binary
search, and nodes that occur often enough are retained; lists longer than ``LONG``
are not merged but probed, once a candidate is known, and lower the number of
occurrences asked for by as many of them as both nodes are in. A node in so many
long lists that this number could fall to zero (``spare``) is merged in them
too, with other such nodes, in blocks. Candidates are compared as texts, shingle
by shingle, so no link rests on a hash.

Most of a large group of near copies is linked first, each to the smallest node
of a list. After that, only pairs between different components are looked for: in
each list, the nodes outside its largest component are posted, and all nodes of
the list that are in a larger component than a posted one count it. So a group of n
near copies costs in proportion to n, and no link that joins components is lost."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizes import small
from .components import components
from .shared import bit_words, kept_tables, lookup, marked, materialize, slices, temporary_tables
from .words import grams, mix, whole, words_of

SIZE, PERCENT = 4, 85
#: Members outside its largest component from which a list is long, and the size of posted blocks.
LONG, POSTED = 256, 256
#: Counters of the sketch, as a power of 2, and how many go into one row of it.
SKETCH_BITS, ROW_BITS = 21, 15
#: Turns in which lists' nodes are linked to some of them before all pairs left are looked for; a turn in which fewer than one pair in FRUITLESS links is the last. A node is tried with some TRIES others a turn.
#: There are no more turns, either, once a node meets so few of other components in a list, in the mean.
STARS, FRUITLESS, TRIES, MEETS = 10, 40, 8, 32
#: Members compared with one node in one task, and those merged for one node in one task.
TOGETHER, MERGED = 64, 1 << 16

#: Bytes of the contract's words: all but white space.
FULL = np.ones(256, bool)
FULL[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def spare(n: int) -> int:
    """Occurrences that a node's prefix has beyond those that two sets of any sizes must share."""
    return 1 + n // 32


def rest(n: int, percent: int) -> int:
    """Shingles of a set of n that are not in its prefix; grows with n."""
    return max(0, (percent * n + 99) // 100 - spare(n))


def needed(a: int, b: int, percent: int) -> int:
    """Shingles that the prefixes of two similar sets of a and b have in common, at least.

    Sets of that similarity share ceil(percent (a + b) / (100 + percent)) shingles. Of the
    two prefixes let the one be that ends first in the order: a common shingle not
    in both prefixes comes after its end, and there are rest() of these at most."""
    return (percent * (a + b) + 99 + percent) // (100 + percent) - max(rest(a, percent), rest(b, percent))


def needed_sql(a: str, b: str, percent: int) -> str:
    left = "greatest(0, ({p} * {n} + 99) div 100 - 1 - {n} div 32)"
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent} - greatest({left.format(p=percent, n=a)}, {left.format(p=percent, n=b)}))"


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For all shingles of all texts, repeats included: the text, ascending, and the hash. A text of fewer words is one shingle."""
    w = words_of(texts, FULL)
    ok = whole(w, size)
    doc, found = [w.doc[: len(ok)][ok]], [grams(w, size)[ok]]
    count = np.diff(w.first)
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            doc.append(short)
            found.append(mix(grams(w, k)[w.first[short]] + np.uint64(k)))
    if len(doc) == 1:
        return doc[0], found[0]
    doc, found = np.concatenate(doc), np.concatenate(found)
    order = np.argsort(doc, kind="stable")
    return doc[order], found[order]


@dataclass
class Sets:
    doc: np.ndarray
    hash: np.ndarray  # distinct and ascending in each text
    first: np.ndarray  # where each text's begin, and the end
    n: np.ndarray
    sums: list[np.ndarray]  # two sums of mixed hashes, which with n stand for a set


def sets_of(texts: pa.Array, size: int) -> Sets:
    doc, h = shingles(texts, size)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[i:j].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
        sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return Sets(doc, h, first, np.diff(first), sums)


def own_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def sketch(texts: DataFrame, size: int) -> np.ndarray:
    """For each place of a shingle's hash, how many times the mean count of all places it has, as a power of 2.

    Counts of all texts; a task gives its counters as rows of 2^ROW_BITS, of which Spark
    adds up those of one range. What comes to the driver has a fixed size."""
    width = 1 << ROW_BITS

    def packed(i: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        n = n.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if n.max() <= np.iinfo(t).max))
        return pa.RecordBatch.from_arrays([pa.array([i, n.itemsize], pa.int32())[k : k + 1] for k in (0, 1)] + [pa.array([x.tobytes()], pa.binary()) for x in (at, n)], ["i", "size", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                at = shingles(part.column("text"), size)[1] >> np.uint64(64 - SKETCH_BITS)
                np.add.at(total, at.astype(np.int64), 1)
        for i in range(len(total) // width):
            own = total[i * width : (i + 1) * width]
            some = np.flatnonzero(own)
            if len(some):
                yield packed(i, some.astype(np.uint16), own[some]) if len(some) * 3 < width else packed(i, some[:0].astype(np.uint16), own)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, np.zeros(width, np.int64)
        for batch in batches:
            for i, size, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != last:
                    if last is not None:
                        yield packed(last, total[:0], total)
                    last, total = i, np.zeros(width, np.int64)
                total[np.frombuffer(at, np.uint16) if at else slice(None)] += np.frombuffer(n, f"u{size}").astype(np.int64)
        if last is not None:
            yield packed(last, total[:0], total)

    kind = "i int, size int, at binary, n binary"
    added = texts.select("text").mapInArrow(count, kind).repartition("i").sortWithinPartitions("i").mapInArrow(add, kind)
    out = np.zeros(1 << SKETCH_BITS, np.float64)
    for row in added.collect():
        out[row.i * width : (row.i + 1) * width] = np.frombuffer(row.n, f"u{row['size']}")
    return np.log2(np.maximum(1, out / max(1.0, out.mean()))).astype(np.uint8)


def described(texts: DataFrame, size: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """(id, n, k, prefix) per row: the set's size, what stands for it, and its first shingles in order, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column("text"), size)
                rank = ranks[(sets.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                h = sets.hash[np.argsort(sets.doc * 256 + rank, kind="stable")]
                packed = [h[i : i + n - rest(n, percent)].tobytes() for i, n in zip(sets.first.tolist(), sets.n.tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets.n), *(pa.array(x) for x in sets.sums), pa.array(packed, pa.binary())], ["id", "n", "k1", "k2", "prefix"])

    made = texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n bigint, k1 bigint, k2 bigint, prefix binary")
    return made.select("id", "n", F.struct("k1", "k2", "n").alias("k"), "prefix")


def unpacked(nodes: DataFrame, repeated: np.ndarray | None = None) -> DataFrame:
    """(token, uid, n): a row for each shingle of a prefix; with the bit map ``repeated``, of those it has a bit for,
    and of a node with :func:`spare` of these at least, as any partner shares as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("prefix").to_pylist()
            each = np.fromiter((len(p) // 8 for p in packed), np.int64, len(packed))
            token, of = np.frombuffer(b"".join(packed), np.uint64), np.repeat(np.arange(len(packed)), each)
            uid, n = (np.asarray(batch.column(c), np.int64) for c in ("uid", "n"))
            if repeated is not None:
                keep = marked(repeated, token)
                keep &= (np.bincount(of[keep], minlength=len(packed)) >= 1 + n // 32)[of]
                token, of = token[keep], of[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), uid[of], n[of])], ["token", "uid", "n"])

    return nodes.select("uid", "n", "prefix").mapInArrow(run, "token bigint, uid bigint, n bigint")


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(member, occurrences) of members of at least ``least`` of the sorted lists.

    The heads stand on a heap. If the smallest head stands at too few of them, as many
    heads as can't matter are taken off and moved, by binary search, to the next one left."""
    heap = [(own[0], i, 0) for i, own in enumerate(lists) if own]
    heapq.heapify(heap)
    while len(heap) >= least:
        low, taken = heap[0][0], []
        while heap and heap[0][0] == low:
            taken.append(heapq.heappop(heap))
        to = low + 1
        if len(taken) >= least:
            yield low, len(taken)
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                return
            to = heap[0][0]
        for _, i, at in taken:
            own = lists[i]
            at = bisect_left(own, to, at)
            if at < len(own):
                heapq.heappush(heap, (own[at], i, at))


def retained(n: int, s: int, lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], percent: int) -> list[int]:
    """Posted nodes that a node of n shingles in s long lists meets often enough. A list: ids, sizes and long lists of its posted nodes."""
    ids, sizes, longs = (np.concatenate(x) for x in zip(*lists, strict=True))
    common = np.minimum(s, longs)
    common[(s >= spare(n)) & (longs >= 1 + sizes // 32)] = 0  # both were merged in the long lists too
    most = np.maximum(rest(n, percent), np.maximum(0, (percent * sizes + 99) // 100 - 1 - sizes // 32))
    asked = (percent * (n + sizes) + 99 + percent) // (100 + percent) - most - common
    fit = 100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes)
    if not fit.any() or (least := max(1, int(asked[fit].min()))) > len(lists):
        return []
    by, at, own = dict(zip(ids[fit].tolist(), asked[fit].tolist(), strict=True)), 0, []
    for part, _, _ in lists:
        own.append(sorted(part[fit[at : at + len(part)]].tolist()))
        at += len(part)
    return [b for b, times in merge_skip(own, least) if times >= by[b]]


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): rows (uid, part, n, s, posted) merged by uid and part, where posted has (uid, n, s) of nodes of a list that a node shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, lists = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            posted = batch.column("posted")
            ends, flat = np.asarray(posted.offsets).tolist(), [np.asarray(posted.values.field(c), np.int64) for c in ("uid", "n", "s")]
            for i, now in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uid", "part", "n", "s")), strict=True)):
                if head is None or now[:2] != head[:2]:
                    if lists:
                        found += [(head[0], b) for b in retained(head[2], head[3], lists, percent)]
                    head, lists = now, []
                lists.append(tuple(x[ends[i] : ends[i + 1]] for x in flat))
            yield out(found)
        if lists:
            yield out([(head[0], b) for b in retained(head[2], head[3], lists, percent)])

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("uid", "part").sortWithinPartitions("uid", "part").mapInArrow(run, "a bigint, b bigint")


def crossing(listed: DataFrame, groups: DataFrame, percent: int, long: int = LONG) -> DataFrame:
    """(a, b): candidates among all pairs of nodes in different components, each once.

    listed: (token, uid, n) of lists of several nodes; groups: (uid, root) of nodes that are linked already."""
    own = materialize(listed.join(groups, "uid", "left").select("token", "uid", "n", F.coalesce("root", "uid").alias("root")), "members")
    # components in order: in each list the last one, mostly the largest, is not posted
    sizes = own.groupBy("root").agg(F.count(F.lit(1)).alias("w"))
    own = lookup(own, materialize(sizes, "sizes"), "root", "w").select("token", "uid", "n", F.struct("w", "root").alias("rank"))
    own = materialize(own, "ranked-members")
    lists = own.groupBy("token", "rank").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max("rank").alias("main"), F.max_by("c", "rank").alias("inside"), F.sum("c").alias("w"))
    lists = materialize(lists.where("w > inside").select("token", "main", "w", (F.col("w") - F.col("inside")).alias("others")), "crossing-lists")
    work = materialize(lookup(own, lists, "token", "w").where("main is not null"), "crossing-members")
    # how many long lists a node is in, and to how many nodes its lists post
    per = work.groupBy("uid").agg(F.count_if(F.col("others") > long).alias("s"), F.sum("others").alias("met"))
    work = work.join(per, "uid").where(f"others <= {long} or s >= 1 + n div 32")
    work = materialize(work.selectExpr("token", "uid", "n", "s", "rank", "rank <> main as outside", "others", f"cast(ceil(met / {MERGED}) as int) as parts"), "merged-members")
    posted = work.where("outside").withColumn("blk", F.expr(f"pmod(hash(uid), cast(ceil(others / {POSTED}) as int))"))
    posted = posted.groupBy("token", "blk").agg(F.collect_list(F.struct("uid", "n", "s", "rank")).alias("posted"))
    met = work.join(posted, "token").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    met = met.withColumn("posted", F.expr("transform(filter(posted, p -> p.rank < rank and pmod(hash(p.uid), parts) = part), p -> struct(p.uid as uid, p.n as n, p.s as s))"))
    return candidates(met.where("size(posted) > 0").select("uid", "part", "n", "s", "posted"), percent)


def words_shingled(text: str, size: int) -> set[bytes]:
    """The shingles of a text themselves."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only the contract's white space separates
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the similarity, shingle by shingle. texts: (uid, text).

    A node with many partners goes to several tasks with some of them each; a task
    holds one node's shingles and reads its partners one by one."""
    degree = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("w")), "degrees")
    dealt = lookup(pairs, degree, "a", "w").withColumn("part", F.expr(f"pmod(hash(b), cast(ceil(w / {TOGETHER}) as int))"))
    heads = dealt.select(F.col("a").alias("uid"), "a", "part").distinct().withColumn("kind", F.lit(0))
    rows = texts.join(small(materialize(heads.unionByName(dealt.select(F.col("b").alias("uid"), "a", "part", F.lit(1).alias("kind"))), "compared")), "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[bytes] = set()
        for batch in batches:
            found = []
            for uid, a, kind, text in zip(*batch.columns, strict=True):
                other = words_shingled(text.as_py(), size)
                if kind.as_py() == 0:
                    own = other
                    continue
                inter = len(own & other)
                if 100 * inter >= percent * (len(own) + len(other) - inter):
                    found.append((a.as_py(), uid.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    sent = rows.select("uid", "a", "kind", "text", "part").repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return sent.select("uid", "a", "kind", "text").mapInArrow(run, "a bigint, b bigint")


def texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(uid, text) of the wanted nodes (column uid): rows of their first ids are read again, and of those the ones with the node's set."""
    asked = materialize(nodes.select("uid", "first", "k").join(small(materialize(wanted.distinct(), "wanted")), "uid", "left_semi"), "asked")
    ids = small(asked.select(F.col("first").alias("id")).distinct())
    some = texts.join(ids, texts["id"].eqNullSafe(ids["id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column("text"), size)
                yield pa.RecordBatch.from_arrays([part.column("text"), *(pa.array(x) for x in sets.sums), pa.array(sets.n)], ["text", "k1", "k2", "n"])

    keyed = some.select("text").mapInArrow(run, "text string, k1 bigint, k2 bigint, n bigint").select("text", F.struct("k1", "k2", "n").alias("k"))
    return materialize(keyed.join(small(asked.select("uid", "k")), "k").groupBy("uid").agg(F.min("text").alias("text")), "candidate-texts")


def first_stars(listed: DataFrame, percent: int) -> DataFrame:
    """(a, b): the nodes of each list with its first one; pairs that share half of what is needed."""
    heads = listed.groupBy("token").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "a")
    found = listed.join(heads, "token").where("uid <> a").groupBy("a", "uid", "n").agg(F.count(F.lit(1)).alias("c")).where("2 * c >= 1 + n div 32")
    sizes = listed.select(F.col("uid").alias("a"), F.col("n").alias("m")).distinct()
    return found.join(sizes, "a").where(f"100 * least(n, m) >= {percent} * greatest(n, m) and 2 * c >= {needed_sql('n', 'm', percent)}").select("a", F.col("uid").alias("b"))


def work_left(listed: DataFrame, groups: DataFrame) -> float:
    """How many nodes of other components a node of a list meets there, in the mean."""
    own = listed.join(groups, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    lists = own.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max("c").alias("inside"), F.sum("c").alias("w"))
    return lists.agg(F.sum(F.col("w") * (F.col("w") - F.col("inside"))) / F.sum("w")).first()[0] or 0.0


def more_stars(listed: DataFrame, groups: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): each node outside the component that it shares most lists with, and some TRIES members of that, others each ``turn``."""
    own = materialize(listed.join(groups, "uid", "left").withColumn("root", F.coalesce("root", "uid")), "grouped")
    per = own.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("w"))
    lists = materialize(per.where("w > main.c").selectExpr("token", "main.root as root", "w"), "star-lists")
    shared = lookup(own.withColumnRenamed("root", "from"), lists, "token", "w").where("root <> from").groupBy("uid", "n", "root").agg(F.count(F.lit(1)).alias("c"))
    best = shared.where("c >= 1 + n div 32").groupBy("uid", "n").agg(F.max_by("root", F.struct("c", "root")).alias("root"))
    members = own.select("uid", "n", "root").distinct()
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    some = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(1 << 40)) * F.col("size") < F.lit(TRIES << 40)  # TRIES of each component, more or less
    leaders = members.join(sizes, "root").where(some).select(F.col("uid").alias("a"), F.col("n").alias("m"), "root")
    return best.join(leaders, "root").where(f"100 * least(n, m) >= {percent} * greatest(n, m)").select("a", F.col("uid").alias("b"))


def links(nodes: DataFrame, prefixes: DataFrame, texts: DataFrame, size: int = SIZE, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """(a, b): similar nodes, enough to connect all that are connected. nodes: (uid, first, k); prefixes: (uid, n, prefix); texts: (id, text)."""
    lists = unpacked(prefixes).groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    repeated = bit_words(materialize(lists.select(F.col("token").alias("h")), "repeated-shingles"))
    listed = materialize(unpacked(prefixes, repeated), "listed")
    own = texts_of(listed.select("uid"), nodes, texts, size)
    found, groups = None, None
    for turn in range(STARS):
        pairs = materialize(more_stars(listed, groups, percent, turn) if turn else first_stars(listed, percent), "stars")
        more = materialize(verified(pairs, own, size, percent), "star-links")
        found = found.unionByName(more) if found is not None else more
        groups = components(found).select(F.col("node").alias("uid"), "root")
        if work_left(listed, groups) <= MEETS or turn and more.count() * FRUITLESS < pairs.count():
            break
    pairs = materialize(crossing(listed, groups, percent, long), "candidates")
    return found.unionByName(verified(pairs, own, size, percent))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the smallest id that chains of links reach).

    Two rows are linked if their shingle sets' intersection is at least ``percent`` in a hundred
    of their union. A text of fewer words than ``size`` is one shingle; null and empty texts have
    none and are linked with nothing, so their component is their own id. Rows of one id with different
    texts are each on their own. A null id is never a component's name unless it has no other.
    Other columns are ignored, whatever their names."""
    spark = docs.sparkSession
    with temporary_tables(spark):
        texts = own_texts(docs, id_col, text_col)
        base = materialize(described(texts, size, percent, sketch(texts, size)).withColumn("uid", F.monotonically_increasing_id()), "sets")
        nodes = materialize(base.where("n > 0").groupBy("k").agg(F.min("uid").alias("uid"), F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "set-nodes")
        # of several copies, only the first one's prefix is looked at
        again = materialize(base.where("n > 0").select("uid").join(nodes.select("uid"), "uid", "left_anti"), "copies")
        prefixes = base.where("n > 0").select("uid", "n", "prefix").join(small(again), "uid", "left_anti")
        linked = components(materialize(links(nodes, prefixes, texts, size, percent, long), "links")).select(F.col("node").alias("uid"), "root")
        own = materialize(nodes.join(linked, "uid", "left").select("k", "first", "copies", F.coalesce("root", "uid").alias("root")), "set-roots")
        names = materialize(own.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("w")), "names")
        named = materialize(lookup(own, names, "root", "w").select("k", "copies", "component_id"), "named-sets")
        out = lookup(base.select("id", "n", "k"), named, "k", "copies")
        with kept_tables():
            return materialize(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.expr("if(n > 0, component_id, id)").alias("component_id")), "similar-documents")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
"""

QUERIES = {"op11_ngram_jaccard": op11_ngram_jaccard}
ORACLE = {"op11_ngram_jaccard": SQL}
