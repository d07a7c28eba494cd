"""A trie of conversation prefixes, from polynomial rolling fingerprints.

A prefix of turns t1..td has the fingerprint sum(t_i * B^i) modulo a prime, for two
primes. Turns are sorted over all partitions by conversation and turn, so a very
long conversation lies in many; each task scans its part with numpy cumulative
sums, and what lies before a part is added from one row a part. Sums can be shifted,
so the fingerprints of a conversation rebuilt from two others follow from theirs.

Equal fingerprints are only candidates for one node. In each group all turns are
compared with the representative's, by role and text themselves, together with the
nodes they continue; as a group's parents have been compared likewise, that proves
whole prefixes equal. A group that fails is split by content and its followers
with it. Statistics of subtrees need no walk: each node is counted at the smallest
conversation in it, and a conversation's total is added to all nodes it is in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizes import small
from .resampling import CRC_SQL
from .shared import kept_tables, lookup, materialize, temporary_tables

#: Primes below 2^31, so that products fit in 64 bits, and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 741103597)
SIBLINGS, HEAD = 5, 9
#: Turns of a node's conversations that are added up in one task.
BLOCK = 4096
#: Bytes of ids that are hashed as one piece.
PIECE = 1 << 20
#: The node of no turns.
ROOT = "named_struct('depth', 0L, 'f1', 0L, 'f2', 0L, 'x', -1L)"


def powers(n: int, base: int, prime: int) -> np.ndarray:
    """base^1 .. base^n modulo the prime, by doubling."""
    out = np.ones(n, np.int64)
    if n:
        out[0] = base
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * out[done - 1] % prime
        done += more
    return out


def scanned(turns: DataFrame) -> DataFrame:
    """(conv, part, i, s1, s2, u1, u2, role, text): turns in order, numbered from 1 within the part of a conversation that a partition has.

    s1 and s2 are the part's prefix sums with the turn, u1 and u2 without it. turns: (conv, turn, role, text).
    Ties of turn go by role and text; very long ones by their first 64 characters first."""
    names = ["conv", "part", "i", "s1", "s2", "u1", "u2", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, seen, sums = None, 0, [0, 0]  # of the conversation that the last batch ended in
        for batch in batches:
            c = np.asarray(batch.column("conv"), np.int64)
            if not len(c):
                continue
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            length = np.diff(np.append(first, len(c)))
            i = np.arange(len(c)) - np.repeat(first, length) + 1
            before, until = (seen, sums) if conv == c[0] else (0, [0, 0])
            s, u = [], []
            for k, (prime, base) in enumerate(zip(PRIMES, BASES, strict=True)):
                term = np.asarray(batch.column(f"t{k}"), np.int64) * powers(int(length.max()), base, prime)[i - 1] % prime
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term.astype(np.uint64))])
                own = ((total[1:] - np.repeat(total[first], length)) % np.uint64(prime)).astype(np.int64)
                for sums_of, x in ((s, own), (u, (own - term) % prime)):
                    x[: length[0]] = (until[k] + pow(base, before, prime) * x[: length[0]]) % prime
                    sums_of.append(x)
            i[: length[0]] += before
            conv, seen, sums = int(c[-1]), int(i[-1]), [int(x[-1]) for x in s]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), pa.array(np.full(len(c), part)), pa.array(i), *(pa.array(x) for x in (*s, *u)), batch.column("role"), batch.column("text")], names)

    # the fingerprint of a turn, neither zero nor as large as the primes
    both = F.struct("role", "text")
    kept = turns.withColumn("t0", F.pmod(F.xxhash64(both), F.lit(PRIMES[0] - 1)) + 1).withColumn("t1", F.pmod(F.xxhash64(F.lit(1), both), F.lit(PRIMES[1] - 1)) + 1)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64)]
    dealt = kept.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    return dealt.select("conv", "t0", "t1", "role", "text").mapInArrow(run, "conv bigint, part bigint, i bigint, s1 bigint, s2 bigint, u1 bigint, u2 bigint, role string, text string")


def carried(parts: DataFrame) -> DataFrame:
    """(conv, part, i0, o1, o2, p1, p2): for a conversation of several parts, turns and sums before each, and the bases' powers to shift it by.

    A partition has at most two conversations that go on beyond it, so there are few rows."""

    def run(key, table):
        n, sums, out = 0, [0, 0], []
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            shift = [pow(b, n, p) for b, p in zip(BASES, PRIMES, strict=True)]
            out.append((r["conv"], r["part"], n, *sums, *shift))
            sums = [(o + x * r[f"s{k + 1}"]) % PRIMES[k] for k, (o, x) in enumerate(zip(sums, shift, strict=True))]
            n += r["n"]
        return pa.table([list(x) for x in zip(*out, strict=True)], names=["conv", "part", "i0", "o1", "o2", "p1", "p2"])

    several = parts.join(parts.groupBy("conv").count().where("count > 1").select("conv"), "conv", "left_semi")
    return several.groupBy("conv").applyInArrow(run, "conv bigint, part bigint, i0 bigint, o1 bigint, o2 bigint, p1 bigint, p2 bigint")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, i, s, u, role, text): turns numbered from 1 in their conversation, with its prefix sums with and without each."""
    scan = materialize(scanned(turns), "scanned")
    parts = scan.groupBy("conv", "part").agg(F.max("i").alias("n"), F.max_by(F.struct("s1", "s2"), "i").alias("s"))
    carry = materialize(carried(materialize(parts.select("conv", "part", "n", "s.s1", "s.s2"), "parts")), "carried")
    joined = scan.join(F.broadcast(carry), ["conv", "part"], "left")  # two rows a partition at most
    sums = [F.struct(*[F.expr(f"if(i0 is null, {x}{k}, pmod(o{k} + p{k} * {x}{k}, {p}L))").alias(f"f{k}") for k, p in ((1, PRIMES[0]), (2, PRIMES[1]))]).alias(x) for x in ("s", "u")]
    return joined.select("conv", (F.col("i") + F.coalesce("i0", F.lit(0))).alias("i"), *sums, "role", "text")


def rebuilt(turns: DataFrame, siblings: int = SIBLINGS, head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and their turns (conv, depth, f, g, role, text, length), rebuilt.

    f is the fingerprint of the prefix that a turn ends, g that of the prefix before it."""

    def after(n: str, side: str) -> str:
        return f"if({n} = 0, named_struct('f1', 0L, 'f2', 0L), element_at({side}, cast({n} as int)))"

    convs = turns.groupBy("conv").agg(F.max("i").alias("n"), F.array_sort(F.collect_list(F.when(F.col("i") < head, F.struct("i", "s")))).alias("first"))
    convs = convs.select("conv", "n", F.col("first.s").alias("first"), (F.crc32(F.col("conv").cast("string")) % head).alias("h"), F.expr(f"conv - conv % {siblings}").alias("base"))
    convs = materialize(convs, "conversations")
    base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("first").alias("base_first"))
    info = convs.join(base, "base", "left").withColumn("m", F.expr("least(h, coalesce(base_n, 0))"))
    info = info.selectExpr("conv", "base", "n", "h", "m", f"{after('m', 'base_first')} as base_sum", f"{after('least(h, n)', 'first')} as own_sum", "m + greatest(n - h, 0) as length")
    info = materialize(info, "rebuilt")
    # own turns after the first h follow m turns of the base, so their terms are shifted by m - h, which is 0 or less
    own = lookup(turns, info.drop("base"), "conv", "n").where("i > h")
    shifted = []
    for x in ("s", "u"):
        parts = []
        for k, b, p in ((1, BASES[0], PRIMES[0]), (2, BASES[1], PRIMES[1])):
            by = f"element_at(array({', '.join(f'{pow(b, -m, p)}L' for m in range(head))}), cast(h - m + 1 as int))"
            parts.append(F.expr(f"pmod(base_sum.f{k} + pmod({x}.f{k} - own_sum.f{k}, {p}L) * {by}, {p}L)").alias(f"f{k}"))
        shifted.append(F.struct(*parts).alias("f" if x == "s" else "g"))
    own = own.select("conv", F.expr("m + i - h").alias("depth"), *shifted, "role", "text", "length")
    given = turns.where(f"i < {head} and conv % {siblings} = 0").withColumnRenamed("conv", "base")
    given = given.join(info.where("m > 0").select("conv", "base", "m", "length"), "base").where("i <= m")
    return info.select("conv", "length"), own.unionByName(given.select("conv", F.col("i").alias("depth"), F.col("s").alias("f"), F.col("u").alias("g"), "role", "text", "length"))


def settled(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv, node, up, role, text, length) and nodes (node, conv, n_convs, up, bytes), after comparison.

    A group's turns equal its representative's, and continue the same node, if the least and
    the greatest of them do. Of a group where they don't, each content becomes a node of
    its own, named by its smallest conversation, which the next turns then continue; these may
    have to be split likewise."""
    content = F.struct("up", "role", "text")
    while True:
        groups = members.groupBy("node").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min(content).alias("least"), F.max(content).alias("most"))
        nodes = materialize(groups.select("node", "conv", "n_convs", F.col("least.up").alias("up"), F.octet_length("least.text").cast("bigint").alias("bytes"), (F.col("least") == F.col("most")).alias("same")), "nodes")
        mixed = nodes.where("not same").select("node")
        if mixed.isEmpty():
            return members, nodes.drop("same")
        mixed = small(mixed)
        key = ["node", "up", "role", "text"]
        hit = members.join(mixed, "node", "left_semi")
        hit = materialize(hit.join(hit.groupBy(*key).agg(F.min("conv").alias("x")), key), "mixed")
        split = hit.withColumn("node", F.col("node").withField("x", F.col("x")))
        follow = split.select("conv", (F.col("node.depth") + 1).alias("depth"), F.col("node").alias("renamed"))
        every = members.join(mixed, "node", "left_anti").unionByName(split.drop("x")).withColumn("depth", F.col("node.depth"))
        every = every.join(follow, ["conv", "depth"], "left").withColumn("up", F.coalesce("renamed", "up"))
        members = materialize(every.drop("depth", "renamed"), "members")


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256): of each node, the digest of its ids in order. rows: (node, conv).

    Ids are sorted over all partitions and joined in pieces; only a digest's pieces are read one after another."""
    kind = rows.schema["node"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, last, ids, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            done = []
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if ids and (node != last or size > PIECE):
                    done.append((last, part, seq, ",".join(ids)))
                    seq, ids, size = seq + 1, [], 0
                last = node
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield piece(done)
        if ids:
            yield piece([(last, part, seq, ",".join(ids))])

    def piece(rows: list[tuple]) -> pa.RecordBatch:
        node = pa.struct([(c, pa.int64()) for c in ("depth", "f1", "f2", "x")])
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((node, pa.int64(), pa.int64(), pa.string()))], ["node", "part", "seq", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            done = []
            for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node == last:
                    sha.update(b",")
                else:
                    if sha:
                        done.append((last, 0, 0, sha.hexdigest()))
                    last, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            yield piece(done)
        if sha:
            yield piece([(last, 0, 0, sha.hexdigest())])

    made = f"node {kind}, part bigint, seq bigint, ids string"
    pieces = rows.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(join, made)
    return pieces.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(digest, made).select("node", F.col("ids").alias("ends_sha256"))


def before_in_chain(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``before``: what the nodes of the same conversation that are less deep save. Blocks of depths are added up first."""
    rows = nodes.withColumn("blk", F.expr(f"node.depth div {BLOCK}"))
    blocks = rows.groupBy("conv", "blk").agg(F.sum("saves").alias("sum"))
    far = blocks.join(blocks.where("blk > 0").select("conv").distinct(), "conv", "left_semi")  # the long ones alone
    far = far.withColumn("offset", F.sum("sum").over(Window.partitionBy("conv").orderBy("blk")) - F.col("sum")).select("conv", "blk", "offset")
    own = F.sum("saves").over(Window.partitionBy("conv", "blk").orderBy("node.depth")) - F.col("saves")
    return rows.withColumn("own", own).join(small(far), ["conv", "blk"], "left").withColumn("before", F.col("own") + F.coalesce("offset", F.lit(0))).drop("blk", "own", "offset")


def prefix_trie(conversations: DataFrame, siblings: int = SIBLINGS, head: int = HEAD, fingerprint: str | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    conversations: conv_id, turn, role, text; more columns are ignored. Conversation c becomes the first h
    turns of c - c % siblings, h being its CRC32 modulo ``head``, and its own after the first h. A null role or
    text is empty; turns that are equal, null ones first, go by role and text; repeated rows are turns of their
    own; rows without a conv_id belong to no conversation and are left out. No conversations: no rows, not even
    the root. ``fingerprint`` (tests): SQL of a pair of numbers to use in place of f."""
    spark = conversations.sparkSession
    with temporary_tables(spark):
        turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv is not null")
        convs, rows = rebuilt(numbered_turns(turns), siblings, head)
        for x in ("f", "g") if fingerprint else ():
            rows = rows.withColumn(x, F.expr(fingerprint.format(x)))
        node = "named_struct('depth', {d}, 'f1', {x}.f1, 'f2', {x}.f2, 'x', -1L)"
        rows = rows.selectExpr("conv", f"{node.format(d='depth', x='f')} as node", f"if(depth = 1, {ROOT}, {node.format(d='depth - 1', x='g')}) as up", "role", "text", "length")
        members, nodes = settled(materialize(rows, "members"))
        root = convs.selectExpr("conv", f"{ROOT} as node", "length")
        top = root.groupBy("node").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
        nodes = nodes.unionByName(top.selectExpr("node", "conv", "n_convs", f"if(true, null, {ROOT}) as up", "0L as bytes"))
        children = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saves", F.expr("(n_convs - 1) * bytes"))
        nodes = materialize(nodes, "trie")
        # a subtree's nodes are counted at their smallest conversations, which are all in it
        narrow = members.select("conv", "node", "length").unionByName(root)
        own = nodes.groupBy("conv").agg(F.sum("saves").alias("total"), F.max(F.expr("if(n_children = 0, 1, 0)")).alias("leaf"))
        own = materialize(own.join(convs.selectExpr("conv", "length + 1 as w"), "conv"), "totals")
        sums = lookup(narrow, own, "conv", "w").groupBy("node").agg(F.sum("total").alias("below"), F.sum("leaf").alias("n_leaves"))
        last = ends(narrow.where("length = node.depth"))
        parents = nodes.where("n_children > 0").select(F.col("node").alias("up"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("w"))
        found = lookup(before_in_chain(nodes), parents, "up", "w").drop("w")
        out = found.join(sums, "node").join(last, "node", "left")
        out = out.select(
            F.col("conv").alias("conv_id"), F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("bigint").alias("n_leaves"),
            (F.col("below") - F.col("before")).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
        with kept_tables():
            return materialize(out, "prefix-trie")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = rf"""
WITH RECURSIVE {CRC_SQL},
t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (SELECT conv_id, max(i) AS n, hex(encode(conv_id::VARCHAR)) AS x FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                         lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 9 AS h
  FROM ids, automaton
),
turns AS (
  SELECT c.conv_id, t.i AS depth, r, x FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.i - c.h, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN c b ON b.conv_id = c.base
),
whole AS (SELECT c.conv_id, coalesce(list({{'r': turns.r, 'x': turns.x}} ORDER BY depth) FILTER (depth IS NOT NULL), []) AS l FROM c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id),
members AS (SELECT conv_id, d AS depth, len(l) AS length, CASE WHEN d = 0 THEN '' ELSE to_json(l[1:d])::VARCHAR END AS path, CASE WHEN d = 0 THEN 0 ELSE strlen(l[d].x) END AS bytes
            FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM whole)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CASE WHEN length = depth THEN conv_id END::VARCHAR, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY path, depth
),
linked AS (SELECT n.*, p.path AS up, q.conv_id AS parent_conv_id FROM nodes n LEFT JOIN members p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes q ON q.path = p.path AND q.depth = p.depth),
children AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE up IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN children USING (path, depth)),
subtree AS (
  SELECT m.path, m.depth, sum((f.n_convs - 1) * f.bytes) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
  FROM full_nodes f JOIN members m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256
FROM full_nodes JOIN subtree USING (path, depth)
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLE = {"op12_prefix_trie": SQL}
