"""The retrieval index as tables, under a log of commits.

A batch is written as folders of its own name: chunks, postings and the document frequency
of each token, both in parts by a hash of the token, and embeddings. It counts from
when a commit names it, so a reader never sees half of one, and a failed write leaves
only folders that nobody reads, which :meth:`Index.vacuum` deletes. Commits are numbered
files, each of which only one writer can put in place; a writer that comes second
takes the next number. Within a batch chunks are numbered from 0, and its commit says where it
starts, so writers need not wait for each other.

A commit may also replace batches by one that holds the same (:meth:`Index.compact`):
readers that have read the log before go on with the old folders, later ones read the new ones.

Statistics are kept by batch: chunks and tokens in the commit, document frequencies in a
table. A search adds them up, and reads the postings of the parts that its tokens are in;
chunks are read only for the results."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import registry
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunk as C
from ..operators import dense, fuse, lexical, number
from ..operators.sizes import small
from ..workspace import delete, exists, materialize, temporary_tables

BUCKETS = 4096
#: Parts of postings and frequencies, by a hash of the token.
PARTS = 64
META = "embedder string, dim int, tokenizer string, n bigint, version int, batch string, start bigint, size bigint, n_tokens bigint, token string, replaces array<string>"
#: Tokens of the queries up to which a search names their parts and values to the files.
FEW_TOKENS = 1000
KINDS = ("chunks", "postings", "terms", "embeddings")
_claiming = threading.Lock()


def part_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


def numbered(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ord, counting from 0 by one of BUCKETS buckets, document and chunk."""
    return number.numbered(chunks, F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)), ["doc_id", "chunk_id", "text"], "ord")


class Index:
    def __init__(self, spark: SparkSession, path: str, embedder: str = "hash", dim: int = V.DIM, size: int = C.SIZE, overlap: int = C.OVERLAP, tokenizer: str = "words", tokens=None):
        """Opens the index at ``path``, or starts one. One written with another embedder, length of vectors or tokenizer is an error.

        ``embedder``: a name that registry.embedder knows; it embeds documents and queries. ``tokenizer``: one
        that registry.tokenizer knows, or any name with a function ``tokens`` from a text column to one of tokens."""
        self.spark, self.path, self.embedder, self.dim, self.size, self.overlap, self.tokenizer = spark, path.rstrip("/"), embedder, dim, size, overlap, tokenizer
        found = self.meta()
        for what, own in (("embedder", embedder), ("dim", dim), ("tokenizer", tokenizer)):
            if found[what] != own:
                raise ValueError(f"the index at {path} has {what} {found[what]}, not {own}")
        self.tokens = tokens or (T.words if tokenizer == "words" else registry.tokenizer(tokenizer))

    def embed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the embedding of their text by the index's embedder; vectors of another length are an error."""
        if self.embedder == "hash":
            return dense.embed(rows, dim=self.dim)
        made = registry.embedder(self.embedder)(rows)
        wrong = F.raise_error(F.format_string(f"embedder {self.embedder} gave %d numbers, not {self.dim}", F.size("embedding"))).cast("array<float>")
        return made.withColumn("embedding", F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(wrong))

    # the log

    def log(self) -> list[dict]:
        """All commits in order."""
        if not exists(self.spark, f"{self.path}/meta"):
            return []
        rows = self.spark.read.schema(META).option("pathGlobFilter", "[0-9]*.json").json(f"{self.path}/meta").orderBy("version").collect()
        return [r.asDict() for r in rows]

    def batches(self, log: list[dict] | None = None) -> list[dict]:
        """The commits whose batches hold the index now, in the order of their chunks."""
        log = self.log() if log is None else log
        gone = {name for row in log for name in row["replaces"] or ()}
        return sorted((row for row in log if row["size"] and row["batch"] not in gone), key=lambda row: row["start"])

    def meta(self) -> dict:
        """embedder, dim, tokenizer, number of chunks n and of batches."""
        log = self.log()
        last = log[-1] if log else {"embedder": self.embedder, "dim": self.dim, "tokenizer": self.tokenizer, "n": 0}
        return {"embedder": last["embedder"], "dim": last["dim"], "tokenizer": last["tokenizer"], "n": last["n"], "batches": len(self.batches(log))}

    def put(self, name: str, content: bytes) -> bool:
        """Put a file of the log in place, whole, unless one of that name is there.

        On a local disk a hard link does that, elsewhere a rename that does not replace, as HDFS has it."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/{n}")
        files, own = place(name).getFileSystem(conf), place(f"_{uuid.uuid4().hex}")
        out = files.create(own, False)
        out.write(content)
        out.close()
        try:
            if files.getScheme() == "file":
                local = [p.toUri().getPath() for p in (own, place(name))]
                try:
                    os.link(*local)
                except FileExistsError:
                    return False
                return True
            return not files.exists(place(name)) and files.rename(own, place(name))
        finally:
            if files.exists(own):
                files.delete(own, False)

    def commit(self, size: int, n_tokens: int, batch: str, token: str | None = None, replaces: list[dict] | None = None) -> bool:
        """Add a batch of ``size`` chunks after all others, or in the place of others.

        False if there is one of that token already, or if one of the others has been replaced meanwhile."""
        while True:
            with _claiming:  # threads of one driver need not race for the file
                log = self.log()
                if token is not None and any(r["token"] == token for r in log):
                    return False
                names = [r["batch"] for r in replaces or ()]
                if not set(names) <= {r["batch"] for r in self.batches(log)}:
                    return False
                before = log[-1] if log else {"version": -1, "n": 0}
                row = {"embedder": self.embedder, "dim": self.dim, "tokenizer": self.tokenizer, "version": before["version"] + 1, "batch": batch, "size": size, "n_tokens": n_tokens, "token": token, "replaces": names}
                row |= {"n": before["n"], "start": replaces[0]["start"]} if replaces else {"n": before["n"] + size, "start": before["n"]}
                if self.put(f"{row['version']:08d}.json", json.dumps(row).encode()):
                    return True

    # tables

    def table(self, name: str, kind: str, batches: list[dict] | None = None) -> DataFrame:
        """A table over all batches; ord, where it has one, is counted over all of them."""
        rows = self.batches() if batches is None else batches
        if not rows:
            return self.spark.createDataFrame([], kind)
        paths = [f"{self.path}/{name}/batch={r['batch']}" for r in rows]
        read = self.spark.read.schema(f"{kind}, batch string").option("basePath", f"{self.path}/{name}").parquet(*paths)
        if "ord" not in read.columns:
            return read.drop("batch")
        starts = self.spark.createDataFrame([(r["batch"], r["start"]) for r in rows], "batch string, start bigint")  # one row a batch
        return read.join(F.broadcast(starts), "batch").withColumn("ord", F.col("ord") + F.col("start")).drop("batch", "start")

    def chunks(self, batches: list[dict] | None = None) -> DataFrame:
        return self.table("chunks", "ord bigint, doc_id string, chunk_id int, section string, text string, key string, dl int", batches)

    def postings(self, batches: list[dict] | None = None) -> DataFrame:
        return self.table("postings", "tok string, ord bigint, dl int, tf bigint, part int", batches)

    def terms(self, batches: list[dict] | None = None) -> DataFrame:
        """(tok, df, part) of each batch; a token's frequency is the sum over them."""
        return self.table("terms", "tok string, df bigint, part int", batches)

    def embeddings(self, batches: list[dict] | None = None) -> DataFrame:
        return self.table("embeddings", "ord bigint, embedding array<float>", batches)

    # writing

    def write(self, name: str, batch: str, rows: DataFrame) -> None:
        """Tokens by parts, each file sorted by them: one file a part, or of postings more where there are more shuffle partitions.

        Rows are dealt out by hash, as a range would have to be sampled, and the rows made twice for that."""
        out = rows.write
        if name in ("postings", "terms"):
            own = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // PARTS) if name == "postings" else 1
            salt = F.pmod(F.xxhash64("ord"), F.lit(own)) if own > 1 else F.lit(0)
            out = rows.withColumn("part", part_of(F.col("tok"))).repartition("part", salt).sortWithinPartitions("part", "tok").write.partitionBy("part")
        out.parquet(f"{self.path}/{name}/batch={batch}")

    def write_terms(self, batch: str) -> None:
        posts = self.spark.read.parquet(f"{self.path}/postings/batch={batch}")
        self.write("terms", batch, posts.groupBy("tok").agg(F.count(F.lit(1)).alias("df")))

    def add(self, docs: DataFrame, token: str | None = None) -> int:
        """Index documents (doc_id, text); the number of their chunks. A document that comes again is there twice.

        ``token``: names this batch; a batch of a token that the index has already is not added again."""
        if token is not None and any(r["token"] == token for r in self.log()):
            return 0
        batch = uuid.uuid4().hex
        with temporary_tables(self.spark):
            made = C.chunk(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), self.size, self.overlap)
            made = numbered(materialize(lexical.with_length(made, self.tokens), "chunks")).withColumn("key", C.chunk_key(F.col("doc_id"), F.col("chunk_id")))
            self.write("chunks", batch, made.select("ord", "doc_id", "chunk_id", "section", "text", "key", "dl"))
        own = self.spark.read.parquet(f"{self.path}/chunks/batch={batch}")
        n, n_tokens = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if n:
            self.write("postings", batch, lexical.all_postings(own.select("ord", "text"), self.tokens).select("tok", "ord", "dl", "tf"))
            self.write_terms(batch)
            self.write("embeddings", batch, self.embed(own.select("ord", "text")).select("ord", "embedding"))
        if n and self.commit(n, n_tokens, batch, token):
            return n
        self.drop(batch)
        return 0

    def drop(self, batch: str) -> None:
        for kind in KINDS:
            delete(self.spark, f"{self.path}/{kind}/batch={batch}")

    def compact(self, least: int = 2) -> bool:
        """Replace all batches by one, if there are ``least`` or more: later searches read fewer files. Chunks keep their numbers.

        False if there was nothing to do, or another compaction was first. What was there before stays until :meth:`vacuum`."""
        old = self.batches()
        if len(old) < max(2, least):
            return False
        batch, start = uuid.uuid4().hex, old[0]["start"]
        for kind, rows in (("chunks", self.chunks(old)), ("postings", self.postings(old).drop("part")), ("embeddings", self.embeddings(old))):
            self.write(kind, batch, rows.withColumn("ord", F.col("ord") - start))
        self.write("terms", batch, self.terms(old).groupBy("tok").agg(F.sum("df").alias("df")))
        if self.commit(sum(r["size"] for r in old), sum(r["n_tokens"] for r in old), batch, replaces=old):
            return True
        self.drop(batch)
        return False

    def vacuum(self, older_than: float = 24 * 3600) -> int:
        """Delete the folders of batches that no longer, or never, came to be part of the index and were written ``older_than`` seconds ago; their number.

        That should be longer than any reader or writer takes."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        keep, gone = {r["batch"] for r in self.batches()}, set()
        for kind in KINDS:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
            files = folder.getFileSystem(conf)
            for status in files.listStatus(folder) if files.exists(folder) else ():
                name = status.getPath().getName().removeprefix("batch=")
                if name not in keep and status.getModificationTime() / 1000 <= time.time() - older_than:
                    files.delete(status.getPath(), True)
                    gone.add(name)
        return len(gone)

    # searching

    def asked_only(self, table: DataFrame, asked: DataFrame) -> DataFrame:
        """The rows of the queries' tokens; of few tokens by their parts and values, which reach the files, of many by a join."""
        vocabulary = asked.select("tok").distinct()
        some = vocabulary.select("tok", part_of(F.col("tok")).alias("part")).limit(FEW_TOKENS + 1).collect()
        if len(some) > FEW_TOKENS:
            return table.join(small(vocabulary), "tok", "left_semi")
        return table.where(F.col("part").isin(sorted({r.part for r in some})) & F.col("tok").isin([r.tok for r in some]))

    def wanted_postings(self, asked: DataFrame, batches: list[dict] | None = None) -> DataFrame:
        return self.asked_only(self.postings(batches), asked).drop("part")

    def bm25(self, queries: DataFrame, k: int, batches: list[dict] | None = None) -> DataFrame:
        batches = self.batches() if batches is None else batches
        n, n_tokens = sum(r["size"] for r in batches), sum(r["n_tokens"] for r in batches)
        asked = lexical.query_terms(queries, tokens=self.tokens)
        df = self.asked_only(self.terms(batches), asked).groupBy("tok").agg(F.sum("df").alias("df"))
        known = df.select("tok", lexical.idf(F.lit(n), F.col("df")).alias("idf"))
        stats = self.spark.range(1).select(F.lit(n_tokens / n if n else 0.0).alias("avgdl"))
        return lexical.ranked(lexical.best(asked, known, lexical.weighted(self.wanted_postings(asked, batches), stats), k), k)

    def dense(self, queries: DataFrame, k: int, batches: list[dict] | None = None) -> DataFrame:
        return dense.dense_vectors(self.embeddings(batches), self.embed(queries.select("qid", "text")), k)

    def search(self, queries: DataFrame, k: int = 5, mode: str = "hybrid", rrf_k: int = fuse.RRF_K, with_ranks: bool = True) -> DataFrame:
        """The ``k`` best chunks of each query (qid, text), with the columns of schemas.RESULT, qid and rank. The log is read once."""
        now = self.batches()
        best = fuse.fused({"dense": lambda d: self.dense(queries, d, now), "bm25": lambda d: self.bm25(queries, d, now)}, k, mode, rrf_k, with_ranks)
        return fuse.with_payload(best, self.chunks(now)).select("qid", "rank", *schemas.RESULT.names)


def health(index: Index) -> dict:
    return {"status": "ok", "chunks": index.meta()["n"]}


def source_json(result: Column) -> Column:
    """A result as JSON, with null ranks spelt out."""
    return F.to_json(result, {"ignoreNullFields": "false"})
