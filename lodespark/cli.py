"""ingest FILE, search QUERY, parse an image or a PDF, and evaluate retrieval from the command line."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .functions import text as T


def main(argv: list[str] | None = None, spark=None, generate=None, render=None) -> int:
    ap = argparse.ArgumentParser(prog="lodespark")
    sub = ap.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("file")
    b = sub.add_parser("search")
    b.add_argument("query")
    b.add_argument("--top-k", type=int, default=None)
    b.add_argument("--mode", choices=("hybrid", "dense", "bm25"), default="hybrid")
    c = sub.add_parser("parse")
    c.add_argument("file")
    c.add_argument("--out", default=None)
    d = sub.add_parser("evaluate")
    d.add_argument("file")
    d.add_argument("cases")
    for p in (a, b):
        p.add_argument("--index-dir", default=None)
    args = ap.parse_args(argv)
    for name in (getattr(args, "file", None), getattr(args, "cases", None)):
        if name is not None and not Path(name).is_file():
            print(f"no such file: {name}", file=sys.stderr)
            return 1
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lodespark").getOrCreate()
    from pyspark.sql import functions as F

    from .functions import registry
    from .operators import chunk, evaluate
    from .plans.engine import Engine
    from .settings import settings
    from .sources import chat, files

    if args.command == "parse":
        if Path(args.file).suffix.lower() == ".pdf":
            pages = files.pages(files.documents(spark, args.file), render or registry.renderer())
        else:
            pages = files.image_files(spark, args.file)
        row = files.parsed(pages, generate or chat.generator(settings(), vision=True)).first()
        out = Path(args.out or Path(args.file).with_name(f"{Path(args.file).stem}_parsed.md"))
        out.write_text(row.text if row else "", encoding="utf-8")
        print(out)
        return 0
    if args.command == "evaluate":
        conf = settings()
        made = chunk.chunk(files.text_files(spark, args.file), conf.chunk_size, conf.chunk_overlap).select(F.col("chunk_id").alias("ord"), "text")
        asked = files.cases(spark, args.cases)
        rows = evaluate.by_mode(made, asked.select("qid", F.col("question").alias("text")), asked.select("qid", "gold"), ("bm25", "dense", "hybrid")).orderBy("mode").collect()
        print(evaluate.table([r.asDict() for r in rows], ["mode", "hit_1", "hit_3", "hit_5", "mrr"]))
        return 0
    engine = Engine(spark, path=args.index_dir)
    if args.command == "ingest":
        print(f"{engine.ingest(files.text_files(spark, args.file))} chunks")
        return 0
    found = engine.search(spark.createDataFrame([(0, args.query)], "qid bigint, text string"), args.top_k, args.mode)
    for r in found.orderBy("rank").select("rank", "key", F.format_string("%.4f", "score").alias("score"), "dense_rank", "bm25_rank", T.preview(F.col("text")).alias("text")).collect():
        print(f"{r.rank}. {r.key} score={r.score} dense={r.dense_rank} bm25={r.bm25_rank}\n   {r.text}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
