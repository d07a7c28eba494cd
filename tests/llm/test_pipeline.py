"""The pipeline's stages against brute force on a small corpus, and what each one keeps."""

import random

import corpus_pipeline as P
import pytest
from lodespark.llm import bpe, quality, simhash
from tests.llm.test_decontamination import plain as hits
from tests.llm.test_line_dedup import without_blocks as without_repeats
from tests.llm.test_simhash import classes, near, plain_print
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd, path = random.Random(7), tmp_path_factory.mktemp("sf")
    vocabulary = ["".join(rnd.choice(["ther", "ing", "an", "ed", "on", "re", "é"]) for _ in range(rnd.randrange(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ".", ","]) for _ in range(n))
    junk = lambda n: " ".join("".join(rnd.choice("QZXJ") for _ in range(5)) + "!!" for _ in range(n))
    passage, item = prose(70), prose(30)
    rows = []
    for i in range(160):
        t = junk(90) if i % 5 == 0 else prose(rnd.randrange(40, 160))
        if i % 9 == 1:
            # a word of its own on either side: what agrees beyond the passage with a later occurrence than the first one may stay
            t += f" {i}\n" + passage + f"\n{i} " + prose(30)
        if i % 11 == 2:
            t += "\n" + item + "\n" + prose(20)
        rows.append((i, t, "en", "s", len(t)))
    rows += [(200 + i, rows[6 + i][1], "en", "s", 1) for i in range(3)] + [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(15))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), item


def test_stages_equal_brute_force(spark, tables):
    path, item = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    assert [s for s, _ in P.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding"]

    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    of = model.scorer()
    kept = {r.doc_id: r.text for r in docs.collect() if of((r.text or "").encode()) >= quality.THRESHOLD}
    first = P.STAGES[0][1](spark, docs, path)
    assert first.columns == docs.columns and {r.doc_id: r.text for r in first.collect()} == kept
    wrong = [i for i in range(160) if (i in kept) != bool(i % 5)]
    assert len(wrong) <= 4, wrong

    kept = dict(without_repeats(sorted(kept.items())))
    docs = spark.createDataFrame(first.collect(), first.schema)
    second = P.STAGES[1][1](spark, docs, path)
    assert second.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in second.collect()} == {i: (t, None if t is None else len(t)) for i, t in kept.items()}

    prints = {i: plain_print(t) for i, t in kept.items()}
    group = classes(sorted(set(prints.values())), near(sorted(set(prints.values()))))
    kept = {i: t for i, t in kept.items() if i == min(j for j in kept if group[prints[j]] == group[prints[i]])}
    third = P.STAGES[2][1](spark, spark.createDataFrame(second.collect(), second.schema), path)
    assert third.columns == docs.columns and {r.doc_id: r.text for r in third.collect()} == kept

    clean = {i for i, _, n, _ in hits(list(kept.items()), items) if not n}
    kept = {i: t for i, t in kept.items() if i in clean}
    fourth = P.STAGES[3][1](spark, spark.createDataFrame(third.collect(), third.schema), path)
    assert fourth.columns == docs.columns and {r.doc_id: r.text for r in fourth.collect()} == kept and not any(item in (t or "") for t in kept.values())

    library = Tokenizer.from_file(bpe.tokenizer_path())
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in kept.items()}
    assert {r.doc_id: r.n_tokens for r in P.run(spark, path).collect()} == want
    assert simhash.BITS == 2


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_rows_of_one_id_or_none_are_decided_each_on_its_own(spark, tables):
    path, item = tables
    rnd = random.Random(12)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(7, f"{a} {item} x"), (7, a), (None, f"{item} {b}"), (None, b), (None, c), (9, c), (9, c), (3, None), (4, ""), (9, prose(40)), (None, f"{prose(50)} z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    kept = P.STAGES[3][1](spark, docs, path)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((i, t) for i, t in rows if item not in (t or "")), key=repr)
    near = sorted(((r.doc_id, r.text) for r in P.STAGES[2][1](spark, docs, path).collect()), key=repr)
    # c is in a row without an id and twice under 9; null and empty texts are linked
    want = [r for r in dict.fromkeys(rows) if r not in ((None, c), (4, ""))]
    assert near == sorted(want, key=repr)


def test_empty_table_through_all_stages(spark, tables):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs, tables[0]).count() == 0


def test_tables_of_finished_stages_are_deleted(spark, tables):
    import os

    from lodespark.workspace import shared_dir

    folder = f"{shared_dir(spark)}/lodespark"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    P.run(spark, tables[0]).count()
    assert [n.rpartition("-")[0] for n in set(os.listdir(folder)) - before] == ["stage-4"]
