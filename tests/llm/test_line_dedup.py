"""Line dedup against a plain loop over all documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodespark.llm import line_dedup as L
from lodespark.llm.words import mix, run_hashes

SPACES = " \t\n\v\f\r"


def cut(text):
    """(chunk, lines, words) of a text, line by line; only the hashes of words are the module's."""
    lines, line = [], ""
    for part in re.split("(\n)|(?<=[.!?])(?=[ \t\n\v\f\r])", text):
        line += part or ""
        if part == "\n" or part and part[-1] in ".!?":
            lines.append(line)
            line = ""
    lines.append(line)
    joined = []  # white space alone is no line: it goes with the one before, at the start with the first
    for x in lines:
        lead = len(x) - len(x.lstrip(SPACES))
        if not x.strip(SPACES):
            if joined:
                joined[-1] += x
            else:
                joined.append(x)
        elif joined and joined[-1].strip(SPACES):
            joined[-1] += x[:lead]
            joined.append(x[lead:])
        else:
            joined[-1:] = [(joined[-1] if joined else "") + x]
    if not joined or not joined[0].strip(SPACES):
        return []
    own = [L.split(pa.array([x]))[4] for x in joined]
    one = [int(run_hashes(h, np.array([0]), np.array([len(h)]))[0]) for h in own]
    rolled = [max(1, int(mix(np.array([(h + 3 * (one[i - 1] if i else 0)) % (1 << 64)], np.uint64))[0])) for i, h in enumerate(one)]
    at = lambda i: rolled[i] if 0 <= i < len(rolled) else 0
    again = [at(i) == at(i - 1) for i in range(len(rolled))]
    ends = [i for i in range(len(rolled)) if i == len(rolled) - 1 or at(i) > at(i - 1) and at(i) >= at(i + 1) or again[i] and not (again[i - 1] and again[i + 1])]
    out, start = [], 0
    for e in ends:
        some = joined[start : e + 1]
        out.append(("".join(some), len(some), len("".join(some).encode().split())))
        start = e + 1
    return out


def plain(rows, min_words=L.MIN_WORDS):
    """Runs of repeated chunks taken out; kept are the first occurrences, by id (null last) and place."""
    found = [cut(t or "") for _, t in rows]
    first = {}
    for (i, _), cs in zip(rows, found, strict=True):
        for c, _, _ in cs:
            if i is not None:
                k = c.rstrip(" \n")
                first[k] = min(first.get(k, i), i)
    out = []
    for (i, t), cs in zip(rows, found, strict=True):
        seen, left, run = set(), "", []
        for c, lines, words in [*cs, (None, 0, 0)]:
            k = c and c.rstrip(" \n")
            if c is not None and (k in seen or first.get(k, i) != i):
                run.append((c, lines, words))
            else:
                if sum(x[1] for x in run) < L.MIN_LINES or sum(x[2] for x in run) < min_words:
                    left += "".join(x[0] for x in run)
                left, run = left + (c or ""), []
            seen.add(k)
        out.append((i, t if not cs else left))
    return out


def sentences(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(2, 8))) + rnd.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def test_equals_plain_loop(spark):
    rnd = random.Random(4)
    passages = [sentences(rnd, 70) for _ in range(6)]
    rows = []
    for i in range(60):
        t = sentences(rnd, rnd.randrange(0, 120))
        for p in rnd.sample(passages, rnd.randrange(0, 3)):
            t += "\n" + p + "\n" + sentences(rnd, rnd.randrange(0, 60))
        rows.append((i, t))
    rows += [(60, None), (61, ""), (62, rows[5][1]), (63, "\n\n\n"), (64, rows[7][1] + rows[7][1]), (None, rows[5][1]), (62, rows[5][1]), (65, "same line, again.\n" * 500)]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, key string, h int")
    out = L.deduplicate_lines(docs)
    assert out.columns == ["doc_id", "text", "key", "h", "chunks_removed", "chars_removed"]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in out.collect()))
    assert got == sorted(((i is None, i or 0, t is None, t or "") for i, t in plain(rows)))


def test_chunks_make_up_the_text():
    rnd = random.Random(1)
    texts = [sentences(rnd, rnd.randrange(0, 90)) for _ in range(40)] + ["", None, ". . . .\n\n", "x", re.sub(" ", "", sentences(rnd, 50))]
    found = L.split(pa.array(texts))
    c = L.chunks(found)
    for i, t in enumerate(texts):
        assert b"".join(found[0][s:e].tobytes() for d, s, e in zip(c["doc"], c["start"], c["end"], strict=True) if d == i).decode() == (t or "")


@pytest.mark.parametrize("lines", [5, 8])
def test_repeated_blocks_of_lines(spark, lines):
    """Blocks of whole lines in two documents each; eight lines have PASSAGE words, five often fewer. All lines that do not repeat stay whole."""
    rnd = random.Random(lines)
    line = lambda: " ".join(plain_words(rnd, rnd.randrange(5, 16))).replace(".", "") + "\n"
    rows, blocks = [], []
    for n in range(120):
        block = "".join(line() for _ in range(lines))
        blocks.append(block)
        rows += [(2 * n + k, "".join(line() for _ in range(rnd.randrange(0, 9))) + block + "".join(line() for _ in range(rnd.randrange(0, 9)))) for k in range(2)]
    for passages, least in ((False, 0.25), (True, 0.6 if lines < 8 else 0.99)):
        out = {r.doc_id: r for r in L.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), passages=passages).collect()}
        gone = sum(out[2 * n + 1].chars_removed for n in range(120))
        recall = gone / sum(map(len, blocks))
        print(f"{lines} lines, passages {passages}: recall {recall:.3f}")
        assert recall >= least and all(out[2 * n].text == rows[2 * n][1] for n in range(120))
        for n in range(120):
            left, before = out[2 * n + 1].text, rows[2 * n + 1][1]
            kept = before[: before.index(blocks[n])] + before[before.index(blocks[n]) + len(blocks[n]) :]
            assert set(kept.split("\n")) <= set(left.split("\n"))  # all other lines stay whole
            if not passages:
                assert set(left.split("\n")) <= set(before.split("\n"))


def test_empty_table(spark):
    assert L.deduplicate_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def without_repeats(rows):
    """Words of each text that no window of PASSAGE words has in a text before it or earlier in it; no cutter is used."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = t.split()
        gone = set()
        for k in range(len(w) - L.PASSAGE + 1):
            window = tuple(w[k : k + L.PASSAGE])
            if window in seen:
                gone.update(range(k, k + L.PASSAGE))
            seen.add(window)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def gone_from_both(rows):
    """The characters of each text in runs of repeated chunks and repeated passages of PASSAGE words; both are looked for in the texts as they were."""
    seen, out, left = set(), [], dict(enumerate(t for _, t in plain(rows)))
    for n, (i, t) in enumerate(rows):
        gone = bytearray(len(t or ""))
        at, rest = 0, left[n] or ""
        for c, _, _ in cut(t or ""):  # what plain has left, chunk by chunk
            if rest.startswith(c):
                rest = rest[len(c) :]
            else:
                gone[at : at + len(c)] = b"\1" * len(c)
            at += len(c)
        words = [m.span() for m in re.finditer("[^ \t\n\v\f\r]+", t or "")]
        for k in range(len(words) - L.PASSAGE + 1):
            window = tuple(t[a:b] for a, b in words[k : k + L.PASSAGE])
            if window in seen:
                a, b = words[k][0], words[k + L.PASSAGE][0] if k + L.PASSAGE < len(words) else words[-1][1]
                gone[a:b] = b"\1" * (b - a)
            seen.add(window)
        out.append(gone)
    return out


def plain_both(rows):
    """Texts without these."""
    return [(i, t if t is None else "".join(x for x, g in zip(t, gone, strict=True) if not g)) for (i, t), gone in zip(rows, gone_from_both(rows), strict=True)]


def plain_words(rnd, n):
    return ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(4, 9))) + rnd.choice(["", "", "", ",", "."]) for _ in range(n)]


def test_passages_just_over_fifty_words_go_whole(spark):
    rnd = random.Random(5)
    rows = []
    for n in range(200):  # each passage in two documents, at the start, within or at the end
        p = plain_words(rnd, rnd.randrange(51, 61))
        rows += [(2 * n + k, " ".join(plain_words(rnd, rnd.choice([0, 3, 40])) + p + plain_words(rnd, rnd.choice([0, 2, 70])))) for k in range(2)]
    p = plain_words(rnd, 400)
    rows += [(1000, " ".join(p)), (1001, " ".join(plain_words(rnd, 9) + p + p[:60]))]
    want = without_repeats(rows)
    out = L.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), passages=True)
    assert {r.doc_id: r.text.split() for r in out.collect()} == want
    assert sum(len(t.split()) for _, t in rows) - sum(map(len, want.values())) > 200 * 51


def test_repeated_short_lines_go(spark):
    rnd = random.Random(6)
    rows = []
    for n in range(60):  # a line of up to 6 words, again and again, in other surroundings
        run = plain_words(rnd, rnd.randrange(1, 7)) * 60
        rows += [(2 * n + k, " ".join(plain_words(rnd, 30)) + "\n" + " ".join(run) + "\n" + " ".join(plain_words(rnd, 30))) for k in range(2)]
    want = without_repeats(rows)
    out = {r.doc_id: r.text.split() for r in L.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), passages=True).collect()}
    assert all(out[i][:30] == want[i][:30] and out[i][-30:] == want[i][-30:] for i in out)
    assert all(out[i] == want[i] for i in out if i % 2)


def test_columns_of_any_name_stay(spark):
    names = ["id_", "key_", "gone", "_gone", "id", "key", "text_", "h", "a", "b", "s", "n", "content", "seeds", "again", "digest", "first", "f", "w"]
    rnd = random.Random(9)
    p = " ".join(plain_words(rnd, 60))
    docs = spark.createDataFrame([(i, p, *range(len(names))) for i in range(3)], ", ".join(["doc_id bigint", "text string", *(f"{n} int" for n in names)]))
    out = L.deduplicate_lines(docs, passages=True).collect()
    assert sorted(len(r.text) for r in out) == [0, 0, len(p)] and all([r[n] for n in names] == list(range(len(names))) for r in out)


def test_bit_map_of_any_length_gives_the_same(spark):
    rnd = random.Random(10)
    p = " ".join(plain_words(rnd, 70))
    docs = spark.createDataFrame([(i, " ".join(plain_words(rnd, 40)) + (" " + p if i % 3 else "")) for i in range(30)], "doc_id bigint, text string")
    found = [sorted(map(tuple, L.deduplicate_lines(docs, passages=True, bits=b).collect())) for b in (6, 12, None)]
    assert found[0] == found[1] == found[2] and sum(r[3] for r in found[0]) >= 19 * len(p)


def without_blocks(rows):
    """plain_both, and without the shortest runs from each line on, of two lines and MIN_WORDS words, that an earlier text, or the text itself before, has, and the lines
    after them that agree; rows in order of id."""
    first, out, base = {}, [], gone_from_both(rows)
    for n, (i, t) in enumerate(rows):
        lines, at = [], 0
        for c, _, _ in cut(t or ""):
            for m in re.finditer(r"[^\n]*\n?", c):
                for part in re.finditer(r".*?[.!?](?:\s+|$)|.+$", m[0], re.S):
                    lines.append((at + m.start() + part.start(), at + m.start() + part.end(), part[0].split()))
            at += len(c)
        assert "".join((t or "")[a:b] for a, b, _ in lines) == (t or "")
        gone = bytearray(len(t or ""))
        every = [x for _, _, own in lines for x in own]
        for k in range(len(lines)):
            j = next((j for j in range(k + 1, len(lines)) if sum(len(x[2]) for x in lines[k : j + 1]) >= L.MIN_WORDS), None)
            if j is None or sum(len(x[2]) for x in lines[k : j + 1]) > L.LINE_WORDS:
                continue
            window = tuple(x for own in lines[k : j + 1] for x in own[2])
            after = every[sum(len(x[2]) for x in lines[: j + 1]) :]
            if window in first:
                then = first[window]  # further whole lines that agree with the first occurrence
                while j + 1 < len(lines) and lines[j + 1][2] == then[: len(lines[j + 1][2])]:
                    j, then = j + 1, then[len(lines[j + 1][2]) :]
                gone[lines[k][0] : lines[j][1]] = b"\1" * (lines[j][1] - lines[k][0])
            first.setdefault(window, after)
        out.append((i, t if t is None else "".join(x for x, g, h in zip(t, gone, base[n], strict=True) if not g and not h)))
    return out


def block_line(rnd):
    return " ".join(plain_words(rnd, rnd.randrange(5, 16))).replace(".", "") + "\n"


@pytest.mark.parametrize("lines", [2, 3, 5, 8])
def test_every_repeated_block_of_lines_goes(spark, lines):
    """Without passages: blocks of two lines and more that two documents have, within others, at an end, or as a whole text."""
    rnd = random.Random(100 + lines)
    rows, blocks = [], []
    for n in range(120):
        block = "".join(block_line(rnd) for _ in range(lines))
        blocks.append(block)
        rows += [(2 * n + k, "".join(block_line(rnd) for _ in range(rnd.randrange(0, 6) if n % 4 else 0)) + block + "".join(block_line(rnd) for _ in range(rnd.randrange(0, 6) if n % 4 != 1 and n % 4 else 0))) for k in range(2)]
    out = {r.doc_id: r for r in L.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), lines=True).collect()}
    recall = sum(out[2 * n + 1].chars_removed for n in range(120)) / sum(map(len, blocks))
    print(f"{lines} lines, by chunks of lines alone: recall {recall:.3f}")
    assert recall > 0.99 and all(out[2 * n].text == rows[2 * n][1] for n in range(120))
    for n in range(120):
        before = rows[2 * n + 1][1]
        assert out[2 * n + 1].text.strip() == (before[: before.index(blocks[n])] + before[before.index(blocks[n]) + len(blocks[n]) :]).strip()


def test_blocks_and_passages_equal_a_plain_loop(spark):
    rnd = random.Random(12)
    pool = ["".join(block_line(rnd) for _ in range(rnd.randrange(2, 5))) for _ in range(25)]
    rows = []
    for i in range(70):
        parts = [rnd.choice(pool) if rnd.random() < 0.5 else block_line(rnd) for _ in range(rnd.randrange(0, 7))]
        rows.append((i, "".join(parts)))
    rows += [(70, pool[0] + pool[0]), (71, pool[3].rstrip("\n")), (72, rows[5][1]), (73, "")]
    out = {r.doc_id: r.text for r in L.deduplicate_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), passages=True, lines=True).collect()}
    want = dict(without_blocks(rows))
    assert {i: t.split() for i, t in out.items()} == {i: t.split() for i, t in want.items()}


def test_hashes_are_dealt_out_packed_and_met_again():
    rnd = np.random.default_rng(3)
    held = [rnd.integers(0, 1 << 63, 4000, np.uint64) << np.uint64(1) for _ in range(5)]
    held += [held[0][:700], held[1][:300], np.full(5000, 7, np.uint64)]
    rows = [L.dealt_hashes(held[:4]), L.dealt_hashes(held[4:]), L.dealt_hashes([])]
    assert all(len(r) <= 1 << L.HASH_BITS for r in rows) and sum(len(x.as_py()) for r in rows for x in r.column("h")) < 8 * sum(map(len, held[:-1])) + 100  # a hash goes twice at most
    every = pa.Table.from_batches(rows).sort_by("part").to_batches(max_chunksize=100)
    got = [h for b in L.met_again(iter(every)) for h in b.column("h").to_numpy().view(np.uint64).tolist()]
    value, n = np.unique(np.concatenate(held), return_counts=True)
    assert sorted(got) == value[n > 1].tolist()


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_first_seeds_equal_an_aggregate(spark, monkeypatch, kind):
    rnd = random.Random(14)
    rows = []
    for i in range(300):
        x = np.zeros(rnd.randrange(1, 30), L.SEED)
        x["h"], x["s"], x["w"] = [rnd.choice([-5, 9, rnd.randrange(-300, 300) << 54]) for _ in x], range(len(x)), [rnd.randrange(9) for _ in x]
        rows.append((None if i % 50 == 0 else i // 2 if kind == "bigint" else f"{chr(rnd.choice([97, 233, 65536]))}{i // 2}", rnd.randrange(-9, 9), bytearray(x.tobytes())))
    places = spark.createDataFrame(rows, f"id {kind}, key bigint, seeds binary").repartition(3)
    got = sorted(map(tuple, L.first_seeds(places, kind).collect()), key=str)
    monkeypatch.setattr(L, "ORDERED", ())
    assert got == sorted(map(tuple, L.first_seeds(places, kind).collect()), key=str) and len(got) > 100
