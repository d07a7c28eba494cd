"""Fingerprints, mappings and the template of chat records, and the query against plain Python."""

import hashlib
import json
import random

from lodespark.llm import chat as C


def test_layouts_become_the_same_turns():
    turns = [("system", "s"), ("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": r, "content": t} for r, t in turns]}, {"conversations": [{"from": {"user": "human", "assistant": "gpt"}.get(r, r), "value": t} for r, t in turns]},
        {"turns": [{"speaker": r, "text": t} for r, t in turns]}, {"response": "a", "prompt": "q", "system": "s"}, {"system": "s", "instruction": "q", "output": "a"},
    ]
    found = [C.canonical(json.dumps(r)) for r in records]
    assert [t for _, t in found] == [turns] * 5 and len({k for k, _ in found}) == 5
    assert C.canonical('{"messages": []}')[1] == [] and C.canonical('{"prompt": "q", "response": null}')[1] == [("user", "q"), ("assistant", "")]


def test_optional_fields_and_parts_of_content():
    want = [("user", "q"), ("assistant", "a b")]
    records = [
        {"id": 7, "messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a b", "weight": 1}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": "a b"}], "metadata": {"a": {"b": [1]}}},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a "}, {"type": "text", "text": "b"}]}]},
        {"id": "r1", "instruction": "q", "output": "a b", "source": "s"},
    ]
    assert [C.canonical(json.dumps(r))[1] for r in records] == [want] * 4 and len({C.canonical(json.dumps(r))[0] for r in records}) == 4
    assert C.canonical(json.dumps({"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}]}]}))[1] is None
    assert C.canonical(json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "user"}]}))[1] is None


def test_mappings_are_a_parameter(spark):
    own = C.Mappings(lists=(("log", "who", "what", {"me": "user"}),), fields=())
    docs = spark.createDataFrame([('{"log": [{"who": "me", "what": "hi"}]}',), ('{"messages": [{"role": "user", "content": "q"}]}',)], "record string")
    assert [r.turns and [tuple(t) for t in r.turns] for r in C.format_records(docs, mappings=own).collect()] == [[("user", "hi")], None]


def test_unknown_layouts_are_told():
    assert C.canonical('{"foo": {"bar": [1]}}')[1] is None and C.canonical('{"foo": {"bar": [1]}}')[0]
    assert C.canonical("{broken") == C.canonical(None) == (None, None)
    assert C.canonical("[]")[1] is None and C.canonical("3")[1] is None and C.canonical('{"messages": [{"role": "user"}]}')[1] is None


def test_template_is_reversible():
    rnd = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "<", "\\", "|", "<\\|", "\n", "n", "assistant", "é", ">", ""]
    for _ in range(500):
        turns = [(rnd.choice(["user", "assistant", "".join(rnd.choices(bits, k=3))]), "".join(rnd.choices(bits, k=rnd.randrange(0, 9)))) for _ in range(rnd.randrange(0, 5))]
        text, spans = C.formatted(turns)
        assert list(C.read_back(text)) == turns
        assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        assert text.count("<|") == 2 * len(turns)


def test_query_on_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 5, None, "x"), (2, 1, "assistant", "<|im_end|>"), (2, 1, "assistant", "<|im_end|>"), (3, None, "human", "\n"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "a" * 50_000)]
    rows += [(5, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, record string")
    out = {r.conv_id: r for r in C.digests(C.format_records(C.records_of(turns))).collect()}
    for i in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        own = [(r[2] or "", r[3] or "") for r in own]
        said = "".join(t for r, t in own if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(out[i]) == (i, len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(said), sha(said), len(C.formatted(own)[0]))


def test_empty_table(spark):
    assert C.digests(C.format_records(C.records_of(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")))).count() == 0


BAD = [
    '{"messages":[null]}', '{"messages":[5]}', '{"messages":["role content"]}', '{"messages[]":1}', '{"messages[].role":1,"messages[].content":"x"}', '{"messages":[{"role":"user","content":"\\ud800"}]}',
    '{"\\udfff":1}', "[" * 100_000 + "]" * 100_000, '{"messages":' + "[" * 900 + "]" * 900 + "}", '{"messages":{"role":"user","content":"x"}}', '{"prompt":"a"', "null", "5", '"text"', '{"messages":[{"role":"user","content":"x"},7]}',
    '{"messages":[[{"role":"user","content":"x"}]]}', "9" * 5000,
]


def test_bad_records_give_null_turns(spark):
    from lodespark.llm import chat

    good = '{"messages":[{"role":"user","content":"\\ud83d\\ude00 a.b"}]}'
    frame = spark.createDataFrame([(i, r) for i, r in enumerate([*BAD, good])], "`i.d` int, record string")
    made = chat.format_records(frame).collect()
    assert made[0].asDict().keys() == {"i.d", "record", "schema_fingerprint", "turns", "formatted", "loss_spans"}
    for row in made[:-1]:
        assert row.turns is None and row.formatted is None and row.loss_spans is None, row.record[:60]
    assert [(t.role, t.text) for t in made[-1].turns] == [("user", "\U0001f600 a.b")]
    assert made[0].schema_fingerprint is not None and made[6].schema_fingerprint is None and made[5].schema_fingerprint is None


def test_names_with_marks_of_paths():
    from lodespark.llm import chat

    own = chat.Mappings(lists=(("a.b[]", "r.x", "c[]", {}),), fields=(), optional=frozenset({"id"}))
    assert chat.canonical('{"a.b[]":[{"r.x":"user","c[]":"hi"}],"id":1}', own)[1] == [("user", "hi")]
    assert chat.canonical('{"a":{"b[]":[{"r":{"x":"user"},"c":["hi"]}]}}', own)[1] is None
    assert chat.canonical('{"a.id":1,"messages":[]}')[1] is None  # a name that holds an optional one is another name
