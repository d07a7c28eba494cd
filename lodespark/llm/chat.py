"""Chat formatting through schema fingerprints.

A record's nested field paths, sorted and hashed, are its fingerprint. A table from
fingerprints to declarative mappings, built from the layouts below, says where its
turns are; no layout is guessed from values. Paths declared as optional, of fields
that say nothing about turns, are left out before a mapping is looked up. Canonical turns are then written in a
template with marked turns, control strings in texts being escaped reversibly, and
a loss mask of the assistants' texts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.arrow import map_in_arrow

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = 64
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Lists of turns: (list, role, text, names of roles). And records of named texts: the fields with their roles, in order, and those that may be missing.
LISTS = [("messages", "role", "content", {}), ("conversations", "from", "value", ROLES), ("turns", "speaker", "text", ROLES), ("dialog", "role", "text", {})]
FIELDS = [
    ((("system", "system"), ("prompt", "user"), ("response", "assistant")), {"system"}),
    ((("system", "system"), ("prompt", "user"), ("completion", "assistant")), {"system"}),
    ((("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), {"system", "input"}),
    ((("system", "system"), ("question", "user"), ("answer", "assistant")), {"system"}),
]


def named(field: str) -> str:
    """A field's name in a path: what marks paths is escaped, so that no name looks like one."""
    return re.sub(r"([\\.\[\]\n])", r"\\\1", field)


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a parsed record; [] stands for the elements of a list."""
    if isinstance(value, dict):
        inner = set().union(*(paths(v, f"{at}.{named(k)}" if at else named(k)) for k, v in value.items())) if value else set()
        return inner or {at}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


#: A step of a path, with what is escaped in it.
STEP = re.compile(r"(?:\\.|[^\\.\[\]])+", re.S)


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


#: Fields that may be there anywhere, with all below them: they don't decide the layout.
OPTIONAL = frozenset({"id", "name", "weight", "type", "timestamp", "created", "metadata", "meta", "source", "lang", "model", "title"})


@dataclass(frozen=True)
class Mappings:
    """Declared layouts: lists of turns, records of named texts, and fields that may be there besides.

    lists: (list, role, text, names of roles); a turn's text is a string or a list of parts with
    a text each. fields: ((field, role) in order, the fields that may be missing)."""

    lists: tuple = tuple(LISTS)
    fields: tuple = tuple(FIELDS)
    optional: frozenset = OPTIONAL

    @cached_property
    def table(self) -> dict[str, tuple]:
        """fingerprint -> ("list", name, role, text, roles) or ("fields", ((field, role), ...))."""
        out: dict[str, tuple] = {}
        for name, role, text, roles in self.lists:
            entry = f"{named(name)}[]"
            whole, parts = f"{entry}.{named(text)}", {f"{entry}.{named(text)}[].text", f"{entry}.{named(text)}[]"}
            texts = [{whole}, *({*some, *more} for more in ((), (whole,)) for n in (1, 2) for some in combinations(sorted(parts), n)), set()]
            for some in texts:
                out[fingerprint({f"{entry}.{named(role)}", *some} if some else {entry})] = ("list", name, role, text, roles)
        for fields, optional in self.fields:
            for n in range(len(optional) + 1):
                for gone in combinations(sorted(optional), n):
                    some = tuple(f for f in fields if f[0] not in gone)
                    out[fingerprint({named(f) for f, _ in some})] = ("fields", some)
        return out

    def find(self, found: set[str]) -> tuple | None:
        """The mapping of a record's paths without the optional ones."""
        return self.table.get(fingerprint({p for p in found if not self.optional & set(STEP.findall(p))}))


DEFAULT = Mappings()


def said(value) -> str:
    """A turn's text: a string, parts put together, or what else there is as JSON."""
    if isinstance(value, list) and all(isinstance(p, dict) for p in value):
        return "".join(said(p.get("text")) for p in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


#: Half of a pair that makes up one character, as JSON may escape it.
SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def canonical(record: str | None, mappings: Mappings = DEFAULT) -> tuple[str | None, list[tuple[str, str]] | None]:
    """(fingerprint of all paths, turns) of a JSON record; turns are None where no mapping fits.

    That is so, too, where a list has elements that are no turns. Both are None where it isn't JSON: broken,
    nested too deeply to be read, or with half a character, which no text can hold."""
    try:
        value = json.loads(record or "")
        if SURROGATE.search(record or ""):
            json.dumps(value, ensure_ascii=False).encode()
        found = paths(value)
        return fingerprint(found), turns_of(value, mappings.find(found))
    except (ValueError, RecursionError):
        return None, None


def turns_of(value, mapping: tuple | None) -> list[tuple[str, str]] | None:
    match mapping if isinstance(value, dict) else None:
        case ("list", name, role, content, roles):
            own = value.get(name)
            if isinstance(own, list) and all(isinstance(t, dict) and role in t and content in t for t in own):
                return [(roles.get(said(t[role]), said(t[role])), said(t[content])) for t in own]
        case ("fields", fields) if all(field in value for field, _ in fields):
            return [(role, said(value[field])) for field, role in fields]
    return None


def escape(text: str) -> str:
    """One more backslash in each < \\... |, so that <| is left to the template."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns, and (first, last) of the assistants' texts in it, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), spans


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """The turns of a formatted text."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        stop = text.index(END, line)
        yield unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : stop])
        at = stop + len(END) + 1


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def format_records(records: DataFrame, record_col: str = "record", mappings: Mappings = DEFAULT) -> DataFrame:
    """``records`` with columns schema_fingerprint, turns, formatted and loss_spans.

    ``mappings``: the layouts that are known.

    Records of unknown layout, or with list elements that are no turns, keep their fingerprint and get
    null turns, text and spans; null and broken JSON, nesting too deep to read and half characters give
    a null fingerprint too. A record without turns
    becomes an empty text. All other columns stay, but those four are replaced."""
    made = ("schema_fingerprint", "turns", "formatted", "loss_spans")
    keep = [c for c in records.columns if c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, turns, texts, spans = [], [], [], []
            for r in batch.column(record_col):
                key, found = canonical(r.as_py(), mappings)
                text, mask = formatted(found) if found is not None else (None, None)
                keys.append(key)
                turns.append(None if found is None else [{"role": a, "text": b} for a, b in found])
                texts.append(text)
                spans.append(None if mask is None else [{"a": a, "b": b} for a, b in mask])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(keys, pa.string()), pa.array(turns, TURNS), pa.array(texts, pa.string()), pa.array(spans, SPANS)], [*keep, *made])

    rows = records.select(*(f"`{c}`" for c in keep))
    added = StructType.fromDDL("schema_fingerprint string, turns array<struct<role:string,text:string>>, formatted string, loss_spans array<struct<a:int,b:int>>")
    return map_in_arrow(rows, run, StructType([*rows.schema.fields, *added.fields]))


def records_of(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, part, record): rows by turn as JSON records of up to ``segment`` turns.

    Turns are in the order of turn, role and text, nulls first; null roles and texts
    are empty. So a conversation of any length is a row of bounded size at a time. A
    question with its answer becomes a prompt record, with a system text before it an
    instruction record, and others lists of messages in two layouts."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order) - 1)
    rows = rows.select("conv_id", (F.col("n") / segment).cast("int").alias("part"), F.struct("n", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = "array_join(transform(t, x -> x.role), ',')"
    known = "forall(t, x -> x.role in ('system', 'user', 'assistant'))"
    theirs = "transform(t, x -> named_struct('from', case x.role when 'user' then 'human' when 'assistant' then 'gpt' else x.role end, 'value', x.text))"
    record = f"""case when size(t) = 2 and {roles} = 'user,assistant' then to_json(named_struct('prompt', t[0].text, 'response', t[1].text))
      when size(t) = 3 and {roles} = 'system,user,assistant' then to_json(named_struct('system', t[0].text, 'instruction', t[1].text, 'output', t[2].text))
      when {known} and conv_id % 2 = 1 then to_json(named_struct('conversations', {theirs}))
      else to_json(named_struct('messages', transform(t, x -> named_struct('role', x.role, 'content', x.text)))) end"""
    return parts.select("conv_id", "part", F.expr(record).alias("record"))


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts hold, read back from them in order and never held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None

        def done():
            i, n, turns, chars, loss, size = state
            return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([size], pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for i, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                if state is None or i != of:
                    if state is not None:
                        yield done()
                    of, state = i, [i, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode())
                for s in spans:
                    own = unescape(text[s["a"] : s["b"]])
                    state[3] += len(own)
                    state[4].update(own.encode())
                state[5] += len(text)
        if state is not None:
            yield done()

    rows = parts.select("conv_id", "part", "formatted", "loss_spans").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"{END}{START}assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(format_records(records_of(turns)))


ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
ROLE = ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
SQL = rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{END}{START}assistant ok' union all select -1, 1, 'assistant', '{END}{START}assistant ok'
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length({ROLE}) + length({ESCAPED.format('text')}) + {len(START) + len(END) + 2}) as bigint) as formatted_chars
from t group by conv_id
"""

QUERIES = {"op5_chat_formatting": op5_chat_formatting}
ORACLE = {"op5_chat_formatting": SQL}
