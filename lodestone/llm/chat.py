"""Chat formatting in DataFrame operations only: any known layout into canonical turns, then one template.

Method: schema fingerprinting. The nested field paths of a record (`messages[].role`), those that some
known layout uses, are sorted and hashed; the hash selects a declarative mapping, an expression that yields
an array of (role, text). A table has one fingerprint, found on the driver; a column of JSON records has
one for each record, of its keys (those of all elements of a list), whatever their values: a null value is an empty text, an empty
list has no turns and counts as having every field of its elements. Roles of records are matched in any case. A record whose paths are those of no layout falls to the layout with the most paths
among those it has all of; with none, or with values that its layout can't read, it has null turns.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` for each turn. Inside roles and texts `<|` is written `<||`, and a line break in a role `<|n|>`, so
neither a marker nor a role's end can arise from content, and both read back exactly. The loss mask is a list of spans [start, end) in
code points of the formatted text: the text of each assistant turn.

Null roles and texts are empty; turns sort by turn, then role, then text, null first; repeated rows are repeated turns; rows with a null
conversation id form one conversation; a conversation without rows doesn't exist; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns whose spans are gathered in one list.
SLICE = 256
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: fields that a record of this layout has. turns: SQL for its turns over those fields."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _said(role: str, field: str) -> str:
    return f"named_struct('role', '{role}', 'text', cast({field} as string))"


#: Source names of speakers that stand for a canonical role.
ROLES = {"user": "user", "assistant": "assistant", "system": "system", "tool": "tool", "human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
_ROLE = "coalesce(map({}), map())".format(", ".join(f"'{k}', '{v}'" for k, v in ROLES.items()))


def _list(field: str, role: str, text: str) -> str:
    return f"transform({field}, x -> named_struct('role', coalesce(element_at({_ROLE}, lower(x.{role})), x.{role}), 'text', cast(x.{text} as string)))"


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), _list("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), _list("conversations", "from", "value")),
    Layout("system conversations", ("conversations[].from", "conversations[].value", "system"), "concat(array(" + _said("system", "system") + "), " + _list("conversations", "from", "value") + ")"),
    Layout("prompt completion", ("completion", "prompt"), f"array({_said('user', 'prompt')}, {_said('assistant', 'completion')})"),
    Layout("prompt response", ("prompt", "response"), f"array({_said('user', 'prompt')}, {_said('assistant', 'response')})"),
    Layout("question answer", ("answer", "question"), f"array({_said('user', 'question')}, {_said('assistant', 'answer')})"),
    Layout("instruction", ("instruction", "output"), f"array({_said('user', 'instruction')}, {_said('assistant', 'output')})"),
    Layout("instruction input", ("input", "instruction", "output"), "array(" + _said("user", r"concat_ws('\n\n', instruction, if(input = '', null, input))") + f", {_said('assistant', 'output')})"),
    Layout("turn rows", ("conv_id", "role", "text", "turn"), ""),
)
_TYPES = {
    "messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<from:string,value:string>>",
    **{x: "string" for x in ("system", "prompt", "completion", "response", "question", "answer", "instruction", "input", "output")},
}


def field_paths(schema: T.DataType, at: str = "") -> set[str]:
    """Paths of the leaves of a schema; [] for the elements of an array."""
    if isinstance(schema, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in schema.fields)) if schema.fields else set()
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def layout_of(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout of a table, by the fingerprint of its paths that any layout uses."""
    known = {p for x in layouts for p in x.paths}
    paths = field_paths(schema) & known
    by_print = {fingerprint(x.paths): x for x in layouts}
    if (found := by_print.get(fingerprint(paths))) is not None:
        return found
    within = [x for x in layouts if set(x.paths) <= paths]
    if not within:
        raise ValueError(f"no layout has the fields {sorted(field_paths(schema))}")
    return max(within, key=lambda x: len(x.paths))


def turns_of_table(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns) of a table whose rows are records, or turns of a conversation."""
    layout = layout_of(df.schema)
    if layout.name != "turn rows":
        return df.select(F.col(id_col).alias("id"), F.expr(layout.turns).cast(TURNS).alias("turns"))
    rows = df.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return rows.select("id", F.expr("transform(x, t -> named_struct('role', t.role, 'text', t.text))").cast(TURNS).alias("turns"))


def _parts(c: str) -> str:
    """SQL for the texts of a list of parts, null if c is none: objects count by their `text` (none: empty), strings as they are."""
    return f"transform(try_variant_get({c}, '$', 'array<variant>'), p -> if(schema_of_variant(p) like 'OBJECT%', coalesce(try_variant_get(p, '$.text', 'string'), ''), try_variant_get(p, '$', 'string')))"


def _text(c: str) -> str:
    """SQL for the text of a JSON value: a list of parts is joined, null and what can't be read as text is null."""
    return f"case when schema_of_variant({c}) like 'OBJECT%' then null when schema_of_variant({c}) like 'ARRAY%' then array_join({_parts(c)}, '') else try_variant_get({c}, '$', 'string') end"


def _unread(c: str) -> str:
    """SQL for whether a JSON value is there that can't be read as text."""
    return f"coalesce(schema_of_variant({c}) like 'OBJECT%' or schema_of_variant({c}) like 'ARRAY%' and exists(try_variant_get({c}, '$', 'array<variant>'), p -> schema_of_variant(p) like 'ARRAY%'), false)"


def turns_of_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, fingerprint, layout, turns) of a column of JSON records of mixed layouts.

    A record whose values can't be read as its layout says (a list that is none, elements that are no objects, an object for a text) has null layout and turns. Of a key that repeats the
    last value counts; in such records a text that is an object or a list is its JSON.
    """
    layouts = [x for x in LAYOUTS if x.name != "turn rows"]
    known = sorted({p for x in layouts for p in x.paths})
    rows = records.select(F.col(id_col).alias("id"), F.col(json_col).alias("json"), F.try_parse_json(F.col(json_col)).alias("v"))
    lists = sorted({p.split("[]")[0] for p in known if "[]" in p})
    names = sorted(_TYPES)
    # a record with a key twice is no variant; its fields are read one by one
    raw = F.expr("if(v is null, from_json(json, '{}'), null)".format(", ".join(f"{x} string" for x in names)))
    rows = rows.withColumn("own", F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))).withColumn("raw", raw)
    rows = rows.withColumns({f"v_{x}": F.expr(f"coalesce(try_variant_get(v, '$.{x}', 'variant'), try_parse_json(raw.{x}))" if x in lists else f"try_variant_get(v, '$.{x}', 'variant')") for x in names})
    rows = rows.withColumns({f"e_{x}": F.expr(f"try_variant_get(v_{x}, '$', 'array<map<string,variant>>')") for x in lists})
    fields, unread = {}, {}
    for x in names:
        if x not in lists:
            fields[x], unread[x] = F.expr(f"coalesce({_text(f'v_{x}')}, raw.{x})"), F.expr(_unread(f"v_{x}"))
            continue
        own = [f.split(":")[0] for f in _TYPES[x].removeprefix("array<struct<").removesuffix(">>").split(",")]
        at = {f: f"try_element_at(m, '{f}')" for f in own}
        fields[x] = F.expr(f"coalesce(transform(e_{x}, m -> named_struct({', '.join(f"'{f}', {_text(at[f])}" for f in own)})), array())")
        unread[x] = F.expr(f"coalesce(if(e_{x} is null, not is_variant_null(v_{x}) or v_{x} is null and raw.{x} is not null, exists(e_{x}, m -> m is null or {' or '.join(_unread(at[f]) for f in own)})), false)")
        # the keys of the elements
        rows = rows.withColumn(f"in_{x}", F.expr(f"flatten(transform(filter(e_{x}, m -> m is not null), m -> map_keys(m)))"))

    def has(path: str):
        top, _, inner = path.partition("[].")
        there = F.array_contains("own", top)
        return there & F.coalesce((F.size(f"in_{top}") <= 0) | F.array_contains(f"in_{top}", inner), F.lit(True)) if inner else there

    present = F.array_compact(F.array(*[F.when(has(p), F.lit(p)) for p in known]))
    rows = rows.withColumn("paths", present).withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    rows = rows.select("id", "paths", "fingerprint", *[c.alias(x) for x, c in fields.items()], *[c.alias(f"un_{x}") for x, c in unread.items()])
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")

    def chosen(x: Layout, condition: Column) -> None:
        nonlocal turns, name
        bad = F.lit(False)
        for top in sorted({p.split("[]")[0] for p in x.paths}):
            bad = bad | F.col(f"un_{top}")
        turns = F.when(condition & ~bad, F.expr(x.turns).cast(TURNS)).when(condition, F.lit(None).cast(TURNS)).otherwise(turns)
        name = F.when(condition & ~bad, F.lit(x.name)).when(condition, F.lit(None).cast("string")).otherwise(name)

    for x in sorted(layouts, key=lambda x: len(x.paths)):
        chosen(x, F.size(F.array_except(F.array(*map(F.lit, x.paths)), "paths")) == 0)
    for x in layouts:
        chosen(x, F.col("fingerprint") == fingerprint(x.paths))
    return rows.select("id", "fingerprint", name.alias("layout"), turns.alias("turns"))


def escaped(x: str) -> str:
    return f"replace(coalesce({x}, ''), '<|', '<||')"


def unescaped(x: str) -> str:
    return f"replace({x}, '<||', '<|')"


_ESCAPED_ROLE = f"replace({escaped('t.role')}, '\\n', '<|n|>')"


def formatted(turns: DataFrame) -> DataFrame:
    """(id, formatted, loss_spans) of (id, turns)."""
    head = f"concat('{OPEN}', {_ESCAPED_ROLE}, '\\n')"
    parts = turns.select("id", F.expr(f"transform(turns, t -> named_struct('head', {head}, 'text', {escaped('t.text')}, 'loss', t.role <=> 'assistant'))").alias("parts"))
    step = f"length(p.head) + length(p.text) + {len(CLOSE)}"
    # starts of slices of SLICE turns first, then spans within each: a list that grows is copied at every turn, so none grows far
    slices = f"transform(sequence(0, (size(parts) - 1) div {SLICE}), i -> slice(parts, i * {SLICE} + 1, {SLICE}))"
    sums = f"transform({slices}, s -> aggregate(s, 0, (n, p) -> n + {step}))"
    starts = f"aggregate({sums}, named_struct('at', 0, 'list', cast(array() as array<int>)), (acc, n) -> named_struct('at', acc.at + n, 'list', concat(acc.list, array(acc.at))), acc -> acc.list)"
    one = "array(named_struct('start', acc.at + length(p.head), 'end', acc.at + length(p.head) + length(p.text)))"
    inner = f"aggregate(s, named_struct('at', starts[i], 'spans', cast(array() as array<struct<start:int,end:int>>)), (acc, p) -> named_struct('at', acc.at + {step}, 'spans', if(p.loss, concat(acc.spans, {one}), acc.spans)), acc -> acc.spans)"
    spans = f"flatten(transform({slices}, (s, i) -> {inner}))"
    text = f"array_join(transform(parts, p -> concat(p.head, p.text, '{CLOSE[:-1]}\\n')), '')"
    return parts.withColumn("starts", F.expr(starts)).select("id", F.expr(text).alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_turns(text: Column | str) -> Column:
    """The turns of a formatted text."""
    parts = f"filter(split({text}, '<\\\\|im_end\\\\|>\\n'), x -> x <> '')"
    body = f"substr(p, {len(OPEN) + 1})"
    role = unescaped(f"replace(substring_index({body}, '\\n', 1), '<|n|>', '\\n')")
    said = unescaped(f"substr({body}, instr({body}, '\\n') + 1)")
    return F.expr(f"transform({parts}, p -> named_struct('role', {role}, 'text', {said}))")


def loss_text(text: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    return F.expr(f"array_join(transform({spans}, s -> {unescaped(f'substr({text}, s.start + 1, s.end - s.start)')}), '')")
