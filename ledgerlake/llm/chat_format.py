"""Chat formatting (operator 8): records of many layouts become canonical turns and one marked text.

The fingerprint of a JSON record is a hash of its sorted nested field paths (items of a list share one path). It selects a
declarative mapping, which says where a layout keeps its turns; a record whose fingerprint no mapping has, or that isn't JSON,
is reported with the error and no turns. Canonical turns are written by a template:

    <turn ROLE>TEXT</turn>\\n      in ROLE and TEXT: \\ as \\\\, < as \\<, > as \\>

so control strings stand only where the template puts them, and reading back restores every text. The loss mask is a list of
(start, end) code points of the assistant texts.

Defined results: a null text or role counts as empty; turns with equal numbers stand in the order of role and text; rows
without a conversation id form one conversation without id; repeated rows are turns of their own; an empty table leaves the
conversation that the query adds; other columns are ignored. A conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import map_arrow, pick, table


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: single fields with fixed roles, then a list of turns."""

    paths: tuple[str, ...]  #: all nested field paths, sorted
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  #: role, fields whose texts make the turn, joined by an empty line
    turns: str | None = None  #: the list's field
    role: str | None = None  #: in each item
    text: str | None = None  #: in each item
    roles: tuple[tuple[str, str], ...] = ()  #: other names of roles


def _layout(*paths: str, **kwargs) -> Layout:
    return Layout(tuple(sorted(paths)), **kwargs)


LAYOUTS = [
    _layout("messages", "messages[].role", "messages[].content", turns="messages", role="role", text="content"),
    _layout("conversations", "conversations[].from", "conversations[].value", turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    _layout("system", "conversations", "conversations[].from", "conversations[].value", fields=(("system", ("system",)),), turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    _layout("prompt", "completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    _layout("prompt", "response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    _layout("question", "answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    _layout("instruction", "output", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    _layout("instruction", "input", "output", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    _layout("system", "instruction", "output", fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    _layout("messages", fields=(), turns="messages", role="role", text="content"),  # an empty list has no paths below it
    _layout("conversations", fields=(), turns="conversations", role="from", text="value"),
]


def paths_of(value, at: str = "") -> set[str]:
    """All nested field paths of a JSON value."""
    if isinstance(value, dict):
        own = {f"{at}.{k}" if at else str(k) for k in value}
        return own.union(*(paths_of(v, f"{at}.{k}" if at else str(k)) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value))
    return set()


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def mappings(layouts: list[Layout] | None = None) -> dict[str, Layout]:
    return {fingerprint(x.paths): x for x in layouts or LAYOUTS}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record: str | None, known: dict[str, Layout]) -> tuple[str | None, list[tuple[str, str]] | None, str | None]:
    """(fingerprint, turns, error) of a record."""
    try:
        value = json.loads(record or "")
    except ValueError as e:
        return None, None, f"not JSON: {e}"
    found = fingerprint(paths_of(value))
    layout = known.get(found)
    if layout is None:
        return found, None, "no mapping has this fingerprint"
    turns = []
    for role, fields in layout.fields:
        texts = [_text(value[f]) for f in fields]
        turns.append((role, "\n\n".join([texts[0], *(t for t in texts[1:] if t)])))
    names = dict(layout.roles)
    for item in (value[layout.turns] or []) if layout.turns else []:
        role = _text(item.get(layout.role))
        turns.append((names.get(role, role), _text(item.get(layout.text))))
    return found, turns, None


_SPECIAL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The marked text, and the loss mask."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role)}>", escape(text)
        if role == learned:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a marked text."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "fingerprint string, formatted string, loss_starts array<long>, loss_ends array<long>, error string"


def format_records(records: DataFrame, key: str = "conv_id", record: str = "record", layouts: list[Layout] | None = None) -> DataFrame:
    """key, fingerprint, formatted, loss_starts, loss_ends, error for each JSON record."""
    kind = records.schema[key].dataType.simpleString()

    def make():
        known = mappings(layouts)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for x in batch.column(record).to_pylist():
                found, turns, error = canonical(x, known)
                text, mask = (None, []) if turns is None else render(turns)
                rows.append((found, text, [a for a, _ in mask], [b for _, b in mask], error))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            return pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [key, *(x.split()[0] for x in FORMATTED.split(", "))])

        return f

    return map_arrow(pick(records, key, record), f"`{key}` {kind}, {FORMATTED}", make)


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """key and digests of what the marked texts and their masks hold."""
    kind = formatted.schema[key].dataType.simpleString()

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends")), strict=True):
                turns = parse(text)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], [key, *(x.split()[0] for x in READ.split(", "))])

        return f

    return map_arrow(pick(formatted.where("formatted IS NOT NULL"), key, "formatted", "loss_starts", "loss_ends"), f"`{key}` {kind}, {READ}", make)


def records_of(rows: DataFrame) -> DataFrame:
    """conv_id, record: a JSON record for each conversation of a table of turns. Short ones take the layouts of single prompts and instructions."""
    turns = pick(rows, "conv_id", "turn", "role", "text").select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t")
    )
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t")).withColumn("roles", F.concat_ws(",", F.transform("t", lambda x: F.concat(F.length(x.role).cast("string"), F.lit(":"), x.role))))
    text = lambda k: F.try_element_at("t", F.lit(k)).getField("text")
    record = (
        F.when(F.col("roles") == "4:user,9:assistant", F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("completion"))))
        .when(F.col("roles") == "6:system,4:user,9:assistant", F.to_json(F.struct(text(1).alias("system"), text(2).alias("instruction"), text(3).alias("output"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"))).alias("messages"))))
    )
    return turns.select("conv_id", record.alias("record"))


#: The conversation that the query adds to the table: fixed values.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(ADDED_ID, 0, "user", ADDED_TEXT), (ADDED_ID, 1, "assistant", ADDED_TEXT)], rows.schema)
    return read_back(format_records(records_of(rows.unionByName(added))))
