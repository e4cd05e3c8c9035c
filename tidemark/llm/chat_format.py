r"""Chat formatting: conversations to one text with a loss mask, and back.

A template declares a finite-state machine over roles. Each step reads a role in
a state, names the next state, and emits three segments: the mark before the
turn, its text, the mark after it; a flag says whether the text counts for the
loss. A role that has no step in a state breaks the turn order: the machine
goes to a state that it never leaves, and those turns are written with their
role spelled out, so a conversation in any order can still be read back.

A conversation is cut into blocks of ``BLOCK_TURNS`` turns. A block is a function
from the state it is entered in to the state it is left in, so all blocks are run
from every state at once; composing these short functions gives each block its
entry state, and blocks are formatted apart. One long conversation is therefore
spread over tasks until its digest is taken.

Texts are escaped: a backslash is doubled, and one is put after the first
character of every control string, which then stands nowhere inside a text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import literal_rows

#: Turn values and rows of one block.
BLOCK_TURNS = 64
#: Block of turns without a number: before all others.
_NO_TURN = -(1 << 62)
_SEGMENT = "array<struct<text: string, loss: boolean>>"


@dataclass(frozen=True)
class Step:
    """In ``state``, a turn of ``role`` leads to ``to``."""

    state: str
    role: str
    to: str
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """The first state of ``steps`` is the start. ``after`` tells the role of a
    turn when a text is read back, so one mark belongs to one role."""

    steps: tuple[Step, ...]
    accepting: frozenset[str]
    controls: tuple[str, ...]
    odd_before: str
    odd_after: tuple[str, str]
    loss_roles: frozenset[str]

    def __post_init__(self):
        roles: dict[str, str] = {}
        for s in self.steps:
            if roles.setdefault(s.after, s.role) != s.role:
                raise ValueError(f"{s.after!r} closes turns of two roles")
        marks = [self.odd_before, self.odd_after[0], *roles, *(s.before for s in self.steps if s.before)]
        if bare := [m for m in marks if not any(c in m for c in self.controls)]:
            raise ValueError(f"no control string in {bare}")
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more, and no backslash")

    @property
    def states(self) -> list[str]:
        return list(dict.fromkeys(x for s in self.steps for x in (s.state, s.to)))

    @property
    def roles_of_marks(self) -> dict[str, str]:
        return {s.after: s.role for s in self.steps}


#: System text inside the first user turn, a begin mark before every request,
#: an end mark after every answer; answers are learned.
INSTRUCT = ChatTemplate(
    steps=(
        Step("start", "system", "briefed", "<s>[INST] <<SYS>>\n", "\n<</SYS>>\n\n"),
        Step("start", "user", "asked", "<s>[INST] ", " [/INST] "),
        Step("briefed", "user", "asked", "", " [/INST] "),
        Step("asked", "assistant", "answered", "", " </s>", loss=True),
        Step("answered", "user", "asked", "<s>[INST] ", " [/INST] "),
    ),
    accepting=frozenset({"answered"}),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN]", "[/TURN "),
    odd_before="[TURN] ",
    odd_after=("[/TURN ", "]"),
    loss_roles=frozenset({"assistant"}),
)


def _any_of(strings) -> str:
    """A pattern of these strings, longer ones first."""
    return "|".join(re.escape(x) for x in sorted(set(strings), key=lambda x: (-len(x), x)))


def escape(text: Column, template: ChatTemplate) -> Column:
    heads: dict[str, list[str]] = {}
    for c in template.controls:
        heads.setdefault(c[0], []).append(c[1:])
    found = "|".join([r"\\", *(f"{re.escape(a)}(?={_any_of(rest)})" for a, rest in heads.items())])
    return F.regexp_replace(text, f"({found})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _lookup(pairs: dict, key: Column) -> Column:
    """The value of a key in a constant table, else null."""
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])[key]


def _next(template: ChatTemplate, state: Column, role: Column) -> Column:
    at = {s: i for i, s in enumerate(template.states)}
    steps = {f"{at[s.state]} {s.role}": F.lit(at[s.to]) for s in template.steps}
    return F.coalesce(_lookup(steps, F.concat_ws(" ", state, role)), F.lit(len(at)))


def _blocks(turns: DataFrame, *columns: str) -> DataFrame:
    """(conv_id, block, part, turns): at most BLOCK_TURNS rows in each row, in
    the order of turn, role, text."""
    order = [F.asc_nulls_first(c) for c in columns]
    place = W.partitionBy("conv_id", "block").orderBy(*order)
    numbered = turns.select("conv_id", "block", *columns).withColumn("part", F.floor((F.row_number().over(place) - 1) / BLOCK_TURNS))
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    return numbered.groupBy("conv_id", "block", "part").agg(rows.alias("turns"))


def _entries(turns: DataFrame, template: ChatTemplate) -> DataFrame:
    """(conv_id, block, part, entry): the state in which each block is entered."""
    states = range(len(template.states) + 1)
    left = [F.aggregate("roles", F.lit(s), lambda at, role: _next(template, at, role)) for s in states]
    runs = _blocks(turns, "turn", "role").withColumn("roles", F.col("turns.role"))
    runs = runs.select("conv_id", F.struct("block", "part", F.array(*left).alias("left")).alias("run"))
    kind = "struct<at: int, done: array<struct<block: bigint, part: bigint, entry: int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("done")).cast(kind)

    def follow(so_far: Column, run: Column) -> Column:
        here = F.struct(run["block"].alias("block"), run["part"].alias("part"), so_far["at"].alias("entry"))
        return F.struct(F.get(run["left"], so_far["at"]).alias("at"), F.concat(so_far["done"], F.array(here)).alias("done")).cast(kind)

    chained = runs.groupBy("conv_id").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    return chained.select("conv_id", F.inline(F.aggregate("runs", start, follow)["done"]))


def format_conversations(turns: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """(conv_id, block, part, segments, n_valid, state): conversations as texts
    with loss flags, a row for each block; ``turns`` has conv_id, turn, role, text.

    ``segments`` are (text, loss) in order; joined over the blocks of a
    conversation they are its formatted text. ``n_valid`` counts the block's
    turns that the machine accepts, ``state`` is that in which it is left (null:
    broken). Turns are ordered by turn, then role, then text; null turns come
    first; repeated rows are turns of their own. A null text or role is empty. A
    null conv_id is a conversation like any other. Other columns are ignored.
    No turns, no rows.
    """
    turns = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(_NO_TURN)))
    blocks, entries = _blocks(turns, "turn", "role", "text"), _entries(turns, template)
    same = F.lit(True)
    for c in ("conv_id", "block", "part"):
        same &= blocks[c].eqNullSafe(entries[c])
    met = blocks.join(entries, same).select(blocks["conv_id"], blocks["block"], blocks["part"], "turns", "entry")

    def step(seen: Column, turn: Column) -> Column:
        return F.concat(seen, F.array(_next(template, F.element_at(seen, -1), turn["role"])))

    met = met.withColumn("states", F.aggregate("turns", F.array("entry"), step))
    number = {s: i for i, s in enumerate(template.states)}
    known = {
        f"{number[s.state]} {s.role}": F.struct(F.lit(s.before).alias("before"), F.lit(s.after).alias("after"), F.lit(s.loss).alias("loss"))
        for s in template.steps
    }

    def segments(turn: Column, i: Column) -> Column:
        open_, close = template.odd_after
        odd = F.struct(
            F.lit(template.odd_before).alias("before"),
            F.concat(F.lit(open_), F.url_encode(turn["role"]), F.lit(close)).alias("after"),
            turn["role"].isin(*template.loss_roles).alias("loss"),
        )
        mark = F.coalesce(_lookup(known, F.concat_ws(" ", F.get("states", i), turn["role"])), odd)
        parts = [(mark["before"], F.lit(False)), (escape(turn["text"], template), mark["loss"]), (mark["after"], F.lit(False))]
        return F.array(*[F.struct(a.alias("text"), b.alias("loss")) for a, b in parts])

    broken = F.lit(len(number))
    names = F.array(*map(F.lit, template.states))
    return met.select(
        "conv_id",
        "block",
        "part",
        F.filter(F.flatten(F.transform("turns", segments)), lambda s: s["text"] != "").cast(_SEGMENT).alias("segments"),
        (F.size(F.filter("states", lambda s: s != broken)) - F.when(F.col("entry") != broken, 1).otherwise(0)).cast("long").alias("n_valid"),
        F.get(names, F.element_at("states", -1)).alias("state"),
    )


def read_turns(formatted: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """(conv_id, block, part, turns, learned): what formatted blocks say.

    ``turns`` are (role, text) in order, from the marks alone; ``learned`` is the
    unescaped text of the segments under the loss mask."""
    open_, close = template.odd_after
    opened = _any_of([template.odd_before, *(s.before for s in template.steps if s.before)])
    closed = f"{_any_of(template.roles_of_marks)}|{re.escape(open_)}[^{re.escape(close)}]*{re.escape(close)}"
    found = F.lit(f"(?s)(?:{opened})?(.*?)({closed})")
    whole = formatted.withColumn("whole", F.array_join("segments.text", ""))
    pairs = F.arrays_zip(F.regexp_extract_all("whole", found, F.lit(1)).alias("text"), F.regexp_extract_all("whole", found, F.lit(2)).alias("mark"))

    def turn(pair: Column) -> Column:
        spelled = F.substring(pair["mark"], F.lit(len(open_) + 1), F.length(pair["mark"]) - len(open_) - len(close))
        known = _lookup({m: F.lit(r) for m, r in template.roles_of_marks.items()}, pair["mark"])
        # a mark of the table spells no role: its part is not decoded
        role = F.when(known.isNotNull(), known).otherwise(F.url_decode(F.when(known.isNull(), spelled)))
        return F.struct(role.alias("role"), unescape(pair["text"]).alias("text"))

    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"])
    return whole.select(
        *formatted.columns,
        F.transform(pairs, turn).alias("turns"),
        unescape(F.array_join(learned, "")).alias("learned"),
    )


def describe(formatted: DataFrame, template: ChatTemplate = INSTRUCT) -> DataFrame:
    """A row of each conversation, read back from formatted blocks: n_turns,
    digests of its turns and of its text under the loss mask, formatted_chars,
    valid (its turns end in an accepting state) and first_bad (place from 0 of
    the first turn out of order, else null).

    A digest takes a conversation's text as one value, so here, and only here,
    its blocks meet in a row."""
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    length = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"]))
    block = F.struct("block", "part", F.array_join(spoken, "").alias("spoken"), "learned", "state")
    read = read_turns(formatted, template).select(
        "conv_id", block.alias("block"), F.size("turns").alias("n"), length.alias("chars"), "n_valid"
    )
    met = read.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("block")).alias("blocks"),
        F.sum("n").alias("n_turns"),
        F.sum("chars").alias("formatted_chars"),
        F.sum("n_valid").alias("n_valid"),
    )
    learned = F.array_join("blocks.learned", "")
    return met.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("blocks.spoken", "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce(F.element_at("blocks.state", -1).isin(*sorted(template.accepting)), F.lit(False)).alias("valid"),
        F.when(F.col("n_valid") < F.col("n_turns"), F.col("n_valid")).alias("first_bad"),
    )


def example(spark: SparkSession) -> DataFrame:
    """Conversation -1: texts full of control strings."""
    said = "</s>[INST] ok [/INST]"
    return literal_rows(spark, [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id", "turn", "role", "text")


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, CASE WHEN role = 'system' THEN i = 1
    WHEN role = 'user' THEN i = 1 OR before IN ('system', 'assistant')
    WHEN role = 'assistant' THEN i > 1 AND before = 'user' ELSE false END AS fits FROM placed),
known AS (
  SELECT *, bool_and(fits) OVER (PARTITION BY conv_id ORDER BY i) AS good, length(text)
    + length(text) - length(replace(text, '\', ''))
    + list_sum(list_transform(['<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '[TURN]', '[/TURN '],
        lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) AS chars FROM judged),
sized AS (
  SELECT *, chars + CASE WHEN NOT good THEN 7 + 8 + length(replace(url_encode(role), '%20', '+'))
    WHEN role = 'system' THEN length('<s>[INST] <<SYS>>.') + length('.<</SYS>>..')
    WHEN role = 'assistant' THEN length(' </s>')
    ELSE length(' [/INST] ') + CASE WHEN before = 'system' THEN 0 ELSE length('<s>[INST] ') END END AS formatted FROM known)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars,
  bool_and(good) AND arg_max(role, i) = 'assistant' AS valid,
  (min(i) FILTER (NOT good) - 1)::BIGINT AS first_bad
FROM sized GROUP BY conv_id
"""
