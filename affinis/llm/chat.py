"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads the roles of a conversation in turn order and holds a table
``state x role -> state``; it runs as one fold of a role array inside the JVM. A conversation that ends in an accepting state
is rendered: each turn becomes the template's three segments (prefix, body, suffix) of its role,
with the loss flag that the template gives to each of them.

A conversation of more than MOST_ROWS rows is never gathered: its turns are cut into parts of PART_TURNS turn numbers, each part is
folded from every state at once, and the parts' tables are chained; texts are joined to the places that this gives their turns. The rows
are the same either way.

Defined cases: a conversation that the machine rejects gives one row with ``seg`` and ``turn`` -1, a null text,
``loss`` false and the reason in ``status`` (``null turn``, ``repeated turn``, ``unknown role``,
``null text``, ``bad order``; the first of these that holds). Rows with a null conversation id are left out, as
they belong to no conversation; rows repeated in full count once; two different rows for one turn
are a ``repeated turn``; empty texts are kept as empty bodies; gaps in turn numbers are allowed; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.common import col, cut, table

#: Rows of a conversation that one task gathers at most, and turn numbers of a part of a longer one.
MOST_ROWS, PART_TURNS = 4096, 4096


@dataclass(frozen=True)
class Template:
    """segments: role -> ((text or None for the turn's own text, loss), ...); moves: (state, role) -> state."""

    segments: dict[str, tuple[tuple[str | None, bool], ...]]
    moves: dict[tuple[str, str], str]
    start: str
    accept: tuple[str, ...]


def _mark(role: str, loss: bool) -> tuple[tuple[str | None, bool], ...]:
    return ((f"<|{role}|>\n", False), (None, loss), ("<|end|>\n", loss))


CHAT = Template(
    segments={"system": _mark("system", False), "user": _mark("user", False), "assistant": _mark("assistant", True), "tool": _mark("tool", False)},
    moves={
        ("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked", ("asked", "assistant"): "answered",
        ("answered", "user"): "asked", ("answered", "tool"): "called", ("called", "assistant"): "answered", ("called", "tool"): "called",
    },
    start="start",
    accept=("answered",),
)


class Machine:
    """A template's numbers and expressions: roles count from 1 (0: unknown), states from 0, the last is dead."""

    def __init__(self, template: Template):
        self.roles, states = sorted(template.segments), sorted({template.start, *template.accept, *(s for s, _ in template.moves), *template.moves.values()})
        self.dead, self.start, self.accept = len(states), states.index(template.start), [states.index(s) for s in template.accept]
        flat = [states.index(template.moves[s, r]) if (s, r) in template.moves else self.dead for s in states for r in self.roles] + [self.dead] * len(self.roles)
        self.moves, self.names = F.array(*map(F.lit, flat)), F.array(*map(F.lit, self.roles))
        piece = lambda p: F.struct(F.lit(p[0]).cast("string").alias("fixed"), F.lit(p[1]).alias("loss"))
        self.pieces = {r: F.array(*map(piece, template.segments[r])) for r in self.roles}

    def step(self, state: Column, role: Column) -> Column:
        return F.element_at(self.moves, state * len(self.roles) + role)

    def status(self, null_turn: Column, repeated: Column, unknown: Column, null_text: Column, end: Column) -> Column:
        """The first of the reasons that holds."""
        return F.when(null_turn, "null turn").when(repeated, "repeated turn").when(unknown, "unknown role").when(null_text, "null text").when(end.isin(self.accept), "ok").otherwise("bad order")


def short_chats(rows: DataFrame, machine: Machine) -> DataFrame:
    """Each conversation as one array."""
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    end = F.aggregate("turns", F.lit(machine.start), lambda s, t: machine.step(s, F.array_position(machine.names, t["role"]).cast("int")))
    any_ = lambda f: F.exists("turns", f)
    numbers = F.transform("turns", lambda t: t["turn"])
    status = machine.status(any_(lambda t: t["turn"].isNull()), F.size(F.array_distinct(numbers)) < F.size(numbers), any_(lambda t: t["role"].isNull() | ~t["role"].isin(machine.roles)), any_(lambda t: t["text"].isNull()), end)
    parts = F.create_map(*(x for r in machine.roles for x in (F.lit(r), machine.pieces[r])))
    shape = "struct<turn:bigint,role:string,text:string,loss:boolean>"
    turn = lambda t: F.transform(
        F.element_at(parts, t["role"]),
        lambda p: F.struct(t["turn"].cast("bigint").alias("turn"), t["role"].alias("role"), F.coalesce(p["fixed"], t["text"]).alias("text"), p["loss"].alias("loss")).cast(shape),
    )
    good = F.flatten(F.transform("turns", turn))
    bad = F.array(F.struct(F.lit(-1).alias("turn"), F.lit(None).alias("role"), F.lit(None).alias("text"), F.lit(False).alias("loss")).cast(shape))
    return (
        chats.withColumn("status", status)
        .select("conv_id", "status", F.posexplode(F.when(F.col("status") == "ok", good).otherwise(bad)).alias("n", "s"))
        .select("conv_id", F.when(F.col("status") == "ok", F.col("n")).otherwise(-1).alias("seg"), "s.turn", "s.role", "s.text", "s.loss", "status")
    )


def long_chats(rows: DataFrame, machine: Machine, part_turns: int = PART_TURNS) -> DataFrame:
    """Conversations of any length: no task holds more than part_turns turns of one, nor their texts."""
    c, null = F.col, lambda name: F.col(name).isNull()
    same = [F.xxhash64(F.lit(k), null("role"), "role", null("text"), "text").alias(f"h{k}") for k in range(2)]
    slim = rows.select("conv_id", "turn", F.coalesce(F.array_position(machine.names, c("role")), F.lit(0)).cast("int").alias("r"), null("text").alias("blank"), *same)
    twice = F.greatest(*(F.min(f"h{k}") < F.max(f"h{k}") for k in range(2)))
    turns = slim.groupBy("conv_id", "turn").agg(F.min("r").alias("r"), F.max("blank").alias("blank"), twice.alias("twice")).withColumn("part", F.floor(c("turn") / part_turns))
    flags = [F.max(e).alias(name) for name, e in (("lost", null("turn")), ("twice", c("twice")), ("unknown", c("r") == 0), ("blank", c("blank")))]
    of_role = F.array(*(machine.pieces[r] for r in machine.roles))
    segments = F.flatten(F.transform("turns", lambda t: F.transform(F.element_at(of_role, F.greatest(t["r"], F.lit(1))), lambda p: F.struct(t["turn"].alias("turn"), t["r"].alias("r"), p["fixed"].alias("fixed"), p["loss"].alias("loss")))))
    fold = lambda s: F.aggregate("turns", s, lambda x, t: machine.step(x, F.greatest(t["r"], F.lit(1))))
    parts = cut(turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "r"))).alias("turns"), *flags))
    told = parts.select("conv_id", "part", F.size(segments).alias("n"), F.transform(F.sequence(F.lit(0), F.lit(machine.dead)), fold).alias("to"), *(x for x in parts.columns if x not in ("conv_id", "part", "turns")))
    chats = told.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "to"))).alias("parts"), *(F.max(x).alias(x) for x in ("lost", "twice", "unknown", "blank")))
    end = F.aggregate("parts", F.lit(machine.start), lambda s, p: F.element_at(p["to"], s + 1))
    judged = cut(chats.select("conv_id", machine.status(c("lost"), c("twice"), c("unknown"), c("blank"), end).alias("status")))  # a row for each long conversation
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = told.join(judged.where("status = 'ok'"), "conv_id", "left_semi").select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("base"))
    places = parts.join(base, ["conv_id", "part"]).select("conv_id", "base", F.posexplode(segments).alias("n", "s")).select("conv_id", (c("base") + c("n")).cast("int").alias("seg"), "s.*")
    texts = rows.groupBy("conv_id", "turn").agg(F.first("text").alias("text"))  # all of them are the same
    good = places.join(texts, ["conv_id", "turn"]).select("conv_id", "seg", c("turn").cast("bigint").alias("turn"), F.element_at(machine.names, c("r")).alias("role"), F.coalesce("fixed", "text").alias("text"), "loss", F.lit("ok").alias("status"))
    bad = judged.where("status <> 'ok'").select("conv_id", F.lit(-1).alias("seg"), F.lit(-1).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("loss"), "status")
    return good.unionByName(bad)


def format_chats(conversations: DataFrame, template: Template = CHAT, most_rows: int = MOST_ROWS, part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_id, seg, turn, role, text, loss, status); seg counts a conversation's segments from 0."""
    rows = conversations.select(*(col(c).alias(c) for c in ("conv_id", "turn", "role", "text"))).where(F.col("conv_id").isNotNull())
    machine = Machine(template)
    large = cut(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most_rows).select("conv_id"))
    if large.isEmpty():
        return short_chats(rows, machine)
    return short_chats(rows.join(large, "conv_id", "left_anti"), machine).unionByName(long_chats(rows.join(large, "conv_id", "left_semi"), machine, part_turns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' END, '' ORDER BY turn) AS code,
    count(*) AS n, count(DISTINCT turn) AS turns, count(turn) AS with_turn, count(text) AS texts,
    count(*) FILTER (role IN ('system', 'user', 'assistant', 'tool')) AS known
  FROM u GROUP BY conv_id),
v AS (
  SELECT conv_id, CASE WHEN with_turn < n THEN 'null turn' WHEN turns < n THEN 'repeated turn' WHEN known < n THEN 'unknown role' WHEN texts < n THEN 'null text'
    WHEN regexp_full_match(code, 's?ua(ua|t+a)*') THEN 'ok' ELSE 'bad order' END AS status FROM c)
SELECT conv_id, CAST(3 * (pos - 1) + k AS INTEGER) AS seg, turn, role,
  CASE k WHEN 0 THEN '<|' || role || '|>' || chr(10) WHEN 1 THEN text ELSE '<|end|>' || chr(10) END AS text, k > 0 AND role = 'assistant' AS loss, 'ok' AS status
FROM (SELECT u.*, row_number() OVER (PARTITION BY u.conv_id ORDER BY turn) AS pos FROM u JOIN v USING (conv_id) WHERE status = 'ok'), (VALUES (0), (1), (2)) AS s(k)
UNION ALL
SELECT conv_id, -1, -1, NULL, NULL, false, status FROM v WHERE status <> 'ok'
"""
