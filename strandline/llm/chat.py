"""Chat formatting by budgeted windows.

Turns of a conversation are numbered by two levels of counts and cut into
blocks of so many turns, so a conversation of any length is spread over tasks.
Inside a block prefix sums of the turns' tokens choose turn-aligned windows
within a budget.  Each window begins with the system turn, repeats a limited
history of the turns before it, and marks as target the assistant texts that
no window before it had.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from strandline.llm.common import bounded_batches, durable, small

#: Tokens of a window, and of the history it repeats; turns of that history at most.
BUDGET, HISTORY, HISTORY_TURNS = 1024, 256, 4
#: Turns of a block: windows begin anew in each.
BLOCK_TURNS = 1024
_PIECE = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Template:
    """Marks before and after the text of a turn, by role; other roles are named in the output.

    A mark must begin with ``<`` or ``[`` and hold no other mark.  ``escape`` is put behind the first
    character of each mark that a text holds, so no text can end its turn, and
    marks that hold it already get one more: taking one away gives the text back.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[SAYS]", "[/ROLE]")
    escape: str = "\\"

    @cached_property
    def _all(self) -> list[str]:
        return sorted({m for pair in self.marks.values() for m in pair} | set(self.other), key=lambda m: (-len(m), m))

    @cached_property
    def _held(self) -> re.Pattern[str]:
        rests = {f: "|".join(re.escape(m[1:]) for m in self._all if m[0] == f) for f in self._firsts}
        return re.compile("|".join(f"{re.escape(f)}(?:{re.escape(self.escape)})*(?:{rest})" for f, rest in rests.items()))

    @cached_property
    def _firsts(self) -> list[str]:
        return sorted({m[0] for m in self._all})

    @cached_property
    def _mark(self) -> re.Pattern[str]:
        return re.compile("|".join(map(re.escape, self._all)))

    def escaped(self, text: str) -> str:
        """``text`` without any mark."""
        if not any(f in text for f in self._firsts):
            return text
        return self._held.sub(lambda m: m[0][0] + self.escape + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        """The text that ``escaped`` was given."""
        if self.escape not in text:
            return text
        return self._held.sub(lambda m: m[0][0] + m[0][1:].removeprefix(self.escape), text)

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """(formatted turn, start, end): where the escaped text lies in it."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escaped(role) + self.other[1], self.other[2]
        own = self.escaped(text)
        return before + own + after, len(before), len(before) + len(own)

    def parsed(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns of formatted text."""
        roles = {before: (role, after) for role, (before, after) in self.marks.items()}
        at = 0
        while at < len(formatted):
            mark = self._mark.match(formatted, at)
            if mark is None or (mark[0] not in roles and mark[0] != self.other[0]):
                raise ValueError(f"no turn at character {at}")
            begin, role, after = mark.end(), *roles.get(mark[0], ("", self.other[2]))
            if mark[0] == self.other[0]:
                says = self._mark.search(formatted, begin)
                if says is None or says[0] != self.other[1]:
                    raise ValueError(f"no role at character {at}")
                role, begin = self.unescaped(formatted[begin : says.start()]), says.end()
            end = self._mark.search(formatted, begin)
            if end is None or end[0] != after:
                raise ValueError(f"no end of the turn at character {at}")
            yield role, self.unescaped(formatted[begin : end.start()])
            at = end.end()


TEMPLATE = Template()


def count_pieces(text: str) -> int:
    """Words and signs of ``text``, the default measure of tokens."""
    return sum(1 for _ in _PIECE.finditer(text))


def tokenizer_counts(path: str) -> Callable[[str], int]:
    """A measure by the tokenizer file at ``path``, which every executor must be able to read."""
    loaded: dict[str, object] = {}

    def count(text: str) -> int:
        if not loaded:
            from tokenizers import Tokenizer

            loaded["it"] = Tokenizer.from_file(path)
            loaded["it"].encode_special_tokens = True
        return len(loaded["it"].encode(text, add_special_tokens=False).ids)

    return count


def _numbered(turns: DataFrame, template: Template, measure: Callable[[str], int]) -> tuple[DataFrame, DataFrame]:
    """Stored (conv_id, at, role, text, tokens), ``at`` from 0 in order; and (conv_id, n).

    Rows are dealt by ranges of their order, so one conversation may fill many
    partitions.  Each task counts inside its own; a conversation that goes on
    from the partition before gets an offset, of which there is one a partition at most.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "tie", "id"]
    keyed = turns.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("id"))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            placed = []
            for c in batch.column("conv_id").to_pylist():
                conv, at = (conv, at + 1) if c == conv else (c, 0)
                placed.append(at)
            roles = ["" if r is None else r for r in batch.column("role").to_pylist()]
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            sizes = [measure(template.turn(r, t)[0]) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([part] * len(placed), pa.int32()), pa.array(placed, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["conv_id", "part", "local", "role", "text", "tokens"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    stored = durable(ranged.select("conv_id", "role", "text").mapInArrow(count, f"conv_id {kind}, part int, local long, role string, text string, tokens long"), "chat-turns")
    runs = durable(stored.groupBy("conv_id", "part").agg(F.count("*").alias("n")), "chat-runs")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = durable(runs.withColumn("past", F.sum("n").over(before)).filter("past is not null").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "past"), "chat-offsets")
    at = stored.join(small(later), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    return at.select("conv_id", (F.col("local") + F.coalesce("past", F.lit(0))).alias("at"), "role", "text", "tokens"), runs.groupBy("conv_id").agg(F.sum("n").alias("n"))


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, block_turns: int = BLOCK_TURNS,
    template: Template = TEMPLATE, measure: Callable[[str], int] = count_pieces,
) -> DataFrame:
    """(conv_id, window, first_turn, n_new, n_repeated, n_tokens, text, loss): windows of ``turns`` (conv_id, turn, role, text).

    A window holds the conversation's first turn, if its role is ``system``;
    up to ``history_turns`` turns and ``history`` tokens of what came before;
    and the turns ``first_turn`` (from 0) and on that the budget has room for.
    The first two are the ``n_repeated`` turns (the system turn is new in
    window 0).  History gives way where the first new turn would not fit; a
    turn that is over the budget even so stands in a window of its own, over
    the budget.  ``loss`` lists the spans (start, end) of ``text``, in code
    points, that hold the escaped texts of new assistant turns.  ``window``
    rises with ``first_turn`` and has gaps.

    Turns go by ``turn``, null first, then by role, then by a hash of the text;
    equal rows all stay.  A null role or text is empty, a null conversation id
    is one conversation, and extra columns are ignored.  No turns, no windows.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    placed, lengths = _numbered(turns, template, measure)
    block = F.floor(F.col("at") / block_turns)
    rows = placed.select("conv_id", block.alias("block"), F.when((F.col("at") == 0) & (F.col("role") == "system"), 0).otherwise(2).alias("kind"), "at", "role", "text", "tokens")
    # The last turns of a block may be history in the next; the system turn goes to every block of its conversation.
    tail = rows.filter((F.col("kind") == 2) & (F.pmod("at", F.lit(block_turns)) >= block_turns - history_turns)).select("conv_id", (F.col("block") + 1).alias("block"), F.lit(1).alias("kind"), "at", "role", "text", "tokens")
    long = lengths.filter(F.col("n") > block_turns).select(F.col("conv_id").alias("_conv"), F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("n") - 1) / block_turns))).alias("to"))
    system = rows.filter("kind = 0").join(long, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", F.col("to").alias("block"), "kind", "at", "role", "text", "tokens")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = object()
        head: tuple | None = None
        past: list[tuple] = []  # candidates for history, oldest first
        held: list[tuple] = []  # new turns of the open window
        told: list[tuple] = []  # history of the open window
        out: list[dict] = []

        def close() -> None:
            nonlocal held, told
            if held:
                own = [*([head] if head and held[0] is not head else []), *told]
                text, at, loss = [], 0, []
                for k, (_, role, said, _) in enumerate([*own, *held]):
                    formatted, a, b = template.turn(role, said)
                    if k >= len(own) and role == "assistant":
                        loss.append({"start": at + a, "end": at + b})
                    text.append(formatted)
                    at += len(formatted)
                first = held[0][0]
                out.append({"conv_id": key[0], "window": first, "first_turn": first, "n_new": len(held), "n_repeated": len(own), "n_tokens": sum(t[3] for t in own + held), "text": "".join(text), "loss": loss})
            held, told = [], []

        def take(turn: tuple) -> None:
            nonlocal told
            fixed = head[3] if head and head is not turn else 0
            if held and fixed * (held[0] is not head) + sum(t[3] for t in told) + sum(t[3] for t in held) + turn[3] > budget:
                close()
            if not held and turn is not head:
                told, room = [], min(history, budget - fixed - turn[3])
                for old in reversed(past):
                    room -= old[3]
                    if room < 0:
                        break
                    told.insert(0, old)
            held.append(turn)
            if turn is not head:
                past.append(turn)
                del past[:-history_turns or len(past)]

        for batch in batches:
            for r in batch.to_pylist():
                if (r["conv_id"], r["block"]) != key:
                    close()
                    key, head, past = (r["conv_id"], r["block"]), None, []
                turn = (r["at"], r["role"], r["text"], r["tokens"])
                if r["kind"] == 0:
                    head = turn
                    if r["block"] == 0:
                        take(turn)
                elif r["kind"] == 1:
                    past.append(turn)
                else:
                    take(turn)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    conv = turns.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv}, window long, first_turn long, n_new int, n_repeated int, n_tokens long, text string, loss array<struct<start: int, end: int>>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    dealt = rows.unionByName(tail).unionByName(system).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "at")
    return dealt.mapInArrow(choose, ddl)


def read_back(windows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of stored windows, from their text and loss alone.

    The digests are of a conversation's whole text in order, so each
    conversation passes through one task, a turn at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = object()
        open_: dict | None = None
        out: list[dict] = []

        def close() -> None:
            if open_ is not None:
                out.append(open_ | {"turns_sha256": open_["turns_sha256"].hexdigest(), "loss_sha256": open_["loss_sha256"].hexdigest()})

        for batch in batches:
            for r in batch.to_pylist():
                if open_ is None or r["conv_id"] != key:
                    close()
                    key = r["conv_id"]
                    open_ = {"conv_id": key, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
                for k, (role, text) in enumerate(template.parsed(r["text"])):
                    if k >= r["n_repeated"]:
                        open_["n_turns"] += 1
                        open_["turns_sha256"].update(f"{role}\n{text}\n".encode())
                for span in r["loss"]:
                    text = template.unescaped(r["text"][span["start"] : span["end"]])
                    open_["loss_chars"] += len(text)
                    open_["loss_sha256"].update(text.encode())
                open_["formatted_chars"] += len(r["text"])
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    conv = windows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    dealt = windows.select("conv_id", "window", "n_repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(digest, ddl)


def chat_digest(turns: DataFrame) -> DataFrame:
    """What ``read_back`` finds in the stored windows of ``turns``."""
    return read_back(durable(format_windows(turns), "chat-windows"))
