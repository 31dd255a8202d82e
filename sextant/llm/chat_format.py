"""Chat formatting in budgeted windows.

A conversation becomes one or more windows. Prefix sums of turn tokens choose the spans: with a
stride of ``NEW_SHARE`` of the room that the system turn leaves, a turn belongs to span
floor(tokens of all turns before it / stride). So a span's border follows from prefix sums alone, whatever
task holds the turn. If a span's last turn reaches beyond the room it gets a window of its own. Every
window after the first starts with the conversation's system turn and with up to ``HISTORY_TURNS`` of
the turns before it, as far as they fit in ``HISTORY_SHARE`` of the budget and in what the new turns leave.
The loss mask covers the texts of assistant turns that are new in a window, so a repeated answer is
context and never a target twice.

Template: ``### role: text</turn>`` and a newline per turn. In roles and texts a backslash goes
before each of ``\\ # <`` and before ``|`` after ``<`` (roles: before the colon too), so no control string of the
template or of the vocabulary can appear in a text and reading back is exact. A turn's tokens are those of its
formatted form; turns begin and end at token borders, so a window's tokens are the sum of its turns'. No
window exceeds the budget but that of one turn which exceeds it alone, as no turn is cut.

Rows are range-partitioned by conversation and place in it, so one that holds a third of all rows is
spread over many tasks. Each partition gives the driver one row (token sums of its first and last
conversation, the first few counts, one short system turn), which gives every partition the sums before it; spans are
then put together by (conversation, span). Memory is one window.

Defined results: null text and null role count as empty. Turns are ordered by number, nulls first; rows of
equal conversation and turn stay apart, ordered by role, then by a hash of the text. A system turn is a
conversation's first turn with that role; one of more than ``SYSTEM_SHARE`` of the budget is repeated only where it happens
to fit. Null conversation ids form one conversation. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.tokens import encoder
from sextant.session import checkpointed

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_SHARE = 0.25
#: Share of the room beside the system turn by which spans advance; the rest takes the last turn and history.
NEW_SHARE = 0.75
SYSTEM_SHARE = 0.5
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"
#: Kinds of rows of a span, in their order.
SYSTEM_COPY, HISTORY, NEW = 0, 1, 2

_ESCAPED = re.compile(r"\\(.)", re.S)
_TEXT_SPECIAL = re.compile(r"([\\#<]|(?<=<)\|)")
_ROLE_SPECIAL = re.compile(r"([\\#<:]|(?<=<)\|)")
_TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)</turn>\n", re.S)

WINDOW_DDL = "window_id long, formatted string, loss_spans array<struct<start:int,end:int>>, n_repeated int, n_turns int, n_tokens int"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_END = "</turn>\n"


def escape(text: str) -> str:
    return _TEXT_SPECIAL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str) -> str:
    return f"### {_ROLE_SPECIAL.sub(r'\\\1', role)}: "


@dataclass
class Turn:
    role: str
    text: str
    tokens: int
    is_system: bool = False
    back: int = 0  # of history: turns from it to its span's first


def render(repeated: list[Turn], new: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted window and the code point spans under the loss mask."""
    parts, spans, at = [], [], 0
    for i, turn in enumerate(repeated + new):
        start, text = head(turn.role), escape(turn.text)
        if i >= len(repeated) and turn.role == TARGET_ROLE:
            spans.append((at + len(start), at + len(start) + len(text)))
        parts += [start, text, _END]
        at += len(start) + len(text) + len(_END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


@dataclass(frozen=True)
class Shape:
    """The limits of windows."""

    budget: int = BUDGET
    history_turns: int = HISTORY_TURNS
    history_share: float = HISTORY_SHARE

    @property
    def history_tokens(self) -> int:
        return int(self.budget * self.history_share)

    def room(self, system: int | None) -> int:
        """Tokens beside a system turn of so many, if windows are laid out for it."""
        return self.budget - (system if system is not None and system <= SYSTEM_SHARE * self.budget else 0)

    def stride(self, system: int | None) -> int:
        return max(1, int(NEW_SHARE * self.room(system)))

    def windows(self, system: Turn | None, history: list[Turn], new: list[Turn]) -> list[tuple[list[Turn], list[Turn]]]:
        """(repeated, new) of the one or two windows of a span. ``history``: the turns before it, nearest last."""
        total = sum(t.tokens for t in new)
        # A turn too long for any history was not sent, and ends what can be repeated.
        history = [t for n, t in enumerate(reversed(history), 1) if t.back == n][::-1]
        if len(new) > 1 and total > self.room(system.tokens if system and not new[0].is_system else None):
            parts = [(history, new[:-1]), (history + new[:-1], new[-1:])]
        else:
            parts = [(history, new)]
        return [(self._repeated(system, before, own), own) for before, own in parts]

    def _repeated(self, system: Turn | None, before: list[Turn], new: list[Turn]) -> list[Turn]:
        left = self.budget - sum(t.tokens for t in new)
        first = []
        if system and not new[0].is_system and system.tokens <= left:
            first, left = [system], left - system.tokens
        left = min(left, self.history_tokens)
        chosen: list[Turn] = []
        for turn in reversed(before[-self.history_turns :] if self.history_turns else []):
            if turn.is_system or turn.tokens > left:
                break
            chosen.insert(0, turn)
            left -= turn.tokens
        return first + chosen


@dataclass
class Carry:
    """What a partition has to know of the others: sums before its first conversation's part, and counts after its last."""

    continues: bool = False
    before: int = 0
    last: int = 0  # tokens of the turn before
    system: Turn | None = None
    ahead: tuple[int, ...] = ()


_SUMMARY_DDL = "pid int, single boolean, first_sum long, last_sum long, last_tokens long, head array<int>, system_role string, system_text string, system_tokens int"


def _summary(history_turns: int):
    """One row for each partition with rows: (ids of its first and last conversation, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, first, last, head_, sums, last_tokens, system = False, None, None, [], [0, 0], 0, (None, None, None)
        single = True
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            convs, tokens = batch.column("conv_id").to_pylist(), batch.column("tokens").to_pylist()
            for i, (conv, n) in enumerate(zip(convs, tokens, strict=True)):
                if not started or conv != last:
                    single = not started
                    if not started:
                        first = conv
                    started, last = True, conv
                    sums[1] = 0
                    role = batch.column("role")[i].as_py()
                    system = (role, batch.column("text")[i].as_py(), n) if role == SYSTEM_ROLE else (None, None, None)
                if single:
                    sums[0] += n
                    if len(head_) < history_turns:
                        head_.append(n)
                sums[1] += n
                last_tokens = n
        if started:
            columns = [pa.array([first], id_type), pa.array([last], id_type)]
            values = [TaskContext.get().partitionId(), single, sums[0], sums[1], last_tokens, head_, *system]
            types = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int32()]
            names = ["first_conv", "last_conv", *[part.split()[0] for part in _SUMMARY_DDL.split(", ")]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

    return run


def _carries(rows: list, history_turns: int) -> dict[int, Carry]:
    """Carries of the partitions, from their summaries."""
    rows = sorted(rows, key=lambda r: r["pid"])
    found: dict[int, Carry] = {}
    before, last_tokens, system, conv, started = 0, 0, None, None, False
    for r in rows:
        continues = started and r["first_conv"] == conv
        found[r["pid"]] = Carry(continues, before if continues else 0, last_tokens if continues else 0, system if continues else None)
        own = Turn(r["system_role"], r["system_text"], r["system_tokens"], True) if r["system_role"] is not None else None
        if r["single"] and continues:
            before += r["first_sum"]
        else:
            before, system = r["last_sum"], own
        last_tokens, conv, started = r["last_tokens"], r["last_conv"], True
    for i, r in enumerate(rows):
        ahead: list[int] = []
        for following in rows[i + 1 :]:
            if len(ahead) >= history_turns or following["first_conv"] != r["last_conv"]:
                break
            ahead += following["head"]
            if not following["single"]:
                break
        found[r["pid"]].ahead = tuple(ahead[:history_turns])
    return found


_NAMES = ["conv_id", "span", "kind", "place", "is_system", "role", "text", "tokens", "back"]
_TYPES = [None, pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _route(shape: Shape, carries: dict[int, Carry]):
    """Sends every turn to its span, and to the spans that may repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        carry = carries.get(pid, Carry())
        place = pid << 40
        out: list[tuple] = []
        waiting: deque[tuple] = deque()  # turns whose followers are not known yet
        conv, started = None, False
        before, system, span, stride = 0, None, None, 1

        def send(following: list[int]) -> None:
            """The first waiting turn; ``following``: tokens of the turns after it, at most ``history_turns``."""
            nonlocal before, span
            own_place, role, text, tokens, is_system = waiting.popleft()
            own = before // stride
            if own != span and system is not None and not is_system and system.tokens <= shape.budget:
                out.append((conv, own, SYSTEM_COPY, own_place, True, system.role, system.text, system.tokens, 0))
            out.append((conv, own, NEW, own_place, is_system, role, text, tokens, 0))
            span, before = own, before + tokens
            if tokens <= shape.history_tokens and not is_system:
                at, previous = before, own
                for back, n in enumerate(following, 1):
                    if at // stride != previous:
                        previous = at // stride
                        out.append((conv, previous, HISTORY, own_place, False, role, text, tokens, back))
                    at += n

        def finish(ahead: tuple[int, ...]) -> None:
            while waiting:
                rest = [w[3] for w in list(waiting)[1:]] + list(ahead)
                send(rest[: shape.history_turns])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for own, role, text, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "tokens")), strict=True):
                is_system = False
                if not started or own != conv:
                    finish(())
                    if not started and carry.continues:
                        before, system = carry.before, carry.system
                        stride = shape.stride(system.tokens if system else None)
                        span = (before - carry.last) // stride
                    else:
                        is_system = role == SYSTEM_ROLE
                        before, span = 0, None
                        system = Turn(role, text, tokens, True) if is_system else None
                        stride = shape.stride(tokens if is_system else None)
                    conv, started = own, True
                waiting.append((place, role, text, tokens, is_system))
                place += 1
                if len(waiting) > shape.history_turns:
                    send([w[3] for w in list(waiting)[1:]])
            yield _batch(out, _NAMES, [id_type, *_TYPES[1:]])
            out.clear()
        finish(carry.ahead)
        if out:
            yield _batch(out, _NAMES, [id_type, *_TYPES[1:]])

    return run


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_share: float = HISTORY_SHARE, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, turn, role, text) rows to windows.

    Columns: conv_id, window_id (ascending with the windows of a conversation, with gaps), formatted, loss_spans (code
    points), n_repeated (turns at the start that earlier windows hold), n_turns, n_tokens.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    shape = Shape(budget, history_turns, history_share)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            tokens = [len(encode(f"{head(role)}{escape(text)}{_END}")) for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("role"), batch.column("text"), pa.array(tokens, pa.int32())], names=["conv_id", "role", "text", "tokens"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by span: a span is complete when the next one begins."""
        names = ["conv_id", *[part.split()[0] for part in re.split(r", (?![^<]*>)", WINDOW_DDL)]]
        types = [pa.int64(), pa.string(), _SPANS, pa.int32(), pa.int32(), pa.int32()]
        out: list[tuple] = []
        key, started = None, False
        system: Turn | None = None
        history: list[Turn] = []
        new: list[Turn] = []

        def emit() -> None:
            for i, (repeated, own) in enumerate(shape.windows(system, history, new)):
                formatted, spans = render(repeated, own)
                turns = repeated + own
                out.append((key[0], 2 * key[1] + i, formatted, [{"start": a, "end": b} for a, b in spans], len(repeated), len(turns), sum(t.tokens for t in turns)))

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for own, span, sort, is_system, role, text, tokens, back in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "span", "kind", "is_system", "role", "text", "tokens", "back")), strict=True):
                if not started or (own, span) != key:
                    if started:
                        emit()
                    key, started = (own, span), True
                    system, history, new = None, [], []
                turn = Turn(role, text, tokens, is_system, back)
                if sort == SYSTEM_COPY:
                    system = turn
                elif sort == HISTORY:
                    history.append(turn)
                else:
                    new.append(turn)
                    system = turn if is_system else system
            yield _batch(out, names, [id_type, *types])
            out.clear()
        if started:
            emit()
            yield _batch(out, names, [id_type, *types])

    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "hash"]
    placed = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    # Kept: later passes go by the number of the partition.
    ordered = checkpointed(placed.select("conv_id", "role", "text").mapInArrow(counted, f"conv_id {kind}, role string, text string, tokens int"))
    summaries = ordered.mapInArrow(_summary(history_turns), f"first_conv {kind}, last_conv {kind}, {_SUMMARY_DDL}")
    # A row for each partition; a system turn that is too long to be repeated stays out.
    short = F.when(F.col("system_tokens") <= budget, F.col("system_text")).otherwise("")
    carries = _carries(summaries.withColumn("system_text", short).collect(), history_turns)
    sent = ordered.mapInArrow(_route(shape, carries), f"conv_id {kind}, span long, kind int, place long, is_system boolean, role string, text string, tokens int, back int")
    spans = sent.repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "kind", "place")
    return spans.mapInArrow(put_together, f"conv_id {kind}, {WINDOW_DDL}")


def digests(windows: DataFrame) -> DataFrame:
    """Reads formatted windows back: one row per conversation with digests of turns and of the loss text.

    A digest has to read its conversation in order, so this step brings a conversation's windows to one
    task, which streams them and keeps running hashes.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, started = None, False
        turns = loss = None
        n_turns = loss_chars = chars = 0
        out: list[tuple] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def batch_of(id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            out.clear()
            return found

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for own, formatted, spans, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "n_repeated")), strict=True):
                if not started or own != conv:
                    if started:
                        out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    conv, started, n_turns, loss_chars, chars = own, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(formatted)
                for role, text in read_turns(formatted)[repeated:]:
                    n_turns += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    target = unescape(formatted[span["start"] : span["end"]])
                    loss_chars += len(target)
                    loss.update(target.encode("utf-8", "surrogatepass"))
            yield batch_of(id_type)
        if started:
            out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield batch_of(id_type)

    ordered = windows.select("conv_id", "window_id", "formatted", "loss_spans", "n_repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window_id")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
