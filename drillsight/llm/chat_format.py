"""Chat formatting by incremental black-box rendering.

A template is a function from a list of ``(role, text)`` turns to a string; nothing is known
of how it writes them.  Successive prefixes of a conversation are rendered and consecutive
outputs compared: what is added to the last output is the new turn's span.  The place of the
text inside it comes from two more renderings, with an empty text and with a probe sign.  A
template whose output for a longer prefix does not continue the shorter one rewrites
history; its conversation is marked, and has no spans and no loss.

Long conversations: a template may say how many turns back it looks (``context``).  Then the
prefix that a turn is rendered with starts that many turns before its end.  The declaration is not
taken on trust: whole prefixes are rendered at turns 1, 2, 4, 8, ... and at the end of the
conversation, and compared (by length and digest) with the pieces put together, so a template
that rewrites history at any turn is found.  That is linear in total, and done for conversations
of any length: ``whole_chars`` characters of turns (64 million) are held in memory, and a longer
prefix waits in a temporary file of the task.  A template that writes its output piece by piece
(``stream``) is compared as it writes, in memory that does not grow; a plain black box takes and
gives a prefix whole, which then has to fit into the task's memory.  ``context=None`` renders a
whole prefix at each turn.

Rows are sorted by conversation and turn inside partitions and streamed; a conversation is
never collected.

Rules: null texts and roles are empty.  Rows of one turn number are ordered by role, then
text.  Conversations with a null id are one conversation.  Repeated rows are repeated turns.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.llm.common import table

Turn = tuple[str, str]

#: Strings that steer the format; inside texts each gets a backslash, as each backslash does.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: A sequence that no template writes by itself (of the private use area).
PROBE = "\ue000\ue001\ue000"


def escape(text: str) -> str:
    """No control string of ``text`` is left without a backslash before it."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """Undo :func:`escape`."""
    return _UNESCAPE.sub(r"\1", text)


def inst_pieces(turns: Iterable[Turn]) -> Iterator[str]:
    """``<s>`` first; user turns in ``[INST]``, system in ``<<SYS>>``, assistant ended by
    ``</s>``, any other role named in ``[ROLE]``."""
    yield "<s>"
    for role, text in turns:
        body = escape(text)
        if role == "user":
            yield f"[INST] {body} [/INST]"
        elif role == "assistant":
            yield f" {body}</s>"
        elif role == "system":
            yield f"<<SYS>> {body} <</SYS>>"
        else:
            yield f"[ROLE]{escape(role)}[/ROLE]{body}</s>"


def inst_template(turns: list[Turn]) -> str:
    """:func:`inst_pieces` as one string."""
    return "".join(inst_pieces(turns))


def inst_role(head: str) -> str:
    """The role, read from what :func:`inst_template` writes before a text."""
    if head.startswith("[ROLE]"):
        return unescape(head[len("[ROLE]") : -len("[/ROLE]")])
    return {"[INST] ": "user", "<<SYS>> ": "system", " ": "assistant"}[head]


@dataclass(frozen=True)
class Template:
    """A black box, how far back it looks, and how roles and texts are read back from it."""

    render: Callable[[list[Turn]], str]
    context: int | None = None
    role: Callable[[str], str] = inst_role
    unescape: Callable[[str], str] = unescape
    trained: tuple[str, ...] = ("assistant",)
    #: Characters of turns up to which whole prefixes are held in memory, not in a file.
    whole_chars: int = 64_000_000
    #: What ``render`` gives, piece by piece, for templates that can.
    stream: Callable[[Iterable[Turn]], Iterator[str]] | None = None


INST = Template(inst_template, context=1, stream=inst_pieces)


class _Stored:
    """Turns in a temporary file, in order."""

    def __init__(self, turns: list[Turn]) -> None:
        self.file, self.end = tempfile.TemporaryFile(), 0
        for turn in turns:
            self.append(turn)

    def append(self, turn: Turn) -> None:
        self.file.seek(self.end)
        pickle.dump(turn, self.file)
        self.end = self.file.tell()

    def __iter__(self) -> Iterator[Turn]:
        self.file.seek(0)
        while self.file.tell() < self.end:
            yield pickle.load(self.file)


class Renderer:
    """Renders the turns of one conversation one after the other."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.turns: deque[Turn] = deque(maxlen=template.context)
        self.last = template.render([])
        self.opening = self.last
        self.rewrites = False
        #: The pieces so far, and the turns they were made of: in memory while they are few enough,
        #: then in a file.
        self.size, self.digest = 0, hashlib.sha256()
        self.whole: list[Turn] | None = None if template.context is None else []
        self.stored: _Stored | None = None
        self.count, self.chars, self.next_check = 0, 0, 1
        self._put(self.opening)

    def _put(self, piece: str) -> None:
        self.size += len(piece)
        self.digest.update(piece.encode("utf-8", "surrogatepass"))

    def _checked(self) -> bool:
        """Whether the whole prefix is what the pieces give together."""
        turns = self.whole if self.stored is None else self.stored
        stream = self.template.stream
        size, own = 0, hashlib.sha256()
        for piece in stream(turns) if stream else (self.template.render(list(turns)),):
            size += len(piece)
            own.update(piece.encode("utf-8", "surrogatepass"))
        return size == self.size and own.digest() == self.digest.digest()

    def close(self) -> bool:
        """At the end of the conversation: whether its last prefix shows that history was rewritten."""
        if self.rewrites or not self.count or self.count * 2 == self.next_check:
            return False
        return not self._checked()

    def add(self, turn: Turn) -> tuple[str, int, int]:
        """What the turn adds to the output, and where its text begins and ends there."""
        render, before = self.template.render, list(self.turns)
        base = self.last if self.template.context is None else render(before)
        now = render([*before, turn])
        self.turns.append(turn)
        self.last = now
        if not now.startswith(base):
            self.rewrites = True
            return "", 0, 0
        piece = now[len(base) :]
        empty = render([*before, (turn[0], "")])
        probed = render([*before, (turn[0], PROBE)])
        if not empty.startswith(base) or not probed.startswith(base) or PROBE not in probed[len(base) :]:
            self.rewrites = True
            return "", 0, 0
        head = probed.index(PROBE, len(base)) - len(base)
        tail = len(empty) - len(base) - head
        if self.template.context is not None:
            self._put(piece)
            (self.whole if self.stored is None else self.stored).append(turn)
            self.count += 1
            self.chars += len(turn[0]) + len(turn[1])
            if self.stored is None and self.chars > self.template.whole_chars:
                self.stored, self.whole = _Stored(self.whole), None
            if self.count == self.next_check:
                self.next_check *= 2
                if not self._checked():
                    self.rewrites = True
                    return "", 0, 0
        return piece, head, len(piece) - tail


_PIECES = (
    "conv_id long, position long, role string, piece string, start long, text_start int, "
    "text_end int, loss boolean, rewrites boolean"
)
_NAMES = [x.split()[0] for x in _PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]


def render_turns(turns: DataFrame, template: Template = INST) -> DataFrame:
    """A row for each turn, in order: the ``piece`` of output it adds, where this starts in
    the conversation's output, where the text lies in it, and whether it counts for the loss.
    What the template writes before any turn comes as position -1.

    ``turns`` has ``conv_id, turn, role, text``.  After a turn that rewrites history,
    ``rewrites`` is true and the pieces are empty.  Where the last whole prefix shows that the
    pieces are wrong, a row of position -2 says so.  Rows of a conversation follow each other in one
    partition.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        renderer: Renderer | None = None
        current: object = object()
        position = start = 0
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows: list[tuple] = []
                columns = [c.to_pylist() for c in batch.slice(first, 512).columns]
                for conv, _, role, text in zip(*columns, strict=True):
                    if renderer is None or conv != current:
                        if renderer is not None and renderer.close():
                            rows.append((current, -2, "", "", 0, 0, 0, False, True))
                        current, renderer, position = conv, Renderer(template), 0
                        start = len(renderer.opening)
                        rows.append((conv, -1, "", renderer.opening, 0, 0, 0, False, False))
                    role, text = role or "", text or ""
                    piece, a, b = renderer.add((role, text)) if not renderer.rewrites else ("", 0, 0)
                    loss = role in template.trained and not renderer.rewrites
                    rows.append((conv, position, role, piece, start, a, b, loss, renderer.rewrites))
                    position, start = position + 1, start + len(piece)
                yield _batch_of(rows, _NAMES, _TYPES)
        if renderer is not None and renderer.close():
            yield _batch_of([(current, -2, "", "", 0, 0, 0, False, True)], _NAMES, _TYPES)

    return (
        turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .repartition(parts, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(run, _PIECES)
    )


def formatted(turns: DataFrame, template: Template = INST) -> DataFrame:
    """``conv_id, formatted, loss_spans, rewrites``: each conversation as one string, with the
    character spans under the loss.  For conversations that fit into a row."""
    found = F.sort_array(F.collect_list(F.struct("position", "piece", "start", "text_start", "text_end", "loss")))
    spans = F.transform(
        F.filter("rows", lambda r: r["loss"]),
        lambda r: F.struct(
            (r["start"] + r["text_start"]).alias("start"), (r["start"] + r["text_end"]).alias("end")
        ),
    )
    return (
        render_turns(turns, template)
        .groupBy("conv_id")
        .agg(found.alias("rows"), F.max("rewrites").alias("rewrites"))
        .select(
            "conv_id",
            F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
            spans.alias("loss_spans"),
            "rewrites",
        )
    )


_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, rewrites boolean"
)


def digests(pieces: DataFrame, template: Template = INST) -> DataFrame:
    """Read the pieces back and sum up each conversation, in their order, as a stream."""
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = object()
        state: list | None = None

        def done() -> tuple:
            conv, n, turns, chars, loss, size, rewrites = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, rewrites

        for batch in batches:
            rows: list[tuple] = []
            for conv, position, _, piece, _, a, b, loss, rewrites in zip(
                *[c.to_pylist() for c in batch.columns], strict=True
            ):
                if state is None or conv != current:
                    if state is not None:
                        rows.append(done())
                    current, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                state[5] += len(piece)
                state[6] = state[6] or rewrites
                if position < 0:
                    continue
                state[1] += 1
                if rewrites:
                    continue
                role, text = template.role(piece[:a]), template.unescape(piece[a:b])
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
            if rows:
                yield _batch_of(rows, names, types)
        if state is not None:
            yield _batch_of([done()], names, types)

    return pieces.mapInArrow(run, _DIGESTS)


def _batch_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    return digests(render_turns(turns.unionByName(extra)))
