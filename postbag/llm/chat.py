"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to one string; nothing else is known
about it.  Prefixes of a conversation are rendered turn by turn: if the output for k
turns begins with the output for k - 1, the rest is turn k's span; if not, the
template rewrites history and the conversation is flagged.  Where the turn's own
text lies inside its span is found by rendering it once more with a probe character
in place of the text.  Assistant texts form the loss mask.

Every whole prefix is rendered and compared with the one before it, so time grows
with the square of a conversation's length.  A template may be declared history-free
(a turn's span depends on that turn alone, as with `marked`): then a turn is rendered
after the one before it only, and a digest of all spans so far is kept.  The declaration
is checked: after 1, 2, 4, 8, ... turns and at a conversation's end the whole prefix is
rendered, and its digest must be that of the spans, else it is an error.  All that takes
about three times the length of the conversation.  Conversations are dealt by conv_id and
sorted, and stream through a task row by row; a conversation's turns are kept to its end.

Null texts and roles are empty.  Turns with equal numbers are ordered by role and
text.  Control strings inside texts are escaped reversibly.  Rows without conv_id belong to
no conversation and are left out.  Other columns are not read.  An empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postbag.llm import common

START, END = "<|im_start|>", "<|im_end|>"
PROBE = ""
Turn = tuple[str, str]


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<|", "&lt;|")


def unescape(text: str) -> str:
    return text.replace("&lt;|", "<|").replace("&amp;", "&")


def marked(turns: list[Turn]) -> str:
    """The built-in template: turn marks around a role line and an escaped text."""
    return "".join(f"{START}{escape(role).replace(chr(10), '&nl;')}\n{escape(text)}{END}\n" for role, text in turns)


def _shared(a: str, b: str) -> int:
    """Length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Renderer:
    """Feeds one conversation's turns to a template and locates them in its output."""

    def __init__(self, template: Callable[[list[Turn]], str], history_free: bool = False):
        self.template, self.history_free = template, history_free
        self.turns, self.done, self.rewrites, self.count = [], template([]), False, 0
        self.every, self.digest = [], hashlib.sha256(self.done.encode("utf-8", "surrogatepass"))

    def check(self) -> None:
        """Whether the spans so far are the output for all turns, as a history-free template's are."""
        whole = hashlib.sha256(self.template(self.every).encode("utf-8", "surrogatepass"))
        if whole.digest() != self.digest.digest():
            raise ValueError("the template was declared history-free, but a turn's span depends on others")

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        """(span, first and end of the text inside it) of the next turn."""
        out = self._span(role, text)
        if self.history_free:
            self.every.append((role, text))
            self.digest.update(out[0].encode("utf-8", "surrogatepass"))
            if self.count & (self.count - 1) == 0:
                self.check()
        return out

    def close(self) -> None:
        if self.history_free and self.count & (self.count - 1):
            self.check()

    def _span(self, role: str, text: str) -> tuple[str, int, int]:
        self.count += 1
        if self.history_free and self.count > 2:  # one turn of context
            self.turns = self.turns[-1:]
            self.done = self.template(self.turns)
        whole = self.template([*self.turns, (role, text)])
        probe = self.template([*self.turns, (role, PROBE)])
        if not whole.startswith(self.done):
            self.rewrites = True
            base = whole[: _shared(whole, self.done)]
        else:
            base = self.done
        span = whole[len(base) :]
        at = probe.find(PROBE, len(base))
        if at < 0 or not span:  # the template drops or moves the text
            first = stop = 0
        else:
            tail = len(probe) - at - len(PROBE)
            first, stop = at - len(base), max(at - len(base), len(span) - tail)
        self.turns.append((role, text))
        self.done = whole
        return span, first, stop


SCHEMA = "conv_id long, number long, role string, span string, text_from int, text_to int, loss boolean, rewrites boolean"


def render(conversations: DataFrame, template: Callable[[list[Turn]], str] = marked, assistant: str = "assistant", history_free: bool | None = None) -> DataFrame:
    """A row per turn in order: its span of the output, where its text lies in it, whether it is under the loss mask.

    `history_free` declares the template as such; left out, only `marked` counts as it.
    """
    free = template is marked if history_free is None else history_free
    common.ship(conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        state.close()
                    now, state = conv, Renderer(template, free)
                role, text = role or "", text or ""
                span, first, stop = state.add(role, text)
                for c, x in zip(cols, (conv, state.count - 1, role, span, first, stop, role == assistant, state.rewrites), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "number", "role", "span", "text_from", "text_to", "loss", "rewrites"])
        if state is not None:
            state.close()

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.where("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n((?:(?!<\|).)*)" + re.escape(END) + r"\n", re.S)


def read_back(rendered: DataFrame) -> DataFrame:
    """Conversations as the output of `marked` holds them: a row each, from spans alone.

    Spans of a conversation must come one after the other, as `render` leaves them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def new(conv):
            state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]

        def close():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6])

        for b in batches:
            out = []
            for conv, span, first, stop, loss, rewrites in zip(*(b.column(c).to_pylist() for c in ("conv_id", "span", "text_from", "text_to", "loss", "rewrites")), strict=True):
                if not state or state[0] != conv:
                    if state:
                        out.append(close())
                    new(conv)
                at = 0
                for m in _TURN.finditer(span):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv}: text outside turns")
                    at = m.end()
                    state[1] += 1
                    state[2].update(f"{unescape(m[1].replace('&nl;', chr(10)))}\n{unescape(m[2])}\n".encode())
                if at != len(span):
                    raise ValueError(f"conversation {conv}: a turn is not closed")
                if loss:
                    text = unescape(span[first:stop])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(span)
                state[6] = state[6] or rewrites
            yield _rows(out)
        if state:
            yield _rows([close()])

    return rendered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
