"""Chat formatting in budgeted windows: turn-aligned spans by prefix sums of turn tokens, limited history, loss spans.

A conversation becomes windows of at most `budget` tokens, where a turn is never cut. The prefix sums of its turns' tokens
tell, for the turn that a window starts with, the last turn that still fits. Every window begins with the
conversation's system turn, then repeats the turns before it as far as `history` tokens go, and then has its own turns. Loss spans
cover the texts of its own assistant turns only, so each target is learnt once.

The template is `<s>` and, a turn, `[INST] role [/INST]text</s>`. Where role or text hold one of these four strings, a backslash after the string's
first character breaks it, and backslashes are doubled; dropping one backslash before any character undoes both.

A conversation is dealt in segments of 2 ** SEGMENT_BITS turn numbers, so that a long one is not one task: a segment's rows come sorted and
are formatted as they stream by. Segments after the first one get copies of the system turn and of the last turns
before them. Which conversations have several segments is known from their keys alone, before any text moves.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stage, text_rows

#: Turn numbers of a segment, as a power of two, and turn numbers that may be repeated as history.
SEGMENT_BITS, HISTORY_TURNS = 8, 8
#: Fixed values of the template.
BEGIN, END, ROLE, TEXT = "<s>", "</s>", "[INST] ", " [/INST]"
CONTROLS = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]")
TURN = re.compile(r"\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
#: Turns that wait for their windows at most, and rows of routes that are sent to every task at most (else they are joined by key).
WAITING, SMALL_ROUTES = 1_024, 50_000
#: Kinds of a segment's rows, in their order.
SYSTEM, HISTORY, OWN = 0, 1, 2
#: The segment of turns without a number.
UNNUMBERED = -(1 << 62)


def escape(text: str) -> str:
    """text without control strings; unescape() brings it back."""
    return CONTROLS.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def written(role: str, text: str) -> tuple[str, int]:
    """One turn in the template, and where its text starts."""
    head = f"{ROLE}{escape(role)}{TEXT}"
    return f"{head}{escape(text)}{END}", len(head)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a window's turns, repeated ones included."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


class Turn:
    """A formatted turn: string, where its text starts, whether it is a target, tokens."""

    __slots__ = ("said", "text_at", "target", "tokens")

    def __init__(self, said: str, text_at: int, target: bool, tokens: int):
        self.said, self.text_at, self.target, self.tokens = said, text_at, target, tokens


class Segment:
    """The windows of one segment, made as its turns come in."""

    def __init__(self, budget: int, history: int, begin: int):
        self.budget, self.history, self.begin = budget, history, begin
        self.system: Turn | None = None
        self.before: list[Turn] = []
        self.waiting: list[Turn] = []
        self.made = 0

    def add(self, kind: int, turn: Turn, opens: bool) -> list[tuple]:
        """Take a turn, which opens its conversation as the system turn or not; windows that are full."""
        if kind == SYSTEM:
            self.system = self.system or turn
        elif kind == HISTORY:
            self.before.append(turn)
        else:
            self.waiting.append(turn)
            if opens:
                self.system = turn
        return self.windows(last=False) if len(self.waiting) >= WAITING else []

    def windows(self, last: bool) -> list[tuple]:
        """Windows of the waiting turns; the last one waits for more turns unless there are none."""
        out, turns, start = [], self.waiting, 0
        sums = np.concatenate([[0], np.cumsum([t.tokens for t in turns])])
        while start < len(turns):
            fixed = [self.system] if self.system and self.system is not turns[start] else []
            room = self.budget - self.begin - sum(t.tokens for t in fixed)
            repeated = self._repeated(turns, start, min(self.history, room - turns[start].tokens))
            room -= sum(t.tokens for t in repeated)
            end = max(start + 1, int(np.searchsorted(sums, sums[start] + room, side="right")) - 1)
            if end >= len(turns) and not last:
                break
            out.append(self._window(fixed + repeated, turns[start:end]))
            start = end
        kept, self.waiting = turns[:start], turns[start:]
        self.before = self._repeated(kept, len(kept), self.history)
        return out

    def _repeated(self, turns: list[Turn], start: int, room: int) -> list[Turn]:
        """The turns right before start that fit into room together, without the system turn, which is always there."""
        found: list[Turn] = []
        for t in (*reversed(turns[:start]), *reversed(self.before)):
            room -= t.tokens
            if room < 0 or t is self.system:
                break
            found.append(t)
        return found[::-1]

    def _window(self, repeated: list[Turn], own: list[Turn]) -> tuple:
        at, spans = len(BEGIN) + sum(len(t.said) for t in repeated), []
        for t in own:
            if t.target:
                spans.append({"start": at + t.text_at, "end": at + len(t.said) - len(END)})
            at += len(t.said)
        tokens = self.begin + sum(t.tokens for t in repeated) + sum(t.tokens for t in own)
        self.made += 1
        return self.made - 1, len(repeated), len(repeated) + len(own), tokens, BEGIN + "".join(t.said for t in (*repeated, *own)), spans


def _routes(rows: DataFrame) -> DataFrame:
    """For conversations of several segments, a row a segment: the next one, its last turn number, the conversation's first turn and all other segments on the first row."""
    segments = rows.groupBy("conv", "segment").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    of = Window.partitionBy("conv").orderBy("segment")
    whole = Window.partitionBy("conv")
    first = F.row_number().over(of) == 1
    found = segments.select("conv", "segment", "low", "high", F.count("*").over(whole).alias("n"), F.lead("segment").over(of).alias("next"), first.alias("leads"))
    found = found.where("n > 1")
    others = found.where("not leads").groupBy("conv").agg(F.collect_list("segment").alias("others")).withColumn("leads", F.lit(True))
    return found.alias("f").join(others.alias("o"), F.col("f.conv").eqNullSafe(F.col("o.conv")) & (F.col("f.leads") == F.col("o.leads")), "left").select("f.*", "o.others")


def windows(turns: DataFrame, vocabulary: str, budget: int = 2_048, history: int = 512, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row a window: conv, segment, window (its number in the segment), repeated and turns (how many stand in it, repeated ones first), tokens, over (a turn that no budget holds), split (the conversation has several segments), formatted, loss (spans of code points).

    Turns are in the order of their numbers, those without one first; of turns with one number, system turns come first, then by role and text. The system
    turn is the first one, if its role is system. vocabulary is the path of a tokenizers file: a turn's tokens are those of its formatted
    string. A turn that does not fit with history drops the history, and one that does not fit at all has a window of its own beside
    the system turn, marked over: nothing is cut or left out. A null text or role is empty. Rows with a null conversation are one conversation; repeated rows are
    turns each. Only four columns are read, so other columns never clash. An empty table gives no rows. Memory is
    bounded by WAITING turns, so by the longest texts, in a conversation of any length.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("segment", F.coalesce(F.shiftright("turn", SEGMENT_BITS), F.lit(UNNUMBERED)))
    routes = stage(_routes(rows), "routes")
    sent = F.broadcast(routes) if routes.count() <= SMALL_ROUTES else routes
    there = rows.alias("r").join(sent.alias("s"), F.col("r.conv").eqNullSafe(F.col("s.conv")) & (F.col("r.segment") == F.col("s.segment")), "left")
    at = lambda segment, kind: F.struct(segment.cast("long").alias("segment"), F.lit(kind).alias("kind"))
    late = F.when(F.col("s.next").isNotNull() & (F.col("r.turn") > F.col("s.high") - HISTORY_TURNS), F.array(at(F.col("s.next"), HISTORY)))
    opening = F.when(F.col("s.leads") & (F.col("r.role") == "system") & F.col("r.turn").eqNullSafe(F.col("s.low")), F.transform("s.others", lambda s: at(s, SYSTEM)))
    none = F.array().cast("array<struct<segment:bigint,kind:int>>")
    every = F.concat(F.array(at(F.col("r.segment"), OWN)), F.coalesce(late, none), F.coalesce(opening, none))
    dealt = there.select("r.conv", F.explode(every).alias("to"), "r.turn", "r.role", "r.text", F.coalesce("s.leads", F.lit(True)).alias("leads"), F.col("s.n").isNotNull().alias("split"))
    dealt = dealt.select("conv", "to.*", "turn", "role", "text", "leads", "split")
    order = ("conv", "segment", "kind", "turn", F.col("role") != "system", "role", "text")
    dealt = text_rows(dealt.repartition("conv", "segment").sortWithinPartitions(*order))
    kind = dealt.schema["conv"].dataType.simpleString()
    names = ["conv", "segment", "window", "repeated", "turns", "tokens", "over", "split", "formatted", "loss"]

    def form(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        measure = lambda said: [len(e) for e in tokenizer.encode_batch_fast(said, add_special_tokens=False)]
        begin = measure([BEGIN])[0]
        here, segment, split, lead, key_type = None, None, False, False, None
        for batch in batches:
            key_type = batch.schema.field("conv").type
            c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            strings = [written(r, t) for r, t in zip(c["role"], c["text"], strict=True)]
            tokens = measure([s for s, _ in strings])
            out = []
            for k, (said, text_at) in enumerate(strings):
                now = (c["conv"][k], c["segment"][k])
                if segment is None or now != here:
                    if segment is not None:
                        out += [(*here, *w, split) for w in segment.windows(last=True)]
                    here, segment, split, lead = now, Segment(budget, history, begin), c["split"][k], True
                own = c["kind"][k] == OWN
                opens = own and lead and c["leads"][k] and c["role"][k] == "system"
                lead = lead and not own
                out += [(*here, *w, split) for w in segment.add(c["kind"][k], Turn(said, text_at, c["role"][k] == target, tokens[k]), opens)]
            yield batch_of(out, key_type)
        if segment is not None:
            yield batch_of([(*here, *w, split) for w in segment.windows(last=True)], key_type)

    def batch_of(out, key_type):
        conv, segment, window, repeated, turns, tokens, formatted, loss, split = zip(*out, strict=True) if out else ((),) * 9
        counts = [pa.array(c, pa.int32()) for c in (window, repeated, turns, tokens)]
        spans = pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        flags = [pa.array([t > budget for t in tokens], pa.bool_()), pa.array(split, pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(conv, key_type), pa.array(segment, pa.int64()), *counts, *flags, pa.array(formatted, pa.string()), spans], names)

    ddl = f"conv {kind}, segment long, window int, repeated int, turns int, tokens int, over boolean, split boolean, formatted string, loss array<struct<start:int,end:int>>"
    return dealt.mapInArrow(form, ddl).withColumnRenamed("conv", conv)


class Digest:
    """Running digests of one conversation, read back from its windows in order."""

    def __init__(self):
        self.n_turns, self.loss_chars, self.formatted_chars = 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, n_turns: int, said: str, loss: str, chars: int) -> None:
        self.n_turns, self.loss_chars, self.formatted_chars = self.n_turns + n_turns, self.loss_chars + len(loss), self.formatted_chars + chars
        self.turns.update(said.encode())
        self.loss.update(loss.encode())

    def row(self, conv) -> tuple:
        return conv, None, None, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, None, None


#: Columns of a digest; segment, window, said and loss are of windows whose conversation is not read to its end yet.
DIGEST = "segment long, window int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, said string, loss string"


def own_text(formatted: str, repeated: int, loss: list[dict]) -> tuple[int, str, str]:
    """Of a window: its own turns, role, line end, text and line end of each, and all text under the loss spans."""
    turns = read_back(formatted)[repeated:]
    return len(turns), "".join(f"{role}\n{text}\n" for role, text in turns), "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)


def digests(found: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation of windows(): conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from formatted and loss.

    A digest runs over a whole conversation in order, so that the texts of conversations of several segments are brought together, in order, and
    pass one task each as a stream; all others are read back where they were formatted and only their digests move."""
    kind = found.schema[conv].dataType.simpleString()
    names = ["conv", *(c.split()[0] for c in DIGEST.split(", "))]

    def batch_of(out, key_type):
        columns = zip(*out, strict=True) if out else ((),) * 10
        types = [key_type, pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def folded(batches, parts):
        """One row a conversation from the parts of its windows; a part that is a row is passed on."""
        here, digest, key_type = None, None, None
        for batch in batches:
            key_type, out = batch.column(0).type, []
            for key, part in parts(batch):
                if digest is not None and (len(part) > 4 or key != here):
                    out.append(digest.row(here))
                    digest = None
                if len(part) > 4:
                    out.append(part)
                    continue
                if digest is None:
                    here, digest = key, Digest()
                digest.add(*part)
            yield batch_of(out, key_type)
        if digest is not None:
            yield batch_of([digest.row(here)], key_type)

    def of_windows(batch):
        for key, segment, window, repeated, split, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, said, learnt = own_text(formatted, repeated, loss)
            yield key, ((key, segment, window, n, None, None, None, len(formatted), said, learnt) if split else (n, said, learnt, len(formatted)))

    def of_texts(batch):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield row[0], (row if row[8] is None else (row[3], row[8], row[9], row[7]))

    first = found.select(F.col(conv).alias("conv"), "segment", "window", "repeated", "split", "formatted", "loss").mapInArrow(lambda b: folded(b, of_windows), f"conv {kind}, {DIGEST}")
    dealt = first.repartition("conv").sortWithinPartitions("conv", "segment", "window")
    out = dealt.mapInArrow(lambda b: folded(b, of_texts), f"conv {kind}, {DIGEST}")
    return out.select(F.col("conv").alias(conv), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
