"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of the turns' tokens give the longest
span of new turns that fits the budget; every window starts with the leading system turns and, after
the first, repeats the latest earlier turns up to a history budget. Loss falls on the text of each
assistant turn once: in the window where the turn is new. Repeated turns are masked.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``<|`` is written ``<\\|`` (one
backslash more if there are some), so that no control string comes from a text, and reading undoes it.

Defined results: null text or role is empty; turns are ordered by (turn, role, text) with nulls first;
equal rows are separate turns; rows with a null conversation id form one conversation. A turn longer
than the budget has a window of its own, whole, with ``over_budget`` set. Other columns are not carried.

A conversation passes through its task turn by turn: held are its system turns, the turns of the window that is open and
those that the next may repeat, however long the conversation is. Windows are rows. Turn tokens are counted word by
word with a bounded cache: the tokenizer never joins across a single space between two words.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

BUDGET, HISTORY, CACHE_WORDS, ROWS = 1024, 128, 200_000, 500
START, END = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"
_TO, _FROM = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

_BETWEEN_WORDS = re.compile(r"(?<=\S)(?= \S)")

WINDOW = ("conv_id string, window long, text string, n_tokens long, n_system long, n_history long, n_new long, "
          "over_budget boolean, loss array<struct<start:long,end:long>>")


def escape(text: str) -> str:
    return _TO.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _FROM.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Windows:
    """The windows of one conversation, from its turns in order."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: list[tuple[str, str, int]] = []  # (role, text, tokens)
        self.repeated: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.recent: deque[tuple[str, str, int]] = deque()  # the latest turns that fit the history
        self.base = self.spent = self.kept = self.number = 0
        self.leading = True

    def push(self, role: str, text: str, cost: int):
        """Take a turn; the window that it closes, if it does."""
        turn, closed = (role, text, cost), None
        self.leading = self.leading and role == "system"
        if self.leading:
            self.system.append(turn)
            self.base += cost
            return None
        if self.new and self.base + self.spent + cost > self.budget:
            closed = self._close()
            self.repeated = list(self.recent)
            self.spent = self.kept
            while self.repeated and self.base + self.spent + cost > self.budget:
                self.spent -= self.repeated.pop(0)[2]  # less history before a turn is put over the budget
        self.new.append(turn)
        self.spent += cost
        self.recent.append(turn)
        self.kept += cost
        while self.kept > self.history:
            self.kept -= self.recent.popleft()[2]
        return closed

    def last(self):
        return self._close() if self.new or self.system and not self.number else None

    def _close(self) -> dict:
        parts, loss, size = [], [], 0
        masked = (len(self.system) if self.number else 0), len(self.system), len(self.system) + len(self.repeated)
        for i, (role, text, _) in enumerate([*self.system, *self.repeated, *self.new]):
            head, body = f"{START}{_role(role)}\n", escape(text)
            if role == TARGET and (i >= masked[2] or masked[0] <= i < masked[1]):
                loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
            parts += [head, body, f"{END}\n"]
            size += len(head) + len(body) + len(END) + 1
        cost = self.base + self.spent
        made = {"window": self.number, "text": "".join(parts), "n_tokens": cost, "n_system": len(self.system),
                "n_history": len(self.repeated), "n_new": len(self.new), "over_budget": cost > self.budget, "loss": loss}
        self.number, self.new, self.repeated = self.number + 1, [], []
        return made


class Costs(dict):
    """Word, with the space before it -> number of its tokens."""

    def __init__(self, vocabulary: str | None = None, words: int = CACHE_WORDS):
        super().__init__()
        self.tokenizer, self.limit = _tokenizer(vocabulary), words

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, _BETWEEN_WORDS.split(text)))


def _tokenizer(vocabulary: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                         vocabulary: str | None = None) -> DataFrame:
    """One row per window: conv_id, window (from 0) and what it holds. A conversation's windows are in one partition, one
    after the other. ``vocabulary`` is the path of a tokenizer file."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]
    talks = turns.select(*order).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches):
        costs, now, windows, out = Costs(vocabulary), ..., None, []
        for batch in batches:
            for conv, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                if conv != now:
                    out.append((now, windows and windows.last()))
                    now, windows = conv, Windows(budget, history)
                role, text = role or "", text or ""
                cost = costs.of(f"{START}{_role(role)}\n{escape(text)}{END}\n")
                out.append((now, windows.push(role, text, cost)))
                if len(out) >= ROWS:
                    yield _framed(out)
                    out = []
        out.append((now, windows and windows.last()))
        yield _framed(out)

    # As text, exact also beside nulls.
    done = talks.withColumn("conv_id", F.col("conv_id").cast("string")).select("conv_id", "role", "text").mapInPandas(run, WINDOW)
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))


def _framed(found: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", WINDOW)]
    rows = [{"conv_id": conv, **made} for conv, made in found if made]
    return plain(pd.DataFrame(rows, columns=names), "conv_id", "text", "loss")


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a window's text."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = text.index("\n", at)
        end = text.index(END, line)
        out.append((_read_role(text[at + len(START):line]), unescape(text[line + 1:end])))
        at = end + len(END) + 1
    return out


def digests(windows: DataFrame) -> DataFrame:
    """What the windows say, read back: turns and loss of each conversation. The rows must be as ``format_conversations``
    leaves them, or be brought together by conversation and sorted by window within partitions."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def run(batches):
        now, read, out = ..., None, []
        for batch in batches:
            for conv, number, text, n_system, n_history, loss in zip(*(batch[c] for c in (
                    "conv_id", "window", "text", "n_system", "n_history", "loss"))):
                if conv != now:
                    if read:
                        out.append((now, *read.row()))
                    now, read = conv, _Digest()
                if number != read.n_windows:
                    raise ValueError(f"window {number} of a conversation comes after {read.n_windows} others")
                read.add(text, n_system + n_history if number else 0, loss)
            yield plain(pd.DataFrame(out, columns=names), "conv_id", "turns_sha256", "loss_sha256")
            out = []
        if read:
            yield plain(pd.DataFrame([(now, *read.row())], columns=names), "conv_id", "turns_sha256", "loss_sha256")

    read = windows.select(F.col("conv_id").cast("string").alias("conv_id"), "window", "text", "n_system", "n_history", "loss")
    done = read.mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                 "formatted_chars long, n_windows long")
    return done.withColumn("conv_id", F.col("conv_id").cast(kind))


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_windows = 0

    def add(self, text: str, repeated: int, loss) -> None:
        kept = read_turns(text)[repeated:]
        for role, said in kept:
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for s in loss:
            said = unescape(text[s["start"]:s["end"]])
            self.loss.update(said.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(said)
        self.n_turns, self.chars, self.n_windows = self.n_turns + len(kept), self.chars + len(text), self.n_windows + 1

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_windows
