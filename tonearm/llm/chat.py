"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered whole as ``<|turn|>role`` newline ``text<|end|>`` newline per turn. The two
control strings are tokens of their own, so a text never shares a token with them; inside texts and
roles they are escaped, reversibly, by backslashes. The rendered text is encoded once with offsets, and
the sorted spans of the turns that are learned meet the sorted spans of the tokens by binary search.

A conversation is one run of sorted rows, read as a stream. A very long one is rendered in parts of
bounded size that end between turns, where a token ends anyway: its parts in a row are the whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.common import plain_columns

TURN, END = "<|turn|>", "<|end|>"
LEARNED = "assistant"
# Characters of a part from which the next turn begins another.
PART_CHARS = 200_000
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """A text without control strings: each backslash is doubled, ``<|`` has one put in between."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, np.ndarray]:
    """The formatted text and the spans (start, end) of the learned texts in it, in order."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}\n".replace("\n", "\\n", role.count("\n")), escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(pieces), np.array(spans, np.int64).reshape(-1, 2)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def load_encoder(path: str):
    """The tokenizer of a tokenizers JSON file with the two control strings as tokens of their own.

    Special strings of the vocabulary itself are ordinary text.
    """
    from tokenizers import AddedToken, Tokenizer

    encoder = Tokenizer.from_file(path)
    encoder.encode_special_tokens = True
    encoder.add_tokens([AddedToken(x, normalized=False) for x in (TURN, END)])
    return encoder


def loss_tokens(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (sorted spans) overlap a learned span (sorted, disjoint): binary search."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    following = np.searchsorted(spans[:, 1], offsets[:, 0], "right")  # first span that ends later
    begins = np.r_[spans[:, 0], np.iinfo(np.int64).max][following]
    return (begins < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])


def loss_spans(offsets: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Runs of characters under the mask; tokens that are bytes of one character count it once."""
    own = offsets[mask]
    if not len(own):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(own[:, 1])
    first = np.flatnonzero(np.r_[True, own[1:, 0] > reach[:-1]])
    return np.stack([own[first, 0], reach[np.r_[first[1:] - 1, len(own) - 1]]], axis=1)


_KINDS = {"conv_id": pa.int64(), "part": pa.int32(), "last": pa.bool_(), "formatted": pa.string(),
          "input_ids": pa.list_(pa.int32()), "loss_mask": pa.list_(pa.bool_()),
          "loss_start": pa.list_(pa.int64()), "loss_end": pa.list_(pa.int64())}
_SCHEMA = ("conv_id bigint, part int, last boolean, formatted string, input_ids array<int>, "
           "loss_mask array<boolean>, loss_start array<bigint>, loss_end array<bigint>")


def _parts(rows: Iterator[tuple], chars: int) -> Iterator[tuple[int | None, int, bool, list]]:
    """Turns of sorted rows by conversation and part; whether a part is its conversation's last."""
    key, part, turns, size, began = None, 0, [], 0, False
    for conv_id, role, text in rows:
        role, text = role or "", text or ""
        if began and (conv_id != key or size >= chars):
            yield key, part, conv_id != key, turns
            part, turns, size = (part + 1 if conv_id == key else 0), [], 0
        key, began = conv_id, True
        turns.append((role, text))
        size += len(role) + len(text)
    if began:
        yield key, part, True, turns


def format_chats(conversations: DataFrame, tokenizer: str, learned: str = LEARNED,
                 conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Formatted conversations with token ids and loss mask, by part: ``conv_id, part, last,
    formatted, input_ids, loss_mask, loss_start, loss_end`` (code points of ``formatted``).

    Rows are put in order of turn, role and text (nulls first), repeated rows are turns of their own.
    Null roles and texts are empty; rows without an id are one conversation. Only turns whose role
    is ``learned`` count for the loss. Parts of a conversation follow each other in one partition.
    """
    rows = plain_columns(conversations, conv_id=conv_id, turn=turn, role=role, text=text)

    def run(batches):
        encoder = load_encoder(tokenizer)

        def turns():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        out, held = [], 0
        for key, part, last, own in _parts(turns(), part_chars):
            formatted, spans = render(own, learned)
            encoded = encoder.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
            mask = loss_tokens(offsets, spans)
            found = loss_spans(offsets, mask)
            out.append((key, part, last, formatted, encoded.ids, mask, found[:, 0], found[:, 1]))
            held += len(formatted)
            if held >= 1_000_000:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)

    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(run, _SCHEMA))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, k) for x, k in zip(zip(*rows), _KINDS.values())], names=list(_KINDS))


_READ = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(),
         "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: digests of the turns and of the text under the loss mask, both unescaped.

    Takes the rows of ``format_chats`` as they come: parts of a conversation follow each other.
    """

    def run(batches):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n, chars, total, out = 0, 0, 0, []
        for batch in batches:
            for row in batch.select(["conv_id", "last", "formatted", "loss_start", "loss_end"]).to_pylist():
                text = row["formatted"]
                for role, own in turns_of(text):
                    turns.update(f"{role}\n{own}\n".encode())
                    n += 1
                for a, b in zip(row["loss_start"], row["loss_end"]):
                    own = unescape(text[a:b])
                    loss.update(own.encode())
                    chars += len(own)
                total += len(text)
                if row["last"]:
                    out.append((row["conv_id"], n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n, chars, total = 0, 0, 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out), _READ.values())], names=list(_READ))
                out = []

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, "
                                     "loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts look like control strings."""
    tricky = r"\### Assistant: </turn> ok"
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
