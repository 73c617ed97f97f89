"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole, encoded once, and the sorted spans of its turns are
intersected with the token spans by binary search. Each turn is
MARK role MARK text, and MARK ends the conversation. MARK is a special token of the
tokenizer, so no token crosses the edge of a turn. Control strings inside texts are broken
by a backslash after their first character and backslashes are doubled, which `unescape`
undoes. Token spans are byte spans: the byte-level tokens of a text are its bytes in order.

Rows of a conversation are ordered by (turn, role, text); a null text or role is empty; a
null id is a conversation of its own; repeated rows are turns of their own. A conversation
is one training example and is held by one task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "<|endoftext|>"
# Strings that steer a model in this or another template.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[tuple[str, str]], loss_role: str) -> tuple[str, list[tuple[int, int]]]:
    """(text, byte spans of the texts of `loss_role` in order)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{MARK}{escape(role)}{MARK}", escape(text)
        at += len(head.encode())
        size = len(body.encode())
        if role == loss_role:
            spans.append((at, at + size))
        at += size
        parts += (head, body)
    return "".join(parts) + MARK, spans


def loss_mask(ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet one of the sorted spans; token i is [ends[i-1], ends[i])."""
    mask = np.zeros(len(ends) + 1, dtype=np.int64)
    if spans:
        begin, end = np.array(spans).T
        first = np.searchsorted(ends, begin, side="right")
        starts = np.concatenate([[0], ends[:-1]])
        past = np.searchsorted(starts, end, side="left")
        full = end > begin
        np.add.at(mask, first[full], 1)
        np.add.at(mask, past[full], -1)
    return np.cumsum(mask[:-1]) > 0


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    parts = formatted.split(MARK)[1:-1]
    return [(unescape(r), unescape(t)) for r, t in zip(parts[::2], parts[1::2], strict=True)]


def masked_text(formatted: str, ends: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped. MARK is never masked, so texts stay whole."""
    data = formatted.encode()
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return "".join(unescape(data[starts[a]: ends[b - 1]].decode()) for a, b in zip(first, past))


def format_chats(rows: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv, formatted, input_ids, loss_mask, token_ends (byte offsets) of each conversation.

    `tokenizer` is the path of a byte-level tokenizer file of which MARK is a special token."""
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    whole = rows.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    kind = rows.schema[conv].dataType.simpleString()

    def encode(batches):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        special = model.token_to_id(MARK)
        size = np.zeros(model.get_vocab_size(), dtype=np.int64)
        for token, i in model.get_vocab().items():
            size[i] = len(token)  # one character for each byte
        size[special] = len(MARK)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                made = [render([(t["role"], t["text"]) for t in turns], loss_role)
                        for turns in part.column("turns").to_pylist()]
                coded = model.encode_batch([m[0] for m in made], add_special_tokens=False)
                ids = [np.array(c.ids, dtype=np.int32) for c in coded]
                ends = [np.cumsum(size[i]) for i in ids]
                yield pa.RecordBatch.from_arrays([
                    part.column("conv"), pa.array([m[0] for m in made], pa.string()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([loss_mask(e, m[1]) for e, m in zip(ends, made)], pa.list_(pa.bool_())),
                    pa.array(ends, pa.list_(pa.int64())),
                ], names=[conv, "formatted", "input_ids", "loss_mask", "token_ends"])

    return whole.mapInArrow(
        encode, f"`{conv}` {kind}, formatted string, input_ids array<int>, loss_mask array<boolean>, token_ends array<bigint>"
    )


def digest_chats(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests read back from formatted conversations: turns, and the text under the mask."""
    kind = chats.schema[conv].dataType.simpleString()

    def digest(batches):
        for batch in batches:
            out = []
            for row in batch.select(["formatted", "loss_mask", "token_ends"]).to_pylist():
                turns = read_back(row["formatted"])
                loss = masked_text(row["formatted"], np.array(row["token_ends"]), np.array(row["loss_mask"]))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"]), len(row["token_ends"]),
                            sum(row["loss_mask"])))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(conv), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"],
            )

    return chats.mapInArrow(
        digest, f"`{conv}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_tokens bigint, loss_tokens bigint",
    )
