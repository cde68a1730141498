"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<|turn|>role<|text|>text<|end|>`` and a newline. The three markers are single tokens of their own, so no
token crosses the bounds of a text. A rendered piece of a conversation is encoded once with offsets, and the sorted character spans
of the turns whose text is learned are intersected with the token spans by binary search: the mask has one flag per token.

Control strings inside roles and texts are escaped by a backslash after their first character, and a backslash is
doubled, so unescaping is exact. The query reads everything back from the rendered text, the token offsets and the mask.

Large conversations are dealt by conversation and block of turn numbers, so no task renders or encodes one of them whole; the digests over a
conversation then run over its blocks in order, one block in memory at a time.

Edge cases: null texts and roles are empty; null ids and turn numbers come first and are conversations and turns like others; equal turn numbers
are ordered by role, text; repeated rows are repeated turns; an empty table gives an empty result; other columns are not used.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, pre_tokenizers

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings of this template and of common others.
CONTROL = (
    TURN, TEXT, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
LEARNED = "assistant"
TURNS_PER_BLOCK = 64
PIECE_CHARS = 500_000

_CONTROL = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(
    f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n", re.S,
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text of turns (role, text) and the sorted spans (start, stop) of the learned texts in it."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        pieces += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(pieces), np.array(spans, np.int64).reshape(-1, 2)


def load_tokenizer(path: str) -> Tokenizer:
    """The vocabulary file with the three markers as added tokens and offsets that include leading blanks."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    tokenizer.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (TURN, TEXT, END)])
    return tokenizer


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Flag per token: whether it shares a character with a span; both are sorted by their starts."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    near = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    known = near < len(spans)
    return known & (offsets[:, 1] > spans[np.minimum(near, len(spans) - 1), 0])


def masked_texts(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The text under the mask, read from the tokens: one piece per run of masked tokens."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return [formatted[offsets[a, 0] : offsets[b - 1, 1]] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _format_blocks(path: str, piece_chars: int):
    def finish(key, part, turns, tokenizer):
        formatted, spans = render(turns)
        encoded = tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
        learned = "".join(map(unescape, masked_texts(formatted, offsets, token_mask(offsets, spans))))
        return (*key, part, formatted, len(offsets), learned)

    def batch(rows):
        names = ["conv_id", "block", "part", "formatted", "n_tokens", "learned"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    def run(parts):
        tokenizer = load_tokenizer(path)
        key, part, turns, size, out, held = None, 0, [], 0, [], 0
        for record in parts:
            for conv_id, block, role, text in zip(*(record.column(c).to_pylist() for c in ("conv_id", "block", "role", "text"))):
                if turns and (key != (conv_id, block) or size + len(text) > piece_chars):
                    out.append(finish(key, part, turns, tokenizer))
                    held += size
                    part, turns, size = (part + 1 if key == (conv_id, block) else 0), [], 0
                    if held > piece_chars:
                        yield batch(out)
                        out, held = [], 0
                key = (conv_id, block)
                turns.append((role, text))
                size += len(text)
        if turns:
            out.append(finish(key, part, turns, tokenizer))
        if out:
            yield batch(out)

    return run


def format_conversations(rows: DataFrame, tokenizer_path: str, turns_per_block: int = TURNS_PER_BLOCK, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Pieces (conv_id, block, part, formatted, n_tokens, learned) of all conversations; ordered by block and part they are a conversation."""
    turns = rows.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / turns_per_block), F.lit(-(1 << 62))).cast("long").alias("block"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = turns.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")
    return dealt.select("conv_id", "block", "role", "text").mapInArrow(
        _format_blocks(tokenizer_path, piece_chars), "conv_id long, block long, part long, formatted string, n_tokens long, learned string",
    )


def _digest_conversations(parts):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    state, key, out = None, None, []

    def close():
        n, turns, chars, loss, size, tokens = state
        out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    for record in parts:
        for i in range(record.num_rows):
            conv_id, formatted, tokens, learned = (record.column(c)[i].as_py() for c in ("conv_id", "formatted", "n_tokens", "learned"))
            if state is None or conv_id != key:
                if state is not None:
                    close()
                state, key = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], conv_id
            for m in _TURN.finditer(formatted):
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(formatted)
            state[5] += tokens
        if len(out) > 1000:
            yield batch()
            out.clear()
    if state is not None:
        close()
    if out:
        yield batch()


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """Per conversation what its pieces say: turns, text under the loss mask, sizes; read from the formatted text."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part")
    return ordered.mapInArrow(
        _digest_conversations,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long",
    )
