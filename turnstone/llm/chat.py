"""Chat formatting at the level of tokens, and reading it back."""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

#: Control strings of the template, in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
OPEN, CLOSE, HEAD, BODY = range(4)
#: Finds the first character of a control string, of which backslashes may follow.
PLAIN = r"(<(?=\\*/?s>)|\[(?=\\*/?INST\]))"
ESCAPED = re.compile(r"(<(?=\\+/?s>)|\[(?=\\+/?INST\]))\\")


#: Token ids of conversations that are read back at once, which bounds a task's memory.
CHUNK = 1 << 18


@functools.cache
def _coder(path: str) -> tiktoken.Encoding:
    """The byte-level tokenizer of a file of ranks; strings of special tokens are ordinary text to it."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def escape(text: Column) -> Column:
    r"""A text in which no control string is left: each gets a backslash after its first character.

    One that has backslashes there already gets one more, so that unescape() restores every text.
    """
    return F.regexp_replace(text, PLAIN, r"$1\\")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _encoded(text: Column, path: str) -> Column:
    """The token ids of a text column; texts that a batch repeats (as roles) are encoded once."""

    @F.arrow_udf("array<int>")
    @lean
    def run(texts: pa.Array) -> pa.Array:
        encode, coded = _coder(path).encode_ordinary, texts.dictionary_encode()
        found = [np.array(encode(t.as_py()), dtype=np.int32) for t in coded.dictionary]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found]))).take(coded.indices)

    return run(text)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lengths[0] of them), then those of starts[1], and so on."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def assemble(turns: pa.ListArray, reserved: int) -> pa.StructArray:
    """Token ids and loss masks of conversations from their turns' separately encoded segments.

    Every segment's place follows from a prefix sum over the segment lengths. The
    mask is the prefix sum of +1 where a trained segment starts and -1 where it ends.
    """
    flat = turns.flatten()
    role, text = flat.field("role_ids"), flat.field("text_ids")
    train = np.array(flat.field("train").to_pylist(), dtype=bool)
    role_n, text_n = (np.array(x.value_lengths(), dtype=np.int64) for x in (role, text))
    ends = np.cumsum(role_n + text_n + 4)
    starts = ends - (role_n + text_n + 4)
    body = starts + 2 + role_n
    ids = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    for at, control in ((starts, OPEN), (starts + 1, HEAD), (body, BODY), (ends - 1, CLOSE)):
        ids[at] = reserved + control
    ids[_spread(starts + 2, role_n)] = role.flatten()
    ids[_spread(body + 1, text_n)] = text.flatten()
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(steps, (body + 1)[train], 1)
    np.add.at(steps, (ends - 1)[train], -1)
    mask = np.cumsum(steps[:-1]).astype(np.int8)
    per_turn = np.concatenate([[0], ends])
    offsets = pa.array(per_turn[np.concatenate([[0], np.cumsum(np.array(turns.value_lengths(), dtype=np.int64))])].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, mask)]
    return pa.StructArray.from_arrays(lists, ["input_ids", "loss_mask"])


def format_chats(turns: DataFrame, tokenizer: str, reserved: int, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row (conv_id, formatted, input_ids, loss_mask) per conversation.

    turns: rows (conv_id, turn, role, text); other columns are ignored. A turn becomes
    <s>[INST]role[/INST]text</s>, role and text escaped. input_ids has the segments,
    encoded apart by the tokenizer (a file of ranks), between the controls' ids `reserved` to
    `reserved + 3`, which the vocabulary must not use; no text can produce them.
    loss_mask is 1 on the texts of train_roles.

    A null role or text is empty. Rows of one turn number (null first) are ordered by
    role, then text; repeated rows stay. The rows of the null conv_id form a
    conversation too. An empty table gives no rows. A conversation is one output row, so it
    has to fit into a task, very long texts included; texts are encoded before turns are
    brought together.
    """
    clean = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    coded = clean.withColumns({"role_ids": _encoded(escape(F.col("role")), tokenizer), "text_ids": _encoded(escape(F.col("text")), tokenizer)})
    turn = F.struct("turn", "role", "text", "role_ids", "text_ids")
    chats = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    @F.arrow_udf("struct<input_ids: array<int>, loss_mask: array<tinyint>>")
    @lean
    def run(chat_turns: pa.Array) -> pa.Array:
        return assemble(chat_turns, reserved)

    segments = F.transform("turns", lambda t: F.struct(t["role"].isin(*train_roles).alias("train"), t["role_ids"].alias("role_ids"), t["text_ids"].alias("text_ids")))
    text = F.transform("turns", lambda t: F.concat(F.lit("<s>[INST]"), escape(t["role"]), F.lit("[/INST]"), escape(t["text"]), F.lit("</s>")))
    built = chats.select("conv_id", F.array_join(text, "").alias("formatted"), run(segments).alias("tokens"))
    return built.select("conv_id", "formatted", "tokens.input_ids", "tokens.loss_mask")


def read_back(chats: DataFrame, tokenizer: str, reserved: int) -> DataFrame:
    """A row (conv_id, turns, loss_text, formatted) per formatted conversation.

    turns (an array of role and text) and loss_text (the texts under the mask, joined)
    come from the token ids and the mask alone. A conversation is one row in and out, very long texts included;
    repeated rows, and the null conv_id's, are read each; an empty table gives no rows; other columns are ignored.
    """

    @F.arrow_udf("struct<turns: array<struct<role: string, text: string>>, loss_text: string>")
    @lean
    def run(ids: pa.Array, mask: pa.Array) -> pa.Array:
        kind, parts = pa.struct({"turns": pa.list_(pa.struct({"role": pa.string(), "text": pa.string()})), "loss_text": pa.string()}), []
        for a, b in slices(pc.list_value_length(ids), CHUNK):
            rows = [_parsed(np.array(i.values), np.array(m.values), _coder(tokenizer), reserved) for i, m in zip(ids[a:b], mask[a:b])]
            parts.append(pa.array(rows, kind))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    read = chats.select("conv_id", "formatted", run("input_ids", "loss_mask").alias("read"))
    return read.select("conv_id", "read.turns", "read.loss_text", "formatted")


def _parsed(ids: np.ndarray, mask: np.ndarray, coder: tiktoken.Encoding, reserved: int) -> dict:
    at = np.flatnonzero(ids >= reserved)
    kinds = ids[at] - reserved
    if (kinds.reshape(-1, 4) != (OPEN, HEAD, BODY, CLOSE)).any():
        raise ValueError("the control ids are not those of whole turns")
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    texts: dict[tuple[int, int], str] = {}

    def text(begin: int, end: int) -> str:  # a trained text is asked for twice, as a turn's and under the mask
        if (begin, end) not in texts:
            texts[begin, end] = unescape(coder.decode(ids[begin:end].tolist(), errors="strict"))
        return texts[begin, end]

    turns = [{"role": text(head + 1, body), "text": text(body + 1, close)} for _, head, body, close in at.reshape(-1, 4).tolist()]
    return {"turns": turns, "loss_text": "".join(text(a, b) for a, b in edges.reshape(-1, 2).tolist())}
