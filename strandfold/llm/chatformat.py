"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as ``<|turn|>role<|text|>text<|end|>`` per turn, encoded once with character offsets, and the
sorted spans of the trained roles' texts are intersected with the token spans by binary search. The three marks are
added to the vocabulary as special tokens, so no token crosses the edge of a text. Control strings inside roles and
texts are escaped by a backslash after their first character, one more than the text itself has there, which is undone
exactly.

Defined cases: null roles and texts are empty; turns come in the order of turn, role and text, nulls first, repeated
rows are repeated turns; rows with a null conversation id are one conversation; an empty table gives no rows.
Columns other than the four named ones are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
#: Strings that common chat templates and vocabularies read as control.
CONTROL = (*MARKS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

_rests = {first: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) for first in "<["}
_plain = re.compile(rf"(<\\*)(?={_rests['<']})|(\[\\*)(?={_rests['[']})")
_escaped = re.compile(rf"(<\\*)\\(?={_rests['<']})|(\[\\*)\\(?={_rests['[']})")


def escape(text: str) -> str:
    return _plain.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[0][:-1], text)


def render(turns: Sequence[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans, in characters, of the texts of the trained role."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, text = turn.removeprefix(TURN).split(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """True for tokens inside a span; token starts and ends and the spans are sorted."""
    mask = np.zeros(len(starts), dtype=bool)
    if spans:
        edges = np.array(spans)
        for a, b in zip(np.searchsorted(starts, edges[:, 0], "left"), np.searchsorted(ends, edges[:, 1], "right"), strict=True):
            mask[a:b] = True
    return mask


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def tokenizer_definition(spark, path: str = TOKENIZER):
    """The tokenizer's file (a few MB), read on the driver and broadcast."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("input_ids", T.ArrayType(T.IntegerType())),
    T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
])


def format_conversations(
    rows: DataFrame, trained: str = "assistant", tokenizer: str = TOKENIZER, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, input_ids, loss_mask`` for every conversation."""
    definition = tokenizer_definition(rows.sparkSession, tokenizer)
    turns = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(conv).cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turns)).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        encoder = _tokenizer(definition.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rendered = [
                    render(list(zip(roles, texts, strict=True)), trained)
                    for roles, texts in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True)
                ]
                ids, masks = [], []
                for encoded, (_, spans) in zip(encoder.encode_batch([r[0] for r in rendered], add_special_tokens=False), rendered, strict=True):
                    offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
                    ids.append(encoded.ids)
                    masks.append(mask_tokens(offsets[:, 0], offsets[:, 1], spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_()))], names=FORMATTED.names
                )

    return whole.mapInArrow(run, FORMATTED)


READ_BACK = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("loss_texts", T.ArrayType(T.StringType())), T.StructField("formatted_chars", T.LongType()),
])


def read_formatted(formatted: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Roles, texts and the texts under the loss mask, from token ids and masks alone."""
    definition = tokenizer_definition(formatted.sparkSession, tokenizer)

    def run(batches):
        decoder = _tokenizer(definition.value)
        for batch in batches:
            out = {n: [] for n in READ_BACK.names[1:]}
            for ids, mask in zip(batch.column("input_ids").to_pylist(), batch.column("loss_mask").to_pylist(), strict=True):
                string = decoder.decode(ids, skip_special_tokens=False)
                turns = parse(string)
                edges = np.flatnonzero(np.diff(np.array([False, *mask, False], dtype=np.int8)))
                out["roles"].append([t[0] for t in turns])
                out["texts"].append([t[1] for t in turns])
                out["loss_texts"].append([unescape(decoder.decode(ids[a:b], skip_special_tokens=False)) for a, b in zip(edges[::2], edges[1::2], strict=True)])
                out["formatted_chars"].append(len(string))
            kinds = [pa.list_(pa.string())] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=READ_BACK.names)

    return formatted.select("conv_id", "input_ids", "loss_mask").mapInArrow(run, READ_BACK)
