"""Problem 6: the whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import encoder
from .common import arrow_map

#: Where the vocabulary files lie; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.json"


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """``id_col`` and the token ids of ``text_col``, without special tokens.

    Each partition is encoded by itself through a pair occurrence index (see ``bpe``); nothing is
    shuffled, and each text is read whole. Null and empty texts give an empty list, blank texts the
    ids of their white space. Rows are neither dropped nor merged, other columns are not read.
    """
    path = path or vocabulary()
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encoder(path).encode(b.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([b.column("id"), lists], names=[id_col, out])

    return arrow_map(source, schema, encode)


def count_tokens(df: DataFrame, text_col: str, keep: list[str], path: str | None = None, out: str = "tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text_col`` (0 for a null or empty text)."""
    path = path or vocabulary()
    source = df.select(df[text_col].alias("_text"), *[df[c] for c in keep])
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array(encoder(path).count(b.column("_text").to_pylist()), pa.int64())
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), n], names=[*keep, out])

    return arrow_map(source, schema, measure)
