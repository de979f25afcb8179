"""A tokenizer as a source: texts as token ids, ids as text. The library reads its file once in each worker process; the
file's path is a parameter, and must be there on every machine, as the library itself must."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: End of a word in the vocabulary's strings.
WORD_END = "</w>"
#: Characters of text that go to the library at once.
CHUNK = 1 << 20


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def loaded(path: str):
    """The tokenizer of this process: no truncation or padding, special tokens' strings are ordinary text."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = True
    return out


@functools.cache
def token_strings(path: str) -> list[tuple[bytes, bool]]:
    """Bytes of every token, by id, and whether it ends a word. In a byte-level vocabulary the bytes that print stand for
    themselves, the others, in order, for the characters from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    byte_of = {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}
    vocabulary = loaded(path).get_vocab(with_added_tokens=True)
    out: list[tuple[bytes, bool]] = [(b"", False)] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        body = token.removesuffix(WORD_END)
        out[i] = (bytes(byte_of[c] for c in body) if all(c in byte_of for c in body) else body.encode(), body != token)
    return out


def decoded_ids(path: str, ids: list[int]) -> str:
    """The text of some ids: a space after each end of a word."""
    strings = token_strings(path)
    return b"".join(b + b" " if ends else b for b, ends in (strings[i] for i in ids)).decode("utf-8", "replace")


def texts_in(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with about ``CHUNK`` characters of text (null: empty)."""
    for batch in batches:
        texts, at, size = ["" if t is None else t for t in batch.column(column).to_pylist()], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or k + 1 == len(texts):
                yield batch.slice(at, k + 1 - at), texts[at : k + 1]
                at, size = k + 1, 0


def encode(df: DataFrame, text: str, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of its text."""
    schema, at = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_in(batches, at):
            made = [e.ids for e in loaded(path).encode_batch(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, text: str = "text") -> DataFrame:
    """``df`` with the text of its token ids."""
    schema, at = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]), df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else decoded_ids(path, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)
