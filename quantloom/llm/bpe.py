"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are split by the pre-tokenizer's regular expression and merged by rank. A long text is first cut at safe
boundaries: positions that start a match of the expression whatever surrounds them, so that the pieces' ids joined
are the ids of the whole. Decoding joins the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from quantloom.llm.common import frugal

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Texts longer than this are cut, at the first safe boundary after each so many characters.
LONG = 1 << 16
#: No match of the pre-tokenizer's expression holds a space after a non-space, or a non-letter after a letter.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}])")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, long: int = LONG) -> Iterator[str]:
    """text in parts of about `long` characters, cut only at safe boundaries (a text without any stays whole)."""
    at = 0
    while len(text) - at > long:
        cut = _SAFE.search(text, at + long)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= LONG:
        return enc.encode_ordinary(text)
    return [t for p in pieces(text) for t in enc.encode_ordinary(p)]


def encode_documents(docs: DataFrame, rank_path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """docs' columns, then token_ids array<int>, n_tokens long and decoded binary; those names replace a column of docs.

    A null or empty text has no tokens and decodes to no bytes. Special tokens' strings are ordinary text. Rows are
    independent: repeated rows and null ids pass through; an empty table gives an empty one.
    """
    path, pat = rank_path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN
    own = ["token_ids", "n_tokens", "decoded"]
    names = [c for c in docs.columns if c not in own]
    schema = docs.select(*(f"`{c}`" for c in names)).schema.add("token_ids", ArrayType(IntegerType())).add("n_tokens", "long").add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pat)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [encode(enc, t) if t else [] for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
                arrays = [b.column(b.schema.get_field_index(c)) for c in names]
                arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(map(enc.decode_bytes, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names + own)

    return docs.mapInArrow(frugal(run), schema)


def token_digests(docs: DataFrame, rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256.

    The ids and bytes are digested where they are made, so that no token leaves the worker; nulls as in
    encode_documents."""
    path, pat = rank_path or public_tokenizers.path(RANK_FILE), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pat)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column(1):
                ids = encode(enc, text) if (text := t.as_py()) else []
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
