"""Encoding of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter, never copied into the repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts longer than this many characters are encoded in pieces.
PIECE = 100_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoder of a local rank file (lines of base64 token and rank), without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Split a text where the pattern always splits: before a single blank between two characters that are no white space.

    A piece is longer than ``size`` only where no such place comes sooner.
    """
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1].isspace()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(enc, text: str | None) -> np.ndarray:
    """Ids of a text; null and empty texts have none."""
    if not text:
        return np.empty(0, np.int32)
    if len(text) <= PIECE:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)])


def decode_ids(enc, ids) -> bytes:
    """The raw bytes of the ids, which need not be whole characters."""
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids)


def encoded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """``id_col, ids``: the token ids of every row's text, one row per row.

    Strings that look like special tokens are ordinary text. Null and empty texts
    give an empty list. No shuffle; each row is encoded where it is read.
    """
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            lists = [encode_text(enc, t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            values = np.concatenate(lists).astype(np.int32) if lists else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
