"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, decoding by the byte table.

A byte-level vocabulary writes each byte as one printable character (``byte_to_char``).  Encoding gives
ids, the span of each token in the text's characters, and with it every byte's token.  Decoding looks
each id up in a table of bytes; a character whose UTF-8 bytes are split over tokens comes back whole,
because bytes are joined before they are decoded.  Special tokens are never produced: their strings are
ordinary text.

Null texts count as empty: no ids, the digest of nothing.  Row count and repeated rows are kept.  The
tokenizer file is a parameter (it comes with the public tokenizers, on every machine); it is loaded once
per Python worker.  Texts are encoded whole, a few rows at a time, so memory follows the longest text.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

TOKENIZER = "byte_bpe_50k.json"
_loaded: dict[str, tuple] = {}


def byte_to_char() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the rest for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    table = {b: chr(b) for b in plain}
    table.update({b: chr(0x100 + i) for i, b in enumerate(x for x in range(256) if x not in table)})
    return table


def load(path: str | None = None):
    """(tokenizer, bytes of each id), cached by path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        tok.no_truncation()
        tok.no_padding()
        back = {c: b for b, c in byte_to_char().items()}
        table = [b""] * tok.get_vocab_size(with_added_tokens=True)
        for piece, i in tok.get_vocab(with_added_tokens=True).items():
            table[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        check_ranks(table, path)
        _loaded[path] = (tok, table)
    return _loaded[path]


def check_ranks(table: list[bytes], path: str) -> None:
    """The ranks file beside a tokenizer file, where there is one, must give the same bytes for every id."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return
    with open(ranks, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    if any(int(rank) >= len(table) or table[int(rank)] != base64.b64decode(piece) for piece, rank in pairs):
        raise ValueError(f"{path} and {ranks} differ")


def encode_batch(texts: list[str | None], path: str | None = None) -> list[list[int]]:
    tok, _ = load(path)
    return [e.ids for e in tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def encode_with_offsets(text: str | None, path: str | None = None) -> list[tuple[int, int, int, int, int]]:
    """(id, first character, end character, first byte, end byte) of each token.

    Byte offsets partition the UTF-8 text; a token that holds part of a character has that character's
    whole span in the character offsets.
    """
    tok, table = load(path)
    e = tok.encode(text or "", add_special_tokens=False)
    out, at = [], 0
    for i, (s, t) in zip(e.ids, e.offsets):
        out.append((i, s, t, at, at + len(table[i])))
        at += len(table[i])
    return out


def decode_bytes(ids: list[int], path: str | None = None) -> bytes:
    _, table = load(path)
    return b"".join([table[i] for i in ids])


def decode(ids: list[int], path: str | None = None) -> str:
    """Text of the ids; bytes that are no UTF-8 (a cut character at an edge) become U+FFFD."""
    return decode_bytes(ids, path).decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and ids of each row, with the tokens' character offsets."""

    def fn(cols: dict) -> dict:
        rows = [encode_with_offsets(t, path) for t in cols[text_col]]
        return {
            id_col: cols[id_col],
            "ids": [[x[0] for x in r] for r in rows],
            "starts": [[x[1] for x in r] for r in rows],
            "ends": [[x[2] for x in r] for r in rows],
        }

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, ids array<int>, starts array<int>, ends array<int>"
    return map_rows(docs.select(id_col, text_col), fn, schema, rows_at_once=64)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id and text of each row of ids; null ids count as none."""

    def fn(cols: dict) -> dict:
        return {id_col: cols[id_col], "text": [decode(x or [], path) for x in cols[ids_col]]}

    return map_rows(encoded.select(id_col, ids_col), fn, f"{id_col} {dict(encoded.dtypes)[id_col]}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and give the digests of both."""

    def fn(cols: dict) -> dict:
        ids = encode_batch(cols[text_col], path)
        _, table = load(path)
        return {
            id_col: cols[id_col],
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(np.asarray(x, "<u4").tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(b"".join([table[i] for i in x])).hexdigest() for x in ids],
        }

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select(id_col, text_col), fn, schema, rows_at_once=64)
