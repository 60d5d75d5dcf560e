"""Byte-pair encoding of text with a public vocabulary, exact and in linear time.

A piece of text is encoded left to right. An Aho-Corasick automaton over the vocabulary gives the longest
token at each position; a token may follow another only if the pair is compatible, that is if byte-pair
encoding of the two together would leave their boundary alone. Where no compatible token fits, the encoder
takes the last token back and tries its next shorter prefix. Decoding reads byte ranges from an offset table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary of byte_bpe_50k lies unless a caller names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker keeps; when as many are known it starts anew.
KEPT = 200_000
#: Characters of text that are turned into one Arrow batch.
BATCH_CHARS = 4_000_000

# White space by the Unicode property, and the rule that cuts text into pieces.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RULE = "'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{l}{n}]+|[{S}]+(?![^{S}])|[{S}]+"
ANY_PIECES = regex.compile(RULE.replace("{L}", "\\p{L}").replace("{N}", "\\p{N}").replace("{l}", "\\p{L}").replace("{n}", "\\p{N}").replace("{S}", SPACE))
ASCII_PIECES = re.compile(RULE.replace("{L}", "[A-Za-z]").replace("{N}", "[0-9]").replace("{l}", "A-Za-z").replace("{n}", "0-9").replace("{S}", "\\t-\\r "))


def pieces(text: str) -> list[str]:
    """The pieces of ``text``, which no token crosses; the plain rule gives the same on ASCII text."""
    return (ASCII_PIECES if text.isascii() else ANY_PIECES).findall(text)


class Encoder:
    """Tables for one vocabulary; ``ranks`` maps the bytes of a token to its id, ids in order of merging."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.size = max(ranks.values()) + 1
        by_id = {i: b for b, i in ranks.items()}
        self.lengths = array("i", [len(by_id.get(i, b"")) for i in range(self.size)])
        self.offsets = np.concatenate(([0], np.cumsum(np.frombuffer(self.lengths, np.int32), dtype=np.int64)))
        self.bytes = b"".join(by_id.get(i, b"") for i in range(self.size))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, i in ranks.items():
            automaton.add_word(token.decode("latin-1"), i)
        automaton.make_automaton()
        self.matches = automaton.iter
        self.shorter = array("i", [-1]) * self.size  # longest proper prefix that is a token
        self.left, self.right = array("i", range(self.size)), array("i", range(self.size))
        self.merged: dict[int, int] = {}
        for token, i in ranks.items():
            self.shorter[i] = next((p for n in range(len(token) - 1, 0, -1) if (p := ranks.get(token[:n])) is not None), -1)
        for i in sorted(by_id):
            token, prefix = by_id[i], self.shorter[i]
            while prefix >= 0:
                rest = ranks.get(token[self.lengths[prefix] :])
                if rest is not None and prefix < i and rest < i and self.compatible(prefix, rest):
                    self.left[i], self.right[i] = prefix, rest
                    self.merged[prefix * self.size + rest] = i
                    break
                prefix = self.shorter[prefix]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` together is these two tokens.

        Merges are undone from the latest on. If at any time the two parts that touch could be merged before
        the merge just undone, the boundary would not have stood.
        """
        left, right, merged, size = self.left, self.right, self.merged, self.size
        before = size
        while True:
            together = merged.get(a * size + b)
            if together is not None and together < before:
                return False
            undo_left = a > b
            for _ in range(2):
                if undo_left:
                    part = right[a]
                    if part != a:
                        before, a = a, part
                        break
                else:
                    part = left[b]
                    if part != b:
                        before, b = b + 1, part
                        break
                before = a if undo_left else b + 1
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece of text."""
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        n, lengths, shorter, compatible = len(data), self.lengths, self.shorter, self.compatible
        longest = [-1] * n
        for end, token in self.matches(data):  # ends ascend, so the last match of a start is its longest
            longest[end + 1 - lengths[token]] = token
        dead = bytearray(n + 1)  # positions from which no way leads on
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + lengths[token]
                if not dead[end] and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return tuple(out)

    def decode(self, ids) -> str:
        """The text of ``ids``; bytes that are no UTF-8 give the replacement character."""
        offsets, data = self.offsets, self.bytes
        return b"".join(data[offsets[i] : offsets[i + 1]] for i in ids).decode("utf-8", "replace")


class PieceIds(dict):
    """Ids by piece, filled by the encoder; cleared when full, so that its memory is bounded."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        ids = self.encoder.encode_piece(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def parse_vocabulary(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_WORKER: dict[int, PieceIds] = {}


def worker(data: bytes) -> PieceIds:
    """The encoder of this Python process, built on first use."""
    key = hash(data)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = PieceIds(Encoder(parse_vocabulary(data)))
    return _WORKER[key]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    texts, start, chars = batch.column(column).to_pylist(), 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= BATCH_CHARS:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, chars = i + 1, 0
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def _shipped(df: DataFrame, vocabulary: str):
    # a vocabulary is under 1 MB whatever the corpus; workers need no copy of the file
    return df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids array<int>`` of each row, without special tokens; an empty list for empty and null texts.

    Strings that look like special tokens are ordinary text. Rows are kept as they are, repeated ones
    too; an empty table gives an empty one.
    """
    shipped = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = worker(shipped.value).__getitem__
        for batch in batches:
            for rows, texts in _slices(batch, text):
                values, ends = array("i"), array("i", [0])
                for t in texts:
                    if t:
                        values.extend(chain.from_iterable(map(get, pieces(t))))
                    ends.append(len(values))
                ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(values, np.int32) if len(values) else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(key), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, tokens long``: how many ids :func:`encode` gives each row."""
    shipped = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = worker(shipped.value).__getitem__
        for batch in batches:
            texts = batch.column(text).to_pylist()
            counts = [sum(map(len, map(get, pieces(t)))) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64())], [key, "tokens"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens long")


def decode(df: DataFrame, key: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, text`` of rows with ``ids``; a null list gives null, an empty one the empty text."""
    shipped = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker(shipped.value).encoder
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
