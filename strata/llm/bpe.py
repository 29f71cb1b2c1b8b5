"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The merges are derived from a file of ranks once, on the driver, and sent to
the tasks as one bounded broadcast.  Tasks cut texts where white space begins:
the pattern always splits there, so such a chunk has the same ids wherever it
stands.  Every worker keeps the ids of a bounded number of chunks and passes
only unseen ones to the library.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.worker import held

# Chunks whose ids a worker keeps; the oldest knowledge is dropped as a whole.
CACHED_CHUNKS = 250_000
# Characters of unseen chunks that are passed to the library at once.
BATCH_CHARS = 1_000_000

# Characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that are printable in Latin-1 stand for themselves; the others take
    the code points from 256 on, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge yields ``token``: merge by rank until two parts are left."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer, as the library stores it, that encodes as the ranks and the pattern say."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    characters = byte_characters()

    def shown(token: bytes) -> str:
        return "".join(characters[b] for b in token)

    merges = [
        tuple(map(shown, _halves(token, ranks))) for token in sorted(ranks, key=ranks.get) if len(token) > 1
    ]
    vocabulary = {shown(token): rank for token, rank in ranks.items()}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer.to_str()


class Codec:
    """Encodes and decodes whole texts; one per worker."""

    def __init__(self, stored: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(stored)
        vocabulary = json.loads(stored)["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_characters())}
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        start = 0
        while start < len(chunks):
            end, chars = start, 0
            while end < len(chunks) and (end == start or chars < BATCH_CHARS):
                chars += len(chunks[end])
                end += 1
            found = self.tokenizer.encode_batch(chunks[start:end], add_special_tokens=False)
            for chunk, encoding in zip(chunks[start:end], found):
                self.known[chunk] = np.array(encoding.ids, dtype="<u4").tobytes()
            start = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        for text in texts:
            chunks = _CHUNK.findall(text)
            if len(self.known) > CACHED_CHUNKS:
                self.known.clear()
            unseen = list({c for c in chunks if c not in self.known})
            if unseen:
                self._learn(unseen)
            yield b"".join(map(self.known.__getitem__, chunks))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """Text of any ids; a character that the ids hold only in part becomes U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) code point of every token.

        A token that holds part of a character covers the whole character.
        """
        tokens = np.frombuffer(ids, dtype="<u4")
        lengths = np.fromiter((len(self.bytes_of[i]) for i in tokens), dtype=np.int64, count=len(tokens))
        ends = np.cumsum(lengths)
        data = np.frombuffer(self.decode_bytes(ids), dtype=np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of every byte
        if not len(tokens):
            return ends, ends
        return character[ends - lengths], character[ends - 1] + 1


def codec(stored: str) -> Codec:
    """The worker's codec for a stored tokenizer."""
    return held("bpe", stored, lambda: Codec(stored))


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def _stored(docs: DataFrame, path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path), pattern))


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids of every text of ``docs`` (doc_id, text) and of their decoding.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256.  A null text is empty
    and has no tokens.  One row per row, repeated or not; other columns are not
    read.
    """
    stored = _stored(docs, path, pattern)

    def digests(batches):
        own = codec(stored.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for packed in own.encode(_texts(batch.column("text"))):
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(own.decode_bytes(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        digests, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False, checked: bool = False) -> DataFrame:
    """Add ``token_ids`` to ``docs``, and on request more.

    ``offsets`` adds ``token_starts`` and ``token_ends`` in code points, ``checked``
    adds ``round_trip``: whether the ids decode to the text.  Columns of these
    names are replaced.  Null texts are empty and get no tokens.
    """
    stored = _stored(docs, path, pattern)
    kinds = {"token_ids": "array<int>"}
    if offsets:
        kinds |= {"token_starts": "array<int>", "token_ends": "array<int>"}
    if checked:
        kinds |= {"round_trip": "boolean"}
    added = list(kinds)
    docs = docs.drop(*added)
    names = docs.columns

    def encoded(batches):
        own = codec(stored.value)
        for batch in batches:
            ids, starts, ends, same = [], [], [], []
            column = batch.column("text")
            for text, packed in zip(_texts(column), own.encode(_texts(column))):
                if checked:
                    same.append(own.decode_bytes(packed) == text.encode("utf-8"))
                ids.append(np.frombuffer(packed, dtype="<u4").astype(np.int32))
                if offsets:
                    first, last = own.offsets(packed)
                    starts.append(first.astype(np.int32))
                    ends.append(last.astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in ([ids, starts, ends] if offsets else [ids])]
            if checked:
                lists.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*names, *added])

    schema = docs.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]).schema
    return docs.mapInArrow(encoded, schema)


def decode(rows: DataFrame, path: str, pattern: str, column: str = "token_ids", into: str = "decoded") -> DataFrame:
    """Add the text of the ids in ``column``; null ids give a null text."""
    stored = _stored(rows, path, pattern)
    rows = rows.drop(into)
    names = rows.columns

    def decoded(batches):
        own = codec(stored.value)
        for batch in batches:
            texts = [
                None if ids is None else own.decode(np.asarray(ids, dtype="<u4").tobytes())
                for ids in batch.column(column).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, into])

    return rows.mapInArrow(decoded, rows.select("*", F.lit(None).cast("string").alias(into)).schema)
