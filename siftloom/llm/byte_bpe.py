"""Byte-level BPE over Arrow batches, with the ``tokenizers`` library.

Bytes are written as printable characters by the byte table; matches of the pattern are
encoded apart.  Offsets are counted in characters of the text: an id that holds only part
of a character's bytes spans that whole character.  Decoding reverses the byte table over
all ids of a text before it reads UTF-8, so characters split between ids are whole again.

Defined results: a null or empty text has no ids; repeated rows are encoded one by one; an
empty table gives no rows; extra columns are kept by ``encode`` and ``decode`` (a column
named like an output is replaced).
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrays import ragged, steps, text_buffers
from siftloom.llm.pretokens import TOKEN_BYTES, Memo, character_classes, encode_texts
from siftloom.llm.registry import query, table


def byte_table() -> list[str]:
    """Character of each byte: itself if it is printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of one ranks file."""

    def __init__(self, ranks_path: str):
        from tokenizers import Tokenizer, models

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        as_text = byte_table()
        spelled = {token: "".join(as_text[b] for b in token) for token in ranks}
        # every way to cut a token into two tokens is a merge of the token's rank
        merges = [
            (spelled[token[:i]], spelled[token[i:]])
            for token, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
        ]
        vocab = {spelled[token]: rank for token, rank in ranks.items()}
        self.library = Tokenizer(models.BPE(vocab, merges, ignore_merges=True))
        self.spell = as_text
        # decoding goes back from the library's tokens through the byte table
        back = {c: b for b, c in enumerate(as_text)}
        tokens = [bytes([back[c] for c in self.library.id_to_token(i) or ""]) for i in range(max(ranks.values()) + 1)]
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = np.array([str(i) for i in range(len(tokens))], object)
        self.memo = Memo(self._encode)

    def _encode(self, matches: list[str]) -> list[list[int]]:
        spell, tokenize = self.spell, self.library.model.tokenize
        return [[t.id for t in tokenize("".join([spell[b] for b in m.encode()]))] for m in matches]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the index of each text's first id."""
        return encode_texts(data, offsets, True, self.memo, character_classes())

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        return self.bytes[ragged(self.first[ids], self.size[ids])]

    def spans(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, first: np.ndarray):
        """First and last+1 character, within its text, of each id."""
        ends = np.cumsum(self.size[ids])
        starts = ends - self.size[ids]
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        base = np.repeat(lead[offsets[:-1]], np.diff(first))
        # a continuation byte belongs to the character before it
        inside = np.concatenate([(data & 0xC0) == 0x80, [False]])
        return lead[starts] - inside[starts] - base, lead[ends] - base


@functools.cache
def codec(ranks_path: str) -> ByteBpe:
    return ByteBpe(ranks_path)


def _with(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(n) for n in batch.schema.names if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def _schema(df: DataFrame, added: str) -> str:
    names = [x.split()[0] for x in added.split(", ")]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in names]
    return ", ".join([*kept, added])


def encode(df: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Add ``ids``, ``starts`` and ``ends`` (character offsets) of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for whole in batches:
            for batch in steps(whole, text):
                data, offsets = text_buffers(batch.column(text))
                ids, first = bpe.encode(data, offsets)
                starts, ends = bpe.spans(data, offsets, ids, first)
                lists = {k: pa.ListArray.from_arrays(first.astype(np.int32), pa.array(v.astype(np.int32)))
                         for k, v in (("ids", ids), ("starts", starts), ("ends", ends))}
                yield _with(batch, lists)

    return df.mapInArrow(run, _schema(df, "ids array<int>, starts array<int>, ends array<int>"))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (the bytes) and ``decoded_text`` (bytes that are no UTF-8 become U+FFFD)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for batch in batches:
            out = [bpe.decode(np.asarray(x or [], np.int64)).tobytes() for x in batch.column(ids).to_pylist()]
            yield _with(batch, {"decoded": pa.array(out, pa.binary()),
                                "decoded_text": pa.array([x.decode(errors="replace") for x in out], pa.string())})

    return df.mapInArrow(run, _schema(df, "decoded binary, decoded_text string"))


def digests(df: DataFrame, ranks_path: str, key: str, text: str = "text") -> DataFrame:
    """Per row: number of ids, digests of the decimal ids and of the bytes decoded from them, CRC-32 of their offsets.

    The ids of a step are encoded, hashed and decoded where they are, and not sent on.  The
    CRC is over all starts, then all ends, as little-endian 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path)
        for whole in batches:
            for batch in steps(whole, text, TOKEN_BYTES):
                data, offsets = text_buffers(batch.column(text))
                ids, first = bpe.encode(data, offsets)
                starts, ends = (x.astype("<i4") for x in bpe.spans(data, offsets, ids, first))
                back = bpe.decode(ids)
                edges = np.concatenate([[0], np.cumsum(bpe.size[ids])])[first]
                written = bpe.decimal[ids]
                cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_pydict({
                    key: batch.column(key), "n_tokens": pa.array(np.diff(first)),
                    "ids_sha256": pa.array([hashlib.sha256(" ".join(written[a:z].tolist()).encode()).hexdigest() for a, z in cuts], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(back[edges[i]: edges[i + 1]]).hexdigest() for i in range(len(cuts))], pa.string()),
                    "offsets_crc32": pa.array([zlib.crc32(ends[a:z].tobytes(), zlib.crc32(starts[a:z].tobytes())) for a, z in cuts], pa.int64()),
                })

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_crc32 long")


@query("op3_byte_bpe")
def op3(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), "doc_id")
