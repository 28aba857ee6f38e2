"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file lists the byte strings of a vocabulary in the order in which merges are tried. Bytes
are mapped to printable characters, since the library's vocabulary is of strings; the merges are
read off the ranks. Every match of the split pattern is encoded for itself. Decoding is the way
back: ids to characters, characters to bytes. A character of several bytes may be split between
tokens, so offsets are given in bytes and in characters, and single tokens as bytes.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from docketry.llm.common import clean_name, prepare, read

#: Code points of one part of a text, about: what is encoded at once, so that a task's memory does not grow with a text's length.
PART = 1 << 20
#: Chunks whose ids a task keeps: code points of one at most, what a chunk takes besides its ids, and bytes of all.
LONGEST_KEPT, CHUNK_COST, MOST_KEPT = 64, 200, 128 << 20
#: Places where a match of the pattern ends, whatever stands around: before a lone space or line end between other
#: characters, and after such a line end.
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=\S\n)(?=\S)")
#: White space other than spaces and line ends.
_OTHER_SPACE = re.compile(r"[^\S \n]")


def byte_characters() -> list[str]:
    """For each byte a printable character: itself where it is one, else one of those from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a rank file (base64, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that are merged to ``token``: what is left of its bytes after all merges of lower rank; None if not two."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> str:
    """A tokenizer of the tokenizers library with these ranks and this split pattern, as its JSON text."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    shown = lambda token: "".join(map(table.__getitem__, token))
    pairs = [halves(token, ranks) for token in sorted(ranks, key=ranks.__getitem__) if len(token) > 1]
    merges = [(shown(a), shown(b)) for a, b in filter(None, pairs)]
    tokenizer = Tokenizer(models.BPE(vocab={shown(token): rank for token, rank in ranks.items()}, merges=merges))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


def parts_of(text: str, size: int = PART) -> list[str]:
    """The text in parts of about ``size`` code points, cut where matches of the pattern end; whole where there is no such place."""
    out, begin = [], 0
    while len(text) - begin > size:
        place = _SAFE.search(text, begin + size)
        if place is None:
            break
        out.append(text[begin : place.start()])
        begin = place.start()
    return [*out, text[begin:]]


def chunks_of(text: str) -> list[str]:
    """The text cut at all safe places."""
    if not text:
        return []
    if any(x in text for x in ("  ", "\n\n", " \n", "\n ", "\0")) or text[0].isspace() or text[-1].isspace() or _OTHER_SPACE.search(text):
        return _SAFE.split(text)
    return text.replace("\n", " \n ").replace(" ", "\0 ").replace("\0 \n\0 ", "\0\n\0").split("\0")


class ByteTable:
    """Byte strings by id: all of them behind each other, with their places."""

    def __init__(self, vocabulary: dict[str, int]):
        back = {c: b for b, c in enumerate(byte_characters())}
        tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for shown, i in vocabulary.items():
            tokens[i] = bytes(map(back.__getitem__, shown))
        self.tokens = np.array(tokens, object)
        self.sizes = np.array(list(map(len, tokens)), np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; ids that the vocabulary does not have stand for nothing."""
        known = ids[(ids >= 0) & (ids < len(self.tokens))]
        return b"".join(self.tokens[known])

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where each id's bytes begin and end in the text, and the characters they touch, from and to."""
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        begun = np.cumsum(np.concatenate([[0], first]))  # characters begun before each byte
        return starts, ends, begun[starts + 1] - 1, begun[ends]


class RankEncoder:
    """Ids of texts by a tokenizer of the tokenizers library, with those of recurring chunks kept.

    Chunks are words for the most part, so a corpus has each many times. Long ones are not kept,
    and all are let go when those kept reach MOST_KEPT bytes: memory has a bound whatever the texts.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.table = ByteTable(self.tokenizer.get_vocab())
        self.known: dict[str, bytes] = {}
        self.held = 0

    def __call__(self, text: str) -> bytes:
        """The ids as 32-bit numbers behind each other."""
        out: list[bytes] = []
        for part in parts_of(text):
            chunks = chunks_of(part)
            found = list(map(self.known.get, chunks))
            if None in found:
                ids = self._ids({c for c, f in zip(chunks, found, strict=True) if f is None})
                found = [ids[c] if f is None else f for c, f in zip(chunks, found, strict=True)]
                self._keep(ids)
            out += found
        return b"".join(out)

    def _ids(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids by chunk; chunks that begin with a lone space are encoded as one text, since matches end where the next one begins."""
        words = [c for c in chunks if c[0] == " " and len(c) > 1 and not (c[1].isspace() or c[-1].isspace())]
        rest = list(chunks.difference(words))
        *coded, together = self.tokenizer.encode_batch_fast([*rest, "".join(words)], add_special_tokens=False)
        ids = {c: array("i", e.ids).tobytes() for c, e in zip(rest, coded, strict=True)}
        if words:
            whole = array("i", together.ids)
            ends = np.cumsum(self.table.sizes[np.frombuffer(whole, np.int32)])
            data, at = whole.tobytes(), (4 * np.searchsorted(ends, np.cumsum([len(c.encode()) for c in words])) + 4).tolist()
            ids |= {c: data[a:b] for c, a, b in zip(words, [0, *at], at, strict=False)}
        return ids

    def _keep(self, ids: dict[str, bytes]) -> None:
        short = {c: x for c, x in ids.items() if len(c) <= LONGEST_KEPT}
        self.held += sum(map(len, short.values())) + CHUNK_COST * len(short)
        if self.held > MOST_KEPT:
            self.known.clear()
            self.held = 0
        else:
            self.known.update(short)


@cache
def _encoder(tokenizer: str) -> RankEncoder:
    """One for each Python worker and vocabulary, so that tasks that follow each other share known chunks."""
    return RankEncoder(tokenizer)


def _encoding(tokenizer: object, offsets: bool, at: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer.value)
        table = encoder.table
        for batch in batches:
            coded = [encoder(text.as_py() or "") for text in batch.column(at)]
            ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32))
            added = [np.frombuffer(b"".join(coded), np.int32)]
            if offsets:
                ranges = [table.offsets(text.as_py() or "", np.frombuffer(x, np.int32)) for text, x in zip(batch.column(at), coded, strict=True)]
                added += [np.concatenate([[], *r]).astype(np.int32) for r in zip(*ranges, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in added)], names=names)

    return encode


OFFSETS = ("byte_starts", "byte_ends", "char_starts", "char_ends")


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` with the ids of each whole ``text`` (array<int>), and the names of the new columns.

    ``ranks`` is a rank file's path. With ``offsets`` there are four further arrays, one number for
    each id: where its bytes begin and end in the text's UTF-8 form, and the characters (code
    points) it touches. Tokens that share a split character both have that character.

    A null or empty text has no ids. Special tokens do not exist: their strings are ordinary text.
    Repeated rows are encoded alike; an empty table gives an empty one; other columns stay, and new
    names avoid theirs. Nothing is shuffled; a text of any length is encoded in parts of about
    PART code points, cut where matches of the pattern end (a text without a lone space or line end
    between other characters is one part), and its ids are one row.
    """
    prepare(docs.sparkSession)
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_json(load_ranks(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern))
    new = [clean_name(docs, x) for x in ("ids", *(OFFSETS if offsets else ()))]
    schema = StructType([*docs.schema.fields, *(StructField(name, ArrayType(IntegerType())) for name in new)])
    return docs.mapInArrow(_encoding(tokenizer, offsets, docs.columns.index("text"), schema.names), schema), new


def decode(docs: DataFrame, ids: str, ranks: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with the bytes (binary) that the array column ``ids`` stands for, and the new column's name.

    A null array has no bytes; null ids and ids that the vocabulary does not have stand for
    nothing. The bytes of ids that end inside a character are no whole UTF-8 text and stay bytes.
    """
    prepare(docs.sparkSession)
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_json(load_ranks(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))))
    name = clean_name(docs, "decoded")
    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    at = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _encoder(tokenizer.value).table
        for batch in batches:
            rows = (x.values if x.is_valid else pa.array([], pa.int32()) for x in batch.column(at))
            data = [table.decode(x.drop_null().to_numpy(zero_copy_only=False)) for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema), name


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, (ids,) = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    out, data = decode(coded.select("doc_id", ids), ids)
    return out.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids, " "), 256).alias("ids_sha256"), F.sha2(data, 256).alias("decoded_sha256"),
    )
