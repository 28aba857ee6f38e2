"""Packing of tokenized documents into sequences by minimum bin slack.

Documents are cut into pieces of one sequence's length and a rest. How often each rest occurs is
a table of as many rows as a sequence has tokens, whatever the input. From it a bitset
subset-sum program picks, again and again, the multiset of rests that fills a window closest to
capacity; backtracking gives the count of each length, and the same multiset is used for as many
windows as the counts allow. The places so made are dealt to the pieces by rank among the pieces
of their length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import prepare, read, stored

CAPACITY, END = 1024, 0
#: Chunks of text whose ids a task keeps: code points of one at most, what a chunk takes besides its ids, and bytes of all.
LONGEST_KEPT, CHUNK_COST, MOST_KEPT = 64, 200, 48 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Of tasks by lengths, the rows of first ranks that are broadcast (24 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 200_000


#: White space that is not one space or one line end between other characters.
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]")


class ChunkedEncoder:
    """Ids of whole texts, with those of recurring chunks kept.

    The tokenizer splits before a single space or line end, whatever follows, so a text without
    other white space is encoded chunk by chunk, each with the space before it. Other texts, and
    texts with a special token's string, are encoded whole. ``ranks``, a file with the same
    vocabulary as ranks, encodes chunks not seen before several times as fast, to the same ids.
    Long chunks (a text without spaces is one) are not kept, and all are let go when those kept
    reach MOST_KEPT bytes, so memory has a bound whatever the texts.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.fast = None
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _ODD_SPACE.search(text) or any(x in text for x in self.special):
            return self._encode([text])[0]
        chunks = text.replace("\n", " \n ").replace(" ", "\0 ").replace("\0 \n\0 ", "\0\n\0").split("\0") if "\0" not in text else [text]
        found = list(map(self.known.get, chunks))
        if None in found:
            new = list({c for c, f in zip(chunks, found, strict=True) if f is None})
            ids = dict(zip(new, [array("I", self.fast(c)).tobytes() for c in new] if self.fast else self._encode(new), strict=True))
            found = [ids[c] if f is None else f for c, f in zip(chunks, found, strict=True)]
            self._keep(ids)
        return b"".join(found)

    def rest(self) -> None:
        """Between tasks, when a worker may serve other stages for long, no chunks are kept."""
        self.known.clear()
        self.held = 0

    def _keep(self, ids: dict[str, bytes]) -> None:
        short = {c: x for c, x in ids.items() if len(c) <= LONGEST_KEPT}
        self.held += sum(map(len, short.values())) + CHUNK_COST * len(short)
        if self.held > MOST_KEPT:
            self.rest()
            return
        self.known.update(short)


@cache
def _encoder(path: str) -> ChunkedEncoder:
    """One for each Python worker: the vocabulary is read once."""
    ranks = f"{os.path.splitext(path)[0]}.tiktoken"
    return ChunkedEncoder(path, ranks if os.path.exists(ranks) else None)


def _cutter(path: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), np.array([END], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        names = [x.split()[0] for x in PIECES.split(", ")] + ["part", "nth"] + ["ids"] * with_ids
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, part, seen[length], *([piece] if with_ids else [])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        encode.rest()

    return cut


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of each document, stored: its ids and an end id, cut into runs of ``capacity`` and a rest.

    ``part`` is the task that cut a piece, ``nth`` its number among that task's pieces of its
    length. ``with_ids`` adds the ids themselves (binary, little-endian unsigned 32-bit numbers).
    """
    prepare(docs.sparkSession)
    cut = _cutter(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), capacity, with_ids)
    schema = PIECES + ", part int, nth long" + ", ids binary" * with_ids
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema), "pieces")


def padding(total: int, capacity: int = CAPACITY) -> int:
    return 0 if total & (total - 1) == 0 else capacity - total


def fill_window(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, int]:
    """Counts by length of the multiset that holds the longest piece and leaves the least padding.

    Bit t of the set is on if some choice of the lengths so far sums to t; the sets before each
    length are kept to trace the choice back. Of equal paddings the fuller window is taken.
    """
    longest = max(counts)
    room = capacity - longest
    steps: list[tuple[int, int, int]] = []
    reached, mask = 1, (1 << room + 1) - 1
    for length in sorted(counts, reverse=True):
        most = min(counts[length] - (length == longest), room // length)
        if most > 0:
            steps.append((length, most, reached))
            while most > 0:
                part = most + 1 >> 1  # binary splitting: parts sum to the count, and reach every count below
                reached |= reached << part * length & mask
                most -= part
            if reached >> room & 1:
                break
    rest = min((t for t in range(room + 1) if reached >> t & 1), key=lambda t: (padding(longest + t, capacity), -t))
    chosen = {longest: 1}
    for length, most, before in reversed(steps):
        n = next(k for k in range(most + 1) if rest >= k * length and before >> rest - k * length & 1)
        rest -= n * length
        if n:
            chosen[length] = chosen.get(length, 0) + n
    return chosen


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a window, first offset), sorted; ranks count from 0 by length."""
    left = {k: v for k, v in counts.items() if v and k < capacity}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while left:
        chosen = fill_window(left, capacity)
        times = min(left[k] // n for k, n in chosen.items())
        offset = 0
        for length, n in chosen.items():
            rows.append((length, used[length], sequence, n, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    if counts.get(capacity):
        rows.append((capacity, 0, sequence, 1, 0))
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placer(plan: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] << 48 | plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            _, first, sequence, n, offset = plan[np.searchsorted(keys, length << 48 | rank, side="right") - 1].T
            columns = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            columns += [pa.array(sequence + (rank - first) // n), pa.array(offset + (rank - first) % n * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id (from 0, without gaps) and offset.

    The pieces of a sequence follow each other from offset 0 and hold ``capacity`` ids at most. A
    null or empty text is one piece with the end id alone; repeated rows are packed each for
    itself; an empty table gives an empty one; other columns are not read. With ``with_ids`` each
    piece also carries its ids, and a sequence's ids are those of its pieces in order of offset.

    Tasks number their pieces of each length as they cut them. From the counts by length and task
    come the first ranks of each task, so pieces, equal ones included, get their ranks where they
    are: neither texts nor ids are shuffled unless there are very many tasks. Only the count of
    each length (``capacity`` numbers) reaches the driver.
    """
    cut = pieces(docs, tokenizer, capacity, with_ids)
    counts = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    plan = plan_windows({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = stored(counts.select("length", "part", before.alias("base")), "first-ranks")
    bases = F.broadcast(bases) if bases.count() <= MOST_BROADCAST else bases
    names = [f.name for f in cut.schema if f.name not in ("part", "nth")]
    ranked = cut.join(bases, ["length", "part"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_placer(plan), PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
