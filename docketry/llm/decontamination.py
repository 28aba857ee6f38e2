"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training words stream through the automaton of all items; at each word the state gives the
longest run of words that ends there and stands in some item. A run as long as a window marks
its words and names the items that hold the window.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import clean_name, prepare, read, stored

WINDOW = 10
#: Words of items that one automaton holds on average (about 0.5 kB each); more items are taken in further blocks.
BLOCK_WORDS = 200_000
#: Bytes of stored automata that documents pass before marks are written. In memory they take about 15 times as much, so a
#: Python worker holds about 240 MB of them (a block of 200,000 words: 7 MB stored, 103 MB in memory).
PASS_BYTES = 16 << 20
#: A document with a greater share of marked words goes whole when contaminated spans are removed.
MAX_COVERAGE = 0.5
#: Bytes of the marks of earlier passes that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 32 << 20
KEY = ["h0", "h1"]
SPANS, NAMES = pa.list_(pa.int32()), pa.list_(pa.string())

#: Bytes of words stay, A-Z lower-cased; all other ASCII is a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased, as UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class ItemAutomaton:
    """The suffix automaton of several word sequences, with what is needed to name their windows."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[tuple[int, int], set[int]] = {}
        own: dict[int, set[int]] = {}
        short: list[int] = []
        sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for k, ids in enumerate(sequences):
            state = 0
            for c in ids:
                state = self._extend(state, c)
                own.setdefault(state, set()).add(k)
            if 0 < len(ids) < window:
                short.append(k)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if state in own and self.link[state] > 0:
                own.setdefault(self.link[state], set()).update(own[state])
        #: Of states longer than a window: the items of the window at their end.
        self.items_of: dict[int, frozenset[int]] = {}
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[state] >= window:
                up = self.link[state]
                self.items_of[state] = self.items_of[up] if self.length[up] >= window else frozenset(own[state])
        self.least = min([window, *(len(sequences[k]) for k in short)])
        for k in short:  # an item under a window is itself one; it is known by its state and length
            state = 0
            for c in sequences[k]:
                state = self.next[state][c]
            self.whole.setdefault((state, len(sequences[k])), set()).add(k)
        self.short_states = {state for state, _ in self.whole}

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, state: int, c: int, target: int) -> int:
        """The state of (state's longest word run, c): the target, or a shorter copy of it."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._copy(target, self.length[state] + 1)
        while state >= 0 and self.next[state].get(c) == target:
            self.next[state][c] = copy
            state = self.link[state]
        self.link[target] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new = len(self.length) - 1
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, c, self.next[last][c])
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint spans (from, to) of marked words in order; the numbers of the items found."""
        known = list(map(self.vocabulary.get, words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        following, link, length = self.next, self.link, self.length
        state = matched = 0
        for at, c in enumerate(known):
            if c is None:
                state = matched = 0
                continue
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            to = following[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched < self.least:
                continue
            most = 0
            if matched >= self.window:
                top = state  # the matched run may be shorter than the state's longest
                most = matched
                while length[link[top]] >= matched:
                    top = link[top]
                found |= self.items_of[top]
            if self.short_states:
                up = state
                while up > 0:
                    if up in self.short_states:
                        for n in range(max(length[link[up]] + 1, self.least), min(length[up], matched, self.window - 1) + 1):
                            if (up, n) in self.whole:
                                found |= self.whole[up, n]
                                most = max(most, n)
                    up = link[up]
            if most:
                start = at + 1 - most
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at + 1))
        return spans, found


def item_automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Automata of all items, built in tasks and stored: one row for each block, with the pickled automaton.

    Different items (id and text) are dealt to blocks by hash. An item of more than a block's words
    is cut into parts that overlap by a window less one word, so it has the same windows; a part
    keeps the item's id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for start in range(0, max(len(words) - window + 1, 1) if words else 0, max(block_words - window + 1, 1)):
                    names.append(name)
                    parts.append(b" ".join(words[start : start + max(block_words, window)]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], names=["name", "words"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items in batch.column("items"):
                automaton = ItemAutomaton([(x["name"], x["words"].split()) for x in items.as_py()], window)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(automaton)], pa.binary())], names=["automaton"])

    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").where(F.col("text").isNotNull()).distinct()
    items = stored(items.mapInArrow(cut, "name string, words binary"), "benchmark-items")
    n_words = items.agg(F.sum(F.size(F.split(F.col("words").cast("string"), " ")))).first()[0] or 0
    block = F.pmod(F.xxhash64("name", "words"), F.lit(-(-n_words // block_words) or 1))
    blocks = items.groupBy(block.alias("block")).agg(F.collect_list(F.struct("name", "words")).alias("items"))
    return stored(blocks.select("items").mapInArrow(build, "automaton binary"), "benchmark-automata")


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanner(pickled: object, counted: str, known: str, items: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the spans and items that some automata find to those found before; ``pickled`` is a broadcast list of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [pickle.loads(x) for x in pickled.value]
        for batch in batches:
            texts, n_words, spans, names = batch.column("text"), [], [], []
            for text, before, had in zip(texts, batch.column(known).to_pylist(), batch.column(items).to_pylist(), strict=True):
                words = words_of(text.as_py())
                marked, new = _scan_all(automata, words, merge_spans(list(zip(before[::2], before[1::2], strict=True))))
                n_words.append(len(words))
                spans.append([x for s in marked for x in s])
                names.append(list(dict.fromkeys(had + new)))
            new_columns = {counted: pa.array(n_words, pa.int64()), known: pa.array(spans, SPANS), items: pa.array(names, NAMES)}
            columns = [new_columns.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return scan


def _finder(pickled: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The spans and items that some automata find, for texts that have any."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [pickle.loads(x) for x in pickled.value]
        for batch in batches:
            rows, spans, names = [], [], []
            for i, text in enumerate(batch.column("text")):
                marked, new = _scan_all(automata, words_of(text.as_py()), [])
                if marked:
                    rows.append(i)
                    spans.append([x for s in marked for x in s])
                    names.append(new)
            keys = [batch.column(k).take(pa.array(rows, pa.int32())) for k in KEY]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(spans, SPANS), pa.array(names, NAMES)], names=[*KEY, "spans", "items"])

    return find


def _scan_all(automata: list[ItemAutomaton], words: list[bytes], marked: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[str | None]]:
    names: list[str | None] = []
    for automaton in automata:
        new, found = automaton.scan(words)
        marked = merge_spans([*marked, *new]) if marked else new
        names += [automaton.names[k] for k in found]
    return marked, names


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, str, str, str]:
    """``docs`` with three more columns, whose names are returned too: the number of words, the marked spans
    (a flat array of word numbers: from, to, from, to ...) and the items found (their ids as strings).

    A window is ``window`` consecutive words of an item; an item of fewer words is one window; one
    without words has none. Items are held in automata of about ``block_words`` words, and texts
    pass some of them at a time without a shuffle: PASS_BYTES bound what a task and the driver
    hold, whatever the benchmark's size; the number of passes grows with it. All passes but the
    last write the marks they find, by a 128-bit hash of the text, and read texts from their
    source; the last one takes these marks up. A benchmark of one pass writes nothing.

    Null texts have no words. Repeated documents are scanned alike; repeated items are found
    together, and of two items that share an id and not the text both mark and are named by that
    id once; a null item_id is never named but marks. A very long text is scanned as a stream of
    its words. An empty table gives an empty one, an empty benchmark no marks. New names avoid
    those of ``docs``.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = n_words, spans, items = tuple(clean_name(docs, x) for x in ("n_words", "spans", "items"))
    automata = item_automata(benchmark, window, block_words)
    group: list[bytes] = []
    passes: list[DataFrame] = []
    for row in automata.toLocalIterator():
        if group and sum(map(len, group)) + len(row[0]) > PASS_BYTES:
            passes.append(_marks(docs, group))
            group = []
        group.append(bytes(row[0]))
    if passes:
        hashes = dict(zip((clean_name(docs, k) for k in KEY), (_hash(i) for i in range(2)), strict=True))
        before = _together(passes).toDF(*hashes, spans, items)
        out = docs.withColumns(hashes).join(before, [*hashes], "left").select(*docs.columns, F.lit(0).cast("long").alias(n_words), *(F.coalesce(c, F.array()).alias(c) for c in (spans, items)))
    else:
        out = docs.select("*", F.lit(0).cast("long").alias(n_words), F.array().cast("array<int>").alias(spans), F.array().cast("array<string>").alias(items))
    return out.mapInArrow(_scanner(spark.sparkContext.broadcast(group), *names), out.schema), *names


def _hash(i: int) -> Column:
    return F.xxhash64(F.lit(i), "text")


def _marks(docs: DataFrame, automata: list[bytes]) -> DataFrame:
    """What some automata find in the different texts, stored: KEY, spans, items."""
    sent = docs.sparkSession.sparkContext.broadcast(automata)
    texts = docs.where(F.col("text").isNotNull()).select(*(_hash(i).alias(k) for i, k in enumerate(KEY)), "text")
    found = texts.mapInArrow(_finder(sent), "h0 long, h1 long, spans array<int>, items array<string>").dropDuplicates(KEY)
    out = stored(found, "marks")
    sent.unpersist()
    return out


def _together(passes: list[DataFrame]) -> DataFrame:
    """The marks of all passes by text; broadcast where they are small."""
    marks = reduce(DataFrame.union, passes).groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    marks = stored(marks, "all-marks")
    bytes_ = marks.agg(F.sum(32 + 4 * F.size("spans") + F.octet_length(F.array_join("items", ",")))).first()[0] or 0
    return F.broadcast(marks) if bytes_ <= MOST_BROADCAST else marks


def marked_words(spans: str) -> Column:
    """The number of words in a flat array of spans."""
    return F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda s, x: s + x)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without the words that stand in benchmark windows; text and n_chars follow.

    A document with more than ``max_coverage`` of its words marked goes. Between other words a
    removed span leaves one line end. Documents without marks stay as they are, null texts
    included; an empty table or benchmark changes nothing.
    """
    found, n_words, spans, _ = mark_contamination(docs, benchmark, window)
    schema, names = docs.schema, docs.columns
    at, n = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {i: s for i, s in enumerate(batch.column(spans).to_pylist()) if s}
            columns = [batch.column(i) for i in range(len(names))]
            if rows:
                texts = columns[at].to_pylist()
                for i, flat in rows.items():
                    texts[i] = without_spans(texts[i], list(zip(flat[::2], flat[1::2], strict=True)))
                columns[at] = pa.array(texts, columns[at].type)
                if n is not None:
                    counts = columns[n].to_pylist()
                    for i in rows:
                        counts[i] = len(texts[i])
                    columns[n] = pa.array(counts, columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.where(marked_words(spans) <= max_coverage * F.col(n_words)).mapInArrow(cut, schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words; white space beside a cut becomes one line end."""
    data = text.encode()
    plain = np.frombuffer(data.translate(_WORD_BYTES), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    parts, begin = [], 0
    for a, b in spans:
        parts.append(data[begin : starts[a]])
        begin = ends[b - 1]
    parts.append(data[begin:])
    out = [parts[0].decode().rstrip(), *(p.decode().strip() for p in parts[1:-1]), parts[-1].decode().lstrip()]
    return "\n".join(x for x in out if x)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    found, n_words, spans, items = mark_contamination(docs, benchmark)
    hit, items = marked_words(spans).cast("long"), F.array_sort(F.array_distinct(F.array_compact(items)))
    return found.select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n,
  array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {WINDOW} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
