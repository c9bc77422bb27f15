"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a slice of documents of bounded size. Its words become symbols (the
benchmark's vocabulary; any other word is a separator), its suffixes are sorted,
and the Burrows-Wheeler transform is kept in a wavelet matrix. All test phrases
are then searched backwards at once, each step taking two wavelet ranks, and
their occurrences are located by walking to sampled suffix positions. Spans of
occurrences are merged per document. The phrases travel to the shards. Where
they are more than a block, each block has its own pass, and what it finds meets
the documents by their text; one block needs no shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

#: Consecutive item words in a window.
WINDOW = 10
#: Every so many positions of a shard keep their suffix position.
SAMPLE = 16
#: UTF-8 bytes of benchmark text that are searched for at once; more is searched for in blocks of about that size.
BLOCK_BYTES = 8 << 20


@dataclass
class Phrases:
    """The distinct windows of a benchmark, as symbols over its sorted vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; the symbol is the place plus one
    windows: np.ndarray  # (n, WINDOW) symbols, right-aligned, 0 before shorter ones
    lengths: np.ndarray
    item_starts: np.ndarray  # window -> items, as ranges of `items`
    items: np.ndarray
    names: list[str]  # item_id as text


def phrases_of(item_ids: list, texts: list, window: int = WINDOW) -> Phrases:
    """Windows of all items; items without words give none."""
    data, offsets = tk.buffer_of(pa.array(texts, pa.large_string()))
    data = tk.LOWER[data]
    starts, ends, first = tk.word_bounds(data, offsets, tk.ALNUM)
    hashes = tk.ranges_hash(data, starts, ends)
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    symbols = symbols.astype(np.int32) + 1
    n_words = np.diff(first)
    n_windows = np.where(n_words > 0, np.maximum(1, n_words - window + 1), 0)
    item = np.repeat(np.arange(len(texts)), n_windows)
    at = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    length = np.minimum(n_words[item], window)
    place = at[:, None] + np.arange(window) - (window - length)[:, None]
    rows = np.where(place >= at[:, None], symbols[np.clip(place, 0, max(0, len(symbols) - 1))], 0).astype(np.int32) if len(item) else np.zeros((0, window), np.int32)
    _, head, number = np.unique(rows.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True)
    owners = np.unique(number.astype(np.int64) * len(texts) + item) if len(item) else np.zeros(0, np.int64)
    return Phrases(
        vocabulary,
        rows[head],
        length[head],
        np.searchsorted(owners, np.arange(len(head) + 1) * max(1, len(texts))).astype(np.int64),
        owners % max(1, len(texts)),
        ["" if x is None else str(x) for x in item_ids],
    )


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of `text` (symbols; each 0 counts as a sign of its own, ordered by place, below all others).

    Prefix doubling; from round to round only suffixes that still share a rank are sorted again.
    """
    n = len(text)
    zero = text == 0
    rank = np.empty(n, np.int64)
    z = int(zero.sum())
    rank[zero] = np.arange(z)
    # rank of a group: the number of suffixes in smaller groups
    symbols = text[~zero]
    counts = np.bincount(symbols, minlength=int(symbols.max()) + 1 if len(symbols) else 1)
    before = z + np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank[~zero] = before[symbols]
    shared = counts > 1
    active = np.flatnonzero(~zero)
    active = active[shared[text[active]]]
    k = 1
    while len(active):
        after = active + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, rank[active])) if n > 1 << 30 else np.argsort(rank[active] * (n + 1) + second + 1, kind="stable")
        active, second = active[order], second[order]
        old = rank[active]
        new_group = np.empty(len(active), bool)
        new_group[0] = True
        new_group[1:] = (old[1:] != old[:-1]) | (second[1:] != second[:-1])
        new_old = np.empty(len(active), bool)
        new_old[0] = True
        new_old[1:] = old[1:] != old[:-1]
        place = np.arange(len(active))
        group_at = place[new_group][np.cumsum(new_group) - 1]
        old_at = place[new_old][np.cumsum(new_old) - 1]
        rank[active] = old + group_at - old_at
        alone = new_group & np.append(new_group[1:], True)
        active = active[~alone]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks and access over a sequence of symbols, vectorised over queries."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1 == 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros(len(at), np.int64)
        for ones, zeros, level in zip(self.levels, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = (symbol >> level) & 1 == 1
            n_low, n_at = ones[low], ones[at]
            low = np.where(one, zeros + n_low, low - n_low)
            at = np.where(one, zeros + n_at, at - n_at)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        low = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            n_low, n_at = ones[low], ones[at]
            one = ones[at + 1] > n_at
            symbol = symbol * 2 + one
            low = np.where(one, zeros + n_low, low - n_low)
            at = np.where(one, zeros + n_at, at - n_at)
        return symbol, at - low


class FMIndex:
    """FM-index of a sequence of symbols in which 0 separates; it has to end with 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        suffixes = suffix_array(text)
        self.n = len(text)
        before = text[suffixes - 1]
        self.wavelet = WaveletMatrix(before.astype(np.int64), symbols)
        counts = np.bincount(text, minlength=symbols)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        kept = (suffixes % sample == 0) | (before == 0)
        self.kept = kept
        self.kept_at = np.zeros(self.n + 1, np.int64)
        np.cumsum(kept, out=self.kept_at[1:])
        self.positions = suffixes[kept]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of right-aligned patterns (0 before shorter ones), by backward search."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), self.n, np.int64)
        live = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[live, k].astype(np.int64)
            live = live[symbol > 0]
            symbol = symbol[symbol > 0]
            low[live] = self.smaller[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to sampled ones."""
        rows = rows.copy()
        out = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            done = self.kept[at]
            out[live[done]] = self.positions[self.kept_at[at[done]]] + steps[live[done]]
            live = live[~done]
            symbol, rank = self.wavelet.access(rows[live])
            rows[live] = self.smaller[symbol] + rank
            steps[live] += 1
        return out


def shard_hits(column, phrases: Phrases) -> tuple[np.ndarray, ...]:
    """Occurrences in one shard: its bytes' word bounds, each row's first word, hit flags of words, and (row, window) pairs."""
    data, offsets = tk.buffer_of(column)
    data = tk.LOWER[data]
    starts, ends, first = tk.word_bounds(data, offsets, tk.ALNUM)
    n = len(starts)
    none = np.zeros(0, np.int64)
    hit = np.zeros(n, bool)
    if not n or not len(phrases.windows):
        return starts, ends, first, hit, none, none
    hashes = tk.ranges_hash(data, starts, ends)
    place = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    symbols = np.where(phrases.vocabulary[place] == hashes, place + 1, 0).astype(np.int32)
    # the text: a separator before each document, runs of other words as one separator, one at the end
    row_starts = first[:-1][np.diff(first) > 0]
    keep = symbols > 0
    lone = ~keep
    lone[1:] &= keep[:-1] 
    keep |= lone
    at = np.flatnonzero(keep)
    breaks = np.searchsorted(at, row_starts)
    text = np.insert(symbols[at], breaks, 0)
    words = np.insert(at, breaks, -1)
    text, words = np.append(text, 0), np.append(words, -1)
    # windows with a word that the shard hasn't can't occur
    present = np.zeros(len(phrases.vocabulary) + 1, bool)
    present[text] = present[0] = True
    possible = np.flatnonzero(present[phrases.windows].all(1))
    if not len(possible):
        return starts, ends, first, hit, none, none
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.windows[possible])
    some = np.flatnonzero(high > low)
    found, low, high = possible[some], low[some], high[some]
    if not len(found):
        return starts, ends, first, hit, none, none
    count = high - low
    window = np.repeat(found, count)
    rows = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    word = words[index.locate(rows)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + phrases.lengths[window], -1)
    hit = np.cumsum(edge[:-1]) > 0
    row = np.searchsorted(first, word, "right") - 1
    return starts, ends, first, hit, row, window


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The (item, text) rows of a benchmark in parts of about `block_bytes` of text; equal texts share a part."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // block_bytes))
    return [rows] if parts == 1 else [rows.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k) for k in range(parts)]


def _shared(block: DataFrame, window: int):
    """A block's phrases, broadcast: their size is that of a block."""
    table = block.toArrow()
    return block.sparkSession.sparkContext.broadcast(vars(phrases_of(table.column("i").to_pylist(), table.column("t").to_pylist(), window)))


def _searched(column, phrases: Phrases) -> tuple[np.ndarray, dict[int, list[str]]]:
    """Hit flags of the words of a slice, and the items of each row that has any."""
    _, _, _, hit, row, window_no = shard_hits(column, phrases)
    pairs = np.unique(row * np.int64(len(phrases.windows)) + window_no)
    owner, items = pairs // max(1, len(phrases.windows)), {}
    for doc in np.unique(owner).tolist():
        windows = pairs[np.searchsorted(owner, doc) : np.searchsorted(owner, doc, "right")] % len(phrases.windows)
        items[doc] = sorted({phrases.names[i] for w in windows.tolist() for i in phrases.items[phrases.item_starts[w] : phrases.item_starts[w + 1]].tolist()})
    return hit, items


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    step = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _found(batches, phrases: Phrases):
    """(key, runs, items) of the texts of (key, text) that have a hit."""
    for batch in tk.slices(batches, "t"):
        hit, items = _searched(batch.column(1), phrases)
        if items:
            data, offsets = tk.buffer_of(batch.column(1))
            _, _, first = tk.word_bounds(tk.LOWER[data], offsets, tk.ALNUM)
            runs = [np.stack(_runs(hit[first[d] : first[d + 1]]), 1).ravel().tolist() for d in items]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(list(items))), pa.array(runs, pa.list_(pa.int64())), pa.array(list(items.values()), pa.list_(pa.string()))], names=["key", "runs", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, clean: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with what of the benchmark occurs in each document, row by row.

    Adds n_words, n_hit, n_items, items_sha256, contaminated and spans (merged
    [start, end) code-point offsets of hit words, from the first to the last of
    a run). With `clean`, the text is returned without the spans.

    Null and empty texts have no words. Repeated rows are judged each for
    itself. Items of fewer words than a window are one window; items without
    words never occur; equal windows of several items count for each. An empty
    benchmark leaves everything clean, an empty table gives an empty one. Input
    columns of the added names are replaced; others may have any name. A
    benchmark may have any size, an item that of a block.
    """
    added = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()),
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    base = docs.drop(*[f.name for f in added if f.name != text])
    schema = T.StructType([*base.schema.fields, *added.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def judged(arrays: list, column, hit: np.ndarray, items: dict[int, list[str]]) -> pa.RecordBatch:
        data, offsets = tk.buffer_of(column)
        starts, ends, first = tk.word_bounds(tk.LOWER[data], offsets, tk.ALNUM)
        n = len(offsets) - 1
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[first[1:]] - total[first[:-1]]
        n_items, digests = np.zeros(n, np.int64), [hashlib.sha256(b"").hexdigest()] * n
        spans: list[list] = [[] for _ in range(n)]
        if items:
            chars, texts = tk.char_index(data), column.to_pylist() if clean else None
            for doc, names in items.items():
                n_items[doc] = len(names)
                digests[doc] = hashlib.sha256(",".join(names).encode()).hexdigest()
                a, b = _runs(hit[first[doc] : first[doc + 1]])
                zero = chars[offsets[doc]]
                found = list(zip((chars[starts[a + first[doc]]] - zero).tolist(), (chars[ends[b - 1 + first[doc]]] - zero).tolist(), strict=True))
                spans[doc] = [{"start": x, "end": y} for x, y in found]
                if clean:
                    texts[doc] = without(texts[doc], found)
            if clean:
                k = schema.names.index(text)
                arrays = [pa.array(texts, c.type) if i == k else c for i, c in enumerate(arrays)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items), pa.array(digests, pa.string()), pa.array(n_hit > 0), pa.array(spans, kind)], names=schema.names)

    blocks = _blocks(benchmark, item, item_text, block_bytes)
    shared = [_shared(block, window) for block in blocks]
    if len(blocks) == 1:

        def run(batches):
            phrases = Phrases(**shared[0].value)
            for batch in tk.slices(batches, text):
                column = batch.column(batch.schema.get_field_index(text))
                yield judged(batch.columns, column, *_searched(column, phrases))

        return base.mapInArrow(run, schema)

    key, runs_name, items_name = tk.fresh(base.columns, "key", "runs", "items")
    columns = [F.col(f"`{c}`") for c in base.columns]
    digest = F.sha2(F.col(f"`{text}`"), 256)
    texts = base.select(digest.alias("key"), F.col(f"`{text}`").alias("t"))
    parts = [texts.mapInArrow(lambda b, s=s: _found(b, Phrases(**s.value)), "key string, runs array<long>, items array<string>") for s in shared]
    # equal texts give equal rows, so a frequent text is one row before it is shuffled
    found = reduce(DataFrame.unionByName, parts).groupBy(F.col("key").alias(key)).agg(F.flatten(F.collect_set("runs")).alias(runs_name), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(items_name))
    joined = base.join(found, digest == F.col(key), "left").select(*columns, runs_name, items_name)

    def merge(batches):
        for batch in tk.slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = tk.buffer_of(column)
            _, _, first = tk.word_bounds(tk.LOWER[data], offsets, tk.ALNUM)
            edge, items = np.zeros(int(first[-1]) + 1, np.int64), {}
            for doc, (runs, names) in enumerate(zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if runs:
                    items[doc] = names
                    np.add.at(edge, first[doc] + np.array(runs[::2]), 1)
                    np.add.at(edge, first[doc] + np.array(runs[1::2]), -1)
            yield judged(batch.columns[:-2], column, np.cumsum(edge[:-1]) > 0, items)

    return joined.mapInArrow(merge, schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the given ascending code-point spans."""
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS ww
  FROM items, unnest(range(1, greatest(2, len(w) - 8))) AS u(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), lengths AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS ww
  FROM docs, lengths, unnest(range(1, greatest(1, len(w) - n + 2))) AS u(i)
), found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.ww = x.ww
), words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), unnest(range(i, i + n)) AS u(j) GROUP BY 1
), named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
