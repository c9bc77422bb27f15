"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most three bits differ in at most
three of their eight bytes, so they share at least five positional bytes. The
index posts each distinct fingerprint under three positional bytes at a time,
in two groups of four positions: with at most three bytes differing, one group
has at most one of them, so some posting of that group holds both. Posting
three bytes instead of one keeps lists short (a list of one byte holds 1/256
of all rows, and its pairs grow with the square of the input) and loses no
pair. Within a list, the postings of single positional bytes are tallied for
each pair, pairs reaching the guaranteed minimum of shared bytes are retained,
and those are verified, whatever the length of the list.

Copies fall together before the index is built. Long lists are cut into blocks
and handled a pair of blocks at a time, and only a spanning forest of their
links leaves a task. Components come from alternating star contractions.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .session import cut

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Posted triples of byte positions: all of each half.
TRIPLES = tuple([*combinations(range(4), 3), *combinations(range(4, 8), 3)])
#: Fingerprints of a posting list that a task holds at once; longer lists are cut into such blocks.
BLOCK = 8192
#: Fingerprints at most whose rows are named by a broadcast instead of a join.
FREQUENT = 10_000
#: Rows that a fingerprint has to have for that.
MANY = 100_000
#: Lists up to this length are compared by shifting the sorted postings, longer ones by search.
SHORT = 8


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text: a bit is set if it is in over half the shingle hashes; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - shingle].tolist()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", column: str = "fp") -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed 64-bit integer."""

    def run(batches):
        for batch in tk.slices(batches, text, 8 << 20):
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=[doc_id, column])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, {column} long")


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _block_links(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among `values` (distinct), found breadth first: what is reached is not compared again.

    The values are indexed by their positional bytes. Of each value reached, the
    postings of its bytes are tallied, values with the guaranteed minimum of
    shared bytes are retained, and only those are verified.
    """
    n = len(values)
    at_bytes = values.view(np.uint8).reshape(-1, 8)
    shared = int((at_bytes == at_bytes[0]).all(0).sum())  # bytes that the whole list shares
    index = []
    for p in np.flatnonzero((at_bytes != at_bytes[0]).any(0)).tolist():
        order = np.argsort(at_bytes[:, p], kind="stable")
        index.append((p, order, np.searchsorted(at_bytes[order, p], np.arange(257))))
    left, right = [], []
    waiting = np.ones(n, bool)
    for start in range(n):
        if not waiting[start]:
            continue
        waiting[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            postings = [order[edges[at_bytes[at, p]] : edges[at_bytes[at, p] + 1]] for p, order, edges in index]
            tally = np.bincount(np.concatenate(postings), minlength=n) if postings else np.zeros(n, np.int64)
            kept = np.flatnonzero((tally >= 8 - max_bits - shared) & waiting)
            found = kept[np.bitwise_count(values[kept] ^ values[at]) <= max_bits]
            if len(found):
                waiting[found] = False
                left.append(np.full(len(found), values[at]))
                right.append(values[found])
                queue.extend(found.tolist())
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def links_of_lists(keys: np.ndarray, values: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within posting lists; `keys` sorted, `values` distinct within a list."""
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edges, len(keys)))
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for shift in range(1, SHORT):
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & (size_of[shift:] <= SHORT))
        if not len(at):
            continue
        differing = values[at] ^ values[at + shift]
        # count filter: tally the shared positional bytes, keep pairs with the guaranteed minimum
        tally = (differing.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        at, differing = at[tally >= 8 - max_bits], differing[tally >= 8 - max_bits]
        at = at[np.bitwise_count(differing) <= max_bits]
        left.append(values[at])
        right.append(values[at + shift])
    for k in np.flatnonzero(sizes > SHORT).tolist():
        a, b = _block_links(values[edges[k] : edges[k] + sizes[k]], max_bits)
        left.append(a)
        right.append(b)
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b) with a > b: links whose components are those of all pairs of `distinct.fp` within max_bits bits."""
    spark = distinct.sparkSession
    postings = distinct.select(
        "fp",
        F.posexplode(F.array(*[sum(F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255)) * F.lit(1 << 8 * i) for i, p in enumerate(triple)) for triple in TRIPLES])).alias("triple", "bytes"),
    )
    postings = postings.select("fp", (F.col("bytes") * len(TRIPLES) + F.col("triple")).alias("key"))
    # lists of one hold no pair; the counts also say which lists are cut into blocks
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    listed = postings.join(sizes.select("key", "blocks"), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    listed = listed.withColumn("own", own).select(
        "fp", "key", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, F.col("own")) * F.col("blocks") + F.greatest(x, F.col("own")))).alias("pair")
    )

    def run(batches):
        held_keys, held = None, None  # the list that the last batch may have left open
        def flush(keys, values):
            a, b = links_of_lists(keys, values, max_bits)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            value = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if held_keys is not None:
                key, value = np.concatenate([held_keys, key]), np.concatenate([held, value])
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield flush(key[:last], value[:last])
            held_keys, held = key[last:], value[last:]
        if held_keys is not None:
            yield flush(held_keys, held)

    work = listed.select(F.xxhash64("key", "pair").alias("k"), "fp").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "fp")
    return work.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of `links` (a, b): root is the smallest node of the component.

    Alternates large-star and small-star contractions until nothing changes;
    each round is written to the checkpoint folder, so a lost executor costs
    one round at most.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: a node's smaller neighbours and itself go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id linked to it, itself included.

    Null and empty texts have fingerprint 0 and are linked like any other.
    Repeated rows give repeated rows. Null doc_ids take part, but name a
    component only if it has no other (then component_id is null). An empty
    table gives an empty one; other columns don't matter.
    """
    i = F.col(f"`{doc_id}`").alias("i")
    prints = cut(fingerprints(docs.select(i, F.col(f"`{text}`").alias("t")), text="t", doc_id="i"))
    first = prints.groupBy("fp").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    links = near_links(first.select("fp"))
    roots = components(links)
    named = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = cut(named.select("fp", "n", "root").join(least, "root").select("fp", "n", "component_id"))
    # a fingerprint of many rows would be one task's: the few with a share of them, FREQUENT at most, are broadcast
    many = F.col("n") >= max(MANY, prints.count() // FREQUENT)
    frequent = of_print.filter(many).select("fp", F.struct("component_id").alias("of"))
    told = prints.join(F.broadcast(frequent), "fp", "left")
    rest = told.filter("of IS NULL").select("i", "fp").join(of_print.filter(~many).select("fp", "component_id"), "fp")
    out = told.filter("of IS NOT NULL").select("i", "fp", "of.component_id").unionByName(rest)
    return out.select(F.col("i").alias(doc_id), "fp", "component_id")


def keep_first(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component: the one with the smallest doc_id (all rows that repeat it count as one).

    Null and empty texts are one component. Null doc_ids stay only where their
    component has no other. An empty table gives an empty one; other columns may
    have any name.
    """
    (kept_id,) = tk.fresh(docs.columns, "kept")
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    groups = near_duplicates(docs.select(i.alias("i"), t.alias("t")), text="t", doc_id="i")
    kept = groups.filter(F.col("i").eqNullSafe(F.col("component_id"))).select(F.col("i").alias(kept_id)).distinct()
    return docs.join(kept, i.eqNullSafe(F.col(kept_id)), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
