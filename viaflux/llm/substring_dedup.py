"""Substring dedup by hashing units of lines.

A text is cut into lines and each line into units at content-defined places: a
word starts a unit where the hash of it and its successor is the least among
its neighbours of the same line, so a passage set into another line is cut
there as it is elsewhere. Units and whole lines are normalised (words only, A-Z
lower-cased), hashed, and their digests grouped globally; the occurrence that
ranks earliest by (doc_id, place in the document) stays, and each later one
knows it. A unit alone may repeat by chance, so units go in runs: neighbours
whose first occurrences are neighbours as well. The ends of a run are moved
outwards over the words that equal those beside the first occurrence (CONTEXT
of them on either side), and the run goes if it has MIN_WORDS words or more, or
is whole lines of MIN_LINE_WORDS or more: a sequence of words that stands earlier
in the corpus, word for word. Lines are hashed as a whole too, and later
occurrences of an equal line go from MIN_LINE_WORDS words on or, as the queries
have it, at any length. Removed spans keep their offsets in the original text.

A frequent digest sends one row from each task to the global grouping; its other
rows wait under a key of their own task and learn the first occurrence from that
row. The words around first occurrences are fetched only for ends that may move,
of runs that can reach the least length. Nothing depends on how rows are dealt
to tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk

#: Neighbours on each side that a unit's first word is compared with.
REACH = 2
#: Words of a run of repeated units that is removed wherever it stands.
MIN_WORDS = 20
#: Words of whole lines that are removed if they stand earlier, as lines or inside one.
MIN_LINE_WORDS = 8
#: Words beside a first occurrence that the end of a run is compared with, by 32 bits of their hashes.
CONTEXT = 16
#: A unit is known by a byte of the hash of so many words on either side: where it differs, fewer of them are equal.
NEAR = 6
#: A unit's words as far as its hint counts them; one of so many may have more.
MOST = 127
#: Added to a line's number to tell it from a unit's.
LINE = -(1 << 31) + 1
#: The seq of a row that tells a task's waiting rows the first occurrence.
TELLS = -(1 << 31)
#: Occurrences in a slice that make a digest worth remembering for the rest of a task, and how many are.
HOT, MAX_HOT = 8, 1 << 16


class Units:
    """The units of the texts of one slice."""

    def __init__(self, column):
        self.data, self.offsets = data, offsets = tk.buffer_of(column)
        self.starts, self.ends, self.first = tk.word_bounds(tk.LOWER[data], offsets, tk.ALNUM)
        n = len(self.starts)
        self.newlines = np.flatnonzero(data == 10)
        row = tk.rows_of(self.first, n)
        line = np.searchsorted(self.newlines, self.starts) + row  # grows at each newline and each row
        self.line_start = np.ones(n, bool)
        self.line_start[1:] = line[1:] != line[:-1]
        self.row, self.line = row, line
        self.words = words = tk.ranges_hash(tk.LOWER[data], self.starts, self.ends)
        pair = words * np.uint64(3)
        if n:
            same = line[1:] == line[:-1]
            pair[:-1] += np.where(same, words[1:], np.uint64(0))
        pair = tk.mix(pair)
        begins = np.ones(n, bool)
        for k in range(1, min(REACH, n - 1) + 1):
            same = line[k:] == line[:-k]
            begins[k:] &= ~same | (pair[k:] < pair[:-k])
            begins[:-k] &= ~same | (pair[:-k] <= pair[k:])
        begins |= self.line_start
        self.begin = np.flatnonzero(begins)  # first word of each unit
        self.end = np.append(self.begin[1:], n)[: len(self.begin)]
        self.digest = tk.ranges_hash(words, self.begin, self.end) if n else np.zeros(0, np.uint64)
        self.unit_row = row[self.begin]
        self.first_unit = np.searchsorted(self.begin, self.first)
        self.seq = np.arange(len(self.begin)) - self.first_unit[self.unit_row]

    def hints(self) -> np.ndarray:
        """What tells how far a run that ends with a unit can grow, 12 bits for either side and 7 for its words (MOST at most).

        Of the words after it (from bit 0 on) and before it (from bit 8 on): a
        byte of the NEAR nearest, 0 where the row has fewer; two bits each (from
        16 and 18 on) of the way to the line's end: 0 none, 1 fewer than NEAR
        words, 2 up to CONTEXT, 3 more; two bits (from 20 and 22 on) of the
        nearest word.
        """
        if not len(self.begin):
            return np.zeros(0, np.int32)
        out = np.minimum(self.end - self.begin, MOST).astype(np.int32) << 24
        first, last = self.first[self.unit_row], self.first[self.unit_row + 1]
        heads = np.append(np.flatnonzero(self.line_start), len(self.words))
        back = self.begin - heads[np.searchsorted(heads, self.begin, "right") - 1]
        ahead = heads[np.searchsorted(heads, self.end)] - self.end
        sides = ((1, self.begin - NEAR, self.begin, self.begin - 1, back), (0, self.end, self.end + NEAR, self.end, ahead))
        for side, low, high, next_word, way in sides:
            at = np.flatnonzero((low >= first) & (high <= last))
            mark = (tk.ranges_hash(self.words, low[at], high[at]) >> np.uint64(56)).astype(np.int32)
            out[at] |= np.maximum(mark, 1) << (8 * side)
            out |= np.digitize(way, [1, NEAR, CONTEXT + 1]).astype(np.int32) << (16 + 2 * side)
            at = np.flatnonzero((next_word >= first) & (next_word < last))
            out[at] |= (self.words[next_word[at]] >> np.uint64(62)).astype(np.int32) << (20 + 2 * side)
        return out

    def beside(self, at: np.ndarray, row: np.ndarray, step: int) -> np.ndarray:
        """32 bits of the hashes of the CONTEXT words before (step -1) or from (step 1) the word places `at`, the nearest first; 0 beyond the row."""
        first, last = self.first[row], self.first[row + 1]
        places = (at + (step < 0) * step)[:, None] + step * np.arange(CONTEXT)
        inside = (places >= first[:, None]) & (places < last[:, None])
        return np.where(inside, self.words[np.clip(places, 0, max(0, len(self.words) - 1))], np.uint64(0)).astype(np.uint32)

    def found(self, row: np.ndarray, seq: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units that (row, seq) name, and whether they are there with that digest."""
        at = self.first_unit[row] + seq
        fits = (seq >= 0) & (at < self.first_unit[row + 1])
        at = np.where(fits, at, 0)
        if len(self.digest):
            fits &= self.digest[at] == digest
        return at, fits

    def lines(self) -> Lines:
        """The lines that have more than white space; a line without words is known by its other bytes."""
        data, offsets = self.data, self.offsets
        starts = np.union1d(offsets[:-1][offsets[:-1] < offsets[1:]], self.newlines + 1)
        starts = starts[starts < len(data)]
        row = np.searchsorted(offsets, starts, "right") - 1
        k = np.searchsorted(self.newlines, starts)
        ends = np.append(self.newlines, len(data))[k]
        ends = np.minimum(ends, offsets[row + 1])
        solid = np.zeros(len(data) + 1, np.int64)
        np.cumsum(tk.NON_SPACE[data], out=solid[1:])
        some = solid[ends] > solid[starts]
        starts, ends, row = starts[some], ends[some], row[some]
        a, b = np.searchsorted(self.starts, starts), np.searchsorted(self.starts, ends)
        digest = tk.mix(tk.ranges_hash(self.words, a, b) ^ np.uint64(0x5851F42D4C957F2D))
        bare = np.flatnonzero(a == b)
        if len(bare):
            digest[bare] = tk.mix(tk.ranges_hash(data[tk.NON_SPACE[data]], solid[starts[bare]], solid[ends[bare]]) ^ np.uint64(0x14057B7EF767814F))
        first = np.searchsorted(row, np.arange(len(offsets)))
        return Lines(starts, ends, row, digest, first, b - a)


@dataclass
class Lines:
    """Lines by their bytes [start, end), their rows, digests and numbers of words, and each row's first."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    digest: np.ndarray
    first: np.ndarray
    words: np.ndarray


def _same(a, b) -> np.ndarray:
    """Equality of two Arrow arrays, nulls equal to each other."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def _waiting_key(digest: np.ndarray, group: np.ndarray) -> np.ndarray:
    return tk.mix(digest ^ tk.mix(group.astype(np.uint64)))


def _candidates(batches, text: str, min_line_words: int):
    """(k, doc, seq, digest, group, hint) of all units and of lines of so many words or more.

    A row without a digest is a candidate and k is its digest; its group, if it
    has one, is what later occurrences in this task wait under. Those have
    their digest, that group and a k that spreads them.
    """
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    hot: dict[int, tuple] = {}
    for number, batch in enumerate(tk.slices(batches, text)):
        units = Units(batch.column(1))
        digests, rows, seqs, hints = units.digest, units.unit_row, units.seq, units.hints()
        lines = units.lines()
        at = np.flatnonzero(lines.words >= min_line_words)
        digests, rows = np.concatenate([digests, lines.digest[at]]), np.concatenate([rows, lines.row[at]])
        seqs = np.concatenate([seqs, at - lines.first[lines.row[at]] + LINE])
        hints = np.concatenate([hints, np.zeros(len(at), np.int32)])
        n = len(digests)
        if not n:
            continue
        docs = batch.column(0)
        rank = pc.rank(docs, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()[rows].astype(np.int64)
        order = np.lexsort((seqs, rank, digests))
        digest, place = digests[order], rank[order] * (1 << 32) + seqs[order]
        head = np.flatnonzero(np.append(True, digest[1:] != digest[:-1]))
        sizes = np.diff(np.append(head, n))
        repeat = place > np.repeat(place[head], sizes)
        own = np.int64(part << 32 | number)
        group = np.full(n, own)
        for k in np.flatnonzero(np.add.reduceat(repeat, head) >= HOT).tolist():
            at = order[head[k]]
            doc = docs[int(rows[at])].as_py()
            here = (doc is not None, doc, int(seqs[at]))
            before = hot.get(int(digest[head[k]]))
            if before is not None and before[0] < here:  # all of them are later than what an earlier slice has sent
                span = slice(head[k], head[k] + sizes[k])
                repeat[span], group[span] = True, before[1]
            elif before is not None or len(hot) < MAX_HOT:
                hot[int(digest[head[k]])] = (here, own)
        told = np.repeat(np.logical_or.reduceat(repeat, head), sizes)  # the digest has rows that wait
        sent = np.zeros(n, bool)
        sent[head] = ~repeat[head]
        has_group = repeat | (told & sent)
        spread = tk.mix(digest ^ tk.mix(np.arange(n, dtype=np.uint64) + np.uint64(own)))
        key = np.where(repeat, spread, digest)
        arrays = [
            pa.array(key.view(np.int64)), docs.take(pa.array(rows[order])), pa.array(seqs[order].astype(np.int32)),
            pa.array(digest.view(np.int64), mask=~repeat), pa.array(group, mask=~has_group), pa.array(hints[order]),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["k", "doc", "seq", "digest", "group", "hint"])


#: What `_firsts` gives: k, doc, seq, digest, hint and the first occurrence's fdoc, fseq, fhint.
_MET = ["k", "doc", "seq", "digest", "hint", "fdoc", "fseq", "fhint"]


def _firsts(batches, waiting: bool):
    """Of candidates sorted by (k, doc, seq): those after the first, with the first.

    With `waiting` instead rows that tell a group's first, and the rows that wait for them.
    """
    held = None  # the first occurrence of the digest that the last batch ended with
    for batch in batches:
        waits = pc.is_valid(batch.column(3))
        found = batch.filter(waits)
        if waiting and found.num_rows:
            key = _waiting_key(found.column(3).to_numpy().view(np.uint64), found.column(4).to_numpy())
            none = pa.nulls(found.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), found.column(1), found.column(2), found.column(3), found.column(5), pa.nulls(found.num_rows, found.column(1).type), none, none], names=_MET)
        batch = batch.filter(pc.invert(waits))
        kept = held.num_rows if held is not None else 0
        if held is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns, strict=True)], schema=batch.schema)
        if not batch.num_rows:
            continue
        digest = batch.column(0).to_numpy()
        head = np.flatnonzero(np.append(True, digest[1:] != digest[:-1]))
        held = batch.slice(int(head[-1]), 1)
        head_of = np.repeat(head, np.diff(np.append(head, len(digest))))
        fresh = np.arange(len(digest)) >= kept  # not the held row, which has been through this
        at = np.flatnonzero(fresh & pc.is_valid(batch.column(4)).to_numpy(zero_copy_only=False))
        if waiting and len(at):
            first = batch.take(pa.array(head_of[at]))
            key = _waiting_key(digest[at].view(np.uint64), batch.column(4).take(pa.array(at)).to_numpy())
            arrays = [pa.array(key.view(np.int64)), first.column(1), pa.array(np.full(len(at), TELLS, np.int32)), pa.array(digest[at]), first.column(5), first.column(1), first.column(2), first.column(5)]
            yield pa.RecordBatch.from_arrays(arrays, names=_MET)
        later = np.flatnonzero(fresh & (head_of != np.arange(len(digest))))
        if waiting or not len(later):
            continue
        own, first = batch.take(pa.array(later)), batch.take(pa.array(head_of[later]))
        other = pa.array(~(_same(own.column(1), first.column(1)) & _same(own.column(2), first.column(2))))
        arrays = [own.column(0), own.column(1), own.column(2), own.column(0), own.column(5), first.column(1), first.column(2), first.column(5)]
        yield pa.RecordBatch.from_arrays(arrays, names=_MET).filter(other)


def _settled(batches):
    """Rows that wait, with the first occurrence, from what `_firsts` gives sorted by (k, seq): they take what the row before them tells."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]) for a, b in zip(held.columns, batch.columns, strict=True)], schema=batch.schema)
        if not batch.num_rows:
            continue
        seq = batch.column(2).to_numpy()
        tells = seq == TELLS
        last = np.maximum.accumulate(np.where(tells, np.arange(len(seq)), -1))
        held = batch.slice(int(last[-1]), 1) if last[-1] >= 0 else None
        rows = np.flatnonzero(~tells)
        own, first = batch.take(pa.array(rows)), batch.take(pa.array(last[rows]))
        yield pa.RecordBatch.from_arrays([*own.columns[:5], *first.columns[5:]], names=_MET)


def _contexts(batches, text: str):
    """(ask, words): the hashes of the words beside asked units, from documents whose last column lists (seq, digest, side, ask)."""
    for batch in tk.slices(batches, text):
        units = Units(batch.column(batch.schema.get_field_index(text)))
        asked = batch.column(batch.num_columns - 1)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        seq, digest, side, ask = asked.flatten().flatten()
        at, fits = units.found(row, seq.to_numpy(), digest.to_numpy().view(np.uint64))
        at, row, side, ask = at[fits], row[fits], side.to_numpy()[fits], ask.to_numpy()[fits]
        for step, places in ((-1, units.begin), (1, units.end)):
            mine = side == step
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array(ask[mine]), _packed(units.beside(places[at[mine]], row[mine], step))], names=["ask", "words"])


def _packed(hashes: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    n, width = hashes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (hashes.itemsize * width)).tobytes()), pa.py_buffer(np.ascontiguousarray(hashes).tobytes())])


def _equal_words(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The number of equal words in each row, counted from the nearest; 0 is no word."""
    differ = (own != other) | (own == 0)
    return np.where(differ.any(1), differ.argmax(1), CONTEXT)


def removed_spans(units: Units, lines: Lines, row: np.ndarray, flags: list[np.ndarray], min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of a slice that go, ascending and apart.

    `flags` has for each entry seq, digest, opens (a run begins), side and, as
    (n, CONTEXT) hashes, the words beside the first occurrence. side 0 marks a
    repeat, -1 and 1 tell the words before and after a unit's first occurrence.
    """
    seq, digest, opens, side, words = flags
    at, fits = units.found(row, seq, digest)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    repeats = np.flatnonzero(fits & (side == 0))
    if len(repeats):
        order = repeats[np.lexsort((~opens[repeats], at[repeats]))]
        unit = at[order]
        once = np.append(True, unit[1:] != unit[:-1])
        unit, open_ = unit[once], opens[order][once]
        breaks = np.append(True, (unit[1:] != unit[:-1] + 1) | open_[1:] | (units.unit_row[unit[1:]] != units.unit_row[unit[:-1]]))
        first = np.flatnonzero(breaks)
        head, tail = unit[first], unit[np.append(first[1:], len(unit)) - 1]
        begin, end, of_row = units.begin[head], units.end[tail], units.unit_row[head]
        for step, ends_of, places in ((-1, head, begin), (1, tail, end)):
            told = np.flatnonzero(fits & (side == step))
            if not len(told):
                continue
            told = told[np.lexsort((*words[told].T[::-1], at[told]))]  # of several answers the least
            told = told[np.append(True, at[told][1:] != at[told][:-1])]
            k = np.minimum(np.searchsorted(at[told], ends_of), len(told) - 1)
            more = np.where(at[told][k] == ends_of, _equal_words(units.beside(places, of_row, step), words[told[k]]), 0)
            if step < 0:
                begin = begin - more
            else:
                end = end + more
        last_word = units.first[of_row + 1]
        to_line_end = (end == last_word) | units.line_start[np.minimum(end, len(units.words) - 1)]
        whole = units.line_start[begin] & to_line_end
        goes = (end - begin >= min_words) | (whole & (end - begin >= min_line_words))
        begin, end, of_row, to_line_end, whole, last_word = (x[goes] for x in (begin, end, of_row, to_line_end, whole, last_word))
        size = units.offsets[of_row + 1]
        k = np.searchsorted(units.newlines, units.ends[end - 1])
        line_end = np.minimum(np.append(units.newlines, len(units.data))[k], size)
        line_end = np.where(whole, np.minimum(line_end + 1, size), line_end)
        starts.append(units.starts[begin])
        ends.append(np.where(to_line_end, line_end, units.starts[np.minimum(end, len(units.words) - 1)]))
    k = lines.first[row] + (seq - LINE)
    mine = (seq < 0) & (side == 0) & (k < lines.first[row + 1])
    k = np.unique(k[mine][lines.digest[k[mine]] == digest[mine]])
    starts.append(lines.starts[k])
    ends.append(np.minimum(lines.ends[k] + 1, units.offsets[lines.row[k] + 1]))
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((end, start))
    start, end = start[order], end[order]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    # ranges of two rows don't join, though the rows' bytes meet
    of_row = np.searchsorted(units.offsets, start, "right")
    new = np.append(True, (start[1:] > reach[:-1]) | (of_row[1:] != of_row[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def _key(column: str, kind: T.DataType) -> list:
    """Two columns that are equal where `column` is, nulls too; a null-safe join compares the same."""
    c = F.col(f"`{column}`")
    filled = F.coalesce(c, F.lit(0).cast(kind)) if isinstance(kind, T.NumericType) else F.coalesce(c.cast("string"), F.lit(""))
    return [filled, F.isnull(c)]


def repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """The later occurrences of units (seq from 0) and lines (seq below 0), each with its first.

    doc and no_doc are the key of the document, fdoc and no_fdoc that of the
    first occurrence's, seq and fseq the places. words counts a unit's; back and
    ahead tell how many words before and after it may be equal at most, to_start
    and to_end whether all of its line may be.
    """
    kind = docs.schema[doc_id].dataType
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    field = lambda n, k: T.StructField(n, k)
    candidate = T.StructType([field("k", T.LongType()), field("doc", kind), field("seq", T.IntegerType()), field("digest", T.LongType()), field("group", T.LongType()), field("hint", T.IntegerType())])
    met = T.StructType([*[candidate[n] for n in ("k", "doc", "seq", "digest", "hint")], field("fdoc", kind), field("fseq", T.IntegerType()), field("fhint", T.IntegerType())])
    found = docs.select(doc_id, text).mapInArrow(lambda b: _candidates(b, text, min_line_words), candidate)
    dealt = found.repartition(partitions, "k").sortWithinPartitions("k", "doc", "seq")
    waiting = dealt.mapInArrow(lambda b: _firsts(b, True), met).repartition(partitions, "k").sortWithinPartitions("k", "seq").mapInArrow(_settled, met)
    out = dealt.mapInArrow(lambda b: _firsts(b, False), met).unionByName(waiting)
    (doc, no_doc), (fdoc, no_fdoc) = _key("doc", kind), _key("fdoc", kind)
    bits = lambda c, by, mask: F.shiftright(c, by).bitwiseAND(F.lit(mask))
    words = F.when(bits("hint", 24, 127) == MOST, F.lit(1 << 20)).otherwise(bits("hint", 24, 127))

    def side(k):
        """The most words that may be equal on a side, and whether those up to the line's end may."""
        alike = (bits("hint", 8 * k, 255) != 0) & (bits("hint", 8 * k, 255) == bits("fhint", 8 * k, 255))
        most = F.when(bits("hint", 20 + 2 * k, 3) != bits("fhint", 20 + 2 * k, 3), F.lit(0)).when(alike, F.lit(CONTEXT)).otherwise(F.lit(NEAR - 1))
        way = bits("hint", 16 + 2 * k, 3)
        return most, (way == 0) | ((way == 1) & (most > 0)) | ((way == 2) & (most == CONTEXT))

    (back, to_start), (ahead, to_end) = side(1), side(0)
    return out.select(doc.alias("doc"), no_doc.alias("no_doc"), "seq", "digest", words.alias("words"), back.alias("back"), ahead.alias("ahead"), to_start.alias("to_start"), to_end.alias("to_end"), fdoc.alias("fdoc"), no_fdoc.alias("no_fdoc"), "fseq")


def _runs(found: DataFrame, least: int, least_line: int) -> DataFrame:
    """Repeats by runs: opens and closes mark their ends; left out are runs of units that can't have `least` words nor be whole lines of `least_line`."""
    key = ["doc", "no_doc"]
    of_doc = Window.partitionBy(*key).orderBy("seq", "digest")
    before = lambda c: F.lag(c).over(of_doc)
    follows = (before("fdoc") == F.col("fdoc")) & (before("no_fdoc") == F.col("no_fdoc")) & (before("seq") == F.col("seq") - 1) & (before("fseq") == F.col("fseq") - 1)
    rows = found.withColumn("opens", ~F.coalesce(follows, F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("opens").cast("int")).over(of_doc)).withColumn("closes", F.coalesce(F.lead("opens").over(of_doc), F.lit(True)))
    of_run = Window.partitionBy(*key, "run")
    at = lambda end, value: F.max(F.when(F.col(end), F.col(value))).over(of_run)
    rows = rows.withColumn("most", F.sum("words").over(of_run) + at("opens", "back") + at("closes", "ahead")).withColumn("lines", at("opens", "to_start") & at("closes", "to_end"))
    return rows.filter((F.col("most") >= least) | (F.col("lines") & (F.col("most") >= least_line)) | (F.col("seq") < 0))


def dedup_substrings(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", whole_lines: bool = False, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """`docs` without repeated substrings: `text` loses them, `removed` has their spans in the original.

    Runs of `min_words` words that stand earlier, word for word, go wherever
    they are, and whole lines from `min_line_words` words on, if they equal an
    earlier line or a run inside one. `whole_lines` removes equal lines of any length
    (those without words: equal in all that isn't white space). Other parts of
    fewer than `min_words` words stay.
    Adds removed (array of [start, end) code-point offsets in the original
    text) and n_units. Null texts stay null and empty ones empty. Rows that
    repeat a doc_id with the same text are the same document: none of them
    counts as the other's repeat. Null doc_ids rank first. Of equal units the
    one of the smallest doc_id stays, then the first in the text. An empty
    table gives an empty one. Input columns of the added names are replaced;
    others may have any name. A text is worked on as a whole, with about 60
    bytes of memory for each of its bytes.
    """
    base = docs.drop("removed", "n_units")
    flags_name, asked_name, id_name, no_id = tk.fresh(base.columns, "flags", "asked", "id", "no_id")
    key, kind = ["doc", "no_doc"], base.schema[doc_id].dataType
    runs = _runs(repeats(base, text=text, doc_id=doc_id, min_line_words=0 if whole_lines else min_line_words), min_words, min_line_words)
    sides = F.array_compact(F.array(F.when(F.col("opens") & (F.col("back") > 0), F.lit(-1)), F.when(F.col("closes") & (F.col("ahead") > 0), F.lit(1))))
    ends = runs.filter("seq >= 0").select(*key, "seq", "digest", "fdoc", "no_fdoc", "fseq", F.explode(sides).alias("side")).withColumn("ask", F.xxhash64("digest", "side"))
    asked = ends.groupBy(F.col("fdoc").alias(id_name), F.col("no_fdoc").alias(no_id)).agg(F.collect_set(F.struct(F.col("fseq").alias("seq"), "digest", "side", "ask")).alias(asked_name))
    columns = [F.col(f"`{c}`") for c in base.columns]
    # documents meet the questions and the answers by one key, so that they are shuffled once
    own = _key(doc_id, kind)
    on = (own[0] == F.col(id_name)) & (own[1] == F.col(no_id))
    told = base.join(asked, on).select(*columns, asked_name).mapInArrow(lambda b: _contexts(b, text), "ask long, words binary")
    answers = ends.select(*key, "seq", "digest", "side", "ask").join(told, "ask")
    answers = answers.groupBy(F.col("doc").alias(id_name), F.col("no_doc").alias(no_id)).agg(F.collect_list(F.struct("seq", "digest", F.lit(False).alias("opens"), "side", "words")).alias(asked_name))
    none = F.lit(None).cast("binary").alias("words")
    flags = runs.groupBy(F.col("doc").alias(id_name), F.col("no_doc").alias(no_id)).agg(F.collect_list(F.struct("seq", "digest", "opens", F.lit(0).alias("side"), none)).alias(flags_name))
    entries = F.when(F.col(asked_name).isNull(), F.col(flags_name)).otherwise(F.concat(flags_name, asked_name))
    joined = base.join(flags, on, "left").drop(id_name, no_id).join(answers, on, "left").select(*columns, entries.alias(flags_name))
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*base.schema.fields, T.StructField("removed", spans), T.StructField("n_units", T.LongType())])

    def apply(batches):
        for batch in tk.slices(batches, text):
            k = batch.schema.get_field_index(text)
            units = Units(batch.column(k))
            texts = batch.column(k)
            removed = pa.array([[]] * batch.num_rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            flagged = batch.column(batch.num_columns - 1)
            entries = flagged.flatten()
            if len(entries):
                row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(flagged), 0).to_numpy(zero_copy_only=False))
                seq, digest, opens, side, words = entries.flatten()
                beside = np.zeros((len(entries), CONTEXT), np.uint32)
                has = np.flatnonzero(pc.is_valid(words).to_numpy(zero_copy_only=False))
                beside[has] = np.frombuffer(b"".join(words.take(pa.array(has)).to_pylist()), np.uint32).reshape(-1, CONTEXT)
                parts = [seq.to_numpy().astype(np.int64), digest.to_numpy().view(np.uint64), opens.to_numpy(zero_copy_only=False).astype(bool), side.to_numpy(), beside]
                start, end = removed_spans(units, units.lines(), row, parts, min_words, min_line_words)
                texts, removed = _without(units, texts, start, end)
            arrays = [texts if i == k else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, removed, pa.array(np.diff(units.first_unit), pa.int64())], names=schema.names)

    return joined.mapInArrow(apply, schema)


def _without(units: Units, texts, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Texts without the byte ranges, and the ranges of each as code points."""
    stays = np.zeros(len(units.data) + 1, np.int64)
    np.add.at(stays, start, 1)
    np.add.at(stays, end, -1)
    stays = np.cumsum(stays[:-1]) == 0
    left = np.zeros(len(units.data) + 1, np.int64)
    np.cumsum(stays, out=left[1:])
    offsets = left[units.offsets]
    valid = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    out = pa.Array.from_buffers(pa.large_string(), len(texts), [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(units.data[stays].tobytes())]).cast(texts.type)
    chars = tk.char_index(units.data)
    row = np.searchsorted(units.offsets, start, "right") - 1
    zero = chars[units.offsets[row]]
    spans = pa.StructArray.from_arrays([pa.array(chars[start] - zero), pa.array(chars[end] - zero)], ["start", "end"])
    return out, pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), spans)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, whole_lines=True).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "removed", "n_units")
