"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton over the vocabulary's bytes enumerates, at each
place, the pieces that end there, longest first; dynamic programming carries
the best score and its number of pieces. Ties are the tokenizer's: the longer
piece (the earlier start) stays unless a later one scores strictly more, and a
character that is no piece by itself may be taken as unknown at the lowest
score less 10. Unknown characters cost a piece for each byte where the
vocabulary falls back to bytes, else runs of them are one piece.

Texts are cut where no piece can span: before a run of spaces that follows
another character, and around characters that occur in no piece. Each distinct
part of a slice is scored once, short ones all at the same time, one byte after
the other, and long ones each by itself in time and memory that follow their
length. A model's normaliser, where it has one, is applied first.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import textkit as tk

UNKNOWN_PENALTY = 10.0
#: The sign that stands for a space in pieces.
MARK = "▁"
#: Parts scored at the same time are bounded by their bytes.
CHUNK_BYTES = 4 << 20
#: Parts of more bytes are scored by themselves.
LONG_BYTES = 2048


class Vocabulary:
    """Pieces with scores; `byte_fallback` tells whether unknown characters become bytes.

    `normaliser` is a SentencePiece model whose normaliser texts go through;
    without one they stay, but for a space before those that aren't empty
    (`dummy_prefix`).
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True, dummy_prefix: bool = True, normaliser: bytes | None = None):
        self.pieces = dict(pieces[::-1])  # of equal pieces the first counts
        self.byte_fallback, self.dummy_prefix, self.normaliser = byte_fallback, dummy_prefix, normaliser

    @staticmethod
    def from_sentencepiece(path: str, byte_fallback: bool = True) -> Vocabulary:
        """The normal and user-defined pieces of a SentencePiece model file, with the file's scores."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            model = f.read()
        probe = "  a\tﬁ①  é\u3000b\r\n "
        same = sentencepiece.SentencePieceNormalizer(model_proto=model).normalize(probe) == MARK + probe.replace(" ", MARK)
        ids = [i for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        return Vocabulary([(p.id_to_piece(i), p.get_score(i)) for i in ids], byte_fallback, same, None if same else model)


class Counter:
    """A vocabulary compiled to an automaton over bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.byte_fallback, self.dummy_prefix, self.normaliser = vocabulary.byte_fallback, vocabulary.dummy_prefix, None
        if vocabulary.normaliser:
            import sentencepiece

            self.normaliser = sentencepiece.SentencePieceNormalizer(model_proto=vocabulary.normaliser)
        self.texts = {k.replace(MARK, " "): v for k, v in vocabulary.pieces.items() if k}
        self.automaton = None
        pieces = {k.replace(MARK, " ").encode(): v for k, v in vocabulary.pieces.items() if k}
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        children: list[dict[int, int]] = [{}]
        length, score = [0], [0.0]
        for piece, value in pieces.items():
            at = 0
            for byte in piece:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    length.append(0)
                    score.append(0.0)
                at = children[at][byte]
            length[at], score[at] = len(piece), value
        n = len(children)
        used = sorted({b for c in children for b in c})
        self.klass = np.zeros(256, np.int64)  # bytes of no piece share class 0, which leads to the root
        self.klass[used] = np.arange(1, len(used) + 1)
        step = np.zeros((n, len(used) + 1), np.int32)
        fail, up = np.zeros(n, np.int64), np.zeros(n, np.int32)  # up: the next shorter piece that ends at a state
        queue = deque()
        for byte, child in children[0].items():
            step[0, self.klass[byte]] = child
            queue.append(child)
        while queue:
            at = queue.popleft()
            step[at] = step[fail[at]]
            for byte, child in children[at].items():
                fail[child] = step[fail[at], self.klass[byte]]
                step[at, self.klass[byte]] = child
                queue.append(child)
            f = fail[at]
            up[at] = f if length[f] else up[f]
        self.step, self.up = step, up
        self.length, self.score = np.array(length, np.int32), np.array(score)
        text = "".join(k.replace(MARK, " ") for k in vocabulary.pieces)
        self.spanned = np.zeros(128, bool)  # ASCII characters that occur in a piece
        self.spanned[[ord(c) for c in set(text) if ord(c) < 128]] = True
        # a run of unknown characters must not be cut either: with bytes it doesn't matter, else a space has to be known
        self.breaks_at_space = (self.byte_fallback or b" " in pieces) and not any(" " in k.replace(MARK, " ").lstrip(" ") for k in vocabulary.pieces)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the parts of all rows (each is scored by itself) and each row's first."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            if self.breaks_at_space:
                space = data == 32
                cut[1:-1] |= space[1:] & ~space[:-1]
            if self.byte_fallback:  # runs of unknown characters don't merge, so each may stand alone
                alone = (data < 128) & ~self.spanned[np.minimum(data, 127)]
                cut[:-1] |= alone
                cut[1:] |= alone
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, offsets)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of the best path of each part (one byte or more, whole characters)."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64)
        sizes = ends - starts
        if (sizes > LONG_BYTES).any():
            out, short = np.zeros(n, np.int64), sizes <= LONG_BYTES
            out[short] = self.count(data, starts[short], ends[short])
            for k in np.flatnonzero(~short).tolist():
                out[k] = self.count_long(data[starts[k] : ends[k]].tobytes().decode())
            return out
        order = np.argsort(-sizes, kind="stable")
        first, size = starts[order], sizes[order]
        longest = int(size[0])
        live = np.searchsorted(-size, -np.arange(longest + 2), "right")  # parts of so many bytes or more
        at = np.cumsum(np.append(0, size + 1))  # where a part's states begin
        best, pieces = np.zeros(int(at[-1])), np.zeros(int(at[-1]), np.int64)
        unknown_last = np.zeros(int(at[-1]), bool)
        at = at[:-1]
        state = np.zeros(n, np.int32)
        head = np.zeros(n, np.int64)  # where the character that holds the byte starts
        for t in range(longest):
            m = int(live[t + 1])
            byte = data[first[:m] + t]
            state[:m] = self.step[state[:m], self.klass[byte]]
            starting = (byte & 0xC0) != 0x80
            head[:m][starting] = t
            last = np.ones(m, bool)  # the byte ends its character
            going = int(live[t + 2])
            last[:going] = (data[first[:going] + t + 1] & 0xC0) != 0x80
            here = np.flatnonzero(last)
            to = at[here] + t + 1
            value, number, lone = np.full(len(here), -np.inf), np.zeros(len(here), np.int64), np.zeros(len(here), bool)
            whole = t + 1 - head[here]  # bytes of the character
            single = np.zeros(len(here), bool)
            node = state[here]
            node = np.where(self.length[node] > 0, node, self.up[node])
            open_ = np.flatnonzero(node > 0)
            while len(open_):
                at_node = node[open_]
                length = self.length[at_node]
                source = to[open_] - length
                candidate = self.score[at_node] + best[source]
                single[open_] |= length == whole[open_]
                better = candidate > value[open_]
                chosen = open_[better]
                value[chosen] = candidate[better]
                number[chosen] = pieces[source[better]] + 1
                node[open_] = self.up[at_node]
                open_ = open_[node[open_] > 0]
            bare = np.flatnonzero(~single)
            if len(bare):
                source = to[bare] - whole[bare]
                candidate = self.unknown + best[source]
                better = candidate > value[bare]
                chosen, source = bare[better], source[better]
                value[chosen] = candidate[better]
                # a space is the three bytes of its mark
                added = np.where(byte[here[chosen]] == 32, len(MARK.encode()), whole[chosen]) if self.byte_fallback else 1 - unknown_last[source].astype(np.int64)
                number[chosen] = pieces[source] + added
                lone[chosen] = True
            best[to], pieces[to], unknown_last[to] = value, number, lone
        out = np.empty(n, np.int64)
        out[order] = pieces[at + size]
        return out

    def count_long(self, part: str) -> int:
        """Pieces of the best path of one part, keeping as many places as the longest piece has characters."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for piece, value in self.texts.items():
                self.automaton.add_word(piece, (len(piece), value))
            if self.texts:
                self.automaton.make_automaton()
        size = max(map(len, self.texts), default=1) + 1
        best, pieces, lone = [0.0] * size, [0] * size, [False] * size
        matches = self.automaton.iter(part) if self.texts else iter(())
        end, found = next(matches, (-1, None))
        for at, sign in enumerate(part):
            value, number, single, unknown = -np.inf, 0, False, False
            while end == at:  # the longest piece comes first
                length, score = found
                source = (at + 1 - length) % size
                candidate = score + best[source]
                single |= length == 1
                if candidate > value:
                    value, number = candidate, pieces[source] + 1
                end, found = next(matches, (-1, None))
            if not single:
                source = at % size
                candidate = self.unknown + best[source]
                if candidate > value:
                    unknown = True
                    added = (len(MARK.encode()) if sign == " " else len(sign.encode())) if self.byte_fallback else 1 - lone[source]
                    value, number = candidate, pieces[source] + added
            to = (at + 1) % size
            best[to], pieces[to], lone[to] = value, number, unknown
        return pieces[len(part) % size]

    def slice_counts(self, column) -> np.ndarray:
        """Tokens of each row of a column; each distinct part is counted once."""
        if self.normaliser:
            texts = [self.normaliser.normalize(t) if t else "" for t in column.to_pylist()]
            column = pa.array(texts, pa.large_string())
        column = pc.replace_substring(column, MARK, " ")
        if self.dummy_prefix:  # a space before each text that isn't empty
            column = pc.fill_null(column.cast(pa.large_string()), "")
            column = pc.if_else(pc.greater(pc.binary_length(column), 0), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())), column)
        data, offsets = tk.buffer_of(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(rows, np.int64)
        starts, first = self.parts(data, offsets)
        ends = np.append(starts[1:], len(data))
        key = tk.ranges_hash(data, starts, ends)
        _, where, back = np.unique(key, return_index=True, return_inverse=True)
        counts = np.zeros(len(where), np.int64)
        sizes = np.cumsum(ends[where] - starts[where])
        at = 0
        while at < len(where):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES, "right")))
            counts[at:to] = self.count(data, starts[where[at:to]], ends[where[at:to]])
            at = to
        total = np.concatenate([[0], np.cumsum(counts[back])])
        return total[first[1:]] - total[first[:-1]]

    def count_text(self, text: str | None) -> int:
        return int(self.slice_counts(pa.array([text], pa.string()))[0])


@lru_cache(4)
def _compiled(path: str, byte_fallback: bool) -> Counter:
    return Counter(Vocabulary.from_sentencepiece(path, byte_fallback))


def default_path() -> str:
    """The public unigram-style piece list that the box installs."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def counted(docs: DataFrame, *, text: str = "text", column: str = "n_tokens", vocabulary: Vocabulary | None = None) -> DataFrame:
    """`docs` with the number of tokens of each whole text, row by row.

    Null and empty texts have 0. Very long texts and parts without spaces are
    counted whole. Ties are settled as the module says. Repeated rows are
    counted alike. An empty table gives an empty one. An input column of the
    added name is replaced; others may have any name.
    """
    vocabulary = vocabulary or Vocabulary.from_sentencepiece(default_path())
    shared = docs.sparkSession.sparkContext.broadcast((list(vocabulary.pieces.items()), vocabulary.byte_fallback, vocabulary.dummy_prefix, vocabulary.normaliser))
    base = docs.drop(column)

    def run(batches):
        counter = Counter(Vocabulary(*shared.value))
        for batch in tk.slices(batches, text):
            counts = counter.slice_counts(batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=[*batch.schema.names, column])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(column, T.LongType())]))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return counted(docs).select("doc_id", "n_tokens")
