"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The signs are the bytes of the text, so every script is modelled and nothing is
folded; an n-gram of ORDER bytes is a number. A model is trained on the trusted
texts of each language but a part of them that is held out, and a document is
kept if its perplexity isn't above a quantile of the held-out trusted documents
of its language.

Documents and labels are dealt to buckets of a fixed amount of text, once. Each
bucket counts its trusted n-grams, and counts are joined in shards. The shard of
an n-gram goes by its inner bytes, so an n-gram, its context, its suffix and the
suffix's context meet in one shard, and the counts of the two highest orders
need no other data. Lower orders have as many n-grams as there are short byte
strings and are one table for each language. To score, each bucket asks the
shards for its distinct n-grams, is answered with what the two highest orders
give, and sums its documents. Neither the model nor the corpus is ever gathered
in one place; the number of shards grows with the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .session import cut

#: Bytes of an n-gram.
ORDER = 5
#: Bytes of text in a bucket, and there are as many shards as buckets.
BUCKET_BYTES = 32 << 20
#: Bytes of text worked on at once, with about 80 bytes of memory for each.
SLICE_BYTES = 1 << 20
#: One of so many trusted documents is held out of training to find the threshold.
HOLD_OUT = 10
QUANTILE = 0.995
#: Allowance over the quantile, as it is one of a sample.
SLACK = 1.1
#: Documents of fewer characters aren't judged.
MIN_CHARS = 60
#: The model of all languages, for texts of others.
ALL = "\x00all"
#: Buckets that a copy of a language's table of lower orders serves.
SERVED = 16
_INNER = np.int64((1 << 8 * (ORDER - 2)) - 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes that end at each byte as a number, the last lowest; before a row stand zeros."""
    out = data.astype(np.int64)
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER):
        before = np.zeros(len(data), np.int64)
        before[back:] = data[:-back] if len(data) > back else 0
        out |= np.where(since >= back, before, 0) << (8 * back)
    return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shards of n-grams: those of the same inner bytes meet."""
    return (tk.mix((keys >> 8 & _INNER).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """D0 to D3 of an order from how many of its n-grams have the counts 1 to 4."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    return np.array([0.0] + [max(0.1 * k, min(k - 0.1, k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[0] else k / 2)) for k in (1, 2, 3)])


class Level:
    """n-grams of one order with counts: what each gives after its discount, and what its context leaves."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, d: np.ndarray):
        self.keys = keys  # ascending
        context = keys >> 8
        head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        taken = d[np.minimum(counts, 3)]
        total = np.add.reduceat(counts, head) if len(keys) else np.zeros(0)
        self.contexts = context[head]
        self.gamma = np.add.reduceat(taken, head) / total if len(keys) else np.zeros(0)
        self.alpha = (counts - taken) / np.repeat(total, np.diff(np.append(head, len(keys)))) if len(keys) else np.zeros(0)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha (0 if unseen) and gamma (1 if the context is unseen) of n-grams."""
        return _look(self.keys, self.alpha, keys, 0.0), _look(self.contexts, self.gamma, keys >> 8, 1.0)


def _look(known: np.ndarray, values: np.ndarray, keys: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), otherwise)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], otherwise)


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if counts is None:
        found, n = np.unique(keys, return_counts=True)
        return found, n.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head).astype(np.int64) if len(keys) else counts


def _pack(keys: np.ndarray) -> bytes:
    """Numbers below 2**40, their low 32 bits after their high ones, which compress well."""
    return (keys >> 32).astype(np.uint8).tobytes() + (keys & 0xFFFFFFFF).astype(np.uint32).tobytes()


def _unpack(value: bytes) -> np.ndarray:
    n = len(value) // 5
    return np.frombuffer(value, np.uint8, n).astype(np.int64) << 32 | np.frombuffer(value, np.uint32, n, n)


class Bucket:
    """The documents of one bucket, and which of them are trusted."""

    def __init__(self, table: pa.Table):
        self.table = table  # texts stay where they are; only slices of them are copied
        is_doc = table.column("label_of").is_null() if table.num_rows else pa.chunked_array([], pa.bool_())
        self.is_doc = is_doc.to_numpy()
        self.docs = table.drop_columns(["text"]).filter(is_doc)
        marks = table.select(["id", "label_of"]).filter(pc.invert(is_doc))
        ids = marks.column("id")
        bad = ids.filter(pc.equal(marks.column("label_of"), 0))
        good = ids.filter(pc.equal(marks.column("label_of"), 1))
        own = self.docs.column("id")
        trusted = pc.and_(pc.is_in(own, value_set=good, skip_nulls=True), pc.invert(pc.is_in(own, value_set=bad, skip_nulls=True)))
        # a trusted id is in the value set; a null id never is
        self.trusted = pc.and_(trusted, pc.is_valid(own)).to_numpy() if self.docs.num_rows else np.zeros(0, bool)
        self.held = self.docs.column("held").to_numpy() if self.docs.num_rows else np.zeros(0, bool)

    def parts(self, wanted: np.ndarray | None = None):
        """(lang, documents, n-grams of their bytes, each document's first) of slices of documents of one language."""
        number, row = np.cumsum(self.is_doc) - 1, 0
        for batch in self.table.to_batches():
            rows = np.flatnonzero(self.is_doc[row : row + batch.num_rows])
            docs = number[row + rows]
            row += batch.num_rows
            if wanted is not None:
                rows, docs = rows[wanted[docs]], docs[wanted[docs]]
            text = batch.column(batch.schema.get_field_index("text"))
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            by_lang: dict = {}
            for k, i in enumerate(rows.tolist()):
                by_lang.setdefault(langs[i], []).append(k)
            for lang, own in by_lang.items():
                own = np.array(own)
                ends = np.cumsum(size[rows[own]], dtype=np.int64)
                at = 0
                while at < len(own):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
                    data, offsets = tk.buffer_of(text.take(pa.array(rows[own[at:to]])))
                    yield lang, docs[own[at:to]], grams(data, offsets), offsets
                    at = to

    def distinct(self, wanted: np.ndarray | None = None) -> dict:
        """Of each language the distinct n-grams with their counts."""
        out: dict = {}
        for lang, _, keys, _ in self.parts(wanted):
            keys, counts = _tally(keys)
            if lang in out:
                keys, counts = _tally(np.concatenate([out[lang][0], keys]), np.concatenate([out[lang][1], counts]))
            out[lang] = keys, counts
        return out


_COUNTED = "shard long, lang string, keys binary, counts binary"


def _counted(shards: int):
    """Counts of a bucket's trusted n-grams, a row for each language and shard."""

    def run(table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        rows = []
        for lang, (keys, counts) in bucket.distinct(bucket.trusted & ~bucket.held).items():
            shard = shard_of(keys, shards)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            rows += [(s, lang, _pack(keys[own]), counts[own].astype(np.uint32).tobytes()) for s in np.flatnonzero(np.diff(edges)).tolist() for own in (order[edges[s] : edges[s + 1]],)]
        return _table(rows, ["shard", "lang", "keys", "counts"], [pa.int64(), pa.string(), pa.binary(), pa.binary()])

    return run


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _merged(table: pa.Table) -> pa.Table:
    """The counts of a shard by model: those of each language, and of all together."""
    held: dict[str, list] = {}
    for shard, lang, keys, counts in zip(*(table.column(c).to_pylist() for c in ("shard", "lang", "keys", "counts")), strict=True):
        for name in {lang, ALL} - {None}:
            held.setdefault(name, []).append((_unpack(keys), np.frombuffer(counts, np.uint32).astype(np.int64)))
    rows = []
    for name, parts in held.items():
        keys, counts = _tally(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        rows.append((shard, name, _pack(keys), counts.tobytes()))
    return _table(rows, ["shard", "name", "keys", "counts"], [pa.int64(), pa.string(), pa.binary(), pa.binary()])


def _suffixes(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes, a byte shorter than `order`, with the number of signs that stand before them."""
    return _tally(keys & ((1 << 8 * (order - 1)) - 1))


def _statistics(batches):
    """(name, kind, key, n) of shards' counts: of orders 5 and 4 how many have the counts 1 to 4, and the counts of order 3."""
    for batch in batches:
        rows = []
        for name, keys, counts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            keys, counts = _unpack(keys), np.frombuffer(counts, np.int64)
            for order in (ORDER, ORDER - 1):
                rows.append((name, np.full(4, order), np.arange(1, 5), np.array([(counts == k).sum() for k in range(1, 5)])))
                keys, counts = _suffixes(keys, order)
            rows.append((name, np.full(len(keys), ORDER - 2), keys, counts))
        if rows:
            names = pa.array(np.repeat(np.array([r[0] for r in rows], object), [len(r[1]) for r in rows]), pa.string())
            yield pa.RecordBatch.from_arrays([names, *[pa.array(np.concatenate([r[i] for r in rows]).astype(np.int64)) for i in (1, 2, 3)]], names=["name", "kind", "key", "n"])


def _completed(table: pa.Table) -> pa.Table:
    """A model's discounts of the two highest orders, and its table of the lower ones."""
    name = table.column("name")[0].as_py()
    kind, key, n = (table.column(c).to_numpy() for c in ("kind", "key", "n"))
    high = []
    for order in (ORDER, ORDER - 1):
        found = np.zeros(4)
        np.add.at(found, key[kind == order] - 1, n[kind == order])
        high.append(discounts(found))
    keys, counts = _tally(key[kind == ORDER - 2], n[kind == ORDER - 2])
    parts = []
    for order in range(ORDER - 2, 0, -1):
        parts.append(keys.astype(np.uint32).tobytes() + counts.astype(np.int64).tobytes())
        keys, counts = _suffixes(keys, order)
    return pa.table([pa.array([name]), pa.array([np.concatenate(high).tolist()], pa.list_(pa.float64())), pa.array([parts], pa.list_(pa.binary()))], names=["name", "d", "low"])


class Low:
    """Probabilities under the lower orders of one model."""

    def __init__(self, parts: list[bytes]):
        self.levels = []
        for part in parts:
            n = len(part) // 12
            keys, counts = np.frombuffer(part, np.uint32, n).astype(np.int64), np.frombuffer(part[4 * n :], np.int64)
            self.levels.append(Level(keys, counts, discounts(np.array([(counts == k).sum() for k in range(1, 5)]))))

    def of(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / 256)
        for order, level in zip(range(1, len(self.levels) + 1), self.levels[::-1], strict=True):
            alpha, gamma = level.of(keys & ((1 << 8 * order) - 1))
            p = alpha + gamma * p
        return p


_ASKED = "shard long, bucket long, lang string, keys binary"


def _in_shards(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending keys by shard, and where each shard begins in it."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _asked(shards: int):
    """The distinct n-grams of a bucket's documents, a row for each language and shard."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for lang, (keys, _) in Bucket(table).distinct().items():
            order, edges = _in_shards(keys, shards)
            rows += [(s, table.column("bucket")[0].as_py(), lang, _pack(keys[order[edges[s] : edges[s + 1]]])) for s in np.flatnonzero(np.diff(edges)).tolist()]
        return _table(rows, ["shard", "bucket", "lang", "keys"], [pa.int64(), pa.int64(), pa.string(), pa.binary()])

    return run


_ANSWERED = "bucket long, lang string, shard long, name string, a binary, g binary"


def _answered(asked: pa.Table, model: pa.Table) -> pa.Table:
    """For each asked n-gram a and g: its probability is a + g * p, p that of its last bytes under the lower orders."""
    names = ["bucket", "lang", "shard", "name", "a", "g"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
    levels = {}
    none = (b"", b"")
    seen = {n: (k, c) for n, k, c in zip(*(model.column(x).to_pylist() for x in ("name", "keys", "counts")), strict=True) if k is not None}
    for name, d in zip(model.column("name").to_pylist(), model.column("d").to_pylist(), strict=True):
        if d is not None:
            keys, counts = seen.get(name, none)
            keys, counts = _unpack(keys), np.frombuffer(counts, np.int64)
            levels[name] = Level(keys, counts, np.array(d[:4])), Level(*_suffixes(keys, ORDER), np.array(d[4:]))
    rows = []
    for bucket, lang, shard, keys in zip(*(asked.column(x).to_pylist() for x in ("bucket", "lang", "shard", "keys")), strict=True):
        name = lang if lang in levels else ALL
        if name not in levels:
            continue
        high, low = levels[name]
        keys = _unpack(keys)
        alpha, gamma = high.of(keys)
        a, g = low.of(keys & ((1 << 8 * (ORDER - 1)) - 1))
        rows.append((bucket, lang, shard, name, (alpha + gamma * a).astype(np.float32).tobytes(), (gamma * g).astype(np.float32).tobytes()))
    return _table(rows, names, kinds)


def _scored(shards: int, schema: pa.Schema):
    """The documents of a bucket with the sums of their log probabilities."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        n = bucket.docs.num_rows
        low, found, name_of = {}, {}, {}
        for lang, shard, name, a, g, parts in zip(*(answers.column(c).to_pylist() for c in ("lang", "shard", "name", "a", "g", "low")), strict=True):
            if parts is not None:
                low[name] = Low(parts)
            else:
                found.setdefault(lang, {})[shard] = np.frombuffer(a, np.float32), np.frombuffer(g, np.float32)
                name_of[lang] = name
        logs: dict = {}
        for lang, (keys, _) in bucket.distinct().items():
            if lang not in found:
                continue
            order, edges = _in_shards(keys, shards)
            a, g = (np.concatenate([found[lang][s][i] for s in np.flatnonzero(np.diff(edges)).tolist()]).astype(float) for i in (0, 1))
            value = np.empty(len(keys))
            value[order] = np.log(a + g * low[name_of[lang]].of(keys[order] & _INNER))
            logs[lang] = keys, value
        sums, size = np.full(n, np.nan), np.zeros(n, np.int64)
        for lang, rows, keys, offsets in bucket.parts():
            size[rows] = np.diff(offsets)
            if lang in logs:
                known, value = logs[lang]
                total = np.concatenate([[0.0], np.cumsum(value[np.searchsorted(known, keys)])])
                sums[rows] = total[offsets[1:]] - total[offsets[:-1]]
        chars = pc.fill_null(pc.utf8_length(table.column("text")), 0).cast(pa.int64()).filter(pa.array(bucket.is_doc))
        names = [name_of.get(x) for x in bucket.docs.column("lang").to_pylist()]
        arrays = [bucket.docs.column("row"), pa.array(names, pa.string()), pa.array(bucket.trusted & bucket.held), chars, pa.array(size), pa.array(sums, mask=np.isnan(sums) | (size == 0))]
        return pa.table(arrays, schema=schema)

    return run


def judged(docs: DataFrame, labels: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", label: str = "quality", quantile: float = QUANTILE, slack: float = SLACK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """`docs` without the text, with n_chars_scored, n_bytes, perplexity (of a byte), threshold and kept.

    Trusted are documents labelled 1 (a doc_id labelled both ways isn't). Every
    language with trusted text has a model of its own; null languages and the
    others use the model of all. One of HOLD_OUT trusted documents, by a hash of
    its doc_id, isn't trained on; the threshold is the quantile of those of the
    language, or of all where it has none, times the slack.
    Texts of fewer than MIN_CHARS characters are kept unjudged; null and empty
    texts have no perplexity and aren't kept. Without any trusted text nothing
    has a perplexity and all other texts are kept. Repeated rows are scored
    alike and count as often as they stand; rows without a doc_id are never
    trusted. An empty table gives an empty one. Input columns of the added
    names are replaced; others may have any name.
    """
    base = docs.drop("n_chars_scored", "n_bytes", "perplexity", "threshold", "kept")
    kept_columns = [c for c in base.columns if c != text]
    size = base.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // bucket_bytes))
    t, i = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    place = lambda key: F.pmod(F.xxhash64(key), F.lit(shards))
    # rows without an id are dealt by their text
    rows = base.select(
        F.when(i.isNull(), place(t)).otherwise(place(i)).alias("bucket"), F.lit(None).cast("int").alias("label_of"), i.alias("id"), t.alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"),
        (F.pmod(F.xxhash64(F.lit("held"), i), F.lit(HOLD_OUT)) == 0).alias("held"), F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row"),
    )
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    mark = F.col(f"`{label}`")
    marks = labels.filter(mark.isNotNull()).select(F.col(f"`{doc_id}`").cast(kinds["id"]).alias("id"), (mark == 1).cast("int").alias("label_of")).filter("id IS NOT NULL")
    marks = marks.select(place(F.col("id")).alias("bucket"), "label_of", "id", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("text", "lang", "held", "row")])
    # one shuffle deals texts and labels for counting, asking and scoring: all is one plan, in which Spark reuses it
    dealt = rows.unionByName(marks).groupBy("bucket")
    counts = dealt.applyInArrow(_counted(shards), _COUNTED).groupBy("shard").applyInArrow(_merged, "shard long, name string, keys binary, counts binary")
    statistics = counts.mapInArrow(_statistics, "name string, kind long, key long, n long").groupBy("name", "kind", "key").agg(F.sum("n").alias("n"))
    models = statistics.groupBy("name").applyInArrow(_completed, "name string, d array<double>, low array<binary>")
    none = F.lit(None)
    model = counts.select("shard", "name", "keys", "counts", none.cast("array<double>").alias("d"))
    model = model.unionByName(models.select("name", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), none.cast("binary").alias("keys"), none.cast("binary").alias("counts")))
    answers = dealt.applyInArrow(_asked(shards), _ASKED).groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_answered, _ANSWERED)
    # a copy of a table of lower orders serves SERVED buckets, so no task hands it to all
    used = answers.select("bucket", "name").distinct().withColumn("copy", F.floor(F.col("bucket") / SERVED))
    copies = models.select("name", "low", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((shards - 1) // SERVED).cast("long"))).alias("copy"))
    lows = used.join(copies, ["name", "copy"]).select("bucket", none.cast("string").alias("lang"), none.cast("long").alias("shard"), "name", none.cast("binary").alias("a"), none.cast("binary").alias("g"), "low")
    told = answers.withColumn("low", none.cast("array<binary>")).unionByName(lows)
    out_schema = T.StructType([T.StructField("row", kinds["row"]), T.StructField("name", T.StringType()), T.StructField("held", T.BooleanType()), T.StructField("chars", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("log_sum", T.DoubleType())])
    arrow = docs.sparkSession.createDataFrame([], out_schema).toArrow().schema
    out = cut(dealt.cogroup(told.groupBy("bucket")).applyInArrow(_scored(shards, arrow), out_schema)).withColumn("perplexity", F.exp(-F.col("log_sum") / F.col("bytes")))
    held = out.filter(F.col("held") & F.col("perplexity").isNotNull() & (F.col("chars") >= MIN_CHARS))
    percentile = F.percentile_approx("perplexity", quantile, 10_000)
    overall = held.agg(percentile.alias("q")).first()["q"]
    limits = held.groupBy(F.col("name").alias("of")).agg(percentile.alias("limit"))
    out = out.join(limits, F.col("name") == F.col("of"), "left")
    threshold = F.coalesce(F.col("limit"), F.lit(overall).cast("double")) * F.lit(slack)
    kept = (F.col("bytes") > 0) & ((F.col("chars") < MIN_CHARS) | F.coalesce(F.col("perplexity") <= threshold, F.lit(True)))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept_columns], F.col("chars").alias("n_chars_scored"), F.col("bytes").alias("n_bytes"), "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", F.col("n_bytes").alias("n_symbols"), "perplexity", "threshold", "kept")
