import collections
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from viaflux.llm import queries, toxicity
from viaflux.llm import textkit as tk

from .test_operators import SPACES, WORDS, brute_dedup, lower

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    return sorted(tuple(str(cell(r[i])) for i in order) for r in rows), sorted(columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_return_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert 0 < docs.count() <= before
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
            before = docs.count()


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", None, None), (None, "a b c", None, "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x " * 3000, "en", "s", 6000)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (1, "q r s")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [c.split()[0] for c in kind.split(", ")]
    empty = spark.createDataFrame([], kind)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    ours = plain([tuple(r) for r in df.collect()], df.columns)
    out = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in out.description]
    assert ours == plain(out.fetchall(), columns)


def plain_pipeline(rows, labels, items, model):
    """run() by plain loops over (doc_id, text, source): the doc_ids and texts it gives, with their numbers."""
    # toxicity: the trained weights, applied by dictionaries
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    digest = lambda x: int(tk.ranges_hash(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])

    def toxic(text):
        counts = collections.Counter()
        for w in WORDS.findall(lower(text)):
            b = w.encode()
            counts.update([digest(b), *[digest(b[:n]) ^ n for n in toxicity.PREFIXES if len(b) >= n]])
        return model.bias + sum(weight.get(k, 0) * np.log1p(c) for k, c in counts.items()) >= 0

    rows = [r for r in rows if not toxic(r[1])]
    # near-duplicates: every pair of fingerprints
    import xxhash

    def print_of(text):
        w = SPACES.findall(lower(text))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))

    prints = [print_of(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[a] = b
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    rows = [r for i, r in enumerate(rows) if least[root(i)] == r[0]]
    # repeats
    solid = lambda t: bool(SPACES.search(t or ""))
    texts = brute_dedup([r[:2] for r in rows])
    rows = [(d, texts[d], s) for d, t, s in rows if texts[d] == t or solid(texts[d])]
    # benchmark
    windows = set()
    for t in items:
        w = WORDS.findall(lower(t))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    out = []
    for d, t, s in rows:
        words = list(WORDS.finditer(lower(t)))
        plain, hit = [m.group() for m in words], set()
        for n in {len(x) for x in windows}:
            for i in range(len(plain) - n + 1):
                if tuple(plain[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        kept = list(t or "")
        for i in hit:
            last = words[i + 1].start() if i + 1 in hit else words[i].end()
            kept[words[i].start() : last] = [""] * (last - words[i].start())
        after = None if t is None else "".join(kept)
        if after == t or solid(after):
            out.append((d, after, s))
    # mixing
    sizes = collections.Counter()
    for _, t, s in out:
        sizes[s] += len(SPACES.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if 3 * sizes[s] <= level * weights[s]}
        for s in full or free:
            target[s] = 3.0 * sizes[s] if full else level * weights[s]
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    found = collections.Counter()
    for d, t, s in out:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        draw = int(hashlib.md5(f"mix-1|{d}".encode()).hexdigest()[:8], 16) / 2**32
        found[d, t] += int(rate) + (draw < rate - int(rate))
    return +found


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_run_is_that_of_plain_loops_in_any_partitioning(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    expected = plain_pipeline([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], labels, items, toxicity.fit(docs, labels))
    results = []
    for name, part in (("a", docs.coalesce(1)), ("b", docs.repartition(9)), ("c", docs.orderBy(F.xxhash64("text")))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for table in ("labels", "benchmark"):
            os.symlink(f"{SF}/{table}.parquet", f"{tmp_path}/{name}/{table}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == docs.columns
        results.append(sorted(map(str, out.collect())))
        assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == expected
    assert results[0] == results[1] == results[2] and len(results[0]) > 100
