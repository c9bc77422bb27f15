"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viaflux.llm import decontaminate, html_extract, kneser_ney, license_scan, mixing, quality_rules, simhash, substring_dedup, token_count, toxicity
from viaflux.llm import textkit as tk

SPACES = re.compile("[^\x20\x09-\x0d]+")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = " ".join(f"word{i % 977} straße" for i in range(30000))
ODD = [None, "", " \n\t ", "é", "one two three", "日本語 テキスト", LONG, "a\n\na\nA b", "Same text here, twice.", "Same text here, twice."]


def table(spark, texts, extra=""):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- helpers ---


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZé9 \n\t漢,", max_size=20)), max_size=8))
def test_word_bounds(texts):
    data, offsets = tk.buffer_of(pa.array(texts, pa.string()))
    for kind, pattern in ((tk.NON_SPACE, SPACES), (tk.ALNUM, WORDS)):
        shown = tk.LOWER[data]
        starts, ends, first = tk.word_bounds(shown, offsets, kind)
        got = [[shown[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
        assert got == [pattern.findall(lower(t)) for t in texts]


def test_range_hashes_tell_words_apart():
    words = [f"w{i}" for i in range(5000)] + ["", "w1"]
    data, offsets = tk.buffer_of(pa.array(words))
    h = tk.ranges_hash(data, offsets[:-1], offsets[1:])
    assert len(set(h[:5001].tolist())) == 5001 and h[1] == h[-1]


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 50 + ["y" * 5000] + [None])], names=["t"])
    sizes = [s.num_rows for s in tk.slices(iter([batch]), "t", 1000)]
    assert sum(sizes) == 52 and max(sizes) <= 10


# --- 1 ---


def test_repeated_passages_go(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(80)) for _ in range(8)]
    for k in (2, 5, 6):  # inside a line
        w = texts[k].split()
        texts[k] = " ".join([*w[:30], passage, *w[30:]])
    texts += ["short line", "short line", None, "", "one line of eight plain words stands right here\nx", "y\none line of eight plain words stands right here"]
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(table(spark, texts)).collect()}
    assert len(out) == len(texts)
    assert passage in out[2]["text"]
    for k in (5, 6):
        left = out[k]["text"]
        assert all(w in left.split() for w in set(texts[k].split()) - set(passage.split()))
        assert sum(w in left.split() for w in passage.split()) <= 6
    for k in (0, 1, 3, 4, 7, 8, 9, 10, 11, 12):
        assert out[k]["text"] == texts[k] and out[k]["removed"] == []
    assert out[13]["text"] == "y\n"
    for k, r in out.items():
        t, at, kept = texts[k], 0, []
        for s in r["removed"]:
            kept.append(t[at : s["start"]])
            at = s["end"]
        if t is not None:
            assert "".join(kept) + t[at:] == r["text"]


def test_repeated_lines_of_any_length_go(spark):
    texts = ["Share this\nown words here", "other words\nShare this\nthird text", "Share this", "a - b\n---\nshare", "x y\n---\nshare, this!\n", "Share this and more"]
    out = [r["text"] for r in sorted(substring_dedup.dedup_substrings(table(spark, texts), whole_lines=True).collect(), key=lambda r: r["doc_id"])]
    assert out == [texts[0], "other words\nthird text", "", texts[3], "x y\n", texts[5]]


def test_set_in_passages_of_twenty_odd_words_are_found(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passages = [[word() for _ in range(25)] for _ in range(100)]
    texts = [" ".join([*[word() for _ in range(30)], *p, *[word() for _ in range(30)]]) for p in passages * 2]
    out = {r["doc_id"]: r["text"].split() for r in substring_dedup.dedup_substrings(table(spark, texts)).collect()}
    left = [sum(w in out[100 + i] for w in p) for i, p in enumerate(passages)]
    assert sum(n == 25 for n in left) <= 2 and np.mean(left) <= 1.5


def brute_units(text):
    """Units of a text by a plain loop: (words, first word, line start)."""
    out = []
    for line in (text or "").split("\n"):
        words = WORDS.findall(lower(line))
        data, offsets = tk.buffer_of(pa.array(words or [""]))
        h = tk.ranges_hash(data, offsets[:-1], offsets[1:])
        pair = [int(tk.mix(np.array([(int(h[i]) * 3 + (int(h[i + 1]) if i + 1 < len(words) else 0)) % 2**64], np.uint64))[0]) for i in range(len(words))]
        starts = [i for i in range(len(words)) if i == 0 or (all(pair[i] < pair[j] for j in range(max(0, i - substring_dedup.REACH), i)) and all(pair[i] <= pair[j] for j in range(i + 1, min(len(words), i + substring_dedup.REACH + 1))))]
        out += [tuple(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)], strict=False)]
    return out


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="abc \n", max_size=60), min_size=1, max_size=4))
def test_units_are_as_by_a_plain_loop(texts):
    u = substring_dedup.Units(pa.array(texts))
    for i, t in enumerate(texts):
        own = range(u.first_unit[i], u.first_unit[i + 1])
        assert [int(u.end[k] - u.begin[k]) for k in own] == [len(x) for x in brute_units(t)]


def brute_dedup(rows, whole_lines=True, least=20, least_line=8):
    """Texts without repeats by plain loops over (doc_id, text): unit firsts, runs, their growth, whole lines."""
    docs = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words, units, lines, at = [], [], [], 0
        for line in (text or "").split("\n"):
            own = [(m.group(), at + m.start(), at + m.end()) for m in WORDS.finditer(lower(line))]
            key = tuple(w for w, _, _ in own) or ("", re.sub("[\x20\x09-\x0d]", "", line))
            if re.sub("[\x20\x09-\x0d]", "", line):
                lines.append((key, at, min(at + len(line) + 1, len(text))))
            begin = len(words)
            words += [(*w, at + len(line)) for w in own]
            for unit in brute_units(line):
                units.append((unit, begin, begin + len(unit)))
                begin += len(unit)
            at += len(line) + 1
        docs.append((doc, text, words, units, lines))
    first, first_line = {}, {}
    for d, (*_, units, lines) in enumerate(docs):
        for k, (unit, _, _) in enumerate(units):
            first.setdefault(unit, (d, k))
        for k, (key, _, _) in enumerate(lines):
            first_line.setdefault(key, (d, k))
    out = {}
    for d, (doc, text, words, units, lines) in enumerate(docs):
        goes = [(a, b) for k, (key, a, b) in enumerate(lines) if (whole_lines or (key[0] and len(key) >= least_line)) and first_line[key] != (d, k)]
        k = 0
        while k < len(units):
            if first[units[k][0]] == (d, k):
                k += 1
                continue
            n = 1
            f, g = first[units[k][0]]
            while k + n < len(units) and first[units[k + n][0]] == (f, g + n) and (f, g + n) != (d, k + n):
                n += 1
            begin, end, theirs = units[k][1], units[k + n - 1][2], docs[f][2]
            a, b = docs[f][3][g][1], docs[f][3][g + n - 1][2]
            for _ in range(substring_dedup.CONTEXT):
                if begin == 0 or a == 0 or words[begin - 1][0] != theirs[a - 1][0]:
                    break
                begin, a = begin - 1, a - 1
            for _ in range(substring_dedup.CONTEXT):
                if end == len(words) or b == len(theirs) or words[end][0] != theirs[b][0]:
                    break
                end, b = end + 1, b + 1
            opens = begin == 0 or words[begin - 1][3] != words[begin][3]
            closes = end == len(words) or words[end - 1][3] != words[end][3]
            if end - begin >= least or (opens and closes and end - begin >= least_line):
                stop = words[end - 1][3] if closes else words[end][1]
                goes.append((words[begin][1], min(stop + 1, len(text)) if opens and closes else stop))
            k += n
        kept = list(text or "")
        for a, b in goes:
            kept[a:b] = [""] * (b - a)
        out[doc] = None if text is None else "".join(kept)
    return out


@pytest.mark.parametrize("whole_lines", [True, False])
def test_dedup_is_that_of_plain_loops(spark, whole_lines, monkeypatch):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [list(rng.choice(vocabulary, int(rng.integers(3, 60)))) for _ in range(12)]
    rows = [(None, "a line\n--\nx"), (900, None), (901, ""), (902, "--\na LINE!")]
    for doc in range(120):
        words = []
        for _ in range(int(rng.integers(1, 6))):
            words += list(rng.choice(vocabulary, int(rng.integers(0, 30)))) + (passages[int(rng.integers(12))] if rng.random() < 0.7 else [])
        rows.append((doc, "".join(w + (rng.choice([" ", " ", " ", ", ", "\n", "\n\n"])) for w in words)))
    rows += [(1000, rows[10][1]), (1001, rows[10][1] + rows[11][1]), (1002, "p q r s " * 40)]
    expected = brute_dedup(rows, whole_lines)
    monkeypatch.setattr(tk, "SLICE_BYTES", 1 << 11)
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    for partitions in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        assert {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(df, whole_lines=whole_lines).collect()} == expected
    assert expected != dict(rows)


def test_lines_that_stand_inside_earlier_lines_go(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    lines = [[word() for _ in range(15)] for _ in range(100)]
    rows = [(k, " ".join([*[word() for _ in range(30)], *line, *[word() for _ in range(30)]])) for k, line in enumerate(lines)]
    rows += [(100 + k, f"{word()} {word()}\n{' '.join(line)}\n{word()}") for k, line in enumerate(lines)]
    expected = brute_dedup(rows)
    out = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), whole_lines=True).collect()}
    assert out == expected
    assert sum(len(out[100 + k].split()) == 3 for k in range(100)) >= 90


def test_unique_words_beside_passages_stay(spark):
    rng = np.random.default_rng(2)
    passage = [f"shared{i}" for i in range(40)]
    texts = [" ".join([*[f"u{k}x{i}" for i in range(int(rng.integers(1, 12)))], *passage, *[f"v{k}x{i}" for i in range(int(rng.integers(1, 12)))]]) for k in range(1500)]
    out = {r["doc_id"]: r["text"].split() for r in substring_dedup.dedup_substrings(table(spark, texts), whole_lines=True).collect()}
    for k, t in enumerate(texts):
        assert [w for w in out[k] if not w.startswith("shared")] == [w for w in t.split() if not w.startswith("shared")]
    assert out[0] == texts[0].split() and all(not any(w.startswith("shared") for w in out[k]) for k in range(1, 1500))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_dedup_does_not_depend_on_partitioning(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    results = []
    for df, size in ((docs.coalesce(1), 2 << 20), (docs.repartition(16), 2 << 20), (docs.repartition(5), 1 << 16)):
        monkeypatch.setattr(tk, "SLICE_BYTES", size)
        results.append({tuple(map(str, r)) for r in substring_dedup.dedup_substrings(df, whole_lines=True).collect()})
    assert results[0] == results[1] == results[2]


def test_repeated_rows_and_odd_columns(spark):
    line = " ".join(f"token{i}" for i in range(40))
    df = spark.createDataFrame([(1, line, 5), (1, line, 6), (None, line, 7), (2, "other " + line, 8)], "doc_id long, text string, removed int")
    out = sorted(substring_dedup.dedup_substrings(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert out[0]["text"] == line  # null ranks first
    assert out[1]["text"] == out[2]["text"] == "" and out[3]["text"].strip() == "other"
    assert substring_dedup.dedup_substrings(df.limit(0)).collect() == []
    named = df.selectExpr("doc_id", "text", "1 AS _flags", "2 AS _ID", "3 AS doc", "4 AS digest")
    odd = substring_dedup.dedup_substrings(named, whole_lines=True)
    assert odd.columns == [*named.columns, "removed", "n_units"] and {tuple(r)[2:6] for r in odd.collect()} == {(1, 2, 3, 4)}


# --- 2 ---


def brute_contamination(texts, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORDS.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    out = []
    for t in texts:
        w = WORDS.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


def test_contamination(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30)))) for i in range(25)] + [(99, None), (100, "!!"), (101, "V1 v2, V3")]
    texts = [" ".join(rng.choice(vocabulary + ["zz", "qq"], rng.integers(0, 200))) for _ in range(30)]
    texts += [f"start {items[3][1]} mid {items[3][1].upper()} end", *ODD]
    df = table(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.contamination(df, bench).collect()}
    assert [out[i] for i in range(len(texts))] == brute_contamination(texts, items)
    clean = {r["doc_id"]: r["text"] for r in decontaminate.contamination(df, bench, clean=True).collect()}
    assert clean[30].split()[0] == "start" and sum(x[1] for x in brute_contamination([clean[30]], items)) <= 12
    assert clean[30 + 1] is None
    none = decontaminate.contamination(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0 and decontaminate.contamination(df.limit(0), bench).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=80))
def test_suffixes_and_search(values):
    text = np.array([0, *values, 0], np.int32)
    sa = decontaminate.suffix_array(text)
    key = lambda i: [(v, 0) if v else (-1, j) for j, v in enumerate(text[i:].tolist(), i)]
    assert sa.tolist() == sorted(range(len(text)), key=key)
    index = decontaminate.FMIndex(text, 5, sample=4)
    patterns = {tuple(values[i : i + n]) for n in (1, 2, 3) for i in range(len(values) - n + 1)}
    patterns = [p for p in patterns if 0 not in p] + [(4, 4, 4)]
    rows = np.array([[0] * (3 - len(p)) + list(p) for p in patterns], np.int32)
    low, high = index.search(rows)
    for p, a, b in zip(patterns, low, high, strict=True):
        places = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
        assert places == [i for i in range(len(text)) if tuple(text[i : i + len(p)].tolist()) == p]


def test_benchmarks_of_many_blocks(spark):
    rng = np.random.default_rng(12)
    words = [f"b{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(60)] + [(60, None), (61, "b1 b2")]
    texts = [" ".join([*rng.choice(words, 20), *items[int(rng.integers(60))][1].split()[:15], "x"]) for _ in range(80)] + ODD
    docs = table(spark, texts + texts[:3]).withColumn("key", F.lit(1)).withColumn("_runs", F.lit(2)).withColumn("ITEMS", F.lit(3))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for clean in (False, True):
        whole = decontaminate.contamination(docs, benchmark, clean=clean)
        parts = decontaminate.contamination(docs, benchmark, clean=clean, block_bytes=900)
        assert parts.columns == whole.columns and parts.columns[4:7] == ["key", "_runs", "ITEMS"]
        assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))


# --- 3 ---


def test_quality_with_any_column_names(spark):
    names = ["_t", "_w", "_h", "_o", "_lines", "_row", "_lang", "_of", "_classes", "_Words", "row", "kept"]
    df = table(spark, ODD).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = quality_rules.judged(df)
    assert out.columns[: 3 + 11] == ["doc_id", "lang", "source", *names[:-1]] and {tuple(r)[3:14] for r in out.collect()} == {tuple(range(11))}
    plain = quality_rules.judged(table(spark, ODD)).select("doc_id", "kept").collect()
    assert sorted(map(tuple, out.select("doc_id", "kept").collect())) == sorted(map(tuple, plain))


def test_common_words_between_marks(spark):
    texts = ['"which", (nicht), «the» “the” the— 2the of3', "the's x"]
    words = {"en": ["the", "which", "of"]}
    out = {r["_row"]["doc_id"]: list(r["_words"]) for r in quality_rules.features(table(spark, texts), words=words).collect()}
    assert out == {0: [4, 1, 1, 1], 1: [0, 0, 0, 2]}


def brute_quality(t):
    t = t or ""
    w = SPACES.findall(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if SPACES.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(20)] + ["x y z " * 20, "a\nb\na\na \n\n", "###|<> &&", *ODD]
    df = table(spark, texts).withColumn("kept", F.lit("old")).withColumn("n_words", F.lit(1))
    out = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}
    for i, t in enumerate(texts):
        r, e = out[i], brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e
        assert r["base_failed"] == (e[0] < 20 or 100 * e[4] > 30 * e[0])
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judged(df.limit(0)).collect() == []


def test_divergence_rejects_shouting_and_keeps_prose(spark):
    rng = np.random.default_rng(4)
    words = ["the", "of", "and", "to", "in", "house", "river", "walked", "little", "green", "garden", "with", "morning"]
    good = [" ".join(rng.choice(words, 150)) + "." for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 150)) for _ in range(3)] + [" | ".join(rng.choice(words[5:], 150)) for _ in range(3)]
    out = {r["doc_id"]: r["kept"] for r in quality_rules.judged(table(spark, good + bad)).collect()}
    assert all(out[i] for i in range(60)) and not any(out[i] for i in range(60, 66))


def test_distance(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), (None, [1.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()]
    assert got == [0.0, 1.0, 0.0]


def test_quality_runs_no_python(spark):
    plan = quality_rules.features(table(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 4 ---


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title &amp; more</h1><p>First  line\n of\ttext<br>goes on.</p><p>Second &eacute; one here, as it is.</p></article><footer>&copy; us</footer></body></html>", "Title & more\nFirst line of text goes on.\nSecond é one here, as it is."),
        ("<article><p>Open <b>tag and no end. A few words more are good.<p>Next paragraph is cut &am", "Open tag and no end. A few words more are good.\nNext paragraph is cut &am"),
        ("<body><script>var a='<p>no</p>'</script><style>p{}</style><main><p>Only this text is the one to keep here.</p><!-- <p>not this</p> --></main><form>Name <input></form></body>", "Only this text is the one to keep here."),
        (None, ""),
        ("", ""),
        ("<nav><a href=x>a</a></nav>", ""),
    ],
)
def test_pages(page, text):
    assert html_extract.extract([page], html_extract.default_weights()) == [text]


def test_extraction_on_unseen_pages():
    weights = html_extract.default_weights()
    wrong = total = 0
    for source in html_extract.labelled_pages(120, seed=1234):
        p = html_extract.Page(source)
        x, parent, depth, group = html_extract.features([p])
        marginal, _, _ = html_extract.messages(*html_extract.potentials(weights, x, group), parent, depth)
        for node, _ in p.blocks:
            total += 1
            wrong += (marginal[node, 1] >= 0.5) != bool(p.labels[node])
    assert wrong < 0.05 * total


@pytest.mark.parametrize(
    ("tag", "text"),
    [
        ("<p title=it's>Next para", "Next para"),
        ('<p class="a>Next para</p><p class="b">More words', "More words"),
        ('<p class="a>Next para', ""),
        ("<p/class='x'data-y=\"1>2\">Next <b a=1/>para", "Next para"),
        ("<p ==x a= 'b' c =d>Next para", "Next para"),
        ("<p>a < b and c<3 </ p><//><!----><!--->x<!--> y <!-- > --!> z", "a < b and c<3 x y z"),
        ("<p>one<?php echo 1 ?>two<!DOCTYPE x>three</p >", "onetwothree"),
        ("<p>one</p foo='>'>two<script>if (a</b) '</scripty>'</script >three", "one\ntwothree"),
    ],
)
def test_markup_by_the_standard(tag, text):
    assert "\n".join(t for _, t in html_extract.Page(tag).blocks) == text


def test_no_markup_in_pages_cut_anywhere():
    page = "<html><body><nav><a href='/x'>menu</a></nav><article class=\"a b\"><p id=p1 title='it > is'>First <a href=\"http://example.net/?a=1&amp;b=2\">words</a> here.</p><!-- no --><p>Second</p></article></body></html>"
    allowed = set("menu First words here. Second".split())
    for k in range(len(page)):
        for _, block in html_extract.Page(page[:k]).blocks:
            assert all(any(w.startswith(x) for w in allowed) for x in block.split()), (page[:k], block)


def test_deep_and_long_pages():
    import time

    began = time.time()
    deep = "<div>" * 20000 + "<p>deep words</p>" + "</div>" * 20000
    article = "".join(f"<p>Paragraph number {i} has words.</p>" for i in range(40000))
    long = f"<html><body><nav><ul><li><a href=/>menu</a></li></ul></nav><article>{article}</article></body></html>"
    bad = "<i>" * 20000 + "</b>" * 20000 + "<li>" * 5000
    out = html_extract.extract([deep, long, bad], html_extract.default_weights())
    assert out[1].count("\n") == 39999 and "menu" not in out[1] and time.time() - began < 60


HAND_MADE = [
    ('<body><div id="masthead"><a href="/">The Daily</a></div><div class="entry-content"><h1>A title</h1><p>One long first paragraph, with several words in it.</p><p>Another paragraph.</p></div><div class="comments"><p>Nice post!</p></div><div id="footer">Copyright 2020</div></body>', "A title\nOne long first paragraph, with several words in it.\nAnother paragraph."),
    ("<header><h1>Site</h1></header><main><article><h2>Head</h2><p>Some text &amp; more of it here.</p><blockquote>A quote stands here.</blockquote></article></main><aside><h3>Related</h3><ul><li><a href=a>x</a></li></ul></aside><footer>&copy; Site</footer>", "Head\nSome text & more of it here.\nA quote stands here."),
    ('<div class="cookie-banner">We use cookies. <button>OK</button></div><article><p>Only this is the text of the page.</p></article><div class="ad">Buy now</div>', "Only this is the text of the page."),
]


@pytest.mark.parametrize(("page", "text"), HAND_MADE)
def test_hand_made_layouts(page, text):
    assert html_extract.extract([page], html_extract.default_weights()) == [text]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_pages_give_their_article_elements(spark):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        """Texts of the blocks inside <article>, by the library's parser."""

        def __init__(self):
            super().__init__()
            self.inside, self.blocks = 0, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag == "br":
                self.blocks[-1].append(" ")
            elif tag not in html_extract.INLINE:
                self.blocks.append([])

        def handle_endtag(self, tag):
            if tag not in html_extract.INLINE:
                self.blocks.append([])
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1].append(data)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    out = {r["page_id"]: r for r in html_extract.op4_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    assert out.keys() == pages.keys()
    for k, page in pages.items():
        plain = Article()
        plain.feed(page)
        plain.close()
        blocks = [" ".join("".join(b).split()) for b in plain.blocks]
        assert out[k]["text"] == "\n".join(b for b in blocks if b) and out[k]["n_chars"] == len(out[k]["text"])


def test_messages_are_exact():
    rng = np.random.default_rng(0)
    parent, depth = np.array([0, 0, 0, 1, 1, 3]), np.array([0, 1, 1, 2, 2, 3])
    unary, pair = rng.normal(size=(6, 2)), rng.normal(size=(6, 2, 2))
    marginal, pairs, z = html_extract.messages(unary, pair, parent, depth)
    weight = {}
    for s in np.ndindex(*[2] * 6):
        weight[s] = np.exp(sum(unary[i, s[i]] for i in range(6)) + sum(pair[i, s[parent[i]], s[i]] for i in range(1, 6)))
    total = sum(weight.values())
    assert np.isclose(z, np.log(total))
    for i in range(6):
        assert np.isclose(marginal[i, 1], sum(w for s, w in weight.items() if s[i]) / total)
        if i:
            assert np.isclose(pairs[i, 1, 0], sum(w for s, w in weight.items() if s[parent[i]] == 1 and s[i] == 0) / total)


def test_page_table(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, "v", "<article><p>Some words of text are here, and more.</p></article>", "y"), (2, "v", "<article><p>Some words of text are here, and more.</p></article>", "y")], "page_id long, url string, html string, text string")
    out = html_extract.extract_pages(df).orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in out] == [(1, "", 0)] + [(2, "Some words of text are here, and more.", 38)] * 2
    assert html_extract.extract_pages(df.limit(0)).collect() == []


# --- 5 ---


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in ids}


def test_simhash_groups(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = rng.choice(words, 300).tolist()
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 12)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, 300)] = "changed"
            texts.append(" ".join(copy))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("block", [7, 8192])
def test_links_of_dense_balls(spark, block):
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 2**62))
    prints = {centre}
    while len(prints) < 150:
        x = centre
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 2**62, 100)}
    signed = [x - 2**64 if x >= 2**63 else x for x in sorted(prints)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.near_links(df, block=block)).collect()}
    want = brute_components({x: x % 2**64 for x in signed})
    groups = collections.defaultdict(set)
    for k, v in want.items():
        groups[v].add(k)
    ours = collections.defaultdict(set)
    for x in signed:
        ours[roots.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_every_pair_within_three_bits_shares_a_posting():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        a = int(rng.integers(0, 2**63))
        b = a
        for k in rng.choice(64, 3, replace=False):
            b ^= 1 << int(k)
        byte = lambda v, p: v >> 8 * p & 255
        assert any(all(byte(a, p) == byte(b, p) for p in t) for t in simhash.TRIPLES)


def test_chains_join(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {roots[i] for i in range(41)} == {0} and roots[101] == 100


def test_near_dedup_with_any_column_names_and_frequent_prints(spark, monkeypatch):
    df = table(spark, ["a b c d"] * 30 + ["e f g h"] + [None, ""]).select("*", *[F.lit(i).alias(n) for i, n in enumerate(["_kept", "fp", "i", "first", "component_id", "n"])])
    out = simhash.keep_first(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 30, 31]
    before = sorted(map(tuple, simhash.near_duplicates(df).collect()))
    monkeypatch.setattr(simhash, "MANY", 2)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == before


def test_near_dedup_edges(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (1, None), (2, "")], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert out == [(1, 1), (2, 1), (3, 3), (3, 3), (None, 3)]
    assert sorted(r["doc_id"] for r in simhash.keep_first(df).collect()) == [1, 3, 3]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


# --- 6 ---


def brute_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over bytes by plain dictionaries: the log probability of a text, and p."""
    order = kneser_ney.ORDER
    pad = lambda t: bytes(order - 1) + t.encode()
    levels = [collections.Counter(s[i - order + 1 : i + 1] for s in map(pad, texts) for i in range(order - 1, len(s)))]
    for _ in range(order - 1):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    stats = []
    for c in levels:
        n = [sum(v == k for v in c.values()) for k in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [0] + [max(0.1 * k, min(k - 0.1, k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[1] else k / 2)) for k in (1, 2, 3)]
        totals, gamma = collections.Counter(), collections.Counter()
        for g, v in c.items():
            totals[g[:-1]] += v
            gamma[g[:-1]] += d[min(v, 3)]
        stats.append((c, d, totals, gamma))

    def p(g, level=0):
        if level == order:
            return 1 / 256
        c, d, totals, gamma = stats[level]
        if g[:-1] not in totals:
            return p(g[1:], level + 1)
        return (max(c[g] - d[min(c[g], 3)], 0) + gamma[g[:-1]] * p(g[1:], level + 1)) / totals[g[:-1]]

    return lambda t: sum(np.log(p(s[i - order + 1 : i + 1])) for s in [pad(t)] for i in range(order - 1, len(s))), p


def test_plain_dictionaries_sum_to_one():
    _, p = brute_kneser_ney(["abc abd", "ab cab", "日本"])
    for context in (b"abc ", b"xxxx", b"\0\0ab"):
        assert np.isclose(sum(p(context + bytes([k])) for k in range(256)), 1)


@pytest.mark.parametrize("bucket_bytes", [kneser_ney.BUCKET_BYTES, 1 << 11])
def test_perplexity_and_verdicts_are_those_of_plain_dictionaries(spark, bucket_bytes):
    rng = np.random.default_rng(8)
    rows, trusted = [], []
    for i in range(240):
        lang = [None, "de", "en", "zh", "xx"][i % 5]
        letters = {"de": "abcdeß ", "en": "abcde .", "zh": "日本語文 ", "xx": "xyz ", None: "nop "}[lang]
        t = "".join(rng.choice(list(letters), int(rng.integers(20, 150))))
        rows.append((i, t, lang))
        if i % 3 and lang != "xx":
            trusted.append(i)
    rows += [(300, None, "en"), (301, "", "en"), (302, "QQQQ#### " * 20, "en"), (303, "hi", "en"), (None, "abc de" * 20, "en"), (3, rows[3][1], rows[3][2]), (304, "日本" * 60, "de")]
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(7, 0), (302, 0), (None, 1)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    hold = {r["id"] for r in spark.range(400).filter(F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(kneser_ney.HOLD_OUT)) == 0).collect()}
    good = [r for r in rows if r[0] in set(trusted) - {7}]
    models = {name: brute_kneser_ney([t for i, t, lang in good if i not in hold and name in (lang, kneser_ney.ALL)])[0] for name in ("de", "en", "zh", kneser_ney.ALL)}
    of = lambda lang: lang if lang in models else kneser_ney.ALL
    perplexity = lambda t, lang: np.exp(-models[of(lang)](t) / len(t.encode())) if t else None
    held = [(of(lang), perplexity(t, lang)) for i, t, lang in good if i in hold and len(t) >= kneser_ney.MIN_CHARS]
    quantile = lambda v: sorted(v)[max(0, int(np.ceil(kneser_ney.QUANTILE * len(v))) - 1)]
    out = {(r["doc_id"], r["lang"]): r for r in kneser_ney.judged(df, labels, bucket_bytes=bucket_bytes).collect()}
    assert len(out) == len(rows) - 1
    for i, t, lang in rows:
        own, r = perplexity(t, lang), out[i, lang]
        limit = kneser_ney.SLACK * quantile([x for n, x in held if n == of(lang)] or [x for _, x in held])
        assert r["n_bytes"] == len((t or "").encode()) and r["n_chars_scored"] == len(t or "")
        assert (r["perplexity"] is None) if own is None else np.isclose(r["perplexity"], own, rtol=1e-5)
        assert np.isclose(r["threshold"], limit, rtol=1e-5)
        assert r["kept"] == (bool(t) and (len(t) < kneser_ney.MIN_CHARS or own <= limit))


def test_any_number_of_languages_has_models(spark):
    rows = [(i, " ".join(f"l{i % 40}w{(i * 7 + j * j) % 11}" for j in range(30)), f"l{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    out = kneser_ney.judged(df, labels).select("lang", "threshold").distinct().collect()
    assert len(out) == 40 and len({r["threshold"] for r in out}) > 20


def test_classifier_keeps_trusted_kind(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice(["the", "river", "flows", "along", "green", "fields", "today"], 60)) for _ in range(120)]
    bad = ["".join(rng.choice(list("XQZ#%&!"), 300)) for _ in range(5)]
    df = table(spark, good + bad + [None, "", "hi"])
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(120, 0)], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in kneser_ney.judged(df, labels).collect()}
    assert sum(out[i] for i in range(120)) >= 118 and not any(out[i] for i in range(120, 125))
    assert (out[125], out[126], out[127]) == (False, False, True)
    assert kneser_ney.judged(df.limit(0), labels).collect() == []
    named = df.selectExpr("doc_id", "text", "lang", "1 AS row", "2 AS bucket", "3 AS held", "4 AS low", "5 AS Name", "6 AS kept")
    odd = kneser_ney.judged(named, labels)
    assert odd.columns[:7] == ["doc_id", "lang", "row", "bucket", "held", "low", "Name"] and {tuple(r)[2:7] for r in odd.collect()} == {(1, 2, 3, 4, 5)}
    unlabelled = kneser_ney.judged(df, labels.limit(0))
    assert unlabelled.filter("kept").count() == 126


# --- 7 ---


def unigram(pieces, byte_fallback):
    from tokenizers import Tokenizer, models

    extra = [(f"<0x{i:02X}>", min(s for _, s in pieces)) for i in range(256)] if byte_fallback else []
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *extra], unk_id=0, byte_fallback=byte_fallback))
    return lambda s: len(t.model.tokenize("▁" + s.replace(" ", "▁"))) if s else 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text(alphabet="ab▁é漢", min_size=1, max_size=3), st.integers(-4, -1), min_size=1, max_size=9), st.text(alphabet="ab é漢z", max_size=14))
def test_counts_with_ties(pieces, text):
    for fallback in (True, False):
        listed = [(k, float(v)) for k, v in pieces.items()]
        counter = token_count.Counter(token_count.Vocabulary(listed, byte_fallback=fallback))
        counter.unknown = min([0.0, *(s for _, s in listed)]) - 10  # the library's unknown piece has the score 0
        assert counter.count_text(text) == unigram(listed, fallback)(text)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text(alphabet="ab▁é漢", min_size=1, max_size=3), st.integers(-4, -1), min_size=1, max_size=9), st.text(alphabet="ab é漢z", min_size=1, max_size=40), st.booleans())
def test_long_parts_are_counted_as_short_ones(pieces, text, fallback):
    counter = token_count.Counter(token_count.Vocabulary([(k, float(v)) for k, v in pieces.items()], byte_fallback=fallback))
    data = np.frombuffer(text.encode(), np.uint8)
    assert counter.count_long(text) == int(counter.count(data, np.array([0]), np.array([len(data)]))[0])


def test_long_parts_take_little_time():
    pytest.importorskip("public_tokenizers")
    import time

    vocabulary = token_count.Vocabulary.from_sentencepiece(token_count.default_path())
    counter, began = token_count.Counter(vocabulary), time.time()
    text = "abcdefghij" * 100_000
    assert counter.count_text(text) == unigram(list(vocabulary.pieces.items()), True)(text) and time.time() - began < 20


def test_marks_and_normalised_texts():
    counter = token_count.Counter(token_count.Vocabulary([("▁", -1.0), ("a", -1.0)]))
    assert counter.count_text("a▁a") == counter.count_text("a a") == 4


def test_counts_of_a_public_vocabulary(spark):
    pytest.importorskip("public_tokenizers")
    vocabulary = token_count.Vocabulary.from_sentencepiece(token_count.default_path())
    count = unigram(list(vocabulary.pieces.items()), True)
    texts = ["Hello  world\n x", "naïve 漢字 😀", "for (int i = 0; i < 10; i++) {\r\n}", "a" * 3000, " lead", *[t for t in ODD if t is not LONG], LONG[:20000]]
    out = {r["doc_id"]: r["n_tokens"] for r in token_count.counted(table(spark, texts), vocabulary=vocabulary).collect()}
    assert out == {i: count(t or "") for i, t in enumerate(texts)}
    assert token_count.counted(table(spark, texts).limit(0), vocabulary=vocabulary).collect() == []


# --- 8 ---


def toxic_table(spark, n=1500):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = rng.choice(words, 60).tolist()
        toxic = rng.random() < 0.15
        if toxic:
            for k in rng.choice(60, 6, replace=False):
                w[k] = str(rng.choice(["Vile", "nasty", "grim", "foulish"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, LONG)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_table(spark)
    # half of the training labels are hidden: those rows are unlabelled
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) == 1503 and all(0 <= s <= 1 for s in out.values())
    right = sum((out[i] >= 0.5) == bool(truth[i]) for i in held)
    assert right >= 0.97 * len(held)
    again = toxicity.fit(docs.repartition(7), labels.filter("doc_id % 2 = 0"))
    assert np.allclose(np.sort(model.weights), np.sort(again.weights), atol=1e-6)
    assert out[1500] < 0.5 and out[1502] < 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 1500").count() == 3


def test_toxicity_does_not_depend_on_partitioning(spark):
    docs, labels, _ = toxic_table(spark, 7000)
    odd = spark.createDataFrame([(7, f"again w{i} w{i % 7}", "x") for i in range(600)] + [(None, f"none w{i}", "x") for i in range(600)], docs.schema)
    docs = docs.unionByName(odd)
    options = {"max_positive": 300, "max_unlabelled": 1500}
    results = []
    for part in (docs.coalesce(1), docs.repartition(7), docs.repartition(3, "text")):
        model = toxicity.fit(part, labels, **options)
        results.append(sorted((r["text"] or "", r["score"]) for r in toxicity.scored(part, model).collect()))
    assert results[0] == results[1] == results[2]


def test_risk_and_gradient_by_plain_sums():
    rng = np.random.default_rng(5)
    score, prior = rng.normal(0, 2, 30), 0.3
    p = np.arange(30) < 10
    w_p, w_u = np.where(p, 1 / 10, 0), np.where(p, 0, 1 / 20)
    plain = lambda s: (prior * sum(np.log1p(np.exp(-x)) for x in s[:10]) / 10, sum(np.log1p(np.exp(x)) for x in s[10:]) / 20 - prior * sum(np.log1p(np.exp(x)) for x in s[:10]) / 10)
    got = toxicity.risk(score, w_p, w_u, prior)
    assert np.allclose(got[:2], plain(score))
    for k in range(30):
        step = np.where(np.arange(30) == k, 1e-6, 0)
        high, low = plain(score + step), plain(score - step)
        assert np.isclose(got[2][k], (high[0] - low[0]) / 2e-6, atol=1e-6) and np.isclose(got[3][k], (high[1] - low[1]) / 2e-6, atol=1e-6)


def test_scores_are_those_of_plain_dictionaries(spark):
    docs, labels, _ = toxic_table(spark, 400)
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    for r in toxicity.scored(docs, model).collect():
        counts = collections.Counter()
        for w in WORDS.findall(lower(r["text"])):
            b = w.encode()
            h = lambda x: int(tk.ranges_hash(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0])
            counts.update([h(b), *[h(b[:n]) ^ n for n in toxicity.PREFIXES if len(b) >= n]])
        z = model.bias + sum(weight.get(k, 0) * np.log1p(c) for k, c in counts.items())
        assert np.isclose(r["score"], 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "doc_id long").select("doc_id", toxicity.fold(F.col("doc_id")).alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in df.collect())


def test_no_toxic_labels(spark):
    docs, labels, _ = toxic_table(spark, 50)
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == 53
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_negative_risk_is_corrected():
    rng = np.random.default_rng(0)
    n, flat, row, positive = 400, [], [], np.zeros(400, bool)
    positive[:80] = True
    for i in range(n):
        toxic = positive[i] or rng.random() < 0.2
        flat += [1000 + int(rng.integers(0, 50)), 1] if toxic else [1000 + int(rng.integers(0, 50)), 2]
        row += [i, i]
    m = toxicity.train(np.array(flat, np.uint64), np.ones(len(flat)), np.array(row), positive, 0.2)
    s = m.scores(np.array([1, 2], np.uint64), np.array([0, 1]), 3)
    assert s[0] > 0.5 > s[1]


# --- 9 ---


def brute_targets(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {k: float(i % 3 + 1) for i, k in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        w = sum(weight[k] for k in free)
        over = {k for k in free if left * weight[k] / w > 3 * sizes[k]}
        if not over:
            target |= {k: left * weight[k] / w for k in free}
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
        left -= sum(target[k] for k in over)
        free -= over
    return target


@settings(max_examples=15, deadline=None)
@given(sizes=st.dictionaries(st.one_of(st.none(), st.text(alphabet="aé漢z", min_size=1, max_size=3)), st.integers(0, 5000), min_size=1, max_size=7))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], atol=1e-6) for k in got)


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))) if i % 50 else None, str(rng.choice(["a", "a", "a", "b", "c", "d"])) if i % 9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies int")
    plan = mixing.planned(df).collect()
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in plan:
        assert r["mix_size"] == len((r["text"] or "").split()) and r["mix_source_size"] == sizes[r["source"]]
        assert np.isclose(r["mix_target"], want[r["source"]]) and 0 <= r["mix_copies"] <= 3
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
    assert all(abs(taken[s] - want[s]) <= 0.12 * want[s] + 60 for s in want)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["mix_copies"] for r in plan)
    again = {r["doc_id"]: r["mix_copies"] for r in mixing.planned(df.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["mix_copies"] for r in plan}
    assert mixing.mix(df.limit(0)).collect() == []


def test_mixing_with_any_column_names(spark):
    df = table(spark, ["a b", "c", None, ""] * 20).select("*", *[F.lit(i).alias(n) for i, n in enumerate(["_copy", "_of", "_rate", "copies", "row", "t", "s", "i0", "nth", "mix_size"])])
    out = mixing.mix(df)
    assert out.columns == df.columns and {tuple(r)[4:] for r in out.collect()} == {tuple(range(10))}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in mixing.mix(df.select("doc_id", "text", "source")).collect())


def test_mixing_runs_no_python(spark):
    plan = mixing.mix(table(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 10 ---


def brute_lis(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        best[i] += max((best[j] for j in range(i) if pairs[j][1] < pairs[i][1]), default=0)
    return max(best, default=0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=12), st.lists(st.integers(0, 8), max_size=12), st.permutations(range(9)))
def test_alignment(a, b, order):
    pairs = license_scan.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    anchors = list(enumerate(order))
    assert len(license_scan._increasing(anchors)) == brute_lis(anchors)
    assert license_scan.patience(a, a) == [(i, i) for i in range(len(a))]


def test_licences(spark):
    apache, mit = license_scan.TEMPLATES[0][1], license_scan.TEMPLATES[4][1]
    texts = [
        f"Intro words. {apache}. More words.",
        f"x {mit[:200]} and here it goes on {mit[200:]} y",
        "Licensed under CC BY 4.0 and then Licensed under CC BY-NC 4.0.",
        "The licence of this dog is the best under the sun, version two.",
        f"{apache} {apache}",
        *ODD,
    ]
    out = {r["doc_id"]: r for r in license_scan.scanned(table(spark, texts).withColumn("licenses", F.lit(1))).collect()}
    assert [out[i]["licenses"] for i in range(5)] == ["Apache-2.0", "MIT", "CC-BY-4.0,CC-BY-NC-4.0", "", "Apache-2.0"]
    n = out[0]["notices"][0]
    assert texts[0][n["start"] : n["end"]] == apache and out[0]["coverage"] == 1.0
    assert out[1]["coverage"] > 0.9 and len(out[4]["notices"]) == 2
    assert all(out[i]["n_licenses"] == 0 for i in range(5, 5 + len(ODD)))
    assert license_scan.scanned(table(spark, texts).limit(0)).collect() == []
    assert license_scan.scanned(table(spark, texts), templates=[]).filter("n_licenses > 0").count() == 0


def test_scans_by_plain_search(spark):
    rng = np.random.default_rng(3)
    filler = [f"filler{i}" for i in range(500)]
    texts, expected = [], []
    for name, template in license_scan.TEMPLATES:
        w = license_scan.words_of(template)
        before, after = rng.choice(filler, int(rng.integers(0, 80))).tolist(), rng.choice(filler, int(rng.integers(0, 80))).tolist()
        texts.append(" ".join([*before, *w, *after]))
        expected.append((name, 1.0, len(" ".join(before)) + bool(before), len(" ".join([*before, *w]))))
        if len(w) >= 20:
            other = list(w)
            for k in rng.choice(np.arange(1, len(w) - 1), max(1, len(w) // 12), replace=False):
                other[k] = "changed"
            texts.append(" ".join([*before, *other, *after]))
            expected.append((name, sum(x == y for x, y in zip(w, other, strict=True)) / len(w), len(" ".join(before)) + bool(before), len(" ".join([*before, *other]))))
    out = {r["doc_id"]: r["notices"] for r in license_scan.scanned(table(spark, texts)).collect()}
    for i, (name, coverage, start, end) in enumerate(expected):
        best = max(out[i], key=lambda n: n["end"] - n["start"])
        plain = sorted({n for n, t in license_scan.TEMPLATES if f" {' '.join(license_scan.words_of(t))} " in f" {texts[i]} "})
        if coverage == 1.0:
            assert name in plain and [tuple(n) for n in out[i]] == [(name, 1.0, start, end)], (i, plain, out[i])
        else:
            assert best["name"].split("-")[0] == name.split("-")[0] and best["coverage"] >= license_scan.MIN_COVERAGE, (i, name, out[i])
    names = ["notices", "_text", "coverage"]
    odd = license_scan.scanned(table(spark, texts[:2]).select("*", *[F.lit(1).alias(n) for n in names]))
    assert "_text" in odd.columns and odd.filter("n_licenses = 1").count() == 2
