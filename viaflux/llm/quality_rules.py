"""Quality rules from distribution divergence, with DataFrame functions only.

Each document gets a histogram of character classes and one of common words of
its language. References are the same histograms summed over all documents of
the language that pass the base rules, so they follow the corpus. A document is kept if it passes
the base rules and its Jensen-Shannon distances to the references stay below
thresholds; documents too short for a stable histogram are not judged by it.

A text is read in a few passes of JVM expressions; only counts are written and
joined, never texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import cut

#: Frequent function words of the languages that references are kept for.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "as", "be", "by", "at", "this", "are", "from", "or", "an", "not", "have", "which"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er", "sie"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne", "se", "ce", "avec"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como", "más", "es", "o", "pero"],
}
#: Character classes: a name and a Java pattern of one character.
CLASSES = {
    "lower": r"[a-z]",
    "upper": r"[A-Z]",
    "digit": r"[0-9]",
    "symbol": r"[#*$%&|<>=_~^@\\{}\[\]+/]",
    "punctuation": r"[!?.,;:'\"()\-]",
}
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Histograms of fewer characters or words aren't judged.
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 100
MAX_CLASS_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.29

_SPACE = r"[\x20\x09-\x0D]"
#: What may stand beside a common word, the signs of ASCII and the usual marks of typography.
_EDGES = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~¡¿«»‹›‘’‚“”„–—…·•©®°§"
_ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def _with_repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in WINDOW-word windows that are found twice or more, first included.

    `_h` has a hash for each window. Only texts with a repeated one sort theirs;
    each step is a column of its own, as lambdas evaluate what they name once
    for each element.
    """
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    placed = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("_o", F.when(repeated, F.sort_array(placed)))
    last = F.size("_o") - 1
    same = lambda x, k: F.get(F.col("_o"), k)["h"] == x["h"]
    marked = F.transform("_o", lambda x, k: F.when(((k > 0) & same(x, k - 1)) | ((k < last) & same(x, k + 1)), x["i"]))
    rows = rows.withColumn("_o", F.sort_array(F.array_compact(marked)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_o", zero, lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def features(docs: DataFrame, *, text: str = "text", lang: str = "lang", words: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """The base counts and the two histograms (arrays of long) of each row; _row has the input's other columns, _lang its language."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in _ADDED]
    docs = docs.select(F.struct(*others).alias("_row") if others else F.lit(None).alias("_row"), F.col(f"`{lang}`").alias("_lang"), t.alias("_t"))
    keep = [F.col("_row"), F.col("_lang")]
    lists = F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    listed = F.coalesce(F.element_at(lists, F.coalesce(F.col("_lang"), F.lit(""))), F.array().cast("array<string>"))
    a = docs.select(*keep, "_t", F.array_remove(F.split("_t", _SPACE + "+"), "").alias("_w"), listed.alias("_list"))
    n = F.size("_w")
    # the most frequent characters go first, so that later passes see short texts
    a = a.withColumn("_rest", F.regexp_replace("_t", r"[a-z]+", ""))
    a = a.withColumn("_solid", F.regexp_replace("_rest", _SPACE + "+", ""))
    # hashes of 2, 4 and 8 words, each from two of the one before
    h = F.transform("_w", lambda w: F.xxhash64(w))
    pairs = lambda c, by: F.zip_with(F.col(c), F.slice(F.col(c), by + 1, F.greatest(n, F.lit(1))), lambda x, y: F.xxhash64(x, y))
    a = a.withColumn("_h", h)
    for by in (1, 2, 4):
        a = a.withColumn("_h", pairs("_h", by))
    a = a.withColumn("_h", F.slice("_h", 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    a = a.withColumn("_lines", lines)
    longest = max((len(w) for v in words.values() for w in v), default=0)
    bare = F.filter(F.transform("_w", lambda w: F.btrim(w, F.lit(_EDGES))), lambda w: F.length(w) <= longest)
    bare = F.transform(bare, lambda w: F.lower(w))
    a = a.withColumn("_common", F.filter(bare, lambda w: F.array_contains(F.col("_list"), w)))
    solid = lambda pattern: F.length(F.regexp_replace("_solid", "[^" + pattern[1:] + "+", ""))
    a = a.withColumns({f"_c_{k}": solid(p) for k, p in CLASSES.items() if k != "lower"} | {
        "_c_lower": F.length("_t") - F.length("_rest"),
        "word_chars": (F.length("_t") - F.length("_rest") + F.length("_solid")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_solid", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_words": n.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    a = _with_repeat_words(a)
    known = reduce(lambda x, y: x + y, [F.col(f"_c_{k}") for k in CLASSES])
    classes = F.array(*[F.col(f"_c_{k}").cast("long") for k in CLASSES], F.greatest(F.col("word_chars") - known, F.lit(0)).cast("long"))
    per_word = F.transform("_list", lambda w: F.size(F.filter("_common", lambda x: x == w)).cast("long"))
    common = F.concat(per_word, F.array((F.col("n_words") - F.size("_common")).cast("long")))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return a.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), classes.alias("_classes"), common.alias("_words"))


def _shares(counts: Column) -> Column:
    """Counts over their sum; null if that is 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, y: s + y)
    return F.when(total > 0, F.transform(F.arrays_zip(counts.alias("c"), F.array_repeat(total, F.size(counts)).alias("t")), lambda x: x["c"] / x["t"]))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares; 0 if either is null."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    divergence = F.aggregate(terms, F.lit(0.0), lambda s, y: s + y) / 2
    return F.coalesce(F.sqrt(F.greatest(divergence, F.lit(0.0))), F.lit(0.0))


def judged(docs: DataFrame, *, text: str = "text", lang: str = "lang", words: dict[str, list[str]] = COMMON_WORDS, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """`docs` without the text, with the base counts, the distances and `kept`.

    Null texts have no words and fail the base rules, as empty ones do. Rows of
    a null or unlisted language are compared by character classes only, with
    the reference of their language value (null counts as one). Repeated rows
    count as often as they stand in the references. An empty table gives an
    empty one. Input columns of the added names are replaced; others may have
    any name.
    """
    rows = cut(features(docs, text=text, lang=lang, words=words))
    at = lambda name, size: [F.sum(F.when(~F.col("base_failed"), F.get(F.col(name), F.lit(i)))).alias(f"{name}{i}") for i in range(size)]
    n_classes, n_words = len(CLASSES) + 1, max(map(len, words.values())) + 1
    sums = rows.groupBy(F.col("_lang").alias("_of")).agg(*at("_classes", n_classes), *at("_words", n_words))
    rows = rows.withColumns({"_classes": _shares(F.col("_classes")), "_words": _shares(F.col("_words"))})
    reference = sums.select("_of", _shares(F.array(*[F.coalesce(F.col(f"_classes{i}"), F.lit(0)) for i in range(n_classes)])).alias("_ref_classes"), _shares(F.filter(F.array(*[F.col(f"_words{i}") for i in range(n_words)]), lambda x: x.isNotNull())).alias("_ref_words"))
    # a row for each language: small, and joined as Spark's size statistics say
    out = rows.join(reference, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    guard_c, guard_w = F.col("word_chars") >= MIN_CHARS_JUDGED, (F.col("n_words") >= MIN_WORDS_JUDGED) & (F.size("_words") > 1)
    out = out.withColumn("class_distance", F.when(guard_c, js_distance(F.col("_classes"), F.col("_ref_classes"))).otherwise(F.lit(0.0)))
    out = out.withColumn("word_distance", F.when(guard_w & (F.size("_ref_words") == F.size("_words")), js_distance(F.col("_words"), F.col("_ref_words"))).otherwise(F.lit(0.0)))
    kept = ~F.col("base_failed") & (F.col("class_distance") <= max_class) & (F.col("word_distance") <= max_word)
    others = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != text and c not in _ADDED]
    return out.withColumn("kept", kept).select(*others, *_ADDED)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def _oracle() -> str:
    longest = max(len(w) for v in COMMON_WORDS.values() for w in v)
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    lists = ", ".join(f"({quote(k)}, {i}, {quote(w)})" for k, v in COMMON_WORDS.items() for i, w in enumerate(v))
    counts = ", ".join(f"length(regexp_replace(t, {quote('[^' + p[1:] + '+')}, '', 'g')) AS c{i}" for i, p in enumerate(CLASSES.values()))
    known = " + ".join(f"c{i}" for i in range(len(CLASSES)))
    classes = " UNION ALL ".join([f"SELECT doc_id, lang, base_failed, 'c' AS kind, {i} AS k, c{i} AS c FROM judged" for i in range(len(CLASSES))] + [f"SELECT doc_id, lang, base_failed, 'c', {len(CLASSES)}, greatest(word_chars - ({known}), 0) FROM judged"])
    return rf"""
WITH lists(lang, k, word) AS (VALUES {lists}),
base AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS ww FROM cut, unnest(range(1, greatest(1, len(w) - {WINDOW - 2}))) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, ww) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM twice, unnest(range(i, i + {WINDOW})) AS u(j) GROUP BY 1),
counted AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, {counts} FROM cut LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted),
tokens AS (SELECT doc_id, lang, lower(trim(x, {quote(_EDGES)})) AS word FROM cut, unnest(w) AS u(x) WHERE length(trim(x, {quote(_EDGES)})) <= {longest}),
common AS (SELECT doc_id, k, count(*) AS c FROM tokens JOIN lists USING (lang, word) GROUP BY ALL),
cells AS (SELECT doc_id, lang, base_failed, k, coalesce(c, 0) AS c, n_words FROM judged JOIN (SELECT lang, k FROM lists) USING (lang) LEFT JOIN common USING (doc_id, k)),
hist AS ({classes} UNION ALL SELECT doc_id, lang, base_failed, 'w', k, c FROM cells
  UNION ALL SELECT doc_id, lang, base_failed, 'w', -1, any_value(n_words) - sum(c) FROM cells GROUP BY doc_id, lang, base_failed),
own AS (SELECT *, c / nullif(sum(c) OVER (PARTITION BY doc_id, kind), 0)::DOUBLE AS p FROM hist),
sums AS (SELECT lang, kind, k, sum(c) AS s FROM hist WHERE NOT base_failed GROUP BY lang, kind, k),
ref AS (SELECT *, s / nullif(sum(s) OVER (PARTITION BY lang, kind), 0)::DOUBLE AS q FROM sums),
parts AS (SELECT doc_id, own.kind, p, q, (p + q) / 2 AS m FROM own JOIN ref ON own.kind = ref.kind AND own.k = ref.k AND own.lang IS NOT DISTINCT FROM ref.lang),
js AS (SELECT doc_id, kind, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2, 0)) AS d FROM parts GROUP BY ALL),
verdicts AS (SELECT j.*, CASE WHEN word_chars >= {MIN_CHARS_JUDGED} THEN coalesce(a.d, 0) ELSE 0 END AS cd, CASE WHEN n_words >= {MIN_WORDS_JUDGED} THEN coalesce(b.d, 0) ELSE 0 END AS wd
  FROM judged j LEFT JOIN js a ON a.doc_id = j.doc_id AND a.kind = 'c' LEFT JOIN js b ON b.doc_id = j.doc_id AND b.kind = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND cd <= {MAX_CLASS_DISTANCE} AND wd <= {MAX_WORD_DISTANCE} AS kept, round(cd, 6)::DOUBLE AS class_distance, round(wd, 6)::DOUBLE AS word_distance FROM verdicts
"""


ORACLE = _oracle()
