"""Quality rules: divergence of a document's histograms from references of its language.

Two histograms describe a document: character classes (ASCII capitals, punctuation, symbols, digits,
white space, all else) and common words (a short word list for each language, plus "any other
word"). A language's reference is the mean histogram of its documents that pass the base rules and
are long enough; every document of the corpus counts. A document goes if the Jensen-Shannon distance
(square root of the divergence to base 2) to its reference exceeds the limit. Histograms of short
texts are noise, so each distance has a minimum length below which it says nothing.

Everything is DataFrame expressions: one pass over the text writes small features; references and
verdicts come from those.

Defined cases: a null or empty text has no words and fails the base rules; a language that is null or
has no reference is compared with the nearest of all references; with no reference at all (an empty
table, or only short texts) the base rules alone decide; repeated rows each get a row; other columns
of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, stage, table, words_column

#: Frequent words of each language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it"),
    "fr": ("de", "la", "le", "les", "et", "des", "en", "un", "du", "que"),
    "de": ("der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "für"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "un"),
}
#: One pattern for each character class that is counted by itself; white space is what words leave.
CLASSES = ("[A-Z]", r"[.,;:!?'\"()-]", r"[#*$%&|<>@^~=+_/{}\[\]`]", "[0-9]")
CONTRACT_SYMBOLS = "[#*$%&|<>]"

#: A distance d of n characters (words) counts from MIN_CHARS (MIN_WORDS) on, and is too large above
#: BASE + NOISE / sqrt(n): a histogram of few items strays that far by chance.
CHAR_LIMIT = (0.095, 3.2)
WORD_LIMIT = (0.12, 4.0)
MIN_CHARS = 200
MIN_WORDS = 50
#: Base rules.
MIN_BASE_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8


def _count_of(text: Column, pattern: str) -> Column:
    """Characters that match a one-character pattern."""
    return F.size(F.split(text, pattern)) - 1


def _at(array: Column, i) -> Column:
    return F.get(array, i)


def _pairs(codes: Column, n: Column, step: int, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(_at(codes, i), _at(codes, i + step)))


def repeat_words(words: Column, n: Column) -> Column:
    """How many words lie in 8-word windows that the text holds twice or more."""

    def covered(codes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            again = F.filter(
                s,
                lambda e, k: (e["x"] == _at(s, k - 1)["x"]) | ((e["x"] == _at(s, k + 1)["x"])),
            )
            again = F.filter(again, lambda e: e["x"].isNotNull())
            return let(
                F.sort_array(F.transform(again, lambda e: e["i"])),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(_at(p, k + 1), x + WINDOW) - x)),
                    F.lit(0).cast("long"),
                    lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(codes)) == F.size(codes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(codes, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), of_sorted)
        )

    one = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(
        let(one, lambda a: let(_pairs(a, n, 1, 2), lambda b: let(_pairs(b, n, 2, 4), lambda c: let(_pairs(c, n, 4, 8), covered))))
    )


def features(docs: DataFrame, lexicon: dict[str, tuple[str, ...]] = COMMON_WORDS) -> DataFrame:
    """doc_id, lang, base counts and both histograms (counts) of each row of ``docs``."""
    listed = sorted({w for ws in lexicon.values() for w in ws})
    longest = 3 * max(map(len, listed))  # bytes, whatever the case
    text = F.coalesce(F.col("text"), F.lit(""))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        common = F.transform(F.filter(w, lambda x: (F.octet_length(x) <= longest) & F.lower(x).isin(listed)), F.lower)
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w, n).alias("n_repeat_words"),
            let(common, lambda c: F.transform(F.array(*map(F.lit, listed)), lambda k: F.size(F.filter(c, lambda x: x == k)))).alias("common"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    classes = [*(_count_of(text, c) for c in CLASSES), F.length(text) - F.col("w.word_chars").cast("int")]
    return docs.select("doc_id", "lang", "text", let(words_column(F.col("text")), of_words).alias("w")).select(
        "doc_id",
        "lang",
        "w",
        _count_of(text, CONTRACT_SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.length(text).cast("long").alias("n_chars"),
        F.array(*classes).alias("classes"),
    ).select(
        "doc_id", "lang", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
        "n_chars", "classes", "w.common",
    )


def _histogram(counts: Column, total: Column, n: int) -> Column:
    """Shares of ``total``, the last for what no bin counts; null where there is nothing to count."""
    shares = [_at(counts, i) / total for i in range(n)]
    rest = F.lit(1.0)
    for s in shares:
        rest = rest - s
    return F.when(total > 0, F.array(*shares, F.greatest(rest, F.lit(0.0))))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance between two histograms, 0 to 1."""

    def half(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))),
            F.lit(0.0),
            lambda s, x: s + x,
        )

    return F.sqrt(F.greatest(F.lit(0.0), half(p, q) / 2 + half(q, p) / 2))


def judge(
    docs: DataFrame,
    lexicon: dict[str, tuple[str, ...]] = COMMON_WORDS,
    char_limit: tuple[float, float] = CHAR_LIMIT,
    word_limit: tuple[float, float] = WORD_LIMIT,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row for each row of ``docs``: the base counts, both distances and the verdict."""
    n_common, n_classes = len({w for ws in lexicon.values() for w in ws}), len(CLASSES) + 1
    base_failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = stage(
        features(docs, lexicon)
        .withColumn("char_hist", _histogram(F.col("classes"), F.col("n_chars"), n_classes))
        .withColumn("word_hist", _histogram(F.col("common"), F.col("n_words"), n_common))
        .withColumn("base_failed", base_failed)
        .drop("classes", "common"),
        "quality-features",
    )
    fit = rows.filter(~F.col("base_failed") & (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words))
    means = fit.groupBy("lang").agg(
        F.array(*(F.avg(_at(F.col("char_hist"), i)) for i in range(n_classes + 1))).alias("char_ref"),
        F.array(*(F.avg(_at(F.col("word_hist"), i)) for i in range(n_common + 1))).alias("word_ref"),
    )
    # One reference for each language of the lexicon at most, so the array below is bounded by a parameter.
    known = means.filter(F.col("lang").isin(list(lexicon))).agg(F.collect_list(F.struct("lang", "char_ref", "word_ref")).alias("refs"))

    def nearest(hist: str, ref: str) -> Column:
        mine = F.filter(F.col("refs"), lambda r: r["lang"] == F.col("lang"))
        chosen = F.when(F.size(mine) > 0, mine).otherwise(F.col("refs"))
        return F.array_min(F.transform(chosen, lambda r: jensen_shannon(F.col(hist), r[ref])))

    scored = (
        rows.join(F.broadcast(known))
        .withColumn("char_distance", F.when(F.col("n_chars") >= min_chars, nearest("char_hist", "char_ref")))
        .withColumn("word_distance", F.when(F.col("n_words") >= min_words, nearest("word_hist", "word_ref")))
    )

    def too_far(distance: str, n: str, limit: tuple[float, float]) -> Column:
        return F.coalesce(F.col(distance) > limit[0] + limit[1] / F.sqrt(F.col(n)), F.lit(False))

    far = too_far("char_distance", "n_chars", char_limit) | too_far("word_distance", "n_words", word_limit)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance",
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def _oracle() -> str:
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    words, langs = (", ".join(f"'{w}'" for w in x) for x in (listed, COMMON_WORDS))
    classes = ", ".join("len(regexp_extract_all(t, '{}'))".format(c.replace("'", "''")) for c in CLASSES)

    def half(a: str, b: str) -> str:
        return f"coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END)), 0)"

    def distance(a: str, b: str) -> str:
        return f"sqrt(greatest(0, ({half(a, b)} + {half(b, a)}) / 2))"

    def mean(column: str, n: int) -> str:
        return "[" + ", ".join(f"avg({column}[{i}])" for i in range(1, n + 1)) + "]"

    def shares(counts: str, total: str) -> str:
        return f"list_append(list_transform({counts}, lambda c: c / {total}), greatest(0, 1 - list_sum(list_transform({counts}, lambda c: c / {total}))))"

    n_classes, n_words = len(CLASSES) + 2, len(listed) + 1
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS k, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' '))) AS w FROM d WHERE len(ws) >= 8),
again AS (SELECT doc_id, k FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM again) GROUP BY doc_id),
f AS (SELECT d.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{CONTRACT_SYMBOLS}'))::BIGINT AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(t) AS n_chars, [{classes}, length(t) - length(array_to_string(ws, ''))] AS classes,
  list_transform([{words}], lambda k: len(list_filter(ws, lambda x: lower(x) = k))) AS common FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id),
h AS (SELECT *, n_words < {MIN_BASE_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CASE WHEN n_chars >= {MIN_CHARS} THEN {shares('classes', 'n_chars')} END AS ch, CASE WHEN n_words >= {MIN_WORDS} THEN {shares('common', 'n_words')} END AS wh FROM f),
r AS (SELECT lang AS ref_lang, {mean('ch', n_classes)} AS cr, {mean('wh', n_words)} AS wr FROM h WHERE NOT base_failed AND n_chars >= {MIN_CHARS} AND n_words >= {MIN_WORDS} AND lang IN ({langs}) GROUP BY lang),
s AS (SELECT h.doc_id, min(CASE WHEN ch IS NOT NULL THEN {distance('ch', 'cr')} END) AS cd, min(CASE WHEN wh IS NOT NULL THEN {distance('wh', 'wr')} END) AS wd
  FROM h JOIN r ON h.lang = r.ref_lang OR h.lang IS NULL OR h.lang NOT IN (SELECT ref_lang FROM r) GROUP BY h.doc_id)
SELECT h.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(cd > {CHAR_LIMIT[0]} + {CHAR_LIMIT[1]} / sqrt(n_chars), false) OR coalesce(wd > {WORD_LIMIT[0]} + {WORD_LIMIT[1]} / sqrt(n_words), false)) AS kept
FROM h LEFT JOIN s ON h.doc_id = s.doc_id
"""


ORACLE = _oracle()
