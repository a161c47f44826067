"""Quality rules: a table of thresholds compiled into one Spark projection.

Per document the projection measures length, symbols, stop words, line repetition and 8-word repetition
with built-in functions only; each row of RULES then becomes one comparison over those measures. There is
no shuffle: a document is judged on its own row.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null doc_id is
passed through; repeated rows are judged one by one; extra columns are passed through by keep_good and left out
of the report, whatever their names (measured and judged add columns to docs, which must not have these yet); an
empty table gives an empty result. Windows are compared within one text by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlens.llm.common import as_before, whole_rows

#: Stop words of the corpus languages (English, German, French, Spanish).
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by at this from or an not have has "
    "der die das und ist von zu den mit sich des auf für nicht ein eine als auch dem im es "
    "le la les de des et en un une du que qui est pour dans sur pas au par avec il elle ce "
    "el los las y del se por con una para su al lo como más no o"
).split()

#: measure, lowest and highest allowed value (None: no bound).
RULES = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.25),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.5),
)

SPACE = "[ \\t-\\r]+"
WINDOW = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: the binding is a lambda variable, which no optimizer rule inlines."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _covered(hashes: Column) -> Column:
    """How many words lie in WINDOW-word windows whose hash occurs again; hashes: one for each window start."""
    def of_pairs(a: Column) -> Column:
        twin = F.filter(a, lambda x, k: (x["h"] == F.get(a, k - 1)["h"]) | (x["h"] == F.get(a, k + 1)["h"]))
        starts = F.sort_array(F.transform(twin, lambda x: x["i"]))
        return _let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda acc, x: acc + x))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(pairs, of_pairs))


def repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows found at least twice among words, the first finding included."""
    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(_let(hashed, lambda h: _let(windows(h), _covered)))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base counts and the measures RULES names."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    docs = docs.withColumn("_w", words_of(F.col("text"))).withColumn("_l", lines)
    docs = docs.select(
        *docs.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.coalesce(F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")), F.lit(0)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("_n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
    )
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    return docs.withColumns({
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "stop_word_ratio": share("_stops", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "_n_lines"),
        "repeat_word_ratio": share("n_repeat_words", "n_words"),
    })


def verdict(rules=RULES) -> Column:
    """The table of thresholds as one boolean expression."""
    ok = F.lit(True)
    for name, low, high in rules:
        if low is not None:
            ok = ok & (F.col(name) >= F.lit(low))
        if high is not None:
            ok = ok & (F.col(name) <= F.lit(high))
    return ok


def judged(docs: DataFrame, rules=RULES) -> DataFrame:
    """measured(docs) with base_failed and kept."""
    docs = measured(docs)
    docs = docs.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return docs.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_report(docs: DataFrame, rules=RULES) -> DataFrame:
    return judged(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns, whatever their names."""
    return as_before(judged(whole_rows(docs, "text"), rules).where("kept"), docs)


def oracle(rules=RULES) -> str:
    """DuckDB SQL for quality_report."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    cases = " AND ".join([f"{n} >= {lo}" for n, lo, _ in rules if lo is not None] + [f"{n} <= {hi}" for n, _, hi in rules if hi is not None])
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n >= 2
), cover AS (
  SELECT doc_id, sum(least(8, nxt - i))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) AS nxt FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS stops
  FROM w LEFT JOIN cover c USING (doc_id)
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN stops / n_words ELSE 0 END AS stop_word_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {cases}) AS kept FROM r
"""
