"""Quality rules, line first: lines are judged and removed before the document is.

Every line is tested for navigation, symbol noise, shouting, boilerplate and missing
punctuation. Lines that fail go; a document that loses more than ``max_loss`` of its
characters goes as well. Repetition and length of the whole text are judged first
(``base_failed``). Everything is a projection over one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm._common import ASCII_SPACE, let, numbered, restored, words_of

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture and licence lines in English, German, French and Spanish, of ASCII letters.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "uses? cookies",
    "accept (?:all )?cookies",
    "cookie (?:policy|notice|settings|consent)",
    "enable javascript",
    "javascript is (?:disabled|required)",
    "click here",
    "sign in",
    "log in",
    "subscribe",
    "share this",
    "powered by",
    "copyright",
    "alle rechte vorbehalten",
    "datenschutzerkl",
    "impressum",
    "nutzungsbedingungen",
    "hier klicken",
    "verwendet cookies",
    "tous droits r",
    "politique de confidentialit",
    "conditions d'utilisation",
    "cliquez ici",
    "utilise des cookies",
    "todos los derechos reservados",
    "aviso legal",
    "haga clic",
    "utiliza cookies",
)
#: A line that ends in punctuation.
ENDS = r"""[.!?…:;,"'”’»)\]][\x20\x09-\x0D]*\z"""
#: Phrases start at a word, so that "catalog in" isn't "log in".
PHRASES = r"(?i)(?:^|[^A-Za-z])(?:" + "|".join(BOILERPLATE) + ")"
WINDOW = 5


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the array, the first included."""
    return let(words, _repeat_words)


def _repeat_words(words: Column) -> Column:
    """Equal hashes are found by array_distinct; only arrays that have some are sorted by hash
    and words to find where, so the work is n log n at most and words decide.
    """
    n = F.size(words)
    at = lambda i, k: F.get(words, i + k)
    hashes = F.when(n < WINDOW, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    )

    def places(h: Column) -> Column:
        windows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.slice(words, i + 1, WINDOW).alias("w"), i.alias("p"))))

        def twice(s: Column) -> Column:
            same = lambda a, b: F.coalesce((F.get(s, a)["h"] == F.get(s, b)["h"]) & (F.get(s, a)["w"] == F.get(s, b)["w"]), F.lit(False))
            dup = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.sort_array(F.transform(dup, lambda j: F.get(s, j)["p"]))

        return let(windows, twice)

    def covered(p: Column) -> Column:
        step = lambda acc, i: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW)))
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), step))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), covered)))


def line_fault(line: Column) -> Column:
    """The name of the first rule that a line with a word breaks, or null."""
    n = F.length(line)
    symbols = n - F.length(F.regexp_replace(line, r"[#*$%&|<>{}\\^~]+", ""))
    bars = F.regexp_count(line, F.lit(r"[|»›•·>](?: |\z)"))
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    return (
        F.when((bars >= 3) & (bars * 6 >= n_words), "navigation")
        .when((symbols >= 5) & (symbols * 12 > n), "symbols")
        .when((n >= 20) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}"), "shouting")
        .when((n_words <= 20) & line.rlike(PHRASES), "boilerplate")
        .when((n_words <= 3) & ~line.rlike(ENDS), "punctuation")
    )


def clean_lines(docs: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """docs with the measures of every text, its cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, lost (share of the characters of worded lines that failing lines
    hold), clean_text and kept. Input columns of these names are replaced. A null or
    empty text has no words, so base_failed is true and kept false. Repeated rows are
    judged alike and all stay; ties play no part.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    staged = docs.withColumns({"_q_text": body, "_q_words": words_of(body), "_q_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    t, words, lines = F.col("_q_text"), F.col("_q_words"), F.col("_q_lines")
    n_words = F.size(words)
    staged = staged.withColumns(
        {
            "n_words": n_words.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeat_words(words).cast("long"),
            # A filter on the verdict must not be pushed below this: it would compute all of it once more.
            "_q_row": F.monotonically_increasing_id(),
            "_q_good": F.filter(lines, lambda x: line_fault(x).isNull()),
        }
    )
    lengths = lambda a: F.length(F.array_join(a, ""))
    return (
        staged.withColumns(
            {
                "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
                "lost": F.coalesce(1 - lengths(F.col("_q_good")) / F.nullif(lengths(lines), F.lit(0)), F.lit(1.0)),
                "clean_text": F.array_join(F.col("_q_good"), "\n"),
            }
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_loss) & (F.col("_q_row") >= 0))
        .drop("_q_row", "_q_text", "_q_words", "_q_lines", "_q_good")
    )


def digest(docs: DataFrame) -> DataFrame:
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")


def stage(docs: DataFrame) -> DataFrame:
    """Kept documents with their failing lines removed and n_chars counted anew, in the columns of docs, whatever their names."""
    renamed, names = numbered(docs)
    out = clean_lines(renamed, names["text"]).where("kept")
    return restored(out, names, text=F.col("clean_text"), n_chars=F.length("clean_text").cast("long"))


#: The same as digest() for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT rid, i, list_value(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), r AS (
  SELECT rid, count(DISTINCT q) AS n FROM (
    SELECT rid, unnest(range(i, i + 5)) AS q FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
  ) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         length(array_to_string(lines, '')) AS all_chars,
         length(array_to_string(list_filter(lines, lambda x: NOT (
           (len(regexp_extract_all(x, '[|»›•·>](?: |\z)')) >= 3 AND len(regexp_extract_all(x, '[|»›•·>](?: |\z)')) * 6 >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))
           OR (length(x) - length(regexp_replace(x, '[#*$%&|<>{}\\^~]+', '', 'g')) >= 5 AND (length(x) - length(regexp_replace(x, '[#*$%&|<>{}\\^~]+', '', 'g'))) * 12 > length(x))
           OR (length(x) >= 20 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))
           OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 20 AND regexp_matches(x, '@PHRASES'))
           OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) <= 3 AND NOT regexp_matches(x, '@ENDS'))
         )), '')) AS good_chars
  FROM w LEFT JOIN r USING (rid)
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         coalesce(1 - CAST(good_chars AS DOUBLE) / nullif(all_chars, 0), 1.0) AS lost
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept, CAST(lost AS DOUBLE) AS lost
FROM v
""".replace("@PHRASES", PHRASES.replace("'", "''")).replace("@ENDS", ENDS.replace("'", "''"))

__all__ = ["ASCII_SPACE", "clean_lines", "digest", "line_fault", "repeat_words", "stage"]
