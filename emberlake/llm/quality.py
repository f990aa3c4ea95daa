"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule is a row (name, measure, least, most); a text passes if every measure lies in its bounds. ``RULES`` can be
replaced by the caller. The measures of a row are computed once, in one struct, over the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import let, words

SYMBOL = "[#*$%&|<>]"
CAPITAL = r"\p{Lu}"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 3

#: Common words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the of and to in a is that it for on was as with be by are this at an from or "
    "der die das und den von mit ist im für auf ein nicht sich des dem "
    "le la les de et un une est que dans pour du en par sur des au avec "
    "el los las del y con por se su para es una lo como"
).split()

#: (rule, measure, least, most); None: no bound on that side. Measures are the names in ``measures``.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "mean_word", 2.0, 14.0),
    ("symbols_per_word", "symbol_ratio", None, 0.10),
    ("capitals_share", "upper_ratio", None, 0.40),
    ("stop_words_share", "stop_ratio", 0.06, None),
    ("repeated_lines_share", "dup_line_ratio", None, 0.60),
    ("bullet_lines_share", "bullet_ratio", None, 0.90),
    ("ellipsis_lines_share", "ellipsis_ratio", None, 0.30),
    ("short_lines_share", "short_line_ratio", None, 0.80),
]
#: Lines that begin as a list's item does, that break off, and the characters under which a line is short.
BULLET, ELLIPSIS, SHORT = r"^[\x20\x09]*[-*•●◦‣]", r"(\.\.\.|…)[\x20\x09-\x0D]*$", 30


def _repeat_words(w: Column) -> Column:
    """How many of the words ``w`` lie in a 3-word window that occurs twice or more; each word counts once.

    Windows are told apart by a 64-bit hash, over one text. Texts without a repeat, nearly all, never sort.
    """

    def spread(at: Column) -> Column:
        # at: the places of repeated windows, ascending; each covers WINDOW words, less what the next covers
        steps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)

    def places(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda x, k: (k >= 0) & (k < F.size(s)) & (F.get(s, k)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        return let(order, repeated)

    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.when(F.size(w) > WINDOW, F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), spread)))
    return F.coalesce(counted, F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """A struct of counts and ratios over one whole text; a null text has no words, lines or symbols."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    stop = list(dict.fromkeys(STOP_WORDS))
    share = lambda lines, kind: F.size(F.filter(lines, kind))

    def counts(t: Column, w: Column) -> Column:
        return let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), lambda lines: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.regexp_count(t, F.lit(CAPITAL)).cast("long").alias("n_upper"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop"),
            share(lines, lambda x: x.rlike(BULLET)).alias("n_bullet"),
            share(lines, lambda x: x.rlike(ELLIPSIS)).alias("n_ellipsis"),
            share(lines, lambda x: F.length(x) < SHORT).alias("n_short"),
        ))

    def ratios(c: Column) -> Column:
        per_word = lambda x: x / F.greatest(c["n_words"], F.lit(1))
        per_line = lambda x: x / F.greatest(c["n_lines"], F.lit(1))
        kept = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop")
        return F.struct(
            *(c[k].alias(k) for k in kept),
            per_word(c["word_chars"]).alias("mean_word"),
            per_word(c["n_symbols"]).alias("symbol_ratio"),
            (c["n_upper"] / F.greatest(c["word_chars"], F.lit(1))).alias("upper_ratio"),
            per_word(c["n_stop"]).alias("stop_ratio"),
            *(per_line(c[n]).alias(ratio) for n, ratio in (("n_dup_lines", "dup_line_ratio"), ("n_bullet", "bullet_ratio"), ("n_ellipsis", "ellipsis_ratio"), ("n_short", "short_line_ratio"))),
        )

    return let(let(text, lambda t: let(words(t), lambda w: counts(t, w))), ratios)


def verdict(m: Column, rules=None) -> Column:
    """True if the measures ``m`` lie within all bounds of the threshold table."""
    ok = F.lit(True)
    for _, measure, least, most in RULES if rules is None else rules:
        ok = ok if least is None else ok & (m[measure] >= least)
        ok = ok if most is None else ok & (m[measure] <= most)
    return ok


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """One row for each row of ``docs``: the id, the base counts, ``base_failed`` and ``kept``.

    Null and empty texts have zero counts and fail; repeated rows give repeated rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), measures(F.col(text_col)).alias("m"))
    named = [F.col("m")[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = base_failed(F.col("m"))
    return rows.select("id", *named, failed.alias("base_failed"), (~failed & verdict(F.col("m"), rules)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules=None) -> DataFrame:
    """The rows of ``docs`` that pass the base and the table, with all their columns, whatever their names.

    Null and empty texts have no words and go; rows with null or repeated ids are judged one by one; an empty table stays empty.
    """
    m = measures(F.col(text_col))
    return docs.filter(let(m, lambda x: ~base_failed(x) & verdict(x, rules)))
