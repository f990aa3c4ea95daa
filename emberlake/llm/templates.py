"""Line dedup by a log-template tree.

A line's tokens that hold a digit are variable fields. The tree has a fixed depth: first the number of tokens, then the
leading tokens; a leaf is a combination of these. Inside a leaf a further token stays if it recurs at its place over
many texts, and else becomes a variable field too. A line whose fixed tokens make up enough of it has the template so
found; any other line is its own template. Lines of templates that recur in many different texts are dropped. A line that
is mostly variable fields, such as a row of numbers, is its own template as it stands: it recurs with equal lines only.

A tree in a log reader grows line by line; here every step is an aggregation over all lines, so the result doesn't
depend on their order. Rows of tokens are made only for lines in leaves that recur, once for each different line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions.binding import bound
from emberlake.llm.common import discard, let, reads, small, words, written

FIELD = "<*>"
#: What a line must hold to differ from its masked form or to have fields, but for spaces; listed one by one, as Java looks single characters up in a table.
ODD = r"[0123456789<\t\x0B\f\r]"
DEPTH = 3
MIN_TEXTS = 10
SIMILARITY = 0.6


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def masked(line: Column) -> Column:
    """The words of a line with one space between, those with a digit replaced by FIELD; empty without a word.

    Most lines have single spaces and no digit and are left as they are, without an array of words.
    """
    spaced = line.startswith(" ") | line.endswith(" ")
    for run in ("  ", "\t", "\x0b", "\f", "\r"):
        spaced = spaced | line.contains(run)
    even = F.when(spaced, F.array_join(words(line), " ")).otherwise(line)
    return let(even, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "[^ ]*[0-9][^ ]*", FIELD)).otherwise(x))


def n_tokens(line: Column) -> Column:
    """The number of words of a masked line that isn't empty."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1


def _leaf(line: Column, n_words: Column) -> Column:
    return F.xxhash64(n_words, F.substring_index(line, " ", DEPTH))


def text_lines(text: Column) -> Column:
    """The \\n-split lines of a text (null: none)."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def masked_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """(text_id, line_no, line, odd, x) of every line with a word: ``x`` is the masked line, itself where the line isn't ``odd``.

    Lines become rows before anything is worked out of them, so that Spark compiles the steps, which it can't inside arrays.
    """
    text, line = F.col(text_col).cast("string"), F.col("line")
    texts = docs.filter(F.col(text_col).isNotNull()).select(digest(text).alias("text_id"), text.alias("text"))
    lines = texts.select("text_id", F.posexplode(text_lines(F.col("text"))).alias("line_no", "line"))
    lines = bound(lines, "odd", line.rlike(ODD) | line.contains("  ") | line.startswith(" ") | line.endswith(" "))
    return bound(lines, "x", F.when(F.col("odd"), masked(line)).otherwise(line)).filter("x != ''")


def line_keys(docs: DataFrame, text_col: str, similarity: float = SIMILARITY) -> DataFrame:
    """(text_id, line_no, leaf, line_id, n_words, raw_id) of every line with a word, once for each different text.

    ``raw_id`` is set for lines of mostly variable fields: it stands for the line's words as they are.
    """
    x = F.col("x")
    fixed = F.size(F.filter(F.split(x, " "), lambda w: w != FIELD))
    raw_id = F.when(F.col("odd") & x.contains(FIELD), F.when(fixed < similarity * F.col("n_words"), digest(F.array_join(words(F.col("line")), " "))))
    found = bound(masked_lines(docs, text_col), "n_words", n_tokens(x))
    found = found.select("text_id", "line_no", _leaf(x, F.col("n_words")).alias("leaf"), digest(x).alias("line_id"), "n_words", raw_id.alias("raw_id"))
    return written(found.distinct(), "line-keys")


def _in_texts(keyed: DataFrame, keys: list[str], lines: DataFrame, min_texts: int, tag: str) -> DataFrame:
    """The ``keys`` whose lines are in ``min_texts`` different texts; ``keyed`` has (keys, line_id, n: the texts of the line).

    The greatest n and the sum of n bound the number from both sides; texts are counted only between the two.
    """
    bounds = written(keyed.groupBy(*keys).agg(F.max("n").alias("least"), F.sum("n").alias("most")).filter(F.col("most") >= min_texts), f"{tag}-bounds")
    # ``lines`` has a row for each line of a text
    doubtful = keyed.join(small(bounds.filter(F.col("least") < min_texts).select(*keys)), keys).select(*keys, "line_id").distinct()
    asked = written(doubtful, f"{tag}-doubtful")
    texts = lines.select("line_id", "text_id").join(small(asked), "line_id").select(*keys, "text_id").distinct()
    counted = texts.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= min_texts)
    out = written(bounds.filter(F.col("least") >= min_texts).select(*keys).unionByName(counted.select(*keys)), tag)
    discard(bounds, asked)
    return out


def recurring_lines(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(line_keys, templates): templates has (line_id, template) for the different lines of recurring templates.

    Lines of mostly variable fields that recur as they are have their ``raw_id`` as line_id, and no template.
    """
    lines = line_keys(docs, text_col, similarity)
    # one row for each different line, with the number of texts it is in
    counted = written(lines.select("leaf", "line_id", "text_id").distinct().groupBy("leaf", "line_id").agg(F.count("*").alias("n")), "counted")
    leaves = _in_texts(counted, ["leaf"], lines, min_texts, "leaves")
    candidates = counted.join(small(leaves), "leaf")
    # only lines of leaves that recur go on; equal lines meet in the aggregation before it shuffles
    every = masked_lines(docs, text_col).select(_leaf(F.col("x"), n_tokens(F.col("x"))).alias("leaf"), F.col("x").alias("line"))
    spelt = every.join(small(leaves), "leaf", "left_semi").groupBy("line").agg(F.lit(1).alias("one")).select(digest(F.col("line")).alias("line_id"), "line")
    named = written(candidates.join(spelt, "line_id").select("leaf", "line_id", "n", F.split("line", " ").alias("w")), "named")

    beyond = named.select("leaf", "line_id", "n", F.posexplode("w").alias("place", "token")).filter(f"place >= {DEPTH}")
    fixed = _in_texts(beyond.filter(F.col("token") != FIELD), ["leaf", "place", "token"], lines, min_texts, "fixed")
    kept = beyond.select("leaf", "place", "token", "line_id").join(fixed, ["leaf", "place", "token"]).groupBy("line_id").agg(F.array_sort(F.collect_list("place")).alias("fixed"))
    kept = written(kept, "kept")
    line = named.join(kept, "line_id", "left")

    def template(w: Column, places: Column) -> Column:
        # both arrays belong to one line; map look-ups would be as slow as a search, so fields are marked by difference
        free = F.array_except(F.sequence(F.lit(DEPTH), F.size(w) - 1), places)
        marked = F.transform(free, lambda k: F.struct(k.alias("k"), F.lit(FIELD).alias("t")))
        stays = F.transform(F.array_union(F.sequence(F.lit(0), F.least(F.size(w), F.lit(DEPTH)) - 1), places), lambda k: F.struct(k.alias("k"), F.get(w, k).alias("t")))
        return F.transform(F.array_sort(F.concat(marked, stays)), lambda x: x["t"])

    none = F.array().cast("array<int>")
    places = F.coalesce("fixed", none)
    line = line.withColumn("t", F.when(F.size("w") > DEPTH, let(F.col("w"), lambda w: let(places, lambda p: template(w, p)))).otherwise(F.col("w")))
    sure = F.size(F.filter("t", lambda x: x != FIELD))
    own = F.when(sure >= similarity * F.size("w"), F.col("t")).otherwise(F.col("w"))
    line = line.select("line_id", "n", own.alias("own")).filter(F.size(F.filter("own", lambda x: x != FIELD)) >= similarity * F.size("own"))
    line = written(line.select("line_id", "n", F.array_join("own", " ").alias("template")), "templates")
    often = _in_texts(line, ["template"], lines, min_texts, "often")
    equal = lines.filter("raw_id is not null").select("raw_id", "text_id").distinct().groupBy("raw_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_texts)
    equal = equal.select(F.col("raw_id").alias("line_id"), F.lit(None).cast("string").alias("template"))
    out = written(line.join(often, "template").select("line_id", "template").unionByName(equal), "recurring")
    discard(counted, leaves, named, fixed, kept, line, often)
    return lines, out


def marked(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of ``docs`` and ``__drop``: the numbers (from 0) of the lines to drop, null if none.

    Null and empty texts and an empty table have nothing to drop; repeated rows are marked alike. ``docs`` has no column
    ``__text``, ``__drop`` or ``__text_id``.
    """
    lines, recurring = recurring_lines(docs, text_col, min_texts, similarity)
    hits = lines.withColumn("line_id", F.coalesce("raw_id", "line_id")).join(small(recurring.select("line_id")), "line_id")
    per_text = written(hits.groupBy(F.col("text_id").alias("__text")).agg(F.collect_list("line_no").alias("__drop")), "drops")
    discard(lines, recurring)
    keyed = docs.withColumn("__text_id", digest(F.col(text_col).cast("string")))
    return reads(keyed.join(per_text, F.col("__text_id") == F.col("__text"), "left").drop("__text", "__text_id"), per_text)


def _without(text: Column, drop: Column) -> Column:
    """A text without the lines of the given numbers."""
    return let(text_lines(text), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), drop), lambda k: F.get(x, k)), "\n"))


def drop_recurring(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, **how) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of the texts; all rows and columns stay.

    A template recurs if its lines are in ``min_texts`` different texts or more, however many of them a text has. Equal
    texts count once, so exact copies alone drop nothing; a text of nothing but recurring lines is left without a word.
    Null texts stay null, empty texts empty; lines without a word are never dropped; an empty table stays empty.
    ``chars_col`` names a column that holds the length of the text and is set anew. ``docs`` may have columns of any name
    but ``__text``, ``__drop`` and ``__text_id``.
    """
    found = marked(docs, text_col, **how)
    rows = found.withColumn(text_col, F.when(F.col("__drop").isNotNull(), _without(F.col(text_col), F.col("__drop"))).otherwise(F.col(text_col)))
    if chars_col:
        rows = rows.withColumn(chars_col, F.when(F.col("__drop").isNotNull(), F.length(text_col)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return reads(rows.drop("__drop"), found)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: (id, n_lines, n_dropped, text_md5 of the text that is left; null stays null).

    A null text has no lines, an empty one has one line. Other columns are not read; null and repeated ids keep their rows.
    """
    rows = marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", **how)
    after = F.when(F.col("__drop").isNotNull(), _without(F.col("text"), F.col("__drop"))).otherwise(F.col("text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    return rows.select("id", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"), F.md5(after.cast("binary")).alias("text_md5"))
