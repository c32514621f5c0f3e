"""Quality rules: per-document measures, and lines that many documents of one host share.

Normalised lines (ASCII lower case, white space as one space, trimmed) are hashed, and the distinct documents of
each host (the column source) that hold a line are counted; documents of the same text count once, so exact copies make
no line frequent. The limit is a count, whatever the size of the host, so a line of a small share of a large host is
caught too. A line above the limit is removed from every text of the host; a document that loses more than a set
share of its words is depleted and rejected.

Defined results: a null text has no words and fails; a null host is the host ""; null and repeated doc_ids are judged
row by row; an empty table gives no rows; other columns are kept, whatever their names, but for those that have the
name of a measure of judge(), which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.store import aside, restored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_WORDS, REPEAT_SHARE = 50, 0.5
#: A line is removed beyond so many documents of its host.
LINE_DOCS = 20
#: Keys over which the rows of one frequent line are dealt.
SALTS = 16
#: A document is depleted when it loses more than this share of its words.
DEPLETED = 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(line, UPPER, LOWER), SPACE, " "))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable isn't expanded where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(grams: Column) -> Column:
    """Words covered by 3-word windows whose hash occurs twice or more."""

    def among(order: Column) -> Column:
        same = lambda x, j: (x["h"] == F.get(order, j - 1)["h"]) | (x["h"] == F.get(order, j + 1)["h"])
        starts = F.array_sort(F.transform(F.filter(order, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
        return _let(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return _let(F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), among)


def repeated_words(word_list: Column) -> Column:
    """word_list: an array expression, evaluated once."""

    def over(w: Column) -> Column:
        grams = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.size(w) - 2)
        # most texts repeat no window; only others are sorted
        own = _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(own)

    return _let(word_list, over)


def measures(rows: DataFrame) -> DataFrame:
    """rows (text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, SPACE, "") != "")
    both = _let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    dup = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = rows.withColumns(
        {
            "both": both,
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": dup.cast("long"),
        }
    )
    out = out.withColumns({"n_words": F.col("both.n"), "n_repeat_words": F.col("both.r")}).drop("both")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words")))


OWN = ("doc_id", "source", "text")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed", "clean_words", "clean_digest")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, text and REST of docs, with id and row, a key that rows of one doc_id, source and text share."""
    rows = aside(docs, OWN).withColumns({"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "text": F.col("text").cast("string")})
    return rows.withColumns({"id": F.coalesce("doc_id", F.lit(-1).cast("long")), "row": F.xxhash64("doc_id", "source", "text")})


def line_digest(line: Column) -> Column:
    """The first 32 bits of a line's MD5; sums of them tell which lines a text has, in whatever order."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def removed_words(rows: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """id, row, removed, digest, gone: words, digests and hashes of each row's lines above the limit; only rows that have any."""
    text, host = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    line = lambda x: _let(normalised(x), lambda y: F.struct(line_digest(x).alias("digest"), F.xxhash64(y).alias("line"), F.when(y == "", 0).otherwise(F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("n")))
    lines = rows.select("id", "row", host.alias("host"), F.xxhash64(text).alias("doc"), F.explode(F.transform(F.split(text, "\n", -1), line)).alias("l"))
    real = lines.select("id", "row", "host", "doc", "l.line", "l.n", "l.digest").where("n > 0")
    frequent = real.groupBy("host", "line").agg(F.count_distinct("doc").alias("docs")).where(F.col("docs") > line_docs).select("host", "line")
    # a frequent line is the hottest key there is: its rows are dealt to SALTS keys, to each of which it is sent
    real = real.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    frequent = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = real.join(frequent, ["host", "line", "salt"]).groupBy("id", "row").agg(F.sum("n").alias("removed"), F.sum("digest").alias("digest"), F.collect_set("line").alias("gone"))
    # rows that repeat share a key: what their lines add up to is shared out among them
    count = rows.groupBy("id", "row").agg(F.count("*").alias("rows"))
    return hit.join(count, ["id", "row"]).select("id", "row", *[(F.col(x) / F.col("rows")).cast("long").alias(x) for x in ("removed", "digest")], "gone")


def _judged(docs: DataFrame, depleted: float, line_docs: int) -> DataFrame:
    """_keyed(docs) with the measures and gone, the hashes of the row's frequent lines (null if it has none)."""
    rows = _keyed(docs)
    all_lines = F.aggregate(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_digest), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = measures(rows).withColumn("whole", all_lines).join(removed_words(rows, line_docs), ["id", "row"], "left")
    rows = rows.withColumn("removed", F.coalesce("removed", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("removed")
    # what all lines come to is summed before the join, so a digest of the text left moves no text
    kept = ~F.col("base_failed") & (F.col("removed") <= depleted * F.col("n_words"))
    return rows.withColumns({"clean_words": left, "clean_digest": F.col("whole") - F.coalesce("digest", F.lit(0)), "kept": kept})


def _without_lines() -> Column:
    left = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(normalised(x))))
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))


def judge(docs: DataFrame, depleted: float = DEPLETED, line_docs: int = LINE_DOCS) -> DataFrame:
    """Every row of docs, its text without lines above the limit, and MEASURES: of the text as it was, but for removed
    (words of the lines taken out), clean_words (words left) and clean_digest (sum of the line digests of the text left)."""
    rows = _judged(docs, depleted, line_docs).withColumn("text", _without_lines())
    return restored(rows, docs, OWN, MEASURES)


def clean(docs: DataFrame, depleted: float = DEPLETED, line_docs: int = LINE_DOCS) -> DataFrame:
    """The kept rows of docs, their text without lines above the limit; other texts stay as they are."""
    rows = _judged(docs, depleted, line_docs).where("kept").withColumn("text", _without_lines())
    return restored(rows, docs, OWN)


def report(docs: DataFrame) -> DataFrame:
    out = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"))
    return out.select("doc_id", *MEASURES)
