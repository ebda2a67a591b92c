"""Quality rules: per-document base rules and cross-document line frequency.

Built from DataFrame functions only. The base figures of a document are computed
inside its row, so no text is shuffled. Lines are normalised and hashed; per
host, the distinct documents (by id) that hold each line are counted with
map-side partial sums. Lines above the host's limit count as removed, and a
document that loses most of its words is rejected.

Nulls and empty texts have no words and fail the base rules. A null host is a
host of its own. Repeated rows give one result row each, and count as one document if they share an id, as null
ids do. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, WORD, stored

_SPACES = " \t\n\x0b\x0c\r"
#: A host's frequent lines are joined in so many parts.
SALTS = 16


def base_figures(df: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    rest = [c for c in df.columns if c not in {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}]
    keep = [F.col(f"`{c}`") for c in rest]
    out = df.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    trimmed = F.btrim("__t", F.lit(_SPACES))
    out = out.select(
        "*",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")).alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    out = out.select(
        "*",
        F.size("__w").cast("long").alias("n_words"),
        F.when(
            F.size("__w") > window,
            F.transform(F.sequence(F.lit(1), F.size("__w") - (window - 1)), lambda i: F.xxhash64(F.slice("__w", i, window))),
        ).alias("__h"),
    )
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    out = out.withColumn(
        "__s", F.when(repeats, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    out = out.withColumn("__p", F.sort_array(F.transform(F.filter("__s", _beside), lambda e: e["i"])))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end")),
        lambda a: a["n"],
    )
    return out.select(
        *keep,
        "n_words",
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _beside(e: Column, j: Column) -> Column:
    """Whether a neighbour in the sorted windows is equal; a missing one is not."""
    equal = lambda k: F.coalesce(e["h"] == F.get("__s", k)["h"], F.lit(False))
    return equal(j - 1) | equal(j + 1)


def line_counts(text: Column) -> Column:
    """The lines with a word as an array of (line, words): each normalised line's hash and all its words in the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.transform(
        lines, lambda x: F.struct(F.xxhash64(F.lower(F.btrim(x, F.lit(_SPACES)))).alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"))
    )


def frequent_lines(docs: DataFrame, min_line_docs: int, max_line_docs: int, line_percent: int) -> DataFrame:
    """(host, line) of the lines beyond their host's limit, from rows (doc, host, lines).

    Documents are counted by id. Lines that a document repeats are made one before the shuffle, and counts
    are partly summed before theirs, so a line of all documents costs a row for each task."""
    held = docs.select("host", "doc", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("line_docs")).filter(F.col("line_docs") >= min_line_docs)
    hosts = docs.select(F.col("host").alias("of"), "doc").distinct().groupBy("of").agg(F.count(F.lit(1)).alias("host_docs"))
    much = (F.col("line_docs") >= max_line_docs) | (100 * F.col("line_docs") >= line_percent * F.col("host_docs"))
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).filter(much).select("host", "line")


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 20, max_repeat_percent: int = 30,
    min_line_docs: int = 10, max_line_docs: int = 100, line_percent: int = 1, min_left_percent: int = 50,
) -> DataFrame:
    """The base figures, ``n_removed_words``, ``base_failed`` and ``kept`` of each row.

    A line is removed on a host if at least ``min_line_docs`` of its documents hold it, and they are
    ``line_percent`` of them or ``max_line_docs``, whichever is less. So the limit grows with small hosts and stands still
    on large ones. A document is depleted if fewer than ``min_left_percent`` of its words are left.

    Texts are read and parsed once: figures and line hashes go to a table, and the rest works on that.
    """
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    source = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("body"), F.col(f"`{host}`").cast("string").alias("host"))
    docs = stored(base_figures(source, "body").select(
        "doc", "host", *figures, line_counts(F.coalesce("body", F.lit(""))).alias("lines"), F.monotonically_increasing_id().alias("row")
    ))
    common = frequent_lines(docs, min_line_docs, max_line_docs, line_percent).select(
        F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("none"), F.col("line").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    rows = docs.select("row", F.coalesce("host", F.lit("")).alias("rh"), F.col("host").isNull().alias("rn"), F.inline("lines")).withColumn("rs", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    same = (F.col("rh") == F.col("h")) & (F.col("rn") == F.col("none")) & (F.col("line") == F.col("l")) & (F.col("rs") == F.col("salt"))
    removed = rows.join(common, same).groupBy(F.col("row").alias("of_row")).agg(F.sum("words").alias("removed"))
    joined = docs.drop("lines", "host").join(removed, F.col("row") == F.col("of_row"), "left").withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_removed_words")) >= min_left_percent * F.col("n_words")
    return joined.select(F.col("doc").alias(id_col), *figures, failed.alias("base_failed"), (~failed & left).alias("kept"), "n_removed_words")
