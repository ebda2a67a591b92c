"""Line dedup by levelled sorted runs of line hashes.

Built from DataFrame functions only. A run is a table of (two line hashes, number
of documents, largest document id), bucketed by the hashes and sorted within each bucket. Documents come in
batches from the largest id down. A batch's lines are counted, keys that are settled, as enough documents hold them, are
merge-anti-joined out, the counts of the others go on from what the runs say, by one merge join, and the batch adds its own run at level 0.
A level that holds ``fanout`` runs is merged into one run of the next level. Runs have the number of buckets that the
session's shuffles have, so neither joining nor merging moves them.

All runs are partitions of one bucketed table besides, so that one scan brings the rows of a bucket together from any number of
runs: merging them is one aggregate, which makes a row for each key however many runs there are, and a batch takes part in two joins
however many runs came before.

The rule needs more than a feed's: a line goes from earlier batches, too, once a later one settles it. As the
batch with a key's largest id comes first, a settled key names the document that keeps it, and one join of the lines with
the settled keys corrects all batches. Only hashes and positions are shuffled for this; texts move once, to meet the
positions that they lose.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hidden, remove, shared_dir, stored

_SPACES = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line's documents are joined in so many parts, so that no line makes a large task.
SALTS = 16


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(_SPACES))
    # lower() also changes other letters; only ASCII text can take it
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


class LineRuns:
    """Levelled sorted runs under a shared folder.

    Holds only the runs' names on the driver. With ``settle``, keys that so many documents hold are settled: batches must come
    from the largest document id down then, and add nothing to them. Without, batches may come in any order.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 3, settle: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout, self.settle, self.path = spark, fanout, settle, path or shared_dir(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.names: list[str] = []
        self.whole: str | None = None

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.names.append(name)
        writer = df.select("k1", "k2", "n_docs", "last_doc").write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}")
        writer.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").saveAsTable(name)
        if self.whole is None:
            self.whole = f"line_runs_{uuid.uuid4().hex}"
            columns = "k1 BIGINT, k2 BIGINT, n_docs BIGINT, last_doc BIGINT, run STRING"
            clustered = f"PARTITIONED BY (run) CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE {self.whole} ({columns}) USING parquet {clustered} LOCATION '{self._quoted(self.whole)}'")
        self.spark.sql(f"ALTER TABLE {self.whole} ADD PARTITION (run = '{name}') LOCATION '{self._quoted(name)}'")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _quoted(self, name: str) -> str:
        return f"{self.path}/{name}".replace("\\", "\\\\").replace("'", "\\'")

    def add(self, keys: DataFrame) -> None:
        """Adds the (k1, k2, doc) rows of a batch of documents that no other batch has."""
        own = keys.select("k1", "k2", "doc").distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))
        names = self._runs()
        if names:
            at = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))
            past = self._merge(names).select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("n_docs").alias("n"), F.col("last_doc").alias("last"))
            if self.settle is not None:
                own = own.join(past.filter(F.col("n") >= self.settle).select("r1", "r2").hint("merge"), at, "left_anti")
            own = own.join(past.hint("merge"), at, "left")
            own = own.select("k1", "k2", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))
        self._write(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            gone, self.levels[level] = self.levels[level], []
            self._write(merged, level + 1)
            for name in gone:
                self._drop(name)
            level += 1

    def _merge(self, names: list[str]) -> DataFrame:
        """A row for each key of the runs. Counts of a run go on from those before, so the largest says all."""
        rows = self.spark.table(self.whole).filter(F.col("run").isin(names))
        return rows.groupBy("k1", "k2").agg(F.max("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def _runs(self) -> list[str]:
        """All runs, from the oldest on: higher levels hold older batches."""
        return [name for level in reversed(self.levels) for name in level]

    def tally(self) -> DataFrame:
        """Every key with its number of documents and largest document id; of settled keys, as of the batch that settled them."""
        names = self._runs()
        if not names:
            return self.spark.createDataFrame([], "k1 long, k2 long, n_docs long, last_doc long")
        return stored(self._merge(names))

    def admit(self, lines: DataFrame) -> DataFrame:
        """The rows (k1, k2, doc, ...) of a new batch whose keys no earlier batch has, and adds the batch's run.

        This is the rule for a feed, where a line stays with the first batch that brings it. The rows are written, as
        the runs that they were held against go on changing."""
        runs = self.tally().select(F.col("k1").alias("r1"), F.col("k2").alias("r2"))
        fresh = stored(lines.join(runs, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left_anti"))
        self.add(lines)
        return fresh

    def _drop(self, name: str) -> None:
        self.names.remove(name)
        self.spark.sql(f"ALTER TABLE {self.whole} DROP PARTITION (run = '{name}')")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        """Removes all runs."""
        for name in list(self.names):
            self._drop(name)
        if self.whole is not None:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.whole}")
            remove(self.spark, f"{self.path}/{self.whole}")
        self.levels, self.whole = [], None

    def split(self, lines: DataFrame, min_docs: int, how: str) -> DataFrame:
        """Of rows (k1, k2, doc, ...), those that go ("left_semi") or stay ("left_anti")."""
        return split(self.tally().filter(F.col("n_docs") >= min_docs), lines, how)


def split(settled: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """Of rows (k1, k2, doc, ...), those that go ("left_semi") or stay ("left_anti") by the settled keys."""
    common = settled.select(
        F.col("k1").alias("r1"), F.col("k2").alias("r2"), "last_doc", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("r3")
    )
    salted = lines.withColumn("k3", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    at = (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("k3") == F.col("r3")) & (F.col("doc") < F.col("last_doc"))
    return salted.join(common, at, how).drop("k3")


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batch_docs: int = 1 << 16,
    least_batches: int = 2, most_batches: int = 16, fanout: int = 3,
) -> DataFrame:
    """Drops lines that ``min_docs`` documents hold from all but the largest id.

    There is a batch for each ``batch_docs`` documents, within the least and the most number of batches: batches follow each
    other, so in a large table they are larger, and not more. They are cut at quantiles of the ids.

    Returns the table with ``text`` changed and with ``n_lines`` (before) and
    ``n_dropped``; columns of these names are replaced. Lines are the parts
    between \\n; those whose key has fewer than ``min_chars`` code points stay. A
    null text counts as one empty line and becomes an empty text. Rows of one id
    count as one document and are cut alike; null ids count as one document, smaller than
    any other. An empty table stays empty.
    """
    spark = df.sparkSession
    rest = [c for c in df.columns if c not in {"n_lines", "n_dropped", text}]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))
    keys = F.transform(F.split(body, "\n"), lambda x: line_key(x))
    long_keys = F.filter(
        F.transform(keys, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(1), k).alias("k2"), i.alias("pos")))),
        lambda x: x.isNotNull(),
    )
    n_docs = df.count()
    n_batches = min(most_batches, max(least_batches, -(-n_docs // batch_docs)))
    ids = df.select(doc.alias("doc"))
    edges = ids.agg(F.percentile_approx("doc", [i / n_batches for i in range(1, n_batches)], 10_000)).first()[0] if n_batches > 1 else None
    batch = sum([(F.col("doc") > e).cast("int") for e in sorted({*(edges or [])})], F.lit(0))
    lines = stored(
        df.select(doc.alias("doc"), F.xxhash64(body).alias("t"), F.explode(long_keys).alias("x"))
        .select("doc", "t", "x.k1", "x.k2", "x.pos", batch.alias("batch")),
        ["batch"],
    )
    runs = LineRuns(spark, fanout=fanout, settle=min_docs)
    for b in reversed(range(n_batches)):
        runs.add(lines.filter(F.col("batch") == b).select("k1", "k2", "doc"))
    settled = runs.tally().filter(F.col("n_docs") >= min_docs)
    runs.drop()
    lost = split(settled, lines.drop("batch"), "left_semi").groupBy("doc", "t").agg(F.collect_set("pos").alias("lost"))
    joined = df.select(*hidden(rest), body.alias("__body"), doc.alias("__doc"), F.xxhash64(body).alias("__t")).join(
        lost.hint("shuffle_hash"), (F.col("__doc") == F.col("doc")) & (F.col("__t") == F.col("t")), "left"
    )
    parts = joined.withColumn("__lines", F.split("__body", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "lost")
    changed = F.when(F.col("lost").isNull(), F.col("__body")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    return parts.select(
        *[F.col(f"r_{rest.index(c)}").alias(c) if c != text else changed.alias(text) for c in df.columns if c in {*rest, text}],
        F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
