"""Line dedup: hashes in range partitions, sorted within by document and position, leave run-length keep bitmaps."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import text_or_empty, written

#: a key that holds more than this part of all lines is hot and cut into slices of about that part
SLICES = 4096
#: items that the search for hot keys keeps in memory
TRACKED = 65_536
EDGE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without blanks at both ends, A-Z folded."""
    bare = F.trim(line, F.lit(EDGE))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(doc, mark, pos, h1, h2): a row for each line whose key has at least `least` code points. `mark` is a hash
    of the whole text and tells rows of one id apart; (h1, h2) is a 128-bit hash of the key."""
    text = text_or_empty(text_col)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = rows.select("doc", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select("doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _hot(lines: DataFrame) -> DataFrame:
    """(h1, slices) of the keys that may hold more than 1/SLICES of all lines: at most SLICES rows. Which keys
    are found only decides how work is dealt, never a result."""
    top = lines.agg(F.expr(f"approx_top_k(h1, {SLICES}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    item = top.select("n", F.explode("top").alias("t")).where(F.col("t.count") * SLICES > F.col("n"))
    return item.select(F.col("t.item").alias("h1"), F.ceil(F.col("t.count") * SLICES / F.col("n")).alias("slices"))


def dropped_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(doc, mark, pos) of the lines whose key stands in at least `least_docs` documents, this one not being the
    largest of them.

    Lines are range-partitioned by (hash, slice) and sorted by document, largest first, and position, so that
    the first row of each run is the occurrence to keep. Only hot keys have more than one slice; what their
    slices found is put together on one row per key."""
    hot = written(_hot(lines), "lines-hot")
    dealt = lines.join(F.broadcast(hot), "h1", "left").withColumn("slice", F.pmod(F.xxhash64("doc"), F.coalesce("slices", F.lit(1))))
    dealt = dealt.repartitionByRange("h1", "h2", "slice").sortWithinPartitions("h1", "h2", "slice", F.desc("doc"), "pos")
    run = Window.partitionBy("h1", "h2", "slice")
    ranked = dealt.withColumn("rank", F.dense_rank().over(run.orderBy(F.desc("doc")))).withColumn("docs", F.max("rank").over(run))
    some = ranked.where(F.col("slices").isNotNull() | ((F.col("docs") >= least_docs) & (F.col("rank") > 1)))
    some = written(some.select("doc", "mark", "pos", "h1", "h2", "slice", "slices", "docs"), "lines-ranked")
    whole = some.where("slices is not null").groupBy("h1", "h2", "slice").agg(F.max("doc").alias("top"), F.max("docs").alias("docs"))
    # one row for each hot key, of which there are at most SLICES
    whole = whole.groupBy("h1", "h2").agg(F.max("top").alias("top"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    sliced = some.where("slices is not null").drop("docs").join(F.broadcast(whole), ["h1", "h2"]).where("doc <> top")
    return some.where("slices is null").select("doc", "mark", "pos").unionByName(sliced.select("doc", "mark", "pos"))


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, least_docs: int = 3) -> DataFrame:
    """(doc, mark, drops) of every document that loses lines: the keep bitmap in run lengths, `drops` being the
    runs (at, n) of lost lines in order, lines counted from 0; all other lines stay."""
    gone = dropped_lines(written(line_hashes(df, id_col, text_col, least), "lines-hashes"), least_docs)
    # rows that repeat id and text have the same positions: equal ranks, one run
    run = Window.partitionBy("doc", "mark").orderBy("pos")
    runs = gone.withColumn("run", F.col("pos") - F.dense_rank().over(run)).groupBy("doc", "mark", "run").agg(F.min("pos").alias("at"), F.max("pos").alias("last"))
    return runs.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("last") - F.col("at") + 1).alias("n")))).alias("drops"))


def kept_text(lines: Column, drops: Column) -> Column:
    """The lines outside the runs of `drops`, joined by line feeds."""
    def piece(i: Column) -> Column:
        before = F.get(drops, i - 1)
        start = F.coalesce(before["at"] + before["n"], F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(F.get(drops, i)["at"], F.size(lines)) - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), piece)), "\n")


def without_common_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, least_docs: int = 3) -> DataFrame:
    """(id, n_lines, n_dropped, kept_text) of every row: lines are what stands between line feeds; lines whose key
    (no blanks at the ends, A-Z folded) has at least `least` code points and stands in at least `least_docs`
    documents go from all but the largest id that holds it, and there all of them stay.

    A null or empty text is one empty line. Documents are counted by id, so rows that share an id count once,
    and each keeps or loses lines of its own text. Rows without an id are not counted and lose nothing. A text of
    any length is one row; an empty table gives no rows; other columns are not read."""
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    maps = keep_bitmaps(df, id_col, text_col, least, least_docs).select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"), "drops")
    out = rows.join(maps, (F.col("id") == F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left").withColumn("lines", F.split("text", "\n"))
    lost = F.aggregate("drops", F.lit(0), lambda n, d: n + d["n"])
    return out.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept_text(F.col("lines"), F.col("drops"))).alias("kept_text"))
