"""Removal of repeated passages by overlapping windows of three consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, salted_join, table

WINDOW = 3
#: A line of these alone is blank.
BLANK = " \t\x0b\x0c\r"


def _once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Of rows (__row, __id, __th) that share an id and text the first, and the others, None if there are none.

    Equal rows are counted before anything is exchanged, so it does not matter how many there are.
    """
    keyed = rows.withColumn("__ih", F.xxhash64("__id"))
    keys = ["__ih", "__th"]
    counts = cut(keyed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"))
    if counts.isEmpty():
        return rows, None
    marked = salted_join(keyed, counts.withColumn("__twice", F.lit(True)).drop("n"), keys, hot_keys(counts, keys, "n"), F.monotonically_increasing_id(), "left")
    groups = cut(marked.where("__twice").groupBy("__row", "__id", "__th").agg(F.count("*").alias("__n")))
    first = groups.groupBy(F.col("__id").alias("__fid"), F.col("__th").alias("__fth")).agg(F.min("__row").alias("__first"))
    both = groups.join(first, F.col("__id").eqNullSafe(F.col("__fid")) & F.col("__th").eqNullSafe(F.col("__fth")))
    is_first = F.col("__row").eqNullSafe(F.col("__first"))
    one = both.where(is_first).select(*rows.columns)
    more = both.withColumn("__n", F.col("__n") - is_first.cast("long")).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    return marked.where("__twice IS NULL").select(*rows.columns).unionByName(one), more.select(*rows.columns)


def dedup_line_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """df with the lines dropped from the text that lie in a later occurrence of a repeated window.

    Lines are what \\n separates. Every run of `window` lines that isn't all blank is a window; two windows are
    the same if their lines are the same. Of the occurrences of a window, in any documents or the same one, the
    first by (id, text hash, line number) stays; the lines that the others cover are dropped, overlapping
    windows merged. A dropped line so always has an earlier copy that stays.

    Adds n_lines and n_removed (long; input columns of these names are replaced). A null text stays null, with
    0 lines; texts of fewer lines than the window stay as they are; very long ones are read whole; of rows with the same
    id and text one, the first by its other columns, is the document and the others are later occurrences from their
    first line to their last; a null id is an id that sorts first. All other columns are kept.
    """
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.xxhash64(F.col(f"`{text_col}`")).alias("__th"),
    )
    lines = F.split(F.col(f"__row.`{text_col}`"), "\n").alias("__lines")  # only the text itself is exchanged
    rows, again = _once(rows)

    def at(i):
        lines = [F.get("__lines", i + k) for k in range(window)]
        return F.struct(
            F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(1), *lines).alias("h2"), i.cast("int").alias("at"),
            (F.btrim(F.concat_ws("", *lines), F.lit(BLANK)) != "").alias("solid"),
        )

    whole = F.transform(F.sequence(F.lit(0), F.size("__lines") - window), at)
    windows = (
        rows.select("__id", "__th", lines).where(F.size("__lines") >= window)
        .select("__id", "__th", F.inline(whole))
        .where("solid").drop("solid")
        .withColumn("__me", F.struct("__id", "__th", "at"))
    )
    repeated = cut(windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("__me").alias("__first")).where("n > 1"))
    later = salted_join(windows, repeated.drop("n"), ["h1", "h2"], hot_keys(repeated, ["h1", "h2"], "n"), F.col("__me")).where("__me != __first")
    covered = later.groupBy(F.col("__id").alias("__cid"), F.col("__th").alias("__cth")).agg(F.collect_set("at").alias("__starts"))
    joined = rows.join(covered, F.col("__id").eqNullSafe(F.col("__cid")) & (F.col("__th") == F.col("__cth")), "left").withColumn("__lines", lines)
    if again is not None:  # every window of theirs occurs before
        starts = F.when(F.size("__lines") >= window, F.transform(F.filter(whole, lambda w: w["solid"]), lambda w: w["at"]))
        theirs = again.withColumn("__lines", lines)
        joined = joined.select("__row", "__lines", "__starts").unionByName(theirs.select("__row", "__lines", F.when(F.size(starts) > 0, starts).alias("__starts")))
    n = F.greatest(F.size("__lines"), F.lit(0))  # size of null is -1 or null
    gone = F.flatten(F.transform("__starts", lambda s: F.array(*[s + k for k in range(window)])))
    left = F.when(F.col("__starts").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone))
    cleaned = joined.withColumn("__left", left)
    text = F.when(F.col("__left").isNull(), F.col(f"__row.`{text_col}`")).otherwise(F.array_join(F.transform("__left", lambda i: F.get("__lines", i)), "\n"))
    return cleaned.select(
        *[text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in keep],
        F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__lines") - F.size("__left"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_line_windows(docs).select("doc_id", "text", "n_lines", "n_removed")


#: The rows of dedup_line_windows over a relation `{docs}` of distinct doc_id.
LINES_SQL = r"""
  lined AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM {docs}),
  wins AS (SELECT doc_id, pos, line || chr(10) || lead(line) OVER d || chr(10) || lead(line, 2) OVER d AS win
           FROM lined WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
  later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth
            FROM wins WHERE win IS NOT NULL AND trim(replace(win, chr(10), ''), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') WHERE nth > 1),
  gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS o(k)),
  kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
                  count(*) AS n_lines, count(g.pos) AS n_removed
           FROM lined l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
"""

QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {
    "op10_line_dedup": "WITH" + LINES_SQL.format(docs="documents")
    + "SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed FROM documents d LEFT JOIN kept k USING (doc_id)"
}
