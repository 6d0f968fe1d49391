"""Problem 1: cutting oversized files into pieces at natural boundaries.

The cut is one bounded-quantifier regular expression. Its alternatives stand in the order of the strength of the
boundary they end at, each takes as much as the limit allows, and the last one takes bare characters, so that
successive matches cover the text without a gap. A piece is such a match preceded by the last ``overlap`` characters
of the match before it (the look-back), so its length stays within ``max_chars``; dropping the look-back of each piece
and joining the rest gives the file again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import extension

#: Words and marks that open a declaration in the languages at hand.
DECLARATION = (
    r"(?:export|import|class|interface|function|def|async|public|private|protected|internal|static|abstract|final|sealed"
    r"|namespace|package|enum|type|struct|record|const|module|declare|/\*\*|///|@\w|\[\w)"
)
#: Half of the room must be filled before a cut at a declaration or blank line is preferred to a later plain line.
FILL_NUMERATOR, FILL_DENOMINATOR = 1, 2
#: Pieces whose running sums are added up together.
BLOCK = 64

LINE = r"(?<=\n|\r(?!\n))"
BLANK = r"(?<=\n[ \t]{0,40}\r?\n)"
NOT_IN_CRLF = r"(?!(?<=\r)\n)"


def cut_pattern(room: Column) -> Column:
    """The expression for pieces of at most ``room`` characters, as a column."""
    least = F.greatest(F.lit(1), F.floor(room * FILL_NUMERATOR / FILL_DENOMINATOR).cast("int"))
    full, part = F.concat(F.lit(".{1,"), room.cast("string"), F.lit("}")), F.concat(F.lit(".{"), least.cast("string"), F.lit(","), room.cast("string"), F.lit("}"))
    alternatives = [
        F.concat(full, F.lit(r"+\z")),  # the rest of the file
        F.concat(part, F.lit(BLANK + r"(?=" + DECLARATION + r")")),  # a blank line before a declaration at the margin
        F.concat(part, F.lit(BLANK + r"(?=[ \t]{1,8}" + DECLARATION + r")")),  # a blank line before a member
        F.concat(part, F.lit(LINE + r"(?=[ \t]{0,8}" + DECLARATION + r")")),  # a line that opens a declaration
        F.concat(part, F.lit(BLANK)),
        F.concat(full, F.lit(LINE)),
        F.concat(part, F.lit(r"(?<=[\s;,{}])" + NOT_IN_CRLF)),  # within an overlong line: a blank or mark
        F.concat(full, F.lit(NOT_IN_CRLF)),  # characters
        F.lit("."),
    ]
    return F.concat(F.lit("(?s)(?:"), F.concat_ws("|", *alternatives), F.lit(")"))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with one more column, computed once: a generator of one row keeps the optimizer from copying it into later uses,
    and into lambdas, where it would be computed for each element."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def running_sums(df: DataFrame, array: str, name: str) -> DataFrame:
    """``df`` with the lengths of what stands before each element: by blocks of :data:`BLOCK`, so that no long array is copied for each element."""

    def sums(xs, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    df = once(df, "_lengths", F.transform(array, F.length))
    n = F.size("_lengths")
    df = once(df, "_blocks", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))), lambda b: F.slice("_lengths", b * BLOCK + 1, BLOCK)))
    df = once(df, "_totals", F.transform("_blocks", lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)))
    before = F.slice(sums("_totals", F.lit(0)), F.lit(1), F.size("_totals"))
    inner = F.flatten(F.zip_with("_blocks", before, lambda b, start: F.slice(sums(b, start), F.lit(1), F.size(b))))
    return once(df, name, inner).drop("_lengths", "_blocks", "_totals")


def split_files(files: DataFrame, limits: DataFrame, *, id_col: str = "file_id", path_col: str = "path", content_col: str = "content", with_pieces: bool = True) -> DataFrame:
    """One row per file: ``(id, max_chars, n_chars, longest_line, n_pieces, pieces)``; without ``pieces`` if only their number is wanted.

    ``pieces`` is an array of ``(piece_no, start_char, shared, piece)``: ``start_char`` (from 0) is where the piece's
    own text begins, ``shared`` the number of leading characters that repeat the end of the text before.

    ``limits`` has one row per extension (``ext``, ``max_chars``, ``overlap_chars``); it is broadcast, being bounded by
    the number of file types. Null content gives an empty array, empty content and content within its limit one piece,
    content of an unlisted or missing extension one piece whatever its length. An ``overlap_chars`` that is null,
    negative or not below ``max_chars`` counts as 0, a ``max_chars`` that is null or below 1 as no limit. Repeated ids
    give repeated rows. Other columns of either table are ignored.
    """
    lim = limits.select(F.lower("ext").alias("_ext"), F.col("max_chars").cast("int").alias("_max"), F.col("overlap_chars").cast("int").alias("_over")).where("_max >= 1 and _ext is not null")
    lim = lim.groupBy("_ext").agg(F.min(F.struct("_max", "_over")).alias("_l")).select("_ext", "_l.*")
    lim = lim.withColumn("_over", F.when((F.col("_over") > 0) & (F.col("_over") < F.col("_max")), F.col("_over")).otherwise(0))
    lim = lim.withColumn("_pattern", cut_pattern(F.col("_max") - F.col("_over")))
    df = files.select(F.col(id_col).alias("_id"), F.col(content_col).alias("_text"), extension(F.col(path_col)).alias("_ext"))
    df = df.join(F.broadcast(lim), "_ext", "left").withColumn("_n", F.length("_text"))
    cores = F.when(F.col("_n") > F.col("_max"), F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))).when(F.col("_text").isNotNull(), F.array("_text")).otherwise(F.array().cast("array<string>"))
    # a one-row generator, so that no later filter makes the optimizer copy the expression and run it again
    df = once(df, "_cores", cores)
    # starts: running sums of the lengths; shared: the end of the match before
    if with_pieces:
        df = running_sums(df, "_cores", "_starts")

    def piece(core: Column, i: Column) -> Column:
        before = F.when(i > 0, F.col("_cores")[i - 1]).otherwise(F.lit(""))
        back = F.when(F.coalesce(F.col("_over"), F.lit(0)) > 0, F.right(before, F.col("_over"))).otherwise(F.lit(""))
        return F.struct(i.alias("piece_no"), F.col("_starts")[i].alias("start_char"), F.length(back).alias("shared"), F.concat(back, core).alias("piece"))

    lines = F.when(F.col("_n") > F.col("_max"), F.array_max(F.transform(F.split("_text", r"\r\n|\n|\r"), F.length))).alias("longest_line")
    pieces = [F.transform("_cores", piece).alias("pieces")] if with_pieces else []
    return df.select(F.col("_id").alias(id_col), F.col("_max").alias("max_chars"), F.col("_n").alias("n_chars"), lines, F.size("_cores").alias("n_pieces"), *pieces)


def explode_pieces(split: DataFrame, id_col: str = "file_id") -> DataFrame:
    """One row per piece: ``(id, piece_no, start_char, shared, piece)``."""
    return split.select(id_col, F.inline("pieces"))


def oversized(split: DataFrame, id_col: str = "file_id") -> DataFrame:
    """The files that had to be cut: ``(id, long_line)``, each id once; ``long_line`` is 1 if a single line is over the limit."""
    return (
        split.where(F.col("n_pieces") > 1)
        .groupBy(id_col)
        .agg(F.max(F.when(F.col("longest_line") > F.col("max_chars"), 1).otherwise(0)).cast("int").alias("long_line"))
    )
