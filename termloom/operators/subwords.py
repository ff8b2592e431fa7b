"""Subwords of a vocabulary, by the longest match first.

A term is cut from its start into the longest pieces that the vocabulary holds; a piece
that is not at the start is written with ``##`` before it. A term that cannot be cut to its
end, or has more than ``max_chars`` characters, is unknown and has no row. Nulls and
repeated terms have none of their own either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 100


def pieces(terms: DataFrame, vocabulary: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """(term, pieces, ids) of the distinct known terms, for a vocabulary (piece, id) of distinct pieces.

    Every term is joined with the vocabulary by its substrings up to the longest piece, one
    number that comes to the driver; only the longest match of a place meets the cutting.
    """
    longest = vocabulary.select(F.max(F.length(F.regexp_replace("piece", "^##", "")))).first()[0] or 0
    n = F.length("term")
    own = terms.select("term").distinct().filter((n > 0) & (n <= max_chars))
    placed = own.select("term", F.explode(F.sequence(F.lit(1), n)).alias("start"))
    sized = placed.select("term", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), n - F.col("start") + 1))).alias("size"))
    mark = F.when(F.col("start") > 1, F.lit("##")).otherwise(F.lit(""))
    asked = sized.withColumn("piece", F.concat(mark, F.col("term").substr(F.col("start"), F.col("size"))))
    found = asked.join(vocabulary.select("piece", F.col("id").cast("long").alias("id")), "piece")
    best = found.groupBy("term", "start").agg(F.max(F.struct("size", "piece", "id")).alias("best"))
    steps = best.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("start", "best"))).alias("steps"))
    state = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("pieces"), F.array().cast("array<bigint>").alias("ids"))

    def step(s, x):
        taken = F.struct((s["next"] + x["best"]["size"]).alias("next"), F.concat(s["pieces"], F.array(x["best"]["piece"])).alias("pieces"), F.concat(s["ids"], F.array(x["best"]["id"])).alias("ids"))
        return F.when(x["start"] == s["next"], taken).otherwise(s)

    cut = steps.select("term", F.aggregate("steps", state, step).alias("cut"))
    return cut.filter(F.col("cut.next") == n + 1).select("term", "cut.pieces", "cut.ids")


def encoded(token_rows: DataFrame, vocabulary: DataFrame, key: str, max_chars: int = MAX_CHARS) -> DataFrame:
    """(key, pos, term, piece_no, piece, id) of rows (key, pos, term); unknown terms are skipped."""
    known = pieces(token_rows, vocabulary, max_chars).select("term", F.arrays_zip("pieces", "ids").alias("cut"))
    rows = token_rows.select(key, "pos", "term").join(known, "term").select(key, "pos", "term", F.posexplode("cut").alias("piece_no", "cut"))
    return rows.select(key, "pos", "term", "piece_no", F.col("cut.pieces").alias("piece"), F.col("cut.ids").alias("id"))
