"""Text analysis as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A token is a run of letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"
#: English stop words of the usual short list (fixed values).
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text; null is empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def analyzed(text: Column, stopwords: Sequence[str] | None = STOPWORDS) -> Column:
    """The tokens that an index and its queries are made of: without stop words."""
    found = tokens(text)
    return F.filter(found, lambda t: ~t.isin(list(stopwords))) if stopwords else found


def counted(df: DataFrame, ordered: str, into: str) -> DataFrame:
    """``df`` with a column of the distinct tokens and their numbers of occurrences, an array of (term, tf).

    ``ordered`` names a column of sorted tokens. The starts of runs are a column of their
    own for the same reason as it: lambdas are not compiled, so what is written in one, or
    more than once, is computed as often.
    """
    tokens_, starts = F.col(ordered), f"{into}_starts"
    places = F.sequence(F.lit(1), F.size(tokens_))
    first_of_run = F.filter(places, lambda i: (i == 1) | (F.get(tokens_, i - 1) != F.get(tokens_, i - 2)))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(tokens_) + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(F.get(tokens_, a - 1).alias("term"), (b - a).cast("long").alias("tf")))
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return df.withColumn(starts, first_of_run).withColumn(into, F.when(F.size(tokens_) > 0, runs).otherwise(none)).drop(starts)


def whitespace_tokens(text: Column) -> Column:
    """Lower-cased words between spaces."""
    return F.filter(F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+"), lambda t: t != "")


def first(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def token_rows(df: DataFrame, key: str, text_col: str = "text", limit: int | None = None, analyze: bool = False) -> DataFrame:
    """(key, pos, term), positions from 0; ``analyze`` leaves out stop words."""
    found = analyzed(F.col(text_col)) if analyze else tokens(F.col(text_col))
    return df.select(F.col(key), F.posexplode(found if limit is None else first(found, limit)).alias("pos", "term"))


def record_text(text: Column, title: Column, description: Column) -> Column:
    """text, else title and a non-empty description, else nothing."""
    titled = F.concat_ws(" ", title, F.when(description != "", description))
    return F.coalesce(F.when(text != "", text), F.when(titled != "", titled), F.lit(""))


def merge_subwords(df: DataFrame, key: str, pieces_col: str = "pieces") -> DataFrame:
    """(key, word_idx, word, start_pos, end_pos) from an array of subwords; ``##`` continues a word, ends are exclusive."""
    rows = df.select(F.col(key), F.posexplode(pieces_col).alias("pos", "piece"))
    order = Window.partitionBy(key).orderBy("pos")
    starts = (~F.col("piece").startswith("##") | (F.col("pos") == 0)).cast("int")
    numbered = rows.withColumn("word_idx", F.sum(starts).over(order).cast("int") - 1)
    part = F.regexp_replace("piece", "^##", "")
    parts = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return numbered.groupBy(key, "word_idx").agg(
        F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("word"),
        F.min("pos").alias("start_pos"),
        (F.max("pos") + 1).alias("end_pos"),
    )


def subwords(term: Column, size: int = 4) -> Column:
    """A term cut into pieces of ``size`` characters, later ones marked with ``##``."""
    n = F.ceil(F.length(term) / F.lit(size)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda i: F.concat(F.when(i > 0, F.lit("##")).otherwise(F.lit("")), F.substring(term, i * size + 1, F.lit(size))),
    )
