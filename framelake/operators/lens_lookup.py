"""Camera and lens lookup: loose text match by an inverted token index with a ranking.

    entries(entry, make, model)      the database
    queries(query, make, model)      what cameras write

A token is a run of letters or digits, lower-cased; numbers and words next to each other are told apart. An entry's score is 100 times the
tokens that it shares with the query, over the larger of both counts; makes must share a token unless the query has none. The best score
comes first, ties go to the smaller entry. Distinct queries are looked up once, however many rows have them, and only entries
that share a token meet a query.

Cases: a null or tokenless model, and one that shares no token with any entry, gives a null entry: identity, no correction; repeated
tokens count once; repeated entries are entries of their own; empty tables; extra columns go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}]+|[0-9]+"), F.lit(0)))


def looked_up(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, entry, score) of every query; entry and score are null where nothing fits."""
    asked = queries.select("query", tokens(F.col("make")).alias("make"), tokens(F.col("model")).alias("model"))
    distinct = asked.select("make", "model").distinct().where("size(model) > 0")
    base = entries.select("entry", tokens(F.col("make")).alias("e_make"), tokens(F.col("model")).alias("e_model"))
    index = base.select("entry", "e_make", F.size("e_model").alias("e_size"), F.explode("e_model").alias("token"))
    words = distinct.select("make", "model", F.explode("model").alias("token"))
    met = words.join(index, "token").where((F.size("make") == 0) | F.arrays_overlap("make", "e_make"))
    scored = met.groupBy("make", "model", "entry").agg(F.count(F.lit(1)).alias("shared"), F.first("e_size").alias("e_size"))
    score = F.floor(100 * F.col("shared") / F.greatest(F.size("model"), F.col("e_size"))).cast("int")
    best = scored.withColumn("score", score).groupBy("make", "model").agg(F.max(F.struct("score", (-F.col("entry")).alias("back"))).alias("b"))
    return asked.join(best, ["make", "model"], "left").select("query", (-F.col("b.back")).alias("entry"), F.col("b.score").alias("score"))
