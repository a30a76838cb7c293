"""What may not follow a sequence of tokens without repeating a part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def banned_next(tokens: DataFrame, by: list[str], order: list[str], token: str, n: int = 3) -> DataFrame:
    """Rows (by, token), each once: the tokens that after the sequence's end would repeat ``n`` in a row that it has already.

    ``tokens`` has a row per token of each sequence, in an order without ties. Every n - 1 tokens in a row with the one
    after them are an index; the last n - 1 of each sequence are looked up in it. Null tokens match no other, rows with
    a null ``by`` are left out. Sequences under n tokens ban nothing, and with n = 1 every token is banned that came.
    """
    along = W.partitionBy(*by).orderBy(*order)
    rows = tokens.dropna(subset=by)
    gram = F.array(*[F.lag(token, n - 1 - i).over(along) for i in range(n - 1)])
    held = rows.select(*by, F.col(token).alias("_next"), gram.alias("_gram"), F.row_number().over(along).alias("_at"), F.lead(F.lit(True)).over(along).isNull().alias("_last"), F.array(*[F.lag(token, n - 2 - i).over(along) for i in range(n - 1)]).alias("_end"))
    whole = lambda c: F.forall(c, lambda t: t.isNotNull())
    index = held.where((F.col("_at") >= n) & whole("_gram") & F.col("_next").isNotNull()).select(*by, "_gram", "_next")
    ends = held.where(F.col("_last") & (F.col("_at") >= n) & whole("_end")).select(*by, F.col("_end").alias("_gram"))
    return index.join(ends, [*by, "_gram"]).select(*by, F.col("_next").alias(token)).distinct()
