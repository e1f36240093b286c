"""Exact histogram of encoded lengths, and suffix sums over it.

One row for each length that occurs answers, for a context limit of that many tokens: how many
documents fit, how many tokens a cut at the limit keeps, and the share of documents up to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import materialize

#: Lengths summed in one group of the two-level running sums.
SPAN = 128


def length_histogram(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of each encoded length. A null or empty text has length 0; each repeated row counts."""
    return encode_documents(docs, vocabulary, id_col, text_col, digests=False).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def token_counts(histogram: DataFrame) -> DataFrame:
    """For every length L that occurs, from the histogram (n_tokens, n_docs):

    total_tokens at this length; docs_up_to and docs_longer; tokens_longer (suffix sums);
    truncated_tokens, the tokens left if every document were cut to L; quantile, the share of
    documents of length L or less. An empty histogram gives no rows.

    Lengths are summed within spans first, then over the few span totals, so no task gets them all.
    The histogram is written once, as it is read twice and may come from encoding all texts.
    """
    h = materialize(histogram).withColumn("total_tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("total_tokens").alias("t"))
    later = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # Spans are as many as the longest text has hundreds of tokens: this window stays small.
    base = spans.select("span", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"), F.sum("d").over(Window.partitionBy()).alias("all_docs"), F.sum("t").over(Window.partitionBy()).alias("all_tokens"))
    own = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = h.join(base, "span").withColumns({
        "docs_longer": F.coalesce(F.sum("n_docs").over(own), F.lit(0)) + F.col("d_after"),
        "tokens_longer": F.coalesce(F.sum("total_tokens").over(own), F.lit(0)) + F.col("t_after"),
    })
    return longer.select(
        "n_tokens", "n_docs", "total_tokens", "docs_longer", "tokens_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_up_to"),
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def quantile_length(counts: DataFrame, q: float) -> int | None:
    """Smallest length with at least the share ``q`` of the documents at or under it; null without documents."""
    return counts.where(F.col("quantile") >= F.lit(q)).agg(F.min("n_tokens")).first()[0]


def truncated_total(counts: DataFrame, limit: int) -> int:
    """Tokens that stay if every document is cut to ``limit`` tokens, for any limit."""
    kept, over = counts.select(
        F.sum(F.when(F.col("n_tokens") <= limit, F.col("total_tokens"))), F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")))
    ).first()
    return (kept or 0) + limit * (over or 0)
