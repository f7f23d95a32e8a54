"""BM25 as column arithmetic. Lower (more negative) is better, as in the stored scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# fixed values: the ranking parameters
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6


def idf(n_docs, df) -> Column:
    """Inverse document frequency; a phrase in more than half of the texts is almost weightless."""
    n_docs, df = _c(n_docs), _c(df)
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def bm25_term(tf, doc_len, avg_len, n_docs, df) -> Column:
    """One phrase's (negative) share of a score; 0 where the phrase does not occur."""
    tf = _c(tf).cast("double")
    damp = K1 * (1 - B + B * _c(doc_len) / _c(avg_len))
    share = -idf(n_docs, df) * (tf * (K1 + 1)) / (tf + damp)
    return F.when(tf > 0, share).otherwise(F.lit(0.0))


def bm25_score(tfs: list, doc_len, avg_len, n_docs, dfs: list) -> Column:
    total = F.lit(0.0)
    for tf, df in zip(tfs, dfs):
        total = total + bm25_term(tf, doc_len, avg_len, n_docs, df)
    return total


def team_rank(score) -> Column:
    """Team results carry a positive rank, higher is better."""
    return -_c(score)
