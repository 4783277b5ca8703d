"""Ranking formulas as Columns. A strategy is a function of (tf, length, documents, average length, df)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse_document_frequency(n: Column, df: Column) -> Column:
    return F.when((n > 0) & (df > 0), F.log(n / df)).otherwise(0.0)


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def tfidf(tf: Column, length: Column, n: Column, average: Column, df: Column) -> Column:
    return F.when(tf > 0, (1 + F.log(F.greatest(tf, F.lit(1.0)))) * smoothed_idf(n, df)).otherwise(0.0)


def bm25(k1: float = 1.2, b: float = 0.75):
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be at least 0 and b from 0 to 1")

    def score(tf, length, n, average, df):
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        size = length / F.when(average > 0, average).otherwise(1.0)
        return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size))).otherwise(0.0)

    return score


def strategy(name, k1: float = 1.2, b: float = 0.75):
    if callable(name):
        return name
    return {"bm25": bm25(k1, b), "tfidf": tfidf}[name]


def default_max_distance(term: str) -> int:
    return 1 if len(term) <= 4 else 2
