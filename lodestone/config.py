"""Options of the engine, as plain data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

# The default English stop words.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was were will with"
).split()


@dataclass(frozen=True)
class TokenizerOptions:
    """Text analysis, of documents and queries alike. normalization: None leaves texts as they are."""

    lowercase: bool = True
    punctuation: str = "replace"
    stop_words: tuple[str, ...] = tuple(STOP_WORDS)
    #: Column -> Column, applied to each token; empty stems are dropped.
    stemmer: Callable[[Column], Column] | None = None
    #: (shortest, longest) n-gram, and what joins its words.
    ngrams: tuple[int, int] | None = None
    separator: str = " "
    normalization: str | None = "NFKC"
    #: Language whose rules of lower case hold: tr and az for their two i, lt for its dotted one; else those of all.
    locale: str | None = None

    def __post_init__(self):
        if self.punctuation not in ("replace", "remove", "preserve"):
            raise ValueError("punctuation is replace, remove or preserve")
        if self.ngrams is not None and not 1 <= self.ngrams[0] <= self.ngrams[1]:
            raise ValueError("n-gram sizes must be at least 1 and in order")


@dataclass(frozen=True)
class Field:
    searchable: bool = False
    filterable: bool = False
    facetable: bool = False
    sortable: bool = False
    weight: float = 1.0


@dataclass(frozen=True)
class BoostRule:
    """A score of at least 1 times (boost - 1) is added where the condition holds."""

    field: str
    condition: str
    boost: float
    value: Any = None


@dataclass(frozen=True)
class RecencyRule:
    """A score of at least 1 times weight is added, halved every half_life_days of age."""

    field: str
    half_life_days: float
    weight: float = 0.2


@dataclass(frozen=True)
class Synonym:
    source: str
    targets: tuple[str, ...]
    bidirectional: bool = False


@dataclass(frozen=True)
class IndexConfig:
    fields: dict[str, Field]
    tokenizer: TokenizerOptions = TokenizerOptions()
    synonyms: tuple[Synonym, ...] = ()
    synonym_penalty: float = 0.7
    rules: tuple[BoostRule | RecencyRule, ...] = ()

    @property
    def searchable(self) -> list[str]:
        return [k for k, f in self.fields.items() if f.searchable]


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class TypoTolerance:
    max_distance: int | None = None
    prefix_length: int = 1


@dataclass(frozen=True)
class SearchOptions:
    limit: int | None = 10
    offset: int = 0
    fields: tuple[str, ...] | None = None
    filters: tuple[Filter, ...] = ()
    facets: tuple[str, ...] = ()
    sort: Sort | None = None
    ranking: str = "bm25"
    k1: float = 1.2
    b: float = 0.75
    proximity: bool = False
    max_proximity_distance: int = 5
    typo: TypoTolerance | None = None
    #: ISO time that stands for now in recency rules.
    now: str | None = None
    digits: int = 6
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for name in ("limit", "offset"):
            n = getattr(self, name)
            if n is not None and (not isinstance(n, int) or n < 0):
                raise ValueError(f"{name} must be a whole number from 0")
