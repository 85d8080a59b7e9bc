"""Text analysis: char filters, a tokenizer and token filters, each a function of columns, in registered analyzers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stemmer import stem, stem_array

ColumnFunction = Callable[[Column], Column]
STOP_WORDS = ("a", "and", "be", "have", "i", "in", "of", "that", "the", "to")


def lower_case(text: Column) -> Column:
    """Char filter: Unicode lower case."""
    return F.lower(text)


def simple_tokenizer(text: Column) -> Column:
    """Tokenizer: maximal runs of Unicode letters and numbers."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda token: token != "")


def stop_word_filter(tokens: Column, words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Token filter: drops the words, keeping the repetitions of all others."""
    return F.filter(tokens, lambda token: ~token.isin(*words))


def stemming_filter(tokens: Column) -> Column:
    """Token filter: English stems."""
    return stem_array(tokens)


def _no_stop_word(token: str) -> str | None:
    return None if token in STOP_WORDS else token


#: Token filters that look at one token at a time, as functions of it; without a result it is dropped.
_WORDWISE: dict[ColumnFunction, Callable[[str], str | None]] = {stop_word_filter: _no_stop_word, stemming_filter: stem}


@dataclass(frozen=True)
class Analyzer:
    """Char filters in order, a tokenizer, token filters in order."""

    tokenizer: ColumnFunction = simple_tokenizer
    char_filters: tuple[ColumnFunction, ...] = ()
    token_filters: tuple[ColumnFunction, ...] = ()

    def with_char_filter(self, f: ColumnFunction) -> Analyzer:
        return Analyzer(self.tokenizer, (*self.char_filters, f), self.token_filters)

    def with_token_filter(self, f: ColumnFunction) -> Analyzer:
        return Analyzer(self.tokenizer, self.char_filters, (*self.token_filters, f))

    def tokens(self, text: Column) -> Column:
        """The tokens of a text column; null for a null text."""
        for f in self.char_filters:
            text = f(text)
        tokens = self.tokenizer(text)
        for f in self.token_filters:
            tokens = f(tokens)
        return tokens

    def tokens_of_values(self, texts: Column) -> Column:
        """The tokens of an array of texts, one value's after the other's."""
        parts = texts
        for f in self.char_filters:
            parts = F.transform(parts, f)
        tokens = F.flatten(F.transform(parts, self.tokenizer))
        for f in self.token_filters:
            tokens = f(tokens)
        return tokens

    def wordwise(self) -> list[Callable[[str], str | None]] | None:
        """What becomes of each run of letters and numbers after the char filters, for batches in which each distinct one is
        looked at once; None where that can't be told from the tokenizer and token filters."""
        known = self.tokenizer is simple_tokenizer and all(f in _WORDWISE for f in self.token_filters)
        return [_WORDWISE[f] for f in self.token_filters] if known else None

    def filtered(self, texts: Column, repeated: bool) -> Column:
        """The text after the char filters; of an array of texts one, in lines."""
        for f in self.char_filters:
            texts = F.transform(texts, f) if repeated else f(texts)
        return F.array_join(texts, "\n") if repeated else texts

    def terms(self, spark: SparkSession, text: str) -> list[str]:
        """The tokens of a literal, on one row."""
        row = spark.range(1).select(self.tokens(F.lit(text)).alias("tokens")).first()
        return list(row["tokens"])


DEFAULT = Analyzer(char_filters=(lower_case,))
ENGLISH = Analyzer(char_filters=(lower_case,), token_filters=(stemming_filter, stop_word_filter))


@dataclass
class Registry:
    """Analyzers by name. ``default`` is there from the start."""

    _known: dict[str, Analyzer] = field(default_factory=lambda: {"default": DEFAULT})

    def register(self, name: str, analyzer: Analyzer) -> None:
        if analyzer is None:
            raise ValueError("an analyzer is needed")
        if name in self._known:
            raise ValueError(f"analyzer {name!r} is registered already")
        self._known[name] = analyzer

    def get(self, name: str) -> Analyzer:
        if name not in self._known:
            raise KeyError(f"analyzer {name!r} is not registered")
        return self._known[name]

    def __contains__(self, name: str) -> bool:
        return name in self._known


#: The registry that indexes use unless they are given another.
REGISTRY = Registry()
REGISTRY.register("en_stem", ENGLISH)
