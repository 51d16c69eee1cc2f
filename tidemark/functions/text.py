"""Text normalisation as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and numbers longer than one character."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", " ")), " +")
    return F.filter(F.array_distinct(words), lambda w: F.char_length(w) > 1)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, even where ``body`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def solid(text: Column) -> Column:
    """The lower-cased letters and numbers of a text, without what stands between them."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def bigram_codes(text: str) -> np.ndarray:
    """The distinct pairs of neighbouring characters, in order of their first place, as one number each."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    pairs, first = np.unique(code[:-1] << 21 | code[1:], return_index=True)
    return pairs[np.argsort(first)]


def pair_of(code: int) -> str:
    return chr(code >> 21) + chr(code & 0x1FFFFF)


def text_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbours among the lower-cased letters and numbers."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [pair_of(c) for c in bigram_codes(t).tolist()])

    return F.pandas_udf(run, "array<string>")(solid(text))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def cluster_text(*parts: Column) -> Column:
    """Parts in lower case with white space collapsed, a line each."""
    return F.concat_ws("\n", *[collapse(F.lower(p)) for p in parts])


def clean_cell(text: Column) -> Column:
    """White space, then quotes, off both ends."""
    return F.btrim(F.trim(text), F.lit('"'))


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case Latin letters, digits, Hangul syllables, '_' and '-', dashes for all else; 'item' if nothing is left."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9가-힣_-]+", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.substring(F.btrim(dashed, F.lit("-")), 1, most), F.lit("")), F.lit("item"))


def excerpt(text: Column, most: int = 1200) -> Column:
    one = collapse(text)
    return F.when(F.char_length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 3)), F.lit("..."))).otherwise(one)


def drop_controls(text: Column) -> Column:
    """Without C0 controls other than tab, line feed and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def ticker(text: Column) -> Column:
    """The digits, if there are six of them."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.char_length(digits) == 6, digits)


def edge_token(text: Column) -> Column:
    return F.upper(F.translate(F.trim(text), "- ", "__"))


def header_name(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def token_estimate(text: Column) -> Column:
    """A token for every four characters, one at least; none for no text."""
    size = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4))).cast("long")


def name_or_none(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
