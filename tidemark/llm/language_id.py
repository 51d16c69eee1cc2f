"""Language identification by rank-order profiles (out-of-place distance between ranked n-grams).

A text is lower-cased letter by letter; everything but letters is a gap. Its n-grams of 1 to 3 letters, gaps at word ends
included, are ranked by falling frequency, then by code. The distance to a language is the sum over the text's TOP first
n-grams of how far each is out of place in the language's profile, TOP for one that the profile lacks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import sliced, trimmed

#: N-grams of a profile.
TOP = 300
#: Labelled rows of each language that are read for its profile, in the mean.
TRAIN_DOCS = 2000
GAP, BITS, STEP = 32, 21, 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-cased letter, or GAP."""
    table = np.full(0x110000, GAP, np.int64)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as integers, and their counts; none if it has no letter. A long text is read in parts of STEP characters."""
    parts, last = [], np.array([GAP])
    for at in range(0, len(text or ""), STEP):
        code = _letters()[np.frombuffer(text[at : at + STEP].encode("utf-32-le", "surrogatepass"), np.uint32)]
        # Of a run of gaps one stays, wherever the parts end.
        code = code[(code != GAP) | np.append(last[-1] != GAP, code[:-1] != GAP)]
        if at + STEP >= len(text) and np.append(last, code)[-1] != GAP:
            code = np.append(code, GAP)
        parts.append(_counted(last, code))
        last = np.append(last, code)[-2:]
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, back = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return code, np.bincount(back, np.concatenate([x[1] for x in parts]), len(code)).astype(np.int64)


def _counted(before: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end in ``code``, which follows ``before``."""
    both = np.append(before, code)
    two = both[:-1] << BITS | both[1:]
    three = (two[:-1] << BITS | both[2:])[both[1:-1] != GAP] if len(both) > 2 else two[:0]
    fresh = len(before)
    inner = np.count_nonzero(both[1 : fresh - 1] != GAP) if fresh > 2 else 0
    every = np.sort(np.concatenate((code[code != GAP], two[fresh - 1 :], three[inner:])))
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    return every[first], np.diff(np.append(first, len(every)))


def ranked(text: str | None) -> np.ndarray:
    """The TOP most frequent n-grams, most frequent first."""
    code, count = grams(text)
    return code[np.argsort(-count, kind="stable")[:TOP]]


@dataclass(frozen=True)
class Profiles:
    """languages: names in order; codes: sorted n-grams of any profile; ranks: for each language and code its rank, or TOP."""

    languages: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray

    def nearest(self, text: str | None) -> tuple[str, float]:
        """The language at the least distance, the first in order on a tie, and 1 minus that distance over the largest one."""
        own = ranked(text)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.where(self.codes[at] == own, self.ranks[:, at], TOP)
        out = np.where(rank == TOP, TOP, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        best = int(out.argmin())
        return self.languages[best], 1.0 - float(out[best]) / (TOP * len(own))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in sliced(batches, 1):
        parts: dict[str, list] = {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts.setdefault(label, [held.pop(label)] if label in held else []).append(grams(text))
        for label, found in parts.items():
            code, back = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
            held[label] = code, np.bincount(back, np.concatenate([x[1] for x in found]), len(code)).astype(np.int64)
    for label, (code, count) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([label] * len(code), pa.string()), pa.array(code), pa.array(count)], names=["label", "code", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles from labelled rows; rows without a label don't count, null and empty texts add nothing.

    Of a language with more than ``train_docs`` rows, rows are drawn by a hash of their id so that about that many
    remain; rows that repeat an id, or have none, are drawn together. N-grams alike in frequency are ranked by code. The profiles, TOP n-grams of each
    label, come to the driver. An empty table gives no profile.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where("label is not null")
    per = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return Profiles((), np.zeros(0, np.int64), np.zeros((0, 0), np.int64))
    share = F.create_map(*[F.lit(x) for label, n in per.items() for x in (label, min(1.0, train_docs / n))])
    draw = F.pmod(F.xxhash64(F.lit("profile"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    counted = labelled.where(draw < share[F.col("label")]).select("label", "text").mapInArrow(_count, "label string, code long, n long")
    counted = counted.groupBy("label", "code").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "code")) - 1).where(F.col("rank") < TOP)
    rows = top.select("label", "code", "rank").collect()
    languages = tuple(sorted({r["label"] for r in rows}))
    codes = np.array(sorted({r["code"] for r in rows}), np.int64)
    ranks = np.full((len(languages), len(codes)), TOP, np.int64)
    for r in rows:
        ranks[languages.index(r["label"]), np.searchsorted(codes, r["code"])] = r["rank"]
    return Profiles(languages, codes, ranks)


def detect(docs: DataFrame, profiles: Profiles, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1; all its columns and rows stay.

    Texts that are null or have no letter get ``und`` and 0, as does every text where no profile was learned. Whole texts
    are read, however long. ``names`` must be new to the table.
    """
    if set(names) & set(docs.columns):
        raise ValueError(f"columns {names} exist already")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            found = [profiles.nearest(text) for text in batch.column(at).to_pylist()]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(trimmed(run), schema)


def accepted(lang: Column, score: Column, least: float) -> Column:
    """Texts in a known language that are at least so near to its profile."""
    return (lang != UNKNOWN) & (score >= least)
