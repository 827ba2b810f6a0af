"""Language identification by rank-order n-gram profiles.

A profile is a language's n-grams (one to three letters, word ends count as
``_``) by falling frequency. A document's n-grams are ranked likewise; the
distance to a profile adds up how far each of the document's most frequent
n-grams is out of place, and the nearest profile wins. n-grams that no profile
has are equally far from all of them and are not ranked.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Recent, apart, fold, limit_batches

PROFILE_SIZE = 2000
#: About so many different rows of a language are learned from, chosen by a hash of their id and text; all of a language that has no more.
FIT_ROWS = 5000
DOCUMENT_SIZE = 1000
ORDERS = (1, 2, 3)
#: How fast confidence falls with a language's mean displacement behind the best one's.
SHARPNESS = 40.0
LETTERS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"


def ngrams(piece: str) -> list[str]:
    """The n-grams of the words in a piece of text without spaces."""
    out = []
    piece = piece.lower()
    for word in [piece] if piece.isalpha() else LETTERS.findall(piece):
        padded = f"_{word}_"
        out += word
        for n in ORDERS[1:]:
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return out


def _counted(held: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: dict[str, Counter] = {}

        def flush() -> pd.DataFrame:
            rows = []
            for lang, found in pieces.items():
                grams: Counter = Counter()
                for piece, n in found.items():
                    for g in ngrams(piece):
                        grams[g] += n
                rows += [(lang, g, n) for g, n in grams.items()]
            pieces.clear()
            return pd.DataFrame(rows, columns=["lang", "ngram", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                pieces.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, pieces.values())) > held:
                yield flush()
        if pieces:
            yield flush()

    return run


@dataclass
class Profiles:
    """languages; the index of each n-gram known to any; ranks[language, n-gram], the profile size where it lacks the n-gram."""

    languages: list[str]
    index: dict[str, int]
    ranks: np.ndarray
    missing: int

    @staticmethod
    def learned(docs: DataFrame, size: int = PROFILE_SIZE, held: int = 300_000, fit_rows: int = FIT_ROWS) -> Profiles:
        """From the columns text and lang of about fit_rows rows a language where neither is null, whole texts. Rows are chosen by a hash of id and text, repeated ones count once, and every language has one at least. What comes to the driver is size n-grams a language."""
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
        usable = docs.where("text is not null and lang is not null").select("doc_id", "lang", "text", place.alias("place"))
        # The first row always counts, so no language is without any.
        share = usable.groupBy("lang").agg(F.greatest(F.lit(float(fit_rows)) / F.approx_count_distinct("place"), F.min("place")).alias("share"))
        chosen = usable.join(F.broadcast(share), "lang").where("place <= share").select("doc_id", "lang", "text").distinct()
        counts = chosen.select("lang", "text").mapInPandas(_counted(held), "lang string, ngram string, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
        place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "ngram"))
        top = counts.withColumn("place", place).where(F.col("place") <= size).collect()
        languages = sorted({r.lang for r in top})
        total: Counter = Counter()
        weight = Counter()
        for r in top:
            weight[r.lang] += r.n
        for r in top:
            total[r.ngram] += r.n / weight[r.lang]
        index = {g: i for i, (g, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0])))}
        ranks = np.full((len(languages), len(index)), size, np.float32)
        for r in top:
            ranks[languages.index(r.lang), index[r.ngram]] = r.place - 1
        return Profiles(languages, index, ranks, size)

    def judge(self, cached: int = 100_000):
        """text -> (language, confidence)."""
        index, known = self.index, len(self.index)
        of_piece = Recent(lambda p: np.array([i for i in map(index.get, ngrams(p)) if i is not None], np.int32).tobytes(), cached)
        scale = SHARPNESS / max(self.missing, 1)

        def of(text: str | None) -> tuple[str, float]:
            if not text or not LETTERS.search(text) or not self.languages:
                return UNDETERMINED, 0.0
            found = Counter(text.split())
            ids = list(map(of_piece.__getitem__, found))
            times = np.repeat(np.fromiter(found.values(), np.float64, len(found)), np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
            n = np.bincount(np.frombuffer(b"".join(ids), np.int32), times, known)
            there = np.flatnonzero(n)
            top = there[np.argsort(-n[there], kind="stable")[:DOCUMENT_SIZE]]  # ties go to the n-gram more common overall
            if not len(top):
                return self.languages[0], 1.0 / len(self.languages)
            far = np.abs(self.ranks[:, top] - np.arange(len(top), dtype=np.float32)).sum(1, dtype=np.float64) / len(top)
            best = int(np.argmin(far))
            return self.languages[best], float(1.0 / np.exp(-scale * (far - far[best])).sum())

        return of


def judged(text: Column, profiles: Profiles) -> Column:
    """struct(lang_pred, score) of a text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = profiles.judge()
        for batch in batches:
            yield pd.DataFrame([of(t) for t in batch], columns=["lang_pred", "score"])

    return run(text)


def language_ids(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang; other columns are ignored).

    Profiles are learned from the rows outside the held-out fold that have a
    text and a language. Null texts and texts without letters are ``und`` at 0,
    and so are all if there is nothing to learn from. A text whose n-grams no
    profile has goes to the first language at the score of a guess. n-grams of
    one frequency are ranked by the n-gram in profiles, and in documents by how
    common they are over all profiles; of languages that are equally far, the
    first by name wins. Repeated rows stay. Texts count whole. No rows: an
    empty result.
    """
    profiles = Profiles.learned(docs.where(fold(docs, divisor=4) != 2))
    return limit_batches(docs.select("doc_id", (fold(docs, divisor=4) == 2).alias("held_out"), judged(F.col("text"), profiles).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score"))


@apart
def identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """docs without the rows of undetermined language or of a confidence below least; columns as they were."""
    profiles = Profiles.learned(docs.where(fold(docs, divisor=4) != 2))
    marked = docs.select(*docs.columns, judged(F.col("text"), profiles).alias("__language"))
    return limit_batches(marked).where((F.col("__language.lang_pred") != UNDETERMINED) & (F.col("__language.score") >= least)).select(*docs.columns)
