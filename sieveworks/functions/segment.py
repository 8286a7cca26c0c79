"""The base segmenter: the likeliest path through a lattice of words, for text without blanks between words.

Words and their counts are learnt from a corpus in Spark. A known word costs its share of all counts; a piece of at most `longest` other characters costs one unseen word and
its characters' shares. All scores are whole micro-nats, so paths tie exactly where they tie, and then the longer first piece wins. Known words are found by one walk down a
double-array trie from each place; the best path is built from the text's end.

What a task holds is the model, whose size `most_words` bounds: words beyond that are made of shorter words or of characters, as unseen ones are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import small_batches, thin_batches

MICRO = 1_000_000
#: Characters of a text that paths run over; all else is cut as the plain segmenter does.
HAN_RUN = "[一-鿿㐀-䶿]+"
_PLAIN = r"[A-Za-z0-9]+|\s+|."


@dataclass(frozen=True)
class DoubleArray:
    """A trie in two arrays: the child of state s by code c is base[s] + c, if check there says s. Values of words stand at their states, 1 elsewhere."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    codes: dict[str, int]

    @classmethod
    def of(cls, words: dict[str, int]) -> DoubleArray:
        """words: word to value, values not above 0."""
        ordered = sorted(words)
        codes = {c: i + 1 for i, c in enumerate(sorted({c for w in ordered for c in w}))}
        used, base, owner, value = bytearray(1), [0], [0], [1]
        used[0] = 1

        def room(upto: int) -> None:
            if upto >= len(used):
                more = max(upto + 1 - len(used), len(used))
                used.extend(bytes(more))
                base.extend([0] * more)
                owner.extend([-1] * more)
                value.extend([1] * more)

        todo, lone, several = [(0, 0, len(ordered), 0)], 1, 1
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(ordered[lo]) == depth:
                value[state] = words[ordered[lo]]
                lo += 1
            if lo == hi:
                continue
            edges = [lo] + [i for i in range(lo + 1, hi) if ordered[i][depth] != ordered[i - 1][depth]] + [hi]
            own = [codes[ordered[i][depth]] for i in edges[:-1]]
            # a lone child takes the first free place; several look from where the last ones had to look far to
            start, tries = (max(1, lone - own[0]), 0) if len(own) == 1 else (several, 0)
            room(start + own[-1])
            while any(used[start + c] for c in own):
                start, tries = start + 1, tries + 1
                room(start + own[-1])
            if len(own) == 1:
                lone = max(lone, start + own[0]) if start > 1 else lone
            elif tries > 32:
                several = start
            base[state] = start
            for c, i, j in zip(own, edges[:-1], edges[1:], strict=True):
                used[start + c], owner[start + c] = 1, state
                todo.append((start + c, i, j, depth + 1))
        kind = np.int32 if min(value) >= -(1 << 31) else np.int64
        return cls(np.array(base, np.int32), np.array(owner, np.int32), np.array(value, kind), codes)

    def __reduce__(self) -> tuple:
        return DoubleArray, (self.base, self.check, self.value, self.codes)

    @cached_property
    def _views(self) -> tuple[memoryview, memoryview, memoryview]:
        """The arrays as they lie, 12 bytes a state; lists of Python's numbers would take ten times as much in every worker."""
        return memoryview(self.base), memoryview(self.check), memoryview(self.value)

    def found(self, text: str, at: int) -> list[tuple[int, int]]:
        """(length, value) of the words that begin at a place, shorter first."""
        base, check, value = self._views
        out, state, last = [], 0, len(check)
        for i in range(at, len(text)):
            c = self.codes.get(text[i])
            if c is None:
                break
            child = base[state] + c
            if child >= last or check[child] != state or child == 0:
                break
            state = child
            if value[state] <= 0:
                out.append((i + 1 - at, value[state]))
        return out


@dataclass(frozen=True)
class Segmenter:
    """words: the trie with scores; chars: scores of characters, other ones cost `rare`; unseen: score of one unseen word."""

    words: DoubleArray
    chars: dict[str, int]
    rare: int
    unseen: int
    longest: int = 4
    run: str = HAN_RUN
    known_runs: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False, repr=False)

    def best(self, run: str) -> tuple[int, tuple[str, ...]]:
        """(score, pieces) of the likeliest path; of equal ones, the one whose first piece is longest, and so on."""
        n = len(run)
        score, length = [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            top, size, cost = None, 0, self.unseen
            for k in range(1, min(self.longest, n - i) + 1):
                cost += self.chars.get(run[i + k - 1], self.rare)
                if top is None or cost + score[i + k] >= top:
                    top, size = cost + score[i + k], k
            for k, value in self.words.found(run, i):
                if value + score[i + k] > top or (value + score[i + k] == top and k > size):
                    top, size = value + score[i + k], k
            score[i], length[i] = top, size
        pieces, i = [], 0
        while i < n:
            pieces.append(run[i : i + length[i]])
            i += length[i]
        return score[0], tuple(pieces)

    def pieces(self, run: str) -> tuple[str, ...]:
        if (found := self.known_runs.get(run)) is None:
            if len(self.known_runs) > 20_000:
                self.known_runs.clear()
            found = self.best(run)[1]
            if len(run) <= 64:
                self.known_runs[run] = found
        return found

    @cached_property
    def _parts(self) -> re.Pattern:
        return re.compile(f"({self.run})|{_PLAIN}", re.S)

    def ends(self, text: str) -> list[int]:
        """Ends of all pieces; between them, from 0, lies the whole text."""
        out = []
        for m in self._parts.finditer(text):
            if m[1] is None:
                out.append(m.end())
            else:
                at = m.start()
                for p in self.pieces(m[1]):
                    at += len(p)
                    out.append(at)
        return out


def word_counts(texts: DataFrame, text: Column, word: str) -> DataFrame:
    """(word, n) of all matches of a pattern in whole texts."""
    return texts.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(word), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def micro(share: Column) -> Column:
    return F.round(F.log(share) * MICRO).cast("long")


def learn(counts: DataFrame, least: int = 2, most_words: int = 200_000, longest: int = 4, run: str = HAN_RUN) -> Segmenter:
    """The segmenter of counted words (word, n). Words seen `least` times and more are known, the commonest `most_words` of them; ties by word.

    Sums are made in Spark; the known words and one row for each character reach the driver.
    """
    total = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1
    chars = counts.select(F.explode(F.filter(F.split("word", ""), lambda c: c != "")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    all_chars = (chars.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1
    known = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most_words).select("word", micro(F.col("n") / total).alias("score"))
    of_chars = {r["c"]: r["score"] for r in chars.select("c", micro(F.col("n") / all_chars).alias("score")).toLocalIterator()}
    words = {r["word"]: r["score"] for r in known.toLocalIterator() if r["word"]}
    return Segmenter(DoubleArray.of(words), of_chars, round(float(np.log(1 / all_chars)) * MICRO), round(float(np.log(1 / total)) * MICRO), longest, run)


def best_paths(spark: SparkSession, run: Column, segmenter: Segmenter) -> Column:
    """struct<pieces: array<string>, score: bigint> of a run of characters."""
    small_batches(spark)
    thin_batches(spark)
    shared = spark.sparkContext.broadcast(segmenter)

    @F.pandas_udf("pieces array<string>, score long")
    def found(s: pd.Series) -> pd.DataFrame:
        got = [shared.value.best(t or "") for t in s]
        return pd.DataFrame({"pieces": [list(p) for _, p in got], "score": [v for v, _ in got]})

    return found(run)


def lattice_segments(spark: SparkSession, text: Column, segmenter: Segmenter) -> Column:
    """array<string>: the pieces of a whole text, which joined are the text; none of a null or empty one. Pieces are some fifty bytes each, so batches are small."""
    small_batches(spark, 500)
    thin_batches(spark, 2 << 20)
    shared = spark.sparkContext.broadcast(segmenter)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        def of(t: str) -> list[str]:
            ends = shared.value.ends(t)
            return [t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

        return s.map(lambda t: of(t) if t else [])

    return cut(text)
