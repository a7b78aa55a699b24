"""Language identification by words first, backing off to character n-grams.

A word that the model knows scores its log frequency in each language. For another word
the longest n-grams of it that are known speak, down to single letters; what has none is
silent. A document's language is the one with the largest sum over its words, and its score
that language's share of a word's evidence on average, so that long texts aren't surer than
short ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, forget, pieces, saved

#: Learning rows of each language on average: a fixed share of its rows by hash. The one bound of the model.
ROWS_PER_LANGUAGE = 2_000
LONGEST_GRAM = 5
#: The pipeline drops documents whose score is below this by more than its standard error. Text in a language that was learnt
#: scores 0.8 to 0.9, word salad about 0.3.
LEAST_SCORE = 0.45
#: Bytes of scores that a task remembers before it forgets all of them, the length up to which it remembers a word,
#: and the bytes of scores summed at a time.
REMEMBERED, REMEMBERED_LENGTH, AT_ONCE = 64 << 20, 40, 8 << 20
#: Characters of a text read at a time.
SEGMENT = 1 << 19

_RUNS = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s")


def _alphabetic(run: str) -> list[str]:
    """The words of a run: without numerals such as superscripts and fractions, which aren't letters."""
    return [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()


def letter_words(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return [word for run in _RUNS.findall(text.lower()) for word in _alphabetic(run)]


def segments(text: str) -> Iterator[str]:
    """The text in parts of about ``SEGMENT`` characters, cut at white space; a longer word is one part."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + SEGMENT) if at + SEGMENT < len(text) else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def grams_of(word: str, n: int) -> Iterator[str]:
    """The n-grams of a word with its ends marked by a space; single letters without marks."""
    padded = f" {word} " if n > 1 else word
    return (padded[i : i + n] for i in range(len(padded) - n + 1))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Log frequencies by language, of which only those seen are stored.

    ``places[n]`` gives the row of a known n-gram, words being those of size 0. A row lists
    the languages it was seen in (``langs[starts[row] : starts[row + 1]]``) and by how much
    its log frequency there (``above``) exceeds that of an unseen one, ``floor[n]``.
    """

    languages: tuple[str, ...]
    places: tuple[dict[str, int], ...]
    floor: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    above: np.ndarray


def learning_rows(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``lang, text``: the rows to learn from, not held out, with a language and a text.

    A language with more rows gives a share of them, chosen by a hash of the id; the share
    is such that ``rows_per_language`` come on average, which bounds the model's work.
    """
    able = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # written, so that its size is known when the join is planned: a row a language
    shares = saved(able.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.count(F.lit(1))).alias("share")))
    chance = F.pmod(F.xxhash64(F.lit("learn"), F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    return able.join(shares, "lang").where(chance < F.col("share")).select("lang", "text")


def count_words(rows: DataFrame) -> DataFrame:
    """``lang, word, n`` of ``lang, text`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for part in segments(text):
                    found.update((lang, word) for word in letter_words(part))
            yield _counted(found, ["lang", "word"])

    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """``size, gram, lang, n`` of counted words; a word is its own gram of size 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for size in range(1, LONGEST_GRAM + 1):
                    for gram in grams_of(word, size):
                        found[lang, size, gram] += n
            yield _counted(found, ["lang", "size", "gram"])

    grams = words.mapInArrow(count, "lang string, size int, gram string, n long").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    return words.select(F.lit(0).alias("size"), F.col("word").alias("gram"), "lang", "n").unionByName(grams)


def _counted(found: Counter, names: list[str]) -> pa.RecordBatch:
    keys = list(found)
    columns_ = [pa.array([k[i] for k in keys], pa.int32() if name == "size" else pa.string()) for i, name in enumerate(names)]
    return pa.RecordBatch.from_arrays([*columns_, pa.array(list(found.values()), pa.int64())], [*names, "n"])


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model of all words and n-grams of the learning rows, which are bounded for each language."""
    counted = saved(count_words(learning_rows(docs, rows_per_language)))
    counts = count_grams(counted).toArrow()
    forget(counted)
    return model_of(counts)


def model_of(counts: pa.Table) -> Model:
    """The model of ``size, gram, lang, n``."""
    counts = counts.sort_by([("size", "ascending"), ("gram", "ascending"), ("lang", "ascending")])
    lang = counts["lang"].combine_chunks().dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    order = np.argsort(np.array(lang.dictionary.to_pylist(), object)) if len(lang.dictionary) else np.empty(0, np.int64)
    languages = tuple(lang.dictionary[int(i)].as_py() for i in order)
    langs = np.argsort(order).astype(np.int32)[lang.indices.to_numpy(zero_copy_only=False)] if len(languages) else np.empty(0, np.int32)
    size, n = counts["size"].to_numpy(), counts["n"].to_numpy().astype(np.float64)
    grams = counts["gram"].to_pylist()
    new = np.fromiter((i == 0 or size[i] != size[i - 1] or grams[i] != grams[i - 1] for i in range(len(grams))), bool, len(grams))
    firsts = np.flatnonzero(new)
    places: tuple[dict[str, int], ...] = tuple({} for _ in range(LONGEST_GRAM + 1))
    for row, at in enumerate(firsts.tolist()):
        places[size[at]][grams[at]] = row
    floor = np.zeros((LONGEST_GRAM + 1, len(languages)))
    for k, table in enumerate(places):
        of = size == k
        floor[k] = np.log(0.5) - np.log(np.bincount(langs[of], n[of], len(languages)) + 0.5 * len(table) + 1)
    return Model(languages, places, floor, np.append(firsts, len(grams)), langs, np.log(n + 0.5) - np.log(0.5))


class _Scores(dict):
    """The row of ``table`` for a run: over its words, the sum of log frequencies, then of each language's share of the evidence, and their number."""

    def __init__(self, model: Model):
        self.model, self.width = model, max(1, len(model.languages))
        self.most = max(1024, REMEMBERED // (16 * self.width + 8))
        self.table, self.used = np.zeros((1024, 2 * self.width + 1)), 0

    def rows(self, runs: list[str]) -> np.ndarray:
        """The row of each run; those that aren't remembered are scored first, each once."""
        new = [run for run in set(runs) if run not in self]
        step = max(1, AT_ONCE // (16 * self.width))
        for at in range(0, len(new), step):
            self.add(new[at : at + step])
        out = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
        for run in new:
            if len(run) > REMEMBERED_LENGTH:
                del self[run]
        return out

    def add(self, runs: list[str]) -> None:
        """Scores runs: the log frequencies of each word, else the mean over its longest known n-grams."""
        model, width = self.model, len(self.model.languages)
        known = model.places[0].get
        rows: list[int] = []  # of the model, word after word
        often: list[tuple[int, int]] = []  # places in ``rows`` of n-grams that a long word has more than once
        ends, sizes, of_run = [], [], []
        for k, run in enumerate(runs):
            for word in _alphabetic(run):
                size = 0
                if (row := known(word)) is not None:
                    rows.append(row)
                else:
                    for n in range(LONGEST_GRAM, 0, -1):
                        place = model.places[n].get
                        if len(word) > 1000:
                            found = Counter(r for g in grams_of(word, n) if (r := place(g)) is not None)
                            often += enumerate(found.values(), len(rows))
                        else:
                            found = [r for g in grams_of(word, n) if (r := place(g)) is not None]
                        if found:
                            rows += found
                            size = n
                            break
                ends.append(len(rows))
                sizes.append(size)
                of_run.append(k)
        lens, row = np.diff(np.array(ends, np.int64), prepend=0), np.array(rows, np.int64)
        times = np.ones(len(row))
        for i, n in often:
            times[i] = n
        word_of = np.repeat(np.arange(len(lens)), lens)
        first = model.starts[row]
        spread = model.starts[row + 1] - first
        flat = np.repeat(first - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
        cell = np.repeat(word_of, spread) * width + model.langs[flat]
        logs = np.bincount(cell, model.above[flat] * np.repeat(times, spread), len(lens) * width).reshape(-1, width)
        n = np.bincount(word_of, times, len(lens))[:, None]
        logs = (logs + model.floor[sizes] * n) / np.maximum(n, 1)
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        while self.used + len(runs) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.used : self.used + len(runs)] = 0.0
        np.add.at(self.table, self.used + np.array(of_run, np.int64), np.hstack((logs, share, np.ones((len(lens), 1)))))
        self.update(zip(runs, range(self.used, self.used + len(runs)), strict=True))
        self.used += len(runs)

    def forget(self) -> None:
        if self.used > self.most:
            self.clear()
            self.used = 0


class Judge:
    """Predicts the languages of texts."""

    def __init__(self, model: Model):
        self.scores, self.languages = _Scores(model), model.languages

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.judge([text])[0][:2]

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """Language, score and number of words of each text."""
        width = len(self.languages)
        if not width:
            return [("und", 0.0, 0)] * len(texts)
        totals = np.zeros((len(texts), 2 * width + 1))
        runs: list[list[str]] = []  # of the rows below
        rows: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            for part in segments(text or ""):
                runs.append(_RUNS.findall(part.lower()))
                rows.append(i)
                held += len(part)
                if held >= SEGMENT:
                    self._add(runs, rows, totals)
                    held = 0
        self._add(runs, rows, totals)
        best, words = totals[:, :width].argmax(axis=1), totals[:, -1].astype(np.int64)
        share = totals[np.arange(len(texts)), width + best] / np.maximum(words, 1)
        return [(self.languages[b], min(1.0, s), n) if n else ("und", 0.0, 0) for b, s, n in zip(best.tolist(), share.tolist(), words.tolist(), strict=True)]

    def _add(self, runs: list[list[str]], rows: list[int], totals: np.ndarray) -> None:
        """Adds the scores of each list of runs to the total of its row."""
        scores, sizes = self.scores, [len(x) for x in runs]
        at = scores.rows(list(chain.from_iterable(runs)))
        step = max(1, AT_ONCE // (8 * totals.shape[1]))
        owner = np.repeat(np.array(rows, np.int64), sizes)
        for a in range(0, len(at), step):
            own = owner[a : a + step]
            firsts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            totals[own[firsts]] += np.add.reduceat(scores.table[at[a : a + step]], firsts, axis=0)
        runs.clear()
        rows.clear()
        scores.forget()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: ``doc_id, lang_pred, score`` from the whole text alone.

    ``lang_pred`` is ``und`` with score 0 for a null or empty text, one without letters, or a
    model without languages; ties go to the first language in alphabetical order. ``score`` is
    the mean over the words of the share that the predicted language has of a word's evidence.
    Very long texts are read whole, a segment at a time. Repeated rows give repeated results;
    null ids are kept; other columns play no part; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ROWS_PER_LANGUAGE
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in pieces(batches):
            found = judge.judge(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, **options: int) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, by a model learnt from those not held out.

    Odd rows as in ``predict``. Learning runs when called.
    """
    found = predict(docs, learn(docs, **options))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE, **options: int) -> DataFrame:
    """``docs``, whole rows, without those of no language or a score surely below ``least``.

    Null and empty texts and those without letters go; a text goes too if its words speak for the
    language it is nearest to less than ``least`` on average, by more than the standard error that a
    mean of so many shares has at most, as in a language that wasn't learnt or in word salad; a few
    words alone prove nothing. Very long texts are read whole; rows that repeat all stay or go;
    null ids and other columns, whatever their names, are kept; an empty table gives none.
    Learning runs when called.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value)
        for batch in pieces(batches):
            found = judge.judge(batch.column("text").to_pylist())
            yield batch.filter(pa.array([name != "und" and share + 0.5 / n**0.5 >= least for name, share, n in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
