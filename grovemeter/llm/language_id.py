"""Language identification by unigrams marginalised over segmentations.

The vocabulary is a published one; each language has a probability for every piece of it. A
word is scored by a forward recursion that sums the probabilities of all ways to cut it into
pieces, and a text by the product over its words times the share of the language among the
labelled rows. The probabilities come from expectation-maximisation: a forward and a backward
recursion give the expected count of every piece in every training word.

Words are runs of letters in lower case with a mark for their beginning. Pieces of every length
count (a vocabulary with one above LONGEST characters is refused); a character outside the vocabulary is the piece UNKNOWN. Recursions run
over many words at once, position by position, so long words cost time, not memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovemeter.llm.common import let_workers_import
from grovemeter.scratch import stage, unstage

LONGEST = 64
UNKNOWN = 0
ROUNDS = 3
SMOOTHING = 0.1
#: Labelled rows of each language that the probabilities are fitted on: all where there are no
#: more, else as many in expectation. The shares of the languages are counted over all labelled rows.
TRAIN_ROWS = 5000
#: Training words above this are learned from in stretches of as many letters, none left out.
STRETCH = 200
CACHE_WORDS = 150_000
#: New words scored at once.
SCORED_WORDS = 4_000
UNDETERMINED = "und"
MARK = "▁"

LETTERS = regex.compile(r"\p{L}+")
#: Base of the polynomial hash of a piece: any odd number that spreads code points.
BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[str]:
    """All pieces of letters and the mark of a sentencepiece model, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    wanted = regex.compile(rf"{MARK}?\p{{L}}*")
    pieces = {model.id_to_piece(code).lower() for code in range(model.get_piece_size())}
    found = sorted(p for p in pieces if p and wanted.fullmatch(p))
    if any(len(p) > LONGEST for p in found):
        raise ValueError(f"{path} has pieces of more than {LONGEST} characters")
    return found


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words end to end as code points, and the length of each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64), lengths


@dataclass
class Pieces:
    """The vocabulary by hash: for every length the sorted hashes and the numbers of pieces."""

    hashes: list[np.ndarray]
    numbers: list[np.ndarray]
    size: int

    @classmethod
    def of(cls, pieces: list[str]) -> Pieces:
        hashes, numbers = [], []
        for length in range(1, max(map(len, pieces), default=1) + 1):
            own = [(i + 1, p) for i, p in enumerate(pieces) if len(p) == length]
            points, _ = code_points([p for _, p in own])
            value = np.zeros(len(own), np.uint64)
            with np.errstate(over="ignore"):
                for back in range(length):
                    value += (points.reshape(len(own), length)[:, length - 1 - back] + np.uint64(1)) * BASE ** np.uint64(back + 1)
            order = np.argsort(value)
            hashes.append(value[order])
            numbers.append(np.array([i for i, _ in own], np.int64)[order])
        return cls(hashes, numbers, len(pieces) + 1)

    def ending_at(self, window: np.ndarray, length: int, value: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of ``length`` that end a window, -1 for none."""
        known = self.hashes[length - 1]
        if not len(known):
            return np.full(len(value), -1)
        at = np.minimum(np.searchsorted(known, value), len(known) - 1)
        return np.where(known[at] == value, self.numbers[length - 1][at], -1)


def lattice(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, offsets, lengths) of every piece at every position of marked words.

    ``numbers[k, l]`` is the piece of l + 1 characters that ends at character k of all words
    end to end, -1 for none.
    """
    points, lengths = code_points(words)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    inside = np.arange(len(points)) - np.repeat(offsets[:-1], lengths)
    numbers = np.full((len(points), len(pieces.hashes)), -1, np.int32)
    value = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(min(len(pieces.hashes), len(points))):
            able = inside >= back
            value[back:] += (points[: len(points) - back] + np.uint64(1)) * BASE ** np.uint64(back + 1)
            found = pieces.ending_at(points, back + 1, value)
            numbers[:, back] = np.where(able, found, -1)
    numbers[numbers[:, 0] < 0, 0] = UNKNOWN
    return numbers, offsets, lengths


def forward(numbers: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Log probabilities (words, languages) summed over all segmentations.

    As many sums of a word as the longest piece has characters are kept relative to its latest one, whose logarithm is
    carried apart, so words of any length neither vanish nor overflow.
    """
    count, languages = len(lengths), probabilities.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts, ends = offsets[:-1][order], lengths[order]
    padded = np.vstack([probabilities, np.zeros(languages)])  # number -1 is the last row
    recent = np.zeros((numbers.shape[1], count, languages))  # recent[l]: sum up to l + 1 characters back
    recent[0] = 1.0
    logs = np.zeros((count, languages))
    for at in range(int(ends[0]) if count else 0):
        live = int(np.searchsorted(-ends, -at, side="left"))  # words longer than ``at``
        here = numbers[starts[:live] + at]
        total = np.zeros((live, languages))
        for back in range(min(numbers.shape[1], at + 1)):
            total += recent[back, :live] * padded[here[:, back]]
        logs[:live] += np.log(total)
        recent[1:, :live] = recent[:-1, :live] / total
        recent[0, :live] = 1.0
    out = np.empty_like(logs)
    out[order] = logs
    return out


def expected_counts(
    numbers: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, probabilities: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """Expected count (pieces, languages) of each piece in words that count ``weights`` times.

    Words are at most STRETCH characters and a mark here, so plain sums are scaled once a position.
    """
    languages = probabilities.shape[1]
    padded = np.vstack([probabilities, np.zeros(languages)])
    counts = np.zeros_like(padded)
    for length in np.unique(lengths):
        chosen = np.flatnonzero(lengths == length)
        here = numbers[offsets[chosen][:, None] + np.arange(length)]  # words, positions, lengths
        ahead = np.zeros((length + 1, len(chosen), languages))
        ahead[0] = 1.0
        scale = np.ones((length + 1, len(chosen), languages))
        for at in range(length):
            for back in range(min(numbers.shape[1], at + 1)):
                since = np.prod(scale[at - back + 1 : at + 1], axis=0) if back else 1.0
                ahead[at + 1] += ahead[at - back] * padded[here[:, at, back]] / since
            scale[at + 1] = ahead[at + 1]
            ahead[at + 1] = 1.0
        behind = np.zeros((length + 1, len(chosen), languages))
        behind[length] = 1.0
        for at in reversed(range(length)):
            for more in range(min(numbers.shape[1], length - at)):
                end = at + more
                since = np.prod(scale[at + 1 : end + 2], axis=0)
                share = padded[here[:, end, more]] * behind[end + 1] / since
                behind[at] += share
                np.add.at(counts, here[:, end, more], share * ahead[at] * weights[chosen])
    return counts[:-1]


def stretches(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Marked words, those above STRETCH letters in several parts, and the word each belongs to."""
    parts, origin = [], []
    for i, word in enumerate(words):
        for low in range(0, len(word), STRETCH):
            parts.append((MARK if low == 0 else "") + word[low : low + STRETCH])
            origin.append(i)
    return parts, np.array(origin, np.int64)


def held_out(id_column: str = "doc_id", modulus: int = 4, part: int = 2) -> Column:
    """Whether the checksum of the identifier as text has the remainder of the held-out part."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == part, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    probabilities: np.ndarray
    priors: np.ndarray
    #: Log probability of a letter drawn evenly from those of the vocabulary.
    noise: float


def fit(labelled: DataFrame, pieces: list[str], text_column: str = "text", language_column: str = "lang") -> Model | None:
    """A model from the rows of ``labelled`` that have a language; None if there are none.

    Word counts are taken by Spark on TRAIN_ROWS rows of each language, each row drawn on its own
    by a seeded generator, so copies of one text are no more and no less likely together; each
    round reads them, and only sums by piece and language reach the driver, a table as large as
    the vocabulary.
    """
    rows = labelled.where(F.col(language_column).isNotNull()).select(
        F.col(language_column).cast("string").alias("language"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    shares = sorted((r["language"], r["count"]) for r in rows.groupBy("language").count().collect())
    if not shares:
        return None
    languages = [language for language, _ in shares]
    let_workers_import(labelled.sparkSession)
    place = F.create_map(*[F.lit(x) for i, language in enumerate(languages) for x in (language, i)])[F.col("language")]
    part = F.create_map(*[F.lit(x) for language, n in shares for x in (language, min(1.0, TRAIN_ROWS / n))])[F.col("language")]
    drawn = F.rand(7) < part
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = stage(
        rows.where(drawn).select(place.alias("place"), found.alias("word")).groupBy("place", "word").agg(F.count(F.lit(1)).alias("n")),
        "language-words",
    )
    table, size, count = Pieces.of(pieces), len(pieces) + 1, len(languages)
    probabilities = np.full((size, count), 1.0 / size)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, count))
        for batch in batches:
            places = batch.column(0).to_numpy()
            marked, origin = stretches(batch.column(1).to_pylist())
            weights = np.zeros((len(marked), count))
            weights[np.arange(len(marked)), places[origin]] = batch.column(2).to_numpy()[origin]
            for low in range(0, len(marked), 20_000):
                part = slice(low, low + 20_000)
                numbers, offsets, lengths = lattice(marked[part], table)
                total += expected_counts(numbers, lengths, offsets, probabilities, weights[part])
        at, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(total[at, language])], ["piece", "language", "n"]
        )

    for _ in range(ROUNDS):
        sums = words.mapInArrow(expect, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        counts = np.full((size, count), SMOOTHING)
        for row in sums.collect():
            counts[row["piece"], row["language"]] += row["n"]
        probabilities = counts / counts.sum(axis=0)
    unstage(words)
    priors = np.array([n for _, n in shares], float)
    letters = sum(len(p) == 1 and p != MARK for p in pieces)
    return Model(languages, table, probabilities, np.log(priors / priors.sum()), -np.log(max(letters, 2)))


class Scorer:
    """Log probabilities of words, kept for the last CACHE_WORDS words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)))

    def _learn(self, words: list[str]) -> None:
        if len(self.rows) + len(words) > CACHE_WORDS:
            self.rows.clear()
            self.scores = self.scores[:0]
        new = []
        for low in range(0, len(words), SCORED_WORDS):
            part = [MARK + w for w in words[low : low + SCORED_WORDS]]
            new.append(forward(*lattice(part, self.model.pieces), self.model.probabilities))
        for word in words:
            self.rows[word] = len(self.rows)
        self.scores = np.vstack([self.scores, *new])

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log scores (texts, languages) with priors, and the number of letters of each text."""
        found = [LETTERS.findall(text.lower()) if text else [] for text in texts]
        unknown = dict.fromkeys(w for words in found for w in words if w not in self.rows)
        if unknown:
            if len(self.rows) + len(unknown) > CACHE_WORDS:
                unknown = dict.fromkeys(w for words in found for w in words)
            self._learn(list(unknown))
        rows = self.rows
        out = np.tile(self.model.priors, (len(texts), 1))
        for i, words in enumerate(found):
            if words:
                out[i] += self.scores[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return out, np.fromiter((sum(map(len, words)) for words in found), np.int64, len(found))


def predict(docs: DataFrame, model: Model | None, text_column: str = "text", batch: int = 500) -> DataFrame:
    """``docs`` with the columns lang_pred, score and explained, in place of any of that name.

    A text is explained if the language predicted gives it a higher probability than letters
    drawn evenly from those of the vocabulary would have.
    """
    docs = docs.drop("lang_pred", "score", "explained")
    fields = [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("explained", T.BooleanType()),
    ]
    position = docs.columns.index(text_column)
    names = [*docs.columns, "lang_pred", "score", "explained"]
    let_workers_import(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for whole in batches:
            for low in range(0, whole.num_rows, batch):
                part = whole.slice(low, batch)
                predicted, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                explained = np.zeros(part.num_rows, bool)
                if scorer:
                    logs, letters = scorer.score(part.column(position).to_pylist())
                    best = logs.argmax(axis=1)
                    likely = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                    score = np.where(letters > 0, likely, 0.0)
                    predicted = [model.languages[b] if n else UNDETERMINED for b, n in zip(best, letters)]
                    explained = (letters > 0) & (logs.max(axis=1) - model.priors[best] > letters * model.noise)
                added = [pa.array(predicted, pa.string()), pa.array(score), pa.array(explained)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def identify(
    docs: DataFrame,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    The model is fitted on the labelled rows that are not held out and applied to all rows by
    their text alone. ``score`` is the probability of the language under the model. A text
    that is NULL or has no letter, and every text where nothing could be learned, is ``und``
    with score 0. Ties go to the language first in code point order. Rows repeat as they come,
    other columns are not read, an empty table gives an empty result.
    """
    model = fit(docs.where(~held_out(id_column)), vocabulary(vocabulary_path), text_column, language_column)
    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    return predict(rows, model).select(F.col("id").alias(id_column), "held_out", "lang_pred", "score")


def keep_identified(
    docs: DataFrame,
    vocabulary_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, a NULL language filled with it.

    Rejected are texts that are NULL or have no letter, and those that even the likeliest
    language explains worse than letters drawn evenly from the vocabulary: other scripts and
    noise. Other columns and given languages stay as they are. Where no row has a label nothing
    can be learned: texts without a letter are rejected and no language is filled in.
    """
    model = fit(docs.where(~held_out(id_column)), vocabulary(vocabulary_path), text_column, language_column)
    if model is None:
        return docs.where(F.col(text_column).rlike(r"\p{L}"))
    plain = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text, language = (f"c{docs.columns.index(c)}" for c in (text_column, language_column))
    filled = F.coalesce(F.col(language), F.col("lang_pred").cast(docs.schema[language_column].dataType))
    kept = predict(plain, model, text).where("explained").withColumn(language, filled)
    return kept.select(*plain.columns).toDF(*docs.columns)
