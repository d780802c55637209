"""Line dedup by winnowing over hashes of short lines.

Repeated passages rarely begin and end where lines do, so the lines hashed here are all runs of
LINE words, wherever line feeds are. Of every window of WINDOW successive line hashes the
smallest (the last of equals) is a fingerprint: two texts that share LINE + WINDOW - 1 words in
a row share one, at the same place of the passage. Every place of a fingerprint is matched
with its first one, in the order of identifiers and places. Matches of one text that overlap or
touch join into runs, and both ends of a run are extended word by word as far as the words
around the first place agree, at most WINDOW - 1 words: what lies beyond holds a fingerprint of
its own. Runs of at least MIN_WORDS words are deleted, so only their first place stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemeter.llm.common import id_order, let_workers_import, whole, words
from grovemeter.scratch import stage

LINE = 25
WINDOW = 24
MIN_WORDS = 30
#: Words compared beyond each end of a run.
REACH = WINDOW - 1

#: The base of word values (modulo 2 ** 64), a multiplier and a prime modulus that
#: order lines, and an odd number that tells lines apart.
BASE, SPREAD, MODULUS, MIX = 0x2545F4914F6CDD1D, 1_000_003, 2_147_483_647, np.uint64(0x9E3779B97F4A7C15)
HALF, LAST = np.uint64(32), np.uint64(2**32 - 1)
#: Bytes whose prefix sums are formed at once, and bytes of texts that are handled together.
BLOCK, BATCH = 1 << 16, 1 << 20


def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** (i + 1) and BASE ** -i of all places of a block, modulo 2 ** 64."""
    powers = np.cumprod(np.full(size, BASE, np.uint64))
    inverses = np.full(size, pow(BASE, -1, 2**64), np.uint64)
    inverses[:1] = 1
    return powers, np.cumprod(inverses)


TABLES = power_tables(BLOCK)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text in UTF-8 start and end."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_values(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The value of each word, the sum of byte i times BASE ** (i + 1), from prefix sums."""
    codes = np.frombuffer(data, np.uint8)
    values = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        until = max(int(np.searchsorted(ends, low + BLOCK, "right")), at + 1)
        size = int(ends[until - 1] - low)
        powers, inverses = TABLES if size <= BLOCK else power_tables(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(codes[low : low + size] * powers[:size], out=sums[1:])
        first, last = starts[at:until] - low, ends[at:until] - low
        values[at:until] = (sums[last] - sums[first]) * inverses[first]
        at = until
    return values


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` successive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def winnow(values: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints among the lines of several texts.

    ``opens`` holds where each text's word values begin, and where the last one ends. Lines
    never reach over the end of a text; a text of fewer than WINDOW lines has one window.
    """
    n = len(values)
    room = LINE + WINDOW
    # Behind a text's last line stand LINE - 1 places without one: no window reaches the next text.
    behind = np.repeat(opens[1:], np.diff(opens))
    at = np.arange(n, dtype=np.int64)
    has_line = at + LINE <= behind
    high = np.concatenate([values, np.zeros(room, np.uint64)]) >> HALF
    place = np.arange(n + room, dtype=np.uint64)
    plain, placed = np.zeros(n + room + 1, np.uint64), np.zeros(n + room + 1, np.uint64)
    np.cumsum(high, out=plain[1:])
    np.cumsum(high * place, out=placed[1:])
    plain, placed = plain[LINE : LINE + n] - plain[:n], placed[LINE : LINE + n] - placed[:n]
    order = (np.uint64(2) * (placed - place[:n] * plain) + plain) * np.uint64(SPREAD) % np.uint64(MODULUS)
    keys = np.full(n + WINDOW - 1, np.iinfo(np.uint64).max, np.uint64)
    keys[:n][has_line] = (order << HALF | (LAST - place[:n]))[has_line]
    counts = has_line & (at + (LINE + WINDOW - 1) <= behind)
    counts[opens[:-1][np.diff(opens) >= LINE]] = True
    least = sliding_minimum(keys, WINDOW)[counts]
    picked = (LAST - (least & LAST)).astype(np.int64)
    picked = picked[np.diff(picked, prepend=-1) > 0]
    mixed = (values ^ (values >> HALF)) * MIX
    hashes = np.zeros(len(picked), np.uint64)
    for step in range(LINE):
        hashes = hashes * np.uint64(BASE) + mixed[picked + step]
    return picked, hashes.view(np.int64)


def text_batches(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts): successive texts of about BATCH bytes together, or one longer text."""
    first, texts, size = 0, [], 0
    for row, text in enumerate(column):
        data = text.as_buffer().to_pybytes()
        if texts and size + len(data) > BATCH:
            yield first, texts
            first, texts, size = row, [], 0
        texts.append(data)
        size += len(data)
    if texts:
        yield first, texts


def row_batches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Successive rows with about BATCH bytes of texts together, or one row of a longer text."""
    first, size = 0, 0
    for row, length in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if row > first and size + (length or 0) > BATCH:
            yield batch.slice(first, row - first)
            first, size = row, 0
        size += length or 0
    if first < batch.num_rows:
        yield batch.slice(first)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(line, rank_id, digest, place) of every fingerprint; places are words before it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1)]
            for first, texts in text_batches(batch.column(2)):
                data = b"\n".join(texts)
                starts, ends = word_bounds(data)
                limits = np.cumsum([0] + [len(text) + 1 for text in texts])
                opens = np.searchsorted(starts, limits)
                places, lines = winnow(word_values(data, starts, ends), opens)
                rows = np.searchsorted(opens, places, "right") - 1
                columns = [lines, *(key[first + rows] for key in keys), places - opens[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["line", "rank_id", "digest", "place"])

    let_workers_import(docs.sparkSession)
    text = whole(text_column)
    keyed = docs.select(id_order(id_column).alias("rank_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return keyed.mapInArrow(find, "line long, rank_id long, digest long, place long")


def words_around(data: bytes, bounds: tuple[np.ndarray, np.ndarray], spot: int, after: bool) -> np.ndarray:
    """Values of the REACH words from ``spot`` on, or before it, nearest first."""
    near = slice(spot, spot + REACH) if after else slice(max(spot - REACH, 0), spot)
    values = word_values(data, bounds[0][near], bounds[1][near])
    return values if after else values[::-1]


def surroundings(docs: DataFrame, asked: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(first_id, first_digest, spot, after, around): the words next to the places asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in row_batches(whole_batch, 2)):
            rows, spots, sides, around = [], [], [], []
            for row, (text, asks) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                data = text.as_buffer().to_pybytes()
                bounds = word_bounds(data)
                for ask in asks:
                    rows.append(row)
                    spots.append(ask["spot"])
                    sides.append(ask["after"])
                    around.append(words_around(data, bounds, ask["spot"], ask["after"]).tobytes())
            keys = [pa.array(batch.column(i).to_numpy()[rows]) for i in (0, 1)] if rows else [pa.array([], pa.int64())] * 2
            arrays = [*keys, pa.array(spots, pa.int64()), pa.array(sides, pa.bool_()), pa.array(around, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["first_id", "first_digest", "spot", "after", "around"])

    let_workers_import(docs.sparkSession)
    text = whole(text_column)
    keyed = docs.select(id_order(id_column).alias("first_id"), F.xxhash64(text).alias("first_digest"), text.alias("text"))
    spots = asked.groupBy("first_id", "first_digest").agg(F.collect_set(F.struct("spot", "after")).alias("asks"))
    found = keyed.join(spots, ["first_id", "first_digest"]).select("first_id", "first_digest", "text", "asks")
    schema = "first_id long, first_digest long, spot long, after boolean, around binary"
    return found.mapInArrow(read, schema).distinct()


def matched_ends(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(rank_id, digest, ends): for each text with matches both ends of its runs.

    An end has its place among the text's words, whether it is the right one (``after``), and
    the values of the words next to it at the first place. First means a smaller identifier,
    then a smaller hash of the text, then a smaller place; a NULL identifier comes last. Rows
    that repeat with their id and text are one document.
    """
    placed = stage(fingerprints(docs, id_column, text_column), "line-prints")
    where = F.struct("rank_id", "digest", "place")
    met = placed.groupBy("line").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n"))
    # Staged before it is joined: a join to a table, unlike one to an aggregate, lets adaptive
    # execution split a very common line over many tasks.
    first = stage(met.where("n > 1").drop("n"), "line-first")
    later = placed.join(first, "line").where(where > F.col("first")).select("rank_id", "digest", "place", "first")

    text = Window.partitionBy("rank_id", "digest").orderBy("place")
    opens = F.coalesce(F.col("place") > F.lag("place").over(text) + LINE, F.lit(True))
    match = F.struct("place", "first")
    runs = (
        later.withColumn("opens", opens.cast("int"))
        .withColumn("run", F.sum("opens").over(text))
        .groupBy("rank_id", "digest", "run")
        .agg(F.min(match).alias("head"), F.max(match).alias("tail"))
    )

    def end(of: str, ahead: int):
        return F.struct(
            (F.col(of)["place"] + ahead).alias("at"),
            (F.col(of)["first"]["place"] + ahead).alias("spot"),
            F.lit(ahead > 0).alias("after"),
            F.col(of)["first"]["rank_id"].alias("first_id"),
            F.col(of)["first"]["digest"].alias("first_digest"),
        )

    ends = runs.select("rank_id", "digest", F.explode(F.array(end("head", 0), end("tail", LINE))).alias("end"))
    ends = stage(ends.select("rank_id", "digest", "end.*"), "line-ends")
    spot = ["first_id", "first_digest", "spot", "after"]
    around = stage(surroundings(docs, ends.select(*spot).distinct(), id_column, text_column), "line-around")
    return (
        ends.join(around, spot)
        .groupBy("rank_id", "digest")
        .agg(F.sort_array(F.collect_list(F.struct("at", "after", "around"))).alias("ends"))
    )


def repeated_runs(data: bytes, bounds: tuple[np.ndarray, np.ndarray], ends: list[dict]) -> list[tuple[int, int]]:
    """Runs (first word, word behind the last) to delete, from the ends of a text's matches."""

    def agreeing(end: dict) -> int:
        own = words_around(data, bounds, end["at"], end["after"])
        theirs = np.frombuffer(end["around"], np.uint64)
        both = min(len(own), len(theirs))
        return int(np.logical_and.accumulate(own[:both] == theirs[:both]).sum())

    heads = [end["at"] - agreeing(end) for end in ends if not end["after"]]
    tails = [end["at"] + agreeing(end) for end in ends if end["after"]]
    runs: list[list[int]] = []
    for head, tail in zip(heads, tails):
        if runs and head <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], tail)
        else:
            runs.append([head, tail])
    return [(head, tail) for head, tail in runs if tail - head >= MIN_WORDS]


def without_runs(text: str, ends: list[dict]) -> tuple[str, int]:
    """A text without its repeated runs and the white space before each of their words."""
    data = text.encode()
    bounds = word_bounds(data)
    left, done, gone = [], 0, 0
    for head, tail in repeated_runs(data, bounds, ends):
        left.append(data[done : bounds[1][head - 1] if head else 0])
        done = int(bounds[1][tail - 1])
        gone += tail - head
    return (b"".join([*left, data[done:]]).decode(), gone) if gone else (text, 0)


def clean_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", count_column: str = "n_deleted"
) -> DataFrame:
    """All rows and columns of ``docs``, the text without later repeated runs, and their words.

    ``count_column`` counts the deleted words; a column of that name is replaced, others keep
    their names and values. A deleted word takes the white space before it along. A NULL text
    stays NULL, a text all of whose words go keeps white space at its end. A text of fewer than
    LINE words has no fingerprint and stays. Rows that repeat with their id and text are
    treated alike: none of them is the other's repetition. An empty table gives an empty result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in row_batches(whole_batch, 1)):
            texts, counts = [], []
            for text, ends in zip(batch.column(1), batch.column(2)):
                left, gone = without_runs(text.as_py(), ends.as_py()) if ends.is_valid else (text, 0)
                texts.append(left if isinstance(left, str) else text.as_py())
                counts.append(gone)
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "text", "gone"])

    docs = docs.drop(count_column)
    others = [name for name in docs.columns if name != text_column]
    keyed = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in others]).alias("row"),
        F.col(text_column).alias("text"),
        id_order(id_column).alias("rank_id"),
        F.xxhash64(whole(text_column)).alias("digest"),
    )
    found = matched_ends(docs, id_column, text_column)
    joined = keyed.join(found, ["rank_id", "digest"], "left").select("row", "text", "ends")
    row = joined.schema["row"].dataType.simpleString()
    cleaned = joined.mapInArrow(cut, f"row {row}, text string, gone long")
    back = [F.col("text").alias(name) if name == text_column else F.col("row")[name].alias(name) for name in docs.columns]
    return cleaned.select(*back, F.col("gone").alias(count_column))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with cleaned texts; rows of whose text no word is left are dropped."""
    count = "n_deleted"
    while count in docs.columns:
        count += "_"
    # staged, or each use of the text would build it again
    cleaned = stage(clean_lines(docs, id_column, text_column, count), "line-cleaned")
    emptied = (F.col(count) > 0) & (F.size(words(F.col(text_column))) == 0)
    return cleaned.where(~emptied).select(*docs.columns)
