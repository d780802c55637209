"""A hidden Markov language model trained by Baum-Welch.

Hidden states have transition probabilities and each its own distribution over words. A word
is drawn by first drawing its class (its last SUFFIX bytes, hashed to CLASSES) from the state
and then the word from the unigram counts of the class, so

    log p(text) = unigram score of the text + log sum over state paths of
                  transitions * p(class | state) / p(class)

where the first part needs the exact count of every word of the corpus and the second only a
table of bounded size, STATES x CLASSES. A word without a count has the unigram probability
in every state. All probabilities of a state sum to one.

Texts are dealt into blocks of about BLOCK_CHARS characters by a hash. A block is one row:
its distinct words, and its documents as numbers into them. Word counts are summed over
blocks by a shuffle of distinct words, never gathered; expectation steps read blocks and send
one count per class and state from each task; likelihoods are exact over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemeter.llm.common import let_workers_import
from grovemeter.llm.language_id import held_out
from grovemeter.scratch import stage

STATES = 8
CLASSES = 1 << 16
END = CLASSES  # the class of the end of a text
SUFFIX = 4
ROUNDS = 5
#: Training cuts texts into runs of this many tokens, so that many are handled at once; the
#: likelihood of a text is always over the whole of it.
RUN = 256
#: Tokens whose probabilities by state are held at once, however many a block or a text has.
AT_ONCE = 1 << 17
BLOCK_CHARS = 8_000_000
#: Weight of the unigram distribution in the distribution of each state, in tokens.
PRIOR = 200.0
SEED = 11

BLOCK_SCHEMA = (
    "block int, doc_ids array<bigint>, held array<boolean>, sizes array<int>, tokens array<int>, "
    "words array<bigint>, classes array<int>"
)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row holding a whole array."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _pack(table: pa.Table) -> pa.Table:
    """All documents of a block (block, doc_id, held, text) as its one row.

    Words become numbers in order of first use. A word is told from others by a 64-bit hash:
    among 100 million distinct words the chance that any two share one is 0.03 %.
    """
    numbers: dict[bytes, int] = {}
    sizes, tokens = [], []
    for text in table.column("text").to_pylist():
        found = text.encode().lower().split()  # bytes: only A-Z change, only \x20\x09-\x0D part
        sizes.append(len(found))
        tokens.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
    words = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers)).view(np.int64)
    classes = np.fromiter((xxhash.xxh32_intdigest(w[-SUFFIX:]) % CLASSES for w in numbers), np.int32, len(numbers))
    ids = table.column("doc_id").combine_chunks()
    held = table.column("held").combine_chunks()
    whole = pa.array([0, len(sizes)], pa.int32())
    return pa.table(
        [
            table.column("block").slice(0, 1),
            pa.ListArray.from_arrays(whole, ids),
            pa.ListArray.from_arrays(whole, held),
            _lists(np.array(sizes, np.int32), pa.int32()),
            _lists(np.concatenate(tokens) if tokens else np.empty(0, np.int32), pa.int32()),
            _lists(words, pa.int64()),
            _lists(classes, pa.int32()),
        ],
        ["block", "doc_ids", "held", "sizes", "tokens", "words", "classes"],
    )


def _array(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to (block, place, word, class, n): how often its training texts use each word."""
    for batch in batches:
        for row in range(batch.num_rows):
            sizes, words = _array(batch, row, "sizes"), _array(batch, row, "words")
            train = np.repeat(~_array(batch, row, "held").astype(bool), sizes)
            counts = np.bincount(_array(batch, row, "tokens")[train], minlength=len(words))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(words), batch.column("block")[row].as_py(), np.int32)),
                    pa.array(np.arange(len(words), dtype=np.int32)),
                    pa.array(words),
                    pa.array(_array(batch, row, "classes")),
                    pa.array(counts.astype(np.int64)),
                ],
                ["block", "place", "word", "class", "n"],
            )


@dataclass
class Model:
    """start (S), moves (S, S), ratio (CLASSES + 1, S): p(class | state) / p(class)."""

    start: np.ndarray
    moves: np.ndarray
    ratio: np.ndarray


def first_model(base: np.ndarray) -> Model:
    """States that stay, and distributions a random step away from the unigram one."""
    random = np.random.default_rng(SEED)
    noise = np.exp(random.normal(0.0, 0.5, (len(base), STATES)))
    noise[END] = 1.0
    moves = np.full((STATES, STATES), 0.1 / (STATES - 1)) if STATES > 1 else np.ones((1, 1))
    np.fill_diagonal(moves, 0.9 if STATES > 1 else 1.0)
    total = (base[:, None] * noise).sum(axis=0)
    return Model(np.full(STATES, 1.0 / STATES), moves, noise * base.sum() / np.where(total > 0, total, 1.0))


def _runs(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length of each run of at most RUN tokens, longest first; whether it opens a text."""
    ends = np.cumsum(sizes)
    pieces = -(-sizes // RUN)
    begins = np.repeat(ends - sizes, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lengths = np.minimum(RUN, np.repeat(ends, pieces) - begins)
    opens = begins == np.repeat(ends - sizes, pieces)
    order = np.argsort(-lengths, kind="stable")
    return begins[order], lengths[order], opens[order]


def _by_step(begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in the order of their place in a run, and where each place begins in that order.

    Runs come longest first, so the runs that go on are the first ones of the step before.
    """
    longest = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(longest), side="left")
    order = [begins[:n] + at for at, n in enumerate(live)]
    return np.concatenate(order) if order else np.empty(0, np.int64), np.concatenate([[0], np.cumsum(live)])


def _stretches(counts: np.ndarray) -> Iterator[slice]:
    """Cuts a list into stretches of at most AT_ONCE tokens, or of one item that has more."""
    ends = np.cumsum(counts)
    low = 0
    while low < len(counts):
        high = max(int(np.searchsorted(ends, ends[low] - counts[low] + AT_ONCE, side="right")), low + 1)
        yield slice(low, high)
        low = high


def expect(classes: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of classes by state, of moves, and of states at the start of texts."""
    begins, lengths, opens = _runs(classes, sizes)
    states = len(model.start)
    counts, moved, opened = np.zeros((states, len(model.ratio))), np.zeros((states, states)), np.zeros(states)
    for part in _stretches(lengths):
        found = _expect_runs(classes, begins[part], lengths[part], opens[part], model)
        for total, more in zip((counts, moved, opened), found):
            total += more
    return counts.T, moved * model.moves, opened


def _expect_runs(
    classes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, opens: np.ndarray, model: Model
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts by state and class, the moves not yet weighed by their probability, the starts of some runs."""
    states = len(model.start)
    order, steps = _by_step(begins, lengths)
    classes = classes[order]
    emitted = model.ratio[classes]
    ahead = np.empty_like(emitted)
    scale = np.empty((len(classes), 1))
    now = np.tile(model.start, (len(begins), 1))
    for at, (low, high) in enumerate(zip(steps, steps[1:])):
        now = (now[: high - low] @ model.moves if at else now) * emitted[low:high]
        total = now.sum(axis=1, keepdims=True)
        now /= total
        scale[low:high], ahead[low:high] = total, now
    moved = np.zeros((states, states))
    behind = np.ones((len(begins), states))
    back = model.moves.T.copy()
    emitted /= scale
    for at in reversed(range(len(steps) - 1)):
        low, high = steps[at], steps[at + 1]
        live = high - low
        weighted = emitted[low:high]
        weighted *= behind[:live]
        ahead[low:high] *= behind[:live]  # the posterior of the state
        if at:
            before = steps[at - 1]
            moved += ahead[before : before + live].T @ weighted
            behind[:live] = weighted @ back
    counts = np.stack([np.bincount(classes, ahead[:, s], minlength=len(model.ratio)) for s in range(states)])
    return counts, moved, ahead[: len(begins)][opens].sum(axis=0)


def log_ratio(classes: np.ndarray, sizes: np.ndarray, model: Model, known: np.ndarray) -> np.ndarray:
    """log10 of the sum over state paths for each text, by the scaled forward recursion."""
    longest_first = np.argsort(-sizes, kind="stable")
    order, steps = _by_step((np.cumsum(sizes) - sizes)[longest_first], sizes[longest_first])
    out = np.zeros(len(sizes))
    now = np.tile(model.start, (len(sizes), 1))
    for part in _stretches(np.diff(steps)):
        first = steps[part.start]
        tokens = order[first : steps[part.stop]]
        emitted = model.ratio[classes[tokens]]
        emitted[~known[tokens]] = 1.0
        for at in range(part.start, part.stop):
            low, high = steps[at] - first, steps[at + 1] - first
            now = (now[: high - low] @ model.moves if at else now) * emitted[low:high]
            total = now.sum(axis=1, keepdims=True)
            now /= total
            out[: high - low] += np.log10(total[:, 0])
    result = np.empty_like(out)
    result[longest_first] = out
    return result


def _with_ends(classes: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every token of a block with the end of each text, and sizes with it."""
    return np.insert(classes[tokens], np.cumsum(sizes), END), sizes + 1


def train(blocks: DataFrame, base: np.ndarray) -> Model:
    """ROUNDS rounds of Baum-Welch over the training texts of all blocks.

    ``base`` is the unigram probability of each class. What reaches the driver in a round are
    the sums by class and state: a table of fixed size whatever the corpus.
    """
    spark = blocks.sparkSession
    columns = [f"s{s}" for s in range(STATES)]
    model = first_model(base)
    seen = np.where(base > 0, base, 1.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1, STATES))
        moved, opened = np.zeros((STATES, STATES)), np.zeros(STATES)
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = _array(batch, row, "sizes")
                train = ~_array(batch, row, "held").astype(bool)
                tokens = _array(batch, row, "tokens")[np.repeat(train, sizes)]
                part = expect(*_with_ends(_array(batch, row, "classes"), tokens, sizes[train]), model)
                total += part[0]
                moved += part[1]
                opened += part[2]
        rows = np.vstack([total, moved, opened[None, :]])
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array(rows[used, s]) for s in range(STATES))], ["at", *columns]
        )

    parts = blocks.select("held", "sizes", "tokens", "classes").coalesce(max(1, spark.sparkContext.defaultParallelism))
    schema = "at int, " + ", ".join(f"{c} double" for c in columns)
    for _ in range(ROUNDS):
        sums = parts.mapInArrow(count, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        rows = np.zeros((CLASSES + 1 + STATES + 1, STATES))
        if sums.num_rows:
            rows[sums.column("at").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in columns], axis=1)
        emitted = rows[: CLASSES + 1] + PRIOR * base[:, None]
        moved = rows[CLASSES + 1 : -1] + 1.0 / STATES
        opened = rows[-1] + 1.0
        model = Model(
            opened / opened.sum(),
            moved / moved.sum(axis=1, keepdims=True),
            np.where(base[:, None] > 0, emitted * base.sum() / np.maximum(emitted.sum(axis=0), 1e-300) / seen[:, None], 1.0),
        )
    return model


def score(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", modulus: int = 5, part: int = 1
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose identifier's checksum has not the remainder ``part``; a
    NULL identifier learns too. NULL texts are empty and consist of their end alone. Scores
    are log10 probabilities. Rows repeat as they come, other columns are not read, an empty
    table gives an empty result; without training rows every word is unknown.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        held_out(id_column, modulus, part).alias("held"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(chars // BLOCK_CHARS) + 1
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int")
    dealt = rows.select(block.alias("block"), "doc_id", "held", "text").repartitionById(count, F.col("block"))
    blocks = stage(dealt.groupBy("block").applyInArrow(_pack, BLOCK_SCHEMA), "lm-blocks")

    # Every block's words with their counts in the whole corpus; a word is in a block once.
    own = blocks.select("block", "held", "sizes", "tokens", "words", "classes").mapInArrow(
        _word_counts, "block int, place int, word bigint, class int, n bigint"
    )
    everywhere = Window.partitionBy("word")
    counted = stage(
        own.select(
            "block", "place", "class",
            F.sum("n").over(everywhere).alias("c"),
            (F.row_number().over(everywhere.orderBy("block")) == 1).alias("first"),
        ),
        "lm-counts",
    )
    per_class = (
        counted.where(F.col("first") & (F.col("c") > 0)).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()
    )
    ends = rows.agg(F.count_if(~F.col("held"))).first()[0]
    mass, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    if per_class.num_rows:
        at = per_class.column("class").to_numpy()
        mass[at], kinds[at] = per_class.column("c").to_numpy(), per_class.column("v").to_numpy()
    if ends:
        mass[END], kinds[END] = ends, 1
    total, distinct = int(mass.sum()), int(kinds.sum())
    bottom = total + 0.5 * (distinct + 1)
    base = np.where(kinds > 0, (mass + 0.5 * kinds) / bottom, 0.0)
    model = train(blocks, base)

    places = counted.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, tokens = _array(batch, row, "sizes"), _array(batch, row, "tokens")
                counts = _array(batch, row, "counts") if batch.column("counts")[row].is_valid else np.empty(0, np.int64)
                text = np.repeat(np.arange(len(sizes)), sizes)
                unigram = np.log10((counts + 0.5) / bottom)
                plain = np.bincount(text, unigram[tokens], minlength=len(sizes)) + np.log10((ends + 0.5) / bottom)
                known = counts[tokens] > 0
                met = np.bincount(text, known, minlength=len(sizes)).astype(np.int64) + (ends > 0)
                classes, longer = _with_ends(_array(batch, row, "classes"), tokens, sizes)
                usable = np.insert(known, np.cumsum(sizes), ends > 0)
                more = log_ratio(classes, longer, model, usable)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[row].values,
                        batch.column("held")[row].values,
                        pa.array(longer.astype(np.int64)),
                        pa.array(met),
                        pa.array(np.full(len(sizes), total, np.int64)),
                        pa.array(plain),
                        pa.array(plain + more),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    narrow = blocks.select("block", "doc_ids", "held", "sizes", "tokens", "classes")
    return (
        narrow.join(places, "block", "left")
        .select("doc_ids", "held", "sizes", "tokens", "classes", "counts")
        .mapInArrow(
            run,
            "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        )
        .withColumnRenamed("doc_id", id_column)
    )
