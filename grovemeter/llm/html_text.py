"""Main text of web pages by structure and by what a host's pages repeat.

A page is cut into blocks of text; a block knows whether it stands in the article, in a part
that pages repeat (menus, headers, footers, sidebars, notices, adverts, forms, comments), or
in neither. The blocks of a page are one stream of tokens. Its tokens are covered that lie in
a run of LONG tokens which stands on distinct pages of the host too; that is what all longer
repeats cover. Covered blocks are boilerplate in the article and beside it; so are the marked
parts, on hosts too small to repeat anything. Pages of equal main text are copies and count as
one page, so that none of them covers another. An article at least half of whose tokens are in
covered blocks is an edited copy of another one and stays whole.

Hosts of up to SHELF pages are worked on one by one: the suffixes of the host's stream are
sorted by prefix doubling, to a depth of LONG tokens, and suffixes that tie are repeats. Larger
hosts find the same runs over all tasks in two rounds, and what is sent is packed. First each
batch of pages sends marks: the least of the hashes of the grams of GRAM tokens in a run. Equal
runs have equal marks, there are about a third as many marks as runs, and three bytes hold one.
Buckets of even size by hash answer with a bit for each mark, whether other batches have it too. Only runs
with such a mark are sent then, hashed with the host, and answered with a bit for each that came from
distinct pages. However common a run is, a batch sends it once. Runs are told apart by 64-bit
hashes, the pages of a run by 32-bit ones; marks of MARK_BITS only choose what is looked at. The
blocks are bucketed by batch and stay where they are.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemeter.llm.common import let_workers_import, partitions, whole
from grovemeter.llm.url_filter import host_of
from grovemeter.scratch import new_scratch_path, stage, stage_packed

LONG = 8
#: Pages of a host up to which one task works on the whole host.
SHELF = 200
COVERED = 0.9
#: Pages and tokens of a batch at which the next one begins, and runs of a bucket.
BATCH_PAGES = 1000
BATCH_TOKENS = 500_000
BUCKET_RUNS = 2_000_000
#: Tokens of the grams that marks are the least of, and bits of a mark.
GRAM = 5
MARK_BITS = 38
#: Bytes of text that are hashed at once.
HASHED_BYTES = 1 << 20

PLAIN, ARTICLE, REPEATED, HIDDEN = range(4)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
CLOSES_ITSELF = frozenset("p li dt dd td th tr option".split())
NEVER_TEXT = frozenset("head title script style noscript template iframe object svg math audio video canvas".split())
NO_ARTICLE = frozenset("nav header footer aside form menu dialog button select textarea".split())
IS_ARTICLE = frozenset("article main".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in a class, id or role that mark a part as no article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|header|login|masthead|menu|modal|nav\w*|"
    r"newsletter|notices?|pager|pagination|popup|promo\w*|related|search|share|sharing|sidebar|social|sponsor\w*|subscribe|"
    r"toolbar|widget)(?=$|[\s_-])",
    re.IGNORECASE,
)


class Blocks(HTMLParser):
    """Collects (zone, text) of the blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = []
        self.pieces: list[str] = []

    @property
    def zone(self) -> int:
        return self.open[-1][1] if self.open else PLAIN

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.found.append((self.zone, text))
            self.pieces = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in EMPTY:
            if tag == "br":
                self.pieces.append(" ")
            elif tag == "hr":
                self.flush()
            return
        marked = any(name in ("class", "id", "role") and value and MARKS.search(value) for name, value in attrs)
        known = tag in BLOCKS or tag in NEVER_TEXT or tag in NO_ARTICLE
        if not known and not marked:
            return
        if known and tag not in ("button", "select", "textarea", *(NEVER_TEXT - BLOCKS)):
            self.flush()
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            if tag in CLOSES_ITSELF and self.open and self.open[-1][0] == tag:
                self.open.pop()
        elif self.zone != HIDDEN:
            self.flush_if_zone_changes(tag, marked)
        self.open.append((tag, self._zone_of(tag, marked)))

    def _zone_of(self, tag: str, marked: bool) -> int:
        zone = self.zone
        if zone == HIDDEN or tag in NEVER_TEXT:
            return HIDDEN
        if zone == REPEATED or tag in NO_ARTICLE or (marked and tag not in ("html", "body", *IS_ARTICLE)):
            return REPEATED
        return ARTICLE if tag in IS_ARTICLE else zone

    def flush_if_zone_changes(self, tag: str, marked: bool) -> None:
        if self._zone_of(tag, marked) not in (self.zone, HIDDEN):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                if tag in BLOCKS or self.open[at][1] != (self.open[at - 1][1] if at else PLAIN) != HIDDEN and self.open[at][1] != HIDDEN:
                    self.flush()
                del self.open[at:]
                return
            if tag in CLOSES_ITSELF and self.open[at][0] in BLOCKS - CLOSES_ITSELF:
                return

    def handle_data(self, data: str) -> None:
        if self.zone != HIDDEN:
            self.pieces.append(data)


#: A tag that the end of the page cuts off.
CUT_TAG = re.compile(r"</?[a-zA-Z][^<>]*\Z")


def blocks_of(html: str) -> list[tuple[int, str]]:
    parser = Blocks()
    parser.feed(CUT_TAG.sub("", html))
    parser.close()
    parser.flush()
    return parser.found


def cover(size: int, starts: np.ndarray, long: int) -> np.ndarray:
    """Which of ``size`` tokens lie in a run of ``long`` that begins at one of ``starts``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + long, -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_tokens(tokens: np.ndarray, pages: np.ndarray, long: int = LONG, copies: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a substring of at least ``long`` tokens found on distinct pages.

    ``pages`` numbers the page of each token, ascending; substrings do not cross pages. Pages
    with the same number in ``copies`` are one page. Ranks of suffixes are doubled until they
    tell suffixes by their first ``long`` tokens.
    """
    size = len(tokens)
    covered = np.zeros(size, bool)
    if size < long:
        return covered
    ranks, depth = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while depth < long:
        step = min(depth, long - depth)
        ahead = np.zeros(size, np.int64)
        ahead[:-step] = ranks[step:]
        ranks = np.unique(ranks * (size + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        depth += step
    inside = np.flatnonzero(pages[: size - long + 1] == pages[long - 1 :])
    owners = pages[inside] if copies is None else copies[pages[inside]]
    met = np.unique(ranks[inside] * (pages[-1] + 1) + owners)
    many = np.bincount(met // (pages[-1] + 1), minlength=size + 2) > 1
    return cover(size, inside[many[ranks[inside]]], long)


Page = tuple[list[int], list[str]]


def main_of(page: Page) -> str:
    """What a page is a copy by: its text without the marked parts."""
    return "\n".join(block for zone, block in zip(*page) if zone != REPEATED)


class Stream:
    """The tokens of some pages end to end, numbered in the order of their first use."""

    def __init__(self, pages: list[Page]) -> None:
        numbers: dict[str, int] = {}
        tokens: list[int] = []
        owners, sizes = [], []
        for page, (_, blocks) in enumerate(pages):
            for block in blocks:
                words = block.split(" ")
                tokens += [numbers.setdefault(w, len(numbers)) for w in words]
                sizes.append(len(words))
                owners.append(page)
        self.tokens = np.array(tokens, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.owners = np.repeat(np.array(owners, np.int64), self.sizes)


def texts_of(pages: list[Page], block_sizes: np.ndarray, covered: np.ndarray) -> list[str]:
    """The main text of each page, given the tokens of all blocks and which tokens repeats cover."""
    ends = np.concatenate([[0], np.cumsum(covered)])
    last = np.cumsum(block_sizes)
    share = (ends[last] - ends[last - block_sizes]) / np.maximum(block_sizes, 1)
    texts, at = [], 0
    for zones, blocks in pages:
        repeated, sizes = share[at : at + len(blocks)] >= COVERED, block_sizes[at : at + len(blocks)]
        at += len(blocks)
        inside = np.array(zones) == ARTICLE
        copied = 2 * sizes[inside & repeated].sum() >= sizes[inside].sum()
        kept = [
            block
            for zone, block, boilerplate in zip(zones, blocks, repeated)
            if zone in (PLAIN, ARTICLE) and (not boilerplate or (zone == ARTICLE and copied))
        ]
        texts.append("\n".join(kept))
    return texts


def choose(pages: list[Page]) -> list[str]:
    """The main text of each page of one whole host, from its zones and block texts."""
    stream = Stream(pages)
    known: dict[str, int] = {}
    copies = np.array([known.setdefault(main_of(page), len(known)) for page in pages], np.int64)
    return texts_of(pages, stream.sizes, repeated_tokens(stream.tokens, stream.owners, copies=copies))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


FACTOR = 0x9E3779B97F4A7C15


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.array([_number(f"byte {b}") for b in range(256)], np.uint64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR to the powers from 0 on, and their inverses modulo 2 ** 64."""
    up, down = np.full(size, FACTOR, np.uint64), np.full(size, pow(FACTOR, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def hashed_spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each span of ``values``, whatever stands around it."""
    up, down = _powers(max(HASHED_BYTES, 1 << len(values).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])])
    # an empty span may begin at the end of the values, where there is no power to divide by
    return _mixed((sums[stops] - sums[starts]) * down[np.minimum(starts, len(down) - 1)])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """How many values each list has, and the values end to end."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


class Hashed:
    """The tokens of a batch of pages as 64-bit hashes, taken from the bytes of its blocks."""

    def __init__(self, pages: pa.Table) -> None:
        held, blocks = _flat(pages.column("blocks"))
        zones = _flat(pages.column("zones"))[1].to_numpy(zero_copy_only=False)
        blocks = blocks.cast(pa.large_string())
        if len(blocks):
            edges = np.frombuffer(blocks.buffers()[1], np.int64)[blocks.offset : blocks.offset + len(blocks) + 1]
            data = np.frombuffer(blocks.buffers()[2], np.uint8)[edges[0] : edges[-1]]
            edges = edges - edges[0]
        else:
            edges, data = np.zeros(1, np.int64), np.empty(0, np.uint8)
        spaces = np.flatnonzero(data == ord(" "))
        starts = np.sort(np.concatenate([edges[:-1], spaces + 1]))
        stops = np.sort(np.concatenate([spaces, edges[1:]]))
        self.sizes = np.diff(np.searchsorted(spaces, edges)) + 1
        self.owners = np.repeat(np.repeat(np.arange(len(held)), held), self.sizes)
        self.tokens = np.empty(len(starts), np.uint64)
        cuts = [*np.unique(np.searchsorted(starts, np.arange(0, len(data), HASHED_BYTES))).tolist(), len(starts)]
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                first = starts[low]
                values = _byte_values()[data[first : stops[high - 1]]]
                self.tokens[low:high] = hashed_spans(values, starts[low:high] - first, stops[low:high] - first)
        numbers = {host: _number(host) for host in set(pages.column("host").to_pylist())}
        self.hosts = np.array([numbers[host] for host in pages.column("host").to_pylist()], np.uint64)[self.owners]
        self.copies = self._copies(zones, len(held))
        inside = self.owners[: max(len(self.tokens) - LONG + 1, 0)] == self.owners[LONG - 1 :]
        self.starts = np.flatnonzero(inside)

    def _copies(self, zones: np.ndarray, pages: int) -> np.ndarray:
        """A number from 1 for the page of each token, equal for pages with equal ``main_of``."""
        first = np.zeros(len(self.tokens), np.uint64)
        first[np.cumsum(self.sizes) - self.sizes] = 1
        kept = np.repeat(zones != REPEATED, self.sizes)
        many = np.bincount(self.owners[kept], minlength=pages)
        stops = np.cumsum(many)
        mains = hashed_spans(_mixed(self.tokens + first)[kept], stops - many, stops)
        return (mains % np.uint64(2**32 - 1) + np.uint64(1)).astype(np.uint32)[self.owners]

    def grams(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the host and ``size`` tokens from each of ``starts`` on."""
        hashes = self.hosts[starts]
        for ahead in range(size):
            hashes = hashes * np.uint64(FACTOR) + self.tokens[starts + ahead]
            hashes ^= hashes >> np.uint64(29)
        return hashes * np.uint64(0xBF58476D1CE4E5B9)

    def marks(self) -> np.ndarray:
        """For each run, the least of the hashes of the grams in it, mixed to be even again."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        grams = self.grams(np.arange(len(self.tokens) - GRAM + 1), GRAM)
        least = np.minimum.reduce([grams[self.starts + ahead] for ahead in range(LONG - GRAM + 1)])
        return _mixed(least) >> np.uint64(64 - MARK_BITS)


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as the bytes of their steps, low bytes of all first; the high ones are zeros."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(cell: bytes) -> np.ndarray:
    steps = np.frombuffer(cell, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view(np.uint64).ravel(), dtype=np.uint64)


def cells_of(values: np.ndarray, bits: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending numbers of ``bits`` dealt to buckets by ranges."""
    bounds = np.array([(bucket << bits) // buckets for bucket in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(values, bounds).tolist(), len(values)]
    return [(bucket, a, b) for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]


def chosen(values: np.ndarray, bits: int, buckets: int, back: dict[int, bytes]) -> np.ndarray:
    """Those of the numbers sent to which the buckets' answers have a bit set."""
    mask = np.zeros(len(values), bool)
    for bucket, a, b in cells_of(values, bits, buckets):
        mask[a:b] = np.unpackbits(np.frombuffer(back[bucket], np.uint8), count=b - a)
    return values[mask]


def met_on(runs: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs, ascending, and for each the one page it is on, or 0 for several."""
    if not len(runs):
        return runs, copies
    order = np.argsort(runs)
    runs, copies = runs[order], copies[order]
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    least, most = np.minimum.reduceat(copies, first), np.maximum.reduceat(copies, first)
    return runs[first], np.where(least == most, least, np.uint32(0))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(html, ...) to (zones, blocks, ...)."""
    for batch in batches:
        zones, blocks = [], []
        for html in batch.column(0).to_pylist():
            found = blocks_of(html)
            zones.append([zone for zone, _ in found])
            blocks.append([text for _, text in found])
        yield pa.RecordBatch.from_arrays(
            [pa.array(zones, pa.list_(pa.int32())), pa.array(blocks, pa.list_(pa.string())), *batch.columns[1:]],
            ["zones", "blocks", *batch.schema.names[1:]],
        )


def _number_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses as ``_parse`` and numbers batches of pages; ``runs`` counts the tokens at most."""
    first = TaskContext.get().partitionId() << 32
    number, pages, tokens = first, 0, 0
    for batch in _parse(batches):
        numbers, sizes = [], []
        for blocks in batch.column(1).to_pylist():
            size = sum(block.count(" ") + 1 for block in blocks)
            if pages and (pages == BATCH_PAGES or tokens + size > BATCH_TOKENS):
                number, pages, tokens = number + 1, 0, 0
            pages, tokens = pages + 1, tokens + size
            numbers.append(number)
            sizes.append(size)
        columns = [*batch.columns, pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "batch", "runs"])


OF_MARKS, OF_RUNS = range(2)


def _sent(batch: int, values: np.ndarray, bits: int, buckets: int, copies: np.ndarray | None = None) -> pa.Table:
    cells = cells_of(values, bits, buckets)
    columns = {
        "batch": pa.array([batch] * len(cells), pa.int64()),
        "bucket": pa.array([bucket for bucket, _, _ in cells], pa.int32()),
        "sent": pa.array([packed(values[a:b]) for _, a, b in cells], pa.binary()),
    }
    if copies is not None:
        columns["copies"] = pa.array([copies[a:b].tobytes() for _, a, b in cells], pa.binary())
    return pa.table(columns)


def _answers(table: pa.Table, round_: int, sent: list[np.ndarray], known: np.ndarray) -> pa.Table:
    """To each batch, a bit for each number it sent: whether it is one of ``known``."""
    bits = [np.packbits(np.isin(part, known, assume_unique=True)).tobytes() for part in sent]
    kind = pa.array([round_] * len(bits), pa.int32())
    return pa.table([table.column("batch"), table.column("bucket"), kind, pa.array(bits, pa.binary())], ["batch", "bucket", "round", "bits"])


def _answer_marks(table: pa.Table) -> pa.Table:
    sent = [unpacked(cell) for cell in table.column("sent").to_pylist()]
    marks, batches = np.unique(np.concatenate(sent), return_counts=True)
    return _answers(table, OF_MARKS, sent, marks[batches > 1])


def _answer_runs(table: pa.Table) -> pa.Table:
    sent = [unpacked(cell) for cell in table.column("sent").to_pylist()]
    copies = np.concatenate([np.frombuffer(cell, np.uint32) for cell in table.column("copies").to_pylist()])
    runs, pages = met_on(np.concatenate(sent), copies)
    return _answers(table, OF_RUNS, sent, runs[pages == 0])


class _Rounds:
    """What a batch of pages sends in either round, and its texts."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def marks(self, pages: pa.Table) -> pa.Table:
        return _sent(pages.column("batch")[0].as_py(), np.unique(Hashed(pages).marks()), MARK_BITS, self.buckets)

    def _asked(self, hashed: Hashed, back: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs, those repeated within the batch, and those to ask for with their pages."""
        marks, hashes = hashed.marks(), hashed.grams(hashed.starts, LONG)
        runs, pages = met_on(hashes, hashed.copies[hashed.starts])
        known = chosen(np.unique(marks), MARK_BITS, self.buckets, _bits(back, OF_MARKS))
        elsewhere = np.isin(runs, hashes[np.isin(marks, known)], assume_unique=False)
        return hashes, runs[pages == 0], runs[elsewhere], pages[elsewhere]

    def runs(self, pages: pa.Table, back: pa.Table) -> pa.Table:
        _, _, runs, copies = self._asked(Hashed(pages), back)
        return _sent(pages.column("batch")[0].as_py(), runs, 64, self.buckets, copies)

    def texts(self, pages: pa.Table, back: pa.Table) -> pa.Table:
        hashed = Hashed(pages)
        hashes, here, runs, _ = self._asked(hashed, back)
        shared = np.concatenate([here, chosen(runs, 64, self.buckets, _bits(back, OF_RUNS))])
        covered = cover(len(hashed.tokens), hashed.starts[np.isin(hashes, shared)], LONG)
        blocks = list(zip(pages.column("zones").to_pylist(), pages.column("blocks").to_pylist()))
        return _with_texts(pages, texts_of(blocks, hashed.sizes, covered))


def _bits(back: pa.Table, round_: int) -> dict[int, bytes]:
    answers = zip(*(back.column(name).to_pylist() for name in ("round", "bucket", "bits")))
    return {bucket: bits for kind, bucket, bits in answers if kind == round_}


def _host(pages: pa.Table) -> pa.Table:
    return _with_texts(pages, choose(list(zip(pages.column("zones").to_pylist(), pages.column("blocks").to_pylist()))))


def _with_texts(pages: pa.Table, texts: list[str]) -> pa.Table:
    return pa.table([pages.column("id"), pages.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars.

    NULL html counts as empty, and a page without main text has the empty text. Pages without a
    host are treated as one host. Rows repeat as they come; pages of a host that are equal
    outside their marked parts count as one page. Other columns are not read; an empty table
    gives an empty result.
    """
    spark = pages.sparkSession
    let_workers_import(spark)
    host = host_of(F.col(url_column))
    counts = pages.select(host.alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    large = stage(counts.where(F.col("pages") > SHELF), "html-hosts")
    rows = pages.select(
        whole(html_column).alias("html"), F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), host.alias("host")
    )
    kind = dict(rows.dtypes)["id"]
    parsed = f"zones array<int>, blocks array<string>, id {kind}, url string, host string"
    result = f"id {kind}, url string, text string"
    found = rows.join(large.select("host"), "host", "left_anti").select(*rows.columns).mapInArrow(_parse, parsed).groupBy("host").applyInArrow(_host, result)
    many = large.agg(F.sum("pages")).first()[0]
    if many:
        numbered = rows.join(large.select("host"), "host", "left_semi").select(*rows.columns)
        numbered = numbered.mapInArrow(_number_batches, parsed + ", batch long, runs long")
        # bucketed by batch, so that blocks stay where they are when answers come to them
        name = f"html_{uuid.uuid4().hex}"
        writer = numbered.write.format("parquet").option("compression", "zstd").option("path", new_scratch_path(spark, "html-blocks"))
        writer.bucketBy(max(-(-many // (4 * BATCH_PAGES)), partitions(spark)), "batch").sortBy("batch").saveAsTable(name)
        numbered = spark.table(name)
        runs = numbered.agg(F.sum("runs")).first()[0] or 0
        rounds = _Rounds(max(-(-runs // BUCKET_RUNS), partitions(spark)))
        batches, answer = numbered.select("batch", "host", "zones", "blocks"), "batch long, bucket int, round int, bits binary"
        marks = batches.groupBy("batch").applyInArrow(lambda pages: rounds.marks(pages), "batch long, bucket int, sent binary")
        back = stage_packed(marks.groupBy("bucket").applyInArrow(_answer_marks, answer), "html-marks")
        sent = batches.groupBy("batch").cogroup(back.groupBy("batch"))
        sent = sent.applyInArrow(lambda pages, back: rounds.runs(pages, back), "batch long, bucket int, sent binary, copies binary")
        back = back.union(sent.groupBy("bucket").applyInArrow(_answer_runs, answer))
        texts = numbered.drop("runs").groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(lambda pages, back: rounds.texts(pages, back), result)
        found = found.union(texts)
        spark.sql(f"DROP TABLE {name}")  # its files stay until scratch is released
    return found.select(
        F.col("id").alias(id_column), F.col("url").alias(url_column), "text", F.char_length("text").cast("long").alias("n_chars")
    )
