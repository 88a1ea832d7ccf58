"""Which filter removes what, in every order of the filters, with exact repeats found by fingerprint.

Documents are routed by xxhash as an RDD. Each task first keeps chains of its own: for a fingerprint the texts that share it, each
in full with its least id; a row that is not the least of its text goes on at once as settled, without its text, so copies of a
text cost one routed text a task, however many there are. After the shuffle, which sorts by fingerprint, one chain at a time is
held, and ids that turn out not to be the least are emitted as they lose. Masks of failed filters are then counted as vectors by
part (combineByKey, so a task sends one vector a part), and all orders are read off a part's vector.

Null texts count as empty and null parts as the empty string. A null id is less than no other and takes no part in chains. Rows
that repeat both id and text are all least, or all not. Extra columns are ignored, whatever their names are. Empty tables give
no rows. What a task holds: HELD bytes of texts before the shuffle, one fingerprint's texts after it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import text_or_empty

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
#: Bytes of texts that a task holds in chains of its own before it sends them on.
HELD = 32 << 20
#: Documents that a task sorts by fingerprint, at most on average.
ROUTED = 20_000

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = b"#$%&*|"

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed(text: str) -> int:
    """The filters A to D that a text fails, as bits: under 100 words, few distinct words, many capitals, a mark."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at the space and the controls 0x09 to 0x0D
    short = len(words) < 100
    few = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _UPPER))) > 10 * len(text)
    marked = len(data.translate(None, _MARKS)) < len(data)
    return short | few << 1 | loud << 2 | marked << 3


def _enter(chain: list[list], text: str, mask: int, doc_id: int, parts: dict[str, int]) -> tuple | None:
    """Puts the rows of an id (their number by part) into the chain of its fingerprint; gives those that are not the least, if any."""
    for held in chain:
        if held[0] == text:
            if doc_id == held[2]:
                for part, n in parts.items():
                    held[3][part] = held[3].get(part, 0) + n
                return None
            lost = (doc_id, parts) if doc_id > held[2] else tuple(held[2:])
            if doc_id < held[2]:
                held[2:] = [doc_id, dict(parts)]
            return lost
    chain.append([text, mask, doc_id, dict(parts)])
    return None


def _settled(doc_id: int | None, parts: dict[str, int], mask: int) -> Iterator[tuple]:
    for part, n in parts.items():
        yield doc_id, part, mask, n


def _local(rows: Iterable) -> Iterator[tuple]:
    """(fingerprint, row): rows that are settled without their texts, under a key of their own, and a task's least rows with them."""
    chains: dict[int, list[list]] = {}
    size = spread = 0

    def held() -> Iterator[tuple]:
        for mark, chain in chains.items():
            for text, mask, doc_id, parts in chain:
                yield mark, (doc_id, parts, mask, text)

    for mark, doc_id, text, part in rows:
        chain = chains.setdefault(mark, [])
        before = len(chain)
        if doc_id is None:
            lost, mask = (None, {part: 1}), failed(text)
        else:
            mask = next((x[1] for x in chain if x[0] == text), None)
            mask = failed(text) if mask is None else mask
            lost = _enter(chain, text, mask, doc_id, {part: 1})
            mask |= REPEAT
        if lost:
            spread += 1
            yield spread * 0x9E3779B97F4A7C15 + mark, (*lost, mask, None)
        if len(chain) > before:
            size += len(text) + 200
            if size > HELD:
                yield from held()
                chains.clear()
                size = 0
    yield from held()


def _chained(rows: Iterable) -> Iterator[tuple]:
    """doc_id, part, mask, n of rows sorted by fingerprint: one chain is held at a time."""
    for _, same in itertools.groupby(rows, key=lambda x: x[0]):
        chain: list[list] = []
        for _, (doc_id, parts, mask, text) in same:
            if text is None:
                yield from _settled(doc_id, parts, mask)
            elif lost := _enter(chain, text, mask, doc_id, parts):
                yield from _settled(*lost, mask | REPEAT)
        for _, mask, doc_id, parts in chain:
            yield from _settled(doc_id, parts, mask)


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask (bit i: fails filter i of FILTERS), n: the rows of docs that have these."""
    rows = docs.select(F.xxhash64(text_or_empty()), F.col("doc_id").cast("long"), text_or_empty(), F.coalesce(F.col(part).cast("string"), F.lit(""))).rdd
    n = max(rows.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROUTED)
    routed = rows.mapPartitions(_local).repartitionAndSortWithinPartitions(n, lambda mark: mark % n)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(_chained), "doc_id long, part string, mask int, n long", verifySchema=False)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id of documents whose text a smaller id has too."""
    return failures(docs).where(F.col("mask").bitwiseAND(REPEAT) != 0).select("doc_id").distinct()


def _counted(row: tuple) -> np.ndarray:
    """The vector of one row (mask, good, toxic, n): counts by 4 * mask + 2 * good + toxic."""
    return _added(np.zeros(4 << len(FILTERS), np.int64), row)


def _added(counts: np.ndarray, row: tuple) -> np.ndarray:
    mask, good, toxic, n = row
    counts[4 * mask + 2 * good + toxic] += n
    return counts


def _orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: every order of the filters, step by step."""
    masks, by = np.arange(len(counts) // 4), counts.reshape(-1, 2, 2)
    whole, good, toxic = by.sum(axis=(1, 2)), by[:, 1].sum(axis=1), by[:, :, 1].sum(axis=1)
    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in map("".join, itertools.permutations(FILTERS)):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            here, late = (masks & bit != 0) & (masks & earlier == 0), (masks & bit != 0) & (masks & earlier != 0)
            earlier |= bit
            removed = int(whole[here].sum())
            shapley[letter] += removed
            steps.append((part, order, step, int(whole[masks & earlier == 0].sum()), removed, int(whole[late].sum()), int(whole[bit]), int(good[here].sum()), int(toxic[here].sum())))
    for row in steps:
        yield (*row, shapley[row[1][row[2] - 1]])


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """AUDIT: for each part, order of the filters and step, the documents that stay, go, or went before. Labels that repeat an
    id count as set where any row sets them."""
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    rows = failures(docs).join(marks, "doc_id", "left").select("part", "mask", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)), "n")
    vectors = rows.rdd.map(lambda r: (r[0], r[1:])).combineByKey(_counted, _added, np.add)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: _orders(*x)), AUDIT, verifySchema=False)
