"""Evaluation texts that stand in training documents, wholly or in part.

Rare n-gram seeds join documents to test items, a Smith-Waterman alignment scores each joined pair, and an exact check of
the longest unbroken run may follow. Texts are compared by their letters, combining marks and digits, case ignored.

Where a document must have half of an item in one run, seeds of the item are the rarest n-gram of every stretch as long as
half the item, rarity being the number of documents of the whole corpus that have the n-gram. Such a document has a whole
such stretch, so it has a seed: no such document is lost. A stretch one of whose n-grams no document has needs no seed.

An edited copy needs no whole stretch, and its n-grams may be anything but the rarest. Where such copies are asked for, every
n-gram of an item is a seed.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thornbill.llm.hashing import Rolling, code_points
from thornbill.tables import canonical, table

#: Characters of an n-gram; items of which half is shorter use that half.
GRAM = 12
#: Characters of test items that travel with the code at once; more items go through in blocks of about this size.
BLOCK_CHARS = 500_000
#: Pairs aligned together, and characters that they have together at most, unless one pair alone has more.
ALIGNED, ALIGNED_CELLS = 256, 1 << 20
MATCH, MISMATCH, GAP = 2, -1, 2
_FILTER_BITS = 20


class Grams:
    """A set of n-gram hashes by length, tested against texts at once with a bit table before an exact look-up."""

    def __init__(self, by_length: dict[int, np.ndarray]):
        self.by_length = {}
        for k, hashes in by_length.items():
            table_ = np.zeros(1 << _FILTER_BITS, bool)
            table_[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.by_length[k] = (np.sort(hashes), table_)

    def hits(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``length, text number, place in the text, hash`` of all n-grams of the set in ``texts``."""
        lengths = np.array([len(t) for t in texts])
        starts = np.r_[0, np.cumsum(lengths + 1)]
        points = code_points("\0".join(texts) + "\0")
        rolling = Rolling(points)
        for k, (hashes, table_) in self.by_length.items():
            at = np.arange(max(0, len(points) - k + 1))
            seen = rolling.of(at, at + k)
            at = np.flatnonzero(table_[(seen >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            found = seen[at]
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            same = hashes[place] == found
            at, found = at[same], found[same]
            text = np.searchsorted(starts, at, "right") - 1
            yield k, text, at - starts[text], found


def item_grams(text: str) -> tuple[int, int, np.ndarray]:
    """``need, k, hashes``: half of the item's length rounded up, the length of its n-grams and the hash of each."""
    need = (len(text) + 1) // 2
    k = min(GRAM, need)
    at = np.arange(len(text) - k + 1)
    return need, k, Rolling(code_points(text)).of(at, at + k)


def _count_documents(docs: DataFrame, grams: Grams) -> dict[tuple[int, int], int]:
    """In how many documents each n-gram of the set stands; those that stand in none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = defaultdict(int)
        for batch in batches:
            for i in range(0, len(batch), 200):
                for k, text, _, found in grams.hits(batch.column(1).slice(i, 200).to_pylist()):
                    if len(found):
                        once = np.unique(np.rec.fromarrays([found, text]))
                        for h, n in zip(*np.unique(once.f0, return_counts=True)):
                            counts[k, int(h)] += int(n)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array(np.array([h for _, h in keys], np.uint64).view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["k", "gram", "n"])

    rows = docs.mapInArrow(run, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).collect()
    return {(r.k, r.gram & (1 << 64) - 1): r.n for r in rows}


def choose_seeds(items: list[tuple[int, str]], documents: dict[tuple[int, int], int]) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """Length → n-gram → ``(item number, place)``: the rarest n-gram of every stretch of half an item, ties to the lesser hash."""
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for number, (_, text) in enumerate(items):
        need, k, hashes = item_grams(text)
        ranks = [(documents.get((k, int(h)), 0), int(h), i) for i, h in enumerate(hashes)]
        span = need - k + 1
        chosen = {min(ranks[i : i + span]) for i in range(len(ranks) - span + 1)}
        for n, h, i in chosen:
            if n:
                # Every place of the n-gram in the item counts, as the document's run may hold any of them.
                seeds[k][h] += [(number, j) for j, other in enumerate(hashes) if int(other) == h and (number, j) not in seeds[k][h]]
    return {k: dict(v) for k, v in seeds.items()}


def every_seed(items: list[tuple[int, str]]) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """Like ``choose_seeds``, with every n-gram of every item."""
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for number, (_, text) in enumerate(items):
        _, k, hashes = item_grams(text)
        for i, h in enumerate(hashes.tolist()):
            seeds[k][h].append((number, i))
    return {k: dict(v) for k, v in seeds.items()}


def _align_padded(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``align`` of several pairs at once, anti-diagonal by anti-diagonal; a row an item's place, a column a pair."""
    n, m = max(map(len, a)), max(map(len, b))
    # Padding is of no text and differs between both sides, so it never matches.
    items, texts = np.full((n, len(a)), 0xFFFFFFFF, np.uint32), np.full((m + 2 * n, len(a)), 0xFFFFFFFE, np.uint32)
    for i, (x, y) in enumerate(zip(a, b)):
        items[: len(x), i] = x
        texts[n + m - len(y) : n + m, i] = y[::-1]
    kind = np.int16 if MATCH * n < 1 << 14 else np.int32
    before, last, row = (np.zeros((n + 1, len(a)), kind) for _ in range(3))
    best = np.zeros((n, len(a)), kind)
    for d in range(n + m - 1):
        same = items == texts[n + m - 1 - d : 2 * n + m - 1 - d]
        now = row[1:]
        np.multiply(same, kind(MATCH - MISMATCH), out=now)
        now += kind(MISMATCH)
        now += before[:-1]
        np.maximum(now, np.maximum(last[:-1], last[1:]) - kind(GAP), out=now)
        np.maximum(now, kind(0), out=now)
        np.maximum(best, now, out=best)
        before, last, row = last, row, before
    return best.max(axis=0)


def alignments(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The Smith-Waterman score of the best local alignment of each pair of sequences of code points. Pairs of like length
    are aligned together."""
    out = np.zeros(len(a), np.int64)
    order = sorted((i for i in range(len(a)) if len(a[i]) and len(b[i])), key=lambda i: (len(b[i]), len(a[i])))
    while order:
        # The longest come last; as many go together as keep the memory bounded.
        size = len(b[order[-1]]) + 2 * max(len(a[i]) for i in order[-ALIGNED:])
        part = order[-max(1, min(ALIGNED, ALIGNED_CELLS // size)) :]
        del order[-len(part) :]
        out[part] = _align_padded([a[i] for i in part], [b[i] for i in part])
    return out


def align(a: np.ndarray, b: np.ndarray) -> int:
    """The Smith-Waterman score of the best local alignment of two sequences of code points."""
    return int(alignments([a], [b])[0])


def stretches_around(places: list[tuple[int, int, int]], n: int) -> list[tuple[int, int]]:
    """The stretches of a document to which an alignment through a seed at ``(place in doc, place in item, length)`` can
    reach if it has half of the score of the whole item, of ``n`` letters: its gaps cost at most the other half, so they are
    at most half the item. Stretches that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted({(max(0, p - q - n // 2), p - q + n + n // 2) for p, q, _ in places}):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def longest_run(doc: str, item: str, places: list[tuple[int, int]], k: int) -> int:
    """The length of the longest common run through any of the seeds at ``(place in doc, place in item)``."""
    best, seen = 0, {}
    for d, i in sorted(set(places)):
        if seen.get(d - i, -1) >= d + k:
            continue
        a = 0
        while d - a > 0 and i - a > 0 and doc[d - a - 1] == item[i - a - 1]:
            a += 1
        b = k
        while d + b < len(doc) and i + b < len(item) and doc[d + b] == item[i + b]:
            b += 1
        seen[d - i] = d + b
        best = max(best, a + b)
    return best


def _scan(docs: DataFrame, items: list[tuple[int, str]], seeds: dict) -> DataFrame:
    """``doc, item, score, run, n``: the pairs that share a seed."""
    grams = Grams({k: np.array(list(v), np.uint64) for k, v in seeds.items()})
    reach = {i: code_points(t) for i, (_, t) in enumerate(items)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                out, sides, windows, owner = [], [], [], []
                ids = batch.column(0).slice(i, 200).to_pylist()
                texts = batch.column(1).slice(i, 200).to_pylist()
                pairs: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
                for k, text, place, found in grams.hits(texts):
                    for t, p, h in zip(text.tolist(), place.tolist(), found.tolist()):
                        for number, q in seeds[k][h]:
                            pairs[t, number].append((p, q, k))
                for (t, number), places in pairs.items():
                    item = items[number][1]
                    n, k = len(item), places[0][2]
                    for low, high in stretches_around(places, n):
                        sides.append(reach[number])
                        windows.append(code_points(texts[t][low:high]))
                        owner.append(len(out))
                    out.append([ids[t], items[number][0], 0, longest_run(texts[t], item, [(p, q) for p, q, _ in places], k), n])
                for o, score in zip(owner, alignments(sides, windows).tolist()):
                    out[o][2] = max(out[o][2], score)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc", "item", "score", "run", "n"])

    return docs.mapInArrow(run, "doc long, item long, score long, run long, n long")


def seeded_pairs(docs: DataFrame, items: DataFrame, every: bool = False) -> DataFrame:
    """``doc, item, score, run, n``: every document and item that share a seed, with the score of their best local
    alignment, the longest unbroken run through a seed and the item's length, all in letters, marks and digits.

    ``docs`` has ``doc long, text string``, ``items`` has ``item long, text string``. Null texts and texts without any
    letter, mark or digit have no pairs. Seeds are those of runs of half an item, or with ``every`` all n-grams of an item.
    Documents are scanned twice for each block of items, with ``every`` once, and never shuffled.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc").cast("long"), canonical(F.col("text")).alias("text")).where("text <> ''")
    items = items.select(F.col("item").cast("long"), canonical(F.col("text")).alias("text")).where("text <> ''")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = math.ceil(total / BLOCK_CHARS)
    out = None
    for block in range(blocks):
        mine = [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item").collect()]
        if every:
            seeds = every_seed(mine)
        else:
            hashes: dict[int, list[np.ndarray]] = defaultdict(list)
            for _, text in mine:
                _, k, h = item_grams(text)
                hashes[k].append(h)
            counts = _count_documents(docs, Grams({k: np.unique(np.concatenate(v)) for k, v in hashes.items()}))
            seeds = choose_seeds(mine, counts)
        found = _scan(docs, mine, seeds)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc long, item long, score long, run long, n long")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), table(spark, sf_dir, "test_items").select(F.col("item_id").alias("item"), "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_id``: the document has at least half of the item in one unbroken run. The alignment score that such
    a run must reach is asked first, then the run itself."""
    pairs = seeded_pairs(*_inputs(spark, sf_dir)).where(F.col("score") >= MATCH * F.ceil(F.col("n") / 2)).where(2 * F.col("run") >= F.col("n"))
    return pairs.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, item_id, score, share``: pairs whose best local alignment has at least half of the score of a whole copy,
    edited copies included; ``share`` is that part. Any n-gram in common is enough for a pair to be aligned."""
    pairs = seeded_pairs(*_inputs(spark, sf_dir), every=True).withColumn("share", F.round(F.col("score") / (MATCH * F.col("n")), 6))
    return pairs.where("share >= 0.5").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "score", "share")


ORACLES = {
    "p7_found": r"""
with d as (select doc_id, lower(upper(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}]', '', 'g'))) t from documents where text is not null),
i as (select item_id, lower(upper(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}]', '', 'g'))) t from test_items where text is not null),
w as (select item_id, h, substring(t, s + 1, h) g from (select item_id, t, (length(t) + 1) // 2 h, unnest(range(length(t) - (length(t) + 1) // 2 + 1)) s from i where t <> ''))
select distinct doc_id, item_id from w join d on contains(d.t, w.g)
""",
}
QUERIES = {"p7_found": p7_found, "p7_alignments": p7_alignments}
