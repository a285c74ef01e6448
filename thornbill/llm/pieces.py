"""Cutting oversized texts at natural boundaries, with a fixed overlap."""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thornbill.tables import WS, table

LIMIT, OVERLAP = 1200, 120
#: The characters that may end a sentence in any script.
TERMINATORS = ".!?。！？।॥۔؟|…"
#: Cost of a cut at a sentence end, at white space, at a terminator with no space behind it, inside a stretch without any of
#: these that the overlap leaves no other way over, and inside one longer than the limit.
PENALTY = {"sentence": 0.0, "space": 1.0, "stop": 20.0, "squeezed": 100.0, "forced": 100.001}
IMBALANCE = 2.0

_SPACE = regex.compile(rf"[{regex.sub(r'\\x\{(\w+)\}', lambda m: f'\\u{int(m[1], 16):04x}', WS)}]+")
_SENTENCE = regex.compile(rf"[{regex.escape(TERMINATORS)}]+[\"'”’»」』）)\]]*(?=\s|$)|[。！？]+[\"'”’」』）)]*")
_STOP = regex.compile(f"[{regex.escape(TERMINATORS)}]")
_BREAK = regex.compile(rf"[{regex.escape(TERMINATORS)}]|{_SPACE.pattern}")


def stretches(text: str, longer: int) -> list[tuple[int, int]]:
    """``start, end`` of the stretches of more than ``longer`` characters without white space and without any terminator."""
    ends = [(m.start(), m.end()) for m in _BREAK.finditer(text)]
    return [(a, b) for (_, a), (b, _) in zip([(0, 0), *ends], [*ends, (len(text), len(text))]) if b - a > longer]


def _candidates(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may end, and the cost of each; inside gaps too long to be bridged, places are added by force."""
    cost: dict[int, float] = {m.end(): PENALTY["stop"] for m in _STOP.finditer(text)}
    for m in _SPACE.finditer(text):
        cost.update(dict.fromkeys(range(m.start(), m.end()), PENALTY["space"]))
    cost |= {m.end(): PENALTY["sentence"] for m in _SENTENCE.finditer(text)}
    cost = {e: c for e, c in cost.items() if overlap < e < len(text)}
    cost[len(text)] = 0.0
    long = stretches(text, limit)
    begins = [a for a, _ in long]
    reach, last = limit - overlap, 0
    for e in sorted(cost):
        if e - last > reach:
            for p in range(last + max(1, min(100, reach)), e, max(1, min(100, reach))):
                q = p
                while q > p - 20 and q > last + 1 and (unicodedata.category(text[q])[0] == "M" or text[q] == "‍"):
                    q -= 1
                if q > overlap:
                    k = bisect.bisect_left(begins, q) - 1
                    cost.setdefault(q, PENALTY["forced" if k >= 0 and q < long[k][1] else "squeezed"])
        last = e
    places = np.array(sorted(cost))
    return places, np.array([cost[e] for e in places])


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the pieces of a text, kind being how the piece ends: sentence, space, stop, squeezed,
    forced (see PENALTY) or end. As the ends of pieces are at most ``limit - overlap`` apart, a text has a forced one just if
    some stretch without white space and terminators is longer than ``limit``.

    Dynamic programming over the places where a piece may end: the sum of the cut's cost and the squared deviation from
    an even size is least, ties to the earlier cut. Every piece has at most ``limit`` characters and starts ``overlap``
    characters before the end of the piece before it. A text within the limit is one piece; an empty text has none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, "end")] if n else []
    places, costs = _candidates(text, limit, overlap)
    pieces = -(-(n - overlap) // (limit - overlap))
    even = (n + (pieces - 1) * overlap) / pieces
    uneven = IMBALANCE * ((np.arange(limit + 1) - even) / even) ** 2  # by the length of a piece
    lows = np.searchsorted(places, places - limit + overlap)
    total = np.full(len(places), np.inf)
    before = np.full(len(places), -1)
    for j, (e, low) in enumerate(zip(places.tolist(), lows.tolist())):
        best = uneven[e] if e <= limit else np.inf
        if low < j:
            through = total[low:j] + uneven[e + overlap - places[low:j]]
            k = int(through.argmin())
            if through[k] < best:
                best, before[j] = through[k], low + k
        total[j] = best + costs[j]
    names = {v: k for k, v in PENALTY.items()}
    out, j = [], len(places) - 1
    while j >= 0:
        i = before[j]
        out.append((int(places[i]) - overlap if i >= 0 else 0, int(places[j]), "end" if places[j] == n else names[costs[j]]))
        j = i
    return out[::-1]


def oversized_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every distinct chunk longer than ``limit``.

    ``chunk_id, position, piece_start, piece_end, char_span, text, ends``: offsets are in the chunk's text; ``char_span`` is
    in the passage's text, null where the chunk's own span is null or not as long as its text; ``ends`` is how the piece
    ends. A chunk delivered several times counts once (if its texts should differ, the least of them); null ids and texts
    have no pieces. Only oversized rows are shuffled.
    """
    long = chunks.where(F.length("text") > limit).where("chunk_id is not null")
    known = (F.col("char_span.end") - F.col("char_span.start")) == F.length("text")
    row = F.struct("text", F.when(known, F.col("char_span.start")).alias("base"))
    once = long.groupBy("chunk_id").agg(F.min(row).alias("row")).select("chunk_id", "row.text", "row.base")
    kind = "chunk_id string, position int, piece_start int, piece_end int, char_span struct<start:int,end:int>, text string, ends string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for i, (a, b, ends) in enumerate(cut(r["text"], limit, overlap)):
                    span = None if r["base"] is None else {"start": r["base"] + a, "end": r["base"] + b}
                    rows.append((r["chunk_id"], i, a, b, span, r["text"][a:b], ends))
            names = ["chunk_id", "position", "piece_start", "piece_end", "char_span", "text", "ends"]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.struct([("start", pa.int32()), ("end", pa.int32())]), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return once.mapInArrow(run, kind)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, cut``: every distinct oversized chunk, ``forced`` if one of its pieces ends by force."""
    pieces = oversized_pieces(table(spark, sf_dir, "chunks"))
    return pieces.groupBy("chunk_id").agg(F.when(F.bool_or(F.col("ends") == "forced"), "forced").otherwise("natural").alias("cut"))


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, first, left_over, gaps, within, least_shared, most_shared, verbatim``: what holds for the pieces of each
    oversized chunk: they begin at 0, leave no character over, are numbered without gaps, keep the limit, share just the
    overlap, and have the chunk's characters between their offsets."""
    chunks = table(spark, sf_dir, "chunks")
    pieces = oversized_pieces(chunks)
    order = W.partitionBy("chunk_id").orderBy("position")
    shared = F.lag("piece_end").over(order) - F.col("piece_start")
    texts = chunks.where(F.length("text") > LIMIT).groupBy("chunk_id").agg(F.min("text").alias("whole"))
    p = pieces.withColumn("shared", shared).join(texts, "chunk_id")
    same = F.substr("whole", F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start")) == F.col("text")
    out = p.groupBy("chunk_id").agg(
        F.min("piece_start").alias("first"), (F.max("piece_end") - F.max(F.length("whole"))).alias("left_over"), (F.max("position") + 1 - F.count(F.lit(1))).alias("gaps"),
        (F.max(F.length("text")) <= LIMIT).alias("within"), F.coalesce(F.min("shared"), F.lit(OVERLAP)).alias("least_shared"), F.coalesce(F.max("shared"), F.lit(OVERLAP)).alias("most_shared"), F.every(same).alias("verbatim"),
    )
    return out


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every distinct chunk of more than 1,200 characters."""
    return oversized_pieces(table(spark, sf_dir, "chunks"))


ORACLES = {
    "p2_invariants": 'select chunk_id, 0 as first, 0 as left_over, 0::bigint as gaps, true as "within", 120 as least_shared, 120 as most_shared, true as verbatim from chunks where length(text) > 1200 group by chunk_id',
    "p2_found": rf"""
select chunk_id, case when max(stretch) > {LIMIT} then 'forced' else 'natural' end as cut
from (select chunk_id, list_max(list_transform(regexp_split_to_array(text, '[{WS}.!?。！？।॥۔؟|…]'), lambda x: length(x))) stretch from chunks where length(text) > {LIMIT})
group by chunk_id
""",
}
QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_invariants": p2_invariants}
