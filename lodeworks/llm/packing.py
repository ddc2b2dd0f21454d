"""Order-preserving packing of documents into windows of at most ``window`` tokens.

Each partition's documents, in their order, make one token stream. Where the stream is
cut is found by dynamic programming over candidate places: document ends, sentence
ends and, at a grid of ``grid`` tokens, places within a sentence. With p(j) the place
of candidate j,

    f(j) = penalty(j) + window - p(j) + min over i, p(j) - p(i) <= window, of f(i) + p(i),

so the minimum runs over a sliding window and a monotone queue gives each transition in
amortised constant time. The last windows of a partition are as long as powers of two,
which need no padding.

The stream is worked off in blocks: the last cut of a block is settled within its last
window and the tokens behind it carry over, so memory doesn't grow with a partition.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.tokens import BpeEncoder, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def best_cuts(place, penalty, window: int, final: bool) -> list[int]:
    """Indexes of the chosen cuts of a block, the first (at 0) left out.

    ``place``: ascending candidate places from 0, at most ``window`` apart; ``penalty``:
    what a cut there costs, in padded tokens. Unless ``final``, the block's end is no cut: the last chosen
    place lies within ``window`` of it. If ``final``, the end is the last and costs nothing.
    """
    m, end = len(place), place[-1]
    back, cost = [0] * m, [0] * m
    queue = deque([(place[0], 0, 0)])  # (f + p, place, index), values ascending
    queue[0] = (cost[0] + place[0], place[0], 0)
    push, pop, left = queue.append, queue.pop, queue.popleft
    for j in range(1, m):
        p = place[j]
        low = p - window
        while queue[0][1] < low:
            left()
        g, _, i = queue[0]
        back[j] = i
        g = cost_j = g + penalty[j] + window - p
        cost[j] = cost_j
        g += p
        while queue and queue[-1][0] >= g:
            pop()
        push((g, p, j))
    last = m - 1
    while last > 0 and end - place[last - 1] <= window:
        last -= 1
    open_ends = range(last, m if not final else m - 1) if m > 1 else range(1)
    j = min(open_ends, key=cost.__getitem__, default=0)
    cuts = [m - 1] if final and m > 1 else []
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Stream:
    """Cuts one partition's token stream, block by block."""

    def __init__(self, encoder, window, sentence_penalty, hard_penalty, grid, first_id):
        self.encoder, self.window, self.grid = encoder, window, grid
        self.sentence_penalty, self.hard_penalty = sentence_penalty, hard_penalty
        self.next_id = first_id
        self.tokens = np.zeros(0, "<u4")
        self.docs = []  # (doc_id, its place in self.tokens, its tokens), in order

    def add(self, doc_ids, ids, counts) -> None:
        """Append documents; ``ids`` already hold each one's closing 0."""
        at = len(self.tokens) + np.cumsum(counts) - counts
        self.docs += zip(doc_ids, at.tolist(), counts.tolist())
        self.tokens = np.concatenate((self.tokens, ids))

    def _candidates(self, final: bool):
        t, n = self.tokens, len(self.tokens)
        cost = np.full(n + 1, -1.0)
        cost[:: self.grid] = self.hard_penalty
        stop = self.encoder.ends_sentence[t[:-1]] & self.encoder.opens_piece[t[1:]]
        cost[np.flatnonzero(stop) + 1] = self.sentence_penalty
        ends = np.array([at + size for _, at, size in self.docs])
        cost[ends] = 0
        cost[0] = 0
        if final:
            cost[n] = 0
        place = np.flatnonzero(cost >= 0)
        return place.tolist(), cost[place].tolist()

    def cut(self, final: bool) -> pa.RecordBatch | None:
        """Pieces of all windows that are settled; the rest stays for the next block."""
        if not len(self.tokens):
            return None
        place, cost = self._candidates(final)
        cuts = [place[j] for j in best_cuts(place, cost, self.window, final)]
        if final:
            a = cuts[-2] if len(cuts) > 1 else 0
            rest = cuts.pop() - a
            for bit in range(self.window.bit_length(), -1, -1):  # a power of two needs no padding
                if rest >> bit & 1:
                    a += 1 << bit
                    cuts.append(a)
        if not cuts:
            return None
        return self._pieces(np.array(cuts))

    def _pieces(self, cuts: np.ndarray) -> pa.RecordBatch:
        done = int(cuts[-1])
        at = np.array([d[1] for d in self.docs])
        size = np.array([d[2] for d in self.docs])
        ends = np.unique(np.concatenate((cuts, (at + size)[at + size <= done])))
        starts = np.concatenate(([0], ends[:-1]))
        doc = np.searchsorted(at, starts, "right") - 1
        window = np.searchsorted(cuts, starts, "right")
        opened = np.concatenate(([0], cuts[:-1]))
        ids = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer((np.concatenate((starts, ends[-1:])) * 4).astype("<i8")), pa.py_buffer(self.tokens[:done].tobytes())]
        )
        doc_ids = pa.array([d[0] for d in self.docs], pa.int64())
        out = pa.RecordBatch.from_arrays(
            [
                doc_ids.take(pa.array(doc)),
                pa.array(starts - at[doc], pa.int64()),
                pa.array(ends - starts, pa.int64()),
                ids.cast(pa.binary()),
                pa.array(size[doc], pa.int64()),
                pa.array(self.next_id + window, pa.int64()),
                pa.array(starts - opened[window], pa.int64()),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.next_id += len(cuts)
        self.tokens = self.tokens[done:]
        self.docs = [(d, a - done, n) for d, a, n in self.docs if a + n > done]
        return out


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    window: int = 1024,
    sentence_penalty: float = 8,
    hard_penalty: float = 32,
    grid: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document in a packed sequence.

    A document is its text's ids and one closing id 0. ``start``: its ids before the
    piece; ``ids``: the piece's ids as little-endian unsigned 32-bit integers;
    ``offset``: where the piece begins in sequence ``sequence_id``. Every id lies in exactly one
    piece, and the documents of a partition follow each other in their order.

    A null text packs as an empty one (its closing id alone), a null id stays null, and
    repeated rows are packed one by one. An empty table gives no rows. Further
    columns aren't read. Nothing is shuffled; sequence ids follow from the partition's
    number and so are the same when a task is repeated.
    """
    if grid > window or window & (window - 1):
        raise ValueError("window has to be a power of two and no smaller than grid")

    def packed(batches):
        encoder = BpeEncoder.load(tokenizer_json)
        stream = Stream(encoder, window, sentence_penalty, hard_penalty, grid, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encoder.encode(part.column("text"))
                ends = np.cumsum(counts)
                stream.add(part.column("doc_id").to_pylist(), np.insert(ids, ends, 0), counts + 1)
                if (out := stream.cut(final=False)) is not None:
                    yield out
        if (out := stream.cut(final=True)) is not None:
            yield out

    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(packed, SCHEMA)
