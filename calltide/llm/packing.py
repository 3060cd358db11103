"""Best-fit packing by bin completion.

Only lengths decide how documents pack, and a length is at most the capacity. So the plan is made on the histogram of lengths
(at most ``capacity`` numbers, whatever the number of documents): the whole plan of best fit decreasing is the incumbent, and
branch and bound goes over plans made of undominated fillings around the largest length left, each used as often as the counts
allow, cutting those whose waste can't come out under the incumbent's. The documents then take their places in these patterns by their rank within their length, which
Spark works out in salted groups: no task, and not the driver, sees all documents of a length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calltide.llm import bpe
from calltide.llm.common import Stored

VOCABULARY, CAPACITY, END = "byte_bpe_50k.json", 2048, 0
#: Groups that each length is dealt to for ranking: so many at least, and one more for so many pieces.
SALTS, SALT_ROWS = 64, 200_000
#: Nodes that the search around one largest document may visit before it takes its incumbent, and all searches after the first plan.
NODES, PLAN_NODES = 3000, 500_000
#: Fillings around a largest document that the search over plans tries.
WIDTH = 3
#: Characters (Latin, punctuation) that both tokenizer libraries class alike, and runs of white space that the fast one can't take.
OTHER = re.compile(r"[^\x00-\u024F\u2010-\u2027\u2030-\u205E\u20AC]|\s{4000}")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Texts' ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    Where the file's merges are in the order of their ids, ``tiktoken`` gives the same ids from the same vocabulary five times
    as fast. It gets the texts whose characters it classes alike; others, and those with special strings, go to ``tokenizers``.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.fast = Tokenizer.from_file(path), None
        merges, self.specials = bpe.load(path)
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        made = [vocabulary[a + b] for a, b in merges]
        if made == sorted(made):
            import tiktoken

            byte = {c: b for b, c in enumerate(bpe.byte_symbols())}
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in self.specials}
            self.fast = tiktoken.Encoding("bpe", pat_str=bpe.PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.specials) or OTHER.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encode_text(text: str, path: str) -> bytes:
    """A text's ids as little-endian unsigned 32-bit bytes; a worker loads a vocabulary once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return array("I", _ENCODERS[path].ids(text)).tobytes()


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    last = end.to_bytes(4, "little")
    for batch in batches:
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = encode_text(text, path) + last
            n = len(ids) // 4
            first = n if n <= capacity else n % capacity or capacity
            at, size, k = 0, first, 0
            while at < n:
                row.append(i), piece.append(k), start.append(at), length.append(size)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                at, size, k = at + size, capacity, k + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
            names=["id", "piece", "start", "length", "ids_crc32"],
        )


def best_filling(sizes: list[int], left: dict[int, int], room: int, nodes: int = NODES) -> list[int]:
    """The filling of ``room`` from the multiset ``left`` that wastes least, largest sizes first; ``sizes``: its keys, ascending."""
    return fillings(sizes, left, room, nodes)[0][0]


def fillings(sizes: list[int], left: dict[int, int], room: int, nodes: int | None = NODES, width: int | None = 1) -> tuple[list[list[int]], int]:
    """Up to ``width`` undominated fillings (None: all), those that waste least first, and how many nodes the search visited.

    Depth-first; a node takes one size some number of times, and its branches take smaller ones. The first path takes the
    largest size that fits as often as it fits, as best fit decreasing does. A filling into which one more document fits is
    dominated by the one with it and isn't kept. A branch is cut when even all of its smaller documents wouldn't fill its room
    better than the worst of the ``width`` kept does. With a ``width`` of 1 the search ends at a filling without waste.
    """
    best: list[tuple[int, list[tuple[int, int]]]] = []
    chosen: list[tuple[int, int]] = []
    least, seen, total = room + 1, 0, [0]
    for s in sizes:  # what all documents up to a size could fill
        total.append(min(total[-1] + s * left[s], room + 1))

    def dominated(room: int) -> bool:
        used = dict(chosen)
        return any(left[s] > used.get(s, 0) for s in sizes[: bisect_right(sizes, room)])

    def search(room: int, top: int) -> bool:
        """Whether to stop."""
        nonlocal least, seen
        seen += 1
        if room < least and not dominated(room):
            best.append((room, chosen[:]))
            best.sort(key=itemgetter(0))
            if width is not None:
                del best[width:]
            if len(best) == width:
                least = best[-1][0]
        if not least or nodes is not None and seen > nodes and best:
            return True
        for i in range(min(top, bisect_right(sizes, room) - 1), -1, -1):
            if room - total[i + 1] >= least:
                return False
            s = sizes[i]
            for k in range(min(left[s], room // s), 0, -1):
                chosen.append((s, k))
                stop = search(room - s * k, i - 1)
                chosen.pop()
                if stop:
                    return True
        return False

    search(room, len(sizes) - 1)
    return [[s for s, k in b for _ in range(k)] for _, b in best], seen


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """The whole plan of best fit decreasing: each document, largest first, goes where it leaves least room, else to a new sequence.

    Sequences that hold the same are placed as one. Documents of one size go to the fullest that takes them for as long as
    it does, so each size splits at most one group of equal sequences.
    """
    groups: dict[int, list[tuple[list[int], int]]] = {}  # by room
    for s in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        n = histogram[s]
        for room in [*sorted(r for r in groups if r >= s), capacity]:
            each, old = room // s, groups.pop(room, [])
            if room == capacity:  # new ones, as many as it takes
                old = [([], -(-n // each))]
            for filling, times in old:
                full, rest = (times, 0) if n >= times * each else divmod(n, each)
                n -= full * each + rest
                for k, of in ((each, full), (rest, 1 if rest else 0), (0, times - full - (1 if rest else 0))):
                    if of:
                        groups.setdefault(room - k * s, []).append((filling + [s] * k, of))
            if not n:
                break
    return [g for same in groups.values() for g in same]


def fewest(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound on sequences: the tokens', or that of lengths over half, which lie apart, and what finds no room beside them."""
    sizes, bound = sorted(s for s, n in histogram.items() if n > 0), -(-sum(s * n for s, n in histogram.items()) // capacity)
    over = [(s, histogram[s]) for s in sizes if 2 * s > capacity]
    small = [(s, histogram[s]) for s in sizes if 2 * s <= capacity]
    apart = sum(n for _, n in over)
    filled, room, i = sum(s * n for s, n in small), sum((capacity - s) * n for s, n in over), len(over) - 1
    for low in (0, *(s for s, _ in small)):  # lengths from ``low`` on; those over ``capacity - low`` take none of these beside them
        while i >= 0 and over[i][0] > capacity - low:
            room -= (capacity - over[i][0]) * over[i][1]
            i -= 1
        bound = max(bound, apart + max(0, -(-(filled - room) // capacity)))
        filled -= low * histogram.get(low, 0)
    return bound


def patterns(histogram: dict[int, int], capacity: int, nodes: int | None = NODES, plan_nodes: int | None = PLAN_NODES, width: int | None = WIDTH) -> list[tuple[list[int], int]]:
    """Fillings that use up the histogram, each with how often it is used: never more sequences than best fit decreasing takes.

    Branch and bound over whole plans, with best fit decreasing as incumbent. A node takes the largest length left and one of
    ``width`` undominated fillings around it, as often as counts allow. Nodes are visited in the order of how many times they
    depart from the filling that wastes least (limited discrepancy), and a plan is cut when its sequences and the tokens left
    can't come out under the incumbent. The search ends at a plan that meets the lower bound (:func:`fewest`), which is then the
    best there is, or after ``plan_nodes`` nodes beyond the first plan.

    With None for ``nodes``, ``plan_nodes`` and ``width`` nothing ends early, all fillings are tried and each is taken once at a
    time: the plan is the best there is, after a search that may be exponential in the number of documents.
    """
    exact = nodes is plan_nodes is width is None
    plan_nodes = 1 << 62 if plan_nodes is None else plan_nodes
    best = best_fit_decreasing(histogram, capacity)
    count, bound = sum(n for _, n in best), fewest(histogram, capacity)
    tokens = sum(s * n for s, n in histogram.items())
    seen, order = 0, 0
    queue: list[tuple[int, int, int, int, tuple | None]] = [(0, 0, 0, 0, None)]  # departures, depth, order, which filling, path
    while queue and count > bound:
        away, depth, _, which, path = heappop(queue)
        first = not away
        left, used, rest = {s: n for s, n in histogram.items() if n > 0}, 0, tokens
        steps, at = [], path
        while at:
            at, step = at
            steps.append(step)
        for filling, times in steps:
            used, rest = used + times, rest - sum(filling) * times
            for s in filling:
                left[s] -= times
        sizes = sorted(s for s, n in left.items() if n)
        while sizes and used + (fewest(left, capacity) if exact else -(-rest // capacity)) < count:
            top = sizes[-1]
            left[top] -= 1
            found, visited = fillings([s for s in sizes[: bisect_right(sizes, capacity - top)] if left[s]], left, capacity - top, nodes, None if exact else which + 1)
            left[top] += 1
            seen += 0 if first else visited
            if len(found) <= which:
                break
            order += 1
            if which + 1 < (len(found) if width is None else width) and (first or seen <= plan_nodes):
                heappush(queue, (away + 1, depth, order, which + 1, path))
            filling = [top, *found[which]]
            need = {s: filling.count(s) for s in set(filling)}
            times = 1 if exact else min(left[s] // n for s, n in need.items())
            used, rest, path, depth, which = used + times, rest - sum(filling) * times, (path, (filling, times)), depth + 1, 0
            for s, n in need.items():
                left[s] -= n * times
                if not left[s]:
                    sizes.remove(s)
            if not first and seen > plan_nodes:
                break
        if not sizes and used < count:
            best, count = [], used
            while path:
                path, step = path
                best.append(step)
            best.reverse()
        if seen > plan_nodes:
            break
    return best


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length: ranks from ``first`` (``times`` of them) take place ``place`` in sequences from ``sequence`` on.

    Rows: length, first rank, times, first sequence, place. One row for each place of each pattern.
    """
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for filling, times in plan:
        at = 0
        for s in filling:
            first = taken.get(s, 0)
            out.append((s, first, times, sequence, at))
            taken[s] = first + times
            at += s
        sequence += times
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, nodes: int | None = NODES, plan_nodes: int | None = PLAN_NODES, width: int | None = WIDTH) -> DataFrame:
    """A row for each piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset; for ``nodes``, ``plan_nodes`` and
    ``width`` see :func:`patterns`.

    A document is its ids and then ``end``; one longer than ``capacity`` is cut into pieces of that length, of which the first
    may be shorter. A null or empty text is ``end`` alone. Repeated rows (also of one id) are packed each. An empty table gives
    no rows. Columns other than the two named aren't read. Sequence numbers are dense from 0.
    """
    spark = docs.sparkSession
    kept, path = Stored(spark, "packing"), bpe.vocabulary_path(vocabulary)
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pieces = kept.write(rows.mapInArrow(partial(_pieces, path=path, capacity=capacity, end=end), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"), "pieces")

    salts = max(SALTS, pieces.count() // SALT_ROWS)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))  # a row for each salt
    counts = kept.write(counts.withColumn("before", F.coalesce(before, F.lit(0))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows

    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    # Not broadcast, as there are lengths x salts of them; the pieces lie by these keys already.
    ranked = pieces.withColumn("within", within).join(counts.select("length", "salt", "before").hint("merge"), ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).alias("rank"))
    places = slots(patterns(histogram, capacity, nodes, plan_nodes, width))
    out = ranked.mapInArrow(partial(_place, places=places), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)


def _place(batches: Iterator[pa.RecordBatch], places: list[tuple[int, int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Gives each piece the place that its rank within its length has in the plan; the plan's size depends on the capacity alone."""
    import numpy as np

    length, first, _, sequence, at = (np.asarray(x, np.int64) for x in zip(*places, strict=True))
    order = np.lexsort((first, length))
    length, first, sequence, at = length[order], first[order], sequence[order], at[order]
    begin = {int(s): (int(i), int(j)) for s, i, j in zip(*(lambda v, i: (v, i, [*i[1:], len(length)]))(*np.unique(length, return_index=True)), strict=True)}
    for batch in batches:
        sizes, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        row = np.empty(len(sizes), np.int64)
        for s in np.unique(sizes):
            i, j = begin[int(s)]
            of = sizes == s
            row[of] = i + np.searchsorted(first[i:j], ranks[of], "right") - 1
        columns = [*batch.columns[:-1], pa.array(sequence[row] + ranks - first[row]), pa.array(at[row])]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])
