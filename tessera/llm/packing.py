"""Best-fit packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

A chromosome is a grouping of items into bins. The first ones are best-fit decreasing and tight fillings (the longest item
with the one or two that fill its bin best). Crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold duplicates, and puts the displaced items back: first in exchange for shorter ones that leave a bin less
full, then by best fit, longest first. Items are dealt into cells by a hash; every cell is evolved on several islands (separate
tasks), whose elites migrate round a ring between epochs. The better island's grouping of each cell stays; its badly filled
bins are dissolved and their items meet those of other cells in the next round, until one cell is left. A cell has a fixed
number of items, so no task grows with the input. Evolution ends when the number of bins meets a lower bound, which proves
it the least, or after GENERATIONS.

Defined results: null and empty texts have the end id only; repeated rows are separate documents; null ids stay null; an
empty table packs into nothing; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, memo_of, table

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
CELL, ISLANDS, EPOCHS, GENERATIONS, POPULATION, WELL_FILLED = 4000, 2, 2, 60, 6, 0.985
MEMO = 500_000
#: The tokenizer's own split of a lower-case word, restricted to ASCII and to bytes of other characters (checked to be letters).
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[!-/:-@\[-`{-~]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Byte-level alphabet: printable bytes stand for themselves, the others, in order, for the characters from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
_loaded: dict = {}


class _Memo(dict):
    """word -> bytes of its ids. Words may be encoded alone, and so may the letter runs, digits and signs of which the
    tokenizer's own split would make one: no merge crosses them. A word with anything else is encoded as it is."""

    def __init__(self, path: str | None) -> None:
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.tok, self.parts = Tokenizer.from_file(path), {}

    def __missing__(self, word: bytes) -> bytes:
        pieces = _PARTS.findall(word)
        got = [self.parts.get(p) or self._part(p) for p in pieces] if len(b"".join(pieces)) == len(word) and b"<|" not in word else [None]
        if None in got:
            got = [array("I", self.tok.encode(word.decode(), add_special_tokens=False).ids).tobytes()]
        self[word] = ids = got[0] if len(got) == 1 else b"".join(got)
        return ids

    def _part(self, part: bytes) -> bytes | None:
        if part.isascii():
            text = part.decode()
        else:
            text = "".join([c.lower() for c in unicodedata.normalize("NFC", part.decode())])
            if not (part.decode().isalpha() and text.isalpha()):
                return None
            text = text.encode().decode("latin-1").translate(_BYTE_CHARS)
        self.parts[part] = ids = array("I", [x.id for x in self.tok.model.tokenize(text)]).tobytes()
        return ids


def token_bytes(texts: list[str | None], path: str | None = None) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, the end id last."""
    if path not in _loaded:
        _loaded[path] = _Memo(path)
    memo = _loaded[path]
    if len(memo) > MEMO:
        memo.clear()
        memo.parts.clear()
    end, look = array("I", [END_ID]).tobytes(), memo.__getitem__
    out = []
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        ws = (raw if b"<|" in raw else raw.translate(_LOWER)).split()  # the vocabulary is lower case; <| may begin a special token
        out.append(b"".join(map(look, ws)) + end)
    return out


def cut(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) per piece of at most capacity tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("packing", _loaded.clear)
        for batch in batches:
            rows = []
            for i in range(0, len(batch), 256):
                for k, b in enumerate(token_bytes(batch.column(1).slice(i, 256).to_pylist(), path), i):
                    for piece, s in enumerate(range(0, len(b), 4 * capacity)):
                        rows.append((k, piece, s // 4, min(len(b) - s, 4 * capacity) // 4, zlib.crc32(b[s : s + 4 * capacity])))
            at, *values = zip(*rows, strict=True) if rows else ((),) * 5
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, t) for v, t in zip(values, types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Bins as lists of items; free space is kept sorted, so best fit is one bisection."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.bins, self.free = capacity, [], []

    def add(self, items: list[int], fill: int) -> None:
        insort(self.free, (self.capacity - fill, len(self.bins)))
        self.bins.append(items)

    def best_fit(self, item: int, length: int) -> None:
        at = bisect_left(self.free, (length, -1))
        if at == len(self.free):
            self.add([item], length)
            return
        free, b = self.free.pop(at)
        self.bins[b].append(item)
        insort(self.free, (free - length, b))


def _fill(bins: list[list[int]], size: list[int]) -> list[int]:
    return [sum(size[i] for i in b) for b in bins]


def _refill(bins: list[list[int]], loose: list[int], size: list[int], capacity: int) -> list[list[int]]:
    packed = _Bins(capacity)
    for b, f in zip(bins, _fill(bins, size), strict=True):
        packed.add(list(b), f)
    for i in sorted(loose, key=lambda i: -size[i]):
        packed.best_fit(i, size[i])
    return packed.bins


def _fitness(bins: list[list[int]], size: list[int], capacity: int) -> float:
    return sum((f / capacity) ** 2 for f in _fill(bins, size)) / max(1, len(bins))


def least_bins(size: list[int], capacity: int) -> int:
    """A lower bound on the number of bins: for each k, items above capacity - k fill a bin alone, those above half a bin need
    one each, and what of the items from k to the half does not fit beside these needs more."""
    x = np.sort(np.array(size, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    half = np.searchsorted(x, capacity // 2, "right")
    k = np.unique(np.concatenate([[0], x[:half]]))
    lone, low = np.searchsorted(x, capacity - k, "right"), np.searchsorted(x, k)
    room = (lone - half) * capacity - (total[lone] - total[half])
    more = -((total[half] - total[low] - room) // -capacity)
    return int((len(x) - half + np.maximum(0, more)).max()) if len(x) else 0


def _tight(size: list[int], capacity: int, rng: random.Random, loosely: float) -> list[list[int]]:
    """Bins of the longest item left and, again and again, the one or two items that fill it best; now and then, with the
    chance loosely, of the next best."""
    order = np.argsort(size, kind="stable")
    value, bins = np.array(size)[order], []
    while len(value):
        taken, gap = [len(value) - 1], capacity - int(value[-1])
        value, items = value[:-1], [int(order[-1])]
        order = order[:-1]
        while len(value) and value[0] <= gap:
            fits = value[: np.searchsorted(value, gap, "right")]
            other = np.searchsorted(fits, gap - fits, "right") - 1
            first = np.flatnonzero(other > np.arange(len(fits)))
            taken = [len(fits) - 1]
            if len(first):
                both = fits[first] + fits[other[first]]
                at = int(both.argmax())
                if rng.random() < loosely:
                    at = int(rng.choice(np.argpartition(-both, min(3, len(both) - 1))[:4].tolist()))
                if both[at] > fits[-1]:
                    taken = [int(first[at]), int(other[first[at]])]
            items += [int(order[i]) for i in taken]
            gap -= int(value[taken].sum())
            value, order = np.delete(value, taken), np.delete(order, taken)
        bins.append(items)
    return bins


def _exchanged(bins: list[list[int]], loose: list[int], size: list[int], capacity: int) -> list[int]:
    """Puts displaced items into bins in exchange for shorter ones where they fit; returns what is displaced then."""
    loose = sorted(loose, key=size.__getitem__)
    lengths = [size[i] for i in loose]
    for b, fill in zip(bins, _fill(bins, size), strict=True):
        free = capacity - fill
        for k, i in enumerate(b):
            if not free:
                break
            at = bisect_right(lengths, size[i] + free) - 1
            if at >= 0 and lengths[at] > size[i]:
                b[k], free = loose.pop(at), free - lengths.pop(at) + size[i]
                back = bisect_left(lengths, size[i])
                lengths.insert(back, size[i])
                loose.insert(back, i)
    return loose


def _cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """b with well-filled bins of a injected; bins of b that share an item go, and so do the emptiest; their items are put back.

    Well filled is a bin that meets WELL_FILLED or, where few do, the fuller half."""
    fills = _fill(a, size)
    enough = min(WELL_FILLED * capacity, sorted(fills)[len(fills) // 2])
    good = [list(x) for x, f in zip(a, fills, strict=True) if f >= enough and rng.random() < 0.5]
    taken = {i for x in good for i in x}
    stay, loose = [], []
    for x in b:
        if taken.isdisjoint(x):
            stay.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    bins = good + stay
    order = sorted(range(len(bins)), key=_fill(bins, size).__getitem__)
    gone = set(order[: max(1, len(bins) // 100)])
    loose += [i for k in sorted(gone) for i in bins[k]]
    bins = [x for k, x in enumerate(bins) if k not in gone]
    return _refill(bins, _exchanged(bins, loose, size, capacity), size, capacity)


def evolve(size: list[int], elites: list[list[list[int]]], capacity: int, seed: int, generations: int = GENERATIONS) -> list[list[int]]:
    """The best grouping found from the elites, best-fit decreasing and tight fillings; the same for the same arguments."""
    rng = random.Random(seed)
    least = least_bins(size, capacity)
    people = list(elites) or [_refill([], list(range(len(size))), size, capacity)]
    key = lambda bins: (len(bins), -_fitness(bins, size, capacity))
    while len(people) < POPULATION and min(map(len, people)) > least:
        people.append(_tight(size, capacity, rng, 0.3 if len(people) > 1 or elites else 0.0))
    people.sort(key=key)
    for _ in range(generations):
        if len(people[0]) <= least:
            break
        a, b = rng.sample(people, 2)
        people = sorted([*people, _cross(a, b, size, capacity, rng)], key=key)[:POPULATION]
    return people[0]


_OWN = ["item", "doc_id", "no_id", "piece", "start", "length", "ids_crc32"]
_STATE = "item long, doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long, cell long, island int, bin int, off long, fill long, bins int"


def _epoch(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """One epoch on every (cell, island); rows with origin >= 0 carry an elite's bins in their column bin."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        cell, island = int(key[0]), int(key[1])
        own = x[x["origin"] == x["origin"].min()].sort_values("item").reset_index(drop=True)
        place = {v: k for k, v in enumerate(own["item"].tolist())}
        elites = []
        for _, e in x[x["origin"] >= 0].groupby("origin"):
            bins: dict[int, list[int]] = {}
            for i, b in zip(e["item"].tolist(), e["bin"].tolist(), strict=True):
                bins.setdefault(int(b), []).append(place[i])
            elites.append(list(bins.values()))
        size = own["length"].tolist()
        best = evolve(size, elites, capacity, zlib.crc32(f"{seed}:{cell}:{island}".encode()))
        bin_of, off, fill = np.zeros(len(size), int), np.zeros(len(size), int), np.zeros(len(size), int)
        for b, members in enumerate(best):
            at = 0
            for i in members:
                bin_of[i], off[i] = b, at
                at += size[i]
            fill[members] = at
        return own[[*_OWN, "cell"]].assign(island=island, bin=bin_of, off=off, fill=fill, bins=len(best))

    return items.groupBy("cell", "island").applyInPandas(run, _STATE)


def pack(pieces: DataFrame, capacity: int = CAPACITY, cell_items: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    numbered = pieces.withColumn("item", F.monotonically_increasing_id())
    items = durable(numbered.withColumns({"no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0)).cast("long")}), "pack-items")  # no nulls: pandas would make them floats
    named = [F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), *out[1:]]
    full = items.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("item") * 2 + 1).withColumn("offset", F.lit(0).cast("long")).select(*named)
    rest, done, step, was = items.where(F.col("length") < capacity), [full], 0, None
    while True:
        n = rest.count()
        cells = max(1, -(-n // cell_items))
        if n == 0:
            break
        dealt = rest.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(step)), F.lit(cells)).cast("long"))
        island = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
        state = dealt.withColumn("island", island).withColumn("origin", F.lit(-1)).withColumn("bin", F.lit(-1))
        for e in range(epochs):
            if e:  # each island keeps its elite and gets its neighbour's
                moved = state.withColumn("origin", F.col("island")).withColumn("island", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))))
                state = moved.distinct() if islands == 1 else moved
            state = durable(_epoch(state, capacity, 1000 * step + e), "pack-epoch")
        won = state.groupBy("cell", "island").agg(F.max("bins").alias("bins"), F.sum(F.col("fill") * F.col("length")).alias("good")).groupBy("cell").agg(F.min_by("island", F.struct("bins", -F.col("good"), "island")).alias("island"))
        best = state.join(won, ["cell", "island"])
        last = cells == 1 or (was is not None and n > 0.8 * was)  # items of which no two fit together gain nothing from other cells
        kept = best if last else best.where(F.col("fill") >= WELL_FILLED * capacity)
        number = (F.lit(step).cast("long") * (1 << 57)) + F.col("cell") * (1 << 23) + F.col("bin") * 2
        done.append(kept.withColumn("sequence_id", number).withColumn("offset", F.col("off")).select(*named))
        if last:
            break
        rest = durable(best.where(F.col("fill") < WELL_FILLED * capacity).select(*_OWN), "pack-rest")
        step, was = step + 1, n
        cell_items = cell_items if n > 2 * cell_items else n
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(table(spark, sf_dir, "documents")))


SQL: dict[str, str] = {}
QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
