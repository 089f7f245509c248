"""Ranked lexical search over a tiered index.

index() cuts the documents into blocks; a block holds, for each of its terms, the postings by falling impact (the part of a score
that depends on frequency and length alone) in three tiers: the highest, the next, the rest. With each term it keeps its document
frequency in the block and, per tier, the residual bound: the highest impact in the tiers below. Tiers are columns, so a search
of the first tier reads nothing of the others. No posting is shuffled; a block has a bounded number of documents and terms.

search() takes items in batches. Document frequencies of a batch's terms are added up over the blocks and give the weights. Then
the first tier is searched: what a document has matched bounds its score from below, the residuals of what it has not matched
bound it from above. An item is proven when no document whose score is not yet exact, seen or unseen, can reach its twentieth
best lower bound. Items without that proof fall through to the next tier, where blocks that cannot reach the bound known so far
are passed over; in the last tier all scores are exact. Results are therefore always exact.

Terms are told apart by 64-bit hashes (two of 10^9 terms of which one is asked for collide with a chance below 10^-6).

Defined results: null and empty texts have no terms: such documents are in no result, such items have none; very long texts are
read whole; equal scores are ordered by doc_id, null last; repeated documents are ranked row by row, repeated items answered row by
row; an empty table on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import durable, memo_of, table

TOP = 20
#: Documents and terms (with repeats) of a block; postings of a term in the first and in the first two tiers of a block.
BLOCK_DOCS, BLOCK_TERMS, CUTS = 2048, 600_000, (16, 256)
TIERS = len(CUTS) + 1
#: Items searched at once.
BATCH = 256
#: Bits of an impact (below 1,000,000) and of a document's place in its block.
Q_BITS, O_BITS = 20, 16
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = "docs array<bigint>, terms binary, df binary, " + ", ".join(f"c{k} binary, o{k} binary, q{k} binary, r{k} binary" for k in range(TIERS))


def terms(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_TERMS).split()


@dataclass(frozen=True)
class Index:
    """Blocks of documents that have terms, how many such documents there are, and all their terms with repeats."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def _raw(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))


def _sizes(docs: DataFrame) -> tuple[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [len(terms(x.as_py())) for b in batches for x in b.column(0)]
        yield pa.RecordBatch.from_pydict({"n": [sum(k > 0 for k in n)], "l": [sum(n)]})

    got = docs.select("raw").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return got[0] or 0, got[1] or 0


def _block(ids: list[int | None], found: list[list[bytes]], n_docs: int, n_terms: int, cuts: tuple[int, ...]) -> dict:
    """One block's row: postings ordered by term, falling impact, document."""
    vocabulary: defaultdict = defaultdict(count().__next__)
    n = np.array([len(x) for x in found], np.int64)
    token = np.fromiter(map(vocabulary.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
    size = len(vocabulary)
    pair, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + token, return_counts=True)
    doc, term = np.divmod(pair, size)
    m = np.array([75 + 25 * int(k) * n_docs // n_terms for k in n], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    hashed = np.fromiter(map(xxh3_64_intdigest, vocabulary), np.uint64, size)
    order = np.argsort(hashed)
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    key = rank[term] << (Q_BITS + O_BITS) | ((1 << Q_BITS) - 1 - impact) << O_BITS | doc
    key.sort()
    term, impact, doc = key >> (Q_BITS + O_BITS), (1 << Q_BITS) - 1 - (key >> O_BITS & (1 << Q_BITS) - 1), key & (1 << O_BITS) - 1
    df = np.bincount(term, minlength=size)
    starts = np.cumsum(df) - df
    place = np.arange(len(key)) - starts[term]
    row = {"docs": ids, "terms": hashed[order].tobytes(), "df": df.astype(np.uint32).tobytes()}
    for k, (low, high) in enumerate(zip((0, *cuts), (*cuts, None), strict=True)):
        inside = (place >= low) & (place < high) if high else place >= low
        beyond = np.zeros(size, np.int64)
        if high:
            more = df > high
            beyond[more] = impact[starts[more] + high]
        row |= {
            f"c{k}": np.clip(df - low, 0, high - low if high else None).astype(np.uint32).tobytes(),
            f"o{k}": doc[inside].astype(np.uint16).tobytes(),
            f"q{k}": impact[inside].astype(np.uint32).tobytes(),
            f"r{k}": beyond.astype(np.uint32).tobytes(),
        }
    return row


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, cuts: tuple[int, int] = CUTS) -> Index:
    """The tiered index of all documents, as a table in the shared folder."""
    rows = _raw(docs, doc_id, text)
    n_docs, n_terms = _sizes(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("lexical")
        ids: list = []
        found: list = []
        total = 0

        def out() -> pa.RecordBatch:
            row = _block(ids, found, n_docs, n_terms, cuts)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64()) if k == "docs" else pa.binary()) for k, v in row.items()], list(row))

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (got := terms(x.as_py())):
                    continue
                ids.append(i)
                found.append(got)
                total += len(got)
                if len(ids) == block_docs or total >= BLOCK_TERMS:
                    yield out()
                    ids, found, total = [], [], 0
        if ids:
            yield out()

    return Index(durable(rows.mapInArrow(run, _BLOCK), "tiers"), n_docs, n_terms)


@dataclass
class _Batch:
    """Items searched at once: the hashes of their terms in order, and per term the items that have it and how often."""

    hashed: np.ndarray
    items: list[np.ndarray]
    times: list[np.ndarray]
    n: int

    @classmethod
    def of(cls, texts: list[bytes]) -> _Batch:
        has: defaultdict = defaultdict(list)
        for i, t in enumerate(texts):
            for term, k in Counter(terms(t)).items():
                has[xxh3_64_intdigest(term)].append((i, k))
        keys = sorted(has)
        return cls(np.array(keys, np.uint64), [np.array([i for i, _ in has[h]]) for h in keys], [np.array([k for _, k in has[h]], np.int64) for h in keys], len(texts))

    def places(self, block_terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the batch's terms a block has, and where in the block."""
        at = np.minimum(np.searchsorted(block_terms, self.hashed), len(block_terms) - 1)
        mine = np.flatnonzero(block_terms[at] == self.hashed)
        return mine, at[mine]


def _frequencies(blocks: DataFrame, batch: _Batch) -> np.ndarray:
    """How many documents hold each of the batch's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(batch.hashed), np.int64)
        for b in batches:
            for t, df in zip(b.column(0), b.column(1), strict=True):
                mine, at = batch.places(np.frombuffer(t.as_buffer(), np.uint64))
                total[mine] += np.frombuffer(df.as_buffer(), np.uint32)[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    df = np.zeros(len(batch.hashed), np.int64)
    for r in blocks.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    return df


def _best(ids: np.ndarray, absent: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Places of the best scores, ties by id with null last."""
    if len(scores) > top:
        some = np.flatnonzero(scores >= np.partition(scores, -top)[-top])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], absent[some], -scores[some]))][:top]


def _searched(blocks: DataFrame, batch: _Batch, weights: np.ndarray, known: np.ndarray, tier: int, top: int) -> DataFrame:
    """One search of the tiers up to `tier` for the items whose known bound is not negative: per task and item, the best lower
    bounds (item, doc_id, score), and, as `open`, the highest upper bound of a document whose score is not exact."""

    def score(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items still of interest in a block, their scores and upper bounds by document."""
        mine, at = batch.places(np.frombuffer(row["terms"], np.uint64))
        act = known >= 0
        got = np.zeros((batch.n, len(row["docs"])), np.int64)
        matched: list[list[np.ndarray]] = [[] for _ in mine]
        for k in range(tier + 1):
            counts, docs, impact, beyond = (np.frombuffer(row[f"{x}{k}"], d) for x, d in zip("coqr", (np.uint32, np.uint16, np.uint32, np.uint32), strict=True))
            ends = np.cumsum(counts, dtype=np.int64)
            missing = np.zeros_like(got)  # the residuals of all terms, less those of the terms that a document has matched so far
            for t, a, seen in zip(mine, at, matched, strict=True):
                some = act[batch.items[t]]
                who, weight = batch.items[t][some], weights[t] * batch.times[t][some]
                if counts[a] and len(who):
                    inside = slice(ends[a] - counts[a], ends[a])
                    got[who[:, None], docs[inside]] += weight[:, None] * impact[inside].astype(np.int64)
                    seen.append(docs[inside])
                if beyond[a] and len(who):
                    part = (weight * int(beyond[a]))[:, None]
                    missing[who] += part
                    for x in seen:
                        missing[who[:, None], x] -= part
            upper = got + missing
            act = act & (upper.max(axis=1) >= np.maximum(known, 1))
        return np.flatnonzero(act), got, upper

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        still = np.zeros(batch.n, np.int64)
        for b in batches:
            names = b.schema.names
            for r in range(len(b)):
                row = {c: b.column(j)[r] if c == "docs" else b.column(j)[r].as_py() for j, c in enumerate(names)}
                ids = row["docs"].values
                absent = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                act, got, upper = score(row)
                for i in act:
                    inexact = upper[i] > got[i]
                    if inexact.any():
                        still[i] = max(still[i], upper[i][inexact].max())
                    held = best.get(i)
                    least = max(int(known[i]), 1, int(held[2][-1]) if held and len(held[2]) == top else 1)
                    some = np.flatnonzero(got[i] >= least)
                    if len(some):
                        new = (ids[some], absent[some], got[i][some])
                        new = new if held is None else tuple(map(np.concatenate, zip(held, new, strict=True)))
                        keep = _best(*new, top)
                        best[i] = tuple(x[keep] for x in new)
        open_ = np.flatnonzero(still)
        who = np.array([i for i, x in best.items() for _ in x[0]], np.int64)
        ids, absent, scores = (np.concatenate([x[j] for x in best.values()]) if best else np.zeros(0, d) for j, d in enumerate((np.int64, bool, np.int64)))
        none = pa.nulls(len(open_), pa.int64())
        columns = [(pa.array(who), pa.array(open_)), (pa.array(ids, mask=absent), none), (pa.array(scores), none), (pa.nulls(len(who), pa.int64()), pa.array(still[open_]))]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([a.cast(pa.int64()), z.cast(pa.int64())]) for a, z in columns], ["item", "doc_id", "score", "open"])

    return blocks.select("docs", "terms", *[f"{x}{k}" for k in range(tier + 1) for x in "coqr"]).mapInArrow(run, "item long, doc_id long, score long, open long")


def search(index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP, batch_items: int = BATCH) -> DataFrame:
    """(item_id, rank, doc_id, score, tier): each item's best documents; tier is the one in which its result was proven."""
    spark = items.sparkSession
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id long, score long, tier int"
    out = spark.createDataFrame([], schema)
    rows = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw")).toLocalIterator()
    while some := list(islice(rows, batch_items)):  # a batch bounds what is broadcast and what returns to the driver
        batch = _Batch.of([bytes(r.raw) for r in some])
        if not len(batch.hashed):
            continue
        df = _frequencies(index.blocks, batch)
        weights = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * int(k) + 1))) for k in df], np.int64)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(some)], f"item long, {schema.split(',')[0]}")
        known = np.zeros(batch.n, np.int64)
        for tier in range(TIERS):
            found = durable(_searched(index.blocks, batch, weights, known, tier, top), f"tier{tier}")
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = found.where("open is null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            bound = {r.item: r.bound for r in ranked.where(F.col("rank") == top).select("item", F.col("score").alias("bound")).collect()}
            open_ = {r.item: r.open for r in found.where("open is not null").groupBy("item").agg(F.max("open").alias("open")).collect()}
            proven = [i for i in range(batch.n) if known[i] >= 0 and open_.get(i, -1) < bound.get(i, 0)]
            done = names.where(F.col("item").isin(proven)) if len(proven) < batch.n else names
            out = out.unionByName(ranked.join(F.broadcast(done), "item").select("item_id", "rank", "doc_id", "score", F.lit(tier).alias("tier")))
            known = np.array([-1 if known[i] < 0 or i in set(proven) else max(int(known[i]), bound.get(i, 0)) for i in range(batch.n)], np.int64)
            if (known < 0).all():
                break
    return out


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
size AS (SELECT count(*) AS n, sum(len(ts)) AS l FROM d WHERE len(ts) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, cast(floor(1000 * ln((2 * (SELECT n FROM size) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY t),
a AS (SELECT i, t, count(*) AS k FROM (SELECT i, unnest(ts) AS t FROM i) GROUP BY i, t),
m AS (SELECT r, doc_id, cast(100 - 25 + (25 * len(ts) * (SELECT n FROM size)) // (SELECT l FROM size) AS BIGINT) AS m FROM d WHERE len(ts) > 0),
s AS (SELECT i, r, doc_id, cast(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM a JOIN w USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY i, r, doc_id)
SELECT item_id, cast(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) JOIN i USING (i)
WHERE rank <= 20"""

QUERIES = {"op11_tiered_search": lambda spark, sf_dir: op11_tiered_search(spark, sf_dir).drop("tier")}
SQL = {"op11_tiered_search": SEARCH_SQL}
