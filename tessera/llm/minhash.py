"""MinHash near-duplicates of whole texts on word shingles.

Each document's set of shingles (64-bit hashes) gives many universal-hash minima. Bands of minima propose documents,
a comparison of the signatures drops hopeless proposals, and the exact Jaccard similarity of the full sets confirms a link.
Components are found by alternating large-star and small-star.

Documents with equal sets form a class and stand as one (its smallest id). Within a bucket, members are first compared with
a hub (each document with the hub it meets most often); a bucket whose members are then in one component needs no more.
The members in different components of the buckets left over are compared pair by pair in small buckets and block by block
in large ones, so no proposed link is lost and no group is emitted as pairs.
With 40 bands of 5 minima a link of similarity 0.8 is not proposed with a chance of 1.3e-7.

Defined results: null or empty texts have no shingles and link with nothing; texts with fewer words than a shingle are one
shingle; rows that repeat a doc_id count as one document with several texts; a null id links with nothing; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, memo_of, table
from .graph import components

BANDS, ROWS, MEMO = 40, 5, 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20240601)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_C = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_K = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """word -> hash, emptied when full: a bound on memory, not on vocabulary."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_memo = _Words()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    ws = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    h = np.array([_memo[w] for w in ws], np.uint64)
    n = max(1, len(h) - width + 1)
    mixed = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        mixed = _mix(mixed + h[k : k + n]) * _C[k]
    return np.unique(_mix(mixed))


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def sign(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, k1, k2: hash of the set, bands, sig: low byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo_of("minhash", _memo.clear)
        step = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                m = minima(s)
                keys = _mix((m.reshape(BANDS, ROWS).astype(np.uint64) * _K).sum(axis=1) + step)
                one, two = int(_mix(s).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(_mix(s * _C[1])).view(np.int64))
                rows.append((len(s), one, two, keys.view(np.int64), (m & np.uint32(255)).astype(np.uint8).tobytes()))
            n, k1, k2, bands, sig = zip(*rows, strict=True) if rows else ((),) * 5
            whole = [pa.array(x, pa.int64()) for x in (n, k1, k2)]
            columns = [batch.column(0), *whole, pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig binary")


def _likely(pairs: DataFrame, sigs: DataFrame, at_least: float) -> DataFrame:
    """Pairs whose signatures agree as often as 6.5 standard deviations below the threshold allow."""
    n = BANDS * ROWS
    least = int(n * at_least - 6.5 * (n * at_least * (1 - at_least)) ** 0.5)
    a, b = sigs.select(F.col("rep").alias("doc"), F.col("sig").alias("sa")), sigs.select(F.col("rep").alias("hub"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                same = np.frombuffer(b"".join(x["sa"]), np.uint8).reshape(-1, n) == np.frombuffer(b"".join(x["sb"]), np.uint8).reshape(-1, n)
                yield x.loc[same.sum(axis=1) >= least, ["hub", "doc"]]

    return pairs.join(a, "doc").join(b, "hub").mapInPandas(run, "hub long, doc long").distinct()


def _alike(s: np.ndarray, h: np.ndarray, percent: int) -> bool:
    if not len(s) or 100 * min(len(s), len(h)) < percent * max(len(s), len(h)):
        return False
    both = np.concatenate([s, h])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(s) + len(h) - common)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int, per_task: int = 2000) -> DataFrame:
    """(hub, doc) of pairs whose full sets have 100 * intersection >= percent * union. texts: (doc, text).

    Texts are sent to their hub's group; large groups are dealt over salts, to each of which the hub's text goes. A task
    streams over its groups, hub first, and holds one hub's set."""
    many = pairs.groupBy("hub").agg(F.count("*").alias("_n"))
    salts = many.select("hub", F.ceil(F.col("_n") / per_task).cast("int").alias("_s"))
    sent = pairs.join(salts, "hub").select("hub", "doc", F.pmod(F.xxhash64("doc"), F.col("_s")).cast("int").alias("salt"), F.lit(1).alias("kind"))
    hubs = salts.select("hub", F.col("hub").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("salt"), F.lit(0).alias("kind"))
    grouped = texts.hint("merge").join(sent.unionByName(hubs), "doc").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sets = None, []
        for x in batches:
            out = []
            for hub, doc, salt, kind, t in zip(x["hub"], x["doc"], x["salt"], x["kind"], x["text"], strict=True):
                s = shingle_set(t, width)
                if at != (hub, salt):
                    at, sets = (hub, salt), []
                if kind == 0:
                    sets.append(s)
                elif any(_alike(s, h, percent) for h in sets):
                    out.append((hub, doc))
            yield pd.DataFrame(out, columns=["hub", "doc"], dtype="int64")

    return grouped.mapInPandas(run, "hub long, doc long").distinct()


def _joined_in_block(ids: list[int], comps: list[int], side: list[int], sets: list[np.ndarray], percent: int, columns: int = 8192) -> list[tuple[int, int]]:
    """Links between different components of a pair of blocks, no more than connect them. Intersections by matrix products
    over the shingles that more than one of the texts has, some columns at a time."""
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[where]
    rows, cols = rows[keep], number[where[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for c in range(0, int(shared.sum()), columns):
        lo, hi = np.searchsorted(cols, [c, c + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[rows[lo:hi], cols[lo:hi] - c] = 1
        common += m @ m.T
    inter = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    side_, comp_ = np.array(side), np.array(comps)
    across = (side_[:, None] < side_[None, :]) if side_.min() < side_.max() else np.triu(np.ones_like(inter, bool), 1)
    a, b = np.nonzero(across & (100 * inter >= percent * union) & (union > 0) & (comp_[:, None] != comp_[None, :]))
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(comps[i]), find(comps[j])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ids[i], ids[j]))
    return out


def compare_blocks(members: DataFrame, buckets: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 256) -> DataFrame:
    """(hub, doc) links that join different components inside each cluster. members: (cluster, doc, comp), buckets: (key,
    doc), texts: (doc, text).

    A component of some size is cut into blocks by a hash of its documents, small ones are put together by a hash of the
    component. Two blocks that share a bucket and do not lie in one component are compared in a task of its own, which holds
    them whatever the cluster's size and gives out spanning links only."""
    sizes = members.groupBy("cluster", "comp").agg(F.count("*").alias("n")).withColumn("own", F.col("n") > block // 4)
    few = sizes.where("not own").groupBy("cluster").agg(F.sum("n").alias("small"))
    parts = F.ceil(F.when(F.col("own"), F.col("n")).otherwise(F.col("small")) / block)
    sizes = durable(sizes.join(few, "cluster", "left").select("cluster", "comp", "own", parts.alias("parts")), "mh-sizes")
    home = F.when(F.col("own"), F.col("comp"))
    at = F.pmod(F.when(F.col("own"), F.xxhash64("doc")).otherwise(F.xxhash64("comp")), F.col("parts"))
    named = F.struct(F.col("own"), F.coalesce(home, F.lit(0)).alias("home"), at.alias("at"))
    placed = durable(members.join(sizes, ["cluster", "comp"]).select("cluster", "doc", "comp", named.alias("block")), "mh-blocks")
    met = durable(buckets.join(placed, "doc").select("key", "cluster", "block").distinct(), "mh-met")
    left, right = met.select("key", "cluster", F.col("block").alias("i")), met.select("key", F.col("block").alias("j"))
    two = left.join(right, "key").where("i <= j and not (i.own and j.own and i.home = j.home)").select("cluster", "i", "j").distinct()
    sides = two.select("cluster", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side"))
    sides = sides.unionByName(two.where("i < j").select("cluster", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    rows = texts.hint("merge").join(placed.join(sides, ["cluster", "block"]), "doc")
    rows = rows.select("cluster", F.to_json("i").alias("i"), F.to_json("j").alias("j"), "side", "doc", "comp", "text")
    rows = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def done() -> pd.DataFrame:
            docs, comps, side, sets = (list(v) for v in zip(*held, strict=True))
            return pd.DataFrame(_joined_in_block(docs, comps, side, sets, percent), columns=["hub", "doc"], dtype="int64")

        for x in batches:
            for cluster, i, j, side, doc, comp, t in x.itertuples(index=False, name=None):
                if at != (cluster, i, j):
                    if held:
                        yield done()
                    at, held = (cluster, i, j), []
                held.append((doc, comp, side, shingle_set(t, width)))
        if held:
            yield done()

    return rows.mapInPandas(run, "hub long, doc long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", star_rounds: int = 2, small: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs."""
    signed = durable(sign(docs, width, doc_id, text), "mh-signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = durable(classes, "mh-classes")
    sigs = classes.select("rep", "sig")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = durable(keys.join(shared, "key").select("key", F.col("rep").alias("doc")).distinct(), "mh-members")
    involved = members.select("doc").distinct()
    texts = durable(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).hint("merge").join(involved, "doc"), "mh-texts")
    links, tested, comp = None, None, None

    def labelled() -> DataFrame:
        if comp is None:
            return members.select("key", "doc", F.col("doc").alias("comp"))
        return members.join(comp, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))

    def add(found: DataFrame) -> None:
        nonlocal links, comp
        found = durable(found, "mh-links")
        links = found if links is None else links.unionByName(found)
        comp = components(links, "hub", "doc")

    def check(pairs: DataFrame) -> DataFrame:
        nonlocal tested
        pairs = durable(pairs, "mh-pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        return confirm(durable(_likely(pairs, sigs, percent / 100), "mh-likely"), texts, width, percent)

    for k in range(star_rounds):  # every member against one hub of its buckets
        lab = labelled()
        hub = F.min_by("doc", F.struct(F.xxhash64("doc", F.lit(k)), "doc"))
        mixed = lab.groupBy("key").agg(hub.alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        met = lab.join(mixed.select("key", "hub"), "key")
        if comp is None:
            met = met.withColumn("hub_comp", F.col("hub"))
        else:
            met = met.join(comp.select(F.col("node").alias("hub"), F.col("component").alias("_hc")), "hub", "left").withColumn("hub_comp", F.coalesce("_hc", "hub"))
        pairs = met.where("comp <> hub_comp").groupBy("doc", "hub").agg(F.count("*").alias("n"))
        pairs = pairs if tested is None else pairs.join(tested, ["hub", "doc"], "left_anti")
        add(check(pairs.groupBy("doc").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")).select("hub", "doc")))
    lab = durable(labelled(), "mh-labelled")
    mixed = durable(lab.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi"), "mh-mixed")
    left = lab.join(mixed.where(F.col("n") <= small).select("key"), "key", "left_semi")  # few members: pair by pair
    pairs = left.select("key", F.col("doc").alias("hub"), F.col("comp").alias("hub_comp")).join(left, "key").where("hub_comp < comp").select("hub", "doc").distinct()
    pairs = pairs.join(tested, ["hub", "doc"], "left_anti").join(tested.select(F.col("hub").alias("doc"), F.col("doc").alias("hub")), ["hub", "doc"], "left_anti")
    add(check(pairs))
    star = durable(members.join(mixed.where(F.col("n") > small).select("key", "hub"), "key").select("hub", "doc").distinct(), "mh-large")  # many: block by block
    if not star.isEmpty():
        cluster = components(star, "hub", "doc")
        inside = cluster.select(F.col("node").alias("doc"), F.col("component").alias("cluster")).unionByName(cluster.select(F.col("component").alias("doc"), F.col("component").alias("cluster")).distinct())
        inside = inside.join(comp, F.col("doc") == F.col("node"), "left").select("cluster", "doc", F.coalesce("component", "doc").alias("comp"))
        large = members.join(mixed.where(F.col("n") > small).select("key"), "key", "left_semi")
        add(compare_blocks(inside, large, texts, width, percent))
    own = classes.select("k1", "k2", "n_shingles", "rep")
    asked = signed.select("doc_id", "n_shingles", "k1", "k2")
    out = asked.where("n_shingles > 0").join(own, ["k1", "k2", "n_shingles"], "left").join(comp, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", "component", "rep")
    none = F.lit(None).cast("long")
    out = out.unionByName(asked.where("n_shingles = 0").select("doc_id", "n_shingles", none.alias("component"), none.alias("rep")))  # not one key of all
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs per component, columns unchanged. Of rows that repeat the kept id, the one with the least hash of its
    columns (of those that can be hashed) stays. Rows without an id all stay."""
    judged = durable(near_duplicates(docs, width, percent, doc_id, text), "mh-judged")
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    # a document's columns travel as one struct: no name of theirs meets one of these
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_d"), F.xxhash64(*plain).alias("_h"))
    out = rows.join(judged.where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), F.col("_d") == F.col("_gone"), "left_anti")
    repeated = durable(judged.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_many")), "mh-repeated")
    if repeated.isEmpty():
        return out.select("_row.*")
    one = out.join(repeated, F.col("_d") == F.col("_many"), "left_anti")
    many = out.join(repeated, F.col("_d") == F.col("_many"), "left_semi").groupBy("_d").agg(F.min_by("_row", "_h").alias("_row"))
    return one.select("_row.*").unionByName(many.select("_row.*"))


def op6_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


SQL = {
    "op6_minhash_components": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then ws else list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) end) g from w)),
n as (select doc_id, count(*) n from s group by doc_id),
i as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id c from documents union select e.b, r.c from r join e on e.a = r.doc_id)
select d.doc_id, coalesce(n, 0)::bigint n_shingles, m component_id, d.doc_id = m kept from documents d left join n using (doc_id) join (select doc_id, min(c) m from r group by doc_id) using (doc_id)
"""
}
QUERIES = {"op6_minhash_components": op6_minhash_components}
