"""Mixing sources to target weights by systematic sampling.

Within a source, every document expects target / source_size copies (at most 2). The expected copies are prefix-summed
over the source's documents, one random offset is added, and a document is emitted once per integer boundary that its
part of the sum crosses. Documents stand in order of their size class, then of a hash: neighbours have like
sizes, so the words taken come near the target. The hash is that of id, size and text: reruns agree however the table is cut
into partitions (rows equal in these are alike to the mix), and rows of one id do not stand together.

The prefix sum is distributed: documents are ranked inside (source, size class, hash digits) and the ranks are shifted by
the counts of the groups before. Groups are counted first, so a source with a third of all rows is dealt over many tasks.

Defined results: null texts have size 0; a source of size 0 has target 0 and takes nothing; null is a source of its own,
last in order; rows that repeat an id are separate documents; an empty table gives an empty mix. Extra columns are kept;
those that clash with an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table, words

WEIGHTS, SHARE, MAX_REPEAT, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Words of a document take 7 leading binary digits as its size class.
_CLASS = "greatest(length(bin({s})) - 7, 0) * 128 + shiftright({s}, greatest(length(bin({s})) - 7, 0))"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, offset) per source. A target stops at max_repeat times the source's size; the excess
    goes to the others by weight until none is above. That is a water level: sources sorted by cap / weight fill up
    first, and the level is right for the first count of full sources at which the next one stays below its cap: the greatest
    of the levels that keep their source below it."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(ws, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    per = per.withColumn("_water", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("_w"), F.col("_cap")))
    return per.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, _text: a hash of the text) per document."""
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    sized = durable(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("_key"), F.size(words(F.col(text))).cast("long").alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_text")), "mix-sizes")
    n = sized.count()
    digits = 1
    while n > 4_000_000 * 16**digits and digits < 8:
        digits += 1
    keyed = sized.withColumn("_class", F.expr(_CLASS.format(s="size"))).withColumn("_tie", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), "_text").cast("binary"))).withColumn("_salt", F.substring("_tie", 1, digits))
    groups = keyed.groupBy("_key", "_class", "_salt").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("_key").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("_key", "_class", "_salt", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    targets = source_targets(sized, weights, share, max_repeat).select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_key"), "source_size", "target")
    inside = Window.partitionBy("_key", "_class", "_salt").orderBy("_tie")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside))
    placed = ranked.join(starts, ["_key", "_class", "_salt"]).join(targets, "_key")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("_before") + F.col("_rank")
    placed = placed.withColumn("_u", offset).withColumn("_e", each).withColumn("_at", at.cast("double"))
    copies = (F.floor(F.col("_e") * F.col("_at") + F.col("_u")) - F.floor(F.col("_e") * (F.col("_at") - 1) + F.col("_u"))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_text")


def emit(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it, columns unchanged.

    Rows are matched by id. Where ids repeat or are null, they are matched by id, source, size and the text's hash, and rows
    that are alike in these by their number."""
    copies = mixed.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("copies").cast("int").alias("_c"), F.col("_text").alias("_h"))
    shared = durable(copies.groupBy("_i").agg(F.count("*").alias("n")).where("n > 1 or _i is null").select(F.col("_i").alias("_r")), "mix-repeats")
    # a document's columns travel as one struct: no name of theirs meets one of these
    docs = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_d"), F.col(source).alias("_o"), F.col(text).alias("_x"))

    def repeat(rows: DataFrame) -> DataFrame:
        return rows.where("_c > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_c")))).select("_row.*")

    if shared.isEmpty():
        return repeat(docs.join(copies, F.col("_d") == F.col("_i")))
    one, many = (lambda x, i: x.join(shared, F.col(i).eqNullSafe(F.col("_r")), "left_anti")), (lambda x, i: x.join(shared, F.col(i).eqNullSafe(F.col("_r")), "left_semi"))
    hashed = docs.withColumn("_m", F.md5(F.coalesce(F.col("_x"), F.lit("")).cast("binary")))
    alike = many(hashed, "_d").withColumn("_k", F.row_number().over(Window.partitionBy("_d", "_o", "_m").orderBy(F.lit(0))))
    counted = many(copies, "_i").withColumn("_j", F.row_number().over(Window.partitionBy("_i", "_s", "_h").orderBy("_c")))
    same = F.col("_d").eqNullSafe(F.col("_i")) & F.col("_o").eqNullSafe(F.col("_s")) & (F.col("_m") == F.col("_h")) & (F.col("_k") == F.col("_j"))
    return repeat(one(docs, "_d").join(one(copies, "_i"), F.col("_d") == F.col("_i"))).unionByName(repeat(alike.join(counted, same)))


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
with recursive s as (select row_number() over () rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(text, '')) th from {docs}),
p as (select source, sum(size)::bigint source_size from s group by source),
w as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double wt, (source_size * 2.0)::double cap from p),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / wt, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / (sum(wt) over () - coalesce(sum(wt) over (order by cap / wt, source nulls last rows between unbounded preceding and 1 preceding), 0)) lev from w),
t as (select source, source_size, least(cap, coalesce((max(case when lev * wt <= cap then lev end) over ()) * wt, cap)) as target,
  ('0x' || substr(md5('mix-1:' || coalesce('s' || source, 'n')), 1, 8))::bigint::double / 4294967296.0::double u from l),
r as (select rid, doc_id, size, s.source, source_size, target, u, case when source_size > 0 then target / source_size else 0 end e,
  (row_number() over (partition by s.source order by greatest(length(bin(size)) - 7, 0) * 128 + (size >> greatest(length(bin(size)) - 7, 0)), md5(coalesce(doc_id::varchar, '') || ':' || size || ':' || th)))::double k
  from s join t on s.source is not distinct from t.source)
"""
SQL = {"op5_systematic_mix": MIX_SQL.format(docs="documents") + "select doc_id, size, source_size, target, ((floor(e * k + u) - floor(e * (k - 1) + u))::bigint * size)::bigint taken from r"}
QUERIES = {"op5_systematic_mix": op5_systematic_mix}
