"""The query catalogue: each query as a DataFrame plan over the supplied tables, and its SQL where SQL can express it.

Patches: 25 vectors are one image's 5 x 5 grid; even images are references, odd ones are queries; a patch lies in the mask of
its label. Thresholds are scaled to these vectors, whose similarities are low.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.vectors import ratio
from ..operators import bank as banks
from ..operators import clusters, geometry, masks, matching, metrics, protocol, runs, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOW, HIGH, KEEP, LOOSE = 0.05, 0.20, 0.15, 0.30


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def patches(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").selectExpr("vec_id", "vec_id div 25 image_id", "cast(vec_id % 25 as int) patch_no", "cast((vec_id % 25) div 5 as int) row", "cast(vec_id % 5 as int) col", "label class_id", "embedding")
    ann = F.col("image_id") * 10 + F.col("class_id")
    return v.withColumn("ann_id", ann).withColumn("file_key", banks.file_key(F.col("image_id"), F.col("ann_id")))


def bank_of(p: DataFrame) -> DataFrame:
    return p.where("image_id % 2 = 0")


def queries_of(p: DataFrame) -> DataFrame:
    """Every query cell for every class present in its image."""
    q = p.where("image_id % 2 = 1")
    asked = q.select("image_id", "class_id").distinct()
    return q.drop("class_id").join(asked, "image_id").select("class_id", "image_id", "row", "col", "embedding")


def scored_bank(spark: SparkSession, sf: str, limit: int | None = 100) -> DataFrame:
    """The bank with its votes in the first limit target images of each class, or in all of them."""
    p = patches(spark, sf)
    return banks.scored(bank_of(p), p.where("image_id % 2 = 0"), 0.0, 3, limit)


P = """p as (select vec_id, vec_id // 25 image_id, (vec_id % 25)::int patch_no, ((vec_id % 25) // 5)::int "row", (vec_id % 5)::int col, label class_id, embedding::double[] e,
 sqrt(list_inner_product(embedding::double[], embedding::double[])) m, (vec_id // 25) || '_' || ((vec_id // 25) * 10 + label) || '.pt' file_key, (vec_id // 25) * 10 + label ann_id from embeddings),
bank as (select * from p where image_id % 2 = 0)"""
VOTES = P + """,
ti as (select class_id, image_id from (select class_id, image_id, row_number() over (partition by class_id order by image_id) k from (select distinct class_id, image_id from bank)) where k <= 100),
tv as (select b.vec_id, b.class_id, t.image_id, q.patch_no, q.class_id = b.class_id inside, round(list_inner_product(b.e, q.e) / (b.m * q.m), 12) sim from bank b join ti t on t.class_id = b.class_id and t.image_id <> b.image_id join p q on q.image_id = t.image_id),
best as (select *, row_number() over (partition by vec_id, image_id order by sim desc, patch_no) k from tv),
votes as (select vec_id, class_id, sum((sim >= 0 and inside)::int)::bigint tp, sum((sim >= 0 and not inside)::int)::bigint fp from best where k = 1 group by all),
sc as (select b.vec_id, b.class_id, b.image_id, b.patch_no, b.file_key, coalesce(tp, 0)::bigint tp, coalesce(fp, 0)::bigint fp, case when coalesce(tp, 0) + coalesce(fp, 0) >= 3 then tp / (tp + fp) end score from bank b left join votes using (vec_id, class_id))"""
SIM = P + """,
q as (select * from p where image_id % 2 = 1), asked as (select distinct image_id, class_id from q),
sims as (select a.class_id, q.image_id, q."row", q.col, max(list_inner_product(b.e, q.e) / (b.m * q.m)) sim from q join asked a using (image_id) join bank b on b.class_id = a.class_id group by all)"""


def q6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


@query(f"with {VOTES} select vec_id, class_id, tp, fp from votes")
def iccd_votes(spark, sf):
    p = patches(spark, sf)
    b = bank_of(p)
    return search.votes(b, banks.targets(b, banks.target_images(b, 100)), 0.0)


@query(f"with {VOTES} select vec_id, class_id, tp, fp, round(score, 6) score from sc where score >= {KEEP}")
def iccd_score_bank(spark, sf):
    return banks.top_k(scored_bank(spark, sf), KEEP, None).select("vec_id", "class_id", "tp", "fp", q6("score"))


@query(f"with {VOTES}, r as (select *, row_number() over (partition by class_id order by score desc, file_key, patch_no) k from sc where score >= {KEEP}) select vec_id, class_id, round(score, 6) score from r where k <= 5")
def filter_fixed_topk(spark, sf):
    return banks.top_k(scored_bank(spark, sf), KEEP, 5).select("vec_id", "class_id", q6("score"))


@query(f"with {VOTES}, t as (select class_id, least({HIGH}, greatest({LOW}, quantile_cont(score, 0.75) * 0.9)) threshold from sc where score is not null group by class_id) select vec_id, class_id, round(score, 6) score, round(threshold, 6) threshold from sc join t using (class_id) where score >= threshold")
def filter_adaptive_q75(spark, sf):
    return banks.adaptive(scored_bank(spark, sf), LOW, HIGH).select("vec_id", "class_id", q6("score"), q6("threshold"))


@query(f"with {VOTES}, c as (select *, image_id % 3 cluster from sc where score is not null), t as (select class_id, cluster, count(*) cluster_size, least({HIGH}, greatest({LOW}, quantile_cont(score, 0.75) * 0.9)) threshold from c group by all having count(*) >= 5), r as (select *, row_number() over (partition by class_id order by score desc, file_key, patch_no) k from c join t using (class_id, cluster) where score >= threshold) select vec_id, class_id, cluster, cluster_size, round(score, 6) score, round(threshold, 6) threshold from r where k <= 8")
def filter_clustered_adaptive(spark, sf):
    rows = scored_bank(spark, sf).withColumn("cluster", F.col("image_id") % 3)
    return banks.clustered(rows, LOW, HIGH, smallest=5, k=8).select("vec_id", "class_id", "cluster", "cluster_size", q6("score"), q6("threshold"))


@query()
def filter_clustered_kmeans(spark, sf):
    rows = banks.with_clusters(scored_bank(spark, sf, None).where("score is not null"))
    return banks.clustered(rows, LOW, HIGH, smallest=5).select("vec_id", "class_id", "cluster", q6("score"))


_GROUPS = "with s as (select count(*) n from embeddings), k as (select case when n < 200 then 1 else greatest(1, least(greatest(2, least(8, round(sqrt(n / 250)))), n // 25))::int end k from s), r as (select vec_id, vec_id % k g from embeddings cross join k)"


def _separated(spark, sf):
    """All vectors as one class, moved far apart along as many axes as the class's size asks for clusters."""
    v = read(spark, sf, "embeddings").select("vec_id", "embedding")
    k = clusters.cluster_count(v.count())
    away = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.pmod("vec_id", F.lit(k)), 50.0).otherwise(0.0))
    return v.select("vec_id", F.lit(1).alias("class_id"), away.alias("embedding"))


@query(f"{_GROUPS} select vec_id, min(vec_id) over (partition by g) first_vec_id, count(*) over (partition by g) cluster_size from r")
def kmeans_separable(spark, sf):
    """K-means of all vectors as one class in groups that lie far apart: the cluster of each by its first member, and its size."""
    got = clusters.with_clusters(_separated(spark, sf)).select("vec_id", "cluster")
    sizes = got.groupBy("cluster").agg(F.min("vec_id").alias("first_vec_id"), F.count("*").alias("cluster_size"))
    return got.join(sizes, "cluster").select("vec_id", "first_vec_id", "cluster_size")


_FLOOR = f"with {VOTES}, f as (select *, coalesce(score >= {{t}}, true) ok, count(*) over (partition by class_id) n, row_number() over (partition by class_id order by coalesce(score, 0.5) desc, file_key, patch_no) k from sc), g as (select *, sum(ok::int) over (partition by class_id) s, greatest(1, floor(n * 0.3)) need from f), h as (select *, case when s >= need then ok else k <= need end keep from g)"


@query(_FLOOR.format(t=0.25) + " select vec_id, class_id, keep from h")
def filter_min_keep_floor(spark, sf):
    return banks.keep_floor(scored_bank(spark, sf), 0.25, 0.30).select("vec_id", "class_id", "keep")


@query(_FLOOR.format(t=0.15) + ", c as (select *, row_number() over (partition by class_id order by keep desc, coalesce(score, 0.5) desc, file_key, patch_no) j from h) select vec_id, class_id, keep and j <= 6 keep from c")
def target_reference_cap(spark, sf):
    return banks.cap_references(banks.keep_floor(scored_bank(spark, sf), 0.15, 0.30), 6).select("vec_id", "class_id", "keep")


@query(f"with {VOTES} select vec_id, class_id, round(least(1, greatest(0, coalesce(score, 0.5))), 6) weight from sc")
def reweight_bank(spark, sf):
    return banks.reweighted(scored_bank(spark, sf)).select("vec_id", "class_id", q6("weight"))


@query(f"with {VOTES}, a as (select *, coalesce(score >= {KEEP}, false)::int ok, coalesce(sum(coalesce(score >= {KEEP}, false)::int) over (partition by class_id order by file_key, patch_no rows between unbounded preceding and 1 preceding), 0) b from sc) select vec_id, class_id, b < 2 looked, b < 2 and ok = 1 accepted, case when b < 2 and ok = 1 then round(score, 6) else 0 end score, case when b < 2 and ok = 1 then tp else 0 end tp, case when b < 2 and ok = 1 then fp else 3 end fp from a")
def early_accept(spark, sf):
    return banks.early_accept(scored_bank(spark, sf), KEEP, 2).select("vec_id", "class_id", "looked", "accepted", q6("score"), "tp", "fp")


@query(f"with {P}, s as (select a.vec_id, a.class_id, a.image_id, max(case when a.vec_id <> b.vec_id then list_inner_product(a.e, b.e) / (a.m * b.m) end) sim from bank a join bank b using (class_id, image_id) group by all) select vec_id, class_id, image_id, case when sim >= 0 then round(sim, 6) end score, case when sim >= 0 then 3 else 0 end::bigint tp, 0::bigint fp, true match_counts_are_synthetic from s")
def one_shot_self_similarity(spark, sf):
    return banks.one_shot(bank_of(patches(spark, sf))).withColumn("score", F.round("score", 6))


_RATIO = "case when sum(tp) + sum(fp) > 0 then sum(tp) / (sum(tp) + sum(fp)) else 0 end"


@query(f"with {VOTES} select class_id, count(*) total, sum(coalesce(score >= {KEEP}, false)::int)::bigint kept, count(score) n_scored, sum(tp)::bigint tp, sum(fp)::bigint fp, round(avg(score), 4) mean_score, round(quantile_disc(score, 0.5), 4) median_score, round(stddev_pop(score), 4) std_score, round(min(score), 4) min_score, round(max(score), 4) max_score, round(100.0::double * (count(*) - sum(coalesce(score >= {KEEP}, false)::int)) / count(*), 1) removed_pct, round({_RATIO}, 4) \"precision\" from sc group by class_id")
def score_report(spark, sf):
    return banks.report(scored_bank(spark, sf), F.coalesce(F.col("score") >= KEEP, F.lit(False)))


@query(f"with {VOTES} select count(*) total, sum(coalesce(score >= {KEEP}, false)::int)::bigint kept, sum(tp)::bigint tp, sum(fp)::bigint fp, round({_RATIO}, 4) \"precision\", round(100.0::double * (count(*) - sum(coalesce(score >= {KEEP}, false)::int)) / count(*), 2) removed_pct from sc")
def score_report_total(spark, sf):
    return banks.report_total(scored_bank(spark, sf), F.coalesce(F.col("score") >= KEEP, F.lit(False)))


@query(f"with {P}, r as (select *, row_number() over (partition by class_id order by file_key, patch_no) k from bank) select vec_id, class_id, file_key, patch_no from r where k <= 20")
def bank_cap_first_n(spark, sf):
    return banks.first_n(bank_of(patches(spark, sf)), 20).select("vec_id", "class_id", "file_key", "patch_no")


def _annotations(spark, sf):
    return patches(spark, sf).groupBy("class_id", "image_id", "ann_id").agg(F.sum(F.when(F.col("patch_no") % 4 != 0, 1).otherwise(0)).alias("n_patches"))


_ANN = P + ", ann as (select class_id, image_id, ann_id, sum((patch_no % 4 <> 0)::int)::bigint n_patches from p group by all)"


@query(f"with {_ANN}, r as (select *, dense_rank() over (partition by class_id order by image_id) k from ann where n_patches > 0) select class_id, image_id, ann_id, n_patches from r where k <= 4")
def build_quota_images(spark, sf):
    return banks.quota(_annotations(spark, sf), max_images=4)


@query(f"with {_ANN}, r as (select *, coalesce(sum(n_patches) over (partition by class_id order by image_id, ann_id rows between unbounded preceding and 1 preceding), 0) b from ann where n_patches > 0) select class_id, image_id, ann_id, n_patches from r where b < 10")
def build_quota_features(spark, sf):
    return banks.quota(_annotations(spark, sf), max_features=10)


@query(f"with {SIM} select class_id, image_id, \"row\", col, round(sim, 6) sim from sims")
def similarity_map(spark, sf):
    p = patches(spark, sf)
    return search.best_similarity(queries_of(p), bank_of(p)).withColumn("sim", F.round("sim", 6))


@query(f"with {SIM}, r as (select *, row_number() over (partition by image_id, class_id order by sim desc, \"row\", col) rank from sims where sim > 0.25) select image_id, class_id, \"row\", col, round(sim, 6) sim, rank, (col + 0.5::double) * 20 x, (\"row\" + 0.5::double) * 20 y from r where rank <= 3")
def match_absolute_topk(spark, sf):
    p = patches(spark, sf)
    return matching.absolute(queries_of(p), bank_of(p), 3, 0.25, (5, 5), (100.0, 100.0)).select("image_id", "class_id", "row", "col", q6("sim"), F.col("rank").cast("long").alias("rank"), "x", "y")


@query(f"with {SIM}, everyone as (select b.class_id, q.image_id, q.\"row\", q.col, max(list_inner_product(b.e, q.e) / (b.m * q.m)) sim from q, bank b group by all), conf as (select s.class_id, s.image_id, s.\"row\", s.col, s.sim - coalesce((select max(o.sim) from everyone o where o.image_id = s.image_id and o.\"row\" = s.\"row\" and o.col = s.col and o.class_id <> s.class_id), 0) conf from sims s), top as (select c.*, (select max(d.conf) from conf d where d.image_id = c.image_id and d.class_id = c.class_id and abs(d.\"row\" - c.\"row\") <= 1 and abs(d.col - c.col) <= 1) m from conf c) select image_id, class_id, \"row\", col, round(conf, 6) conf from top where conf = m and conf > -0.1")
def match_relative_suppressed(spark, sf):
    p = patches(spark, sf)
    return matching.relative(queries_of(p), bank_of(p), -0.1, 1, 0.0, (5, 5), (100.0, 100.0)).select("image_id", "class_id", "row", "col", q6("conf"))


_COMP = """{c} as (select image_id, class_id, "row", col, "row" * 5 + col cell{more} from {src}),
reach as (select image_id, class_id, cell, cell seed from {c} union select n.image_id, n.class_id, n.cell, r.seed from reach r join {c} a on a.image_id = r.image_id and a.class_id = r.class_id and a.cell = r.cell join {c} n on n.image_id = a.image_id and n.class_id = a.class_id and {near}),
lab as (select image_id, class_id, cell, min(seed) first from reach group by all), comp as (select l.*, dense_rank() over (partition by image_id, class_id order by first)::int component from lab l)"""
_NEAR8, _NEAR4 = 'abs(n."row" - a."row") <= 1 and abs(n.col - a.col) <= 1', 'abs(n."row" - a."row") + abs(n.col - a.col) <= 1'


@query("with recursive " + SIM + ", " + _COMP.format(c="cells", src=f"sims where sim >= {LOOSE}", near=_NEAR8, more=", sim") + """,
full_ as (select c.*, k.component, count(*) over (partition by c.image_id, c.class_id, k.component) n from cells c join comp k using (image_id, class_id, cell)),
peak as (select a.*, (select max(b.sim) from full_ b where b.image_id = a.image_id and b.class_id = a.class_id and b.component = a.component and abs(b."row" - a."row") <= 1 and abs(b.col - a.col) <= 1) m from full_ a where n >= 2)
select image_id, class_id, component, "row", col, round(sim, 6) score, (row_number() over (partition by image_id, class_id order by sim desc, component, "row", col))::int rank, (col + 0.5::double) * 20 x, ("row" + 0.5::double) * 20 y from peak where sim = m""")
def match_hybrid_components(spark, sf):
    p = patches(spark, sf)
    return matching.hybrid(queries_of(p), bank_of(p), LOOSE, 2, 1, (5, 5), (100.0, 100.0)).withColumn("score", F.round("score", 6))


@query("with recursive " + P + ", " + _COMP.format(c="cells", src="p", near=_NEAR8, more="") + " select image_id, class_id, cell, component from comp")
def components_8(spark, sf):
    cells = patches(spark, sf).select("image_id", "class_id", "row", "col")
    return geometry.components(cells, connectivity=8).select("image_id", "class_id", (F.col("row") * 5 + F.col("col")).alias("cell"), "component")


@query("with recursive " + P + ", " + _COMP.format(c="cells", src="p", near=_NEAR4, more="") + " select image_id, class_id, cell, component from comp")
def components_4(spark, sf):
    cells = patches(spark, sf).select("image_id", "class_id", "row", "col")
    return geometry.components(cells, connectivity=4).select("image_id", "class_id", (F.col("row") * 5 + F.col("col")).alias("cell"), "component")


@query(f"with {SIM}, t as (select c.*, (select max(d.sim) from sims d where d.image_id = c.image_id and d.class_id = c.class_id and abs(d.\"row\" - c.\"row\") <= 1 and abs(d.col - c.col) <= 1) m from sims c) select image_id, class_id, \"row\", col, round(sim, 6) sim from t where sim = m and sim > 0")
def local_maxima_2d(spark, sf):
    p = patches(spark, sf)
    return geometry.local_maxima(search.best_similarity(queries_of(p), bank_of(p)), 1, 0.0).select("image_id", "class_id", "row", "col", q6("sim"))


@query(f"""with recursive {SIM[5:] if SIM.startswith("with ") else SIM}, o as (select image_id, class_id, "row" r, col c, sim, row_number() over (partition by image_id, class_id order by sim desc, "row", col) k from sims),
w as (select image_id, class_id, k, sim, r, c, [[r, c]] kept, true ok from o where k = 1
  union all select o.image_id, o.class_id, o.k, o.sim, o.r, o.c, case when z.free then list_append(w.kept, [o.r, o.c]) else w.kept end, z.free
  from w join o on o.image_id = w.image_id and o.class_id = w.class_id and o.k = w.k + 1, lateral (select len(list_filter(w.kept, lambda p: (p[1] - o.r) * (p[1] - o.r) + (p[2] - o.c) * (p[2] - o.c) < 4)) = 0 free) z)
select image_id, class_id, r as "row", c as col, round(sim, 6) sim from w where ok""")
def nms_points(spark, sf):
    p = patches(spark, sf)
    return geometry.nms_points(search.best_similarity(queries_of(p), bank_of(p)), 2.0).withColumn("sim", F.round("sim", 6))


def _instances(spark, sf):
    """Instances of lines: an order's lines of one flag and quarter of the quantity."""
    return read(spark, sf, "lineitem").selectExpr("l_orderkey image_id", "l_returnflag class_id", "cast(l_quantity as int) % 3 inst", "cast(l_linenumber as bigint) pixel", "l_tax score")


def _pixels(instances: DataFrame, condition: str) -> DataFrame:
    """Distinct pixels of instances, dealt by instance."""
    own = ("image_id", "class_id", "inst")
    return instances.where(condition).select(*own, "pixel").repartition(*own).distinct()


@query("""with recursive i as (select l_orderkey image_id, l_returnflag class_id, l_quantity::int % 3 inst, l_linenumber::bigint pixel, l_tax score from lineitem),
g as (select image_id, class_id, inst, max(score) score, list(distinct pixel) px from i group by all),
o as (select *, row_number() over (partition by image_id, class_id order by score desc, inst) k from g),
w as (select image_id, class_id, inst, score, k, [px] kept, true ok from o where k = 1
  union all select o.image_id, o.class_id, o.inst, o.score, o.k, case when z.free then list_append(w.kept, o.px) else w.kept end, z.free
  from w join o on o.image_id = w.image_id and o.class_id = w.class_id and o.k = w.k + 1, lateral (select len(list_filter(w.kept, lambda q: len(list_intersect(q, o.px)) > 0.5 * (len(q) + len(o.px) - len(list_intersect(q, o.px))))) = 0 free) z)
select image_id, class_id, inst, score from w where ok""")
def nms_masks(spark, sf):
    inst = _instances(spark, sf).groupBy("image_id", "class_id", "inst").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("pixel")).alias("pixels"))
    return masks.nms_masks(inst, 0.5)


@query(f"with {SIM}, d as (select s.class_id, sim > {LOOSE} p, coalesce(o.class_id = s.class_id, false) g from sims s join q o on o.image_id = s.image_id and o.\"row\" = s.\"row\" and o.col = s.col), c as (select class_id, sum((p and g)::int)::bigint tp, sum((p and not g)::int)::bigint fp, sum((not p and not g)::int)::bigint tn, sum((not p and g)::int)::bigint fn from d group by rollup(class_id)) select coalesce(class_id, -1) class_id, tp, fp, tn, fn, case when tp + fp > 0 then tp / (tp + fp) else 0 end \"precision\", case when tp + fn > 0 then tp / (tp + fn) else 0 end recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end f1, (tp + tn) / (tp + fp + tn + fn) accuracy from c")
def dense_confusion_rollup(spark, sf):
    p = patches(spark, sf)
    own = p.select("image_id", "row", "col", F.col("class_id").alias("_label"))
    cells = search.best_similarity(queries_of(p), bank_of(p)).join(own, ["image_id", "row", "col"])
    return metrics.dense_confusion(cells, F.col("sim") > LOOSE, F.col("_label") == F.col("class_id")).withColumn("class_id", F.coalesce("class_id", F.lit(-1)))


@query(f"with {SIM}, r as (select *, row_number() over (partition by image_id, class_id order by sim desc, \"row\", col) k from sims), pts as (select image_id, class_id, k, least(greatest(round_even(col + 0.5::double, 0)::int, 0), 4) px, least(greatest(round_even(\"row\" + 0.5::double, 0)::int, 0), 4) py from r where k <= 3), h as (select distinct t.image_id, t.class_id, k from pts t join q on q.image_id = t.image_id and q.class_id = t.class_id and q.col = px and q.\"row\" = py), a as (select class_id, count(*) prompts from pts group by 1), b as (select class_id, count(*) tp from h group by 1), f as (select class_id, count(distinct image_id) found from h group by 1), g as (select class_id, count(distinct image_id) gt from q group by 1), z as (select class_id, prompts, coalesce(tp, 0) tp, coalesce(found, 0) found, gt from g left join a using (class_id) left join b using (class_id) left join f using (class_id)), y as (select *, tp / prompts p, found / gt r from z) select class_id, prompts, tp, prompts - tp fp, found, gt - found missed, p \"precision\", r recall, case when p + r > 0 then 2 * p * r / (p + r) else 0 end f1 from y")
def point_metrics(spark, sf):
    p = patches(spark, sf)
    top = matching.absolute(queries_of(p), bank_of(p), 3, None, (5, 5), (5.0, 5.0))
    points = top.select("image_id", "class_id", F.col("rank").alias("point_id"), "x", "y", F.lit(5).alias("width"), F.lit(5).alias("height"))
    inst = p.where("image_id % 2 = 1").select("image_id", "class_id", F.col("class_id").alias("inst"), F.col("col").alias("px"), F.col("row").alias("py"))
    return metrics.point_metrics(points, inst)


def _line_masks(spark, sf):
    rows = read(spark, sf, "lineitem").selectExpr("l_orderkey image_id", "l_returnflag class_id", "cast(l_linenumber as bigint) pixel", "l_quantity", "l_discount", "l_tax")
    return rows.where("l_discount >= 0.05"), rows.where("l_quantity > 25")


_LINES = """pr as (select distinct l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint pixel from lineitem where l_discount >= 0.05), gt as (select distinct l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint pixel from lineitem where l_quantity > 25),
c as (select coalesce(p.class_id, g.class_id) class_id, sum((p.pixel is not null and g.pixel is not null)::int)::bigint tp, sum((g.pixel is null)::int)::bigint fp, sum((p.pixel is null)::int)::bigint fn from pr p full join gt g on p.image_id = g.image_id and p.class_id = g.class_id and p.pixel = g.pixel group by 1)"""
_PRF = "case when tp + fp + fn > 0 then tp / (tp + fp + fn) else 0 end iou, case when tp + fp > 0 then tp / (tp + fp) else 0 end \"precision\", case when tp + fn > 0 then tp / (tp + fn) else 0 end recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end f1"


@query(f"with {_LINES} select class_id, tp, fp, fn, {_PRF} from c")
def mask_iou_per_class(spark, sf):
    pred, gt = _line_masks(spark, sf)
    return metrics.with_ratios(metrics.pixel_counts(pred, gt))


@query(f"with {_LINES}, t as (select sum(tp)::bigint tp, sum(fp)::bigint fp, sum(fn)::bigint fn, coalesce(avg(case when tp + fn > 0 then tp / (tp + fp + fn) end), 0) miou from c) select tp, fp, fn, miou, {_PRF} from t")
def mask_metrics_global(spark, sf):
    pred, gt = _line_masks(spark, sf)
    return metrics.global_metrics(metrics.pixel_counts(pred, gt))


def _records(spark, sf):
    return read(spark, sf, "events").select(F.col("event_type").alias("class_id"), F.col("value").alias("score"), (F.get_json_object("props", "$.k").cast("int") % 2).alias("is_tp"), F.col("event_id").alias("rec_id"))


_AP = """r as (select event_type class_id, value score, (json_extract_string(props, '$.k')::int % 2) is_tp, event_id rec_id from events), g as (select class_id, (sum(is_tp) + 10)::bigint gt_count from r group by 1),
k as (select *, sum(is_tp) over w t, count(*) over w n from r window w as (partition by class_id order by score desc, rec_id rows between unbounded preceding and current row)),
e as (select *, max(t / n) over (partition by class_id order by n rows between current row and unbounded following) env from k),
ap as (select class_id, gt_count, coalesce(sum(case when is_tp = 1 then env end), 0) / gt_count ap from g join e using (class_id) group by class_id, gt_count)"""


def _aps(spark, sf):
    r = _records(spark, sf)
    return metrics.average_precision(r, r.groupBy("class_id").agg((F.sum("is_tp") + 10).alias("gt_count")))


@query(f"with {_AP} select class_id, gt_count, round(ap, 6) ap from ap")
def average_precision(spark, sf):
    return _aps(spark, sf).withColumn("ap", F.round("ap", 6))


@query(f"with {_AP} select round(avg(ap), 6) map50 from ap")
def map50(spark, sf):
    return metrics.mean_ap(_aps(spark, sf)).withColumn("map50", F.round("map50", 6))


@query("""with recursive i as (select l_orderkey image_id, l_returnflag class_id, l_quantity::int % 3 inst, l_linenumber::bigint pixel, l_tax score from lineitem),
a as (select image_id, class_id, inst, max(score) score, list(distinct pixel) px from i where score >= 0.03 group by all),
b as (select image_id, class_id, list({'inst': inst, 'px': px}) gt from (select image_id, class_id, inst, list(distinct pixel) px from i where score <= 0.05 group by all) group by all),
o as (select a.*, coalesce(gt, []) gt, row_number() over (partition by a.image_id, a.class_id order by score desc, inst) k from a left join b using (image_id, class_id)),
u as (select image_id, class_id, inst, score, k, unnest(case when len(gt) = 0 then [null] else gt end) g, px from o),
v as (select image_id, class_id, inst, score, k, g.inst other, len(list_intersect(px, g.px)) / (len(px) + len(g.px) - len(list_intersect(px, g.px)))::double iou from u),
l as (select image_id, class_id, inst, score, k, list({'o': other, 'iou': iou} order by iou desc, other) filter (iou > 0) options from v group by all),
w as (select image_id, class_id, inst, score, k, case when options[1].iou >= 0.5 then [options[1].o] else [] end taken, (coalesce(options[1].iou, 0) >= 0.5)::int hit from l where k = 1
  union all select l.image_id, l.class_id, l.inst, l.score, l.k, case when z.best.iou >= 0.5 then list_append(w.taken, z.best.o) else w.taken end, (coalesce(z.best.iou, 0) >= 0.5)::int
  from w join l on l.image_id = w.image_id and l.class_id = w.class_id and l.k = w.k + 1, lateral (select list_filter(coalesce(l.options, []), lambda p: not list_contains(w.taken, p.o))[1] best) z)
select image_id, class_id, inst inst_a, score, hit is_tp from w""")
def greedy_gt_match(spark, sf):
    i = _instances(spark, sf)
    a, b = _pixels(i, "score >= 0.03"), _pixels(i, "score <= 0.05")
    preds = i.where("score >= 0.03").groupBy("image_id", "class_id", F.col("inst").alias("inst_a")).agg(F.max("score").alias("score"))
    return metrics.greedy_match(preds, masks.pair_iou(a, b), 0.5)


def _sides(spark, sf):
    rows = read(spark, sf, "lineitem").selectExpr("l_orderkey image_id", "l_returnflag class_id", "cast(l_linenumber as bigint) pixel", "l_discount", "l_quantity", "l_tax score")
    return rows.where("l_discount >= 0.05").drop("l_discount", "l_quantity"), rows.where("l_quantity > 25").drop("l_discount", "l_quantity")


_SIDES = "a as (select l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint pixel, l_tax score from lineitem where l_discount >= 0.05), b as (select l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint pixel, l_tax score from lineitem where l_quantity > 25)"


@query(f"with {_SIDES}, u as (select * from a union all select * from b) select distinct image_id, class_id, pixel, max(score) over (partition by image_id, class_id) score from u")
def merge_union(spark, sf):
    return masks.merged_union(*_sides(spark, sf))


@query(f"with {_SIDES}, sa as (select image_id, class_id, max(score) s from a group by all), sb as (select image_id, class_id, max(score) s from b group by all), i as (select image_id, class_id, pixel from a intersect select image_id, class_id, pixel from b) select i.*, least(sa.s, sb.s) score from i join sa using (image_id, class_id) join sb using (image_id, class_id)")
def merge_intersection(spark, sf):
    return masks.merged_intersection(*_sides(spark, sf))


@query("with recursive " + P + ", t0 as (select image_id, class_id, \"row\", col, (vec_id % 7) / 7.0::double s from p where vec_id % 3 <> 0), q0 as (select image_id, class_id, \"row\", col, (vec_id % 5) / 5.0::double s from p where vec_id % 4 <> 0), both_ as (select coalesce(t.image_id, q.image_id) image_id, coalesce(t.class_id, q.class_id) class_id, coalesce(t.\"row\", q.\"row\") \"row\", coalesce(t.col, q.col) col, t.s ts, q.s qs from t0 t full join q0 q on t.image_id = q.image_id and t.class_id = q.class_id and t.\"row\" = q.\"row\" and t.col = q.col), " + _COMP.format(c="cells", src="both_", near=_NEAR4, more=", ts, qs") + ", w as (select c.*, k.component, coalesce(max(ts) over v, 0) bt, coalesce(max(qs) over v, 0) bq from cells c join comp k using (image_id, class_id, cell) window v as (partition by c.image_id, c.class_id, k.component)) select image_id, class_id, \"row\", col, component, case when bq > bt then 'point' else 'text' end side, score from (select *, max(greatest(bt, bq)) over (partition by image_id, class_id) score from w) where case when bq > bt then qs is not null else ts is not null end")
def merge_confidence_weighted(spark, sf):
    p = patches(spark, sf)
    side = lambda n, keep: p.where(f"vec_id % {keep} <> 0").select("image_id", "class_id", "row", "col", (F.col("vec_id") % n / float(n)).alias("score"))
    return masks.merged_confidence(side(7, 3), side(5, 4))


_INST = "i as (select l_orderkey image_id, l_returnflag class_id, l_quantity::int % 3 inst, l_linenumber::bigint pixel, l_tax score from lineitem)"


@query(f"with {_INST}, a as (select distinct image_id, class_id, inst, pixel from i where score >= 0.03), b as (select distinct image_id, class_id, inst, pixel from i where score <= 0.05), na as (select image_id, class_id, inst, count(*) n from a group by all), nb as (select image_id, class_id, inst, count(*) n from b group by all), x as (select a.image_id, a.class_id, a.inst inst_a, b.inst inst_b, count(*) c from a join b using (image_id, class_id, pixel) group by all) select x.image_id, x.class_id, inst_a, inst_b, c / (na.n + nb.n - c) iou from x join na on na.image_id = x.image_id and na.class_id = x.class_id and na.inst = inst_a join nb on nb.image_id = x.image_id and nb.class_id = x.class_id and nb.inst = inst_b")
def pixel_pair_iou(spark, sf):
    i = _instances(spark, sf)
    return masks.pair_iou(_pixels(i, "score >= 0.03"), _pixels(i, "score <= 0.05"))


@query("with x as (select distinct l_suppkey image_id, l_returnflag class_id, (l_partkey % 64)::int y, (l_orderkey % 64)::int x from lineitem) select image_id, class_id, (y // 16)::int \"row\", (x // 16)::int col, count(*) / 256.0::double coverage from x group by all")
def patch_coverage(spark, sf):
    px = read(spark, sf, "lineitem").selectExpr("l_suppkey image_id", "l_returnflag class_id", "cast(l_partkey % 64 as int) y", "cast(l_orderkey % 64 as int) x").distinct()
    return geometry.grid_from_mask(px, 16)


@query("with a as (select distinct o_custkey image_id, l_returnflag category_id from orders join lineitem on l_orderkey = o_orderkey), n as (select distinct o_custkey image_id, l_returnflag category_id from orders join lineitem on l_orderkey = o_orderkey where l_linestatus = 'O' and l_tax > 0.06) select * from a except select * from n")
def valid_categories(spark, sf):
    ol = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("image_id"), F.col("l_returnflag").alias("category_id"), "l_linestatus", "l_tax")
    return protocol.valid_categories(ol, ol.where("l_linestatus = 'O' and l_tax > 0.06"))


def _images(spark, sf):
    return patches(spark, sf).select("image_id").distinct().withColumn("file_name", F.concat(F.when(F.col("image_id") % 4 == 1, "val/").when(F.col("image_id") % 4 == 3, "test/").otherwise("train/"), F.when(F.col("image_id") % 4 == 1, "img_val_").when(F.col("image_id") % 4 == 3, "img_test_").otherwise("img_"), F.col("image_id").cast("string"), F.lit(".jpg")))


_IMAGES = "im as (select distinct image_id, case image_id % 4 when 1 then 'val/' when 3 then 'test/' else 'train/' end || case image_id % 4 when 1 then 'img_val_' when 3 then 'img_test_' else 'img_' end || image_id || '.jpg' file_name from p)"


@query(f"with {_ANN}, {_IMAGES} select class_id, image_id, file_name, string_agg(ann_id::varchar, ',' order by ann_id) ann_ids, case image_id % 4 when 1 then 'val' when 3 then 'test' else 'eval' end split from ann join im using (image_id) group by all")
def query_manifest(spark, sf):
    rows = protocol.query_manifest(_annotations(spark, sf), _images(spark, sf))
    return rows.withColumn("ann_ids", F.array_join(F.transform("ann_ids", lambda x: x.cast("string")), ","))


@query(f"with {_ANN}, {_IMAGES}, ref as (select distinct class_id, image_id from bank) select class_id, image_id, file_name, string_agg(ann_id::varchar, ',' order by ann_id) ann_ids, 'eval' split from ann join im using (image_id) where class_id in (select r_regionkey from region) and (class_id, image_id) in (select * from ref) group by all")
def support_manifest(spark, sf):
    p = patches(spark, sf)
    cats = read(spark, sf, "region").select(F.col("r_regionkey").alias("class_id"))
    rows = protocol.support_manifest(_annotations(spark, sf), _images(spark, sf), cats, bank_of(p))
    return rows.withColumn("ann_ids", F.array_join(F.transform("ann_ids", lambda x: x.cast("string")), ","))


@query("with n as (select label class_id, count(*) n from embeddings group by 1) select n_nationkey class_id, coalesce(n, 0) n from nation left join n on class_id = n_nationkey")
def counts_with_zero(spark, sf):
    """Vectors per class, with the nations as the classes that there are."""
    classes = read(spark, sf, "nation").select(F.col("n_nationkey").alias("class_id"))
    return protocol.counts_with_zero(classes, patches(spark, sf).select("class_id"))


_QUAL = VOTES + f", ok as (select * from sc where score >= {KEEP}), ql as (select class_id, image_id, max(score) max_score, avg(score) mean_score, median(score) median_score, count(distinct file_key) file_count from ok group by all), sup as (select distinct class_id, image_id from bank), ord as (select s.class_id, s.image_id, coalesce(max_score is not null, false) has_scores, max_score, mean_score, median_score, file_count, case when q.class_id is not null then 'filtered_bank' else 'prefilter_fallback' end selection_source from sup s left join ql q on q.class_id = s.class_id and q.image_id = s.image_id), rk as (select *, row_number() over (partition by class_id order by has_scores desc, round(max_score, 9) desc nulls last, round(mean_score, 9) desc nulls last, round(median_score, 9) desc nulls last, file_count desc nulls last, image_id) rank_within_class from ord)"


def _ordered(spark, sf):
    s = scored_bank(spark, sf)
    q = banks.image_quality(s.where(F.col("score") >= KEEP))
    q = q.withColumns({c: F.round(c, 9) for c in ("max_score", "mean_score", "median_score")})
    return protocol.support_order(s.select("class_id", "image_id").distinct(), q)


@query(f"with {_QUAL} select class_id, image_id, rank_within_class, selection_source, has_scores, round(max_score, 6) max_score, round(mean_score, 6) mean_score, round(median_score, 6) median_score, coalesce(file_count, 0) file_count from rk")
def support_order(spark, sf):
    return _ordered(spark, sf).select("class_id", "image_id", F.col("rank_within_class").cast("long").alias("rank_within_class"), "selection_source", "has_scores", q6("max_score"), q6("mean_score"), q6("median_score"), F.coalesce("file_count", F.lit(0)).alias("file_count"))


@query(f"with {_QUAL}, t as (select *, count(*) over (partition by class_id) n from rk) select shot, class_id, image_id, rank_within_class from t, (select unnest([1, 5, 8, 20]) shot) where n >= shot and rank_within_class <= shot")
def k_shot_lists(spark, sf):
    return protocol.k_shots(_ordered(spark, sf), (1, 5, 8, 20)).select("shot", "class_id", "image_id", F.col("rank_within_class").cast("long").alias("rank_within_class"))


@query(f"with {P}, t as (select class_id, count(distinct image_id) n from bank group by 1) select shot, sum((n >= shot)::int)::bigint valid_classes, sum((n < shot)::int)::bigint missing_classes from t, (select unnest([1, 5, 8, 20]) shot) group by shot")
def shot_validity(spark, sf):
    own = bank_of(patches(spark, sf)).select("class_id", "image_id").distinct()
    return protocol.shot_validity(own, (1, 5, 8, 20))


_MET = VOTES + ", met as (select class_id, image_id, sum((tp + fp >= 3)::int)::bigint n_scored, count(case when tp + fp >= 3 and score >= 0.15 then 1 end) n_passing, max(case when tp + fp >= 3 and score >= 0.15 then score end) max_passing, round(avg(case when tp + fp >= 3 and score >= 0.15 then score end), 6) mean_passing, quantile_disc(case when tp + fp >= 3 and score >= 0.15 then score end, 0.5) median_passing, coalesce(bool_or(tp + fp >= 3 and score >= 0.15), false) accepted from sc group by all)"


@query(f"with {_MET} select class_id, image_id, n_scored, n_passing, round(max_passing, 6) max_passing, mean_passing, round(median_passing, 6) median_passing, accepted from met")
def candidate_metrics(spark, sf):
    return banks.candidate_metrics(scored_bank(spark, sf), KEEP, 3).withColumn("max_passing", F.round("max_passing", 6)).withColumn("median_passing", F.round("median_passing", 6))


@query(f"with {_MET}, pool as (select distinct class_id, image_id from bank where image_id in (select doc_id from labels where quality = 1)), av as (select class_id, count(*) n from pool group by 1) select b.class_id, b.image_id, n_passing from (select distinct class_id, image_id from bank) b join av using (class_id) join met m on m.class_id = b.class_id and m.image_id = b.image_id where n < 4 and accepted and not exists (select 1 from pool p where p.class_id = b.class_id and p.image_id = b.image_id)")
def fill_candidates(spark, sf):
    s = scored_bank(spark, sf)
    own = s.select("class_id", "image_id").distinct()
    good = read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("image_id"))
    pool = own.join(good, "image_id", "left_semi")
    return protocol.fill_candidates(own, pool, banks.candidate_metrics(s, KEEP, 3), pool.groupBy("class_id").agg(F.count("*").alias("n")), 4).select("class_id", "image_id", "n_passing")


@query(f"with {P}, a as (select *, 0 l from bank where vec_id in (select doc_id from labels where quality = 1) union all select *, 1 l from bank), f as (select class_id, file_key, min(l) l from a group by all) select a.vec_id, a.class_id, a.file_key from a join f using (class_id, file_key, l)")
def overlay_first_wins(spark, sf):
    b = bank_of(patches(spark, sf)).select("vec_id", "class_id", "file_key")
    good = read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return banks.overlay_first(b.join(good, "vec_id", "left_semi").select(*b.columns), b)


@query(f"with {VOTES}, c as (select distinct class_id from bank), o as (select class_id, min(score) s from sc where image_id < 4 and score >= 0.2 group by 1), b as (select class_id, min(score) s from sc where score >= 0.3 group by 1) select class_id, round(coalesce(o.s, b.s, case when class_id < 5 then 0.4 end, 0.65), 6) floor from c left join o using (class_id) left join b using (class_id)")
def class_floor(spark, sf):
    s = scored_bank(spark, sf)
    classes = s.select("class_id").distinct()
    return banks.class_floor(s.where("image_id < 4 and score >= 0.2"), s.where("score >= 0.3"), classes, classes.where("class_id < 5").withColumn("threshold", F.lit(0.4))).withColumn("floor", F.round("floor", 6))


def _labels(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.col("lang").alias("raw_label"), F.col("source").alias("ref_label"))


@query("select lang raw, source ref, count(*) n from documents group by all")
def label_confusion(spark, sf):
    return protocol.confusion(_labels(spark, sf), "raw_label", "ref_label")


_MAP = "c as (select source raw, lang ref, count(*) n from documents {w} group by all), r as (select *, row_number() over (partition by raw order by n desc, ref) k, sum(n) over (partition by raw) total from c), m as (select raw, max(case when k = 1 then ref end) target, max(total)::bigint total, max(case when k = 1 then n end) / max(total) purity, string_agg(ref, ',' order by k) top_targets from r where k <= 5 group by raw)"


@query(f"with {_MAP.format(w='')} select raw, target, total, round(purity, 6) purity, top_targets, purity < 0.95 low_confidence from m")
def label_mapping(spark, sf):
    return protocol.label_mapping(protocol.confusion(_labels(spark, sf), "ref_label", "raw_label")).withColumn("purity", F.round("purity", 6))


@query(f"with {_MAP.format(w='where doc_id % 5 <> 0')}, h as (select doc_id // 50 g, source s, lang l, target t from documents left join m on m.raw = source where doc_id % 5 = 0), p as (select g, bool_and(coalesce(t = l, false)) ex, count(*) n, sum(coalesce(t = l, false)::int) ok from h group by g), i as (select l c, count(*) a, sum((t = l)::int) i from h group by 1), b as (select t c, count(*) b from h where t is not null group by 1) select (select sum(n)::bigint from p) pixels, (select sum(ok) / sum(n) from p) pixel_accuracy, (select avg(ex::int) from p) exact_match_rate, (select avg(coalesce(i, 0) / (a + coalesce(b, 0) - coalesce(i, 0))) from i left join b using (c)) mean_iou, (select count(distinct s) from h where t is null) unseen_labels")
def mapping_validation(spark, sf):
    rows = _labels(spark, sf)
    mapping = protocol.label_mapping(protocol.confusion(rows.where("doc_id % 5 <> 0"), "ref_label", "raw_label"))
    held = rows.where("doc_id % 5 = 0").withColumn("g", F.expr("doc_id div 50"))
    return protocol.mapping_validation(held, mapping, "ref_label", "raw_label", "g")


@query("select image_id, pixel, arg_max(class_id, (coalesce(rk, 9999), pos)) class_id from (select l_orderkey image_id, l_linenumber::bigint pixel, l_suppkey class_id, case when l_quantity > 10 then l_quantity::int end rk, l_partkey * 100000 + l_suppkey pos from lineitem) group by all")
def painter_last_wins(spark, sf):
    return masks.painted(read(spark, sf, "lineitem").selectExpr("l_orderkey image_id", "cast(l_linenumber as bigint) pixel", "l_suppkey class_id", "case when l_quantity > 10 then cast(l_quantity as int) end depth_rank", "l_partkey * 100000 + l_suppkey pos"))


@query("with x as (select distinct l_suppkey image_id, l_returnflag class_id, (l_partkey % 64)::int y, (l_orderkey % 64)::int x from lineitem) select image_id, class_id, count(*) area, min(x) bbox_x, min(y) bbox_y, max(x) - min(x) + 1 bbox_w, max(y) - min(y) + 1 bbox_h from x group by all")
def bbox_area(spark, sf):
    px = read(spark, sf, "lineitem").selectExpr("l_suppkey image_id", "l_returnflag class_id", "cast(l_partkey % 64 as int) y", "cast(l_orderkey % 64 as int) x").distinct()
    return masks.area_bbox(px)


@query("select p_partkey, case when lower(left(replace(p_name, '_', ' '), 1)) in ('a', 'e', 'i', 'o', 'u', '') then 'an ' else 'a ' end || replace(p_name, '_', ' ') prompt from part")
def prompt_text(spark, sf):
    return read(spark, sf, "part").select("p_partkey", names.prompt_text(F.col("p_name")).alias("prompt"))


_SANE = r"case when trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')) = '' then 'unknown' else replace(replace(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')), '/', ' or '), '\', ' ') end"


@query("select page_id, " + _SANE.format(c="url") + " name from pages")
def sanitize_names(spark, sf):
    return read(spark, sf, "pages").select("page_id", names.sanitized(F.col("url")).alias("name"))


_SLUG = r"regexp_replace(regexp_replace({c}, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"


@query("select page_id, case when left(" + _SLUG.format(c="url") + ", 48) = '' then 'cache' else left(" + _SLUG.format(c="url") + ", 48) end slug from pages")
def slug(spark, sf):
    return read(spark, sf, "pages").select("page_id", names.slug(F.col("url")).alias("slug"))


@query("select page_id, ltrim(replace(url, chr(92), '/'), './') own_key, substr(sha1(url), 1, 12) short_hash, string_split(url, '/')[-1] base from pages")
def cache_keys(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", names.cache_key(u).alias("own_key"), F.substring(F.sha1(u), 1, 12).alias("short_hash"), names.basename(u).alias("base"))


@query("with n as (select distinct original_name from (select p_name original_name from part union all select p_type from part union all select source from documents) where original_name is not null), c as (select original_name, " + _SANE.format(c="original_name") + " clean from n), k as (select *, row_number() over (partition by clean order by original_name) k from c), a as (select *, case when k = 1 then clean else clean || ' (' || k || ')' end nm from k), b as (select *, row_number() over (partition by nm order by k, original_name) j from a) select (row_number() over (order by original_name))::int category_id, case when j = 1 then nm else nm || ' (' || j || ')' end as name, original_name from b")
def vocabulary_ids(spark, sf):
    p, d = read(spark, sf, "part"), read(spark, sf, "documents")
    every = p.select(F.col("p_name").alias("name")).unionByName(p.select(F.col("p_type").alias("name"))).unionByName(d.select(F.col("source").alias("name")))
    return names.vocabulary(every)


@query("select 'except' op, count(*) n from (select c_custkey from customer except select o_custkey from orders) union all select 'intersect', count(*) from (select c_custkey from customer intersect select o_custkey from orders) union all select 'union', count(*) from (select c_custkey from customer union select o_custkey from orders)")
def set_ops(spark, sf):
    c, o = read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    n = lambda op, d: d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n("except", c.join(o, "k", "left_anti").distinct()).unionByName(n("intersect", c.join(o, "k", "left_semi").distinct())).unionByName(n("union", c.union(o).distinct()))


_RUNS = "x as (select distinct l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint pixel from lineitem), i as (select *, pixel - row_number() over (partition by image_id, class_id order by pixel) g from x), runs as (select image_id, class_id, min(pixel) start, count(*) len from i group by image_id, class_id, g)"


@query(f"with {_RUNS} select image_id, class_id, start, len from runs")
def rle_runs(spark, sf):
    return masks.to_runs(read(spark, sf, "lineitem").selectExpr("l_orderkey image_id", "l_returnflag class_id", "cast(l_linenumber as bigint) pixel"))


@query("select distinct l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint pixel from lineitem")
def runs_to_pixels(spark, sf):
    return masks.to_pixels(rle_runs(spark, sf))


@query("with r as (select l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint s, l_quantity::bigint % 4 + 1 n from lineitem), px as (select distinct image_id, class_id, unnest(generate_series(s, s + n - 1)) pixel from r), i as (select *, pixel - row_number() over (partition by image_id, class_id order by pixel) g from px) select image_id, class_id, min(pixel) start, count(*) len from i group by image_id, class_id, g")
def union_of_runs(spark, sf):
    return masks.union_runs(read(spark, sf, "lineitem").selectExpr("l_orderkey image_id", "l_returnflag class_id", "cast(l_linenumber as bigint) start", "cast(l_quantity as bigint) % 4 + 1 len"))


_SIDES = """x as (select distinct l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint + g pixel from lineitem, generate_series(0, 2) t(g) where g <= l_quantity % 3),
y as (select distinct l_orderkey image_id, l_returnflag class_id, l_linenumber::bigint + 2 * g pixel from lineitem, generate_series(0, 1) t(g) where g <= l_suppkey % 2),
isle as (select * from (select *, pixel - row_number() over (partition by op, image_id, class_id order by pixel) g from (select 'union' op, * from (select * from x union select * from y) union all select 'both', * from (select * from x intersect select * from y) union all select 'less', * from (select * from x except select * from y))))"""


@query(f"with {_SIDES} select op, image_id, class_id, min(pixel) as start, count(*) len from isle group by op, image_id, class_id, g")
def runs_algebra(spark, sf):
    """Union, intersection and difference of two relations of runs, by a sweep over their ends."""
    a, b = _run_sides(spark, sf)
    return runs.algebra(a, b).select("op", "image_id", "class_id", "start", "len")


@query(f"with {_SIDES}, j as (select coalesce(x.class_id, y.class_id) class_id, x.pixel is not null a, y.pixel is not null b from x full join y using (image_id, class_id, pixel)) select class_id, sum((a and b)::int)::bigint tp, sum((a and not b)::int)::bigint fp, sum((b and not a)::int)::bigint fn from j group by 1")
def runs_counts(spark, sf):
    """Pixel counters of two relations of runs."""
    return runs.counts(*_run_sides(spark, sf))


@query(f"with {_SIDES}, a as (select image_id, class_id, count(*) n from x group by all), b as (select image_id, class_id, count(*) n from y group by all), i as (select x.image_id, x.class_id ca, y.class_id cb, count(*) i from x join y using (image_id, pixel) group by all) select i.image_id, ca inst_a, cb inst_b, round(i / (a.n + b.n - i), 6) iou from i join a on a.image_id = i.image_id and a.class_id = ca join b on b.image_id = i.image_id and b.class_id = cb")
def runs_pair_iou(spark, sf):
    """IoU of all overlapping instances of an image, from runs."""
    a, b = (runs.normal(d).withColumnRenamed("class_id", "inst") for d in _run_sides(spark, sf))
    return runs.pair_iou(a, b, ("image_id",)).select("image_id", "inst_a", "inst_b", F.round("iou", 6).alias("iou"))


def _run_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "lineitem").selectExpr("l_orderkey image_id", "l_returnflag class_id", "cast(l_linenumber as bigint) n", "cast(l_quantity as bigint) % 3 + 1 len", "l_suppkey % 2 odd")
    second = rows.withColumn("start", F.explode(F.when(F.col("odd") == 1, F.array("n", F.col("n") + 2)).otherwise(F.array("n"))))
    return rows.select("image_id", "class_id", F.col("n").alias("start"), "len"), second.select("image_id", "class_id", "start", F.lit(1).cast("long").alias("len"))


@query("""with s as (select s_suppkey id, s_suppkey % 17 + 1 x, s_suppkey % 5 + 1 y, s_nationkey % 6 + 1 w, s_nationkey % 4 + 1 h from supplier)
select id, (c * 12 + y)::bigint as start, h::bigint len from s, lateral (select unnest(generate_series(x, x + w - 1)) c) where id % 3 = 0
union all select id, (k * 9 + x)::bigint, y::bigint from s, generate_series(0, 2) t(k) where id % 3 = 1""")
def decoded_runs(spark, sf):
    """Polygons and run-length objects in JSON as runs, by a table function in a LATERAL join; what is no mask has none."""
    runs.register(spark)
    s = read(spark, sf, "supplier").selectExpr("s_suppkey id", "s_suppkey % 17 + 1 x", "s_suppkey % 5 + 1 y", "s_nationkey % 6 + 1 w", "s_nationkey % 4 + 1 h")
    polygon = "format_string('[[%d, %d, %d, %d, %d, %d, %d, %d]]', x, y, x + w, y, x + w, y + h, x, y + h)"
    listed = "concat('{\"size\": [12, 30], \"counts\": [', array_join(array(x, y, 9 - y, y, 9 - y, y), ', '), ']}')"
    s.selectExpr("id", f"case id % 3 when 0 then {polygon} when 1 then {listed} else '{{broken' end segmentation").createOrReplaceTempView("_raw_masks")
    return spark.sql("SELECT a.id, r.start, r.len FROM _raw_masks a, LATERAL mask_runs(a.segmentation, 12, 30) r")


@query("with s as (select s_suppkey id, [-5.0::double, (s_suppkey % 120)::double, 300.0] xs, [(s_suppkey % 7)::double, 20.0, 90.0] ys from supplier where s_suppkey % 4 <> 0), c as (select id, list_transform(xs, lambda v: least(greatest(v, 0), 99.0)) a, list_transform(ys, lambda v: least(greatest(v, 0), 49.0)) b from s) select id, abs(a[1] * b[2] - a[2] * b[1] + a[2] * b[3] - a[3] * b[2] + a[3] * b[1] - a[1] * b[3]) / 2 area, a[1] x1, a[3] x3, b[3] y3 from c")
def polygon_clamp(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.lit(-5.0), (F.col("s_suppkey") % 120).cast("double"), F.lit(300.0)).alias("xs"), F.when(F.col("s_suppkey") % 4 != 0, F.array((F.col("s_suppkey") % 7).cast("double"), F.lit(20.0), F.lit(90.0))).otherwise(F.array(F.lit(1.0))).alias("ys"))
    flat = s.withColumn("flat", geometry.clamped_polygon(F.col("xs"), F.col("ys"), F.lit(100), F.lit(50))).where("flat is not null")
    return flat.select("id", geometry.polygon_area(F.col("flat")).alias("area"), F.element_at("flat", 1).alias("x1"), F.element_at("flat", 5).alias("x3"), F.element_at("flat", 6).alias("y3"))


@query("select c_nationkey, sum((o.k is null)::int)::bigint missing, count(*) wanted from customer left join (select distinct o_custkey k from orders where o_orderstatus = 'F') o on o.k = c_custkey group by 1")
def missing_counts(spark, sf):
    present = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return protocol.missing_counts(read(spark, sf, "customer"), present, ("c_custkey",), "c_nationkey")


@query("with a as (select user_id class_id, count(*) n from events where value > 50 group by 1), b as (select user_id class_id, count(distinct event_type) n from events group by 1) select class_id, max(n) n from (select * from a union all select * from b) group by 1")
def resume_merge(spark, sf):
    e = read(spark, sf, "events")
    user = F.col("user_id").alias("class_id")
    noted, seen = e.where("value > 50").groupBy(user).agg(F.count("*").alias("n")), e.groupBy(user).agg(F.countDistinct("event_type").alias("n"))
    return protocol.merged_resume(noted, seen)


@query("select event_id, user_id from events where user_id not in (select user_id from events where event_type = 'purchase' and user_id is not null)")
def resume_antijoin(spark, sf):
    e = read(spark, sf, "events")
    return protocol.unprocessed(e, e.where("event_type = 'purchase'"), "user_id").select("event_id", "user_id")


@query(f"with {VOTES} select class_id, count(*) vectors, true tp_equal, true fp_equal, 0.0::double max_score_gap, true scores_close, true keep_equal from votes group by 1")
def equivalence_report(spark, sf):
    b = bank_of(patches(spark, sf))
    t = banks.targets(b, banks.target_images(b, 100))
    return banks.equivalence(search.votes(b, t), search.votes_sql(b, t))


@query("with d as (select regexp_replace('docs/' || doc_id || '.txt', '^.*/|[.][^.]*$', '', 'g') stem, 'docs/' || doc_id || '.txt' image_path from documents), m as (select page_id::varchar stem, 'pages/' || page_id || '.png' mask_path from pages) select stem, image_path, mask_path from d full join m using (stem)")
def image_pairing(spark, sf):
    d = read(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    m = read(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    return protocol.paired(d, m)


@query("select event_id, coalesce(value * case when json_extract_string(props, '$.k')::int > 50 then json_extract_string(props, '$.k')::int / 100.0::double end, 0) combined from events")
def score_combine(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf, "events").select("event_id", protocol.combined_score(F.col("value"), F.when(k > 50, k / 100.0)).alias("combined"))


@query("with t as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5])::double threshold) select threshold, count(*) n from t join events on value >= threshold * 100 group by 1")
def threshold_grid(spark, sf):
    grid = spark.createDataFrame([(t,) for t in names.thresholds(0.1, 0.5, 0.1)], "threshold double")
    e = read(spark, sf, "events").select("value")
    return e.select("value", F.explode(F.array(*[F.lit(t) for t in names.thresholds(0.1, 0.5, 0.1)])).alias("threshold")).where(F.col("value") >= F.col("threshold") * 100).groupBy("threshold").agg(F.count("*").alias("n")).join(grid, "threshold")


@query("with g as (select 'a' root, count(*) n from pages where url like 'https%' union all select 'b', count(*) from pages where url not like 'https%') select root, n from g order by n desc, root limit 1")
def majority_root(spark, sf):
    return protocol.majority_root(read(spark, sf, "pages"), F.when(F.col("url").startswith("https"), "a").otherwise("b"))


@query("select doc_id, (row_number() over (order by source, doc_id))::bigint id from documents where doc_id is not null")
def dense_ids(spark, sf):
    d = read(spark, sf, "documents").where("doc_id is not null").select("source", "doc_id")
    return protocol.numbered(d, "source", "doc_id").select("doc_id", F.col("id").cast("long").alias("id"))


@query("select l_orderkey, l_linenumber, l_partkey, coalesce(case when l_partkey % 5 < 3 then l_partkey % 5 + 10 end, 0) mapped from lineitem")
def label_remap(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 5).alias("label"))
    mapping = spark.createDataFrame([(k, k + 10) for k in range(3)], "label long, target long")
    return masks.remapped(rows, mapping).select("l_orderkey", "l_linenumber", "l_partkey", "mapped")


@query("select c_mktsegment class_id, sum((c_acctbal > 0)::int)::bigint positive, count(*) total, sum((c_acctbal > 0)::int) / count(*) share from customer group by 1")
def class_shares(spark, sf):
    g = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("class_id")).agg(F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("positive"), F.count("*").alias("total"))
    return g.withColumn("share", ratio(F.col("positive"), F.col("total")))


@query("select class_id, pixels from (select l_returnflag || l_linestatus class_id, sum(l_quantity) pixels, row_number() over (order by sum(l_quantity) desc) k from lineitem group by 1) where k <= 3")
def top_classes(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("class_id")).agg(F.sum("l_quantity").alias("pixels"))
    return g.orderBy(F.desc("pixels")).limit(3)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return match_hybrid_components(spark, sf)


