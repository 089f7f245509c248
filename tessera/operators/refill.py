"""Filling classes to a number of supports with exact, periodic refiltering.

A class's candidates are looked at in order. A candidate with a vector that passes the gate is accepted: its passing vectors join
the class's scored bank. After `every` accepted candidates, or as soon as they could reach the target, the class is refiltered:
bank and accepted vectors together give a new quartile, a new threshold, a new overlay, and the number of supports that are left,
which may have fallen. Supports count by the overlay, so acceptance goes on until the overlay reaches the target.

Classes are independent, so a round does the next step of all open classes in one plan: it scores candidates of those that need
some (a candidate's score depends on the class's targets alone, so candidates scored but not yet looked at are kept for the next
round), finds each class's next refilter point, and recomputes the touched classes only. Each round is one version of the tables
(sources.versions): a run that dies goes on from the last one and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.versions import Versions
from . import bank as banks
from . import search
from .running import ranked

#: States of a class, and the version of the acceptance rule: a run under another rule begins anew.
PENDING, PREPARING, RUNNING, DONE, EXHAUSTED, SHORT = "pending", "preparing_targets", "running", "done", "exhausted", "insufficient_targets"
RULE = 2
VECTORS = ("class_id", "image_id", "file_key", "patch_no", "vec_id", "tp", "fp", "score")


@dataclass(frozen=True)
class Policy:
    target: int = 20
    every: int = 5
    gate: float = 0.6
    min_matches: int = 3
    top_k: int | None = 10_000
    low: float = 0.65
    high: float = 0.82
    factor: float = 0.90
    least_targets: int = 2
    #: Candidates of a class that are scored at once.
    block: int = 20


def against(vectors: DataFrame, targets: DataFrame, sim_floor: float = 0.0, min_matches: int = 3) -> Callable[[DataFrame], DataFrame]:
    """A scorer: the votes of the asked candidates' vectors in their class's target images. vectors: VECTORS without tp, fp and
    score, with embedding; targets: (class_id, image_id, patch_no, inside, embedding)."""

    def score(asked: DataFrame) -> DataFrame:
        own = vectors.join(asked.select("class_id", "image_id"), ["class_id", "image_id"], "left_semi")
        votes = search.votes(own, targets.join(asked.select("class_id").distinct(), "class_id", "left_semi"), sim_floor)
        out = own.join(votes, ["vec_id", "class_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tp", "fp")})
        total = F.col("tp") + F.col("fp")
        return out.withColumn("score", F.when(total >= min_matches, F.col("tp") / total)).select(*VECTORS)

    return score


def refiltered(bank: DataFrame, policy: Policy) -> DataFrame:
    """bank (scored) after the adaptive quartile rule and the cut to the best top_k of a class, with column threshold."""
    return banks.adaptive(bank, policy.low, policy.high, policy.factor, policy.top_k)


class Refill:
    """A run in the folder root. base: scored vectors (VECTORS) of the present supports; available: (class_id, n) supports that
    the present filter leaves; candidates: (class_id, image_id); targets: (class_id, n) target images of a class. score: a
    function from (class_id, image_id) to their scored vectors (VECTORS)."""

    def __init__(self, root: str, base: DataFrame, available: DataFrame, candidates: DataFrame, targets: DataFrame, score: Callable[[DataFrame], DataFrame], policy: Policy = Policy()) -> None:
        self.base, self.score, self.policy = base.select(*VECTORS), score, policy
        self.available, self.candidates, self.targets = available, candidates, targets
        self.versions = Versions(base.sparkSession, root)

    # an entry: rule, round, and names of data: state, candidates (one each), looked, vectors, overlays (one per round)
    def _begin(self) -> dict:
        """Version of round 0: candidates in order, and the classes that are to be filled."""
        p, v = self.policy, self.versions
        order = v.write(ranked(self.candidates.select("class_id", "image_id").distinct(), ("class_id",), (("image_id", False),), "k"))
        total = v.read(order).groupBy("class_id").agg(F.max("k").alias("total"))
        now = self.available.select("class_id", F.col("n").cast("long").alias("n")).join(total, "class_id", "left").join(self.targets.select("class_id", F.col("n").alias("_t")), "class_id", "left").fillna(0, ["total", "_t"])
        word = F.when(F.col("n") >= p.target, DONE).when(F.col("_t") < p.least_targets, SHORT).otherwise(PREPARING)
        zero = F.lit(0).cast("long")
        state = now.select("class_id", word.alias("state"), "n", "total", zero.alias("scored"), zero.alias("looked"), zero.alias("waiting"), zero.alias("accepted"), F.lit(None).cast("double").alias("threshold"), zero.alias("refilters"), zero.alias("refiltered"))
        return {"rule": RULE, "round": 0, "state": v.write(state), "candidates": order, "looked": [], "vectors": [], "overlays": []}

    def _step(self, entry: dict) -> dict | None:
        """The next round's entry, or None if no class is open. Its data are written, the entry is not."""
        p, v = self.policy, self.versions
        state, order = v.read(entry["state"]), v.read(entry["candidates"])
        open_ = state.where(F.col("state").isin(PREPARING, RUNNING))
        if open_.isEmpty():
            return None
        entry = entry | {"round": entry["round"] + 1}
        # Score a block of those that have nothing scored left to look at.
        hungry = open_.where((F.col("scored") == F.col("looked")) & (F.col("scored") < F.col("total"))).select("class_id", "scored")
        asked = order.join(hungry, "class_id").where((F.col("k") > F.col("scored")) & (F.col("k") <= F.col("scored") + p.block)).select("class_id", "image_id", "k")
        if not hungry.isEmpty():
            kept = v.write(asked)
            vectors = v.write(self.score(v.read(kept)))
            own = banks.candidate_metrics(v.read(vectors), p.gate, p.min_matches).select("class_id", "image_id", "accepted", "n_passing")
            judged = v.read(kept).join(own, ["class_id", "image_id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
            entry = entry | {"looked": [*entry["looked"], v.write(judged)], "vectors": [*entry["vectors"], vectors]}
        judged = v.read(*entry["looked"]) if entry["looked"] else asked.withColumns({"accepted": F.lit(False), "n_passing": F.lit(0)})
        upto = judged.groupBy("class_id").agg(F.max("k").alias("_s"))
        # The refilter point: the accepted candidate that makes `every`, or what the target lacks.
        need = F.greatest(F.lit(1), F.least(F.lit(p.every), F.lit(p.target) - F.col("n"))) - F.col("waiting")
        ahead = judged.where("accepted").join(open_.select("class_id", "looked", need.alias("_need")), "class_id").where("k > looked")
        place = F.row_number().over(Window.partitionBy("class_id").orderBy("k"))  # at most a block of scored ones lies ahead
        point = ahead.withColumn("_j", place).groupBy("class_id").agg(F.min(F.when(F.col("_j") == F.col("_need"), F.col("k"))).alias("_point"))
        new = open_.join(upto, "class_id", "left").join(point, "class_id", "left").withColumn("_scored", F.coalesce("_s", "scored")).withColumn("_looked", F.coalesce("_point", "_scored"))
        taken = judged.where("accepted").join(new.select("class_id", "looked", "_looked"), "class_id").where("k > looked and k <= _looked").groupBy("class_id").agg(F.count("*").alias("_more"))
        new = new.join(taken, "class_id", "left").withColumn("_more", F.coalesce("_more", F.lit(0)))
        waiting, ended = F.col("waiting") + F.col("_more"), F.col("_looked") >= F.col("total")
        moved = v.write(new.select("class_id", "n", "total", F.col("_scored").alias("scored"), F.col("_looked").alias("looked"), waiting.alias("waiting"), (F.col("accepted") + F.col("_more")).alias("accepted"), "threshold", "refilters", "refiltered", (F.col("_point").isNotNull() | (ended & (waiting > 0))).alias("_refilter")))
        touched = v.read(moved).where("_refilter").select("class_id", "looked")
        if not touched.isEmpty():
            passed = judged.where("accepted").join(touched, "class_id").where("k <= looked").select("class_id", "image_id")
            good = v.read(*entry["vectors"]).join(passed, ["class_id", "image_id"], "left_semi").where(F.col("score") >= p.gate)
            layers = banks.overlay_first(self.base.join(touched, "class_id", "left_semi"), good.select(*VECTORS))
            overlay = v.write(refiltered(layers, p).withColumn("round", F.lit(entry["round"])))
            entry = entry | {"overlays": [*entry["overlays"], overlay]}
            left = v.read(overlay).groupBy("class_id").agg(F.countDistinct("image_id").alias("_left"), F.max("threshold").alias("_threshold"))
            now = v.read(moved).join(left, "class_id", "left").withColumns({
                "n": F.when(F.col("_refilter"), F.coalesce("_left", F.lit(0))).otherwise(F.col("n")),
                "threshold": F.when(F.col("_refilter"), F.col("_threshold")).otherwise(F.col("threshold")),
                "waiting": F.when(F.col("_refilter"), F.lit(0)).otherwise(F.col("waiting")),
                "refilters": F.col("refilters") + F.col("_refilter").cast("long"),
                "refiltered": F.when(F.col("_refilter"), F.lit(entry["round"])).otherwise(F.col("refiltered")),
            })
        else:
            now = v.read(moved)
        word = F.when(F.col("n") >= p.target, DONE).when(F.col("looked") >= F.col("total"), EXHAUSTED).otherwise(RUNNING)
        closed = state.join(open_.select("class_id"), "class_id", "left_anti")
        return entry | {"state": v.write(now.withColumn("state", word).select(*state.columns).unionByName(closed))}

    def run(self, rounds: int | None = None) -> dict:
        """Goes on from the newest version, for at most so many rounds; gives the last entry."""
        number, entry = self.versions.latest()
        if entry.get("rule") != RULE:
            number, entry = number + 1, self._begin()
            self.versions.commit(number, entry)
        while rounds is None or rounds > 0:
            after = self._step(entry)
            if after is None:
                break
            number, entry = number + 1, after
            self.versions.commit(number, entry)
            rounds = rounds if rounds is None else rounds - 1
        return entry

    def state(self, entry: dict) -> DataFrame:
        """(class_id, state, n, total, scored, looked, waiting, accepted, threshold, refilters, refiltered): n supports are left of
        the filtered bank, `scored` and `looked` candidates of `total` are behind; refiltered is the round of the last refilter."""
        return self.versions.read(entry["state"])

    def accepted(self, entry: dict) -> DataFrame:
        """(class_id, image_id, k, n_passing) of the accepted candidates that were looked at."""
        if not entry["looked"]:
            return self.versions.read(entry["candidates"]).where("false").withColumn("n_passing", F.lit(0).cast("long"))
        upto = self.state(entry).select("class_id", F.col("looked").alias("_to"))
        return self.versions.read(*entry["looked"]).where("accepted").join(upto, "class_id").where("k <= _to").select("class_id", "image_id", "k", "n_passing")

    def overlay(self, entry: dict) -> DataFrame:
        """The newest overlay of each refiltered class."""
        if not entry["overlays"]:
            return self.base.where("false").withColumn("threshold", F.lit(0.0)).select("class_id", *[c for c in VECTORS if c != "class_id"], "threshold")
        newest = self.state(entry).select("class_id", F.col("refiltered").alias("round"))
        return self.versions.read(*entry["overlays"]).join(newest, ["class_id", "round"]).drop("round")

    def floors(self, entry: dict, filtered: DataFrame, thresholds: DataFrame, default: float = 0.65) -> DataFrame:
        """(class_id, floor): least kept score of the overlay, else of the filtered bank, else the reported threshold."""
        return banks.class_floor(self.overlay(entry), filtered, self.available.select("class_id"), thresholds, default)
