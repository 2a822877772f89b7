"""Bayesian fusion of claimed values with copy detection (problem 7, the method named there).

Sources claim values for fields of objects. A source's accuracy is the mean posterior of what it claims; a value's score is the
sum of its sources' log odds; two sources that share more false values than chance explains are taken as dependent, and of
sources that claim one value the less accurate count only with the probability that they did not copy. The three estimates are
repeated until no accuracy of a source that speaks often moves by more than a tolerance, at most a number of rounds.

Only sources with claims on several objects are compared for copying: of a source that speaks once nothing can be told. So
pairs are made among the few sources of an object that speak often, never among all its records.

The rules of this project fix the surviving record otherwise (see survivors.py), so the result is offered beside them, as the
value and its posterior.

Defined cases: null values are no claims; of several claims of one source for one field the greatest value of `claim_order`
counts, then the greater value; a field with one value keeps it; ties of posteriors go to the smaller value; no claims give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaloom.operators.skew import salted_lookup
from sagaloom.session import cut

OBJECT = ["object_id", "field_name"]


def _dependence(claims: DataFrame, truth: DataFrame | None, accuracy: DataFrame, wrong: int, copy: float, prior: float) -> DataFrame:
    """s, t, dep: probability that two sources depend on each other, from values they share and differ in.

    Before any truth is estimated only agreement counts; a truth voted for by copies would make honest agreement look like
    shared mistakes. Pairs are of the sources given, within one field of one object, where each has one claim.
    """
    c = claims.withColumn("best", F.lit(None).cast("string")) if truth is None else claims.join(truth.select(*OBJECT, F.col("value").alias("best")), OBJECT)
    x, y = c.select(*OBJECT, F.col("source").alias("s"), F.col("value").alias("vs"), "best"), c.select(*OBJECT, F.col("source").alias("t"), F.col("value").alias("vt"))
    same, good = F.col("vs") == F.col("vt"), F.coalesce(F.col("vs") == F.col("best"), F.lit(False))
    counts = [F.count(F.when(k, 1)).alias(n) for k, n in ((same & good, "kt"), (same & ~good, "kf"), (~same, "kd"))]
    n = x.join(y, OBJECT).where("s < t").groupBy("s", "t").agg(*counts)
    a = n.join(accuracy.toDF("s", "a_s"), "s").join(accuracy.toDF("t", "a_t"), "t")
    pt, pf, least = F.col("a_s") * F.col("a_t"), (1 - F.col("a_s")) * (1 - F.col("a_t")) / wrong, F.least("a_s", "a_t")
    if truth is None:
        shared = F.col("kf") * F.log((copy + (pt + pf) * (1 - copy)) / (pt + pf))
    else:
        shared = F.col("kt") * F.log((least * copy + pt * (1 - copy)) / pt) + F.col("kf") * F.log(((1 - least) * copy + pf * (1 - copy)) / pf)
    odds = shared + F.col("kd") * F.log(F.lit(1 - copy)) + F.log(F.lit(prior / (1 - prior)))
    return a.select("s", "t", (1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))).alias("dep"))


def _posteriors(weight: DataFrame, accuracy: DataFrame, wrong: int) -> DataFrame:
    """object_id, field_name, value, posterior under the sources' accuracies and their freedom from copying."""
    w = salted_lookup(weight, accuracy, ["source"], "object_id")
    score = w.groupBy(*OBJECT, "value").agg(F.least(F.sum(F.col("free") * F.log(wrong * F.col("accuracy") / (1 - F.col("accuracy")))), F.lit(60.0)).alias("score"))
    total = score.groupBy(*OBJECT).agg(F.sum(F.exp("score")).alias("total"), F.count(F.lit(1)).alias("n"))
    post = score.join(total, OBJECT).withColumn("posterior", F.exp("score") / (F.col("total") + F.greatest(F.lit(0), wrong + 1 - F.col("n"))))
    return cut(post.select(*OBJECT, "value", "posterior"))


def _truth(post: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("posterior")).alias("p"), "value")).alias("b")
    return post.groupBy(*OBJECT).agg(best).select(*OBJECT, F.col("b.value").alias("value"), (-F.col("b.p")).alias("posterior"))


def fuse_values(claims: DataFrame, rounds: int = 5, tolerance: float = 0.002, least_objects: int = 5, wrong: int = 10, copy: float = 0.8, prior: float = 0.1) -> DataFrame:
    """object_id, field_name, value, posterior from claims (object_id, field_name, source, value, claim_order).

    In each round dependence is judged before accuracies are, so that copies do not first raise their own accuracy.
    """
    one = claims.where("value is not null and source is not null").groupBy(*OBJECT, "source").agg(F.max(F.struct("claim_order", "value"))["value"].alias("value"))
    one = cut(one)
    often = one.groupBy("source").agg(F.countDistinct("object_id").alias("n")).where(F.col("n") >= least_objects).select("source")
    often = cut(often)
    many = cut(one.join(often, "source", "left_semi"))
    accuracy = one.groupBy("source").agg(F.lit(0.8).alias("accuracy"))
    post = None
    for _ in range(rounds):
        dep = cut(_dependence(many, post if post is None else _truth(post), accuracy, wrong, copy, prior))
        both = dep.union(dep.select("t", "s", "dep")).toDF("source", "other", "dep").join(accuracy, "source").join(accuracy.toDF("other", "acc_other"), "other")
        ahead = both.where("acc_other > accuracy or (acc_other = accuracy and other < source)").select("source", "other", "dep")
        met = many.join(many.withColumnRenamed("source", "other"), [*OBJECT, "value"]).join(ahead, ["source", "other"])
        bound = met.groupBy(*OBJECT, "source").agg(F.exp(F.sum(F.log(1 - copy * F.col("dep")))).alias("free"))
        weight = cut(one.join(bound, [*OBJECT, "source"], "left").withColumn("free", F.coalesce("free", F.lit(1.0))))
        post = _posteriors(weight, accuracy, wrong)
        mean = one.join(post, [*OBJECT, "value"]).groupBy("source").agg(F.avg("posterior").alias("m"))
        new = cut(mean.select("source", F.least(F.greatest("m", F.lit(0.05)), F.lit(0.95)).alias("accuracy")))
        moved = new.join(often, "source", "left_semi").join(accuracy.toDF("source", "before"), "source").agg(F.max(F.abs(F.col("accuracy") - F.col("before")))).first()[0]
        accuracy = new
        if moved is None or moved <= tolerance:
            break
    return _truth(post)
