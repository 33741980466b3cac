"""Splits, macro F-beta scoring and output validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import placed


def id_list(raw: Column) -> Column:
    """Distinct ids of a comma-joined text; none of null, blank or placeholder texts."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    empty = raw.isNull() | F.lower(F.trim(raw)).isin("", "nan", "none", "null", "<null>")
    return F.when(empty, F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def rounded(c: Column, digits: int = 6) -> Column:
    """A number of 0 or more, rounded as a double is by SQL engines: its product with 10 ** digits, half up; F.round goes by the decimal text."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def f_beta(true: Column, pred: Column, beta: float = 0.5) -> dict[str, Column]:
    """Counts, precision, recall and F-beta of two id lists; 1, 1, 1 if both are empty, 0, 0, 0 if one is."""
    t, p, hit = F.size(true), F.size(pred), F.size(F.array_intersect(true, pred))
    both, one = (t == 0) & (p == 0), (t == 0) | (p == 0)
    rate = lambda n: F.when(both, 1.0).when(one, 0.0).otherwise(hit / F.greatest(n, F.lit(1)))
    precision, recall = rate(p), rate(t)
    score = F.when(precision * recall == 0, 0.0).otherwise((1 + beta * beta) * precision * recall / (beta * beta * precision + recall))
    return {"true_count": t, "pred_count": p, "correct_count": hit, "precision": precision, "recall": recall, "f_beta": score}


def entity_scores(pred: DataFrame, truth: DataFrame, ids: DataFrame | None = None, beta: float = 0.5) -> DataFrame:
    """One row per entity of truth (or of ids); a missing prediction or truth is an error."""
    wanted = truth.select("source1_entity_id").distinct() if ids is None else ids.select("source1_entity_id").distinct()
    t = truth.groupBy("source1_entity_id").agg(F.max("matched_entity_ids").alias("t"), F.lit(True).alias("has_t"))
    p = pred.groupBy("source1_entity_id").agg(F.max("matched_entity_ids").alias("p"), F.lit(True).alias("has_p"))
    both = wanted.join(t, "source1_entity_id", "left").join(p, "source1_entity_id", "left")
    sure = F.assert_true(F.col("has_t").isNotNull() & F.col("has_p").isNotNull(), F.concat(F.lit("no truth or prediction for "), F.col("source1_entity_id")))
    both = both.filter(sure.isNull()).select("source1_entity_id", id_list(F.col("t")).alias("t"), id_list(F.col("p")).alias("p"))
    return both.select("source1_entity_id", *(c.alias(n) for n, c in f_beta(F.col("t"), F.col("p"), beta).items()))


def macro_scores(scores: DataFrame) -> DataFrame:
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return scores.agg(mean("precision", "macro_precision"), mean("recall", "macro_recall"), mean("f_beta", "macro_f_beta"), F.count("*").alias("evaluated_entities"))


def empty_baseline(truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """Macro scores of a prediction that names no match for any entity."""
    return macro_scores(entity_scores(truth.select("source1_entity_id", F.lit("").alias("matched_entity_ids")), truth, beta=beta))


def match_stratum(truth_ids: Column) -> Column:
    """0, 1 or 2 for no, one or more matches."""
    return F.least(F.size(id_list(truth_ids)), F.lit(2))


def split(s1: DataFrame, truth: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(entity_id, stratum, split): each stratum's first round-half-even(n * fraction) ids by a seeded hash are val."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    t = truth.select(F.col("source1_entity_id").alias("entity_id"), "matched_entity_ids")
    rows = s1.select("entity_id").join(t, "entity_id", "left").select("entity_id", match_stratum(F.col("matched_entity_ids")).alias("stratum"))
    sizes = rows.groupBy("stratum").agg(F.bround(F.count("*") * fraction).cast("bigint").alias("take"))
    draw = F.md5(F.concat_ws("|", "entity_id", F.lit(str(seed))).cast("binary"))
    ranked = placed(rows, "stratum", draw, "entity_id", out="place").join(F.broadcast(sizes), "stratum")
    return ranked.select("entity_id", "stratum", F.when(F.col("place") <= F.col("take"), "val").otherwise("train").alias("split"))


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many keys only one side has: (only_left, only_right)."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").agg(F.count("*").alias("only_left")).crossJoin(right.join(left, key, "left_anti").agg(F.count("*").alias("only_right")))


def subset_violations(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Entities whose matches are not all among their candidates, with the ones that are not."""
    c = candidates.select("source1_entity_id", id_list(F.col("candidate_entity_ids")).alias("c"))
    m = matches.select("source1_entity_id", id_list(F.col("matched_entity_ids")).alias("m"))
    both = m.join(c, "source1_entity_id", "left").withColumn("extra", F.array_except("m", F.coalesce("c", F.array().cast("array<string>"))))
    return both.filter(F.size("extra") > 0).select("source1_entity_id", F.array_join(F.array_sort("extra"), ",").alias("extra"))


def validate(matches: DataFrame, candidates: DataFrame, s1: DataFrame, key: str = "source1_entity_id") -> DataFrame:
    """One row of checks: rows, ids missing or unknown on either output, subset violations, matched and single entities."""
    ids = s1.select(F.col("entity_id").alias(key))
    m = id_differences(ids, matches, key).toDF("missing_matches", "unknown_matches")
    c = id_differences(ids, candidates, key).toDF("missing_candidates", "unknown_candidates")
    v = subset_violations(matches, candidates).agg(F.count("*").alias("violations"))
    size = F.size(id_list(F.col("matched_entity_ids")))
    s = matches.agg(F.count("*").alias("rows"), F.sum(size).cast("bigint").alias("matched_references"), F.count(F.when(size == 0, 1)).alias("singletons"))
    return m.crossJoin(c).crossJoin(v).crossJoin(s)
