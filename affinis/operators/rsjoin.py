"""Similarity join of two datasets by one-level hashing; the left one may be a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.families import hash_at
from affinis.functions.measures import different_bits, dot, jaccard
from affinis.operators.selfjoin import bucket_side, first_only, items, make_hasher, near_sizes, usable
from affinis.plans.params import COSINE, sketch_threshold


def similarity_join(
    left: DataFrame, right: DataFrame, id_col: str, value_col: str, threshold: float, k: int = 8, recall: float = 0.8, seed: int = 14598,
    sketch_bits: int = 0, sketch_epsilon: float = 0.01,
) -> DataFrame:
    """Pairs (id_l, id_r, similarity) of a row of left and a row of right. right must be a batch; each pair is found once.

    Values travel with the hashes, so that a stream needs no second join; with a large left batch prefer slim rows and sketches. Rows are usable as in the self-join; repeated ids of left each find their pairs.
    """
    other, measure, dim = items(right, id_col, value_col)
    rows, _ = usable(left, id_col, value_col)
    rows = rows.where(F.size("v") == dim) if measure == COSINE else rows.where("v IS NOT NULL")
    hasher = make_hasher(measure, dim, threshold, k, None, recall, seed, sketch_bits)
    scheme = hasher.scheme
    limit = sketch_threshold(measure, sketch_bits, threshold, sketch_epsilon)

    keys, pools = ["rep", "hash"], {"": scheme}

    def side(df: DataFrame, s: str) -> DataFrame:
        out = hasher.add(df, keep_value=True).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(scheme.repetitions - 1))))
        out = out.withColumn("hash", hash_at(F.col("left"), F.col("right"), "rep", scheme))
        return bucket_side(out, [*keys, F.col("v").alias(f"v_{s}")], pools, s)

    c = F.col
    met = side(rows, "l").join(side(other, "r"), keys)
    if sketch_bits:
        met = met.where(different_bits(c("sketch_l"), c("sketch_r"), sketch_bits // 64) <= limit)
    met = met.where(near_sizes(hasher, threshold) & first_only(pools))
    sim = dot(c("v_l"), c("v_r")) if measure == COSINE else jaccard(c("v_l"), c("v_r"))
    return met.select("id_l", "id_r", sim.alias("similarity")).where(c("similarity") >= threshold - 1e-12)
