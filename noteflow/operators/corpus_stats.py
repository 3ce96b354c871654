"""Song- and measure-level aggregates over notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sums import steady_avg
from ..plans.joins import nearest
from ..plans.timeline import CHUNK_MS


def measure_index(t: Column, first_beat: Column, measure_ms: Column) -> Column:
    """Measure number, truncating toward zero and never negative."""
    return F.greatest(F.lit(0).cast("bigint"), ((t - first_beat) / measure_ms).cast("bigint"))


def trouble_map(notes: DataFrame, tempo: DataFrame, min_confidence: float = 0.25, max_density: float = 6.0) -> DataFrame:
    """Measures of low confidence or high fragmentation.

    ``tempo`` has song_id, first_beat_ms, beat_ms, numerator: one row per song,
    joined before a single aggregation on (song, measure).
    """
    n = notes.join(tempo, "song_id").withColumn("measure_ms", F.col("beat_ms") * F.col("numerator"))
    n = n.withColumn("measure", measure_index(F.col("start_ms"), F.col("first_beat_ms"), F.col("measure_ms")))
    g = n.groupBy("song_id", "measure").agg(
        steady_avg("confidence").alias("avg_confidence"),
        F.count(F.lit(1)).alias("n_notes"),
        F.first("numerator").alias("numerator"),
        (F.first("first_beat_ms") + F.col("measure") * F.first("measure_ms")).alias("start_ms"),
    )
    density = F.col("n_notes") / F.greatest(F.lit(1e-6), F.col("numerator").cast("double"))
    reasons = F.array_compact(F.array(
        F.when(F.col("avg_confidence") < min_confidence, F.lit("low_confidence")),
        F.when(density > max_density, F.lit("fragmented"))))
    return g.withColumn("notes_per_beat", density).withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def pitch_class_weights(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Duration-weighted, L2-normalised pitch-class histogram, long form."""
    g = notes.groupBy(*keys, F.pmod("pitch", F.lit(12)).alias("pc")).agg(
        F.sum(F.greatest(F.lit(1.0), F.col("end_ms") - F.col("start_ms"))).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return g.withColumn("w", F.col("w") / norm)


def repeat_consistency(notes_in_sections: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Mean pairwise cosine of a label's instances, and the instance least like the rest.

    Cosines come from twelve sums per (label, pitch class): for unit vectors
    v_i, the sum over j of v_i.v_j is v_i.S with S their total, so instances are
    never paired with each other.
    """
    keys = ["song_id", "label"]
    h = pitch_class_weights(notes_in_sections.filter("stem <> 'drums'"), [*keys, "instance"])
    total = h.groupBy(*keys, "pc").agg(F.sum("w").alias("s"))
    per = (
        h.join(total, [*keys, "pc"]).groupBy(*keys, "instance")
        .agg((F.sum(F.col("w") * F.col("s")) - F.sum(F.col("w") * F.col("w"))).alias("others"))
    )
    g = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("instances"),
        F.sum("others").alias("pairs2"),
        F.min_by("instance", F.struct(F.round("others", 9), F.col("instance"))).alias("odd_one"),
        F.min("others").alias("odd_sum"),
    ).filter("instances >= 2")
    n = F.col("instances")
    mean = F.col("pairs2") / (n * (n - 1))
    return g.select(
        *keys, "instances", mean.alias("consistency"),
        F.when((n >= 3) & (mean < threshold), F.col("odd_one")).alias("drift_instance"),
        F.when((n >= 3) & (mean < threshold), F.col("odd_sum") / (n - 1)).alias("drift_similarity"))


def phase_deltas(bass: DataFrame, kicks: DataFrame, reach_ms: float = 500.0, chunk_ms: float = CHUNK_MS) -> DataFrame:
    """Signed distance of each bass note to its nearest kick, pairs beyond reach dropped."""
    j = nearest(bass, kicks, ["song_id"], "start_ms", "start_ms", reach_ms, {"kick_ms": F.col("start_ms")}, chunk_ms)
    return j.filter("kick_ms is not null").withColumn("delta_ms", F.col("start_ms") - F.col("kick_ms"))


def groove(deltas: DataFrame) -> DataFrame:
    """Per song: mean, spread and consistency of the deltas, and the pocket they describe."""
    g = deltas.groupBy("song_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("delta_ms").alias("average_ms"),
        F.stddev_pop("delta_ms").alias("std_ms"),
        (1.0 / (1.0 + F.var_pop("delta_ms") / 100.0)).alias("consistency"))
    avg, std, con = F.col("average_ms"), F.col("std_ms"), F.col("consistency")
    return g.withColumn(
        "groove",
        F.when(F.col("n") < 2, "erratic")
        .when(std.between(2.0, 6.0) & (con > 0.5) & (F.abs(avg) < 8), "dilla_pocket")
        .when((F.abs(avg) > 8) & (con > 0.6), "wide_swing")
        .when((F.abs(avg) < 2) & (con > 0.8), "tight_pocket")
        .when(avg > 0, "laid_back").when(avg < 0, "rushed")
        .when(con < 0.3, "erratic").otherwise("fluid"))
