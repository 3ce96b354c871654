"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "flagship_trouble_after_consolidation", "w01_consolidation", "j01_pivot_latest", "j03_a17_groove_class", "j04_two_witness_onset",
    "j07_note_frame_mean", "a05_key_detection", "a07_tempo_referee", "w02_anchored_groups", "w25_tempo_map", "q01_duration_hypotheses",
    "q05_beat_rhythm", "w09_scale_runs", "w28_max_simultaneity", "w32_playability_summary", "a39_pairwise_voice_scores", "r13_autocorrelation",
    "v01_voice_lines", "v02_melodic_threads", "v03_w37_staff_voices", "w39_tempo_segments", "j18_claim_once_match", "w21_frame_activity", "v08_x04_sequence_agreement", "r04_lattice_search", "j09_stem_attribution",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from noteflow.catalog import registry
    from noteflow.session import get_spark

    spark = get_spark(f"local[{cpus}]", "noteflow-bench", partitions=cpus)
    registry.load()
    # classes loaded and code compiled before the clock starts, on the smallest tables
    small = str(Path(sf_dir).parent / "sf0.001")
    for name in ("p01_confidence_tier", HEADLINE[0], "v02_melodic_threads"):
        registry.QUERIES[name](spark, small if Path(small).exists() else sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1].strip("/")}))
    spark.stop()


if __name__ == "__main__":
    main()
