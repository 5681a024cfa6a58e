"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contract import QUERIES  # noqa: E402
from tuturan.session import local_session  # noqa: E402

HEADLINE = [
    "prepare_tagged_corpus",
    "prepare_corpus",
    "flt10_attrition",
    "txt17_preprocess_asr",
    "txt12_normalize_numbers",
    "txt27_detect_repetition",
    "score_benchmark",
    "agg7_edit_breakdown",
    "agg11_char_frequency",
    "agg12_word_frequency",
    "agg13_vocabulary_coverage",
    "join2_word_durations",
    "join9_to_phonemes",
    "win1_stratified_split",
    "win4_last_points",
    "win6_first_per_text",
    "srt2_seeded_sample",
    "prj4_sequential_names",
    "gen1_mixed_sentences",
    "str1_resume_build",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
