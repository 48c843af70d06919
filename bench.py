"""Benchmark: headline jobs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is executed in full into Spark's ``noop`` sink (no driver collect):
one warm-up, then the median of ``$BENCH_RUNS`` (default 3) runs. Models that
queries share (language ID, BPE) are dropped before every run, so their
training is part of the timing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["clean_mono", "clean_report_mono", "clean_pairs", "clean_report_pairs",
            "lid_predict", "clean_mono_lid", "word_counts", "encode_chars",
            "corpus_bleu", "train_val_split", "clean_pairs_lid", "corpus_bleu_lines",
            "dedup_exact", "bpe_merges"]
#: Long jobs: timed once, without a warm-up.
ONCE = {"bpe_merges"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    from corpusflow.session import get_spark
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    from corpusflow.plans import catalog

    def clear():
        catalog._LID_MODEL.clear()
        catalog._BPE_MODELS.clear()
        spark.catalog.clearCache()

    times, failed = {}, {}
    for name in names:
        fn = catalog.QUERIES[name]
        samples = []
        try:
            for i in range(1 if name in ONCE else runs + 1):
                clear()
                t0 = time.perf_counter()
                fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                if i > 0 or name in ONCE:
                    samples.append(dt)
            times[name] = round(statistics.median(samples), 3)
        except Exception as e:  # noqa: BLE001 - record and keep benchmarking the rest
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_jobs_total_median", "value": round(sum(times.values()), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
