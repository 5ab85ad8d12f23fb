"""Time the catalog queries on local cores and print one JSON line.

BENCH_SF_DIR: input folder; BENCH_CPUS: cores; BENCH_QUERIES: comma-separated names, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ablatrix.plans import catalog, views  # noqa: E402
from ablatrix.session import local_session  # noqa: E402

HEADLINE = [
    "rev_sentences", "rev_words", "scramble_letters", "mask_content", "tr_deductive", "tr_temporal", "tr_spatial",
    "transform_dispatch", "jsonl_corrupt", "chat_render", "sentence_split", "chunk_fixed", "pack_drop",
    "pack_greedy", "decode_ids", "segment_sample", "offsets", "integrity", "merge_by_type", "split_80_20",
    "pad_batch", "worker_assign", "batch_groups", "grad_times_weight", "grad_sum", "topk_global", "topk_chunked",
    "topk_k_sweep", "layer_stats", "dense_mask", "apply_mask", "damage_variants", "result_coverage", "change_matrix",
]
# Tables many queries share are built, and timed, first.
STAGED = ["vocab", "encoded", "segments", "packed_table", "packed_by_source", "tensor_blocks", "attribution_blocks"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.CATALOG) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    views.documents(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    for name in STAGED:
        begin = time.perf_counter()
        getattr(views, name)(spark, sf_dir)
        times[f"stage_{name}"] = round(time.perf_counter() - begin, 3)
    for name in names:
        begin = time.perf_counter()
        catalog.CATALOG[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    line = {
        "metric": "catalog_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
