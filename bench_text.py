"""Throughput of the text operators over much text with the whole lexicon: MiB a second and core, on 1 and 4 cores.

The documents of $BENCH_SF_DIR are repeated until $BENCH_MIB (default 1024) is reached. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def measure(cores: int, mib: int, sf_dir: str) -> dict[str, float]:
    from pyspark.sql import functions as F

    from panelwright.operators import evidence as E
    from panelwright.operators import text as W
    from panelwright.operators.lexicon import DEFAULT_TERMS
    from panelwright.session import cut, local_session

    spark = local_session(cores, "bench-text", os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] / 2**20
    times = max(1, round(mib / size))
    many = cut(docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).repartition(4 * cores), "documents")
    jobs = {"keyword_windows": lambda d: W.keyword_windows(d, ["doc_id", "copy"], "text", DEFAULT_TERMS), "evidence_snippets": lambda d: E.snippets(d, ["doc_id", "copy"], "text", DEFAULT_TERMS, 1200, 1)}
    out = {}
    for name, job in jobs.items():
        job(docs.limit(200).withColumn("copy", F.lit(1))).write.format("noop").mode("overwrite").save()  # starts the workers
        began = time.time()
        job(many).write.format("noop").mode("overwrite").save()
        out[name] = round(size * times / (time.time() - began), 2)
    spark.stop()
    return out


def main() -> None:
    sf_dir, mib = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_MIB", "1024"))
    if len(sys.argv) > 1:
        print(json.dumps(measure(int(sys.argv[1]), mib, sf_dir)))
        return
    found = {}
    for cores in (1, 4):  # a session of its own each
        done = subprocess.run([sys.executable, __file__, str(cores)], capture_output=True, text=True, check=True, env=os.environ | {"BENCH_MIB": str(mib if cores > 1 else max(64, mib // 4))})
        found[cores] = json.loads(done.stdout.strip().splitlines()[-1])
    result = {name: {"mib_a_second": {c: found[c][name] for c in found}, "mib_a_second_and_core": round(found[4][name] / 4, 2), "scaling": round(found[4][name] / found[1][name], 2)} for name in found[1]}
    print(json.dumps({"metric": "text_throughput", "unit": "MiB/s", "mib": mib, "operators": result}))


if __name__ == "__main__":
    main()
