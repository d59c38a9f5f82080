"""Benchmark: headline queries, mask overhead and governance timings.

Prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES, TABLE, _database  # noqa: E402
from checks.views import pii_view  # noqa: E402
from maskwright import vocab as V  # noqa: E402
from maskwright.plans.scan import scan_table  # noqa: E402
from maskwright.plans.secure import secure_read  # noqa: E402
from maskwright.session import tune  # noqa: E402
from maskwright.sources.store import MetadataStore  # noqa: E402
from maskwright.sources.tables import write_table  # noqa: E402

HEADLINE = (
    "a6_insert_if_absent", "a8_upsert", "b1_bounded_sample", "b3_column_sample_lists", "c3_email_tokens",
    "c6_tag_scores", "c12_decode_response", "c13_arbitrate", "c16_scan_table", "c16_scan_table_exact",
    "c17_scan_all", "d1_resolve_policies", "d3_hash_mask_text", "d6_partial_mask_text", "d6_partial_mask_pii",
    "d10_mask_frame", "d11_secure_frame_auditor", "d11_secure_frame_analyst", "d13_access_audit",
    "e4_compliance_by_column", "e7_overhead_pct", "f1_gen_values", "f4_gen_table",
)
CYCLES = 5


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def trimmed(runs: list[float]) -> float:
    kept = sorted(runs)[:-1] or runs
    return sum(kept) / len(kept)


def governance(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """The thresholds of the baseline, measured on the derived table."""
    database = _database(spark) + "_bench"
    write_table(pii_view(spark, sf_dir), f"{database}.{TABLE}")
    store = MetadataStore(spark, database + "_meta").create()
    results = {
        "scan_table_exact_sec": timed(lambda: scan_table(store, TABLE, database, sample_size=None)),
        "scan_table_sample_sec": timed(lambda: scan_table(store, TABLE, database)),
    }
    plain = spark.table(f"{database}.{TABLE}")
    secure = {role: secure_read(store, role, TABLE, None, database) for role in V.ROLES}
    for kind, action in {"show10": lambda df: df._jdf.showString(10, 20, False), "full": drain}.items():
        action(plain)
        normal = trimmed([timed(lambda: action(plain)) for _ in range(CYCLES)])
        for role, df in secure.items():
            action(df)
            masked = trimmed([timed(lambda df=df: action(df)) for _ in range(CYCLES)])
            results[f"overhead_pct_{kind}_{role.lower()}"] = (masked - normal) / normal * 100
        results[f"plain_{kind}_sec"] = normal

    def lookup(role, of):
        return of.policies_of(role, TABLE)

    # a store object that knows nothing yet for each lookup, and one that was asked before
    new = [timed(lambda: lookup(role, MetadataStore(spark, database + "_meta"))) for _ in range(CYCLES) for role in V.ROLES]
    again = [timed(lambda: lookup(role, store)) for _ in range(CYCLES) for role in V.ROLES]
    results["policy_lookup_ms"] = sum(new) / len(new) * 1000
    results["policy_lookup_again_ms"] = sum(again) / len(again) * 1000

    def update(level):
        store.update_level(TABLE, "is_active", level)
        secure_read(store, "ANALYST", TABLE, ["is_active"], database).take(1)

    update("LOW")
    results["update_visible_sec"] = min(timed(lambda: update(level)) for level in ("HIGH", "NONE", "HIGH"))
    return {k: round(v, 3) for k, v in results.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("maskwright-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    times = {}
    for name in HEADLINE:
        runs = [timed(lambda: drain(QUERIES[name](spark, sf_dir))) for _ in range(2)]
        times[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries, planning included, best of two",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "governance": governance(spark, sf_dir),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
