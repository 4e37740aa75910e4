"""Per-query and per-stage times from a Spark event log (no web UI).

    BENCH_EVENT_LOG_DIR=$(mktemp -d) python bench.py
    python tools/stage_times.py <that dir> [top_n]

Jobs are grouped by the job group the bench sets (the query name); for each
query the slowest stages are listed with task count and summed task time.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
from collections import defaultdict


def event_lines(path: str):
    """Lines of one event file; Spark 4 compresses them with zstd by default."""
    with open(path, "rb") as f:
        if path.endswith(".zstd"):
            import zstandard

            stream = zstandard.ZstdDecompressor().stream_reader(f)
            yield from io.TextIOWrapper(stream, encoding="utf-8")
        else:
            yield from io.TextIOWrapper(f, encoding="utf-8")


def main(log_dir: str, top: int = 3) -> None:
    entries = sorted(glob.glob(os.path.join(log_dir, "*")), key=os.path.getmtime)
    if not entries:
        raise SystemExit(f"no event log in {log_dir}")
    newest = entries[-1]
    # Spark 4 writes a folder of rolling event files per application
    parts = sorted(glob.glob(os.path.join(newest, "events_*"))) if os.path.isdir(newest) else [newest]
    stage_group: dict[int, str] = {}
    stages = []
    for part in parts:
        for line in event_lines(part):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id", "-")
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = group
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                if "Completion Time" not in info or "Submission Time" not in info:
                    continue
                task_ms = 0
                for acc in info.get("Accumulables", []):
                    if acc.get("Name") == "internal.metrics.executorRunTime":
                        task_ms = int(acc.get("Value", 0))
                stages.append((info["Stage ID"], info["Stage Name"].split(" at ")[0], info["Number of Tasks"],
                               info["Completion Time"] - info["Submission Time"], task_ms))
    by_group = defaultdict(list)
    for sid, name, n, wall, task in stages:
        by_group[stage_group.get(sid, "-")].append((wall, sid, name, n, task))
    for group, rows in sorted(by_group.items(), key=lambda kv: -sum(r[0] for r in kv[1])):
        total = sum(r[0] for r in rows)
        print(f"{group:34s} stages {len(rows):3d}  stage wall {total / 1000:7.2f}s")
        for wall, sid, name, n, task in sorted(rows, reverse=True)[:top]:
            print(f"    stage {sid:4d} {name:24s} tasks {n:4d} wall {wall / 1000:6.2f}s task-sum {task / 1000:6.2f}s")


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 3)
