"""Print per-stage wall time and task counts from a Spark event log folder.

usage: python tools/stage_times.py <eventlog dir>
"""
import glob
import io
import json
import sys

import zstandard


def events(folder):
    for fn in sorted(glob.glob(f"{folder}/**/events_*", recursive=True)):
        raw = open(fn, "rb").read()
        if fn.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode().splitlines():
            if line.strip():
                yield json.loads(line)


def main():
    for e in events(sys.argv[1]):
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            dt = si["Completion Time"] - si["Submission Time"]
            tasks = si["Number of Tasks"]
            print(f"stage {si['Stage ID']:4d} tasks {tasks:4d} {dt:6d} ms  {si['Stage Name'][:40]}")


if __name__ == "__main__":
    main()
