"""Summarise a Spark event log: job and slow stage durations."""

import glob
import json
import os
import sys


def main(d):
    f = sorted((p for p in glob.glob(os.path.join(d, "**", "*"), recursive=True) if os.path.isfile(p) and "appstatus" not in p), key=os.path.getmtime)[-1]
    jobs, stages = {}, {}
    for line in open(f):
        e = json.loads(line)
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, len(e["Stage IDs"])]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Completion Time"] - si["Submission Time"], si["Number of Tasks"],
                                      si["Stage Name"][:60])
    t0 = min(v[0] for v in jobs.values())
    for j, (s, c, n) in sorted(jobs.items()):
        print(f"job {j:3d} start {s - t0:6d}ms dur {(c or s) - s:6d}ms stages {n}")
    for s, (d, n, name) in sorted(stages.items()):
        if d > 200:
            print(f"  stage {s} {d}ms tasks={n} {name}")


if __name__ == "__main__":
    main(sys.argv[1])
