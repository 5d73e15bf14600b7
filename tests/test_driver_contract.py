"""The contract as the driver uses it: a plain session in another process and
working directory, the entry module loaded by path."""

import os
import subprocess
import sys

SCRIPT = r'''
import importlib.util, json
spec = importlib.util.spec_from_file_location("se", sys_argv_entry)
se = importlib.util.module_from_spec(spec); spec.loader.exec_module(se)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
out = {"entry": se.entry(spark).count()}
for n in ["dft_prime_length", "band_power_blocks", "final_result_sql"]:
    out[n] = se.queries()[n](spark, "/root/testdata/sf0.001").count()
from spindle.plans import queries as q
out["same_keys"] = sorted(q.QUERIES) == sorted(q.SQL) and set(q.QUERIES) <= set(se.queries())
print("RESULT " + json.dumps(out))
'''


def test_contract_in_fresh_process(tmp_path):
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    script = tmp_path / "run.py"
    script.write_text(f"sys_argv_entry = {entry!r}\n" + SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    p = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True, text=True,
                       timeout=600)
    line = [x for x in p.stdout.splitlines() if x.startswith("RESULT ")]
    assert line, p.stderr[-3000:]
    import json
    got = json.loads(line[0][7:])
    assert got["entry"] > 0 and got["dft_prime_length"] > 0 and got["band_power_blocks"] > 0
    assert got["final_result_sql"] == got["entry"] and got["same_keys"]
