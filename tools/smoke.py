"""Run the named queries at a scale and print rows and seconds: smoke.py [sf] [name ...]."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sensorloom.plans import catalog  # noqa: E402
from sensorloom.session import local_session  # noqa: E402

scale, names = (sys.argv[1] if len(sys.argv) > 1 else "0.001"), sys.argv[2:]
spark = local_session(8)
for name, run in catalog.callables().items():
    if names and name not in names:
        continue
    began = time.time()
    try:
        frame = run(spark, f"/root/testdata/sf{scale}")
        print(f"{name:34s} {frame.count():8d} rows {time.time() - began:6.2f} s", flush=True)
    except Exception as error:
        print(f"{name:34s} FAILED {str(error)[:600]}", flush=True)
        traceback.print_exc(limit=-2, file=sys.stdout)
spark.stop()
