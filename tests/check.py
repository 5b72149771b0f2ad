"""Command line: python tests/check.py [--sf 0.01] [name prefix ...]"""

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

from harness import DATA, TIMES, compare, duck  # noqa: E402

import quillcheck.plans.all  # noqa: E402,F401
from quillcheck.plans.registry import PLANS  # noqa: E402
from quillcheck.session import local_session  # noqa: E402

args = sys.argv[1:]
sf = "0.01"
if "--sf" in args:
    at = args.index("--sf")
    sf = args[at + 1]
    del args[at : at + 2]
spark = local_session(8)
root = f"{DATA}/sf{sf}"
con = duck(root)
bad = 0
for name, p in sorted(PLANS.items()):
    if args and not any(name.startswith(a) for a in args):
        continue
    began = time.time()
    try:
        if p.oracle is None:
            problem = None if p(spark, root).count() > 0 else "no rows"
        else:
            problem = compare(spark, con, p, root)
    except Exception as e:  # noqa: BLE001
        problem = f"{type(e).__name__}: {str(e)[:700]}"
    bad += problem is not None
    print(
        f"{'FAIL' if problem else 'ok  '} {name:32s} {time.time() - began:6.2f}s "
        f"(spark {TIMES['spark']:.2f} sql {TIMES['sql']:.2f}) {problem or ''}",
        flush=True,
    )
print("failures:", bad)
