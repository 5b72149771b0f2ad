"""Operations of a training-data pipeline on the tables `documents`, `pages`, `benchmark` and `labels`."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def free_prefix(columns: list[str], wanted: str) -> str:
    """``wanted``, lengthened until no column begins with it in any case of letters: for helper columns."""
    while any(c.lower().startswith(wanted.lower()) for c in columns):
        wanted = "_" + wanted
    return wanted


def ship(spark) -> None:
    """Lets Python workers import this package where neither PYTHONPATH nor the working folder leads to it."""
    root = Path(__file__).resolve().parent.parent.parent
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in [os.path.realpath(p) for p in known if p]:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), "quillcheck.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "quillcheck").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(target)  # the driver serves it to all executors
    _SHIPPED.add(app)
