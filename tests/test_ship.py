"""The package reaches executors that cannot import it by themselves."""

import os
import subprocess
import sys
import zipfile

import rankspark as R

def test_the_zip_holds_every_module(spark, tmp_path):
    path = R.ship(spark).removeprefix("file:")
    names = set(zipfile.ZipFile(path).namelist())
    root = os.path.dirname(R.__file__)
    here = {os.path.relpath(os.path.join(f, n), os.path.dirname(root)) for f, _, ns in os.walk(root) for n in ns if n.endswith(".py")}
    assert names == here
    code = f"import sys; sys.path.insert(0, {path!r}); import rankspark.sources.records as m; print(m.__file__)"
    shown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(tmp_path), timeout=60, env={**os.environ, "PYTHONPATH": ""})
    assert shown.stdout.strip().startswith(path), shown.stderr
