"""Packages are worked on by executors that do not have the repository on their path."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from duskveil.sources import docx
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = docx.with_text(docx.rich_packages(s.createDataFrame([("a",)], "source string"), "source"))
print("text:", df.first().text.split())
"""


def test_packages_on_executors_without_the_repository(tmp_path):
    """the driver alone knows the folder; the code is sent."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "text: ['a', 'a', 'a', 'a']" in out.stdout, out.stderr[-600:]
