"""What keeps Python workers small: batches are made without pandas."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from duskveil.llm import common

LONG, REAL, TEXT, BYTES, FLAG, LISTS = pa.int64(), pa.float64(), pa.string(), pa.binary(), pa.bool_(), pa.list_(pa.int64())
COLUMNS = [
    ([1, 2], LONG), ([1, None, 3], LONG), ([None, None], LONG), ([2**63 - 1, -(2**63)], LONG), (range(3), pa.int32()), (np.arange(7)[::2], LONG), (np.arange(5), pa.int32()),
    ([1.5, None, float("nan")], REAL), ([1, 2], REAL), (np.array([1.5, np.nan]), REAL), ([True, False, None] * 5, FLAG), (np.array([True, False]), FLAG),
    ([None, b"x", b""], BYTES), (["é", None, "", "a\0b"], TEXT), ([None], TEXT), ([[1, 2], [], [3]], LISTS), ([[], []], LISTS), *[([], t) for t in (LONG, REAL, TEXT, BYTES, FLAG, LISTS)],
]

ALONE = """
import sys
import pyarrow as pa
from duskveil.llm import common, mixing
made = common.batch(pa.schema([("a", pa.int64()), ("b", pa.binary()), ("c", pa.string()), ("d", pa.bool_()), ("e", pa.list_(pa.int64()))]), [1, None], [b"x", None], ["y", "z"], [True, False], [[1], []])
common.numbers(made.column(0).slice(0, 1)), list(common.text_bytes(made.column(2))), made.filter(made.column(3)), made.take(common.column([0], pa.int64())), mixing.draws(made.column(0), [b"x", b"y"])
sys.exit("pandas" in sys.modules)
"""


@pytest.mark.parametrize("values,kind", COLUMNS)
def test_columns_are_those_of_arrow(values, kind):
    made, known = common.column(values, kind), pa.array(values, kind)
    made.validate(full=True)
    assert made.type == known.type and made.null_count == known.null_count and str(made.to_pylist()) == str(known.to_pylist())
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        for part in (made, made.slice(1), made.slice(0, 0)):
            np.testing.assert_array_equal(common.numbers(part), part.to_numpy(zero_copy_only=False))


@pytest.mark.parametrize("values,kind", [([2**63], LONG), (np.array([2**40]), pa.int32()), ([b"x"], LONG), (["x"], REAL)])
def test_what_arrow_refuses_is_refused(values, kind):
    with pytest.raises((OverflowError, pa.ArrowInvalid, pa.ArrowTypeError)):
        common.column(values, kind)


def test_batches_load_no_pandas():
    assert subprocess.run([sys.executable, "-c", ALONE], cwd=Path(__file__).parents[2]).returncode == 0
