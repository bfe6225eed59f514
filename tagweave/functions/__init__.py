"""Column-expression helpers (JVM built-ins) plus the one Arrow UDF the
built-ins can't express in linear time: prefix sums inside an array."""

from tagweave.functions.text import py_strip, normalize_ws, split_words
from tagweave.functions.arrays import running_sum, exclusive_running_sum
from tagweave.functions.hashing import mix_hash

__all__ = [
    "py_strip", "normalize_ws", "split_words",
    "running_sum", "exclusive_running_sum", "mix_hash",
]
