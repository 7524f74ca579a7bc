"""Scalar column expressions used by the operators (built-ins only)."""

from keelson.functions.paths import join_path, last_segment, parent_dir, with_suffix
from keelson.functions.times import elapsed_micros, micros_to_ntz, ntz_micros
from keelson.functions.text import (
    escape_backslash,
    int_text,
    prefixed_key,
    seconds_text,
    service_uri,
    when_equals,
)

__all__ = [
    "join_path", "with_suffix", "last_segment", "parent_dir",
    "escape_backslash", "int_text", "seconds_text", "service_uri",
    "prefixed_key", "when_equals", "ntz_micros", "micros_to_ntz", "elapsed_micros",
]
