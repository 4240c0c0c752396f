"""The same operators over streams (STR-1..5)."""
