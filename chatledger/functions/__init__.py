"""Column expressions: text measures, scanning, canonical JSON, prices."""
