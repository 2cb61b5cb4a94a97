"""switchyard: contact-centre operations analytics as Spark DataFrame plans.

Sub-packages:
  sources    readers (tables, dump text, logs, key/value text, file inventory)
  sinks      writers (CSV export, packages, manifests, checksums, audit)
  functions  column expressions shared by operators (blank tests, truncation, globs)
  operators  filters, joins, aggregates, windows, top-k, change sets, checks, rules
  plans      fixture views and the registered query catalogue
  streaming  Structured Streaming versions of the rolling checks
"""

__all__ = ["session"]
