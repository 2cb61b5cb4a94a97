"""Write COVERAGE.md (``python -m switchyard.plans.coverage``): every registered
key with its SURVEY section, the library functions its plan calls, and
whether a DuckDB oracle checks it."""

from __future__ import annotations

import inspect
import os
import re
import sys

ALIASES = {
    "A": "operators.aggregates", "C": "operators.changes", "J": "operators.joins", "K": "operators.checks",
    "Fl": "operators.filters", "T": "operators.topk", "W": "operators.windows", "R": "operators.rules",
    "X": "functions.exprs", "TX": "sources.text", "SD": "sources.sql_dump", "TB": "sources.tables",
    "FI": "sources.files", "EX": "sinks.export", "BL": "sinks.blocks", "CK": "sinks.checksums", "S": "streaming.streams", "M": "plans.migration",
}
CALL = re.compile(r"\b(" + "|".join(sorted(ALIASES, key=len, reverse=True)) + r")\.([a-z_]+)\(")


def _calls(fn, depth: int = 1) -> list[str]:
    """Library functions called by ``fn`` (and by helpers of its own module, one level down)."""
    try:
        src = inspect.getsource(fn)
    except (OSError, TypeError):
        return []
    seen: list[str] = []
    for alias, name in CALL.findall(src):
        ref = f"{ALIASES[alias]}.{name}"
        if ref not in seen:
            seen.append(ref)
    if depth:
        mod = sys.modules.get(fn.__module__)
        for name in re.findall(r"\b([a-z_]+)\(fx\)", src):
            helper = getattr(mod, name, None)
            if callable(helper) and helper is not fn:
                seen += [r for r in _calls(helper, depth - 1) if r not in seen]
    if not seen and "F." in src:
        seen.append("pyspark.sql.functions built-ins")
    return seen


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from switchyard.plans import catalog_checks
    from switchyard.plans.catalog import ORACLES, QUERIES, SECTIONS

    extra = {k: fn for k, (fn, _) in catalog_checks.FINDINGS.items()}
    print("# COVERAGE\n")
    print("Every key registered in `__spark_entry__.queries()`, generated by `python -m switchyard.plans.coverage`. "
          "Functions are relative to the `switchyard` package; 'SQL' means a DuckDB oracle in `oracle_sql()` is "
          "compared at sf0.01 and sf0.001.\n")
    print("| Key | SURVEY | Library functions used | Check |\n|---|---|---|---|")

    def order(k):
        return tuple(int(x) for x in SECTIONS[k].split(".")), k

    for key in sorted(QUERIES, key=order):
        fn = extra.get(key)
        if fn is None:
            import switchyard.plans.catalog_changes as m1
            import switchyard.plans.catalog_io as m2
            import switchyard.plans.catalog_relational as m3
            import switchyard.plans.catalog_streams as m4

            for m in (m1, m2, m3, m4, catalog_checks):
                cand = getattr(m, QUERIES[key].__name__, None)
                if callable(cand) and QUERIES[key].__name__ == key:
                    fn = cand
                    break
        refs = _calls(fn) if fn is not None else []
        if key in ("union_findings", "agg_verdict", "snk_findings"):
            refs = ["plans.diagnosis.findings", *refs]
        cell = ", ".join(f"`{r}`" for r in refs) or "the operational table itself (fixture view)"
        print(f"| `{key}` | {SECTIONS[key]} | {cell} | {'SQL' if key in ORACLES else 'rows-only'} |")


if __name__ == "__main__":
    main()
