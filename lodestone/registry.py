"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from lodestone.plans import audits, books, corpora, designs, markups, measures, numbers, papers, reports, rules, surrogates

_MODULES = (numbers, designs, measures, corpora, markups, audits, papers, rules, reports, books, surrogates)


def queries() -> dict:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
