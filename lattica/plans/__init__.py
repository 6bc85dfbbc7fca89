"""Plans: the registered queries of the panel operators and models, with their SQL."""

from __future__ import annotations


def queries() -> dict:
    from . import models, panel, studies, variation  # noqa: F401  the others add theirs

    return dict(panel.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import models, panel, studies, variation  # noqa: F401

    return dict(panel.SQL)
