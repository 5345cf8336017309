"""Comparison of results."""

import datetime
import decimal
import math


def canonical(found):
    """Rows of a DataFrame, or of what DuckDB executed, as sorted tuples of texts by column: numbers rounded, null, NaN and empty texts apart."""

    def cell(v):
        if v is None:
            return "<null>"
        if isinstance(v, bool):
            return f"{float(v):.6f}"
        if isinstance(v, (int, float, decimal.Decimal)):
            return "<nan>" if math.isnan(v) else f"{float(v):.6f}"
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        if isinstance(v, (list, tuple)):
            return str([cell(x) for x in v])
        if isinstance(v, dict):
            return str([(k, cell(x)) for k, x in sorted(v.items())])
        return f"'{v}'"

    names, rows = (found.columns, found.collect()) if hasattr(found, "collect") else ([d[0] for d in found.description], found.fetchall())
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], sorted(tuple(cell(row[k]) for k in order) for row in rows)
