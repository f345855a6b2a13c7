"""Order-insensitive comparison of a Spark result with a DuckDB one."""

import math
from decimal import Decimal


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return int(x) if x.is_integer() else round(x, 6)
    if isinstance(x, dict):
        return tuple((k, _plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return tuple((k, _plain(v)) for k, v in x.asDict().items())
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, expected):
    names, wanted = expected
    assert sorted(df.columns) == sorted(names)
    a, b = _rows(df.columns, df.collect()), _rows(names, wanted)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, str(wrong[:2])[:2000]
