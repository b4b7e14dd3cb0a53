"""What tests share."""

import math

DATA = "/root/testdata/sf0.001"


def plain(df) -> list:
    """Rows of a pandas frame with sorted columns, in an order of their own, numbers as text of nine digits."""
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float", "uint")):
            return f"{float(v):.9g}"
        if hasattr(v, "__len__") and not isinstance(v, (str, bytes)):
            return str([one(x) for x in v])
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
