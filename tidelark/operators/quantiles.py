"""Exact percentiles of whole columns without their distinct values in one task.

Approximate quantiles cut each column into bins; a bin's count, minimum and
maximum tell which bins hold the wanted ranks, and only their rows are looked
at again, until few are left.  What meets on the driver is a row a bin.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a column in a round, and rows that are counted by value at last.
BINS, FEW = 1000, 50_000


def percentiles(df: DataFrame, wanted: dict[str, list[float]], few: float = FEW) -> dict[str, list[float] | None]:
    """The values of ``percentile`` at the given shares of each column, interpolated; None of a column without values."""
    if not wanted:
        return {}
    cs = list(wanted)
    # NaN is the largest value
    x = {c: F.col("`" + c.replace("`", "``") + "`").cast("double") for c in cs}
    names = {c: f"x{i}" for i, c in enumerate(cs)}
    rows = df.select(*[x[c].alias(names[c]) for c in cs])
    n = rows.agg(*[F.count(v).alias(v) for v in names.values()]).first()
    ranks = {names[c]: sorted({r for p in wanted[c] for r in _places(n[names[c]], p)[:2]}) for c in cs if n[names[c]]}
    found: dict[str, dict[int, float]] = {v: {} for v in ranks}
    # the span that is open (all values at first) of each column: lowest and highest value, and rows below it
    spans: dict[str, list[tuple[float, float, int, int]]] = {v: [(-math.inf, math.nan, 0, n[v])] for v in ranks}
    while spans:
        within = {v: _inside(v, spans[v]) for v in spans}
        if sum(s[3] for each in spans.values() for s in each) <= few:
            bins = _long(rows, {v: F.col(v) for v in spans}, within).groupBy("c", "x").agg(F.count(F.lit(1)).alias("n"))
            table = [(r.c, r.x, r.x, r.n) for r in bins.collect()]
        else:
            edges = _edges(rows, spans, within)
            cut = Bucketizer(splitsArray=list(edges.values()), inputCols=list(edges), outputCols=[f"{v}_bin" for v in edges], handleInvalid="keep").transform(rows)
            bins = _long(cut, {v: F.struct(F.col(f"{v}_bin").alias("bin"), F.col(v).alias("x"), _which(v, spans[v]).alias("span")) for v in edges}, within)
            bins = bins.groupBy("c", "x.bin", "x.span").agg(F.min("x.x").alias("low"), F.max("x.x").alias("high"), F.count(F.lit(1)).alias("n"))
            table = [(r.c, r.low, r.high, r.n) for r in bins.collect()]
        before = spans
        spans = {v: left for v, each in spans.items() if (left := _placed([t[1:] for t in table if t[0] == v], each, ranks[v], found[v]))}
        few = few if spans != before else math.inf
    out: dict[str, list[float] | None] = {}
    for c in cs:
        v = names[c]
        out[c] = None
        if v in ranks:
            out[c] = []
            for p in wanted[c]:
                lo, hi, at = _places(n[v], p)
                a, b = found[v][lo], found[v][hi]
                out[c].append(a if lo == hi or a == b else (hi - at) * a + (at - lo) * b)
    return out


def _places(n: int, p: float) -> tuple[int, int, float]:
    at = (n - 1) * p
    return math.floor(at), math.ceil(at), at


def _key(v: float) -> tuple[bool, float]:
    return (math.isnan(v), 0.0 if math.isnan(v) else v)


def _inside(v: str, spans):
    """Whether a value lies in one of the spans; null if it is null."""
    out = F.lit(False)
    for low, high, _, _ in spans:
        out = out | F.col(v).between(F.lit(low), F.lit(high))
    return out


def _which(v: str, spans):
    out = F.lit(None).cast("int")
    for i, (low, high, _, _) in enumerate(spans):
        out = F.when(F.col(v).between(F.lit(low), F.lit(high)), i).otherwise(out)
    return out


def _long(rows: DataFrame, values: dict, within: dict) -> DataFrame:
    each = F.array(*[F.when(within[v], F.struct(F.lit(v).alias("c"), values[v].alias("x"))) for v in values])
    return rows.select(F.explode(each).alias("e")).where("e IS NOT NULL").select("e.c", "e.x")


def _edges(rows: DataFrame, spans: dict, within: dict) -> dict[str, list[float]]:
    """Lower ends of bins from approximate quantiles of the open values, and the ends of the spans."""
    grid = [i / BINS for i in range(BINS + 1)]
    got = rows.agg(*[F.percentile_approx(F.when(within[v], F.col(v)), grid, 5 * BINS).alias(v) for v in spans]).first()
    out = {}
    for v, each in spans.items():
        # a span's ends are bins of their own, so that it shrinks whatever is tied
        ends = [e for low, high, _, _ in each for e in (low, math.nextafter(low, math.inf), high)]
        out[v] = [-math.inf, *sorted({e + 0.0 for e in (*(got[v] or []), *ends) if math.isfinite(e)}), math.inf]
    return out


def _placed(bins, spans, ranks, found: dict) -> list[tuple[float, float, int, int]]:
    """Puts into ``found`` the ranks that fall in bins of one value; the spans of the others."""
    left = []
    bins = sorted(bins, key=lambda t: _key(t[0]))
    starts = sorted(spans, key=lambda s: _key(s[0]))
    at, k = None, 0
    for low, high, n in bins:
        # a bin belongs to the last span that begins at or below it
        while k < len(starts) and _key(starts[k][0]) <= _key(low):
            at, k = starts[k][2], k + 1
        here = [r for r in ranks if at <= r < at + n and r not in found]
        if here and _key(low) == _key(high):
            found.update(dict.fromkeys(here, low))
        elif here and n == 2:
            found.update({r: low if r == at else high for r in here})
        elif here:
            # the lowest and the highest rank of a bin are known
            found.update({r: v for r, v in ((at, low), (at + n - 1, high)) if r in here})
            if any(r not in found for r in here):
                left.append((low, high, at, n))
        at += n
    return left
