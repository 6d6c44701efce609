"""A collection from several sources with target shares of its tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.skew import grouped_rank

#: The exact fit first takes on the last so many times the longest length; what the budget has beyond is filled in proportion.
LAST = 2
#: Where that leaves a gap the fit takes on more, up to so many tokens.
MOST = 1 << 19


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many items of each length to take so that their lengths add up to ``budget`` or as little below as possible.

    All but the last few lengths of the budget are taken in proportion to the
    counts, and the rest is fitted exactly; so the items taken look like those
    there are, whatever the size. If the fit leaves a gap, it is done again
    with twice as much left to it, until there is none or all of the budget (at
    most ``MOST`` tokens of it) was left to the fit.
    """
    counts = {k: v for k, v in counts.items() if k > 0 and v > 0}
    if not counts or budget <= 0:
        return {}
    last, best = LAST * max(counts), None
    while True:
        take = _fit(counts, budget, last)
        got = sum(k * v for k, v in take.items())
        if best is None or got > best[0]:
            best = got, take
        if got == budget or last >= min(budget, MOST) or len(take) == len(counts) and take == counts:
            return best[1]
        last *= 2


def _fit(counts: dict[int, int], budget: int, last: int) -> dict[int, int]:
    """The bulk of the budget in proportion, the last tokens of it by bounded knapsack.

    Going from short to long, the tokens left over by rounding carry on to the
    next length.
    """
    total = sum(k * v for k, v in counts.items())
    if budget >= total:
        return dict(counts)
    bulk = max(0, budget - last)
    take, seen, took = {}, 0, 0
    for k in sorted(counts):
        seen += k * counts[k]
        take[k] = max(0, min(counts[k], (bulk * seen // total - took) // k))
        took += k * take[k]
    left = budget - took
    mask = (1 << (left + 1)) - 1
    reach, history = 1, []
    for k in sorted(counts, reverse=True):
        n = min(counts[k] - take[k], left // k)
        if n <= 0:
            continue
        history.append((k, n, reach))
        part = 1
        while n > 0:
            part = min(part, n)
            reach |= (reach << (k * part)) & mask
            n -= part
            part *= 2
        if reach >> left & 1:
            break
    best = reach.bit_length() - 1
    for k, n, before in reversed(history):
        for c in range(n + 1):
            if best - c * k < 0:
                raise AssertionError("the fit lost its way")
            if before >> (best - c * k) & 1:
                take[k] += c
                best -= c * k
                break
    return {k: v for k, v in take.items() if v}


def budgets(shares: dict[str, float], most: dict[str, int], total: int) -> dict[str, int]:
    """Tokens of each source: its share of ``total``, or ``most`` where that is less.

    What a source cannot give goes to the others in proportion to their
    shares, until the total is reached or every source gives its most.
    """
    out, free, left = dict.fromkeys(shares, 0), {s for s, w in shares.items() if w > 0 and most[s] > 0}, total
    while free:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if most[s] <= left * shares[s] / weight}
        if not full:
            out |= {s: int(left * shares[s] / weight + 1e-6) for s in free}
            break
        out |= {s: most[s] for s in full}
        left -= sum(most[s] for s in full)
        free -= full
    return out


def plan_mix(histogram: pd.DataFrame, targets: pd.DataFrame, total: int | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(per source: target_share, planned_share, max_repeats, available, budget, passes, tokens, documents, most_uses, actual_share; per source and length: extra).

    The total is given, or all tokens that the sources have. A source that
    cannot reach its share of it within its repeats gives what it can.
    """
    avail = (histogram["n_tokens"] * histogram["n"]).groupby(histogram["source"]).sum()
    t = targets.groupby("source", as_index=False).agg(target_share=("target_share", "sum"), max_repeats=("max_repeats", "max"))
    t["available"] = t["source"].map(avail).fillna(0).astype("int64")
    shares = dict(zip(t["source"], t["target_share"].fillna(0.0).clip(lower=0.0), strict=True))
    most = {s: int(a) * max(0, int(r)) for s, a, r in zip(t["source"], t["available"], t["max_repeats"].fillna(0), strict=True)}
    whole = int(t.loc[t["target_share"] > 0, "available"].sum()) if total is None else total
    plan = budgets(shares, most, whole)
    t["budget"] = [plan[s] for s in t["source"]]
    t["planned_share"] = t["budget"] / max(1, t["budget"].sum())
    t["passes"] = [b // a if a else 0 for b, a in zip(t["budget"], t["available"], strict=True)]
    extras, tokens, documents, uses = [], [], [], []
    for s, b, a, p in zip(t["source"], t["budget"], t["available"], t["passes"], strict=True):
        h = histogram[histogram["source"] == s]
        more = fit(dict(zip(h["n_tokens"].astype(int), h["n"].astype(int), strict=True)), int(b - p * a)) if a else {}
        extras += [(s, k, v) for k, v in more.items()]
        tokens.append(int(p * a + sum(k * v for k, v in more.items())))
        documents.append(int(h["n"].sum()) if p else sum(more.values()))
        uses.append(int(p + bool(more)))
    t["tokens"], t["documents"], t["most_uses"] = tokens, documents, uses
    t["actual_share"] = t["tokens"] / max(1, sum(tokens))
    return t, pd.DataFrame(extras, columns=["source", "n_tokens", "extra"])


def mix(counts: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(collection, report).

    counts: doc_id, source, n_tokens, checkpointed or a written table. The
    collection has doc_id, source, n_tokens and uses: how often a document
    enters, at most the max_repeats of its source. Its size is ``total``, by
    default that of all documents of the sources with a target; a source that
    is too small for its share even when repeated falls short, and the others
    make up for it in proportion. The report has the share wanted and reached
    by each source. Documents without tokens, without a source or of a source
    without target stay out. Only the numbers of documents by source and exact
    length come to the driver; which documents of a length enter once more is
    drawn by a seeded hash, in buckets, so a source or length of any size is
    spread. The report follows from the plan and needs no further job.
    """
    spark = counts.sparkSession
    wanted = [r[0] for r in targets.select("source").distinct().collect()]
    live = counts.where(F.col("source").isin(wanted) & (F.col("n_tokens") > 0)).select("doc_id", "source", "n_tokens")
    histogram = live.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()
    per_source, extras = plan_mix(histogram, targets.toPandas(), total)
    ranked = grouped_rank(live.withColumn("__tie", F.concat_ws(":", F.lit(seed), F.col("doc_id"))), ["source", "n_tokens"], "__tie", out="__rank", stable=True)
    passes = spark.createDataFrame([(s, int(p)) for s, p in zip(per_source["source"], per_source["passes"], strict=True)], "source string, passes int")
    extra = spark.createDataFrame([(s, int(k), int(v)) for s, k, v in extras.itertuples(index=False)], "source string, n_tokens bigint, extra bigint")
    used = (
        ranked.join(F.broadcast(passes), "source").join(extra, ["source", "n_tokens"], "left")
        .withColumn("uses", (F.col("passes") + F.when(F.col("__rank") < F.coalesce("extra", F.lit(0)), 1).otherwise(0)).cast("int"))
        .where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    )
    columns = {"source": str, "target_share": float, "planned_share": float, "max_repeats": int, "available": int, "budget": int, "tokens": int, "documents": int, "most_uses": int, "actual_share": float}
    report = spark.createDataFrame(
        [tuple(None if v is None or v != v else f(v) for f, v in zip(columns.values(), row, strict=True)) for row in per_source[list(columns)].itertuples(index=False)],
        "source string, target_share double, planned_share double, max_repeats int, available bigint, budget bigint, tokens bigint, documents bigint, most_uses int, actual_share double",
    ).select(*[F.round(c, 9).alias(c) if c.endswith("_share") else c for c in columns])
    return used, report
