"""Parent-child links to full hierarchies by fragment contraction.

Rows are spread over fragments of bounded size.  Inside a fragment every chain
is followed to its end: a root, a loop, or an *exit*, a parent that lies in
another fragment.  The exits that other fragments point to form a smaller
forest with the same meaning; it is solved the same way with fewer fragments,
and its answers are joined back to the nodes that leave by them.  Where a round
hardly shrinks the forest (long chains cut everywhere), the rest is solved by
pointer doubling, whose number of joins is logarithmic in the depth.

State of a node: ``nxt`` the exit it leaves by (null: its way ends), ``hops``
steps to there, ``top`` the last node before, ``low`` the smallest id on the
way from the node to ``top``, ``cyc`` the smallest id of the loop it runs into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import hot_keys, join_unique, latest, materialize, release, ship

STATE = "id string, nxt string, hops bigint, top string, low string, cyc string"
#: Rows of one fragment at most: what one task holds in memory (some 300 bytes a row without paths).
FRAGMENT_ROWS = 200_000
#: Smaller forests than this many rows a core aren't spread any further.
LEAST_ROWS = 5_000
#: A round must leave at most this share of the forest, else pointer doubling takes over.
SHRINK = 0.7


def _follow(pdf: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """Follows every chain of one fragment to its end."""
    n = len(pdf)
    if not n:
        return pdf
    ids = pdf["id"].to_numpy(object)
    at = {x: i for i, x in enumerate(ids)}
    nxt = pdf["nxt"].to_numpy(object)
    hops = pdf["hops"].to_numpy(np.int64).copy()
    top, low, cyc = (pdf[c].to_numpy(object).copy() for c in ("top", "low", "cyc"))
    path = pdf["path"].to_numpy(object).copy() if paths else None
    step = np.fromiter((at.get(x, -1) if isinstance(x, str) else -1 for x in nxt), np.int64, n)
    out = nxt.copy()
    state = np.zeros(n, np.int8)  # 1: on the way now, 2: done
    for start in range(n):
        if state[start]:
            continue
        way, i = [], start
        while i >= 0 and state[i] == 0:
            state[i] = 1
            way.append(i)
            i = step[i]
        if i >= 0 and state[i] == 1:  # a loop: from i to the end of the way
            k = way.index(i)
            loop = way[k:]
            least = min(low[j] for j in loop)
            for j in loop:
                cyc[j], out[j], state[j] = least, None, 2
            way = way[:k]
        for j in reversed(way):
            t = step[j]
            if t >= 0:
                hops[j] += hops[t]
                out[j], top[j], cyc[j] = out[t], top[t], cyc[t]
                low[j] = min(low[j], low[t])
                if paths and cyc[j] is None:
                    path[j] = list(path[j]) + list(path[t])
            state[j] = 2
    res = {"id": ids, "nxt": out, "hops": hops, "top": top, "low": low, "cyc": cyc}
    if paths:
        res["path"] = path
    return pd.DataFrame(res)


def _contract(states: DataFrame, fragments: int, salt: int, locality: list[str], paths: bool) -> DataFrame:
    schema = STATE + (", path array<string>" if paths else "")
    cols = [c.split()[0] for c in schema.split(", ")]
    if fragments <= 1:
        placed = states.coalesce(1)
    elif locality:
        placed = states.repartition(fragments, *locality, *_spread(states, locality))
    else:
        placed = states.repartition(fragments, F.xxhash64(F.lit(salt), "id"))
    ship(states.sparkSession)

    def fragment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b[cols] for b in batches]
        if parts:
            whole = pd.concat(parts, ignore_index=True)
            whole = whole.astype(object).where(whole.notna(), None)
            yield _follow(whole, paths)

    return placed.mapInPandas(fragment, schema)


def _spread(states: DataFrame, locality: list[str]) -> list[Column]:
    """A further key for values of ``locality`` with more rows than a fragment holds: those spread over pieces by id."""
    large = {r[0]: r[1] for r in states.groupBy(F.to_json(F.struct(*locality)).alias("k")).count().where(F.col("count") > FRAGMENT_ROWS).toLocalIterator()}
    if not large:
        return []
    pieces = F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, -(-n // FRAGMENT_ROWS))])
    return [F.pmod(F.xxhash64("id"), F.coalesce(pieces[F.to_json(F.struct(*locality))], F.lit(1)))]


def _compose(left: DataFrame, solved: DataFrame, paths: bool, hot: DataFrame | None) -> DataFrame:
    """Continues each node's way by the answer for its exit; an exit without an answer doesn't exist."""
    r = solved.select(F.col("id").alias("nxt"), F.col("nxt").alias("r_nxt"), F.col("hops").alias("r_hops"), F.col("top").alias("r_top"), F.col("low").alias("r_low"), F.col("cyc").alias("r_cyc"), *([F.col("path").alias("r_path")] if paths else []), F.lit(True).alias("r_there"))
    done = left.where(F.col("nxt").isNull())
    met = join_unique(left.where(F.col("nxt").isNotNull()), r, ["nxt"], "left", hot)
    there = F.col("r_there").isNotNull()
    cols = [
        F.col("id"),
        F.col("r_nxt").alias("nxt"),
        F.when(there, F.col("hops") + F.col("r_hops")).otherwise(F.col("hops") - 1).alias("hops"),
        F.when(there, F.col("r_top")).otherwise(F.col("top")).alias("top"),
        F.when(there, F.least("low", "r_low")).otherwise(F.col("low")).alias("low"),
        F.col("r_cyc").alias("cyc"),
    ]
    if paths:
        cols.append(F.when(there & F.col("r_cyc").isNull(), F.concat("path", "r_path")).otherwise(F.col("path")).alias("path"))
    return done.select(*[c for c in STATE_COLUMNS], *(["path"] if paths else [])).unionByName(met.select(*cols))


STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


def _double(states: DataFrame, paths: bool) -> DataFrame:
    """Pointer doubling until every way has ended or has gone round its loop."""
    cur = materialize(states, "double")
    total = cur.count()
    reach = 1
    while not cur.where(F.col("nxt").isNotNull()).isEmpty():
        if reach >= 2 * total:  # whoever still runs is on or under a loop, its exit on the loop and its low complete there
            loop = cur.select(F.col("id").alias("nxt"), F.col("low").alias("l_low"))
            open_ = cur.where(F.col("nxt").isNotNull()).drop("cyc").join(loop, "nxt", "left").withColumnRenamed("l_low", "cyc").withColumn("nxt", F.lit(None).cast("string"))
            nxt = materialize(cur.where(F.col("nxt").isNull()).unionByName(open_.select(*cur.columns)), "double")
        else:
            nxt = materialize(_compose(cur, cur, paths, hot_keys(cur.where(F.col("nxt").isNotNull()), ["nxt"])), "double")
        release(cur)
        cur, reach = nxt, reach * 2
    return cur


def _solve(states: DataFrame, fragment_rows: int, locality: list[str], paths: bool, level: int = 0) -> DataFrame:
    n = states.count()
    fragments = max(1, -(-n // fragment_rows))
    if not level:  # all cores take part in the first round
        fragments = max(fragments, min(states.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
    part = materialize(_contract(states, fragments, level, locality, paths), f"fragments{level}")
    left = part.where(F.col("nxt").isNotNull())
    exits = left.select(F.col("nxt").alias("id")).distinct()
    quotient = materialize(part.join(exits, "id", "left_semi"), f"quotient{level}")
    m = quotient.count()
    if m == 0:
        solved = quotient
    elif fragments > 1 and m > SHRINK * n:
        solved = _double(quotient, paths)
    else:
        solved = _solve(quotient, fragment_rows, [], paths, level + 1)
    return materialize(_compose(part, solved, paths, hot_keys(left, ["nxt"])), f"solved{level}")


def resolve_hierarchy(entries: DataFrame, id_column: str = "id", parent_column: str = "parent_id", order_column: str | None = "entry_ts", locality: list[str] | None = None, paths: bool = False, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """(id, root_id, depth, cycle_id[, path]) for every entry.

    Of several rows of one id the one with the latest ``order_column`` counts;
    rows with a null id take no part.  A null, empty or unknown parent ends the
    way: that entry is a root of depth 0.  Entries on a loop or below one have
    no root and no depth, and ``cycle_id``, the smallest id on the loop.  With
    ``paths`` ``path`` lists the ids from the root down to the entry (null for
    entries without a root).  ``locality`` names columns by which parent and
    child tend to share a fragment; it only affects speed.
    """
    locality = locality or []
    if order_column is None:
        rows = entries.groupBy(F.col(id_column)).agg(F.max(F.struct(parent_column, *locality)).alias("_m")).select(id_column, "_m.*")
    else:
        rows = latest(entries, id_column, order_column, parent_column, *locality)
    keys = [f"_loc{i}" for i in range(len(locality))]
    rows = rows.select(F.col(id_column).cast("string").alias("id"), F.nullif(F.col(parent_column).cast("string"), F.lit("")).alias("nxt"), *[F.col(c).alias(k) for c, k in zip(locality, keys)]).where(F.col("id").isNotNull())
    states = rows.select("id", "nxt", F.col("nxt").isNotNull().cast("bigint").alias("hops"), F.col("id").alias("top"), F.col("id").alias("low"), F.lit(None).cast("string").alias("cyc"), *([F.array("id").alias("path")] if paths else []), *keys)
    solved = _solve(materialize(states, "links"), fragment_rows, keys, paths)
    whole = F.col("cyc").isNull()
    cols = [F.col("id"), F.when(whole, F.col("top")).alias("root_id"), F.when(whole, F.col("hops")).alias("depth"), F.col("cyc").alias("cycle_id")]
    if paths:
        cols.append(F.when(whole, F.reverse("path")).alias("path"))
    return solved.select(*cols)


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) from resolved paths: one row for each entry under each of its ancestors."""
    steps = resolved.where(F.col("path").isNotNull()).select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return steps.where(F.col("at") < F.col("depth")).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
