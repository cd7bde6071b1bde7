"""Exact expanding (running) quantiles of long series, spread over many tasks.

A running order statistic needs the whole past of a series, which a window frame would keep
in one task. Here every known value gets its rank in its series (row-counted pieces of the
value order, so no series is sorted in one task), and ranks fall into blocks of ``block``.

* A time bucket of a series knows how many values of each block came before it. A wavelet
  tree over the blocks of its own values, descended with those counts added, finds for each
  row the block of the wanted order statistic and the rank among that block's values so far.
* A block goes to the time buckets that ask for it, a few each. A wavelet tree over the ranks
  of its values in time order is descended to the value.

A task holds one time bucket (``size`` positions) or one block (``block`` values) of a
series, however long the series is and wherever its quantile moves. Descents are vectorised
over the rows of a bucket, one step a binary digit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.buckets import ROWS_PER_BUCKET, row_position
from panelcast.schemas import KEY
from panelcast.session import materialize

BLOCK = 1 << 14  # values of a series in one block of ranks
SALTS = 16  # parts in which a block is sent to the buckets that ask for it


class WaveletTree:
    """Whole numbers below 2^digits in time order; answers order statistics of any beginning of them."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.digits, self._zeros = digits, []
        order = np.asarray(symbols, np.int64)
        for d in range(digits - 1, -1, -1):
            right = (order >> d & 1).astype(bool)
            self._zeros.append(np.concatenate([[0], np.cumsum(~right)]))
            order = np.concatenate([order[~right], order[right]])  # values of the lower half first, each half in time order

    def smallest(self, upto: np.ndarray, rank: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of the ``rank``-th smallest (from 0) of the first ``upto``, and its rank among equal symbols.

        ``before``: how many of each symbol came earlier and count as well.
        """
        total = np.zeros((1 << self.digits) + 1, np.int64)
        if before is not None:
            total[1 : len(before) + 1] = before
        total = np.cumsum(total)
        low, high, k = np.zeros(len(upto), np.int64), np.asarray(upto, np.int64), np.asarray(rank, np.int64).copy()
        symbol = np.zeros(len(upto), np.int64)
        for level, zeros in enumerate(self._zeros):
            half = 1 << (self.digits - 1 - level)
            in_left = zeros[high] - zeros[low] + total[symbol + half] - total[symbol]
            right = k >= in_left
            k -= np.where(right, in_left, 0)
            symbol += np.where(right, half, 0)
            low = np.where(right, zeros[-1] + low - zeros[low], zeros[low])
            high = np.where(right, zeros[-1] + high - zeros[high], zeros[high])
        return symbol, k


def _locator(q: float, least: int, include_current: bool, names):
    """Rows of one time bucket to the block and the rank in it of the two order statistics around ``q``."""

    def locate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", kind="stable")
        block = pdf["_block"].to_numpy(np.float64, na_value=np.nan)
        known = ~np.isnan(block)
        earlier = dict(pdf["_earlier"].iloc[0] or {})
        own = block[known].astype(np.int64)
        most = max([0, *own.tolist(), *earlier])
        before = np.zeros(most + 1, np.int64)
        before[list(earlier)] = list(earlier.values())
        tree = WaveletTree(own, max(1, int(most).bit_length()))
        upto = np.cumsum(known) - (0 if include_current else known)
        n = before.sum() + upto
        ask = n >= max(least, 1)
        at, upto = (n[ask] - 1) * q, upto[ask]
        parts = []
        for which, rank in ((0, np.floor(at)), (1, np.ceil(at))):
            found, k = tree.smallest(upto, rank.astype(np.int64), before)
            parts.append(pd.DataFrame({"_pos": pdf["_pos"].to_numpy()[ask], "_which": which, "_block": found, "_rank": k, "_frac": at - np.floor(at)}))
        out = pd.concat(parts, ignore_index=True)
        out["_tb"] = pdf["_tb"].iloc[0]
        for k in names:
            out[k] = pd.Series([pdf[k].iloc[0]] * len(out), dtype=object)
        return out

    return locate


def _solver(include_current: bool, names):
    """Values of one block and the rows of one time bucket that ask for it."""

    def solve(values: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if wanted.empty:
            return pd.DataFrame({k: pd.Series([], dtype=object) for k in [*names, "_pos", "_which", "_frac", "_x"]})
        values = values.sort_values("_pos", kind="stable")
        ranks = values["_r"].to_numpy(np.int64)
        order = np.argsort(ranks, kind="stable")
        symbols = np.empty(len(ranks), np.int64)
        symbols[order] = np.arange(len(ranks))  # later values may be missing: ranks close up
        upto = np.searchsorted(values["_pos"].to_numpy(), wanted["_pos"].to_numpy(), side="right" if include_current else "left")
        found, _ = WaveletTree(symbols, max(1, int(len(ranks) - 1).bit_length())).smallest(upto, wanted["_rank"].to_numpy())
        return pd.DataFrame({
            **{k: pd.Series(list(wanted[k]), dtype=object) for k in names}, "_pos": wanted["_pos"].to_numpy(), "_which": wanted["_which"].to_numpy(),
            "_frac": wanted["_frac"].to_numpy(), "_x": values["_v"].to_numpy()[order][found],
        })

    return solve


def ranked_blocks(base: DataFrame, names, block: int) -> DataFrame:
    """``base`` with the rank ``_r`` of each known value in its series and its ``_block``; rows without a value have neither."""
    known = base.where(F.col("_v").isNotNull())
    # equal values in time order; counted pieces, so that one task never sorts a series
    ranked = row_position(known, "_r", pos=F.struct("_v", "_pos"), keys=names, size=None)
    ranked = ranked.withColumn("_block", F.floor(F.col("_r") / block).cast("int"))
    return base.where(F.col("_v").isNull()).withColumns({"_r": F.lit(None).cast("bigint"), "_block": F.lit(None).cast("int")}).unionByName(ranked)


def expanding_quantile(
    df: DataFrame, column: str, q: float, out: str, *, pos, keys=(KEY,), least: int = 1, include_current: bool = True,
    block: int = BLOCK, size: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the ``q`` quantile (linear) of all known values up to each row; NULL before ``least`` values.

    ``pos`` is an integer Column, unique per key: the order of the rows.
    """
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], pos.cast("bigint").alias("_pos"), F.col(column).cast("double").alias("_v"))
    rows = materialize(ranked_blocks(base, names, block).withColumn("_tb", F.floor(F.col("_pos") / size)))

    # how many values of each block came before each time bucket
    hist = rows.where("_block IS NOT NULL").groupBy(*names, "_tb", "_block").agg(F.count(F.lit(1)).alias("_c"))
    buckets = rows.select(*names, "_tb").distinct()
    grid = buckets.join(hist.select(*names, "_block").distinct(), names).join(hist, [*names, "_tb", "_block"], "left")
    before = Window.partitionBy(*names, "_block").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    earlier = grid.select(*names, "_tb", "_block", F.sum("_c").over(before).alias("_s")).where("_s > 0")
    earlier = earlier.groupBy(*names, "_tb").agg(F.map_from_entries(F.collect_list(F.struct("_block", "_s"))).alias("_earlier"))

    key_fields = [T.StructField(n, base.schema[n].dataType) for n in names]
    located = rows.select(*names, "_tb", "_pos", "_block").join(earlier, [*names, "_tb"], "left").groupBy(*names, "_tb").applyInPandas(
        _locator(q, least, include_current, names),
        T.StructType([
            T.StructField("_pos", T.LongType()), T.StructField("_which", T.IntegerType()), T.StructField("_block", T.IntegerType()),
            T.StructField("_rank", T.LongType()), T.StructField("_frac", T.DoubleType()), T.StructField("_tb", T.LongType()), *key_fields,
        ]),
    )
    located = materialize(located)
    fresh = located.select([F.col(c).alias(c) for c in located.columns])  # columns of their own, as both sides of the cogroup come from it
    asked = fresh.select(*names, "_block", "_tb").distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    values = rows.where("_block IS NOT NULL").select(*names, "_block", (F.col("_r") % SALTS).cast("int").alias("_salt"), "_pos", "_v", "_r", F.col("_tb").alias("_own"))
    sent = values.join(asked, [*names, "_block", "_salt"]).where("_own <= _tb").drop("_own", "_salt")
    group = [*names, "_block", "_tb"]
    solved = sent.groupBy(*group).cogroup(located.groupBy(*group)).applyInPandas(
        _solver(include_current, names),
        T.StructType([
            *key_fields, T.StructField("_pos", T.LongType()), T.StructField("_which", T.IntegerType()),
            T.StructField("_frac", T.DoubleType()), T.StructField("_x", T.DoubleType()),
        ]),
    )
    lo, hi = F.max(F.when(F.col("_which") == 0, F.col("_x"))), F.max(F.when(F.col("_which") == 1, F.col("_x")))
    quant = solved.groupBy(*names, "_pos").agg((lo + (hi - lo) * F.max("_frac")).alias(out))
    left = df.withColumn("_pos", pos.cast("bigint"))
    for k, n in zip(keys, names):
        quant = quant.withColumnRenamed(n, k)
    return left.join(quant, [*keys, "_pos"], "left").select(*df.columns, out)
