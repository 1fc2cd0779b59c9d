"""Running sums within keys over a table that is sorted across the cluster, so that a
key of any number of rows is no hot group.

Rows are dealt to ranges of (key, order) and summed within each range; the totals of
the few keys that cross a border (at most two a range) then become the offsets of the
ranges after it.  A hashed column is summed as ``sum(v_i * base**i) mod P``, ``i`` the
place within the key: these sums compose, since a run that follows ``m`` rows is
shifted by ``base**m``, so ranges never see each other's rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.llm.common import partitions, staged

#: Modulus of the hashed sums, a prime below 2**31: products stay below 2**62.
P = (1 << 31) - 1


class _Powers:
    """base**i mod P for arrays of i, from two tables."""

    def __init__(self, base: int):
        self.base, self.low, self.high = base, self._table(base, 4096), self._table(pow(base, 4096, P), 1)

    @staticmethod
    def _table(step: int, n: int) -> np.ndarray:
        out = np.ones(n, np.int64)
        for i in range(1, n):
            out[i] = out[i - 1] * step % P
        return out

    def __call__(self, i: np.ndarray) -> np.ndarray:
        top = int(i.max(initial=0)) >> 12
        if top >= len(self.high):
            self.high = self._table(pow(self.base, 4096, P), 2 * top + 1)
        return self.high[i >> 12] * self.low[i & 4095] % P


def _local(key: str, hashed: dict[str, int], plain: list[str]):
    def run(batches):
        powers = {c: _Powers(base) for c, base in hashed.items()}
        last, place, carry = None, 0, dict.fromkeys([*hashed, *plain], 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            rows = np.arange(len(keys))
            new = np.r_[last is None or keys[0] != last, keys[1:] != keys[:-1]]
            start = np.maximum.accumulate(np.where(new, rows, 0))
            goes_on = np.cumsum(new) == 0  # rows of the key that the last batch ended with
            at = rows - start + goes_on * place
            arrays, names = list(batch.columns), list(batch.schema.names)
            for c in [*hashed, *plain]:
                v = batch.column(names.index(c)).to_numpy().astype(np.int64)
                v = v % P * powers[c](at) % P if c in hashed else v
                total = np.cumsum(v)
                total = total - total[start] + v[start] + goes_on * carry[c]
                total = total % P if c in hashed else total
                carry[c] = int(total[-1])
                arrays[names.index(c)] = pa.array(v)
                arrays.append(pa.array(total))
            last, place = keys[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(at)],
                                             names=[*names, *(f"{c}_sum" for c in [*hashed, *plain]), "place"])
    return run


def running_sums(df: DataFrame, key: str, order: list, hashed: dict[str, int], plain: list[str], name: str,
                 drop: list[str] | None = None) -> DataFrame:
    """``df`` with ``place`` (from 0 within ``key``) and ``<c>_sum``, the running sum up to
    and including the row, of the long columns ``plain`` and, as hashed sums with their
    bases, ``hashed``; a hashed column itself becomes its term ``v * base**place mod P``.

    ``key`` is a long column without nulls; ``order`` fixes the rows of a key and its
    columns may be dropped (``drop``) once sorted."""
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(partitions(spark), key, *order).sortWithinPartitions(key, *order)
    kept = sorted_rows.drop(*(drop or [])).withColumn("part", F.spark_partition_id())
    sums = [f"{c}_sum" for c in [*hashed, *plain]]
    fields = [T.StructField(f.name, T.LongType() if f.name in hashed or f.name in plain else f.dataType) for f in kept.schema]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in [*sums, "place"]])
    local = staged(kept.mapInArrow(_local(key, hashed, plain), schema), name)
    # one row a range
    edges = sorted(local.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect())
    crossing = {a["hi"] for a, b in zip(edges, edges[1:]) if a["hi"] == b["lo"]}
    if not crossing:
        return local.drop("part")
    # at most two rows a range
    totals = sorted(local.where(F.col(key).isin(sorted(crossing))).groupBy(key, "part")
                    .agg(F.max(F.struct("place", *sums)).alias("t")).collect())
    offsets, last = [], None
    for k, part, t in totals:
        if k != last:
            last, rows, sofar = k, 0, dict.fromkeys([*hashed, *plain], 0)
        offsets.append((part, k, rows, *(pow(b, rows, P) for b in hashed.values()), *(sofar[c] for c in [*hashed, *plain])))
        for c in [*hashed, *plain]:
            if c in hashed:
                sofar[c] = (sofar[c] + pow(hashed[c], rows, P) * t[f"{c}_sum"]) % P
            else:
                sofar[c] += t[f"{c}_sum"]
        rows += t["place"] + 1
    fields = ["part int", f"`{key}` long", "_rows long", *(f"_by_{c} long" for c in hashed), *(f"_from_{c} long" for c in [*hashed, *plain])]
    out = local.join(F.broadcast(spark.createDataFrame(offsets, ", ".join(fields))), ["part", key], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    for c in hashed:
        by = F.coalesce(F.col(f"_by_{c}"), F.lit(1))
        out = out.withColumns({f"{c}_sum": (zero(f"_from_{c}") + by * F.col(f"{c}_sum")) % P, c: by * F.col(c) % P})
    for c in plain:
        out = out.withColumn(f"{c}_sum", F.col(f"{c}_sum") + zero(f"_from_{c}"))
    return out.withColumn("place", F.col("place") + zero("_rows")).select(*schema.names).drop("part")
