"""As-of identity over streams: flows named by a changing dimension, once no earlier change can come any more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import FIRST, JSON, InOrder

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def named(state, rows: list) -> tuple[dict, list[str]]:
    """A fold over probes (p) and versions (v) of many keys, texts of kind, key, tab and row: each probe with the versions of its key's latest time before its own.

    Probes come before versions of their time. The state is each key's latest time and its versions.
    """
    state, out = state or {}, []
    for at, text in rows:
        key, row = text[1:].split("\t", 1)  # JSON has no bare tab or line break
        held = state.get(key)
        if text[0] == "p":
            out.append(f"{row}\t" + "\n".join(sorted(held[1])) if held else row)
        elif held is None or at > held[0]:
            state[key] = [at, {row: 1}]
        elif at == held[0]:
            held[1][row] = 1
    return state, out


def unnamed(probes: list[str]) -> list[str]:
    return [text.split("\t", 1)[1] for text in probes]


def as_of(probe: DataFrame, versions: DataFrame, key: str, at: str, since: str, columns: Sequence[str], late: str = "1 minute", salts: int = 1, buckets: int = 1024) -> DataFrame:
    """Streams of probes and of versions, as operators.identity.as_of: probe with the columns of its key's latest version from before its time.

    Both times are timestamps; rows may come in any order as long as none is later than late. A probe is answered when the
    watermark has reached its time; one without a time at once, by no version. Keys are dealt to buckets, whose rows wait
    and are answered together: a key of few rows costs no call of its own. With salts, a key's probes go to that many
    buckets, each of which has the key's versions, so that no bucket has all flows of one gateway. State lies in a store
    on disk (spark.sql.streaming.stateStore.providerClass must be STORE).
    """
    micros = lambda c, none: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(none))
    # as text, as a null key doesn't survive the way into pandas
    group = F.to_json(F.struct(F.col(key).cast(probe.schema[key].dataType).alias("k")), JSON)
    text = lambda kind, names: F.concat(F.lit(kind), "_key", F.lit("\t"), F.to_json(F.struct(*names), JSON)).alias("_row")
    bucket = F.pmod(F.xxhash64("_key", "_salt"), F.lit(buckets)).cast("int").alias("_bucket")
    one = probe.withWatermark(at, late).select("*", group.alias("_key"), F.pmod(F.xxhash64(*probe.columns), F.lit(salts)).cast("int").alias("_salt"))
    one = one.select(bucket, micros(at, FIRST).alias("_at"), text("p", probe.columns), F.col(at).cast("timestamp").alias("_time"))
    two = versions.withWatermark(since, late).select("*", group.alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    two = two.select(bucket, micros(since, FIRST + 1).alias("_at"), text("v", columns), F.col(since).cast("timestamp").alias("_time"))
    found = one.unionByName(two).groupBy("_bucket").transformWithStateInPandas(InOrder(named, unnamed), "_row string", "Append", "EventTime")
    shape = probe.select(*probe.columns).schema
    version = versions.select(*columns).schema
    parts = F.split("_row", "\t", 2)
    # of versions at one time the greatest row counts
    best = F.array_max(F.transform(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: F.from_json(x, version, JSON)))
    out = found.select(F.from_json(parts[0], shape, JSON).alias("_p"), best.alias("_v"))
    return out.select(*(F.col(f"_p.{c}").alias(c) for c in probe.columns), *(F.col(f"_v.{c}").alias(c) for c in columns))
