"""Column expressions: address predicates, name matching, ratios with their state."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

VIP = "_VIP"


def is_ip(name: Column) -> Column:
    """Four dot-separated parts, each castable to a number."""
    parts = F.split(name, "[.]")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.try_cast("double").isNotNull())


def is_private_ip(name: Column, gateway: str) -> Column:
    """Loopback, or in the gateway's /16 with another last octet."""
    a, b, _, d = gateway.split(".")
    part = lambda k: F.split_part(name, F.lit("."), F.lit(k))
    return is_ip(name) & ((part(1) == "127") | ((part(1) == a) & (part(2) == b) & (part(4) != d)))


def matches_service(name: Column, service: Column) -> Column:
    """VIPs match by substring; pods as service-<nine>, service-<digit> or service- at the end; coredns is kube-dns."""
    plain = F.replace(name, F.lit("coredns"), F.lit("kube-dns"))
    vip = plain.contains(VIP) & F.contains(plain, service)
    return vip | F.regexp_like(plain, F.concat(F.lit("^.*"), service, F.lit("-([a-z0-9]{9}|[0-9]|$)")))


def workload_labels(labels: Column) -> Column:
    """The name=, k8s-app= and app= items of a label string."""
    return F.filter(F.split(labels, "[,/]"), lambda x: F.regexp_like(x, F.lit("^(name|k8s-app|app)=")))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a value with a state: a zero denominator is 'inf' (or 'nan' for 0 / 0) and a null value."""
    state = F.when(bottom != 0, "ok").when(top > 0, "inf").otherwise("nan")
    return F.struct(F.try_divide(top.cast("double"), bottom.cast("double")).alias("value"), state.alias("state"))


def angle(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """Angle of two vectors; null where a norm is 0."""
    cos = F.try_divide(dot, norm_a * norm_b)
    # least and greatest skip nulls
    return F.when(cos.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def path_or_none(text: Column) -> Column:
    """A path column's names; '0', '?', an empty text and null stand for no path."""
    return F.when(text.isNull() | text.isin("0", "?", ""), F.array().cast("array<string>")).otherwise(F.split(text, ">"))


def same_service(a: Column, b: Column) -> Column:
    """Equal up to the suffixes _pod and _vip."""
    bare = lambda c: F.regexp_replace(c, "_(pod|vip)$", "")
    return bare(a) == bare(b)


def normal(mean: Column, deviation: Column | float, *seed: Column) -> Column:
    """A normal draw that the seed columns fix, on any partitioning (Box and Muller over two numbers of a hash)."""
    text = F.sha2(F.concat_ws(":", *(F.coalesce(s.cast("string"), F.lit("")) for s in seed)), 256)
    part = lambda at: (F.conv(F.substring(text, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return mean + F.lit(deviation) * F.sqrt(-2.0 * F.log(part(1))) * F.cos(F.lit(2 * math.pi) * part(9))
