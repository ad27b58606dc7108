"""Addresses and networks of both families against Python's own."""

import ipaddress
import random

from pyspark.sql import functions as F

from tessera.operators import sessions as S

ODD = ["1.2.3.4", "256.1.1.1", "01.2.3.4", "1.2.3", "::", "::1", "2001:DB8:0:0:0:0:0:ff", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::ffff:10.0.0.1", "::10.0.0.256", "64:ff9b::1.2.3.4",
       "fe80::1%eth0", ":::", "1::2::3", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "g::", "12345::", "", "unknown", " 10.0.0.7 ", None, "1::", "::1%a%b"]


def parsed(text):
    try:
        return ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None


def test_address_bits(spark):
    r = random.Random(3)
    some = [str(ipaddress.IPv6Address(r.getrandbits(128) & r.getrandbits(128) & r.getrandbits(128) & r.getrandbits(128))) for _ in range(200)]
    for row in spark.createDataFrame([(a,) for a in ODD + some], "a string").select("a", S.address_bits(F.col("a")).alias("b")).collect():
        ip = parsed(row.a)
        assert row.b == (None if ip is None else f"v{ip.version}{int(ip):0{8 if ip.version == 4 else 32}x}"), row.a


def test_client_behind_proxies_of_both_families(spark):
    """As the first hop from the right that no network holds, for random chains and up to forty networks that overlap."""
    r = random.Random(9)
    some = [a for a in ODD if a] + [f"10.{i}.0.{i}" for i in range(20)] + [f"2001:db8:{i:x}::{i:x}" for i in range(20)]
    nets = ["::1", "bad", "", *[f"10.{i}.0.0/{r.choice((14, 16, 24, 32))}" for i in range(20)], *[f"2001:db8:{i:x}::/{r.choice((46, 48, 128))}" for i in range(20)]]
    known = [ipaddress.ip_network(n, strict=False) for n in nets if n not in ("bad", "")]
    trusted = lambda a: (ip := parsed(a)) is not None and any(ip in n for n in known if n.version == ip.version)
    rows = [(i, r.choice(some), None if r.random() < 0.1 else ", ".join(r.choice(some) for _ in range(r.randint(0, 4)))) for i in range(300)]
    d = spark.createDataFrame(rows, "i int, peer string, fwd string").select(
        "i", "peer", "fwd", *[S.client_address(F.col("peer"), F.col("fwd"), n).alias(name) for name, n in (("some", nets), ("every", ["*"]), ("none", ["bad"]))]
    )
    for x in d.collect():
        hops = [h.strip() for h in (x.fwd or "").split(",") if h.strip()]
        want = next((h for h in reversed(hops) if not trusted(h)), hops[0] if hops else x.peer) if trusted(x.peer) else x.peer
        assert (x.some, x.every, x.none) == (want, hops[0] if hops else x.peer, x.peer)
