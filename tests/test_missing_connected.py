"""Missing neighbours by an ordered fold, against a plain loop."""

import random

from tessera.operators import audit


def plain(cited, edges, confidence, co, each, most):
    docs = {}
    for doc, place, item, base, key in sorted(cited, key=lambda c: (c[0], c[1], c[2])):
        docs.setdefault(doc, {}).setdefault(item, (base, key))
    out = set()
    for doc, items in docs.items():
        keys = {k for _, k in items.values()}
        best = {}
        for item, (base, _) in items.items():
            rows = sorted((e for e in edges if e[0] in (item, base) and e[3] >= confidence and e[4] >= co), key=lambda e: (-e[3], -e[4], e[1], e[0]))
            kept = 0
            for _, dst, key, conf, n, status in rows[: each * 4]:
                if key is None or key in keys or (key in best and best[key][0] >= conf) or status in ("Withdrawn", "Superseded"):
                    continue
                best[key] = (conf, n, dst, item)
                kept += 1
                if kept >= each:
                    break
        for conf, n, dst, item in sorted(best.values(), key=lambda b: (-b[0], -b[1], b[2]))[:most]:
            out.add((doc, "missing_connected", "medium", dst, item, n))
    return out


def test_sources_in_order_with_quotas_of_their_own(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"i{k}" for k in range(24)]
        key = lambda x: None if x == "i0" else x[:2]
        edges = [(a, b, key(b), rng.randrange(4, 11) / 10, rng.randrange(5, 12), rng.choice(["Current", "Current", "Withdrawn", None])) for a in names for b in names if a != b and rng.random() < 0.6]
        cited = [(d, p, (i := rng.choice(names)), rng.choice([None, "i1", i]), key(i)) for d in range(40) for p in range(rng.randrange(1, 7))]
        first = {}
        cited = [first.setdefault((c[0], c[2]), c) for c in cited]
        got = audit.missing_connected(spark.createDataFrame(cited, "doc long, place int, item string, base string, key string"), spark.createDataFrame(edges, "src string, dst string, dst_key string, confidence double, co long, dst_status string"), 0.5, 7, 2, 5)
        want = plain(cited, edges, 0.5, 7, 2, 5)
        assert {tuple(r) for r in got.collect()} == want and len(want) > 60
