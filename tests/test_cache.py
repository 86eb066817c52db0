"""The cache as a stream, against a plain loop over the same requests."""

from collections import OrderedDict

from tessera.streaming import cache, streams


def plain(requests, live, most):
    shelves, out = {}, {}
    for shelf, id_, key, at in sorted(requests, key=lambda r: (r[3], r[1])):
        held = shelves.setdefault(shelf, OrderedDict())
        for k in [k for k, t in held.items() if at - t > live]:
            held.pop(k)
        hit, gone = key in held, 0
        if not hit:
            while len(held) >= most:
                held.popitem(last=False)
                gone += 1
            held[key] = at
        out[id_] = (shelf, key, hit, gone)
    return out


def test_hits_expiry_and_eviction(spark, tmp_path):
    import random

    rng = random.Random(3)
    at, requests = 1_700_000_000, []
    for i in range(400):
        at += rng.choice([1, 5, 40, 40, 200])
        requests.append((rng.choice("ab"), i, f"k{rng.randrange(9)}", at))
    for n in range(3):
        part = requests[n * 134 : (n + 1) * 134]
        spark.createDataFrame([(s, i, k, float(t)) for s, i, k, t in part], "shelf string, id long, key string, t double").selectExpr("shelf", "id", "key", "timestamp_seconds(t) as time").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("shelf string, id long, key string, time timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    out = streams.drained(cache.cached(stream, "shelf", "key", "id", "time", "1 second", live=600, most=4), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r.id: (r.shelf, r.key, r.hit, r.evicted) for r in out.collect()}
    want = plain(requests, 600, 4)
    assert got == want
    assert sum(v[2] for v in want.values()) > 40 and sum(v[3] for v in want.values()) > 40
