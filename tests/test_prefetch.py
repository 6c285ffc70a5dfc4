"""Trees of prefetches against plain Python."""

from collections import defaultdict

from relweave.operators.prefetch import Prefetch, prefetch


def test_three_levels(spark):
    parents = [(i, f"p{i}") for i in range(6)] + [(None, "none")]
    children = [(i, 0 if i < 2500 else i % 4, i * 37 % 101) for i in range(2600)] + [(9000, None, 1), (9001, 77, 1)]
    grand = [(i, i % 2700, -(i % 7)) for i in range(6000)]
    p = spark.createDataFrame(parents, "id long, name string")
    c = spark.createDataFrame(children, "cid long, pid long, v long").repartition(3)
    g = spark.createDataFrame(grand, "gid long, cid long, w long").repartition(3)

    below = defaultdict(list)
    for gid, cid, w in sorted(grand, key=lambda r: (-r[2], r[0])):
        if gid % 3:
            below[cid].append(gid)
    of = defaultdict(list)
    for cid, pid, v in sorted(children, key=lambda r: (r[2], r[0])):
        of[pid].append(cid)

    inner = Prefetch("grand", g.where("gid % 3 != 0"), "cid", "cid", ("gid",), ("-w", "gid"), take=2)
    level = lambda take: Prefetch("kids", c, "pid", "id", ("cid",), ("v", "cid"), take=take, inner=(inner,))
    read = lambda items: [(k.cid, [x.gid for x in k.grand]) for k in items]

    out, lists = prefetch(p, level(4))
    assert out.columns == ["id", "name", "kids"] and not lists
    got = {r.id: read(r.kids) for r in out.collect()}
    assert got == {i: [(k, below[k][:2]) for k in of[i][:4]] if i is not None else [] for i, _ in parents}
    assert out.count() == len(parents)

    out, lists = prefetch(p, level(None))
    assert out.columns == p.columns and list(lists) == ["kids"]
    got, sizes = defaultdict(list), []
    for r in sorted(lists["kids"].collect(), key=lambda r: (r.pid, r.chunk)):
        got[r.pid] += read(r.kids)
        sizes.append(len(r.kids))
    assert got == {i: [(k, below[k][:2]) for k in of[i]] for i in range(4)} and max(sizes) == 1000 and len(got[0]) > 2500

    # two trees beside each other, a bounded one with an unbounded one below, no rows at all
    deep = Prefetch("kids", c, "pid", "id", ("cid",), ("cid",), take=2, inner=(Prefetch("all", g, "cid", "cid", ("gid",), ("gid",)),))
    out, lists = prefetch(p, deep, Prefetch("same", c, "pid", "id", ("cid",), ("-cid",), take=1))
    assert set(lists) == {"kids__all"} and {r.cid for r in lists["kids__all"].collect()} == {k for i in range(4) for k in sorted(of[i])[:2]}
    assert {r.id: [x.cid for x in r.same] for r in out.collect()}[0] == [max(of[0])]
    out, lists = prefetch(p, Prefetch("kids", c.where("false"), "pid", "id", ("cid",), ("cid",), take=2))
    assert all(r.kids == [] for r in out.collect())
