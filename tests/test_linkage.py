"""Linkage, fusion and carried windows against brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymark.operators import carry
from tallymark.operators import fuse as fu
from tallymark.operators import link as lk


def score(a, b):
    total = 0.0
    for name, (gain, loss) in lk.WEIGHTS.items():
        x, y = a.get(name), b.get(name)
        if x is None or y is None:
            continue
        same = x == y or (name in lk.CONTAINS and (x in y or y in x))
        total += gain if same else -loss
    return round(max(0.0, min(1.0, total)), 4)


def brute_clusters(rows):
    out, leaders = {}, {}
    for session, o, ident in rows:
        for lo, li in leaders.setdefault(session, []):
            if score(li, ident) >= lk.MATCHED:
                out[session, o] = lo
                break
        else:
            leaders[session].append((o, ident))
            out[session, o] = o
    return out


def test_leader_clusters_equal_brute_force(spark):
    rnd = random.Random(7)
    pick = lambda *xs: rnd.choice(xs)
    rows = []
    for o in range(240):
        session = "hot" if o % 3 else f"s{o % 5}"
        rows.append((session, o, {"brand": pick("a", "b", None), "name": pick("tea", "green tea", "soap", None), "category": pick("food", "food", None),
                                  "pack": pick("5 g", "10 g", None), "model": pick("m1", None, None), "maker": pick("acme", None)}))
    flat = [(s, o, i["brand"], i["name"], i["category"], i["pack"], i["model"], i["maker"]) for s, o, i in rows]
    df = spark.createDataFrame(flat, "session string, ord int, brand string, name string, category string, pack string, model string, maker string")
    df = lk.identity(df, {c: F.col(c) for c in ("brand", "name", "category", "pack", "model", "maker")})
    got = {(r.session, r.ord): r.cluster_ord for r in lk.leader_clusters(df, "session", "ord").collect()}
    assert got == brute_clusters(rows)


def test_every_kind_of_match_has_a_common_key(spark):
    rnd = random.Random(11)
    pool = {"brand": ["a", "b"], "name": ["te", "a", "tea", "green tea", "steam"], "category": ["food", "home"], "variant": ["v1", "v2"], "pack": ["5 g", "9 g"], "model": ["m1", "m2"],
            "sku": ["s1", "s2"], "maker": ["acme", "acme ltd"], "batch": ["b1", "b2"]}
    rows = [("hot" if o % 3 else "cold", o, {k: rnd.choice(v) if rnd.random() < (0.25 if k in ("model", "sku") else 0.7) else None for k, v in pool.items()}) for o in range(400)]
    df = spark.createDataFrame([(s, o, *[i[k] for k in pool]) for s, o, i in rows], "session string, ord int, " + ", ".join(f"{k} string" for k in pool))
    df = lk.identity(df, {c: F.col(c) for c in pool})
    first = {}
    for s, o, i in rows:
        first.setdefault((s, tuple(i.values())), (s, o, i))
    able = [r for r in first.values() if score(r[2], r[2]) >= lk.MATCHED]
    want = {(a[0], a[1], b[1]) for a in able for b in able if a[0] == b[0] and a[1] < b[1] and score(a[2], b[2]) >= lk.MATCHED}
    nodes = df.groupBy("session", "ident").agg(F.min("ord").alias("o")).filter(lk.pair_score(F.col("ident"), F.col("ident")) >= lk.MATCHED)
    assert {tuple(r) for r in lk.match_edges(nodes, "session").collect()} == want and len(want) > 50
    got = {(r.session, r.ord): r.cluster_ord for r in lk.leader_clusters(df, "session", "ord").collect()}
    assert got == brute_clusters(rows)


def test_front_and_back_are_one_product_and_batches_do_not_split(spark):
    rows = [("s", 1, "purebake", "biscuits", "food", "b1"), ("s", 2, "purebake", "biscuits", "food", "b2"), ("s", 3, "purebake", "shampoo", "cosmetic", "b1")]
    df = lk.identity(spark.createDataFrame(rows, "session string, ord int, brand string, name string, category string, batch string"),
                     {c: F.col(c) for c in ("brand", "name", "category", "batch")})
    got = {r.ord: r.cluster_ord for r in lk.leader_clusters(df, "session", "ord").collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_price_conflict_and_agreement(spark):
    rows = [(1, "MRP", "₹299", "FRONT", 1), (1, "MRP", "₹349", "BACK", 2), (1, "NET_QUANTITY", "500 g", "FRONT", 1), (1, "NET_QUANTITY", " 500 G", "BACK", 2), (1, "SERVING_SIZE", "", "BACK", 2)]
    df = spark.createDataFrame(rows, "product_id int, field_name string, value string, panel string, ord int").selectExpr(
        "*", "cast(null as string) as unit", "case when value = '' then 'NOT_VISIBLE' else 'PRESENT' end as status", "0.9D as confidence", "panel as image_id")
    unified, candidates = fu.merge_fields(df)
    got = {r.field_name: (r.status, r.value) for r in unified.collect()}
    assert got == {"MRP": ("CONFLICT", None), "NET_QUANTITY": ("CONFIRMED", "500 g")}
    assert {r.value for r in candidates.collect()} == {"₹299", "₹349"}


def test_carried_windows_equal_plain_windows(spark):
    df = spark.range(3000).selectExpr("case when id % 3 > 0 then 0 else id % 7 end as k", "cast(id * 37 % 2999 as int) as o", "case when id % 11 = 0 then id end as v", "id").withColumn("seg", F.floor(F.col("o") / 100))
    w = Window.partitionBy("k").orderBy("o", "id")
    want = df.select("id", F.lag("id").over(w).alias("p"), F.sum(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"))
    got = carry.lag_across(df, ["k"], "seg", ["o", "id"], ["id"])
    got = carry.row_number_across(got, ["k"], "seg", ["o", "id"], "n")
    got = carry.fill_across(got, ["k"], "seg", ["o", "id"], "v", "f")
    assert sorted(map(tuple, want.collect()), key=str) == sorted(((r.id, r.prev_id, r.n, r.f) for r in got.collect()), key=str)


def test_near_repeats_are_dropped(spark):
    rows = [(1, ["Net Wt: 56 g", "Net Wt: 56 g", "Net Wt. 56 g", "MRP Rs 10"])]
    df = spark.createDataFrame(rows, "id int, l array<string>").select(F.transform("l", lambda t: F.struct(t.alias("text"), F.lit(0.9).alias("confidence"))).alias("l"))
    got = df.select(fu.distinct_lines(F.col("l"))).first()[0]
    assert [(g.text, round(g.confidence, 2)) for g in got] == [("Net Wt: 56 g", 0.95), ("MRP Rs 10", 0.9)]
