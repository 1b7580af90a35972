"""Operators over long tables of boxes, readings, parties and entries, against the plain rules."""

import random
from collections import Counter

from tallymark.operators import fuse as fu
from tallymark.operators import layout as ly
from tallymark.operators import link as lk
from tallymark.sources import notices as no
from test_nearlines import edits


def plain_lines(words):
    """The rule of the running means, over one image: list of lists of ids."""
    lines = []
    for wid, x, y, w, h in sorted(words, key=lambda r: (r[2], r[1], r[0])):
        cy = y + h / 2
        for line in lines:
            if abs(cy - line[0] / line[2]) <= line[1] / line[2] * 0.55:
                line[0], line[1], line[2] = line[0] + cy, line[1] + h, line[2] + 1
                line[3].append(wid)
                break
        else:
            lines.append([cy, h, 1, [wid]])
    return [line[3] for line in lines]


def test_words_join_lines_by_the_running_mean(spark):
    rnd = random.Random(3)
    images = {"slanted": [(i, float(i * 9), i * 0.5, 8.0, 10.0 + i % 3) for i in range(120)]}
    images["mixed"] = [(i, rnd.uniform(0, 300), rnd.uniform(0, 700), rnd.uniform(5, 40), rnd.choice([4.0, 9.0, 9.0, 30.0, 80.0])) for i in range(400)]
    images["sparse"] = [(i, float(i % 5 * 30), float(i // 5 * 40), 20.0, 10.0) for i in range(60)]
    images["ties"] = [(i, 5.0, 7.0, 3.0, 0.0) for i in range(5)] + [(9, 5.0, 7.0, 3.0, 6.0)]
    rows = [(name, *w) for name, words in images.items() for w in words]
    df = spark.createDataFrame(rows, "image_id string, id int, x double, y double, w double, h double").repartition(5)
    got = {}
    for r in ly.words_to_lines(df).collect():
        got.setdefault((r["image_id"], r["line_no"]), set()).add(r["id"])
    for name, words in images.items():
        want = plain_lines(words)
        assert [got[name, k] for k in range(1, len(want) + 1)] == [set(line) for line in want]
    assert sum(1 for name, _ in got if name == "slanted") > 3


def test_headings_take_the_next_region_when_it_is_close(spark):
    rows = [(1, 0.0, 0.0, 50.0, 10.0, "MRP:"), (2, 0.0, 30.0, 50.0, 10.0, "Rs 20"), (3, 0.0, 60.0, 50.0, 10.0, "Net Qty: 5 g"), (4, 0.0, 100.0, 50.0, 10.0, "Batch No"), (5, 120.0, 105.0, 50.0, 10.0, "B12"),
            (6, 0.0, 200.0, 50.0, 10.0, "Mfd by"), (7, 0.0, 275.0, 50.0, 10.0, "too far"), (8, 0.0, 300.0, 50.0, 10.0, "Packed by"), (9, 0.0, 320.0, 50.0, 10.0, "MRP"), (10, 190.0, 335.0, 50.0, 10.0, "aside"), (11, 0.0, 400.0, 5.0, 5.0, None)]
    df = spark.createDataFrame([("i", *r) for r in rows], "image_id string, id int, x double, y double, w double, h double, text string")
    got = {(r["heading_id"], r["value_id"], r["field"], r["value"], r["confidence"]) for r in ly.heading_values_by_box(df).collect()}
    assert got == {(1, 2, "MRP", "Rs 20", 0.94), (3, 3, "NET_QUANTITY", "5 g", 0.98), (4, 5, "BATCH_NUMBER", "B12", 0.94)}


def test_neighbours_equal_the_pairwise_rule(spark):
    rnd = random.Random(5)
    rows = [("a" if i % 3 else "b", i, None if i % 11 == 0 else rnd.uniform(-60, 400), rnd.uniform(-40, 300), rnd.choice([0.0, 10.0, 60.0, 230.0]), rnd.uniform(2, 30)) for i in range(260)]
    rows = [(im, i, x, None if x is None else y, w, h) for im, i, x, y, w, h in rows]
    want = set()
    for im, i, x, y, w, h in rows:
        for jm, j, x2, y2, w2, h2 in rows:
            if im != jm or i == j:
                continue
            if y is None:
                near = j - i in (-1, 1, 2)
            else:
                near = y2 is not None and abs(y2 - (y + h)) <= 14 and (min(x + w, x2 + w2) - max(x, x2) > 0 or abs(x - x2) < 25)
            if near:
                want.add((im, i, j))
    df = spark.createDataFrame(rows, "image_id string, id int, x double, y double, w double, h double")
    got = [(r["image_id"], r["id"], r["near"]) for r in ly.neighbour_rows(df).collect()]
    assert set(got) == want and len(got) == len(want)


def plain_iou(a, b):
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w * h else 0.0


def test_readings_of_a_dense_image_follow_the_first_group(spark):
    rnd = random.Random(9)
    rows = [("dense" if i % 4 else "small", i, rnd.choice(["Net Wt 50g", "Net Wt 5Og", "MRP Rs 10", "Best before", None]), rnd.uniform(-20, 120), rnd.uniform(-20, 120), rnd.choice([0.0, 15.0, 40.0]), rnd.choice([8.0, 12.0, 60.0]), 0.5 + i % 5 / 10) for i in range(320)]
    groups, want = {}, {}
    for im, i, text, *box, _ in rows:
        low = (text or "").lower()
        for leader, first, said in groups.setdefault(im, []):
            over, longest = plain_iou(first, box), max(len(low), len(said))
            if over > 0.35 or (over > 0.15 and (1.0 if not longest else 1.0 - edits(low, said) / longest) > 0.55):
                want[im, i] = leader
                break
        else:
            groups[im].append((i, box, low))
            want[im, i] = i
    df = spark.createDataFrame(rows, "image_id string, ord int, text string, x double, y double, w double, h double, confidence double").repartition(4)
    assert {(r["image_id"], r["ord"]): r["leader"] for r in fu.reading_groups(df).collect()} == want
    items = fu.consensus_readings(df.filter("text is not null")).collect()
    assert sum(r["agreement"] for r in items) == sum(1 for r in rows if r[2]) and {r["status"] for r in items} == {"CONFIRMED"}


def reach(pairs):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for a in root:
        groups.setdefault(find(a), set()).add(a)
    return {frozenset(g) for g in groups.values()}


def test_party_links_connect_what_all_pairs_connect(spark):
    rnd = random.Random(2)
    rows = [("p", 0, "i1", "packer", "A", "x", 0.9), ("p", 1, "i2", "packer", "B", None, 0.8), ("p", 2, "i2", "packer", "C", None, 0.7), ("p", 3, "i3", "packer", "D", "y", 0.6)]
    rows += [(f"q{k % 4}", k, f"i{rnd.randrange(3)}-{k // 30}", rnd.choice(["packer", "Importer", "maker"]), rnd.choice("abcdefgh"), None, 0.5) for k in range(240)]
    rows += [("alone", k, "i1", "packer", "Z", None, 0.5) for k in range(3)] + [("alone", 9, "i2", "maker", "NOT_VISIBLE", None, 0.5)]
    # The name of a link is told by its address here, so that every party can be recognised.
    rows = [(p, o, im, role, name, f"at{o}", c) for p, o, im, role, name, _, c in rows]
    df = spark.createDataFrame(rows, "product_id string, ord int, image_id string, role string, name string, address string, confidence double")
    got = lk.entity_links(df).collect()
    pairs = {(r["product_id"], *[int(part.removeprefix("at")) for part in r["linked_value"].split(" — ")[1].split(", ")]) for r in got}
    own = {(p, o): (im, role.upper(), name.lower()) for p, o, im, role, name, _, _ in rows if name != "NOT_VISIBLE"}
    every = [((p, a), (q, b)) for (p, a), x in own.items() for (q, b), y in own.items() if p == q and a < b and x[0] != y[0] and (x[1] == y[1] or x[2] == y[2])]
    assert reach(((p, a), (p, b)) for p, a, b in pairs) == reach(every) and len(got) <= 4 * len(rows)
    assert {r["linked_value"] for r in got if r["product_id"] == "p"} == {"A — at0, at1", "A — at0, at2", "B — at1, at3", "C — at2, at3"}


def test_citations_are_the_first_entry_that_contains_the_rule(spark):
    entries = [(3, "KB-c", "s3", "Rule 6(1)(a)", "Sub-rule (1)"), (1, "KB-z", "s1", "Rule 18", "General"), (2, "KB-b", "s2", "Rule 61", "Clause (b)"), (4, "KB-d", "s4", "Second Schedule", None), (5, "KB-e", "s5", None, "Rule 6(1)(a)")]
    checks = [(1, "RULE 6", None), (2, " rule 6(1) ", "x"), (3, "Rule 99", "schedule"), (4, None, "b"), (5, "zzz", None), (6, "", "q"), (7, "6", "General"), (8, "general", "x"), (9, "Rule 6(1)(a) and more", "l")] * 2
    kb = spark.createDataFrame(entries, "n int, entry_id string, source string, rule_number string, sub_rule_or_clause string")
    got = no.attach_citation(spark.createDataFrame(checks, "id int, rule_no string, sub_rule string"), kb, ["n"], "fallback").collect()

    def first(q):
        if q is None:
            return None
        return next(((e, s) for _, e, s, *texts in sorted(entries, key=lambda r: r[0]) if any(q.strip().lower() in (t or "").lower() for t in texts)), None)

    want = Counter()
    for i, rule, sub in checks:
        hit = first(rule) or first(sub) or (None, "fallback")
        want[i, *hit] += 1
    assert Counter((r["id"], r["citation_id"], r["citation_source"]) for r in got) == want


def test_percent_blocks_follow_the_reading_order(spark):
    rnd = random.Random(4)
    rows = [("a" if i % 4 else "b", i, None if i % 7 == 0 else round(rnd.uniform(0, 95), 1), rnd.uniform(0, 80), rnd.uniform(1, 4)) for i in range(90)]
    want = {}
    for image in ("a", "b"):
        lines = sorted((r for r in rows if r[0] == image), key=lambda r: (round(r[2] / 3.0) * 3.0, r[3], r[1]) if r[2] is not None else (float(r[1]), 0.0, r[1]))
        block, before = 0, None
        for r in lines:
            if before is None:
                joined = False
            elif r[2] is not None and before[2] is not None:
                joined = 0.0 <= r[2] - (before[2] + before[4]) <= 5.0
            else:
                joined = r[1] == before[1] + 1
            block, before = block + (not joined), r
            want[r[1]] = block
    df = spark.createDataFrame(rows, "image_id string, line_index int, y double, x double, h double")
    assert {r["line_index"]: r["block_no"] for r in ly.lines_to_blocks_percent(df).collect()} == want


def test_links_in_place_equal_those_of_segments(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.choice(["p", "q", None, *"stuv"]), rnd.randrange(40), rnd.choice(["i1", "i2", "i3", None]), rnd.choice(["packer", "Packer", "maker", None]), rnd.choice(["A", "a ", "B", "NOT_VISIBLE", None]), rnd.choice(["x", None]), 0.5) for _ in range(300)]
    # The first parties of images are told apart, as ties are in no given order.
    rows = [(p, k, *r) for k, (p, _, *r) in enumerate(rows)] + [(p, k, *r) for k, (p, _, *r) in enumerate(rows) if k % 7 == 0]
    df = spark.createDataFrame(rows, "product_id string, ord int, image_id string, role string, name string, address string, confidence double")
    some = [sorted(map(str, lk.entity_links(df).collect()))]
    for most in (0, 40):
        monkeypatch.setattr(lk, "MOST_PARTIES", most)
        some.append(sorted(map(str, lk.entity_links(df).collect())))
    assert some[0] and some[0] == some[1] == some[2]


def test_links_are_made_with_two_shuffles(spark):
    """One to count the parties of a product, one to bring them together."""
    df = spark.createDataFrame([("p", k, f"i{k}", "packer", "A", None, 0.5) for k in range(5)], "product_id string, ord int, image_id string, role string, name string, address string, confidence double")
    plan = lk.entity_links(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan


def test_groups_in_place_equal_those_of_the_grid(spark, monkeypatch):
    rnd = random.Random(8)
    texts = ["Net Wt 50g", "Net Wt 5Og", " net wt 50 G", "MRP Rs 10", "MRP Rs 1O0", "", None, "Best before é", "B"]
    rows = [(rnd.choice([*range(30), None]), rnd.choice([*range(40), None]), rnd.choice(texts), rnd.choice([rnd.uniform(-20, 90), None]) if i % 9 == 0 else rnd.uniform(-20, 90), rnd.uniform(-20, 60), rnd.choice([0.0, 15.0, 40.0, 70.0]), rnd.choice([8.0, 12.0, 60.0])) for i in range(900)]
    df = spark.createDataFrame(rows, "image_id int, ord bigint, text string, x double, y double, w double, h double").repartition(5)
    some = [sorted(map(str, fu.reading_groups(df).collect()))]
    want = sorted(map(str, fu._groups_across(df).collect()))
    monkeypatch.setattr(fu, "MOST_READINGS", 28)
    some.append(sorted(map(str, fu.reading_groups(df).collect())))
    assert some[0] == some[1] == want and len(want) == len(rows)


def test_an_image_is_grouped_whole_though_batches_cut_it(spark):
    df = spark.createDataFrame([(k // 20, k % 20, "a", 0.0 if k % 2 else 500.0, 0.0, 10.0, 10.0) for k in range(2_000)], "image_id int, ord int, text string, x double, y double, w double, h double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = fu.reading_groups(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 2_000 and all(r["leader"] == r["ord"] % 2 for r in got)
    plan = fu.reading_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
