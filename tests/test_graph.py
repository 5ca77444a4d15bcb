import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import links as L, pagerank as R
from weftline.plans.lineage import cut, fixed_layout, settings


def ranks_of(nodes, edges, alpha=0.1, epsilon=1e-4, max_steps=1000):
    """Plain power iteration over one graph."""
    out = {}
    for src, _ in edges:
        out[src] = out.get(src, 0) + 1
    pr = {n: 1 / len(nodes) for n in nodes}
    for step in range(1, max_steps + 1):
        got = dict.fromkeys(nodes, 0.0)
        for src, dst in edges:
            if dst in got:
                got[dst] += pr[src] / out[src]
        new = {n: alpha / len(nodes) + (1 - alpha) * got[n] for n in nodes}
        gap = sum((new[n] - pr[n]) ** 2 for n in nodes) ** 0.5
        pr = new
        if gap < epsilon:
            break
    return pr, step


def graph(spark, graphs):
    nodes = [(ds, n) for ds, (ns, _) in graphs.items() for n in ns]
    edges = [(ds, a, b) for ds, (_, es) in graphs.items() for a, b in es]
    return (
        spark.createDataFrame(nodes, "dataset string, url string"),
        spark.createDataFrame(edges, "dataset string, src string, dst string"),
    )


def random_graph(seed, n, m):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(n)]
    return nodes, sorted({(rng.choice(nodes), rng.choice(nodes[: n - 3])) for _ in range(m)})


GRAPHS = {
    "cycle": (["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")]),
    "self": (["a", "b"], [("a", "a"), ("a", "b"), ("b", "a")]),
    "dangling": (["a", "b", "c"], [("a", "b"), ("a", "c"), ("b", "c")]),
    "two": (["a", "b", "x", "y"], [("a", "b"), ("b", "a"), ("x", "y")]),
    "lonely": (["a"], []),
    "random": random_graph(1, 40, 200),
}


@pytest.mark.parametrize("source_block", [R.SOURCE_BLOCK, 3])
def test_pagerank_of_many_graphs(spark, source_block):
    nodes, edges = graph(spark, GRAPHS)
    got = {(r.dataset, r.url): (r.pr, r.steps) for r in R.pagerank(nodes, edges, source_block=source_block).collect()}
    for ds, (ns, es) in GRAPHS.items():
        want, steps = ranks_of(ns, es)
        for n in ns:
            assert got[ds, n][0] == pytest.approx(want[n], abs=1e-12)
            assert got[ds, n][1] == steps
    total = {ds: sum(pr for (d, _), (pr, _) in got.items() if d == ds) for ds in GRAPHS}
    assert total["cycle"] == pytest.approx(1) and total["self"] == pytest.approx(1)
    assert total["dangling"] < 1


def test_pagerank_stops_at_the_step_limit(spark):
    nodes, edges = graph(spark, {"random": GRAPHS["random"]})
    got = {r.url: r.pr for r in R.pagerank(nodes, edges, epsilon=0.0, max_steps=7).collect()}
    want, _ = ranks_of(*GRAPHS["random"], epsilon=0.0, max_steps=7)
    assert got == {n: pytest.approx(p, abs=1e-12) for n, p in want.items()}


def test_pagerank_of_no_pages(spark):
    nodes, edges = graph(spark, {"cycle": GRAPHS["cycle"]})
    assert R.pagerank(nodes.where("false"), edges.where("false")).count() == 0


@pytest.mark.parametrize("source_block", [R.SOURCE_BLOCK, 2])
def test_reachable_with_and_without_budget(spark, source_block):
    _, es = GRAPHS["random"]
    edges = spark.createDataFrame([("d", a, b) for a, b in es], "dataset string, src string, dst string")
    seeds = spark.createDataFrame([("d", "n0")], "dataset string, url string")
    depth, frontier = {"n0": 0}, ["n0"]
    order = ["n0"]
    while frontier:
        fresh = sorted({b for a, b in es if a in frontier and b not in depth})
        for n in fresh:
            depth[n] = depth[frontier[0]] + 1
        order += fresh
        frontier = fresh
    assert {r.url: r.depth for r in L.reachable(edges, seeds, source_block=source_block).collect()} == depth
    assert sorted(r.url for r in L.reachable(edges, seeds, 9, source_block).collect()) == sorted(order[:9])


CAPTURES = [
    ("d", 1, "https://h.com/a/", '<p>One</p><a href="b">b</a><a href="#x">me</a><a href="/c">c</a>', "2024-01-01 00:00:01"),
    ("d", 2, "https://h.com/a/b", '<a href="/c">c</a><a href="/c#2">c</a><a href="mailto:x@y">m</a>', "2024-01-01 00:00:02"),
    ("d", 3, "https://h.com/a/", '<p>Two</p><a href="/new">n</a>', "2024-01-01 00:00:03"),
]


def crawl(spark):
    captures = spark.createDataFrame(CAPTURES, "dataset string, seq bigint, url string, html string, t string").select(
        "dataset", "seq", "url", "html", F.to_timestamp("t").alias("fetched_at")
    )
    prefixes = spark.createDataFrame([("d", "https://h.com/")], "dataset string, prefix string")
    fetched = L.fetched_links(captures, prefixes).cache()
    links = L.distinct_links(fetched)
    return captures, fetched, links, L.current_links(links, captures)


def test_links_over_all_captures_and_of_the_latest(spark):
    _, fetched, links, current = crawl(spark)
    a, b, c, new = (f"https://h.com/{p}" for p in ("a/", "a/b", "c", "new"))
    assert {(r.src, r.dst) for r in links.collect()} == {(a, b), (a, a), (a, c), (b, c), (a, new)}
    assert {(r.src, r.dst) for r in current.collect()} == {(b, c), (a, new)}
    assert {r.url: r.incoming_count for r in L.link_counters(fetched).collect()} == {a: 1, b: 1, c: 2, new: 1}


def test_page_table_keeps_stubs_and_latest_content(spark):
    captures, _, links, current = crawl(spark)
    rows = {r.url[14:]: r for r in L.page_table(captures, links, current).collect()}
    assert set(rows) == {"a/", "a/b", "c", "new"}
    assert "Two" in rows["a/"].content and rows["a/"].out_degree == 1 and rows["a/"].in_degree == 1
    assert rows["c"].content == "" and rows["c"].seq == L.STUB_SEQ and rows["c"].in_degree == 2


def test_incoming_lists_of_a_hot_page_come_in_blocks(spark):
    links = spark.createDataFrame([("d", f"s{i:03}", "hub") for i in range(90)], "dataset string, src string, dst string")
    blocks = L.incoming_lists(links, block_rows=20).collect()
    assert len(blocks) > 1 and sorted(s for b in blocks for s in b.incoming) == [f"s{i:03}" for i in range(90)]


def test_prefixes_join_by_equality(spark):
    """100,000 prefixes in one dataset, some the beginning of others; every address once, however many prefixes allow it."""
    wide = spark.range(100_000).select(F.lit("d").alias("dataset"), F.format_string("https://h%d.com/%s", F.col("id"), F.repeat(F.lit("a/"), (F.col("id") % 5).cast("int"))).alias("prefix"))
    extra = spark.createDataFrame([("d", "https://h7"), ("d", "https://h77.com/x"), ("d", None), ("e", ""), ("f", "http")], "dataset string, prefix string")
    rows = [("d", f"https://h{n}.com/{path}", n) for n in (0, 1, 2, 5, 6, 7, 70, 77, 99_999, 100_000) for path in ("", "a/", "a/a/a/a/z", "b")]
    rows += [("d", "https://h7", 1), ("d", "", 2), ("e", "", 3), ("e", "any", 4), ("f", "ftp://x", 5), ("f", "https://x", 6), ("g", "https://x", 7), ("d", None, 8)]
    rows += [rows[0], rows[0]]
    table = spark.createDataFrame(rows, "dataset string, dst string, n int").repartition(3)

    def allowed(dataset, url):
        if url is None or dataset == "g":
            return False
        if dataset == "e":
            return True
        if dataset == "f":
            return url.startswith("http")
        host = int(url[9:].split(".")[0]) if url.startswith("https://h") else -1
        own = f"https://h{host}.com/" + "a/" * (host % 5)
        return url.startswith("https://h7") or (0 <= host < 100_000 and url.startswith(own))

    found = L.within_prefixes(table, "dst", wide.unionByName(extra))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((r for r in rows if allowed(r[0], r[1])), key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "StartsWith" not in plan
    few = {(r.dataset, r.prefix) for r in L.shortest_prefixes(extra).collect()}
    assert few == {("d", "https://h7"), ("e", ""), ("f", "http")}


def test_a_step_moves_one_sum_per_target_and_sorts_nothing(spark):
    pages = spark.range(300).select("id", F.lit(0).cast("long").alias("code"), F.lit(0.001).alias("base"), F.lit(7).cast("long").alias("out"), F.lit(1 / 300).alias("pr"))
    links = spark.range(2100).select((F.col("id") % 300).alias("src"), (F.col("id") * 31 % 290).alias("dst"))
    with fixed_layout(spark, 4), settings(spark, spark__sql__execution__replaceHashWithSortAgg="true"):
        layout = R._lay_out(links, None, 500, 4).persist()
        step = R._next_state(cut(pages.repartition(4, "id")), layout, ["src"], None, 500, 0.1)
        plan = step._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        ranks = {r.id: r.pr for r in step.collect()}
        layout.unpersist()
    # partial sums run over the sorted links, without a table of all targets, and carry no state of pages
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "SortAggregate(key=[dst" in plan.replace(" ", "")
    assert "max(" not in plan
    want = {}
    for i in range(2100):
        want[i * 31 % 290] = want.get(i * 31 % 290, 0.0) + 1 / 300 / 7
    assert len(ranks) == 300 and all(abs(ranks[i] - 0.001 - 0.9 * want.get(i, 0.0)) < 1e-12 for i in range(300))
