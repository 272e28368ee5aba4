"""Link-graph queries over all links of the pages, against brute force."""

import re
from collections import Counter

import pytest

from sitegrain import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def edges(spark):
    found = set()
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", r.url)
        host = host[1].lower() if host else ""
        found |= {(host, host + href) for href in re.findall(r'<a\s[^>]*href="([^"]*)"', r.html or "", re.I | re.S)}
    return found


def _rows(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def test_every_link_counts(spark, edges):
    outs, ins = Counter(s for s, _ in edges), Counter(t for _, t in edges)
    nodes = set(outs) | set(ins)
    assert {(r.url, r.in_degree, r.out_degree, r.is_orphan) for r in _rows(spark, "gra01_degrees")} == {(u, ins[u], outs[u], not ins[u]) for u in nodes}
    ranks = {u: 1.0 for u in nodes}
    for _ in range(20):
        lost = sum(r for u, r in ranks.items() if not outs[u])
        moved = {u: 0.15 + 0.85 * lost / len(nodes) for u in nodes}
        for a, b in edges:
            moved[b] += 0.85 * ranks[a] / outs[a]
        delta, ranks = sum(abs(moved[u] - ranks[u]) for u in nodes), moved
        if delta < 1e-4:
            break
    top = max(ranks.values())
    assert {(r.url, r.authority) for r in _rows(spark, "gra03_authority")} == {(u, int(1 + 99 * r / top + 0.5)) for u, r in ranks.items()}
    for kind, degree in (("hub", outs), ("authority", ins)):
        best = sorted(degree.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted((r.rn, r.url, r.degree) for r in _rows(spark, "gra04_hubs") if r.kind == kind) == [(i + 1, u, n) for i, (u, n) in enumerate(best)]
    assert [(r.n_nodes, r.n_orphans) for r in _rows(spark, "agg13_graph_metrics")] == [(len(nodes), len(nodes - set(ins)))]
    members = {(r.url, r.direction, r.other, r.set_size) for r in _rows(spark, "gra10_link_sets")}
    assert members == {(b, "in", a, ins[b]) for a, b in edges} | {(a, "out", b, outs[a]) for a, b in edges}
