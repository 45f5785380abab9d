"""Verdicts of a neighbourhood don't depend on the size of the corpus around it."""

from quillstone.llm import urlgraph


def test_small_shares_and_far_hosts_are_blocked(spark):
    """One blocked page among 1e9 others taints those who link to it, and a chain of links carries that on beyond twelve steps."""
    seeds = spark.createDataFrame([("big.com", 1e9), ("bad.com", 1.0)], "host string, weight double")
    chain = ["bad.com"] + [f"h{i}.net" for i in range(15)]
    links = spark.createDataFrame([(a, b, 1) for a, b in zip(chain, chain[1:])], "src string, dst string, n long")
    got = {r.host: r["rank"] for r in urlgraph.propagate(links, seeds, urlgraph.Scratch(spark, "t")).collect()}
    assert all(got[h] > 0 for h in chain) and all(got[b] / got[a] > 0.8 for a, b in zip(chain, chain[1:]))
    pages = [(0, "http://bad.com/", "")] + [(i + 1, f"http://{b}/", f'<a href="http://{a}/">') for i, (a, b) in enumerate(zip(chain, chain[1:]))]
    pages += [(50, "http://good.org/", '<a href="http://fine.net/">'), (51, "http://fine.net/", ""), (52, "http://alone.net/", "")]
    rules = [("bad.com", "/", "block"), ("good.org", "/", "allow")]
    by = {r.page_id: r for r in urlgraph.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert [by[i].verdict for i in range(16)] == ["block"] * 16 and {by[i].verdict for i in (50, 51, 52)} == {"allow"}


def test_one_rare_seed_does_not_outweigh_many(spark):
    """A host that 200 trusted hosts link to, with one bad link of 51, stays allowed; who links to the bad one alone is blocked."""
    pages = [(i, f"http://t{i}.org/", '<a href="http://hub.net/">') for i in range(200)] + [(i + 200, f"http://t{i}.org/more", "") for i in range(200)]
    links = "".join(f'<a href="http://f{i}.net/">' for i in range(50)) + '<a href="http://bad.com/">'
    pages += [(500, "http://hub.net/", links), (501, "http://bad.com/", ""), (502, "http://shill.net/", '<a href="http://bad.com/">'), (502, "http://shill.net/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = urlgraph.judge(df, [("org", "/", "allow"), ("bad.com", "/", "block")]).collect()
    assert len(rows) == len(pages)
    by = {r.page_id: r for r in rows}
    assert by[500].verdict == "allow" and by[500].trust > by[500].distrust > 0
    assert by[502].verdict == by[501].verdict == "block"
    assert urlgraph.judge(df.limit(0), [("org", "/", "allow")]).count() == 0
