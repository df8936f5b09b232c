from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import urls
from tidewire.llm.queries import URL_RULES


def brute(url):
    host, path = urls.split_url(url)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


HOSTS = st.sampled_from(["example.org", "a.example.org", "ORG", "x.org", "notorg", "com", "b.COM", "net", "", "org:80", ".org", "org."])
URLS = st.one_of(st.none(), st.text(max_size=12), st.builds(lambda s, h, p, q: f"{s}://{h}{p}{q}", st.sampled_from(["http", "", "a"]), HOSTS, st.sampled_from(["", "/", "/es/", "/es", "/en/1", "/en/12", "/fr/x", "/de/", "/DE/"]), st.sampled_from(["", "?a=/b", "#://c", "://z.org/"])))


def test_every_kind_of_url(spark):
    kept = []

    @settings(max_examples=400, deadline=None)
    @given(URLS)
    def gather(u):
        kept.append(u)

    gather()
    kept = [u for u in kept if u is None or "\ud800" > max(u, default="a")] + [None, "http://EXAMPLE.org/es/?x", "://org/"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(kept)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, URL_RULES).collect()}
    assert got == {k: brute(u) for k, u in enumerate(kept)}


def test_no_rows_and_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert urls.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert urls.judge_urls(df, []).first()["verdict"] == "allow"
    assert urls.judge_urls(df, [("block", "org", "/"), ("allow", "org", "/")]).first()["verdict"] == "block"


def test_collisions_are_told_apart(tmp_path):
    urls.write_digests([("block", "a", "/"), ("allow", "b", "/x")], str(tmp_path / "d"))
    found = urls.DigestArray(str(tmp_path / "d"))
    for k in range(2):
        assert found.confirm(k, found.keys[k], b"c", b"/") is None
