import re

import pytest
from pyspark.sql import functions as F

from tracelode.llm import urls
from tracelode.llm.queries import op12_url_filter


def plain(url, vocabulary=urls.Vocabulary()):
    """Verdict and counts by regular expressions and a look at every rule."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    low = re.sub("[A-Z]", lambda c: c.group().lower(), url or "")
    n = {t: len(re.findall(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", low)) for t in vocabulary.weights}
    strict = sum(c for t, c in n.items() if vocabulary.weights[t] >= vocabulary.limit)
    soft = {t: c for t, c in n.items() if c and vocabulary.weights[t] < vocabulary.limit}
    own = "block" if sum(vocabulary.weights[t] for t, c in n.items() if c) >= vocabulary.limit else "allow"
    return host, path, rule, verdict or own, strict, sum(soft.values()), len(soft)


def test_every_page_by_plain_rules(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: tuple(r)[1:] for r in op12_url_filter(spark, sf).collect()}
    assert len(got) == len(pages)
    for r in pages:
        assert got[r["page_id"]] == plain(r["url"]), r["url"]


MADE = [
    "https://ONLINE-Casino.example.org/Path",
    "http://news.example.org/essex/cheaply",
    "http://a.example.org/cheap/free#frag",
    "http://a.example.org/free-free_free",
    "http://a.example.org/pornography",
    "http://a.example.org/éporn/porné",
    "http://porn",
    "no scheme at all/porn",
    "://",
    "http://com/",
    "http://xcom/",
    "http://.com/",
    "http://example.com",
    "http://www.example.com/en/1",
    "http://a.www.example.com/en/1",
    "http://wwww.example.com/en/",
    "http://example.com/en?x",
    "http://EXAMPLE.COM/EN/",
    "http://b.net/es/x://com/",
    "http://user@host.net:80/fr/?q=#f",
    "http://a.example.org/\nx?y",
    "",
]


@pytest.mark.parametrize("url", MADE)
def test_made_urls(url):
    host, path = urls.split(url)
    assert (host, path) == plain(url)[:2]
    assert (urls.Rules(urls.RULES).fitting(host, path) or (None, None))[0] == plain(url)[2]


def test_made_urls_through_spark(spark):
    df = spark.createDataFrame(list(enumerate(MADE)), "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "rule", "verdict")})
    assert [tuple(r)[1:] for r in urls.judge(df).orderBy("page_id").collect()] == [plain(u) for u in MADE]


def test_weights_and_boundaries():
    words = urls.Vocabulary({"bad": 3, "so": 1, "so-so": 1, "meh": 2}, limit=3)
    found = lambda u: sorted(urls.hits(u, words.automaton()))
    assert found("http://x/so-so") == [("so", 1), ("so", 1), ("so-so", 1)]
    assert found("http://x/sos/1so/bad2") == []
    assert found("http://x/%62ad") == [("bad", 3)]
    with pytest.raises(ValueError):
        urls.Vocabulary({"": 1})
    with pytest.raises(ValueError):
        urls.Rules([("maybe", "a", "/")])


def test_odd_urls(spark):
    long = "http://" + "a." * 400_000 + "org/" + "free/" * 400_000
    df = spark.createDataFrame([(1, None), (None, "http://a.org/"), (2, long), (2, "http://x.com/porn"), (2, "http://x.com/porn")], "page_id long, url string").withColumn("html", F.lit("x"))
    got = sorted(map(tuple, urls.judge(df).collect()), key=repr)
    assert [r for r in got if r[0] == 1] == [(1, "", "", None, "allow", 0, 0, 0)]
    assert [r[3:] for r in got if r[0] is None] == [(None, "allow", 0, 0, 0)]
    assert [r[3:] for r in got if r[0] == 2] == [(None, "allow", 0, 400_000, 1)] + [("com/", "allow", 1, 0, 0)] * 2
    assert urls.judge(df.filter("page_id > 9")).count() == 0
