"""URL rules against trying every rule on every URL."""

import random
import re

from casewright.llm import url_filter as U

SCHEMA = "page_id long, url string"


def plain(url, hosts=U.HOST_RULES, patterns=U.PATTERN_RULES):
    if url is None or "://" not in url:
        host = rest = path = ""
    else:
        after = url.split("://", 1)[1]
        cut = min([k for k in map(after.find, "/?#") if k >= 0], default=len(after))
        host, rest = re.sub("[A-Z]+", lambda m: m[0].lower(), after[:cut]), after[cut:]
        path = re.split("[?#]", rest)[0]
    fits = [r for r in hosts if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = min(fits, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
        return host, path, best.text, best.verdict
    block = any(p.verdict == "block" and re.search(p.pattern, f"{host}\0{rest}") for p in patterns)
    return host, path, None, "block" if block else "allow"


def test_random_and_odd_urls(spark):
    rng = random.Random(6)
    part = lambda: rng.choice(["example", "org", "com", "fr", "de", "es", "en", "1", "12", "ORG", "x", "myexample", "tracker", "login"])
    urls = [None, "", "example.org/es/", "://", "http://", "http://org", "http://org/", "http://ORG/es/", "http://example.org?x=/es/", "http://a.example.org:80/es/"]
    urls += ["http://example.org/en/1", "http://example.org/en/1x#y", "http://a://b/c", "http://x.com/de/?utm_source=a", "http://x.net/?utm_source=a", "http://İ.org/\n/x"]
    for _ in range(1500):
        host = ".".join(part() for _ in range(rng.randrange(1, 4)))
        path = "".join("/" + part() for _ in range(rng.randrange(4)))
        urls.append(f"{rng.choice(['http', ''])}://{host}{path}{rng.choice(['', '/', '?utm_source=f', '#top', '?a=1&sessionid=3', '.html'])}")
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id]), urls[r.page_id]
    # The index spares most expressions: no rule is tried on every URL.
    assert sum(r.n_tried for r in got) < 0.3 * len(got) * (len(U.HOST_RULES) + len(U.PATTERN_RULES))
    assert all(r.tokens for r in (*U.HOST_RULES, *U.PATTERN_RULES))


def test_many_rules_are_found_through_rare_tokens(spark):
    hosts = [U.HostRule("block", f"site{k}.example", "/") for k in range(300)]
    rows = [(k, f"https://www.site{k}.example/p") for k in range(350)]
    got = U.judge_urls(spark.createDataFrame(rows, SCHEMA), hosts, ()).collect()
    assert all((r.verdict == "block") == (r.page_id < 300) and r.n_tried <= 1 for r in got)


def test_a_hundred_thousand_rules(spark):
    hosts = [U.HostRule("block", f"site{k}.example", "/") for k in range(100_000)]
    rows = [(k, f"https://www.site{k * 97}.example/p") for k in range(1_200)]
    got = U.judge_urls(spark.createDataFrame(rows, SCHEMA), hosts).collect()
    assert all((r.verdict == "block") == (r.page_id * 97 < 100_000) for r in got)
    assert sum(r.n_tried for r in got) <= 2 * len(got)


def test_alternatives_have_tokens_of_their_own(spark):
    urls = ["http://x.net/login", "http://x.net/logout.php", "http://x.net/a/login?b", "http://x.net/loginx", "http://x.net/xlogout/", "http://x.net/LOGIN"]
    urls += ["http://a.adserver.net/", "http://a.tracker.net/", "http://adserver.net/", "http://a.tracker/", "http://a.TRACKER.net/p", "http://x.net/.tracker."]
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), SCHEMA)).collect()
    assert [r.verdict for r in sorted(got, key=lambda r: r.page_id)] == [plain(u)[3] for u in urls]


def test_a_very_long_url(spark):
    url = "http://example.org/en/" + "a/" * 400_000 + "?utm_source=x"
    [r] = U.judge_urls(spark.createDataFrame([(1, url)], SCHEMA)).collect()
    assert (r.host, len(r.path), r.rule, r.verdict) == ("example.org", 800_004, "org/", "allow")


def test_repeats_empty_and_clashing(spark):
    rows = [(1, "http://org/", "h"), (1, "http://org/", "h"), (None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", host string")
    assert sorted(str(r.rule) for r in U.judge_urls(docs).collect()) == ["None", "org/", "org/"]
    assert U.judge_urls(docs.limit(0)).collect() == []
