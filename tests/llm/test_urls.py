import random
import re

from tracemill.llm import urls as U


def plain(url):
    host, path = "", ""
    if url is not None and "://" in url:
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for h, p, v in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, *best
    hit = any(re.search(r.pattern, (host.replace("\n", "\x01") + "\n" + path).lower()) for r in U.PATTERN_RULES)
    return host, path, None, "block" if hit else "allow"


def test_every_url_is_judged_as_by_all_rules(spark):
    rng = random.Random(5)
    hosts = ["example.org", "a.example.org", "notexample.org", "ORG", "x.org:80", "b.com", "com", "spam-farm.example.net", "cheap-pills.example.com", "Casino.net", "casinoroyale.net", "é.net", "", "a\nb.org", "x\norg", "spam\n.example.com", "user:pw@example.org", "example.org:8080", "a\n.com\n", "\norg", ".org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123", "/en/2", "/fr/x", "/FR/", "/de/1?x#y", "?q=/de/", "#/fr/", "/login", "/a/login.php", "/loginx", "/wp-admin/x", "/a\n/login"]
    urls = [None, "", "no scheme", "://", "http:/x", "a://b://c.org/", "http://spam.com/fr/"] + [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}" for h in hosts for p in paths]
    urls += ["http://example.org/en/1"] * 300 + ["http://x.net/" + "a/" * 5000]
    pages = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = U.judge(pages, U.rule_table(spark, U.HOST_RULES + U.PATTERN_RULES)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(urls[r.page_id or 0]), urls[r.page_id or 0]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://example.org/es/")], "page_id long, url string")
    rules = U.rule_table(spark, U.HOST_RULES)
    assert U.judge(pages.limit(0), rules).collect() == []
    assert [r.verdict for r in U.judge(pages, rules.limit(0)).collect()] == ["allow"]


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = U.judge(pages, U.rule_table(spark, U.HOST_RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_case_is_a_flag_and_not_a_rank(spark):
    pages = spark.createDataFrame([(1, "http://a.net/LOGIN")], "page_id long, url string")
    for rank in (1, 1000):
        assert [r.verdict for r in U.judge(pages, U.rule_table(spark, (U.pattern_rule("/login", ("login",), rank=rank),))).collect()] == ["block"]
    cased = U.Rule("/login", ("login",), "block", 1, None, True)
    assert [r.verdict for r in U.judge(pages, U.rule_table(spark, (cased,))).collect()] == ["allow"]


def test_filter_lines():
    def fits(line, url):
        r = U.filter_rule(line)
        host, _, path = url.partition("/")
        subject = host + "\n" + ("/" + path if _ else "")
        found = re.search(r.pattern, subject) is not None
        assert not found or set(r.tokens) <= set(U._tokens(subject)), line
        return found

    assert fits("||ads.example.com^", "ads.example.com/x") and fits("||ads.example.com^", "a.ads.example.com") and not fits("||ads.example.com^", "bads.example.com/") and not fits("||ads.example.com^", "ads.example.com.org/")
    assert fits("||example.com/ads/", "example.com/ads/1") and not fits("||example.com/ads/", "example.com/x/ads/1")
    assert fits("/banner/*/img^", "x.org/banner/a/img/b") and not fits("/banner/*/img^", "x.org/banner/img/b") and not fits("/banner/*/img^", "x.org/banner/a/imgs")
    assert fits("/ad-frame.|", "x.org/ad-frame.") and not fits("/ad-frame.|", "x.org/ad-frame.html")
    assert U.filter_rule("@@||good.org^").verdict == "allow" and U.filter_rule("@@||good.org^").rank == 2
    for line in ("", "! note", "[Adblock]", "x.org##.ad", "||a.com^$script", "*", "ads*", "|http://a.b", "^"):
        assert U.filter_rule(line) is None, line


def test_thousands_of_rules_equal_all_rules_against_all_urls(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("ad", "track", "shop", "blog", "news", "img") for b in range(60)]
    lines = [f"||{rng.choice(words)}.{rng.choice(['com', 'org'])}^" for _ in range(1500)] + [f"/{rng.choice(words)}/{rng.choice(words)}/" for _ in range(1000)] + [f"@@||{rng.choice(words)}.com/{rng.choice(words)}/" for _ in range(300)] + ["||com^"] * 2
    rules = tuple(r for r in map(U.filter_rule, lines) if r)
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice(words)}.{rng.choice(['com', 'org', 'net'])}/" + "/".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")

    def slow(url):
        host, _, path = url.removeprefix("http://").partition("/")
        hit = [r for r in rules if re.search(r.pattern, (host + "\n/" + path).lower())]
        return max(hit, key=lambda r: r.rank).verdict if hit else "allow"

    want = list(map(slow, urls))
    assert 20 < want.count("block") < 280
    table = U.rule_table(spark, rules)
    for small in (U.SMALL_RULES, 10):
        monkeypatch.setattr(U, "SMALL_RULES", small)
        assert [r.verdict for r in U.judge(pages, table).orderBy("page_id").collect()] == want
