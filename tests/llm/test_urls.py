import random
from fnmatch import fnmatchcase

from palisade.llm import urls

SCHEMA = "page_id long, url string, html string, host int, path int, verdict int, found string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", 1, 2, 3, "f") for i, u in rows], SCHEMA)


def slow(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in urls.SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    bad = any(fnmatchcase(host + path, g) for g in urls.BLOCK_GLOBS)
    return host, path, rule and rule.name, rule.verdict if rule else "block" if bad else "allow"


def test_matches_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.com", "www.Example.com", "a.example.com", "notexample.com", "x.net", "net", "com", "xcom", "free-bets.org", "ünï.de", ""]
    paths = ["", "/", "/en/", "/en", "/EN/", "/es/1", "/fr/?q", "/en/casino", "/a/www.example.com/en/", "/x.exe", "/x.exe?y", "/ads/1#t", "#f", "?q=/en/"]
    rows = [(i, rng.choice(["http://", "https://", "", "://"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(400)]
    rows += [(None, "http://x.net/es/"), (1, None), (2, ""), (3, "http://x.org/" + "a" * 20_000 + "/casino"), (4, "http://a://b/c"), (4, "http://a://b/c")]
    got = urls.judge_urls(pages(spark, rows)).collect()
    key = lambda t: tuple((x is None, x or "") if not isinstance(x, int) else (False, str(x)) for x in t)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *slow(u)) for i, u in rows), key=key)


def test_automaton_against_fnmatch():
    rng = random.Random(2)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randrange(9))) for _ in range(60)] + ["", "*", "**", "a" * 70, "*" + "b" * 70 + "*"]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(200)] + ["a" * 70, "a" + "b" * 70 + "a"]
    fits = urls.Automaton([g.encode() for g in globs]).matches([t.encode() for t in texts])
    for t, row in zip(texts, fits):
        assert row.tolist() == [fnmatchcase(t, g) for g in globs], t


def test_empty(spark):
    assert urls.judge_urls(pages(spark, [])).collect() == []
