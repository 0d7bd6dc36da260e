import re
from collections import Counter
from itertools import combinations

from callsieve.llm import urls

PAGES = "page_id long, url string, host string, verdict int"
LABELS = "doc_id long, quality int, toxic int, url string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match("[^?#]*", rest[len(host) :])[0]


def by_hand(url):
    host, path = split(url)
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


CASES = [
    "http://a.com/x",
    "http://a.com",
    "HTTPS://Example.COM/en/1",
    "http://www.example.com/en/1?x=/en/",
    "http://m.www.example.com/en/",
    "http://notexample.com/en/",
    "http://blog.example.com/en",
    "http://x.net/es/1#a",
    "http://net/fr/",
    "http://x.net?/fr/",
    "a://b://c.com/d",
    "no scheme.com/",
    "",
    None,
    "http://É.com/é/",
    "://x.net/fr/\n2",
    "http://a.org/p?q=1&r&=2",
    "http://a.org/" + "p/" * 5000,
]


def test_hosts_paths_and_rules(frame):
    pages = frame([(i, u, "h", 1) for i, u in enumerate(CASES)] + [(None, CASES[0], "", 1), (1, CASES[0], "", 1)], PAGES)
    got = urls.judge_urls(pages, frame([], LABELS)).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        url = CASES[0] if r.page_id is None or (r.page_id == 1 and r.path) else CASES[r.page_id]
        assert (r.host, r.path) == split(url)
        rule, verdict = by_hand(url)
        assert (r.rule, r.verdict) == (rule, verdict or "allow")


def tokens(url):
    host, path = split(url)
    if url is None or "://" not in url:
        return set()
    parts = host.split(".")
    out = {"scheme:" + url.split("://")[0]} | {"host:" + ".".join(parts[i:]) for i in range(len(parts))}
    out |= {"path:" + s for s in re.sub("[0-9]+", "0", path).split("/") if s}
    query = re.match(r"[^?#]*\?([^#]*)", url)
    return out | {"query:" + p.split("=")[0] for p in (query[1] if query else "").split("&") if p.split("=")[0]}


def test_rules_and_verdicts_by_brute_force(frame):
    pages = [(i, f"http{'s' * (i % 2)}://h{i % 3}.example.org/{'ab'[i % 2]}/{i}" + "?ad=1" * (i % 5 == 0)) for i in range(200)]
    bad = {i: i % 5 == 0 and i % 2 == 0 or i % 17 == 0 for i in range(120)}
    support, confidence = 0.05, 0.7
    baskets = [tokens(u) | ({urls.BAD} if bad[i] else set()) for i, u in pages if i in bad]
    sets = Counter(frozenset(c) for b in baskets for n in range(1, len(b) + 1) for c in combinations(sorted(b), n))
    often = {s: n for s, n in sets.items() if n >= support * len(baskets)}
    want = {}
    for s, n in often.items():
        rest = s - {urls.BAD}
        if urls.BAD in s and rest and n / often[rest] >= confidence:
            want[rest] = n / often[rest]
    labelled = frame([(u, bad[i]) for i, u in pages if i in bad] + [(None, True)], "url string, bad boolean")
    rules = urls.mine_rules(labelled, support, confidence).collect()
    assert want and {frozenset(r.antecedent): round(r.confidence, 9) for r in rules} == {
        k: round(v, 9) for k, v in want.items()
    }
    assert all(often[frozenset([r.anchor])] == min(often[frozenset([t])] for t in r.antecedent) for r in rules)
    labels = frame([(i, 1, int(b), "") for i, b in bad.items()], LABELS)
    options = {"support": support, "confidence": confidence}
    table = frame([(i, u, "", 0) for i, u in [*pages, (999, None)]], PAGES)
    for r in urls.judge_urls(table, labels, **options).collect():
        url = dict(pages).get(r.page_id)
        best = max((c for rule, c in want.items() if rule <= tokens(url)), default=None)
        assert r.verdict == (by_hand(url)[1] or ("block" if best else "allow"))
        assert (r.confidence and round(r.confidence, 9)) == (best and round(best, 9))


def test_empty_pages(frame):
    assert urls.judge_urls(frame([], PAGES), frame([(1, 1, 1, "")], LABELS)).count() == 0
