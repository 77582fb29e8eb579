"""URL filter against a plain version."""

import re
from collections import Counter, defaultdict

from bitloom.llm.urls import RULES, UNIT, filter_urls

SCHEMA = "page_id long, url string, html string, id string, host string, path string, rule string, part string, a string, b string, kind string"
SPACE = " \t\r\n\f"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.split("[?#]", rest[len(host):])[0]


def rule_of(host, path, rules):
    fits = [r for _, r in rules for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=len, default=None)


def plain(rows, rules=RULES, rounds=20, owners=True):
    verdicts = {r: v for v, r in rules}
    pages = [(key, *parts(url), html) for key, url, html in rows]
    links = set()
    for _, host, _, html in pages:
        for link in re.findall(f"<[aA][{SPACE}][^>]*?[hH][rR][eE][fF][{SPACE}]*=[{SPACE}]*[\"']?([^\"'{SPACE}>]+)", html or ""):
            if target := re.match("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)", link):
                links.add((host, "".join(c.lower() if c.isascii() else c for c in target[1])))
    links = {(a, b) for a, b in links if a and a != b}
    if owners:
        for host in {h for _, h, _, _ in pages if h} | {x for e in links for x in e}:
            names = host.split(".")
            if len(host) <= 253 and not re.search(r"(^|\.)[0-9]+(:[0-9]*)?\Z", host):
                for k in range(len(names) - 2):
                    a, b = ".".join(names[k:]), ".".join(names[k + 1:])
                    links |= {(a, b), (b, a)}
    count, mass = Counter(h for _, h, _, _ in pages if h), [Counter(), Counter()]
    for _, host, path, _ in pages:
        if rule := rule_of(host, path, rules):
            mass[verdicts[rule] == "block"][host] += UNIT
    total = []
    for new, arcs in zip(mass, (links, {(b, a) for a, b in links}), strict=True):
        out = defaultdict(list)
        for a, b in arcs:
            out[a].append(b)
        come = Counter(new)
        for _ in range(rounds):
            moved = Counter()
            for a, m in new.items():
                for b in out[a]:
                    moved[b] += m * 17 // (20 * len(out[a]))
            new = moved
            come.update(new)
        total.append(come)
    found = []
    for key, host, path, _ in pages:
        rule = rule_of(host, path, rules)
        trust, distrust = (t[host] if host else 0 for t in total)
        method = "block" if host and distrust > trust and 2 * distrust >= count[host] * UNIT else "allow"
        found.append((key, host, path, rule, verdicts[rule] if rule else method, trust, distrust))
    return found


ROWS = [
    (1, "http://a.example.com/de/1", '<a href="https://Bad.example.com/de/2">x</a> <A class=y HREF = //c.org/>'),
    (2, "https://bad.example.com/de/1?x#y", None), (3, "https://bad.example.com/DE/1", ""), (4, "https://bad.example.com/de/", '<a href="/en/3">'),
    (5, "https://friend.io/x", "<a\nhref='https://bad.example.com/de/1'>y</a><a href='mailto:x@y.z'>"),
    (6, "https://good.org/fr/", '<a href="https://liked.io">'), (7, "https://LIKED.io?q", '<a href=http://bad.example.com:80/>'),
    (8, "net/", None), (9, None, '<a href="http://x.net/">'), (None, "http://x.net", "text"), (None, "http://x.net/", "text"),
    (10, "http://www.example.net/en/", None), (11, "http://myexample.net/en/", None), (12, "://", None), (13, "http://1.2.3.4/de/", '<a href="//b..c/">'),
    (14, "http://.net/", None), (15, "http://é.ORG/fr/É", '<a href="http://ÉÀ.net/#">'), (1, "http://a.example.com/de/1", None),
    (16, "http://" + "l." * 200 + "com/", None), (17, "http://k.b.a.example.com/", "<p>" * 100_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefgh") for r in rows], SCHEMA)


def test_verdicts(spark):
    for rows, options in ((ROWS, {}), (ROWS, {"owners": False}), (ROWS, {"rounds": 1}), (ROWS * 3, {}),
                          (ROWS, {"rules": [("block", "bad.example.com/"), ("allow", "com/"), ("block", "a.example.com/de/1")]})):
        found = filter_urls(frame(spark, rows), **options).collect()
        assert sorted(map(tuple, found), key=str) == sorted(plain(rows, **options), key=str)
    verdicts = {r[0]: r[4] for r in plain(ROWS)}
    assert verdicts[5] == "block" and verdicts[6] == "allow"  # links to a blocked host; trusted


def test_nothing(spark):
    assert filter_urls(frame(spark, [])).isEmpty()
    alone = filter_urls(frame(spark, [(1, "http://a.b/c", None), (1, "http://a.b/c", None)])).collect()
    assert [tuple(r) for r in alone] == [(1, "a.b", "/c", None, "allow", 0, 0)] * 2
