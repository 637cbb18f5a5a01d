import re

import pytest

from parallax.llm import common
from parallax.llm import urlfilter as uf

URLS = [
    "https://a.example.com/en/1", "http://Example.COM/en/72?x=1", "http://com/en/", "http://notcom/en/", "http://x.net/de/8", "http://example.net/de/81",
    "https://b.org/es", "https://b.org/es/#top", "ftp://spam-farm.example.org/fr", "http://spamfarm.org/", "http://x.org/spam_farm", "http://a://b.com/en/",
    "no scheme", "", None, "http://", "http://xcom/en/", "http://cheap-pills.net/de/8", "HTTP://WWW.ORG/ES/", "http://a.b/CASINO", "http://a.b/Free-Download?x", "http://a.b/freedownload", "http://a.com/EN/1", "http://line\nbreak.com/en/\n?q",
]


def brute(url):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
    fits = []
    for r in uf.RULES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.name), r.name, r.block))
    if fits:
        _, name, block = max(fits)
        return host, path, name, "block" if block else "allow"
    return host, path, None, "block" if any(re.search(r.pattern, host + path) for r in uf.PATTERNS) else "allow"


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge(pages).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS + URLS)}


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_long_lists_by_tables(spark, monkeypatch, broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    many = uf.RULES + uf.PATTERNS + tuple(uf.host_rule(f"never{i}.org/x", True) for i in range(300)) + (uf.Rule("digits", r"z+\d", (), True, 0),)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS + ["http://q.com/zz9"])], "page_id long, url string, path string")
    got = uf.judge(pages, many)
    few = uf.judge(pages, uf.RULES + uf.PATTERNS + many[-1:])
    assert got.columns == few.columns and sorted(map(str, got.collect())) == sorted(map(str, few.collect()))
    assert uf.judge(pages.limit(0), many).count() == 0


def test_host_rules_without_a_path_end_with_the_host(spark):
    urls = ["http://example.com", "http://example.com/", "https://a.b.example.com/x?q", "http://example.com.evil.org/", "http://notexample.com/", "http://example.com#x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r["verdict"] for r in uf.judge(pages, (uf.host_rule("example.com", True),)).orderBy("page_id").collect()]
    assert got == ["block", "block", "block", "allow", "allow", "block"]


def test_rules_of_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# a list\nblock com/en/\nallow example.com # not this one\n\nblock word spam farm\n")
    rules = uf.read_rules(spark, str(tmp_path / "rules.txt"))
    assert rules == (uf.host_rule("com/en/", True), uf.host_rule("example.com", False), uf.word_rule("spam", "farm"))
    for bad in ("deny x", "block", "block word", "block a b"):
        with pytest.raises(ValueError):
            uf.rules_of([bad])


def test_empty_table_and_rules_without_tokens(spark):
    pages = spark.createDataFrame([(1, "http://q.com/zz9"), (2, "http://q.com/")], "page_id long, url string")
    rule = uf.Rule("digits", r"z+\d", (), True, 0)
    assert [r["verdict"] for r in uf.judge(pages, (rule,)).orderBy("page_id").collect()] == ["block", "allow"]
    assert uf.judge(pages.limit(0)).count() == 0
    assert [r["verdict"] for r in uf.judge(pages, ()).collect()] == ["allow", "allow"]


def test_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/", "s", "w")], "page_id long, url string, _site string, _won string")
    got = uf.judge(pages).first()
    assert (got["_site"], got["_won"], got["verdict"]) == ("s", "w", "block")


def test_only_candidates_run(spark):
    """A rule whose token no url has is not fetched."""
    pages = spark.createDataFrame([(1, "http://q.com/a")], "page_id long, url string")
    trap = uf.Rule("trap", "(", ("neverseen",), True, 0)
    assert uf.judge(pages, (trap,)).collect()[0]["verdict"] == "allow"


def test_words_ignore_case_and_paths_do_not(spark):
    urls = ["http://a.b/CASINO", "http://a.b/Free-Download", "http://SPAM.farm/", "http://a.com/EN/x", "http://a.com/en/x"]
    got = uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [(None, "block")] * 3 + [(None, "allow"), ("com/en/", "block")]
