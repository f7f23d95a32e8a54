import re

import numpy as np

from turnstone.llm.url_rules import Automaton, Rule, judge_urls

GLOBS = ["*.shop.test/en/**", "a?c*d", "**", "x" * 70 + "*", "é?/*", "*/x/**", ""]
TEXTS = ["", ".shop.test/en/", ".a.shop.test/en/x/y", ".shop.test/fr/", "abcd", "aéczzd", "a/cd", "abc/d", "x" * 70, "x" * 71, "x" * 69, "éü/q", "u/x/", "/x/y/z"]


def by_regex(glob, text):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    shown = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    return re.fullmatch("".join(shown.get(p, re.escape(p)) for p in parts), text) is not None


def test_all_globs_at_once_match_as_one_by_one():
    machine = Automaton.of(GLOBS)
    data = [t.encode() for t in TEXTS]
    sizes = np.array([len(d) for d in data])
    ends = machine.ends(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for (word, bit), glob in zip(machine.accept, GLOBS):
        for state, text in zip(ends, TEXTS):
            assert bool(int(state[word]) >> bit & 1) == by_regex(glob, text), (glob, text)


def test_longest_rule_wins_and_odd_urls_get_the_default(spark):
    rows = [(1, "https://WWW.Shop.test/en/a?x"), (2, "https://shop.test/fr"), (3, None), (4, "no scheme"), (5, "ftp://myshop.test/en/"),
            (6, "http://shop.test"), (6, "http://shop.test"), (None, "http://q.shop.test/en/#t"), (7, "http://shop.test/" + "a" * 30000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, rule string")
    rules = [Rule("allow", "shop.test/"), Rule("block", "shop.test/en/"), Rule("allow", "www.shop.test/en/")]
    got = judge_urls(pages, rules, default="block").collect()
    assert len(got) == len(rows)
    found = {r.page_id: (r.host, r.rule, r.verdict) for r in got}
    assert found[1] == ("www.shop.test", "www.shop.test/en/", "allow")
    assert found[2] == ("shop.test", "shop.test/", "allow")
    assert found[3] == found[4] == ("", None, "block")
    assert found[5] == ("myshop.test", None, "block")
    assert found[6] == ("shop.test", None, "block")
    assert found[None] == ("q.shop.test", "shop.test/en/", "block")
    assert found[7][1] == "shop.test/"
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}
