import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, url_rules
from ledgerloom.llm.common import table

from .conftest import SMALL

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows):
    """doc_id and text rows to sorted (doc_id, n_lines, n_dropped, kept sha256)."""
    rank = lambda d: -1 if d is None else d
    key = lambda line: line.translate(FOLD).strip(" \t\n\x0b\x0c\r")
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(rank(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < 3 or rank(d) == max(held[key(x)])]
        out.append((rank(d), len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def digest(df, **how):
    out = line_dedup.drop_lines(df, **how).select(F.coalesce("row.doc_id", F.lit(-1)), "n_lines", "n_dropped", F.sha2("kept_text", 256))
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("slice_rows", [2, 1000])
def test_lines_of_the_small_table(docs, slice_rows):
    assert digest(docs, slice_rows=slice_rows) == by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("slice_rows", [1, 1000])
def test_odd_rows_lose_the_right_lines(odd, slice_rows):
    assert digest(odd, slice_rows=slice_rows) == by_hand([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_deduped_documents_keep_their_columns(odd, nothing):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    row = out.where("doc_id = 4").first()
    assert (row["text"], row["n_chars"], row["slice"]) == ("short", 5, "own slice")
    assert out.where("doc_id = 1").first()["text"] is None
    assert line_dedup.dedup_lines(nothing).count() == 0


def plain_verdict(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (found[1].translate(FOLD), found[2]) if found else ("", "")
    fits = [r for r in url_rules.SITE_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.verdict
    return host, path, None, "block" if any(re.search(p.regex, (url or "").translate(FOLD)) for p in url_rules.PATTERNS) else "allow"


ODD_URLS = [
    None, "", "no scheme", "HTTP://EXAMPLE.COM/en/x", "https://www.Example.com/en/x?y#z", "http://a.www.example.com/en/", "http://com/", "http://x.com",
    "http://notexample.com/en/1", "http://shop.net/es/", "http://shop.net/ES/", "http://shop.net/es", "http://net/fr/a?b=://q/c", "http://my.casino.org/", "http://x.org/wp-login.php",
    "http://x.org/a.exe", "http://x.org/" + "a/" * 20000, "http://x.net:80/es/", "x://y.cheap-pills.org/?", "http://x.com/\n/en/", "http://shop.net/es/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(ODD_URLS)], "page_id bigint, url string, row string")
    out = url_rules.judge_urls(pages).select("row.page_id", "row.row", "host", "path", "rule", "verdict").orderBy("page_id").collect()
    assert [tuple(r)[2:] for r in out] == [plain_verdict(u) for u in ODD_URLS] and {r["row"] for r in out} == {"own"}
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
    given = table(spark, SMALL, "pages")
    got = {r[0]: tuple(r)[1:] for r in url_rules.judge_urls(given).select("row.page_id", "host", "path", "rule", "verdict").collect()}
    assert got == {r.page_id: plain_verdict(r.url) for r in given.collect()}


def test_rules_are_filed_under_whole_tokens():
    assert url_rules.literal_tokens(url_rules.Rule("example.com", "/en", "block")) == ("example", "com")
    assert url_rules.literal_tokens(url_rules.Rule("example.com", "/en/", "block")) == ("example", "com", "en")
    assert url_rules.literal_tokens(url_rules.Rule("com", "", "block")) == ("com",)
