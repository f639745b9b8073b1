"""What pages' parsers find in the whole table of pages, against patterns over the same markup."""

import html
import re

from corvane.operators import lexical_queries
from corvane.sources import pages

VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"


def plain(markup):
    """The text of a piece of markup: a blank for each opening tag but those of elements without content."""
    markup = re.sub(rf"<(?:{VOID})\b[^>]*>|</[^>]*>", "", markup)
    return " ".join(html.unescape(re.sub(r"<[A-Za-z][^>]*>", " ", markup)).split())


def sections_of(markup):
    markup = re.sub(r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "", markup or "")
    pieces = re.split(r"(?i)<(h[1-4])\b[^>]*>", markup)
    out = []
    for k in range(2, len(pieces), 2):
        heading, _, text = re.sub(r"(?i)</h[1-4]>", "\0", pieces[k], count=1).partition("\0")
        out.append((plain(heading), plain(text)))
    return out


def given(spark, sf_dir):
    return {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()}


def test_sections_of_all_pages(spark, sf_dir):
    want = {(i, k, h, t) for i, markup in given(spark, sf_dir).items() for k, (h, t) in enumerate(sections_of(markup))}
    assert len(want) > 20
    assert {tuple(r) for r in lexical_queries.sections(spark, sf_dir).collect()} == want


def test_labelled_sections_of_all_pages(spark, sf_dir):
    texts = given(spark, sf_dir)
    labels = sorted({h for markup in texts.values() for h, _ in sections_of(markup)})[::3]
    found = pages.labelled(lexical_queries.sections(spark, sf_dir), "page_id", labels).collect()
    want = set()
    for i, markup in texts.items():
        ranked = [(labels.index(h), k, h, t) for k, (h, t) in enumerate(sections_of(markup)) if h in labels]
        if ranked:
            want.add((i, *min(ranked)[2:]))
    assert {tuple(r) for r in found} == want


def test_links_of_all_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {x for markup in given(spark, sf_dir).values() for x in re.findall(r'href="([^"]+)"', markup or "") if re.search(r"^/[a-z]+$", x)}
    assert {r["link"] for r in pages.links(rows, "^/[a-z]+$").collect()} == want
