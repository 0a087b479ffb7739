"""Tags of WARC conversions against a scanner, character by character."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.llm import warc


def without_tags(page: str) -> str:
    """``page`` without <b ...> and </b ...>; quotes count after an equals sign, at most one space between them."""
    out, i = [], 0
    while i < len(page):
        at = i + 2 if page.startswith("</", i) else i + 1
        if page[i] != "<" or at >= len(page) or page[at] != "b":
            out.append(page[i])
            i += 1
            continue
        i, quote, after = at + 1, "", ""
        while i < len(page) and (quote or page[i] != ">"):
            c = page[i]
            if quote:
                quote = "" if c == quote else quote
                after = "x"
            elif c in "'\"" and after in ("=", "= "):
                quote = c
            else:
                after = c if c == "=" else "= " if c == " " and after == "=" else "x"
            i += 1
        i += 1
    return "".join(out)


def test_tags_end_outside_of_quotes(spark):
    rng = random.Random(11)
    pages = ["".join(rng.choice(["<b", "</b", ">", '"', "'", "=", " ", "1", "<", "b"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    pages = [" ".join(p.split(" ")).replace("  ", " ").replace("  ", " ") for p in pages]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").select("i", warc.bare_text(F.col("p")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [without_tags(p) for p in pages]


@pytest.mark.parametrize("page,text", [
    ('<p title="a > b">one</p>', "one"), ("<p title='a > b' id = \"x>y\">one</p>two", "one\ntwo"), ("a<i title=it's>b</i>c", "abc"),
    ('<a href="x>one</a> two', ""), ('<a title="<p>">one</a>', "one"), ("1 < 2 <b>3", "1 < 2 3"), ("x<br/>y<p", "x\ny"), ('<img alt="5 > 4" src=a>z', "z"),
])
def test_conversions_and_their_sql(spark, tmp_path, page, text):
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses_from_pages(pages)).collect()
    assert [r.block for r in rows if r.warc_type == "conversion"] == [text]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1::BIGINT AS page_id, 'u' AS url, ? AS html", [page])
    found = con.execute(warc.ORACLE_SQL).fetchall()
    assert sorted((f[0], f[7]) for f in found) == sorted((r.warc_type, r.block_digest) for r in rows)


def test_long_tags_take_linear_time(spark):
    pages = ["<a " + "x=\"y>\" " * 200_000 + ">end", "<a x='" * 100_000, "<p =" * 200_000, '<b t="' + ">" * 1_000_000]
    began = time.time()
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, p string").select("i", warc.bare_text(F.col("p")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["end", "", "\n", ""] and time.time() - began < 20
