"""Markup and pattern functions over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.bindings.common import Registry, table
from plumbline.functions import text
from plumbline.functions.scalars import BLANKS

R = Registry()

_LINK = '(?:href|src)="(/[^"]+)"'
_ORIGIN = "^(https?://[^/]+)"


@R.bind(
    "visible_text",
    f"""select page_id, regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{BLANKS}+', ' ', 'g') as text
        from pages""",
)
def visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.visible_text("html").alias("text"))


@R.bind(
    "escaped_text",
    """select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'),
              '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as text from documents""",
)
def escaped_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.html_escape("text").alias("text"))


@R.bind(
    "page_links",
    f"""with found as (
            select page_id, regexp_extract(url, '{_ORIGIN}', 1) as origin,
                   regexp_extract_all(html, '{_LINK}', 1) as all_links from pages
        ),
        once as (
            select page_id, origin,
                   list_filter(all_links, lambda x, i: list_position(all_links, x) = i) as links from found
        )
        select page_id, len(links) as n,
               array_to_string(list_transform(
                   list_concat(list_filter(links, lambda x: contains(x, 'th')),
                               list_filter(links, lambda x: not contains(x, 'th'))),
                   lambda x: origin || x), ' ') as links
        from once""",
)
def page_links(spark, sf):
    origin = F.regexp_extract("url", _ORIGIN, 1)
    links = text.extract_links("html", _LINK, "th", origin)
    rows = table(spark, sf, "pages").select("page_id", links.alias("l"))
    return rows.select("page_id", F.size("l").cast("bigint").alias("n"), F.array_join("l", " ").alias("links"))


@R.bind(
    "title_lang_pair",
    """select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
              regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang
       from pages
       where regexp_matches(html, '<title>([^<]*)</title>') and regexp_matches(html, '<html lang="([a-z]+)"')""",
)
def title_lang_pair(spark, sf):
    pair = text.extract_pair("html", "<title>([^<]*)</title>", '<html lang="([a-z]+)"')
    rows = table(spark, sf, "pages").select("page_id", pair.alias("p")).where("p is not null")
    return rows.select("page_id", F.col("p.a").alias("title"), F.col("p.b").alias("lang"))
