"""Bodies of sources as items: one transform for each format, from (ord, source columns, xml_text) rows.

All read the body with an explicit schema and explode it: malformed bodies give no item. ``register`` adds a format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.rules import TYPE_LABEL
from tidewire.functions.text import decode_entities, strip, strip_html

from . import schemas

Parser = Callable[[DataFrame], DataFrame]
PLATFORMS: dict[str, Parser] = {}
#: Formats of single sources, by their names, for API rows whose platform has none.
NAMED: dict[str, Parser] = {}
KEPT = ("ord", "source_name", "language", "type")
STRINGS = "array<string>"

# Formats of the items' texts
SUMMARY_CHARS = 500
STIX_TYPES = ("attack-pattern", "malware", "tool", "intrusion-set", "campaign")
UNKNOWN = "未知"
DRAFT_LABELS = {"state": "状态: ", "level": "标准级别: ", "group": "工作组: "}
DRAFT_CATEGORIES = ("IETF", "标准草案")
RELEASE_CATEGORIES = ("工具发布", "GitHub")
LANGUAGE_LABEL, TOPICS_LABEL = " | 语言: ", " | 标签: "
NEWS_URL = "https://www.secrss.com/articles/"
DRAFT_URL = "https://datatracker.ietf.org/doc/"
REPO_URL = "https://github.com/"
POST_URL = "https://aisle.com/blog/"


def register(platform: str) -> Callable[[Parser], Parser]:
    def add(parser: Parser) -> Parser:
        PLATFORMS[platform] = parser
        return parser

    return add


def register_source(name: str, parser: Parser) -> None:
    NAMED[name] = parser


def text(c) -> Column:
    return F.coalesce(c, F.lit(""))


def nonempty(*columns) -> Column:
    """The first of the columns that isn't empty, else ''."""
    return F.coalesce(*(F.when(text(c) != "", c) for c in columns), F.lit(""))


def names(people: Column) -> Column:
    return F.coalesce(F.filter(F.transform(people, lambda p: p["name"]), lambda n: n.isNotNull() & (n != "")), F.array().cast(STRINGS))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast(STRINGS)


def items(rows: DataFrame, title: Column, url: Column, summary: Column, date: Column, authors=None, categories=None, source_type: str | None = None, body=None) -> DataFrame:
    """The common item columns, from rows with an exploded entry and its pos."""
    label = F.create_map(*(F.lit(x) for kv in TYPE_LABEL.items() for x in kv))
    known = F.element_at(label, text(F.col("type")))
    return rows.select(
        "ord", "pos", title.alias("title"), url.alias("url"), summary.alias("summary"), text(date).alias("published_date"), "source_name", "language",
        (F.lit(source_type) if source_type else F.coalesce(known, F.lit("API"))).alias("source_type"),
        (authors if authors is not None else strings()).alias("authors"), (categories if categories is not None else strings()).alias("categories"),
        (body if body is not None else F.lit(None).cast("string")).alias("full_body"),
    )


def entries(raw: DataFrame, schema: str, array: Callable[[Column], Column], test: Callable[[Column], Column] | None = None) -> DataFrame:
    body = raw.withColumn("b", F.from_json("xml_text", F.lit(schema)))
    if test is not None:
        body = body.where(test(F.col("b")))
    return body.select(*KEPT, F.posexplode(array(F.col("b"))).alias("pos", "e"))


@register("news")
def news(raw: DataFrame) -> DataFrame:
    rows = entries(raw, schemas.NEWS, lambda b: b["data"], lambda b: b["code"] == "10000").where(strip(text(F.col("e.title"))) != "")
    return items(rows, strip(F.col("e.title")), F.concat(F.lit(NEWS_URL), text(F.col("e.id"))), strip(text(F.col("e.summary"))), F.col("e.published_at"))


@register("scholar")
def scholar(raw: DataFrame) -> DataFrame:
    rows = entries(raw, schemas.SCHOLAR, lambda b: b["data"]).where(strip(text(F.col("e.title"))) != "")
    return items(rows, strip(F.col("e.title")), text(F.col("e.url")), nonempty(F.col("e.abstract"), F.col("e.title")), F.col("e.publicationDate"), names(F.col("e.authors")))


@register("drafts")
def drafts(raw: DataFrame) -> DataFrame:
    rows = entries(raw, schemas.DRAFTS, lambda b: b["objects"]).where(strip(text(F.col("e.title"))) != "")
    name, title = text(F.col("e.name")), strip(F.col("e.title"))
    part = lambda label, c: F.when(text(c) != "", F.concat(F.lit(label), c))
    summary = F.concat_ws(
        " | ",
        F.concat(F.lit(DRAFT_LABELS["state"]), F.coalesce("e.state", F.lit(UNKNOWN))),
        part(DRAFT_LABELS["level"], F.col("e.intended_std_level")),
        part(DRAFT_LABELS["group"], F.col("e.group")),
    )
    url = F.when(name != "", F.concat(F.lit(DRAFT_URL), name, F.lit("/"))).otherwise("")
    return items(rows, F.when(name != "", F.concat(name, F.lit(" - "), title)).otherwise(title), url, summary, F.col("e.time"), categories=strings(*DRAFT_CATEGORIES))


@register("stix")
def stix(raw: DataFrame) -> DataFrame:
    """Objects of five types, the first of each name in a body."""
    name_of = lambda e: strip(text(e["name"]))

    def firsts(b: Column) -> Column:
        fit = F.filter(F.transform(b["objects"], lambda e, i: F.struct(name_of(e).alias("n"), i.alias("i"), e["type"].isin(*STIX_TYPES).alias("fits"))), lambda x: x["fits"] & (x["n"] != ""))
        # in the order of names and places, the first of each name
        first = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["n"] != x["n"])), lambda x: x["i"]))
        places = F.get(F.transform(F.array(F.array_sort(fit)), first), 0)
        return F.transform(places, lambda i: F.get(b["objects"], i))

    rows = entries(raw, schemas.STIX, firsts)
    name = strip(text(F.col("e.name")))
    link = F.get(F.filter("e.external_references", lambda r: (r["source_name"] == "mitre-attack") & (text(r["url"]) != "")), 0)["url"]
    summary = F.when(text(F.col("e.description")) != "", F.left("e.description", F.lit(SUMMARY_CHARS))).otherwise(name)
    title = F.concat(F.lit("[MITRE "), F.col("e.type"), F.lit("] "), name)
    return items(rows, title, text(link), summary, F.col("e.modified"), categories=F.array(F.col("e.type"), F.lit("MITRE ATT&CK")))


def repo_summary(e: Column, full_name: Column, stars: bool) -> Column:
    topics = F.slice(F.coalesce(e["topics"], strings()), 1, 5)
    base = F.when(text(e["description"]) != "", F.left(e["description"], F.lit(SUMMARY_CHARS))).otherwise(full_name)
    counted = F.concat(F.lit(" | stars: "), F.coalesce(e["stargazers_count"], F.lit(0)), F.lit(LANGUAGE_LABEL), nonempty(e["language"], F.lit(UNKNOWN)))
    tags = F.when(F.size(topics) > 0, F.concat(F.lit(TOPICS_LABEL), F.array_join(topics, ", "))).otherwise("")
    return F.concat(base, counted if stars else F.lit(""), tags)


def owner(e: Column) -> Column:
    return F.when(e["owner"].isNotNull(), F.array(text(e["owner"]["login"]))).otherwise(strings())


@register("repo_search")
def repo_search(raw: DataFrame) -> DataFrame:
    rows = entries(raw, schemas.REPO_SEARCH, lambda b: b["items"])
    e, name = F.col("e"), strip(text(F.col("e.full_name")))
    rows = rows.where(name != "")
    url = F.coalesce("e.html_url", F.concat(F.lit(REPO_URL), name))
    return items(rows, name, url, repo_summary(e, name, True), e["created_at"], owner(e), F.slice(F.coalesce(e["topics"], strings()), 1, 5))


@register("repo")
def repo(raw: DataFrame) -> DataFrame:
    """A body that is one repository."""
    rows = entries(raw, f"struct<{schemas.REPO}>", F.array).where(text(F.col("e.full_name")) != "")
    e, name = F.col("e"), F.col("e.full_name")
    url = F.coalesce("e.html_url", F.concat(F.lit(REPO_URL), name))
    return items(rows, name, url, repo_summary(e, name, False), e["created_at"], owner(e), F.slice(F.coalesce(e["topics"], strings()), 1, 5), "GitHub Repo")


@register("releases")
def releases(raw: DataFrame) -> DataFrame:
    rows = entries(raw, schemas.RELEASES, lambda b: b)
    e, name = F.col("e"), nonempty(F.col("e.name"), F.col("e.tag_name"))
    rows = rows.where(name != "")
    parts = F.split(text(e["html_url"]), "/")
    hint = F.when(F.contains(text(e["html_url"]), F.lit("github.com")) & (F.size(parts) >= 5), F.concat(F.get(parts, 3), F.lit("/"), F.get(parts, 4)))
    title = F.when(hint.isNotNull(), F.concat(F.lit("["), hint, F.lit("] "), name)).otherwise(name)
    summary = F.when(text(e["body"]) != "", F.left(e["body"], F.lit(SUMMARY_CHARS))).otherwise(F.concat(F.lit("Release "), name))
    author = F.when(e["author"].isNotNull(), F.array(text(e["author"]["login"]))).otherwise(strings())
    return items(rows, title, text(e["html_url"]), summary, e["published_at"], author, strings(*RELEASE_CATEGORIES), "GitHub Release")


@register("posts")
def posts(raw: DataFrame) -> DataFrame:
    """Bodies {items|data|docs: [{title, slug, content, publishedAt}]}."""
    entry = "array<struct<title:string,slug:string,content:string,publishedAt:string>>"
    rows = entries(raw, f"struct<items:{entry},data:{entry},docs:{entry}>", lambda b: F.coalesce(b["items"], b["data"], b["docs"]))
    rows = rows.where("e.title is not null and e.slug is not null")
    return items(rows, F.col("e.title"), F.concat(F.lit(POST_URL), "e.slug"), F.left(text(F.col("e.content")), F.lit(SUMMARY_CHARS)), F.col("e.publishedAt"), source_type="API")


#: An RSS item or an Atom entry. Spark reads tags by their names as they are written, prefix and all: a prefixed tag never stands in for a plain one.
ENTRY = (
    "array<struct<title:string,`dc:title`:string,link:array<struct<_VALUE:string,_href:string,_rel:string>>,`atom:link`:array<struct<_href:string,_rel:string>>,"
    "guid:struct<_VALUE:string,_isPermaLink:string>,description:string,summary:string,content:string,`content:encoded`:string,pubDate:string,published:string,issued:string,"
    "updated:string,modified:string,`dc:date`:string,`dcterms:issued`:string,`dcterms:modified`:string,author:array<struct<name:string>>,category:array<struct<_term:string>>>>"
)
#: RSS 0.9x and 2.0 have items in the channel, RSS 1.0 beside it, Atom has entries.
FEED = f"struct<channel:struct<item:{ENTRY}>,item:{ENTRY},entry:{ENTRY}>"
DATES = ("pubDate", "published", "issued", "dcterms:issued", "updated", "modified", "dcterms:modified", "dc:date")
FEED_TAG = r"(?i)<(rss|feed|rdf:RDF|atom:feed)[\s>]"
#: Feed dates as RFC 822 writes them, without the weekday, which Spark's parser doesn't take: day and time, seconds if any, zone.
RFC822 = r"^(?:\w{3},\s*)?(\d{1,2} \w{3} \d{4} \d{2}:\d{2})(:\d{2})?\s*(GMT|UTC|UT|Z|[A-Z]{3}|[+-]\d{4})?$"
# The named zones of RFC 822
ZONES = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def feed_date(value: Column) -> Column:
    """Naive UTC as ISO text; '' if it can't be read. A zone of another name counts as UTC."""
    part = lambda k: F.regexp_extract(text(value), RFC822, k)
    day, seconds, zone = part(1), part(2), part(3)
    named = F.element_at(F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv)), zone)
    offset = F.when(zone.rlike(r"^[+-]"), zone).otherwise(F.coalesce(named, F.lit("+0000")))
    stamp = F.try_to_timestamp(F.concat(day, F.when(seconds != "", seconds).otherwise(":00"), F.lit(" "), offset), F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.try_to_timestamp(text(value))
    return text(F.date_format(F.coalesce(F.when(day != "", stamp), iso), "yyyy-MM-dd'T'HH:mm:ss"))


def linked(*links: Column) -> Column:
    """The address of the first link to the entry itself, in the text or in href; without one, any first href."""
    own = lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"
    href = lambda links, test: F.get(F.filter(F.transform(F.filter(links, test), lambda x: strip(text(x["_href"]))), lambda h: h != ""), 0)
    written = F.get(F.filter(F.transform(links[0], lambda x: strip(text(x["_VALUE"]))), lambda v: v != ""), 0)
    return F.coalesce(written, *(href(x, own) for x in links), *(href(x, lambda _: F.lit(True)) for x in links[:1]), F.lit(""))


def feed(raw: DataFrame, unescape=decode_entities) -> DataFrame:
    """RSS items (0.9x, 2.0 and 1.0) and Atom entries, in one reading of the body. full_body: the content, if there is one and it differs from the summary.

    An entry without a link has its guid's address, unless that says it is none. Dates are those of publication, else of the last change.
    """
    clean = lambda c: strip_html(text(c), unescape)
    body = F.col("xml_text")
    # a feed whose tags all have the prefix of Atom is read without prefixes
    read = F.when(body.rlike(r"(?i)<atom:feed[\s>]"), F.from_xml(body, FEED, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})).otherwise(F.from_xml(body, FEED, {"mode": "PERMISSIVE"}))
    found = raw.where(body.rlike(FEED_TAG)).withColumn("b", read)
    rows = found.select(*KEPT, F.posexplode(F.coalesce("b.entry", "b.channel.item", "b.item")).alias("pos", "e"))
    e = F.col("e")
    guid = F.when(F.lower(text(e["guid"]["_isPermaLink"])) != "false", strip(text(e["guid"]["_VALUE"])))
    full, short = clean(nonempty(e["content:encoded"], e["content"])), clean(nonempty(e["description"], e["summary"], e["content:encoded"], e["content"]))
    dates = F.filter(F.array(*(e[c] for c in DATES)), lambda d: strip(text(d)) != "")
    date = F.coalesce(F.get(F.filter(F.transform(dates, feed_date), lambda d: d != ""), 0), F.lit(""))
    terms = F.filter(F.transform(e["category"], lambda c: c["_term"]), lambda t: t.isNotNull() & (t != ""))
    people = F.filter(names(e["author"]), lambda n: strip(n) != "")
    url = nonempty(linked(e["link"], e["atom:link"]), guid)
    # behind a generator each is computed once
    told = F.struct(strip(nonempty(e["title"], e["dc:title"])).alias("_title"), url.alias("_url"), short.alias("_short"), full.alias("_full"), date.alias("_date"), people.alias("_people"), F.coalesce(terms, strings()).alias("_terms"))
    rows = rows.select(*KEPT, "pos", F.inline(F.array(told)))
    t, full = F.col, F.col("_full")
    return items(rows, t("_title"), t("_url"), t("_short"), t("_date"), t("_people"), t("_terms"), body=F.when((full != "") & (full != t("_short")), full))


PLATFORMS["papers"] = feed


def parse_all(raw: DataFrame, unescape=decode_entities) -> DataFrame:
    """Items of all raw rows (schema RAW_ITEMS and ord), in (ord, pos).

    Failed and empty rows go, as do API rows that neither their platform nor their source's name gives a parser. A row without a type is
    a feed. Each format is one branch over its own rows.
    """
    good = raw.where("(error is null or error = '') and xml_text is not null and xml_text != ''")
    kind, platform = F.coalesce("type", F.lit("rss")), text(F.col("api_platform"))
    branches = [feed(good.where(~kind.isin("api", "scraper")), unescape)]
    branches += [parser(good.where((kind == "api") & (platform == name))) for name, parser in PLATFORMS.items()]
    branches += [parser(good.where((kind == "api") & ~platform.isin(*PLATFORMS) & (F.col("source_name") == name))) for name, parser in NAMED.items()]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def unreadable(raw: DataFrame) -> Column:
    """Whether a body can't be read: a feed that is no well-formed RSS or Atom, an API's answer that is no JSON. Papers are feeds."""
    kind, platform, body = F.coalesce("type", F.lit("rss")), text(F.col("api_platform")), F.col("xml_text")
    damaged = F.from_xml(body, "_damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})["_damaged"].isNotNull()
    feed_like = body.rlike(FEED_TAG)
    is_feed = ~kind.isin("api", "scraper") | ((kind == "api") & (platform == "papers"))
    return F.when(is_feed, ~feed_like | damaged).when(kind == "api", F.try_parse_json(body).isNull()).otherwise(F.lit(False))


def parse_with_errors(raw: DataFrame, at: Column, unescape=decode_entities) -> DataFrame:
    """The items with parse_time and parse_error, and a row without title, at pos -1, for each fetched body that can't be read.

    Bodies are judged row by row: nothing is exchanged. ``at`` is a parameter: results don't depend on when they are computed.
    """
    when = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    found = parse_all(raw, unescape).withColumns({"parse_time": when, "parse_error": F.lit(False)})
    bad = raw.where("(error is null or error = '') and xml_text is not null and xml_text != ''").where(unreadable(raw))
    empty, none = F.lit(""), F.lit(-1)
    rows = items(bad.withColumn("pos", none), empty, empty, empty, empty).withColumns({"parse_time": when, "parse_error": F.lit(True)})
    return found.unionByName(rows, allowMissingColumns=True)
