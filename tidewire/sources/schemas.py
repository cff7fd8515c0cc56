"""Schemas of the engine's tables and of the bodies that sources return; every field is nullable."""

SOURCES = (
    "name string, `group` string, url string, type string, language string, enabled boolean, note string, ssl_verify boolean, api_platform string, "
    "scraper_config struct<article_selector:string,title_selector:string,summary_selector:string,date_selector:string,link_selector:string,link_base:string>"
)
RAW_ITEMS = "source_name string, language string, url string, type string, api_platform string, xml_text string, fetch_time string, error string"
ITEMS = (
    "ord bigint, title string, url string, summary string, published_date string, source_name string, language string, source_type string, "
    "parse_time string, full_body string, authors array<string>, categories array<string>, parse_error boolean"
)

NEWS = "struct<code:string,data:array<struct<id:string,title:string,summary:string,published_at:string>>>"
SCHOLAR = "struct<data:array<struct<title:string,url:string,abstract:string,publicationDate:string,authors:array<struct<name:string>>>>>"
DRAFTS = "struct<objects:array<struct<name:string,title:string,state:string,intended_std_level:string,`group`:string,time:string>>>"
STIX = "struct<objects:array<struct<type:string,name:string,description:string,modified:string,external_references:array<struct<source_name:string,url:string>>>>>"
REPO = "full_name:string,name:string,description:string,topics:array<string>,stargazers_count:int,language:string,html_url:string,created_at:string,pushed_at:string,owner:struct<login:string>"
REPO_SEARCH = f"struct<items:array<struct<{REPO}>>>"
RELEASES = "array<struct<tag_name:string,name:string,body:string,html_url:string,published_at:string,author:struct<login:string>>>"
POSTS = "struct<items:array<struct<title:string,slug:string,summary:string,url:string,published_at:string>>,data:array<struct<title:string,slug:string,summary:string,url:string,published_at:string>>,docs:array<struct<title:string,slug:string,summary:string,url:string,published_at:string>>>"
