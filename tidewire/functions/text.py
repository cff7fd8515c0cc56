"""Text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import BLOCK_TAGS, EMPTY_SENTENCES, ENTITIES, MOBILE_AGENTS, NOISE_LINES, TITLE_PREFIXES

#: White space of any script.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def normalize_title(title: Column) -> Column:
    prefix = "|".join(TITLE_PREFIXES)
    return strip(F.regexp_replace(strip(F.lower(F.coalesce(title, F.lit("")))), f"^({prefix})", ""))


def decode_entities(text: Column) -> Column:
    """Six entities in a fixed order (the ampersand first, so that doubly encoded ones are decoded); other named ones become a blank."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, "&[a-zA-Z]+;", " ")


def without_tags(html: Column) -> Column:
    """Ends of blocks, breaks and rules become line ends; other tags go."""
    html = F.regexp_replace(html, f"(?i)</({'|'.join(BLOCK_TAGS)})>", "\n")
    html = F.regexp_replace(html, r"(?i)<[bh]r\s*/?>", "\n")
    return F.regexp_replace(html, "<[^>]+>", "")


def fallback_text(html: Column) -> Column:
    """The plain text of a page when no main content is found."""
    html = F.regexp_replace(html, r"(?i)<script[^>]*>[\s\S]*?</script>", "")
    html = F.regexp_replace(html, r"(?i)<style[^>]*>[\s\S]*?</style>", "")
    return decode_entities(without_tags(html))


def strip_html(html: Column, unescape) -> Column:
    """Feed markup as text. ``unescape``: decodes all entities (a pandas UDF), or ``decode_entities``."""
    text = unescape(without_tags(html))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), "\n{3,}", "\n\n")
    return strip(text)


def clean_noise_lines(text: Column) -> Column:
    """Lines trimmed, noise lines dropped, blank lines collapsed."""
    lines = F.transform(F.split(text, "\n"), strip)

    def keep(line: Column) -> Column:
        return (line == "") | ~line.rlike("|".join(f"(?:{p})" for p in NOISE_LINES))

    return strip(F.regexp_replace(F.array_join(F.filter(lines, keep), "\n"), "\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Sentences of at least three word characters, in order."""
    marked = F.regexp_replace(F.regexp_replace(text, r"\n\s*\n", " ¶ "), "\n", " ")
    parts = F.transform(F.split(marked, r"(?<=[。！？.!?])\s*"), strip)
    real = F.filter(parts, lambda s: (s != "") & (s != "¶") & s.rlike(r"(?:[\p{L}\p{N}_][^\p{L}\p{N}_]*+){3}"))
    return F.transform(real, lambda s: F.replace(F.replace(s, F.lit("¶ "), F.lit("")), F.lit("¶"), F.lit("")))


def is_meaningful(sentence: Column) -> Column:
    low = strip(F.lower(sentence))
    return (F.length(low) >= 15) & ~low.rlike("|".join(f"(?:{p})" for p in EMPTY_SENTENCES))


def useful_sentences(text: Column) -> Column:
    return F.filter(sentences(text), is_meaningful)


def cjk_ratio(text: Column) -> Column:
    size = F.length(text)
    return F.when(size > 0, F.length(F.regexp_replace(text, r"[^\x{4e00}-\x{9fff}]", "")) / size).otherwise(0.0)


def is_cjk(text: Column, within: int | None = None) -> Column:
    """Over 30 % Chinese characters, in the first ``within`` characters or all."""
    return cjk_ratio(F.left(text, F.lit(within)) if within else text) > 0.3


def ellipsis(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def plain_words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+)"), F.lit(1))


def han_runs(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(r"([\x{4e00}-\x{9fff}]+)"), F.lit(1))


def kept_words(words: Column, stop_words: tuple[str, ...]) -> Column:
    return F.array_except(F.filter(words, lambda w: F.length(w) > 1), F.array(*map(F.lit, stop_words)))


def tokens(text: Column, stop_words: tuple[str, ...]) -> Column:
    """The distinct lower-case words of more than one character that aren't stop words; runs of Chinese characters give their bigrams.

    Bigrams stand in for Chinese words where no dictionary is given; ``segment.tokens_of_all`` takes one.
    """
    low = F.lower(text)
    pairs = F.flatten(F.transform(han_runs(low), lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return kept_words(F.concat(plain_words(low), pairs), stop_words)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / any_)


def hue(name: Column) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(name, F.lit("")).cast("binary")), 1, 6), 16, 10).cast("int") % 360).cast("int")


def iso_week(day: Column) -> Column:
    return F.format_string("%dW%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def week_range(day: Column) -> Column:
    monday = F.date_trunc("week", day)
    return F.concat(F.date_format(monday, "yyyy.MM.dd"), F.lit(" - "), F.date_format(F.date_add(monday.cast("date"), 6), "yyyy.MM.dd"))


def cve_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Za-z0-9_])(CVE-\d{4}-\d{4,8})(?![A-Za-z0-9_])"), F.lit(1))


def join_url(base: Column, link: Column) -> Column:
    return F.when(F.startswith(link, F.lit("/")) & (base != ""), F.concat(F.regexp_replace(base, "/+$", ""), link)).otherwise(link)


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


#: White space as readers of reports split on it.
BLANK = r"[\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
BREAK = "</p><p>"


def linked(html: Column) -> Column:
    """Escaped text with its vulnerability numbers marked and its addresses linked."""
    marked = F.regexp_replace(html, r"(?i)(?<![A-Za-z0-9_])CVE-\d{4}-\d{4,8}(?![A-Za-z0-9_])", "<code>$0</code>")
    return F.regexp_replace(marked, f"https?://[^{BLANK[1:-1]}<]+", '<a href="$0" target="_blank" rel="noopener">$0</a>')


def summary_html(text: Column) -> Column:
    """A summary as paragraphs of HTML: '' for none. Its blank lines, and ends of sentences before a line's end, divide it; in a text of one line each
    Chinese sentence is a paragraph, and each other one that a capital or an opening quote follows."""
    html = linked(escape_html(text))
    one_line = F.regexp_replace(F.regexp_replace(html, f"([。！？]){BLANK}*", f"$1{BREAK}"), rf"([.!?]){BLANK}+(?=[A-Z\"'「『])", f"$1{BREAK}")
    many = F.regexp_replace(html, r"\n{2,}", BREAK)
    for end in (".!?", "。！？"):
        many = F.regexp_replace(many, rf"([{end}]){BLANK}*\n{BLANK}*", f"$1{BREAK}")
    many = F.regexp_replace(many, r"\n+", " ")
    inner = F.when(F.contains(html, F.lit("\n")), many).otherwise(one_line)
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit("<p>"), inner, F.lit("</p>")))


def feed_body(content: Column, summary: Column, description: Column, unescape=decode_entities) -> Column:
    """An entry's text: its full content unless that is blank, else its summary, and its description where it has no summary."""
    full = strip(F.coalesce(content, F.lit("")))
    return strip_html(F.when(full != "", full).otherwise(strip(F.coalesce(summary, description, F.lit("")))), unescape)


def is_mobile(agent: Column) -> Column:
    """Whether a user agent names a mobile device; null for null."""
    return F.lower(agent).rlike("|".join(MOBILE_AGENTS))
