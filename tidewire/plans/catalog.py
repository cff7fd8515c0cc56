"""Every query of the engine's own operators, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.functions.rules import BLOCK_TAGS, BROAD_TYPES, CATEGORY_ORDER, EMPTY_SENTENCES, ENTITIES, NOISE_LINES, REASONS, SAMPLE, SEVERITY, STOP_WORDS, TITLE_PREFIXES, UNCLASSIFIED
from tidewire.operators import dashboard, dedup, extract, health, report, scoring, summary, translate
from tidewire.sources import parse
from tidewire.streaming import feeds

from .fixtures import FETCHES_SQL, ITEMS_SQL, NOW, SOURCES_SQL, fetches, items, sources, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]::VARCHAR[]"


# ---- scoring -------------------------------------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"


def sql_pattern(keyword: str) -> str:
    return quoted(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){keyword}($|[^\p{{L}}\p{{N}}_])") if keyword.isascii() else "NULL"


def keyword_values() -> str:
    rows = []
    for i, k in enumerate(SAMPLE.keywords):
        rule = SAMPLE.ambiguity.get(k.text.lower())
        rows.append(
            f"({i}, {scoring.TIERS.index(k.tier)}, {quoted(k.text)}, {sql_pattern(k.text)}, {str(k.type == 'core').lower()}, {listed(k.categories)}, {listed(k.content_types)}, "
            f"{listed(rule.exclude if rule else ())}, {listed(rule.prefix if rule else ())}, {str(not rule or rule.standalone).lower()}, {SAMPLE.weights[k.tier]}::DOUBLE)"
        )
    return "kw(k, tier, word, pat, core, cats, types, excl, pref, scoring, w) AS (VALUES " + ",\n  ".join(rows) + ")"


M = SAMPLE.multipliers
SEG_SQL = f"""seg AS (
  SELECT ord, title AS seg_title, CASE WHEN trim(summary, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN '' ELSE substr(summary, 1, 200) END AS seg_lead,
    CASE WHEN length(summary) > 400 THEN substr(summary, 201, length(summary) - 400) ELSE substr(summary, 201) END AS seg_body,
    CASE WHEN length(summary) > 400 THEN right(summary, 200) ELSE '' END AS seg_tail FROM items),
txt AS (SELECT *, array_to_string(list_filter([seg_title, seg_lead, seg_body, seg_tail], lambda s: s <> ''), ' ') AS all_text FROM seg)"""


def keyword_hits(select: str) -> str:
    """One branch for each keyword: RE2 compiles a constant pattern once."""
    return " UNION ALL ".join(
        select.format(k=i, hit=f"regexp_matches(t, {sql_pattern(w.text)})" if w.text.isascii() else f"contains(lower(t), {quoted(w.text.lower())})") for i, w in enumerate(SAMPLE.keywords)
    )


CLEAR = "len(list_filter(excl, lambda x: contains(lower({t}), x))) = 0 AND (len(pref) = 0 OR len(list_filter(pref, lambda x: contains(lower({t}), x))) > 0)"
MATCH_SQL = f"""{keyword_values()},
parts AS (
  SELECT ord, 0 AS s, seg_title AS t, {M['title']} AS m FROM txt UNION ALL SELECT ord, 1, seg_lead, {M['lead']} FROM txt
  UNION ALL SELECT ord, 2, seg_body, {M['body']} FROM txt UNION ALL SELECT ord, 3, seg_tail, {M['tail']} FROM txt),
hits AS ({keyword_hits('SELECT ord, {k} AS k, s, m FROM parts WHERE {hit}')}),
best AS (SELECT ord, k, min(s) AS seg, CAST(max(m) AS DOUBLE) AS mult FROM hits GROUP BY ord, k),
mt AS (SELECT best.ord, best.k, best.seg, best.mult, kw.tier, word, core, cats, types, scoring, w
  FROM best JOIN kw USING (k) JOIN txt USING (ord) WHERE {CLEAR.format(t='all_text')})"""
R = SAMPLE.ratios
TIER_SQL = f"""mc AS (SELECT ord, unnest(cats) AS category, k, seg, mult, tier, core, scoring, w FROM mt),
tc AS (
  SELECT ord, category, CASE WHEN count(*) FILTER (scoring AND tier = 0) > 0 THEN 'A' WHEN count(*) FILTER (scoring AND tier = 1 AND core) > 0 THEN 'B'
      WHEN count(*) FILTER (scoring AND tier = 1 AND NOT core) >= 2 THEN 'C' ELSE 'D' END AS tier,
    coalesce(sum(mult * w) FILTER (scoring AND tier = 0), 0) AS s0, coalesce(sum(mult * w) FILTER (scoring AND tier = 1), 0) AS s1,
    coalesce(sum(mult * w) FILTER (scoring AND tier = 2), 0) AS s2 FROM mc GROUP BY ord, category),
ts AS (
  SELECT ord, category, tier, s0 + s1 * CASE tier WHEN 'A' THEN {R['A'][0]} WHEN 'B' THEN {R['B'][0]} WHEN 'C' THEN {R['C'][0]} ELSE 0 END
    + s2 * CASE tier WHEN 'A' THEN {R['A'][1]} WHEN 'B' THEN {R['B'][1]} WHEN 'C' THEN {R['C'][1]} ELSE 0 END AS score FROM tc)"""
NEG = "len(list_filter(" + listed(SAMPLE.negative) + ", lambda x: contains(lower({t}), x))) > 0"
SCORE_SQL = f"""raw AS (
  SELECT txt.ord, coalesce((SELECT sum(score) FROM ts WHERE ts.ord = txt.ord), 0)
    + coalesce((SELECT sum(mult * w) FROM mt WHERE mt.ord = txt.ord AND scoring AND tier > 0 AND len(cats) = 0), 0) AS raw_score,
    coalesce((SELECT sum(mult * w) FROM mt WHERE mt.ord = txt.ord AND scoring), 0) AS flat_raw,
    {NEG.format(t='all_text')} AS negative, EXISTS (SELECT 1 FROM mt WHERE mt.ord = txt.ord AND scoring AND tier = 0) AS strong FROM txt),
sc AS (
  SELECT ord, round(raw_score, 6) AS raw_score, negative, strong,
    CAST(round_even(greatest(least(round(CASE WHEN negative AND NOT strong THEN greatest(least(raw_score, 29.0), 10.0) ELSE raw_score END, 9), 100.0), 0.0), 0) AS INTEGER) AS confidence_score,
    CAST(round_even(greatest(least(round(CASE WHEN negative AND NOT strong THEN greatest(least(flat_raw, 29.0), 10.0) ELSE flat_raw END, 9), 100.0), 0.0), 0) AS INTEGER) AS flat_score FROM raw),
dec AS (SELECT *, CASE WHEN confidence_score >= 50 THEN 'accepted' WHEN confidence_score >= 45 THEN 'review' ELSE 'filtered' END AS filter_decision FROM sc)"""
VOTE_SQL = f"""votes AS (
  SELECT ord, category, sum(CASE WHEN tier = 0 THEN 2 ELSE 1 END) AS v, min((tier * 10 + seg) * 1000 + k) AS first, min(list_position(kc, category)) AS pos
  FROM (SELECT ord, unnest(cats) AS category, cats AS kc, tier, seg, k FROM mt) GROUP BY ord, category),
cat AS (
  SELECT txt.ord, coalesce(category, {quoted(UNCLASSIFIED)}) AS category FROM txt LEFT JOIN (
    SELECT ord, category FROM (
      SELECT v.ord, v.category, row_number() OVER (PARTITION BY v.ord ORDER BY v DESC, first, list_position(cats, v.category)) AS r
      FROM votes v JOIN kw ON kw.k = v.first % 1000) WHERE r = 1) USING (ord))"""


def broad_hits() -> str:
    """One branch for each pattern: RE2 compiles a constant pattern once."""
    out = []
    for i, (name, patterns) in enumerate(BROAD_TYPES.items()):
        for p in patterns:
            end = r"($|[^\p{L}\p{N}_])" if p[-1].isalnum() else r"[\p{L}\p{N}_]"
            hit = f"regexp_matches(all_text, {quoted(r'(?i)(^|[^' + WORD[1:-1] + '])' + p + end)})" if p.isascii() else f"contains(lower(all_text), {quoted(p)})"
            out.append(f"SELECT ord, {i} AS i, {quoted(name)} AS name FROM txt WHERE {hit}")
    return " UNION ALL ".join(out)


BASE = f"WITH {ITEMS_SQL}, {SEG_SQL}, {MATCH_SQL}"
FULL = f"{BASE}, {TIER_SQL}, {SCORE_SQL}"
DECIDED = f"{FULL}, {VOTE_SQL}, sd AS (SELECT dec.*, category FROM dec JOIN cat USING (ord))"


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.matches(scoring.segments(items(spark, sf_dir)))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(items(spark, sf_dir))


@query(
    f"""WITH {ITEMS_SQL}, {keyword_values()},
p AS (SELECT ord, 0 AS s, title AS t, {M['title']} AS m FROM items UNION ALL SELECT ord, 1, substr(summary, 1, 200), {M['lead']} FROM items),
x AS ({keyword_hits('SELECT ord, {k} AS k, t, m FROM p WHERE {hit}')}),
h AS (SELECT ord, tier, w * m AS v FROM x JOIN kw USING (k) WHERE {CLEAR.format(t='t')} AND scoring),
a AS (SELECT i.ord, coalesce(sum(v), 0) AS total, coalesce(bool_or(tier = 0), false) AS strong,
    any_value({NEG.format(t="title || ' ' || summary")}) AS negative FROM items i LEFT JOIN h USING (ord) GROUP BY i.ord),
z AS (SELECT ord, CAST(round_even(greatest(least(round(CASE WHEN negative AND NOT strong THEN least(total, 29.0) ELSE total END, 9), 100.0), 0.0), 0) AS INTEGER) AS stage1_score FROM a)
SELECT ord, stage1_score, stage1_score < 30 AS stage1_drop FROM z"""
)
def quick_score(spark, sf_dir):
    """Flagship: the first stage's score of every item, from title and lead."""
    return scoring.quick_score(items(spark, sf_dir)).select("ord", "stage1_score", "stage1_drop")


@query(f"WITH {ITEMS_SQL}, {SEG_SQL} SELECT ord, seg_title, seg_lead, seg_body, seg_tail, md5(all_text) AS text_md5 FROM txt")
def segment_text(spark, sf_dir):
    return scoring.segments(items(spark, sf_dir)).select("ord", *(f"seg_{s}" for s in scoring.SEGMENTS), F.md5(F.col("all_text").cast("binary")).alias("text_md5"))


@query(f"{BASE} SELECT ord, word, seg, tier FROM mt")
def kw_match(spark, sf_dir):
    return matched(spark, sf_dir).select("ord", F.explode("matched").alias("m")).select("ord", F.col("m.text").alias("word"), "m.seg", "m.tier")


@query(f"{BASE} SELECT ord, word, mult FROM mt")
def kw_max_multiplier(spark, sf_dir):
    return matched(spark, sf_dir).select("ord", F.explode("matched").alias("m")).select("ord", F.col("m.text").alias("word"), "m.mult")


@query(f"{BASE} SELECT word, count(*) AS n FROM mt WHERE word IN ('with', 'la', 'by') GROUP BY word")
def ambiguity_filter(spark, sf_dir):
    hits = matched(spark, sf_dir).select(F.explode("matched.text").alias("word"))
    return hits.where(F.col("word").isin("with", "la", "by")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"{BASE}, {TIER_SQL} SELECT ord, category, tier, round(score, 6) AS score FROM ts")
def tier_score(spark, sf_dir):
    rows = matched(spark, sf_dir).select("ord", F.explode(scoring.tier_scores(F.col("matched"))).alias("t"))
    return rows.select("ord", "t.category", "t.tier", F.round("t.score", 6).alias("score"))


@query(f"{FULL} SELECT ord, flat_score FROM sc")
def flat_score(spark, sf_dir):
    return scoring.score(items(spark, sf_dir), pairing=False).select("ord", F.col("confidence_score").alias("flat_score"))


@query(f"{FULL} SELECT ord, raw_score, negative, confidence_score, filter_decision FROM dec")
def full_score(spark, sf_dir):
    return scored(spark, sf_dir).select("ord", F.round("raw_score", 6).alias("raw_score"), "negative", "confidence_score", "filter_decision")


@query(
    f"""{DECIDED} SELECT count(*) AS total_input, count(*) FILTER (filter_decision = 'accepted') AS total_accepted,
  count(*) FILTER (filter_decision = 'review') AS total_review, count(*) FILTER (filter_decision = 'filtered') AS total_discarded FROM sd"""
)
def decision_split(spark, sf_dir):
    return dashboard.decision_counts(scored(spark, sf_dir))


@query(f"{DECIDED} SELECT ord, filter_decision, CAST(filter_decision = 'review' AS INTEGER) AS kept_rank FROM sd WHERE filter_decision <> 'filtered'")
def kept_items(spark, sf_dir):
    return dashboard.ordered_kept(scored(spark, sf_dir)).select("ord", "filter_decision", "kept_rank")


@query(f"{BASE}, {VOTE_SQL} SELECT ord, category FROM cat")
def category_vote(spark, sf_dir):
    return matched(spark, sf_dir).select("ord", scoring.category_vote(F.col("matched")).alias("category"))


@query(
    f"""{BASE},
b AS (SELECT ord, name, count(*) AS v, 900000 + min(i) AS first FROM ({broad_hits()}) GROUP BY ord, name),
q AS (SELECT ord, name, sum(v) AS v, min(first) AS first FROM (
    SELECT ord, unnest(types) AS name, 1 AS v, (tier * 10 + seg) * 1000 + k AS first FROM mt UNION ALL SELECT ord, name, v, first FROM b) GROUP BY ord, name),
r AS (SELECT ord, name, row_number() OVER (PARTITION BY ord ORDER BY v DESC, first) AS n FROM q)
SELECT txt.ord, coalesce(name, '综合') AS content_type FROM txt LEFT JOIN (SELECT ord, name FROM r WHERE n = 1) USING (ord)"""
)
def content_type_vote(spark, sf_dir):
    return matched(spark, sf_dir).select("ord", scoring.content_type_vote(F.col("matched"), F.col("all_text")).alias("content_type"))


@query(
    f"""{BASE} SELECT txt.ord, coalesce(string_agg(word, ',' ORDER BY word) FILTER (tier = 0), '') AS strong,
  coalesce(string_agg(word, ',' ORDER BY word) FILTER (tier = 1), '') AS medium, coalesce(string_agg(word, ',' ORDER BY word) FILTER (tier = 2), '') AS weak
FROM txt LEFT JOIN mt USING (ord) GROUP BY txt.ord"""
)
def matched_arrays(spark, sf_dir):
    return matched(spark, sf_dir).select("ord", *(F.array_join(scoring.matched_texts(F.col("matched"), t), ",").alias(n) for t, n in enumerate(scoring.TIERS)))


@query(
    f"""{FULL}, used AS (SELECT ord, string_agg(tier, '/' ORDER BY tier) AS u FROM (SELECT DISTINCT ord, tier FROM ts) GROUP BY ord),
c AS (SELECT ord, count(*) FILTER (tier = 0) AS a, count(*) FILTER (tier = 1) AS b, count(*) FILTER (tier = 2) AS c FROM mt GROUP BY ord)
SELECT sc.ord, concat_ws('; ', CASE WHEN a > 0 THEN 'strong=' || a END, CASE WHEN b > 0 THEN 'medium=' || b END, CASE WHEN c > 0 THEN 'weak=' || c END,
  'tiers=' || u, CASE WHEN negative AND NOT strong THEN 'negative clamp' END, 'score=' || confidence_score) AS scoring_reason
FROM sc LEFT JOIN used USING (ord) LEFT JOIN c USING (ord)"""
)
def score_reason(spark, sf_dir):
    return scored(spark, sf_dir).select("ord", "scoring_reason")


# ---- dashboards ----------------------------------------------------------------------------------------------------


@query(
    f"""{FULL} SELECT CAST(b AS INTEGER) AS bucket, count(ord) AS n FROM range(11) t(b)
LEFT JOIN (SELECT ord, least(confidence_score // 10, 10) AS k FROM dec WHERE filter_decision <> 'review') ON k = b GROUP BY b"""
)
def score_histogram(spark, sf_dir):
    return dashboard.score_histogram(scored(spark, sf_dir))


@query(f"{DECIDED} SELECT category, count(*) AS n, min(ord) AS first_ord FROM sd WHERE filter_decision <> 'filtered' GROUP BY category")
def category_distribution(spark, sf_dir):
    return dashboard.category_distribution(scored(spark, sf_dir))


@query(
    f"""{FULL}, st AS (
  SELECT ord % 10 AS day, count(*) FILTER (filter_decision = 'accepted') AS a, count(*) FILTER (filter_decision = 'filtered') AS d,
    list_transform(range(11), lambda b: len(list_filter(list(CASE WHEN filter_decision <> 'review' THEN least(confidence_score // 10, 10) END), lambda x: x = b))) AS bk
  FROM dec GROUP BY ord % 10),
w AS (SELECT day, CASE WHEN a + d > 0 THEN a * 100.0::DOUBLE / (a + d) ELSE 0 END AS share, bk FROM st),
l AS (SELECT day, share, bk, lag(day) OVER o AS prev_day, lag(share) OVER o AS ps, lag(bk) OVER o AS pb FROM w WINDOW o AS (ORDER BY day))
SELECT day, prev_day, round(share, 6) AS share, round(share - ps, 6) AS share_change, abs(share - ps) >= 5 AS share_flag,
  array_to_string(list_filter(range(11), lambda i: abs(bk[i + 1] - pb[i + 1]) >= 5), ',') AS moved_buckets FROM l WHERE prev_day IS NOT NULL"""
)
def score_drift(spark, sf_dir):
    days = scored(spark, sf_dir).withColumn("day", F.col("ord") % 10)
    return dashboard.drift(dashboard.daily_stats(days))


@query("SELECT source AS source_name, count(*) AS n FROM documents GROUP BY source")
def items_per_source(spark, sf_dir):
    return items(spark, sf_dir).groupBy("source_name").agg(F.count("*").alias("n"))


# ---- expiry and duplicates -------------------------------------------------------------------------------------------


@query(
    f"""WITH {ITEMS_SQL} SELECT ord, published_date FROM items WHERE published_date = '' OR published_date LIKE '%Z'
  OR TRY_CAST(published_date AS TIMESTAMP) IS NULL OR TRY_CAST(published_date AS TIMESTAMP) >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY"""
)
def date_filter(spark, sf_dir):
    return dedup.filter_by_date(items(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("ord", "published_date")


@query(f"WITH {ITEMS_SQL} SELECT ord, url FROM items QUALIFY url = '' OR row_number() OVER (PARTITION BY url ORDER BY ord) = 1")
def url_dedup(spark, sf_dir):
    return dedup.drop_url_duplicates(items(spark, sf_dir)).select("ord", "url")


@query(f"WITH {ITEMS_SQL} SELECT ord, trim(regexp_replace(trim(lower('News: ' || title)), '^({'|'.join(TITLE_PREFIXES)})', '')) AS title FROM items")
def normalize_title(spark, sf_dir):
    return items(spark, sf_dir).select("ord", T.normalize_title(F.concat(F.lit("News: "), "title")).alias("title"))


@query()
def fuzzy_title_clusters(spark, sf_dir):
    unique = dedup.drop_url_duplicates(items(spark, sf_dir))
    clusters = dedup.cluster_titles(unique)
    return dedup.merge_clusters(unique, clusters).select("ord", "title", "merged_sources")


# ---- health --------------------------------------------------------------------------------------------------------

RUNS_SQL = f"""WITH {FETCHES_SQL},
g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY name ORDER BY ts, seq) AS island FROM f)"""
HEALTH_SQL = f"""WITH {FETCHES_SQL},
b AS (SELECT name, count(*) AS total_fetches, count(*) FILTER (failed) AS total_errors, max(ts) FILTER (failed) AS last_error,
  max((ts, seq)) FILTER (NOT failed) AS ok, max(ts) FILTER (NOT failed) AS last_success FROM f GROUP BY name),
hl AS (SELECT b.name, (SELECT count(*) FROM f WHERE f.name = b.name AND failed AND (ok IS NULL OR (f.ts, f.seq) > ok)) AS consecutive_failures,
  total_fetches, total_errors, last_success, last_error FROM b)"""


@query(f"{RUNS_SQL} SELECT name, seq, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY name, island ORDER BY ts, seq) AS BIGINT) AS consecutive_failures FROM g")
def failure_runs(spark, sf_dir):
    return health.running_health(fetches(spark, sf_dir)).select("name", "seq", "consecutive_failures")


@query(
    f"""WITH {FETCHES_SQL} SELECT name, seq, count(*) OVER o AS total_fetches, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER o AS BIGINT) AS total_errors,
  max(CASE WHEN NOT failed THEN ts END) OVER o AS last_success, max(CASE WHEN failed THEN ts END) OVER o AS last_error
FROM f WINDOW o AS (PARTITION BY name ORDER BY ts, seq)"""
)
def health_counters(spark, sf_dir):
    return health.running_health(fetches(spark, sf_dir)).select("name", "seq", "total_fetches", "total_errors", "last_success", "last_error")


@query(f"{HEALTH_SQL} SELECT *, consecutive_failures = 0 AS recovered FROM hl")
def source_health(spark, sf_dir):
    return health.source_health(fetches(spark, sf_dir))


@query(f"{HEALTH_SQL} SELECT name, consecutive_failures FROM hl WHERE consecutive_failures >= 1")
def auto_disabled(spark, sf_dir):
    return health.auto_disabled(health.source_health(fetches(spark, sf_dir)), 1).select("name", "consecutive_failures")


@query(f"{HEALTH_SQL}, {SOURCES_SQL} SELECT src.name, hl.consecutive_failures IS NOT NULL AS skipped FROM src LEFT JOIN hl ON src.name = hl.name AND hl.consecutive_failures >= 1 WHERE enabled")
def sources_to_fetch(spark, sf_dir):
    go, skipped = health.split_sources(sources(spark, sf_dir), health.source_health(fetches(spark, sf_dir)), 1)
    return go.select("name", F.lit(False).alias("skipped")).unionByName(skipped.select("name", F.lit(True).alias("skipped")))


@query(
    f"""{HEALTH_SQL}, {SOURCES_SQL} SELECT hl.name, consecutive_failures + CASE WHEN gone THEN 1 ELSE 0 END AS consecutive_failures, total_errors + CASE WHEN gone THEN 1 ELSE 0 END AS total_errors
FROM (SELECT *, consecutive_failures >= 1 AND name IN (SELECT name FROM src WHERE enabled) AS gone FROM hl) AS hl"""
)
def skipped_as_failures(spark, sf_dir):
    """Sources that were passed over as disabled count as failed once more."""
    log = fetches(spark, sf_dir)
    _, skipped = health.split_sources(sources(spark, sf_dir), health.source_health(log), 1)
    grown = health.with_skipped(log, skipped, F.lit("2100-01-01"))
    return health.source_health(grown).select("name", "consecutive_failures", "total_errors")


def statuses(spark, sf_dir):
    failed = F.col("failed")
    return fetches(spark, sf_dir).select("name", F.when(failed, "error").otherwise("success").alias("status"), F.when(failed, F.concat(F.lit("e"), "seq")).alias("error"), F.struct("ts", "seq").alias("ord"))


@query(f"WITH {FETCHES_SQL} SELECT name, CASE WHEN failed THEN 'error' ELSE 'success' END AS status, CASE WHEN failed THEN 'e' || seq END AS error FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) = 1")
def last_status(spark, sf_dir):
    return health.last_status(statuses(spark, sf_dir))


@query(
    f"""{HEALTH_SQL}, {SOURCES_SQL}, off AS (SELECT name FROM hl JOIN src USING (name) WHERE enabled AND consecutive_failures >= 1),
ls AS (SELECT name, failed FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) = 1)
SELECT count(*) FILTER (NOT failed AND name NOT IN (FROM off)) AS n_success, count(*) FILTER (failed AND name NOT IN (FROM off)) AS n_error, (SELECT count(*) FROM off) AS n_disabled FROM ls"""
)
def fetch_counts(spark, sf_dir):
    """The next run's statuses come after the log: sources that failed at its end are passed over as disabled."""
    _, skipped = health.split_sources(sources(spark, sf_dir), health.source_health(fetches(spark, sf_dir)), 1)
    later = F.struct(F.lit("2999-01-01").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("seq"))
    off = skipped.select("name", F.lit("auto_disabled").alias("status"), F.lit(None).cast("string").alias("error"), later.alias("ord"))
    return dashboard.fetch_counts(health.last_status(statuses(spark, sf_dir).unionByName(off)))


@query(
    f"""{HEALTH_SQL}, {SOURCES_SQL},
ls AS (SELECT name, CASE WHEN failed THEN 'error' ELSE 'success' END AS status, CASE WHEN failed THEN 'e' || seq END AS error FROM f QUALIFY row_number() OVER (PARTITION BY name ORDER BY ts DESC, seq DESC) = 1),
j AS (SELECT src.name, grp, src.ord, coalesce(status = 'success', false) AS ok, error, coalesce(consecutive_failures, 0) AS fails,
  (SELECT count(*) FROM documents WHERE source = src.name) AS n FROM src LEFT JOIN ls ON ls.name = src.name LEFT JOIN hl ON hl.name = src.name WHERE enabled)
SELECT name AS source_name, grp AS "group", CASE WHEN fails >= 3 AND NOT ok THEN CASE WHEN fails >= 5 THEN 'high' ELSE 'medium' END
    ELSE CASE grp {' '.join(f"WHEN {quoted(g)} THEN {quoted(s)}" for g, s in SEVERITY.items())} ELSE 'low' END END AS severity,
  CASE WHEN fails >= 3 AND NOT ok THEN replace({quoted(REASONS['failing'])}, '%d', CAST(fails AS VARCHAR)) WHEN NOT ok THEN {quoted(REASONS['failed'])} ELSE {quoted(REASONS['no_items'])} END AS reason,
  CASE WHEN NOT ok THEN error END AS fetch_error FROM j WHERE n = 0"""
)
def source_alerts(spark, sf_dir):
    state = health.source_health(fetches(spark, sf_dir))
    told = health.source_alerts(sources(spark, sf_dir), health.last_status(statuses(spark, sf_dir)), state, items(spark, sf_dir))
    return told.select("source_name", "group", "severity", "reason", "fetch_error")


# ---- pages and text ------------------------------------------------------------------------------------------------

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def tags_sql(c: str) -> str:
    c = rf"regexp_replace({c}, '(?i)</({'|'.join(BLOCK_TAGS)})>', chr(10), 'g')"
    c = rf"regexp_replace({c}, '(?i)<[bh]r\s*/?>', chr(10), 'g')"
    return f"regexp_replace({c}, '<[^>]+>', '', 'g')"


def entities_sql(c: str) -> str:
    for e, ch in ENTITIES:
        c = f"replace({c}, {quoted(e)}, {quoted(ch)})"
    return f"regexp_replace({c}, '&[a-zA-Z]+;', ' ', 'g')"


SCRIPTLESS = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
FALLBACK = entities_sql(tags_sql(SCRIPTLESS))


@query(f"SELECT page_id, {FALLBACK} AS body FROM pages")
def fallback_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.fallback_text(F.col("html")).alias("body"))


@query(
    f"""WITH l AS (SELECT page_id, list_transform(string_split({FALLBACK}, chr(10)), lambda x: trim(x, {BLANKS})) AS ls FROM pages)
SELECT page_id, trim(regexp_replace(array_to_string(list_filter(ls, lambda x: x = '' OR NOT ({' OR '.join(f"regexp_matches(x, {quoted(p)})" for p in NOISE_LINES)})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS}) AS body FROM l"""
)
def noise_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_noise_lines(T.fallback_text(F.col("html"))).alias("body"))


@query(
    f"""SELECT page_id, trim(regexp_replace(regexp_replace({entities_sql(tags_sql('html'))}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS}) AS body FROM pages"""
)
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html"), T.decode_entities).alias("body"))


@query(
    f"""WITH e AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN '  ' END AS content, CASE WHEN page_id % 2 = 0 THEN url END AS summary FROM pages),
p AS (SELECT e.page_id, CASE WHEN trim(coalesce(content, ''), {BLANKS}) <> '' THEN content ELSE coalesce(summary, html) END AS one FROM e JOIN pages USING (page_id))
SELECT page_id, trim(regexp_replace(regexp_replace({entities_sql(tags_sql(f"trim(one, {BLANKS})"))}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS}) AS body FROM p"""
)
def feed_body(spark, sf_dir):
    """Of every third page the content counts; blank or missing content leaves the summary, or the description."""
    at = F.col("page_id") % 3
    content, summary = F.when(at == 0, F.col("html")).when(at == 1, F.lit("  ")), F.when(F.col("page_id") % 2 == 0, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", T.feed_body(content, summary, F.col("html")).alias("body"))


@query()
def strip_html_unescaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html"), extract.unescape).alias("body"))


@query()
def main_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extract.page_text(F.col("html")).alias("body"))


@query()
def scrape_articles(spark, sf_dir):
    rules = {"article_selector": "article", "title_selector": "h1", "summary_selector": "p", "link_base": "https://example.com/"}
    return extract.articles(table(spark, sf_dir, "pages"), rules)


#: What character references of an escaped text stand for, with or without the semicolon, as HTML reads them: a title that was cut may end inside one.
REFERENCES = (("lt", "", "<"), ("gt", "", ">"), ("quot", "", '"'), ("amp", "", "&"), ("#x27", "[^0-9a-fA-F]", "'"), ("#x2", "[^0-9a-fA-F]", ""))


def references_sql(c: str) -> str:
    """Each part behind an ampersand is read once, so that what was decoded isn't decoded again."""
    cases = " ".join(f"WHEN regexp_matches(y, {quoted(f'^{name}({after}|$)' if after else f'^{name}')}) THEN {quoted(ch)} || regexp_replace(y, {quoted(f'^{name};?')}, '')" for name, after, ch in REFERENCES)
    return f"array_to_string(list_transform(string_split({c}, '&'), lambda y, k: CASE WHEN k = 1 THEN y {cases} ELSE '&' || y END), '')"


@query(
    f"""WITH p AS (SELECT page_id, html, split_part(url, '/', 4) AS source_name FROM pages),
li AS (SELECT page_id, source_name, list_filter(list_transform(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<li>(.*?)</li>', 1, 's'),
    lambda x: {{'title': trim({references_sql("regexp_extract(x, '>([^<]*)</a>', 1)")}), 'url': 'https://de.example.com' || {references_sql("""regexp_extract(x, 'href="([^"]*)"', 1)""")}}}), lambda x: length(x.title) >= 4) AS found FROM p WHERE source_name = 'de'),
de AS (SELECT page_id, source_name, unnest(found) AS a, generate_subscripts(found, 1) - 1 AS pos FROM li)
SELECT source_name, page_id, CAST(pos AS INTEGER) AS pos, a.title AS title, a.url AS url, '' AS summary, '' AS published_date FROM de
UNION ALL SELECT source_name, page_id, 0, trim(t), '', regexp_extract(html, '<style>(.*?)</style>', 1, 's'), '' FROM (SELECT *, {references_sql("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} AS t FROM p) WHERE source_name = 'fr' AND length(trim(t)) >= 4"""
)
def scrape_by_source(spark, sf_dir):
    """Pages by rules of their language's own: links of the navigation, the head, the defaults (which find nothing here), and none at all."""
    fields = "name string, scraper_config struct<article_selector:string,title_selector:string,summary_selector:string,date_selector:string,link_selector:string,link_base:string>"
    rules = [("de", ("nav li", "a", None, None, None, "https://de.example.com/")), ("fr", ("head", "title", "style", None, None, None)), ("en", (None,) * 6), ("es", None)]
    pages = table(spark, sf_dir, "pages").select("page_id", F.get(F.split("url", "/"), 3).alias("source_name"), "html")
    return extract.articles_by_source(pages, spark.createDataFrame(rules, fields), "page_id")


SPACE = T.BLANK
ESCAPED = """replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


@query(
    rf"""WITH t AS (SELECT doc_id AS ord, CASE doc_id % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN replace(coalesce(text, ''), chr(10), ' ') ELSE replace(coalesce(text, ''), ' und ', '。 ') END
    || ' cve-2024-' || (doc_id + 1000) || ', (CVE-2023-' || doc_id % 100 || '000) aCVE-2024-1234 <https://x.example/?a=' || doc_id || '&b> 1.' AS s FROM documents),
c AS (SELECT ord, s, regexp_replace(regexp_replace({ESCAPED}, '\b(CVE-\d{{4}}-\d{{4,8}})\b', '<code>\1</code>', 'gi'), '(https?://[^{SPACE[1:-1]}<]+)', '<a href="\1" target="_blank" rel="noopener">\1</a>', 'g') AS h FROM t),
m AS (SELECT ord, s, h, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\n{{2,}}', '</p><p>', 'g'), '([.!?]){SPACE}*\n{SPACE}*', '\1</p><p>', 'g'), '([。！？]){SPACE}*\n{SPACE}*', '\1</p><p>', 'g'), '\n+', ' ', 'g') AS many,
    regexp_replace(regexp_replace(h, '([。！？]){SPACE}*', '\1</p><p>', 'g'), '([.!?]){SPACE}+([A-Z"''「『])', '\1</p><p>\2', 'g') AS one FROM c)
SELECT ord, md5('<p>' || CASE WHEN contains(h, chr(10)) THEN many ELSE one END || '</p>') AS html_md5,
    array_to_string(list_transform(list_distinct_in_order, lambda x: x), ',') AS cves FROM (SELECT *, list_filter(f, lambda x, i: list_position(f, x) = i) AS list_distinct_in_order
    FROM (SELECT *, list_transform(regexp_extract_all(s, '(?i)\bCVE-\d{{4}}-\d{{4,8}}\b'), lambda x: upper(x)) AS f FROM m))"""
)
def readable_summaries(spark, sf_dir):
    """Whole texts as paragraphs, in one line or in many, with numbers and addresses to mark."""
    n = F.col("doc_id")
    whole = F.coalesce("text", F.lit(""))
    text = F.when(n % 3 == 0, whole).when(n % 3 == 1, F.replace(whole, F.lit("\n"), F.lit(" "))).otherwise(F.replace(whole, F.lit(" und "), F.lit("。 ")))
    more = F.concat(F.lit(" cve-2024-"), n + 1000, F.lit(", (CVE-2023-"), n % 100, F.lit("000) aCVE-2024-1234 <https://x.example/?a="), n, F.lit("&b> 1."))
    rows = report.readable(table(spark, sf_dir, "documents").select(n.alias("ord"), F.concat(text, more).alias("summary")))
    return rows.select("ord", F.md5(F.col("summary_html").cast("binary")).alias("html_md5"), F.array_join("cves", ",").alias("cves"))


@query()
def fulltext_join(spark, sf_dir):
    """Items whose summary is short get the text of the page of their number."""
    pages = table(spark, sf_dir, "pages").select("url", "html", F.col("page_id").alias("ord"))
    rows = items(spark, sf_dir).drop("url").join(pages.select("ord", "url"), "ord", "left")
    return extract.add_fulltext(rows, pages.select("url", "html")).select("ord", "url", "fulltext_fetched", F.length("summary").alias("n_chars"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def order_bodies(spark, sf_dir):
    """News bodies built from orders: one for each customer."""
    orders = table(spark, sf_dir, "orders")
    entry = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit(" "), "o_orderpriority").alias("title"), F.col("o_orderstatus").alias("summary"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("published_at"))
    code = F.when(F.col("o_custkey") % 5 == 0, "500").otherwise("10000")
    grouped = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(entry)).alias("data"))
    body = F.to_json(F.struct(code.alias("code"), "data"))
    return grouped.select(F.col("o_custkey").alias("ord"), F.lit("orders").alias("source_name"), F.lit("en").alias("language"), F.lit("api").alias("type"), F.lit("news").alias("api_platform"), body.alias("xml_text"), F.lit(None).cast("string").alias("error"))


@query(
    f"""SELECT o_custkey AS ord, 'https://www.secrss.com/articles/' || o_orderkey AS url, o_orderpriority AS title, o_orderstatus AS summary,
  strftime(o_orderdate, '%Y-%m-%d') AS published_date, 'API' AS source_type FROM orders WHERE o_custkey % 5 <> 0"""
)
def json_api_parse(spark, sf_dir):
    return parse.news(order_bodies(spark, sf_dir)).select("ord", "url", "title", "summary", "published_date", "source_type")


@query(
    """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey FROM customer)
SELECT c_custkey AS ord, c_name || ' - ' || c_mktsegment AS title, 'https://datatracker.ietf.org/doc/' || c_name || '/' AS url,
  '状态: ' || CASE WHEN c_nationkey % 3 = 0 THEN '未知' ELSE 'n' || c_nationkey END || CASE WHEN c_nationkey % 2 = 0 THEN ' | 工作组: g' || c_nationkey ELSE '' END AS summary FROM c"""
)
def draft_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    doc = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"), F.when(n % 3 != 0, F.concat(F.lit("n"), n)).alias("state"), F.when(n % 2 == 0, F.concat(F.lit("g"), n)).alias("group")
    )
    raw = c.select(F.col("c_custkey").alias("ord"), F.lit("c").alias("source_name"), F.lit("en").alias("language"), F.lit("api").alias("type"), F.to_json(F.struct(F.array(doc).alias("objects"))).alias("xml_text"))
    return parse.drafts(raw).select("ord", "title", "url", "summary")


def body_rows(rows: DataFrame, platform: str, ord_: str, body) -> DataFrame:
    """Raw rows of a platform, with their bodies as JSON."""
    return rows.select(
        F.col(ord_).cast("long").alias("ord"), F.lit(platform).alias("source_name"), F.lit("en").alias("language"), F.lit("api").alias("type"), F.lit(platform).alias("api_platform"),
        F.to_json(body).alias("xml_text"), F.lit(None).cast("string").alias("error"),
    )


@query(
    """SELECT s_nationkey AS ord, trim(s_name) AS title, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'http://s/' || s_suppkey END AS url,
  CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE s_name || ' in ' || s_nationkey END AS summary, CASE WHEN s_suppkey % 2 = 0 THEN ['a' || s_suppkey] ELSE ['a' || s_suppkey, 'b'] END AS authors FROM supplier"""
)
def scholar_parse(spark, sf_dir):
    """One body for each nation: its suppliers as papers; empty names of authors go."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    author = lambda x: F.struct(x.alias("name"))
    own = F.concat(F.lit("a"), k)
    paper = F.struct(
        F.concat(F.lit(" "), name, F.lit(" ")).alias("title"), F.when(k % 3 != 0, F.concat(F.lit("http://s/"), k)).alias("url"),
        F.when(k % 4 != 0, F.concat(name, F.lit(" in "), "s_nationkey")).alias("abstract"),
        F.when(k % 2 == 0, F.array(author(own), author(F.lit("")))).otherwise(F.array(author(own), author(F.lit("b")))).alias("authors"),
    )
    rows = table(spark, sf_dir, "supplier").withColumn("s_name", F.trim("s_name")).groupBy("s_nationkey").agg(F.collect_list(paper).alias("data"))
    found = parse.parse_all(body_rows(rows, "scholar", "s_nationkey", F.struct("data")))
    plain = F.when(F.startswith("summary", F.lit(" ")), F.trim("summary")).otherwise(F.col("summary"))
    return found.select("ord", "title", "url", plain.alias("summary"), "authors")


STIX_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'tool' WHEN 1 THEN 'malware' WHEN 2 THEN 'other' ELSE 'campaign' END"


@query(
    f"""WITH o AS (SELECT p_size AS ord, p_partkey, p_brand, {STIX_KIND} AS kind FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY ord, p_brand ORDER BY p_partkey) AS r FROM o WHERE kind <> 'other')
SELECT ord, '[MITRE ' || kind || '] ' || p_brand AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'http://p/' || p_partkey END AS url,
  CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE substr(repeat('d' || p_partkey || ' ', 200), 1, 500) END AS summary FROM f WHERE r = 1"""
)
def stix_parse(spark, sf_dir):
    """One bundle for each size: its parts as objects; the first of each name counts."""
    k = F.col("p_partkey")
    kind = F.when(k % 4 == 0, "tool").when(k % 4 == 1, "malware").when(k % 4 == 2, "other").otherwise("campaign")
    link = lambda source, url: F.struct(F.lit(source).alias("source_name"), url.alias("url"))
    links = F.array(link("else", F.lit("http://no")), link("mitre-attack", F.when(k % 3 != 0, F.concat(F.lit("http://p/"), k))))
    thing = F.struct(k.alias("k"), kind.alias("type"), F.concat(F.lit(" "), "p_brand").alias("name"), F.when(k % 5 != 0, F.repeat(F.concat(F.lit("d"), k, F.lit(" ")), F.lit(200))).alias("description"), links.alias("external_references"))
    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_sort(F.collect_list(thing)).alias("objects"))
    return parse.parse_all(body_rows(rows, "stix", "p_size", F.struct("objects"))).select("ord", "title", "url", "summary")


TOPICS_SQL = "list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'even' END, CASE WHEN p_partkey % 3 = 0 THEN 'third' END, 'a', 'b', 'c', 'd'], lambda x: x IS NOT NULL)[:5]"
REPO_SUMMARY_SQL = "CASE WHEN p_partkey % 4 = 0 THEN 'o/' || p_partkey ELSE substr(repeat(p_name || ' ', 40), 1, 500) END"


def part_repo():
    k = F.col("p_partkey")
    topics = F.array_compact(F.array(F.when(k % 2 == 0, "even"), F.when(k % 3 == 0, "third"), *map(F.lit, "abcd")))
    return F.struct(
        F.concat(F.lit("o/"), k).alias("full_name"), F.when(k % 4 != 0, F.repeat(F.concat("p_name", F.lit(" ")), F.lit(40))).alias("description"), topics.alias("topics"),
        F.when(k % 5 != 0, F.col("p_size")).alias("stargazers_count"), F.when(k % 3 != 0, "Python").alias("language"), F.when(k % 7 != 0, F.concat(F.lit("https://h/"), k)).alias("html_url"),
        F.when(k % 6 != 0, F.struct(F.col("p_brand").alias("login"))).alias("owner"),
    )


REPO_SQL = "CASE WHEN p_partkey % 7 = 0 THEN 'https://github.com/o/' || p_partkey ELSE 'https://h/' || p_partkey END AS url, CASE WHEN p_partkey % 6 = 0 THEN []::VARCHAR[] ELSE [p_brand] END AS authors"


@query(
    f"""SELECT p_size AS ord, 'o/' || p_partkey AS title, {REPO_SQL}, {TOPICS_SQL} AS categories, {REPO_SUMMARY_SQL} || ' | stars: ' || CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END
  || ' | 语言: ' || CASE WHEN p_partkey % 3 = 0 THEN '未知' ELSE 'Python' END || ' | 标签: ' || array_to_string({TOPICS_SQL}, ', ') AS summary FROM part"""
)
def repo_search_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.collect_list(part_repo()).alias("items"))
    return parse.parse_all(body_rows(rows, "repo_search", "p_size", F.struct("items"))).select("ord", "title", "url", "authors", "categories", "summary")


@query(f"SELECT p_partkey AS ord, 'o/' || p_partkey AS title, {REPO_SQL}, {TOPICS_SQL} AS categories, {REPO_SUMMARY_SQL} || ' | 标签: ' || array_to_string({TOPICS_SQL}, ', ') AS summary FROM part")
def repo_parse(spark, sf_dir):
    return parse.parse_all(body_rows(table(spark, sf_dir, "part"), "repo", "p_partkey", part_repo())).select("ord", "title", "url", "authors", "categories", "summary")


@query(
    """SELECT o_custkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '[o/r' || o_custkey || '] ' END || CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey ELSE o_orderpriority END AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://else/x' ELSE 'https://github.com/o/r' || o_custkey || '/releases/' || o_orderkey END AS url,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Release ' || CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey ELSE o_orderpriority END ELSE substr(repeat(o_orderstatus || o_orderkey || '-', 120), 1, 500) END AS summary
FROM orders"""
)
def releases_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    url = F.when(k % 3 == 0, "https://else/x").otherwise(F.concat(F.lit("https://github.com/o/r"), "o_custkey", F.lit("/releases/"), k))
    release = F.struct(
        F.concat(F.lit("v"), k).alias("tag_name"), F.when(k % 2 != 0, F.col("o_orderpriority")).alias("name"), F.when(k % 5 != 0, F.repeat(F.concat("o_orderstatus", k, F.lit("-")), F.lit(120))).alias("body"), url.alias("html_url")
    )
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(release).alias("all"))
    return parse.parse_all(body_rows(rows, "releases", "o_custkey", F.col("all"))).select("ord", "title", "url", "summary")


@query("SELECT o_custkey AS ord, o_orderpriority AS title, 'https://aisle.com/blog/s' || o_orderkey AS url, substr(repeat(o_orderstatus || o_orderkey || ' ', 90), 1, 500) AS summary FROM orders WHERE o_orderkey % 4 <> 0")
def posts_parse(spark, sf_dir):
    """The list lies under one of three names; posts without a slug go."""
    k = F.col("o_orderkey")
    post = F.struct(F.col("o_orderpriority").alias("title"), F.when(k % 4 != 0, F.concat(F.lit("s"), k)).alias("slug"), F.repeat(F.concat("o_orderstatus", k, F.lit(" ")), F.lit(90)).alias("content"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(post).alias("all"))
    of = lambda r, name: F.when(F.col("o_custkey") % 3 == r, F.col("all")).alias(name)
    return parse.parse_all(body_rows(rows, "posts", "o_custkey", F.struct(of(0, "items"), of(1, "data"), of(2, "docs")))).select("ord", "title", "url", "summary")


def feed_bodies(spark, sf_dir):
    rows = items(spark, sf_dir)
    safe = lambda c: T.escape_html(F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F]", ""))
    stamp = F.date_format(F.lit(NOW).cast("timestamp") - F.make_dt_interval((F.col("ord") % 15).cast("int")), "dd MMM yyyy HH:mm:ss")
    form = F.col("ord") % 4
    media = F.when(form == 1, "<media:title>Photo</media:title><media:description>of it</media:description>").otherwise("")
    link = F.when(form == 2, F.concat(F.lit("<link/><atom:link rel=\"self\"/><guid>"), F.col("url"), F.lit("</guid>"))).otherwise(F.concat(F.lit("<link>"), F.col("url"), F.lit("</link>")))
    date = F.when(form == 3, F.concat(F.lit("<dc:date>"), F.date_format(F.to_timestamp(stamp, "dd MMM yyyy HH:mm:ss"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</dc:date>"))).otherwise(F.concat(F.lit("<pubDate>Mon, "), stamp, F.lit(" GMT</pubDate>")))
    xml = F.concat(
        F.lit('<rss version="2.0" xmlns:media="m" xmlns:dc="d" xmlns:atom="a"><channel><item><title>'), safe(F.col("title")), F.lit("</title>"), media, link,
        F.lit("<description>"), safe(F.col("summary")), F.lit("</description>"), date, F.lit("</item></channel></rss>"),
    )
    return rows.select("ord", "source_name", "language", F.lit("rss").alias("type"), F.lit(None).cast("string").alias("api_platform"), xml.alias("xml_text"), F.lit(None).cast("string").alias("error"))


def xml_text_sql(c: str) -> str:
    return rf"regexp_replace({c}, '[\x00-\x08\x0B-\x1F]', '', 'g')"


@query(
    f"""WITH {ITEMS_SQL} SELECT ord, CAST(0 AS INTEGER) AS pos, trim({xml_text_sql('title')}, {BLANKS}) AS title, url,
  trim(regexp_replace(regexp_replace({entities_sql(tags_sql(xml_text_sql('summary')))}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS}) AS summary,
  strftime(TIMESTAMP '{NOW}' - to_days(CAST(ord % 15 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS published_date, 'RSS' AS source_type FROM items"""
)
def xml_feed_parse(spark, sf_dir):
    return parse.parse_all(feed_bodies(spark, sf_dir)).select("ord", "pos", "title", "url", "summary", "published_date", "source_type")


@query(f"SELECT doc_id AS ord, source AS source_name, strftime(TIMESTAMP '{NOW}', '%Y-%m-%dT%H:%M:%S') AS parse_time FROM documents WHERE doc_id % 10 IN (3, 4)")
def body_errors(spark, sf_dir):
    """Bodies that break off, and such that are no feed."""
    body = F.col("xml_text")
    damaged = F.when(F.col("ord") % 10 == 3, F.left(body, F.length(body) - 10)).when(F.col("ord") % 10 == 4, "plain").otherwise(body)
    rows = parse.parse_with_errors(feed_bodies(spark, sf_dir).withColumn("xml_text", damaged), F.lit(NOW).cast("timestamp"))
    return rows.where("parse_error").select("ord", "source_name", "parse_time")


# ---- summaries -----------------------------------------------------------------------------------------------------

#: RE2 has no look-behind: a mark is put after each end of a sentence, and the text is split there.
SENTENCES_SQL = rf"""sents AS (
  SELECT ord, list_transform(list_filter(list_transform(string_split(regexp_replace(
      regexp_replace(regexp_replace(summary, '\n\s*\n', ' ¶ ', 'g'), '\n', ' ', 'g'), '([。！？.!?])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {BLANKS})),
    lambda s: s <> '' AND s <> '¶' AND length(regexp_replace(s, '[^\p{{L}}\p{{N}}_]', '', 'g')) >= 3), lambda s: replace(replace(s, '¶ ', ''), '¶', '')) AS ss FROM items),
useful AS (SELECT ord, list_filter(ss, lambda s: length(trim(lower(s), {BLANKS})) >= 15 AND NOT ({' OR '.join(f"regexp_matches(trim(lower(s), {BLANKS}), {quoted(p)})" for p in EMPTY_SENTENCES)})) AS us FROM sents)"""


@query(f"WITH {ITEMS_SQL}, {SENTENCES_SQL} SELECT ord, CAST(len(ss) AS INTEGER) AS n_sentences, CAST(len(us) AS INTEGER) AS n_useful, md5(array_to_string(us, '|')) AS useful_md5 FROM sents JOIN useful USING (ord)")
def sentence_split(spark, sf_dir):
    rows = scoring.computed(items(spark, sf_dir).select("ord", "summary"), F.struct(T.sentences(F.col("summary")).alias("every")))
    rows = scoring.computed(rows.select("ord", "every"), F.struct(F.filter("every", T.is_meaningful).alias("useful")))
    useful = F.col("useful")
    return rows.select("ord", F.size("every").alias("n_sentences"), F.size(useful).alias("n_useful"), F.md5(F.array_join(useful, "|").cast("binary")).alias("useful_md5"))


@query(
    rf"""WITH {ITEMS_SQL}, {SENTENCES_SQL},
r AS (SELECT ord, i - 1 AS pos, us[i] AS s FROM (SELECT ord, us, unnest(range(1, len(us) + 1)) AS i FROM useful)),
w AS (SELECT ord, pos, list_distinct(list_filter(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1 AND NOT list_contains({listed(STOP_WORDS)}, x))) AS t FROM r),
e AS (SELECT ord, pos, len(t) AS n, unnest(t) AS x FROM w)
SELECT ord, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(c::DOUBLE / (ni + nj - c), 9) AS weight FROM (
  SELECT a.ord, a.pos AS i, b.pos AS j, any_value(a.n) AS ni, any_value(b.n) AS nj, count(*) AS c FROM e a JOIN e b ON a.ord = b.ord AND a.x = b.x AND a.pos < b.pos GROUP BY 1, 2, 3)"""
)
def sentence_jaccard(spark, sf_dir):
    return summary.sentence_similarity(items(spark, sf_dir), "summary").select("ord", "i", "j", F.round("weight", 9).alias("weight"))


@query()
def textrank_summary(spark, sf_dir):
    return summary.summarize(items(spark, sf_dir), "summary").select("ord", "extract")


@query()
def ai_summary(spark, sf_dir):
    return summary.choose_summary(items(spark, sf_dir)).select("ord", "ai_summary")


TRANSLATED_SQL = f"""WITH {ITEMS_SQL}, t AS (SELECT ord, language, title, substr(CASE WHEN ord % 3 = 0 THEN 'orig ' || title ELSE summary END, 1, 500) AS told,
  CASE WHEN ord % 5 = 0 THEN '漢字' WHEN ord % 2 = 0 THEN title ELSE '' END AS best FROM items)
SELECT ord, CASE WHEN language = 'en' THEN CASE WHEN trim(title, {BLANKS}) = '' THEN title ELSE 'zh:' || substr(title, 1, 1500) END END AS title_zh,
  CASE WHEN language = 'en' THEN CASE WHEN trim(told, {BLANKS}) = '' THEN told ELSE 'zh:' || told END END AS summary_zh,
  CASE WHEN best = '漢字' OR trim(best, {BLANKS}) = '' THEN best ELSE 'zh:' || substr(best, 1, 1500) END AS ai_summary_zh FROM t"""


def told_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ord")
    told = {"original_summary": F.when(k % 3 == 0, F.concat(F.lit("orig "), "title")), "ai_summary": F.when(k % 5 == 0, "漢字").when(k % 2 == 0, F.col("title")).otherwise("")}
    return items(spark, sf_dir).withColumns(told)


@query(TRANSLATED_SQL)
def translated_items(spark, sf_dir):
    """A mark stands in for the translator."""
    rows = summary.translate_items(told_items(spark, sf_dir), lambda c: F.concat(F.lit("zh:"), c))
    return rows.select("ord", "title_zh", "summary_zh", "ai_summary_zh")


def marked(text: str) -> str:
    return f"zh:{text}"


@query(TRANSLATED_SQL)
def translated_once(spark, sf_dir):
    """The same from a translator that is called once for each distinct text."""
    rows, _ = translate.translate_once(told_items(spark, sf_dir), marked)
    return rows.select("ord", "title_zh", "summary_zh", "ai_summary_zh")


@query(f"""WITH {ITEMS_SQL} SELECT ord, row_number() OVER (ORDER BY language IS NOT DISTINCT FROM 'en' DESC, ord) AS place FROM items""")
def english_first(spark, sf_dir):
    """Places in the order that puts English items first, numbered by range and offset."""
    keyed = summary.english_first(items(spark, sf_dir).withColumn("id", F.col("ord"))).select("id", "ord")
    return report.numbered_by(keyed, "ord").select(F.col("id").alias("ord"), "place")


@query("SELECT doc_id AS ord, round(length(regexp_replace(text || repeat('漢', CAST(doc_id % 900 AS INTEGER)), '[^\\x{4e00}-\\x{9fff}]', '', 'g'))::DOUBLE / length(text || repeat('漢', CAST(doc_id % 900 AS INTEGER))), 9) AS ratio FROM documents")
def cjk_ratio(spark, sf_dir):
    text = F.concat("summary", F.repeat(F.lit("漢"), (F.col("ord") % 900).cast("int")))
    return items(spark, sf_dir).select("ord", F.round(T.cjk_ratio(text), 9).alias("ratio"))


# ---- report --------------------------------------------------------------------------------------------------------


@query(
    f"""{DECIDED} SELECT items.ord, title, summary, '' AS ai_summary, url, source_name, substr(published_date, 1, 10) AS published_date, category,
  CAST('0x' || substr(md5(source_name), 1, 6) AS INTEGER) % 360 AS source_hue, filter_decision, confidence_score FROM items JOIN sd USING (ord)"""
)
def report_items(spark, sf_dir):
    rows = report.report_items(scored(spark, sf_dir))
    return rows.select("ord", "title", "summary", "ai_summary", "url", "source_name", "published_date", "category", "source_hue", "filter_decision", "confidence_score")


ORDER_SQL = "ord_dim AS (SELECT unnest(" + listed([*CATEGORY_ORDER, UNCLASSIFIED]) + f") AS category, unnest(range({len(CATEGORY_ORDER) + 1})) AS place)"


@query(
    f"""{DECIDED}, {ORDER_SQL}, g AS (SELECT coalesce(place, {len(CATEGORY_ORDER)}) AS place, count(*) AS n FROM sd LEFT JOIN ord_dim USING (category) WHERE filter_decision <> 'review' GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS cat_idx, category, n FROM g JOIN ord_dim USING (place)"""
)
def group_by_category(spark, sf_dir):
    return report.group_by_category(report.category_view(scored(spark, sf_dir)))


@query("SELECT source AS source_name, any_value(CAST('0x' || substr(md5(source), 1, 6) AS INTEGER) % 360) AS source_hue FROM documents GROUP BY source")
def source_hue(spark, sf_dir):
    return items(spark, sf_dir).select("source_name").distinct().select("source_name", T.hue(F.col("source_name")).alias("source_hue"))


@query(
    """SELECT event_id, strftime(ts, '%GW%V') AS week, strftime(date_trunc('week', ts), '%Y.%m.%d') || ' - ' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y.%m.%d') AS days FROM events"""
)
def iso_week(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.iso_week(F.col("ts")).alias("week"), T.week_range(F.col("ts")).alias("days"))


@query(f"{DECIDED} SELECT ord, category FROM sd WHERE filter_decision <> 'review' AND category = 'Beta'")
def category_view(spark, sf_dir):
    return report.category_view(scored(spark, sf_dir), "① Beta").select("ord", "category")


@query(
    f"""{DECIDED}, d AS (SELECT category, url, max(ord) AS last FROM items JOIN sd USING (ord) WHERE url <> '' GROUP BY 1, 2)
SELECT items.ord, url, md5(s.summary) AS summary_md5 FROM items JOIN sd USING (ord) LEFT JOIN d USING (category, url) LEFT JOIN items s ON s.ord = d.last"""
    .replace("SELECT items.ord, url,", "SELECT items.ord, items.url,")
)
def detail_lookup(spark, sf_dir):
    rows = report.report_items(scored(spark, sf_dir))
    return report.with_details(report.list_rows(rows), report.details(rows)).select("ord", "url", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


@query(
    """WITH k AS (SELECT lower(source) AS k, arg_max(lang, doc_id) AS categories FROM documents GROUP BY 1),
n AS (SELECT DISTINCT ' ' || upper(source) AS t FROM documents UNION SELECT DISTINCT c_mktsegment FROM customer UNION SELECT '   ' FROM documents)
SELECT trim(t) AS text, coalesce(categories, '') AS categories FROM n LEFT JOIN k ON k.k = lower(trim(t)) WHERE trim(t) <> ''"""
)
def keyword_upsert(spark, sf_dir):
    """Known: a keyword for each document, its source in either case, the last of which counts. Saved: sources as keywords, unknown ones, and blanks."""
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")).alias("text"), F.array("lang").alias("categories"), F.col("doc_id").alias("ord"))
    words = docs.select(F.concat(F.lit(" "), F.upper("source")).alias("text")).unionByName(docs.select(F.lit("   ").alias("text"))).unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("text")))
    return report.upsert_keywords(known, words.distinct().withColumn("ord", F.lit(0))).select("text", F.array_join("categories", ",").alias("categories"))


@query("SELECT date_trunc('week', ts) AS week_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_windows(spark, sf_dir):
    return feeds.weekly_counts(table(spark, sf_dir, "events"), "event_type")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(d AS INTEGER)) AS window_start, event_type, count(*) AS n FROM events, range(7) AS r(d) GROUP BY 1, 2")
def sliding_windows(spark, sf_dir):
    return feeds.sliding_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER o + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WHERE ts IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, sf_dir):
    return feeds.sessions(table(spark, sf_dir, "events"), "user_id")
