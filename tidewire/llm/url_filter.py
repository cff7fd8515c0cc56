"""Operator 7: URL filter, rules first and logistic regression on hashed character n-grams for the rest.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest
fitting rule decides. Rules are looked up by the suffixes of a url's host, so their number doesn't matter for a
url's cost. Urls without a rule are judged by a logistic regression on the presence of hashed 2- to 4-grams of
host and path, fitted on the driver to a small labelled table (``LABELLED``; at most ``MAX_LABELLED`` rows are
accepted); its ``DIMS`` weights and the rules are broadcast. Rules beyond ``MAX_RULES`` are refused.

Defined cases: null urls and urls without ``://`` have empty host and path, fit no rule and are judged on no
n-grams; of rules of one length the one listed first wins; every row is judged by itself; other columns (html)
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table

DIMS = 1 << 15
GRAMS = (2, 3, 4)
MAX_LABELLED = 10_000
MAX_RULES = 100_000
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"))

#: Labelled urls without their schemes, invented for this table on reserved names: those to be blocked, and those to be kept.
BLOCKED = """
www.casino-palace.test/play lucky-casino.test/bonus royalcasino.invalid/slots/12 m.casino-winbig.test/en/jackpot online-casino-club.invalid/register
www.bestbets.test/odds free-bets-now.invalid/tips blog.sport-bets.test/live betting-king.invalid/signup bets.highroller.test/de/4
m.poker-room.test/tables freepoker.invalid/bonus www.slots-mania.test/spin jackpot-slots.invalid/es/9 roulette-win.test/fr/2
www.cheap-pills.test/order pills4less.invalid/shop blog.buy-pills-fast.test/en/3 pharma-cheap.invalid/discount www.cheap-meds.test/cart
discount-viagra.invalid/buy m.onlinepharmacy-pills.test/de/77 weightloss-pills.invalid/offer miracle-diet.test/order
www.adult-cams.test/live xxx-videos.invalid/watch blog.adult-chat.test/rooms www.hot-singles.invalid/join adultdating.test/fr/8 free-xxx.invalid/es/5
ads.clicktrack.test/pixel www.track-ads.invalid/beacon adserver.bannerfarm.test/serve m.popup-ads.invalid/go ads-exchange.test/bid.html
tracker.clicks.invalid/t/1 www.click-rewards.test/claim free-prizes.invalid/winner blog.spam-links.test/page/3 www.linkfarm.invalid/index/44
www.spam-links-farm.test/fr/10 seo-spam.invalid/en/66 www.payday-loans.test/apply quick-cash-loans.invalid/now easy-money.test/earn
www.warez-downloads.invalid/crack serial-keygen.test/get torrent-warez.invalid/top www.fake-watches.test/replica replica-bags.invalid/sale
""".split()
KEPT = """
dailynews.test/world/2021 www.morning-herald.invalid/politics/5 news.citypost.test/en/18 weather-report.invalid/today blog.travelnotes.test/fr/2
www.university.invalid/research/papers library.museum.test/catalog docs.compiler.invalid/guide/intro wiki.history.test/de/40 school.district.invalid/calendar
blog.gardening.test/roses www.cooking-at-home.invalid/recipes/soup mathforum.test/algebra physics.lectures.invalid/en/7 archive.letters.test/1890
shop.books.invalid/fiction/31 furniture-makers.test/oak www.bicycle-repair.invalid/brakes trains.timetable.test/es/14 parliament.invalid/debates
hospital.care.test/visitors www.townhall.invalid/services/3 farmers-market.test/apples music.orchestra.invalid/concerts theatre.stage.test/season
www.open-data.invalid/sets/12 maps.rivers.test/delta astronomy.invalid/fr/9 chess-club.test/openings poetry.invalid/en/101
m.localpaper.test/sport/2 forum.woodwork.invalid/thread/88 www.linguistics.test/de/5 translation.guild.invalid/terms birdwatching.test/es/61
engineering.bridges.invalid/design www.painters.test/gallery/7 health.advice.invalid/children kitchen.tools.test/knives film.critics.invalid/reviews
api.reference.test/v2/methods kernel.notes.invalid/build.html statistics.office.test/tables/9 www.law-journal.invalid/issue/4 climate.institute.test/report
village.church.invalid/bells www.sailing.test/knots geology.invalid/en/730 handbook.teachers.test/reading the-lighthouse.invalid/story
""".split()
LABELLED = tuple((1, u) for u in BLOCKED) + tuple((0, u) for u in KEPT)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each url's number and the buckets of its n-grams, each once, in order; host and path have buckets of their own."""
    rows, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mark, parts in enumerate((hosts, paths), 1):
        whole = [f"^{p}$" if p else "" for p in parts]
        size = np.array([len(p) for p in whole], np.int64)
        codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner, left = np.repeat(np.arange(len(whole)), size), np.repeat(np.cumsum(size), size) - np.arange(len(codes))
        h = np.full(len(codes), mark, np.uint64)
        for n in range(1, max(GRAMS) + 1):
            ahead = np.zeros(len(codes), np.uint64)
            ahead[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
            with np.errstate(over="ignore"):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ahead)
            if n in GRAMS:
                rows.append(owner[left >= n])
                buckets.append((h[left >= n] % np.uint64(DIMS)).astype(np.int64))
    return np.divmod(np.unique(np.concatenate(rows) * DIMS + np.concatenate(buckets)), DIMS)


def scores(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """The regression's probabilities; features are scaled to unit length."""
    row, bucket = features(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    return 1 / (1 + np.exp(-(np.bincount(row, weights[bucket], len(hosts)) / np.sqrt(np.maximum(n, 1)) + bias)))


def fit(labelled=LABELLED, rounds: int = 1000, rate: float = 2.0, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, by gradient descent over all rows; features are scaled to unit length."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    parts = [url.partition("/") for _, url in labelled]
    row, bucket = features([h for h, _, _ in parts], [slash + p for _, slash, p in parts])
    used, column = np.unique(bucket, return_inverse=True)
    size = np.sqrt(np.maximum(np.bincount(row, minlength=len(labelled)), 1))
    x = np.zeros((len(labelled), len(used)))
    x[row, column] = 1 / size[row]
    y = np.array([float(k) for k, _ in labelled])
    w, bias = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w -= rate * (x.T @ miss / max(1, len(y)) + ridge * w)
        bias -= rate * miss.mean() if len(y) else 0.0
    weights = np.zeros(DIMS)
    weights[used] = w
    return weights, bias


def index_rules(rules) -> dict[str, list[tuple[int, int, str, str, str]]]:
    """By host: (length, place, path, rule, verdict), the strongest first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    out: dict[str, list] = {}
    for k, (verdict, host, path) in enumerate(rules):
        out.setdefault(host, []).append((-len(host + path), k, path, host + path, verdict))
    return {h: sorted(v) for h, v in out.items()}


def rule_for(index: dict, host: str, path: str) -> tuple[str, str] | None:
    best, at = None, 0
    while host and at >= 0:
        fits = next((r for r in index.get(host[at:], ()) if path.startswith(r[2])), None)
        best = min(x for x in (best, fits) if x) if best or fits else None
        at = host.find(".", at) + 1 or -1
    return best and (best[3], best[4])


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's score (null where a rule decides)."""
    shared = pages.sparkSession.sparkContext.broadcast((index_rules(rules), *fit(labelled)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights, bias = shared.value
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            told = [(*rule, None) if (rule := rule_for(index, h, p)) else None for h, p in zip(hosts, paths, strict=True)]
            open_ = [i for i, t in enumerate(told) if t is None]
            for i, score in zip(open_, scores([hosts[i] for i in open_], [paths[i] for i in open_], weights, bias).tolist(), strict=True):
                told[i] = None, "block" if score > 0.5 else "allow", score
            rule, verdict, score = zip(*told, strict=True) if told else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
