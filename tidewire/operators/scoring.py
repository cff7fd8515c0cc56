"""Scoring of items by declarative keyword rules.

Rules are data: all their keywords are found by one automaton, built once in each task, which reads an item's texts once
however many keywords there are; nothing is shuffled. Matches are kept as an array of structs in the order in which they count: tiers strong, medium,
weak; within a tier by the first segment that has the keyword, then by the rules' order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.match import Automaton, batches_found, folded, has_any, has_keyword
from tidewire.functions.rules import BROAD_TYPES, GENERAL, SAMPLE, UNCLASSIFIED, Ambiguity, Rules

SEGMENTS = ("title", "lead", "body", "tail")
TIERS = ("strong", "medium", "weak")


def longest_body(summary: Column, full_body: Column, original: Column) -> Column:
    """The longest of the three; of equally long ones the first."""
    a, b, c = (F.coalesce(x, F.lit("")) for x in (summary, full_body, original))
    ab = F.when(F.length(b) > F.length(a), b).otherwise(a)
    return F.when(F.length(c) > F.length(ab), c).otherwise(ab)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: plain substitution would multiply it wherever a filter is pushed down."""
    return F.get(F.transform(F.array(value), body), 0)


def computed(rows: DataFrame, struct: Column) -> DataFrame:
    """Adds the fields of the struct as columns, computed once: filters on them aren't pushed below a generator."""
    return rows.select(*rows.columns, F.inline(F.array(struct)))


def segment_struct(items: DataFrame, rules: Rules = SAMPLE) -> Column:
    """title, lead, body, tail and all_text of an item."""
    optional = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    lead, bound = rules.lead_chars, rules.tail_from_chars

    def cut(body: Column) -> Column:
        size = F.length(body)
        blank = F.regexp_replace(body, r"(?U)^\s+|\s+$", "") == ""
        middle = F.greatest(size - 2 * lead, F.lit(0))
        return F.struct(
            F.coalesce("title", F.lit("")).alias("title"),
            F.when(blank, "").otherwise(F.left(body, F.lit(lead))).alias("lead"),
            F.when(blank, "").when(size > bound, F.substring(body, F.lit(lead + 1), middle)).otherwise(F.substring(body, F.lit(lead + 1), size)).alias("body"),
            F.when(~blank & (size > bound), F.right(body, F.lit(lead))).otherwise("").alias("tail"),
        )

    def joined(s: Column) -> Column:
        parts = F.filter(F.array(*(s[n] for n in SEGMENTS)), lambda x: x != "")
        return F.struct(*(s[n].alias(n) for n in SEGMENTS), F.array_join(parts, " ").alias("all_text"))

    return let(let(longest_body(F.col("summary"), optional("full_body"), optional("original_summary")), cut), joined)


def segments(items: DataFrame, rules: Rules = SAMPLE) -> DataFrame:
    """Adds seg_title, seg_lead, seg_body, seg_tail and all_text. Items: title, summary, optionally full_body, original_summary."""
    named = lambda s: F.struct(*(s[n].alias(f"seg_{n}") for n in SEGMENTS), s["all_text"].alias("all_text"))
    return computed(items, let(segment_struct(items, rules), named))


MATCHED = "array<struct<tier:int,seg:int,ord:int,text:string,mult:double,scoring:boolean,core:boolean,categories:array<string>,content_types:array<string>>>"
ARROW_MATCHED = pa.list_(pa.struct([
    ("tier", pa.int32()), ("seg", pa.int32()), ("ord", pa.int32()), ("text", pa.string()), ("mult", pa.float64()), ("scoring", pa.bool_()), ("core", pa.bool_()),
    ("categories", pa.list_(pa.string())), ("content_types", pa.list_(pa.string())),
]))


class Finder:
    """The keywords of rules in an item's segments."""

    def __init__(self, rules: Rules):
        by_rule = {k.lower(): r for k, r in rules.ambiguity.items()}
        self.rules, self.ambiguity = rules, [by_rule.get(k.text.lower()) for k in rules.keywords]
        self.texts = tuple(k.text for k in rules.keywords)
        self.weights = [float(rules.multipliers.get(s, 1.0)) for s in SEGMENTS]

    def clear(self, place: int, low: str) -> bool:
        """Whether the keyword means what it says in a text, given in lower case."""
        rule = self.ambiguity[place]
        return not rule or (not any(p.lower() in low for p in rule.exclude) and (not rule.prefix or any(p.lower() in low for p in rule.prefix)))

    def scores(self, place: int) -> bool:
        return not self.ambiguity[place] or self.ambiguity[place].standalone

    def matched(self, automaton: Automaton, segments: tuple[str | None, ...]) -> list[dict]:
        first: dict[int, int] = {}
        best: dict[int, float] = {}
        for seg, text in enumerate(segments):
            for place in automaton.found(text or ""):
                first.setdefault(place, seg)
                best[place] = max(best.get(place, self.weights[seg]), self.weights[seg])
        if not first:
            return []
        low, keywords = " ".join(s for s in segments if s).lower(), self.rules.keywords
        kept = sorted((TIERS.index(keywords[p].tier), seg, p) for p, seg in first.items() if self.clear(p, low))
        return [
            {"tier": t, "seg": seg, "ord": p, "text": (k := keywords[p]).text, "mult": best[p], "scoring": self.scores(p), "core": k.type == "core", "categories": list(k.categories), "content_types": list(k.content_types)}
            for t, seg, p in kept
        ]

    def quick(self, automaton: Automaton, texts: tuple[str | None, ...]) -> list[list[float]]:
        """Of each text: the weights of its strong, medium and weak keywords, and how many strong ones count."""
        out = []
        for name, text in zip(("title", "lead"), texts, strict=True):
            text = text or ""
            low, sums = text.lower(), [0.0] * 4
            for p in sorted(automaton.found(text)):
                if self.scores(p) and self.clear(p, low):
                    k = self.rules.keywords[p]
                    sums[TIERS.index(k.tier)] += float(self.rules.weights[k.tier] * self.rules.multipliers.get(name, 1.0))
                    sums[3] += k.tier == "strong"
            out.append(sums)
        return out


def matches(segmented: DataFrame, rules: Rules = SAMPLE) -> DataFrame:
    """Adds matched to items with segments: an array of (tier, seg, ord, text, mult, scoring, core, categories, content_types)."""
    finder = Finder(rules)

    @F.arrow_udf(MATCHED)
    def found(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return batches_found(finder.texts, columns, finder.matched, ARROW_MATCHED)

    return computed(segmented.withColumn("_matched", found(*(f"seg_{s}" for s in SEGMENTS))), F.struct(F.col("_matched").alias("matched"))).drop("_matched")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def tier_scores(matched: Column, rules: Rules = SAMPLE) -> Column:
    """category, tier (A-D) and score of every category that a match names, in the order in which they appear."""
    w = {t: F.lit(rules.weights[t]) for t in TIERS}
    names = F.array_distinct(F.flatten(F.transform(matched, lambda m: m["categories"])))

    def points(mine: Column, t: int) -> Column:
        return total(F.transform(F.filter(mine, lambda m: m["tier"] == t), lambda m: m["mult"] * w[TIERS[t]]))

    def scored(category: Column, mine: Column) -> Column:
        count = lambda test: F.size(F.filter(mine, test))
        tier = (
            F.when(count(lambda m: m["tier"] == 0) > 0, "A")
            .when(count(lambda m: (m["tier"] == 1) & m["core"]) > 0, "B")
            .when(count(lambda m: (m["tier"] == 1) & ~m["core"]) >= 2, "C")
            .otherwise("D")
        )
        ratio = lambda t, k: F.element_at(F.create_map(*(x for name, r in rules.ratios.items() for x in (F.lit(name), F.lit(float(r[k]))))), t)
        score = lambda t: points(mine, 0) + points(mine, 1) * ratio(t, 0) + points(mine, 2) * ratio(t, 1)
        return let(tier, lambda t: F.struct(category.alias("category"), t.alias("tier"), score(t).alias("score")))

    def of(category: Column) -> Column:
        return let(F.filter(matched, lambda m: m["scoring"] & F.array_contains(m["categories"], category)), lambda mine: scored(category, mine))

    return F.transform(names, of)


def paired_score(matched: Column, tiers: Column, rules: Rules = SAMPLE) -> Column:
    """The categories' scores and, in full, medium and weak matches without a category."""
    free = F.filter(matched, lambda m: m["scoring"] & (m["tier"] > 0) & (F.size(m["categories"]) == 0))
    weight = lambda m: F.when(m["tier"] == 1, rules.weights["medium"]).otherwise(rules.weights["weak"])
    return total(F.transform(tiers, lambda t: t["score"])) + total(F.transform(free, lambda m: m["mult"] * weight(m)))


def flat_score(matched: Column, rules: Rules = SAMPLE) -> Column:
    """Without pairing rules: all scoring matches by weight; medium ones may need a strong one."""
    scoring = F.filter(matched, lambda m: m["scoring"])
    if rules.medium_needs_strong:
        strong = F.exists(scoring, lambda m: m["tier"] == 0)
        scoring = F.filter(scoring, lambda m: (m["tier"] != 1) | strong)
    weight = lambda m: F.when(m["tier"] == 0, rules.weights["strong"]).when(m["tier"] == 1, rules.weights["medium"]).otherwise(rules.weights["weak"])
    return total(F.transform(scoring, lambda m: m["mult"] * weight(m)))


def argmax_first(names: Column, weight, default: str) -> Column:
    """The name of the largest weight; of equal ones the first in ``names``."""
    ranked = F.transform(names, lambda n, i: F.struct(weight(n).alias("w"), (-i).alias("p"), n.alias("n")))
    return F.coalesce(F.array_max(ranked)["n"], F.lit(default))


def category_vote(matched: Column) -> Column:
    """Strong matches vote with 2 for each of their categories, others with 1."""
    names = F.array_distinct(F.flatten(F.transform(matched, lambda m: m["categories"])))
    votes = lambda n: total(F.transform(F.filter(matched, lambda m: F.array_contains(m["categories"], n)), lambda m: F.when(m["tier"] == 0, 2.0).otherwise(1.0)))
    return argmax_first(names, votes, UNCLASSIFIED)


def content_type_vote(matched: Column, all_text: Column) -> Column:
    """A vote for each content type of a match, and one for each pattern of a broad type in the text."""
    def broad(both: Column) -> Column:
        out = []
        for name, patterns in BROAD_TYPES.items():
            n = F.lit(0.0)
            for p in patterns:
                n = n + (has_keyword(all_text, p, both["fold"]) if p.isascii() else F.contains(both["low"], F.lit(p))).cast("double")
            out.append(F.struct(F.lit(name).alias("name"), n.alias("n")))
        return F.filter(F.array(*out), lambda b: b["n"] > 0)

    def voted(hit: Column) -> Column:
        names = F.array_distinct(F.concat(F.flatten(F.transform(matched, lambda m: m["content_types"])), F.transform(hit, lambda b: b["name"])))
        votes = lambda n: F.size(F.filter(matched, lambda m: F.array_contains(m["content_types"], n))) + total(F.transform(F.filter(hit, lambda b: b["name"] == n), lambda b: b["n"]))
        return argmax_first(names, votes, GENERAL)

    both = F.struct(F.lower(all_text).alias("low"), folded(all_text).alias("fold"))
    return let(let(both, broad), voted)


def negative_hit(text: Column, rules: Rules = SAMPLE) -> Column:
    return has_any(F.lower(text), rules.negative)


def final_score(raw: Column, matched: Column, negative: Column) -> Column:
    """Negative items without a scoring strong match are clamped to 10..29, all to 0..100; half to even."""
    strong = F.exists(matched, lambda m: (m["tier"] == 0) & m["scoring"])
    clamped = F.when(negative & ~strong, F.greatest(F.least(raw, F.lit(29.0)), F.lit(10.0))).otherwise(raw)
    return F.bround(F.greatest(F.least(F.round(clamped, 9), F.lit(100.0)), F.lit(0.0))).cast("int")


def decision(score: Column, rules: Rules = SAMPLE) -> Column:
    return F.when(score >= rules.accept, "accepted").when(score >= rules.review, "review").otherwise("filtered")


def matched_texts(matched: Column, tier: int) -> Column:
    return F.array_sort(F.transform(F.filter(matched, lambda m: m["tier"] == tier), lambda m: m["text"]))


def reason(matched: Column, tiers: Column, negative: Column, score: Column) -> Column:
    count = lambda t: F.size(F.filter(matched, lambda m: m["tier"] == t))
    used = F.array_join(F.array_sort(F.array_distinct(F.transform(tiers, lambda t: t["tier"]))), "/")
    strong = F.exists(matched, lambda m: (m["tier"] == 0) & m["scoring"])
    return F.concat_ws(
        "; ",
        *(F.when(count(t) > 0, F.concat(F.lit(f"{name}="), count(t))) for t, name in enumerate(TIERS)),
        F.when(used != "", F.concat(F.lit("tiers="), used)),
        F.when(negative & ~strong, F.lit("negative clamp")),
        F.concat(F.lit("score="), score),
    )


def score(items: DataFrame, rules: Rules = SAMPLE, pairing: bool = True, site: str | None = None) -> DataFrame:
    """The full score: confidence_score, decision, category, content type, matched arrays and reason.

    ``site``: a column whose demoted sites lose ``site_penalty`` points; off unless named.
    """
    penalty = F.when(has_any(F.lower(F.coalesce(site, F.lit(""))), rules.demoted_sites), float(rules.site_penalty)).otherwise(0.0) if site else F.lit(0.0)

    rows = matches(segments(items, rules), rules)
    m, text = F.col("matched"), F.col("all_text")

    def of_tiers(t: Column) -> Column:
        raw = (paired_score(m, t, rules) if pairing else flat_score(m, rules)) + penalty
        both = F.struct(raw.alias("raw"), negative_hit(text, rules).alias("negative"))
        told = lambda r: F.struct(t.alias("tiers"), r["raw"].alias("raw_score"), r["negative"].alias("negative"), final_score(r["raw"], m, r["negative"]).alias("confidence_score"))
        return let(both, told)

    rows = computed(rows, let(tier_scores(m, rules), of_tiers))
    c = F.col("confidence_score")
    # each a column of its own: those that nobody reads aren't computed
    return rows.withColumns({
        "filter_decision": decision(c, rules), "category": category_vote(m), "content_type": content_type_vote(m, text),
        "scoring_matched": F.struct(*(matched_texts(m, k).alias(n) for k, n in enumerate(TIERS))), "scoring_reason": reason(m, F.col("tiers"), F.col("negative"), c),
    })


def quick_score(items: DataFrame, rules: Rules = SAMPLE) -> DataFrame:
    """Adds stage1_score and stage1_drop: title and lead only, each segment counted.

    Ambiguity is tested within the segment. If the rules ask for it, medium matches need a strong one seen so far.
    """
    finder = Finder(rules)

    @F.arrow_udf("array<array<double>>")
    def found(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return batches_found(finder.texts, columns, finder.quick, pa.list_(pa.list_(pa.float64())))

    summary = F.coalesce("summary", F.lit(""))
    parts = {"title": F.coalesce("title", F.lit("")), "lead": F.left(summary, F.lit(rules.lead_chars))}
    rows = items.withColumn("_sums", found(*parts.values()))
    raw, strong = F.lit(0.0), F.lit(False)
    for place in range(len(parts)):
        sums = F.get("_sums", place)
        strong = strong | (F.get(sums, 3) > 0)
        medium = F.when(strong, F.get(sums, 1)).otherwise(0.0) if rules.medium_needs_strong else F.get(sums, 1)
        raw = raw + F.get(sums, 0) + medium + F.get(sums, 2)
    negative = negative_hit(F.concat(parts["title"], F.lit(" "), summary), rules)
    out = computed(rows, F.struct(raw.alias("_raw"), strong.alias("_strong"), negative.alias("_negative")))
    clamped = F.when(F.col("_negative") & ~F.col("_strong"), F.least("_raw", F.lit(29.0))).otherwise(F.col("_raw"))
    score_ = F.bround(F.greatest(F.least(F.round(clamped, 9), F.lit(100.0)), F.lit(0.0))).cast("int")
    return computed(out, F.struct(score_.alias("stage1_score"))).withColumn("stage1_drop", F.col("stage1_score") < rules.drop_below).select(*items.columns, "stage1_score", "stage1_drop")
