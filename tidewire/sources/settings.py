"""Settings and keyword rules from JSON text, read by Spark so that any store it knows will do. A missing file is an error."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewire.functions.rules import CATEGORY_ORDER, UNCLASSIFIED, Ambiguity, Keyword, Rules
from tidewire.functions.segment import MAX_WORDS, Dictionary

#: Defaults of a rule file's optional keys.
TIER_RATIOS = {"tier_a": (1, 1), "tier_b": (0.6, 0.3), "tier_c": (0.5, 0.2), "tier_d": (0, 0)}


def read_json(spark: SparkSession, path: str) -> dict | list:
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def read_status(spark: SparkSession, path: str) -> dict:
    """A status, health or statistics file: empty if it is missing, damaged or no object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return {}
    try:
        told = read_json(spark, path)
    except ValueError:
        return {}
    return told if isinstance(told, dict) else {}


@dataclass(frozen=True)
class Settings:
    """What a configuration says beside its rules."""

    similarity: int = 85
    max_days: int = 7
    category_order: tuple[str, ...] = (*CATEGORY_ORDER, UNCLASSIFIED)


def settings_from(config: dict) -> Settings:
    """dedup.similarity_threshold, dedup.max_days and category_order; absent ones, or an empty order, take the defaults."""
    given = config.get("dedup", {})
    return Settings(given.get("similarity_threshold", Settings.similarity), given.get("max_days", Settings.max_days), tuple(config.get("category_order") or Settings.category_order))


def rules_from(config: dict) -> Rules:
    """Rules from a configuration: tiers with weight and keywords, position_multipliers, thresholds, pairing_rules and so on.

    Of keywords of a tier that differ only in case the last entry's metadata counts.
    """
    keywords = []
    for tier in ("strong", "medium", "weak"):
        entries = [k if isinstance(k, dict) else {"text": k} for k in config[tier]["keywords"]]
        last = {k["text"].lower(): k for k in entries}
        for k in entries:
            if k["text"].strip():
                told = last[k["text"].lower()]
                keywords.append(Keyword(tier, k["text"], tuple(told.get("categories", ())), tuple(told.get("content_types", ())), told.get("type", "normal")))
    negative = config.get("negative_filters", {})
    demotion = negative.get("site_demotion", {})
    limits, pairing = config.get("thresholds", {}), config.get("pairing_rules", {})
    ratios = {}
    for name, (medium, weak) in TIER_RATIOS.items():
        of = pairing.get(name, {})
        ratios[name[-1].upper()] = (float(of.get("medium_score_ratio", medium)), float(of.get("weak_score_ratio", weak)))
    return Rules(
        keywords=tuple(keywords),
        ambiguity={
            k.lower(): Ambiguity(tuple(r.get("exclude_patterns", ())), tuple(r.get("requires_prefix", ())), r.get("standalone_score") is not False)
            for k, r in config.get("ambiguity_rules", {}).items()
        },
        negative=tuple(negative.get("industry_exclusions", ())) + tuple(negative.get("content_type_exclusions", ())),
        demoted_sites=tuple(demotion.get("demoted_sites", ())) if demotion.get("enabled") else (),
        site_penalty=demotion.get("default_penalty", -20),
        weights={t: float(config[t]["weight"]) for t in ("strong", "medium", "weak")},
        multipliers={k: float(v) for k, v in config["position_multipliers"].items()},
        ratios=ratios,
        lead_chars=config.get("lead_max_chars", 200),
        tail_from_chars=config.get("tail_min_total_chars", 400),
        accept=limits.get("accept_threshold", limits.get("direct_accept", 50)),
        review=limits.get("review_threshold", 45),
        drop_below=limits.get("stage1_drop_below", 30),
        medium_needs_strong=config["medium"].get("requires_strong_or_medium", False),
    )


def strong_texts(config: list | dict) -> list[str]:
    """The strong keywords' texts, from a rule file or a plain list."""
    listed = config["strong"]["keywords"] if isinstance(config, dict) else config
    return [k["text"] if isinstance(k, dict) else k for k in listed]


def secret(name: str) -> str | None:
    """Credentials come from the environment alone and are never stored."""
    return os.environ.get(name)


def read_dictionary(spark: SparkSession, path: str) -> Dictionary:
    """A dictionary of lines of a word and its count; what follows these, and other lines, are passed over. Counts of a word that comes again are added."""
    parts = F.split(F.trim("value"), r"\s+")
    listed = spark.read.text(path).select(F.get(parts, 0).alias("word"), F.get(parts, 1).try_cast("long").alias("n"))
    counted = listed.where("word != '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    return Dictionary({r.word: r.n for r in counted.limit(MAX_WORDS + 1).collect()})  # which refuses one row more than it may have
