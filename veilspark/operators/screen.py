"""Prompt-injection screening (advisory; it flags, never blocks).

Every rule is searched in the lower-cased text; labels keep rule order, the
score is the largest matched weight rounded to 2 places, and a row is
suspicious iff the score reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..catalog import InjectionRule
from ..functions import dialect, gates


# Mandatory literals per catalogue rule (every match contains one of them);
# a rule is only evaluated on rows whose lower-cased text contains one.
# Rules without a usable literal are always evaluated.
RULE_LITERALS: dict[str, tuple[str, ...]] = {
    "ignore_previous_instructions": ("instruction",),
    "ignore_your_instructions": ("instruction",),
    "disregard_instructions": ("disregard",),
    "forget_instructions": ("forget", "drop", "dismiss"),
    "do_not_follow": ("follow",),
    "act_as_if": ("you",),
    "pretend_you_are": ("pretend", "imagine", "suppose"),
    "you_are_now": ("now",),
    "dan_jailbreak": ("dan",),
    "do_anything_now": ("anything",),
    "reveal_prompt": ("prompt", "instruction", "rule"),
    "extract_instructions": ("what",),
    "show_me_instructions": ("prompt", "instruction", "rule"),
    "injection_keyword": ("system", "override", "bypass", "jailbreak"),
    "injection_test_keyword": ("injection", "exploit", "payload"),
    "leetspeak_ignore": ("1gn0r3", "ign0re", "1gnore"),
    "new_session_marker": ("new",),
    "fake_system_delimiter": ("###", "==="),
    "fake_system_tag": ("[system]", "[instruction]", "[inst]"),
    "fake_special_token": ("<|",),
    "code_block_system": ("```",),
}
_CATALOGUE_RULES = {r.regex: r.label for r in catalog.INJECTION_RULES}


def rule_hits(lowered: Column, rules: Sequence[InjectionRule] = catalog.INJECTION_RULES,
              special: Column | None = None) -> list[Column]:
    out = []
    for r in rules:
        hit = lowered.rlike(dialect.java(r.regex, "i"))
        lits = RULE_LITERALS.get(_CATALOGUE_RULES.get(r.regex, ""))
        if lits and special is not None:
            gate = special
            for lit in lits:
                gate = gate | lowered.contains(lit)
            hit = F.when(gate, hit).otherwise(F.lit(False))
        out.append(hit)
    return out


def screen(df: DataFrame, text_col: str = "text", rules: Sequence[InjectionRule] = catalog.INJECTION_RULES,
           threshold: float = catalog.INJECTION_THRESHOLD) -> DataFrame:
    """Adds ``injection_patterns``, ``injection_score``, ``injection_detected``."""
    staged = df.withColumn("__lower", F.lower(F.col(text_col))).withColumn(
        "__special", gates.special_fold(F.col(text_col)))
    hits = rule_hits(F.col("__lower"), rules, F.col("__special"))
    staged = staged.select("*", *[h.alias(f"__inj_{i}") for i, h in enumerate(hits)])
    labels = F.array_compact(F.array(*[F.when(F.col(f"__inj_{i}"), F.lit(r.label)) for i, r in enumerate(rules)]))
    weights = [F.when(F.col(f"__inj_{i}"), F.lit(float(r.weight))) for i, r in enumerate(rules)]
    score = F.round(F.coalesce(F.greatest(*weights), F.lit(0.0)), 2)
    out = staged.select("*", labels.alias("injection_patterns"), score.alias("injection_score"))
    out = out.withColumn("injection_detected", F.col("injection_score") >= F.lit(threshold))
    return out.drop("__lower", "__special", *[f"__inj_{i}" for i in range(len(rules))])
