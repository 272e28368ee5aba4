"""Execution tiers, rule gating and effective rule settings, on the driver and as tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from sitegrain.operators.rules import SET_RULES, Rule, rules
from sitegrain.operators.scoring import CATEGORY_WEIGHTS, SEVERITY_ORDER, values
from sitegrain.plans.dialect import DUCK, Dialect, plan


@dataclass(frozen=True)
class Tier:
    """Limits and filters of one depth of audit."""

    name: str
    max_depth: int
    max_pages: int
    concurrency: int
    rate_ms: int
    modules: tuple[str, ...]
    categories: tuple[str, ...]
    min_severity: str
    weights: dict[str, float] = field(default_factory=lambda: CATEGORY_WEIGHTS)


_BASE = ("seo", "metadata", "indexing", "links")
_STANDARD = (*_BASE, "performance", "accessibility", "mobile_seo", "security")
#: The four tiers.
TIERS = {
    t.name: t
    for t in (
        Tier("fast", 1, 1, 5, 50, ("core", "security"), _BASE, "error", {"seo": 0.4, "metadata": 0.3, "indexing": 0.2, "links": 0.1}),
        Tier("standard", 3, 100, 3, 100, ("core", "performance", "mobile", "security"), _STANDARD, "warning"),
        Tier("deep", 5, 500, 2, 250, ("core", "performance", "mobile", "security", "aiVisibility", "hreflang"), (*_STANDARD, "ai_visibility"), "info"),
        Tier("enterprise", 10, 5000, 8, 50, ("core", "performance", "mobile", "security", "aiVisibility", "hreflang", "backlinks"),
             (*_STANDARD, "ai_visibility", "backlink_intelligence"), "info"),
    )
}


@dataclass(frozen=True)
class Override:
    """A user's setting for one rule."""

    enabled: bool = True
    severity: str | None = None
    weight: int | None = None
    severities: dict[str, str] = field(default_factory=dict)  # by sub-check


def all_rules() -> list[Rule]:
    return [*rules(DUCK), *SET_RULES]


def should_run(rule: Rule, tier: Tier, overrides: dict[str, Override] | None = None) -> bool:
    own = (overrides or {}).get(rule.id, Override())
    severity = own.severity or rule.severity
    return (
        own.enabled
        and rule.module in tier.modules
        and rule.category in tier.categories
        and SEVERITY_ORDER[severity] >= SEVERITY_ORDER[tier.min_severity]
    )


def effective(rule: Rule, override: Override) -> Rule:
    """The rule with a user's severity and weight (held between 1 and 10)."""
    weight = rule.weight if override.weight is None else min(10, max(1, override.weight))
    return replace(rule, severity=override.severity or rule.severity, weight=weight)


def severity_of(rule: Rule, sub_check: str, found: str | None, override: Override) -> str:
    """Precedence: rule and sub-check, sub-check, the finding's own, the rule's."""
    named = override.severities
    return named.get(f"{rule.id}:{sub_check}") or named.get(sub_check) or found or override.severity or rule.severity


@plan("flt03_active_rules", "region")
def active(d: Dialect) -> str:
    """Which rule runs in which tier, as a join of two dimensions."""
    defs = values(d, ("rule_id", "module", "category", "severity"), [(r.id, r.module, r.category, r.severity) for r in all_rules()])
    modules = values(d, ("tier", "module"), [(t.name, m) for t in TIERS.values() for m in t.modules])
    categories = values(d, ("tier", "category"), [(t.name, c) for t in TIERS.values() for c in t.categories])
    least = values(d, ("tier", "least"), [(t.name, SEVERITY_ORDER[t.min_severity]) for t in TIERS.values()])
    order = values(d, ("severity", "ordinal"), SEVERITY_ORDER.items())
    return f"""with defs as ({defs}), tier_modules as ({modules}), tier_categories as ({categories}), tier_least as ({least}), severities as ({order})
    select m.tier, r.rule_id, r.category, r.severity from defs r join tier_modules m on r.module = m.module
    join tier_categories c on c.tier = m.tier and c.category = r.category join tier_least l on l.tier = m.tier
    join severities s on s.severity = r.severity where s.ordinal >= l.least"""


@plan("cmd13_tier_list", "region")
def tier_list(d: Dialect) -> str:
    rows = [(t.name, t.max_depth, t.max_pages, t.concurrency, t.rate_ms, t.min_severity, len(t.modules), sum(should_run(r, t) for r in all_rules())) for t in TIERS.values()]
    return values(d, ("tier", "max_depth", "max_pages", "concurrency", "rate_ms", "min_severity", "n_modules", "n_rules"), rows)
