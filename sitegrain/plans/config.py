"""Settings: defaults, preset, tier, file, arguments and environment merged in that order and checked; rules, plugins and data sources."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegrain.plans.tiers import TIERS, Override, all_rules, effective, severity_of, should_run

SEVERITIES = ("info", "warning", "error", "critical")
#: Presets and the tier each stands for.
PRESETS = {"quick": "fast", "standard": "standard", "full": "deep"}


@dataclass(frozen=True)
class Settings:
    max_pages: int = 100
    max_depth: int = 3
    concurrency: int = 5
    rate_ms: int = 100
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    fail_on: tuple[str, ...] = ("critical",)
    browser: bool = False
    lighthouse: bool = False
    keep_html: bool = True
    tier: str | None = None
    overrides: Mapping[str, Override] = field(default_factory=dict)

    def checked(self) -> Settings:
        """Itself, or a ValueError that names every wrong setting."""
        wrong = [f"{k} must be positive" for k in ("max_pages", "max_depth", "concurrency") if getattr(self, k) < 1]
        wrong += ["rate_ms must not be negative"] if self.rate_ms < 0 else []
        wrong += [f"unknown severity {s}" for s in self.fail_on if s not in SEVERITIES]
        wrong += [f"unknown tier {self.tier}"] if self.tier not in (None, *TIERS) else []
        known = {r.id for r in all_rules()}
        wrong += [f"unknown rule {r}" for r in self.overrides if r not in known]
        wrong += [f"weight of {r} must be between 1 and 10" for r, o in self.overrides.items() if o.weight is not None and not 1 <= o.weight <= 10]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self


def _typed(name: str, value: Any) -> Any:
    kind = {f.name: f.type for f in fields(Settings)}[name]
    if isinstance(value, str) and kind == "int":
        return int(value)
    if isinstance(value, str) and kind == "bool":
        return value.lower() in ("1", "true", "yes", "on")
    if kind.startswith("tuple"):
        return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
    if name == "overrides":
        return {k: o if isinstance(o, Override) else Override(**o) for k, o in value.items()}
    return value


def resolve(preset: str | None = None, file: str | None = None, arguments: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Later sources win: defaults, the preset's tier, a JSON file, arguments, variables named SITEGRAIN_<SETTING>."""
    given: dict[str, Any] = {}
    if preset:
        t = TIERS[PRESETS[preset]]
        given |= {"tier": t.name, "max_pages": t.max_pages, "max_depth": t.max_depth, "concurrency": t.concurrency, "rate_ms": t.rate_ms}
    if file:
        with open(file) as f:
            given |= json.load(f)
    given |= {k: v for k, v in (arguments or {}).items() if v is not None}
    names = {f.name for f in fields(Settings)}
    env = os.environ if environment is None else environment
    given |= {k: env[f"SITEGRAIN_{k.upper()}"] for k in names if f"SITEGRAIN_{k.upper()}" in env}
    if strange := sorted(given.keys() - names):
        raise ValueError(f"unknown settings: {', '.join(strange)}")
    return replace(Settings(), **{k: _typed(k, v) for k, v in given.items()}).checked()


def shown(settings: Settings) -> str:
    """The effective settings as JSON."""
    return json.dumps(asdict(settings), default=str, indent=2, sort_keys=True)


def example() -> str:
    """A settings file to start from."""
    return shown(Settings(tier="standard"))


def crawler(settings: Settings, can_browse: bool = True, can_measure: bool = True) -> str:
    """Which capture is used: lighthouse, then browser, then http, down to what is possible."""
    return "lighthouse" if settings.lighthouse and can_measure else "browser" if (settings.browser or settings.lighthouse) and can_browse else "http"


def difference(a: Settings, b: Settings) -> list[tuple[str, str, str]]:
    """(setting, before, after) of every setting that differs."""
    x, y = json.loads(shown(a)), json.loads(shown(b))
    return [(k, json.dumps(x.get(k)), json.dumps(y.get(k))) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k)]


# --- rules as a table, with overrides -----------------------------------------------------------


def rule_table(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """Every rule with its effective severity and weight, whether it is overridden, and whether it runs in the tier."""
    settings = settings or Settings()
    tier = TIERS[settings.tier or "enterprise"]
    rows = []
    for r in all_rules():
        own = settings.overrides.get(r.id)
        e = effective(r, own or Override())
        rows.append((r.id, r.category, r.module, e.severity, e.weight, own is not None, should_run(r, tier, dict(settings.overrides))))
    return spark.createDataFrame(rows, "rule_id string, category string, module string, severity string, weight int, overridden boolean, runs boolean")


def overridden(findings: DataFrame, overrides: Mapping[str, Override]) -> DataFrame:
    """Findings with their effective severity (rule and sub-check, sub-check, the finding's own) and without disabled rules."""
    off = [r for r, o in overrides.items() if not o.enabled]
    rules, changed = {r.id: r for r in all_rules()}, F.col("severity")
    for rule, o in overrides.items():
        for key in o.severities:
            sub = key.split(":", 1)[-1]
            to = severity_of(rules[rule], sub, None, o)
            changed = F.when((F.col("rule_id") == rule) & (F.col("sub_check") == sub), to).otherwise(changed)
        if o.severity and not o.severities:
            changed = F.when(F.col("rule_id") == rule, o.severity).otherwise(changed)
    kept = findings.where(~F.col("rule_id").isin(off)) if off else findings
    return kept.withColumn("severity", changed)


# --- extension points -----------------------------------------------------------------------------


@dataclass
class Plugin:
    """Hooks over DataFrames; each may be left out. A hook that fails while its plan is built is reported and skipped."""

    name: str
    on_init: Callable[[Settings], None] | None = None
    before_crawl: Callable[[DataFrame], DataFrame] | None = None  # urls
    on_pages: Callable[[DataFrame], DataFrame] | None = None
    data_sources: Callable[[DataFrame], dict[str, tuple[str, DataFrame | None]]] | None = None
    after_analysis: Callable[[DataFrame], DataFrame] | None = None  # findings
    on_complete: Callable[[DataFrame], None] | None = None


class Registry:
    """Rules and plugins of a user."""

    def __init__(self) -> None:
        self.rules: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.plugins: list[Plugin] = []
        self.errors: list[tuple[str, str]] = []

    def rule(self, rule_id: str, category: str, severity: str) -> Callable:
        """Registers a function of page rows that gives the rows that fail, with url and sub_check and perhaps severity."""

        def add(check: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            def run(pages: DataFrame) -> DataFrame:
                found = check(pages)
                own: Column = F.col("severity") if "severity" in found.columns else F.lit(None).cast("string")
                return found.select("url", F.lit(rule_id).alias("rule_id"), "sub_check", F.coalesce(own, F.lit(severity)).alias("severity"), F.lit(category).alias("category"))

            self.rules[rule_id] = run
            return check

        return add

    def findings(self, pages: DataFrame) -> DataFrame | None:
        """All registered rules' findings; a rule whose plan can't be built is reported and left out."""
        out = None
        for name, run in self.rules.items():
            found = self._guarded(name, run, pages)
            if found is not None:
                out = found if out is None else out.unionByName(found)
        return out

    def _guarded(self, name: str, hook: Callable | None, value):
        try:
            return hook(value) if hook else None
        except Exception as e:  # a user's code: its failure is its own
            self.errors.append((name, str(e)))
            return None

    def chain(self, hook: str, df: DataFrame) -> DataFrame:
        """Passes a table through every plugin's hook in order of registration."""
        for p in self.plugins:
            changed = self._guarded(f"{p.name}.{hook}", getattr(p, hook), df)
            df = df if changed is None else changed
        return df

    def sources(self, pages: DataFrame) -> dict[str, tuple[str, DataFrame | None]]:
        """Data sources of all plugins by name: status (ok, error, unavailable, not-configured) and table."""
        out: dict[str, tuple[str, DataFrame | None]] = {}
        for p in self.plugins:
            if p.data_sources:
                found = self._guarded(f"{p.name}.data_sources", p.data_sources, pages)
                out |= found if found is not None else {p.name: ("error", None)}
        return out
