from sitegrain.plans.tiers import TIERS, Override, all_rules, effective, severity_of, should_run


def test_active_rules_by_tier():
    assert {n: sum(should_run(r, t) for r in all_rules()) for n, t in TIERS.items()} == {"fast": 9, "standard": 30, "deep": 39, "enterprise": 43}


def test_overrides():
    rule = next(r for r in all_rules() if r.id == "missing-title")
    assert not should_run(rule, TIERS["fast"], {"missing-title": Override(enabled=False)})
    assert effective(rule, Override(weight=99)).weight == 10
    assert severity_of(rule, "too-long", "warning", Override(severities={"too-long": "info"})) == "info"
    assert severity_of(rule, "too-long", "warning", Override(severity="error")) == "warning"
