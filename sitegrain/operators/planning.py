"""Image rules over derived inputs."""

from __future__ import annotations

from sitegrain.plans.dialect import Dialect, plan


def images(d: Dialect) -> str:
    """Image records from parts: bytes, dimensions, format and use follow from the part."""
    return f"""with images as (select p_partkey as image_id, {d.big('p_size * 20000')} as bytes, case when p_partkey % 3 = 0 then 'webp' when p_partkey % 3 = 1 then 'jpeg' else 'png' end as format,
        p_partkey % 4 <> 0 as has_alt, p_partkey % 5 <> 0 as has_dimensions, p_partkey % 2 = 0 as is_lazy, case when p_partkey % 17 = 0 then 404 else 200 end as status, p_partkey % 10 as page_no from part),
    checks as (
      select image_id, page_no, bytes, 'weight' as rule_id, case when bytes > 500000 then 35 when bytes > 200000 then 20 when bytes > 100000 then 10 else 0 end as points from images
      union all select image_id, page_no, bytes, 'format', case when format = 'webp' then 0 else 10 end from images
      union all select image_id, page_no, bytes, 'alt', case when has_alt then 0 else 10 end from images
      union all select image_id, page_no, bytes, 'cls', case when has_dimensions then 0 else 20 end from images
      union all select image_id, page_no, bytes, 'loading', case when is_lazy then 0 else 2 end from images
      union all select image_id, page_no, bytes, 'broken', case when status >= 400 then 35 else 0 end from images)"""


@plan("an13_image_rules", "part")
def image_rules(d: Dialect) -> str:
    return f"{images(d)} select image_id, rule_id, {d.big('points')} as points from checks where points > 0"


@plan("agg17_image_budget", "part")
def image_budget(d: Dialect) -> str:
    return f"""{images(d)}, scores as (select image_id, page_no, max(bytes) as bytes, greatest(0, 100 - sum(points)) as score from checks group by image_id, page_no)
    select {d.big('page_no')} as page_no, {d.big('sum(bytes)')} as page_bytes, sum(bytes) > 1500000 as over_budget, {d.big('floor(sum(score * bytes) / cast(sum(bytes) as double) + 0.5e0)')} as score from scores group by page_no"""


@plan("agg18_worst_image_rule", "part")
def worst_rule(d: Dialect) -> str:
    return f"""{images(d)}, ranked as (select image_id, rule_id, points, row_number() over (partition by image_id order by points desc, rule_id) as rn, sum(points) over (partition by image_id) as total from checks)
    select image_id, rule_id as worst_rule, {d.big('greatest(0, 100 - total)')} as score from ranked where rn = 1"""
