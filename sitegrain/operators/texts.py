"""Text analytics: shingles, readability, keywords, near-duplicate pages, and window-shaped checks."""

from __future__ import annotations

from sitegrain.operators.pages import strip_html
from sitegrain.plans.dialect import STORED, Dialect, Plan, plan

#: Words that keyword counts leave out.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our "
    "ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with would you your yours yourself yourselves".split()
)
#: A silent ending and a leading y that syllable counts drop, and what a syllable is.
SILENT_ENDING, LEADING_Y, SYLLABLE = r"(?:[^laeiouy]es|ed|[^laeiouy]e)$", "^y", "[aeiouy]{1,2}"


def _words(d: Dialect, text: str) -> str:
    """Lower-case words of more than two characters, ASCII letters and digits only."""
    clean = d.repl(f"lower({text})", r"[^a-z0-9_ \t\n\r]", "")
    return d.filter(d.split(clean, r"[ \t\n\r]+"), "w", "length(w) > 2")


#: White space as scripts split at it.
SPACE = r"[ \t\n\x0b\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _tokens(d: Dialect, text: str) -> str:
    """Lower-case words of more than two characters, split at white space only: punctuation and letters of any script stay."""
    return d.filter(d.split(f"lower({text})", SPACE), "w", "length(w) > 2")


@plan("fn03_norm_title", "documents")
def fn03(d: Dialect) -> str:
    """Whole texts trimmed, lower-cased and with white space collapsed."""
    return f"select doc_id, lower(trim({d.repl('text', r'[ \t\n\r]+', ' ')})) as title from documents"


@plan("fn05_shingles", "documents")
def fn05(d: Dialect) -> str:
    """Distinct five-word shingles and the least of them, inside the row: nothing is exploded or shuffled."""
    gram = " || ' ' || ".join(f"w[i + {k + (d.name == 'duckdb')}]" for k in range(5))
    grams = d.distinct(d.map(d.seq("0", f"{d.size('w')} - 5"), "i", gram))
    least = "array_min(grams)" if d.name == "spark" else "list_min(grams)"
    return f"""with words as (select doc_id, {d.once(_tokens(d, 'text'))} as w from documents), enough as (select * from words where {d.size('w')} >= 5),
    sets as (select doc_id, {d.once(grams)} as grams from enough) select doc_id, {d.big(d.size('grams'))} as n_shingles, {least} as first_shingle from sets"""


@plan("fn08_word_count", "documents")
def fn08(d: Dialect) -> str:
    return f"select doc_id, {d.big(d.size(d.filter(d.split('text', r'[ \t\n\r]+'), 'w', f'length(w) > 0')))} as words from documents"


def _syllables(d: Dialect, words: str) -> str:
    """Sum over an array of words: one for short words, else the vowel runs of one or two letters, at least one."""
    word = d.repl(d.repl("w", SILENT_ENDING, ""), LEADING_Y, "")
    each = d.map(words, "w", f"case when length(w) <= 3 then 1 else greatest(1, {d.size(d.all(word, SYLLABLE, 0))}) end")
    return f"cast(aggregate({each}, 0, (a, n) -> a + n) as bigint)" if d.name == "spark" else f"cast(coalesce(list_sum({each}), 0) as bigint)"


@plan("fn18_syllables", "documents")
def fn18(d: Dialect) -> str:
    return f"""with words as (select doc_id, {d.once(_words(d, 'text'))} as ws from documents)
    select doc_id, {d.big(d.size('ws'))} as n_words, {_syllables(d, 'ws')} as syllables from words where {d.size('ws')} > 0"""


@plan("fn19_flesch", "documents")
def fn19(d: Dialect) -> str:
    return f"""with parts as (select doc_id, greatest(1, {d.size(d.filter(d.split('text', '[.!?]+'), 's', 'length(trim(s)) > 0'))}) as sentences, {d.once(_words(d, 'text'))} as ws from documents),
    counts as (select doc_id, sentences, cast({d.size('ws')} as double) as n, cast({_syllables(d, 'ws')} as double) as syllables from parts where {d.size('ws')} > 0)
    select doc_id, floor((206.835e0 - 1.015e0 * (n / sentences) - 84.6e0 * (syllables / n)) * 10 + 0.5e0) / 10 as reading_ease,
      floor((0.39e0 * (n / sentences) + 11.8e0 * (syllables / n) - 15.59e0) * 10 + 0.5e0) / 10 as grade from counts"""


@plan("fn20_length_score", "documents")
def fn20(d: Dialect) -> str:
    words = d.size(d.filter(d.split("text", r"[ \t\n\r]+"), "w", "length(w) > 0"))
    return f"""with c as (select doc_id, {words} as n from documents)
    select doc_id, cast(case when n >= 2000 then 100 when n >= 1500 then 90 when n >= 1000 then 80 when n >= 500 then 60 when n >= 300 then 40 when n >= 100 then 20 else n * 0.2e0 end as double) as length_score from c"""


@plan("agg26_top_keywords", "documents")
def agg26(d: Dialect) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""with words as (select doc_id, {d.explode(_words(d, 'text'))} as term from documents),
    counts as (select doc_id, term, count(*) as n from words where term not in ({stop}) group by doc_id, term),
    ranked as (select *, row_number() over (partition by doc_id order by n desc, term) as rn, sum(n) over (partition by doc_id) as total from counts)
    select doc_id, term, n, {d.big('rn')} as rn, round(n * 100e0 / total, 4) as density from ranked where rn <= 10"""


def page_shingles(d: Dialect) -> str:
    """Sorted distinct five-word shingles, hashed, of every page of five words and more."""
    gram = " || ' ' || ".join(f"w[i + {k + (d.name == 'duckdb')}]" for k in range(5))
    grams = d.map(d.seq("0", f"{d.size('w')} - 5"), "i", d.hash(gram))
    ordered = "array_sort" if d.name == "spark" else "list_sort"
    return f"""with texts as (select page_id, {strip_html(d, "coalesce(html, '')")} as body_text from pages),
    words as (select page_id, {d.once(_tokens(d, "body_text"))} as w from texts) select page_id, {ordered}({d.distinct(grams)}) as g from words where {d.size('w')} >= 5"""


STORED["page_shingles"] = Plan(page_shingles, ("pages",))


@plan("jon09_near_duplicates", "pages")
def jon09(d: Dialect) -> str:
    """Pages whose five-word shingles agree to 0.8 or more: pairs of the representatives of equal sets, and every page's representative.

    Found through shared rare shingles (prefix filter, exact), then verified; copies are never paired with each other.
    """
    sets = "{{page_shingles}}" if d.name == "spark" else f"({page_shingles(d)})"
    return f"""with sets as (select * from {sets}),
    keyed as (select page_id, g, {d.hash(d.join('g', ' '))} as k from sets), reps as (select k, min(page_id) as page_id from keyed group by k),
    sized as (select r.page_id, s.g, {d.size('s.g')} as n from reps r join sets s on s.page_id = r.page_id),
    exploded as (select page_id, n, {d.explode('g')} as term from sized), freq as (select term, count(*) as df from exploded group by term),
    ordered as (select e.page_id, e.n, e.term, f.df, row_number() over (partition by e.page_id order by f.df, e.term) as rn from exploded e join freq f on e.term = f.term),
    prefix as (select page_id, n, term from ordered where rn <= n - ceil(0.8e0 * n) + 1 and df > 1),
    candidates as (select distinct a.page_id as a, b.page_id as b from prefix a join prefix b on a.term = b.term and a.page_id < b.page_id and least(a.n, b.n) >= 0.8e0 * greatest(a.n, b.n)),
    verified as (select c.a, c.b, {d.overlap('x.g', 'y.g')} as common, x.n + y.n as both_n from candidates c join sized x on c.a = x.page_id join sized y on c.b = y.page_id)
    select 'pair' as kind, a as page_a, b as page_b, round(common / cast(both_n - common as double), 6) as similarity from verified where common >= 0.8e0 * (both_n - common)
    union all select 'member', r.page_id, s.page_id, 1e0 from keyed s join reps r on s.k = r.k"""


@plan("win01_heading_jump", "pages")
def win01(d: Dialect) -> str:
    """Headings of a page, each against the next one: where a level is skipped."""
    return f"""with heads as (select page_id, {d.all("coalesce(html, '')", r'(?is)<h([1-6])[\s>]')} as levels from pages),
    numbered as (select page_id, {d.explode_at('levels', 'place', 'level_text')} from heads), levels as (select page_id, place, cast(level_text as int) as level from numbered),
    pairs as (select page_id, place, level, lead(level) over (partition by page_id order by place) as next_level from levels)
    select page_id, {d.big('place')} as place, level, next_level, coalesce(next_level - level > 1, false) as skipped from pairs"""


@plan("win04_success_rate", "events")
def win04(d: Dialect) -> str:
    return """select event_id, round(avg(case when event_type = 'error' then 0e0 else 1e0 end) over (partition by user_id order by event_id rows between 19 preceding and current row), 6) as success_rate from events"""


@plan("win05_section_state", "conversations")
def win05(d: Dialect) -> str:
    """Section number of each line: a running count of the lines that open one."""
    return f"""select conv_id, turn, {d.big("sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and current row)")} as section
    from (select conv_id, turn, min(role) as role from conversations group by conv_id, turn) t"""


@plan("st10_tumbling", "events")
def st10(d: Dialect) -> str:
    hour = "date_trunc('hour', ts)"
    return f"""select event_type, {d.big(f"extract(hour from {hour})")} as hour_of_day, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"""


@plan("set04_new_fixed", "documents")
def set04(d: Dialect) -> str:
    """Whole texts by hash, of documents in English against all others: only in the one, only in the other, in both."""
    side = lambda cond: f"select distinct {d.hash('text')} as k from documents where {cond}"
    return f"""with a as ({side("lang = 'en'")}), b as ({side("lang <> 'en' or lang is null")})
    select k, 'new' as kind from (select k from b except select k from a) x union all select k, 'fixed' from (select k from a except select k from b) y
    union all select k, 'common' from (select k from a intersect select k from b) z"""


@plan("agg15_backlink_merge", "pages")
def agg15(d: Dialect) -> str:
    """Links merged by source and target: longest anchor, first and last sighting, largest authority."""
    host = d.repl(f"lower({d.rx('url', r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)')})", r"^www\.", "")
    return f"""with links as (select page_id, {host} as source, {d.explode(d.all("coalesce(html, '')", r'(?is)<a\s[^>]*href="([^"]*)"'))} as target from pages)
    select source, target, count(*) as n, min(page_id) as first_seen, max(page_id) as last_seen, max(page_id % 100) as authority,
      max(case when page_id % 5 = 0 then 1 else 0 end) = 1 as nofollow from links group by source, target"""


@plan("agg14_referring_domains", "pages")
def agg14(d: Dialect) -> str:
    host = d.repl(f"lower({d.rx('url', r'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)')})", r"^www\.", "")
    return f"""with links as (select {host} as source, {d.explode(d.all("coalesce(html, '')", r'(?is)<a\s[^>]*href="([^"]*)"'))} as target from pages)
    select count(*) as backlinks, count(distinct source) as referring_domains, count(distinct target) as targets from links"""


@plan("rule_anchor_text", "pages")
def anchors(d: Dialect) -> str:
    """Anchors used four times and more, or on half of all links."""
    return f"""with links as (select {d.explode(d.all("coalesce(html, '')", r'(?is)<a\s[^>]*>([^<]*)</a>'))} as anchor from pages),
    counts as (select lower(trim(anchor)) as anchor, count(*) as n from links where trim(anchor) <> '' group by 1), total as (select sum(n) as total from counts)
    select anchor, n, round(n / cast(total as double), 6) as share from counts cross join total where n >= 4 or n >= 0.5e0 * total"""


@plan("rule_low_authority", "supplier")
def low_authority(d: Dialect) -> str:
    """Backlink risk: authority of 15 and less or spam of 50 and more, three times or on 35 percent."""
    return f"""with links as (select s_suppkey, {d.big('s_suppkey % 90')} as domain_authority, {d.big('(s_suppkey * 7) % 60')} as spam from supplier),
    c as (select {d.big('sum(case when domain_authority <= 15 or spam >= 50 then 1 else 0 end)')} as risky, count(*) as n, {d.big('sum(case when domain_authority >= 60 then 1 else 0 end)')} as strong from links)
    select risky, n, strong, risky >= 3 or risky >= 0.35e0 * n as risky_profile, strong < 3 as missing_high_authority from c"""


#: SQL written apart from the builders above: shingles by a window over words, likeness by comparing all pairs.
ORACLE_SQL = {
    "fn05_shingles": r"""with w as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+'), lambda x: length(x) >= 3) as w from documents)),
      g as (select doc_id, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o as g from w window o as (partition by doc_id order by i))
      select doc_id, count(distinct g) as n_shingles, min(g) as first_shingle from g where g is not null group by doc_id""",
    "jon09_near_duplicates": r"""with t as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as b from pages),
      w as (select page_id, list_filter(string_split(lower(b), ' '), lambda x: length(x) >= 3) as w from t),
      s as (select page_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) as g from w where len(w) >= 5),
      r as (select page_id, g, min(page_id) over (partition by g) as rep from s), u as (select page_id, g from r where page_id = rep),
      p as (select a.page_id as a, b.page_id as b, len(list_intersect(a.g, b.g)) as c, len(a.g) + len(b.g) as n from u a join u b on a.page_id < b.page_id and 5 * least(len(a.g), len(b.g)) >= 4 * greatest(len(a.g), len(b.g)))
      select 'pair' as kind, a as page_a, b as page_b, round(c / cast(n - c as double), 6) as similarity from p where 10 * c >= 8 * (n - c)
      union all select 'member', page_id, rep, 1.0 from r""",
}
