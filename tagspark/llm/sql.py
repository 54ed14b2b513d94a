"""SQL for those queries of this package that have a form in it."""

from __future__ import annotations

# Words are separated by these characters only.
_BETWEEN = r"'[\x20\x09-\x0D]+'"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), {_BETWEEN}), lambda w: w <> '')"

QUALITY_STATISTICS = f"""
with texts as (select doc_id, coalesce(text, '') as text, {_WORDS} as words from documents),
windows as (
    select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as w
    from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from texts)),
repeated as (select doc_id, w from windows group by all having count(*) > 1),
covered as (
    select doc_id, count(distinct p) as n from (
        select doc_id, unnest([i, i + 1, i + 2]) as p from windows join repeated using (doc_id, w))
    group by doc_id),
counted as (
    select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines,
        coalesce(n, 0) as n_repeat_words
    from texts left join covered using (doc_id))
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, n_repeat_words,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
from counted
"""

MIX_TARGETS = f"""
with sizes as (
    select source, sum(len({_WORDS})) as source_size from documents group by source),
weighed as (
    select source, source_size, 2.0 * source_size as stop,
        [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight,
        1.5 * sum(source_size) over () as total
    from sizes),
-- Sources stop in the order of stop / weight; what they leave is shared by those after them.
levels as (
    select *, stop / weight as level, sum(weight) over () as weights,
        coalesce(sum(stop) over before, 0) as stopped, coalesce(sum(weight) over before, 0) as stopped_weight
    from weighed
    window before as (order by stop / weight, source rows between unbounded preceding and 1 preceding)),
reached as (
    select min_by(rate, level) as rate from (
        select level, (total - stopped) / (weights - stopped_weight) as rate from levels)
    where rate <= level)
select source, cast(source_size as bigint) as source_size,
    round(least(stop, coalesce(rate * weight, stop)), 3) as target
from levels, reached
"""

_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def _rule(text: str) -> str:
    host, slash, path = text.partition("/")
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash}{path}')"


# Longer rules come first.
_CASES = " ".join(f"when {_rule(r)} then '{r}'" for r in sorted(_RULES, key=len, reverse=True))
URL_RULES = f"""
select page_id, host, path, case {_CASES} end as rule from (
    select page_id,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path
    from pages)
"""

EDITED_TEXTS = """
with following as (
    select doc_id, coalesce(text, '') as text,
        coalesce(lead(coalesce(text, '')) over by_id, first_value(coalesce(text, '')) over by_id) as next
    from documents window by_id as (order by doc_id desc))
select doc_id, length(text) as n_chars,
    sha256(left(text, length(text) - length(text) // 3) || left(next, length(text) // 3)) as edited_sha256
from following
"""

NEIGHBOURS = """
with recursive vectors as (
    select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
sized as (
    select *, sqrt(list_inner_product(e, e)) as norm from vectors
    where label is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
        and list_inner_product(e, e) > 0),
links as (
    select a.vec_id as a, b.vec_id as b from sized a join sized b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reached as (
    select vec_id, vec_id as other from vectors
    union select reached.vec_id, links.b from reached join links on reached.other = links.a),
components as (select vec_id, min(other) as component_id from reached group by vec_id)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id,
    vec_id = component_id as kept
from components
"""

HARD_NEGATIVES = """
with vectors as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
    select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
        cast(list_inner_product(a.v, b.v) as bigint) as score
    from vectors a join vectors b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
    select anchor_id, other_id as positive_id, score as positive_score from scores where same
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, cast(rank as integer) as rank, other_id as negative_id, positive_score,
    score as negative_score
from (
    select *, row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as rank
    from positives join scores using (anchor_id)
    where not same and 80 * positive_score <= 100 * score and score <= positive_score)
where rank <= 5
"""

ORACLES = {
    "quality_statistics": QUALITY_STATISTICS,
    "mix_targets": MIX_TARGETS,
    "url_rules": URL_RULES,
    "edited_texts": EDITED_TEXTS,
    "op11_neighbour_descent": NEIGHBOURS,
    "op13_hard_negatives": HARD_NEGATIVES,
}
