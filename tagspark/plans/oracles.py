"""ANSI SQL for the registered queries, over the same parquet tables.

Written apart from the DataFrame code: common table expressions, joins by
position and list functions, with the plain form of every pattern.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from tagspark.functions.clean import DIGIT_WORDS
from tagspark.functions.hashing import PRIME, coefficients
from tagspark.plans.fixtures import Q_DOCS
from tagspark.plans.settings import (
    ALL_TRAINING, BINS, MARGIN_NOISE_SEED, MARGIN_STEP_RATE, MARGIN_TRAINING, MIN_DF, N_TAGS, NOISE_BATCH,
    NOISE_PASSES, PROJECTION_DIMS, RUN_RANKS, SCORED_STEPS, TAG_TRAINING, TRAIN_TAGS, WIDE_DIMS,
)
from tagspark.sources.questions import FIRST_TEST_ID

_WS = r"[ \t\n\x0B\f\r]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERNS = {
    "p": rf"(?s)<p(?:{_WS}[^>]*)?>(.*?)</p>",
    "li": rf"(?s)<li(?:{_WS}[^>]*)?>(.*?)</li>",
    "code": r"(?s)<code>(.*?)</code>",
    "pre": rf"(?s)<pre(?:{_WS}[^>]*)?>(.*?)</pre>",
}
_STRIP = "' ' || chr(9) || chr(10) || chr(13)"


def lower_sql(e: str) -> str:
    return f"translate({e}, '{_UPPER}', '{_LOWER}')"


def strip_sql(e: str) -> str:
    return f"trim({e}, {_STRIP})"


def unescape_sql(e: str) -> str:
    return f"replace(replace({e}, '&lt;', '<'), '&gt;', '>')"


def tags_sql(e: str) -> str:
    return rf"regexp_replace({e}, '<[^>\n]*>', '', 'g')"


def brackets_sql(e: str) -> str:
    e = rf"regexp_replace({e}, '\[[^\]\n]*\]', '', 'g')"
    return rf"regexp_replace({e}, '\{{[^}}\n]*\}}', '', 'g')"


def keep_sql(e: str) -> str:
    return f"regexp_replace({e}, '[^a-z0-9#+-]', ' ', 'g')"


def widen_sql(e: str) -> str:
    for low, high, width in (("80", "7FF", 2), ("800", "FFFF", 3), ("10000", "10FFFF", 4)):
        e = rf"regexp_replace({e}, '[\x{{{low}}}-\x{{{high}}}]', '{' ' * width}', 'g')"
    return e


def spell_sql(tokens: str) -> str:
    """From a list of tokens: the text with all inner tokens spelled that are all digits."""
    spelled = "t"
    for digit, word in enumerate(DIGIT_WORDS):
        spelled = f"replace({spelled}, '{digit}', '{word} ')"
    # The words contain no digits, so the replacements do not meet.
    inner = (
        f"list_transform({tokens}[2:-2], lambda t: case when regexp_full_match(t, '[0-9]+') "
        f"then {spelled} else t end)"
    )
    return (
        f"case when len({tokens}) < 3 then array_to_string({tokens}, ' ') else array_to_string("
        f"list_concat(list_concat({tokens}[1:1], {inner}), {tokens}[-1:]), ' ') end"
    )


def words_sql(e: str) -> str:
    return rf"list_filter(regexp_split_to_array({e}, '{_WS}+'), lambda x: x <> '')"


def trim_sql(e: str) -> str:
    w = words_sql(e)
    return (
        f"coalesce(case when len({w}) > 40 then array_to_string(list_concat(({w})[1:20], "
        f"({w})[-20:]), ' ') else array_to_string({w}, ' ') end, '')"
    )


def join_sql(e: str) -> str:
    kept = f"list_filter({e}, lambda x: x <> '' and x <> ' ')"
    return strip_sql(f"coalesce(array_to_string({kept}, ' '), '')")


def normal_sql(e: str, widen: bool = False) -> str:
    e = brackets_sql(tags_sql(unescape_sql(strip_sql(e))))
    return keep_sql(widen_sql(e) if widen else e)


def collapse_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, ' +', ' ', 'g'))"


def hash_sql(e: str, seed: int) -> str:
    a, b, c, d = coefficients(seed)
    x = f"(({e}) % {PRIME})"
    h = f"(({a}::bigint * {x} + {b}) % {PRIME})"
    h = f"(({h} * {x} + {c}) % {PRIME})"
    return f"(({h} * {x} + {d}) % {PRIME})"


def normal_noise_sql(e: str, seed: int) -> str:
    u = f"(({hash_sql(e, seed)} + 1) / {float(PRIME + 1)})"
    v = f"({hash_sql(e, seed + 1)} / {float(PRIME)})"
    return f"(sqrt(-2.0 * ln({u})) * cos({2 * math.pi} * {v}))"


def r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


# Common table expressions with what each one needs.
_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    _CTES[name] = (sql.strip(), needs)


def with_ctes(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in _CTES[name][1]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} as materialized ({_CTES[n][0]})" for n in order)
    return f"with {parts}\n{final.strip()}" if parts else final.strip()


_cte("q_docs", Q_DOCS.format(documents="documents"))
_cte("q_pages", "select page_id as idx, url as title, html as body, '' as tags from pages")
_cte("n_all", "select count(*) as n from documents")
_cte("q_train", "select q.* from q_docs q, n_all where idx * 5 < 4 * n", "q_docs", "n_all")
_cte("n_train", "select count(*) as n from q_train", "q_train")
_cte(
    "q_test",
    """select q.idx - t.n as test_idx, title, body from q_docs q, n_all a, n_train t
    where q.idx * 5 >= 4 * a.n""",
    "q_docs", "n_all", "n_train",
)


def _clean_ctes(prefix: str, source: str, key: str, widen: bool = False) -> None:
    """`{prefix}_blocks`, `{prefix}_parts` and `{prefix}` (key, title, body, processed, text)."""
    low = lower_sql("body")
    ex = {k: f"regexp_extract_all({{0}}, '{v}', 1)" for k, v in _PATTERNS.items()}
    rm = {k: f"regexp_replace({{0}}, '{v}', '', 'g')" for k, v in _PATTERNS.items()}
    _cte(
        f"{prefix}_blocks",
        f"""
        select {key}, title, body, p, li, code, {ex['pre'].format('b3')} as pre from (
        select *, {ex['code'].format('b2')} as code, {rm['code'].format('b2')} as b3 from (
        select *, {ex['li'].format('b1')} as li, {rm['li'].format('b1')} as b2 from (
        select {key}, {lower_sql('title')} as title, body, {ex['p'].format('body')} as p,
               {rm['p'].format('body')} as b1
        from (select {key}, title, {low} as body from {source}))))""",
        source,
    )
    _cte(
        f"{prefix}_kept",
        f"select {key}, body, string_split({normal_sql('title')}, ' ') as title, "
        + ", ".join(
            f"string_split({normal_sql(join_sql(n), widen)}, ' ') as {n}" for n in _PATTERNS
        )
        + f" from {prefix}_blocks",
        f"{prefix}_blocks",
    )
    _cte(
        f"{prefix}_parts",
        f"select {key}, body, {spell_sql('title')} as title, "
        + ", ".join(f"{spell_sql(n)} as {n}" for n in _PATTERNS)
        + f" from {prefix}_kept",
        f"{prefix}_kept",
    )
    _cte(
        prefix,
        f"""select *, {collapse_sql("title || ' ' || processed")} as text from (
        select {key}, title, body,
               p || ' ' || {trim_sql('code')} || ' ' || li || ' ' || pre as processed
        from {prefix}_parts)""",
        f"{prefix}_parts",
    )


_clean_ctes("docs", "q_docs", "idx")
_clean_ctes("wide", "q_docs", "idx", widen=True)
_clean_ctes("pagetext", "q_pages", "idx")
_cte("train_docs", "select d.idx, d.text, q.tags from docs d join q_train q using (idx)", "docs", "q_train")
_cte("known", """select t.test_idx, min(r.idx) as train_idx from q_test t join q_train r using (title)
    group by t.test_idx""", "q_test", "q_train")
_cte("test_docs", """select d.idx - t.n as test_idx, d.text from docs d, n_all a, n_train t
    where d.idx * 5 >= 4 * a.n""", "docs", "n_all", "n_train")


def _gram_ctes(prefix: str, source: str, key: str) -> None:
    _cte(
        f"{prefix}_tokens",
        f"select {key}, regexp_extract_all(text, '[a-z0-9_]{{2,}}') as tok from {source}",
        source,
    )
    _cte(
        f"{prefix}_tokrows",
        f"select {key}, unnest(tok) as t, generate_subscripts(tok, 1) as pos from {prefix}_tokens",
        f"{prefix}_tokens",
    )
    _cte(
        f"{prefix}_grams",
        f"""select {key}, t as term from {prefix}_tokrows union all
        select a.{key}, a.t || ' ' || b.t from {prefix}_tokrows a join {prefix}_tokrows b
        on a.{key} = b.{key} and b.pos = a.pos + 1""",
        f"{prefix}_tokrows",
    )
    _cte(
        f"{prefix}_tf",
        f"select {key}, term, count(*) as tf from {prefix}_grams group by {key}, term",
        f"{prefix}_grams",
    )


_gram_ctes("docs", "docs", "idx")
_gram_ctes("train", "train_docs", "idx")
_gram_ctes("test", "test_docs", "test_idx")


def _vocab_ctes(prefix: str, n: str) -> None:
    _cte(f"{prefix}_df", f"select term, count(*) as df from {prefix}_tf group by term", f"{prefix}_tf")
    _cte(
        f"{prefix}_vocab",
        f"""select term, df, row_number() over (order by term) - 1 as feature_id,
               ln((1.0 + n) / (1.0 + df)) + 1.0 as idf
        from {prefix}_df, {n} where df >= {MIN_DF} * n""",
        f"{prefix}_df", n,
    )


_vocab_ctes("docs", "n_all")
_vocab_ctes("train", "n_train")


def _tfidf_cte(name: str, tf: str, vocab: str, key: str) -> None:
    _cte(
        name,
        f"""select {key}, term, feature_id, x / sqrt(sum(x * x) over (partition by {key})) as value
        from (select {key}, term, feature_id, tf * idf as x from {tf} join {vocab} using (term))""",
        tf, vocab,
    )


_tfidf_cte("docs_x", "docs_tf", "docs_vocab", "idx")
_tfidf_cte("train_x", "train_tf", "train_vocab", "idx")
_tfidf_cte("test_x", "test_tf", "train_vocab", "test_idx")

# Tags of all posts and of the training posts.
for _p, _source in (("all", "q_docs"), ("train", "q_train")):
    _cte(
        f"{_p}_rowtags",
        f"select distinct idx, unnest({words_sql('lower(tags)')}) as tag from {_source}",
        _source,
    )
    _cte(f"{_p}_tagcnt", f"select tag, count(*) as cnt from {_p}_rowtags group by tag", f"{_p}_rowtags")
    _cte(
        f"{_p}_tagids",
        f"select tag, cnt, row_number() over (order by tag) - 1 as tag_id from {_p}_tagcnt",
        f"{_p}_tagcnt",
    )
    _cte(
        f"{_p}_tagstats",
        f"""select tag, cnt, tag_id,
            cast(coalesce(sum(cnt) over (order by tag_id rows between unbounded preceding
                 and 1 preceding), 0) as bigint) as "offset",
            row_number() over (order by cnt desc, tag_id desc) - 1 as rank from {_p}_tagids""",
        f"{_p}_tagids",
    )
_cte("top", f"select rank, tag from train_tagstats where rank < {N_TAGS}", "train_tagstats")
_cte("few", f"select rank, tag from train_tagstats where rank < {TRAIN_TAGS}", "train_tagstats")
_cte(
    "positives",
    f"""select distinct q.idx, top.rank from (select idx, unnest({words_sql('tags')}) as tag
    from q_train) q join top using (tag)""",
    "q_train", "top",
)
# Weights from term counts.
_cte("pos_n", "select rank, count(*) as pos_n from positives group by rank", "positives")
_cte(
    "pos_df",
    "select rank, feature_id, count(*) as pos from train_x join positives using (idx) group by all",
    "train_x", "positives",
)
_cte(
    "weights",
    """select t.rank, v.feature_id,
        ln((coalesce(p.pos, 0) + 1.0) / (pos_n + 2.0))
        - ln((v.df - coalesce(p.pos, 0) + 1.0) / (n - pos_n + 2.0)) as w
    from train_vocab v cross join top t join pos_n using (rank) cross join n_train
    left join pos_df p on p.rank = t.rank and p.feature_id = v.feature_id""",
    "train_vocab", "top", "pos_n", "n_train", "pos_df",
)
_cte(
    "bias",
    "select rank, ln((pos_n + 1.0) / (n - pos_n + 1.0)) as b from pos_n, n_train",
    "pos_n", "n_train",
)


def _score_cte(name: str, rows: str, x: str, key: str, *needs: str) -> None:
    _cte(
        name,
        f"""select r.{key}, bias.rank, b + coalesce(z, 0) as z,
            1.0 / (1.0 + exp(-(b + coalesce(z, 0)))) as score
        from {rows} r cross join bias left join
        (select {key}, rank, sum(value * w) as z from {x} join weights using (feature_id)
         group by {key}, rank) s on s.{key} = r.{key} and s.rank = bias.rank""",
        rows, x, "weights", "bias", *needs,
    )


_score_cte("train_scores", "q_train", "train_x", "idx")
_score_cte("test_scores", "q_test", "test_x", "test_idx")
_cte(
    "train_y",
    """select s.*, case when p.rank is null then 0.0 else 1.0 end as y from train_scores s
    left join positives p on p.idx = s.idx and p.rank = s.rank""",
    "train_scores", "positives",
)
_cte(
    "predicted",
    """select t.test_idx, coalesce(a.tags, '') as tags from q_test t left join
    (select test_idx, string_agg(tag, ' ' order by rank) as tags from test_scores
     join top using (rank) where score > 0.5 group by test_idx) a using (test_idx)""",
    "q_test", "test_scores", "top",
)
# One optimizer step of the trainer from weights 0, for the first tags.
_cte(
    "first_rows",
    """select rank, n / 2.0 + pos_n as mass, pos_n / 2.0 as hits from pos_n join few using (rank), n_train""",
    "pos_n", "few", "n_train",
)
_cte(
    "first_gradient",
    """select m.rank, v.term, -2.0 / mass * coalesce(p.vy, 0) * 0.25
        + 2.0 * hits / (mass * mass) * v.v * 0.25 as g
    from (select term, feature_id, sum(value) as v from train_x group by all) v
    cross join first_rows m left join
    (select rank, feature_id, sum(value) as vy from train_x join positives using (idx) group by all) p
    on p.rank = m.rank and p.feature_id = v.feature_id
    union all
    select rank, '', -2.0 / mass * hits * 2 * 0.25 + 2.0 * hits / (mass * mass) * n * 0.25
    from first_rows, n_train""",
    "train_x", "first_rows", "positives", "n_train",
)
# Projection cells of the training vocabulary: each feature's gaps, added up.


def _projection_ctes(cells: str, projected: str, k: int) -> None:
    mean = f"({k} * 2.0 / draws)"
    _cte(
        cells,
        f"""select feature_id, dim, {hash_sql(f'feature_id * {k} + dim', 16)} % 2 * 2 - 1 as sign from (
        select feature_id, cast(sum(gap) over (partition by feature_id order by j) as bigint) - 1 as dim from (
            select feature_id, j, cast(floor(ln(({hash_sql('feature_id * steps + j', 15)} + 1) / {float(PRIME + 1)})
                / ln(1 - 2.0 / draws::double)) as bigint) + 1 as gap
            from train_vocab, (
                select draws, least({k}, cast(ceil({mean} + 12 * sqrt({mean}) + 12) as bigint)) as steps
                from (select cast(floor(2 * sqrt(count(*))) as bigint) as draws from train_vocab)),
                (select unnest(range({k})) as j)
            where j < steps))
        where dim < {k}""",
        "train_vocab",
    )
    _cte(
        projected,
        f"select idx, dim, sum(value * sign) as value from train_x join {cells} using (feature_id) group by all",
        "train_x", cells,
    )


_projection_ctes("cells", "projected", PROJECTION_DIMS)
_projection_ctes("wide_cells", "wide_projected", WIDE_DIMS)

# Trainings, iteration by iteration.


def _training_rows_ctes(name: str, tags: str, features: str, batches: int, needs: tuple[str, ...]) -> None:
    """The rows of a training, their targets, and the state before the first iteration."""
    _cte(
        f"{name}_rows",
        f"""select idx, idx <= n * 3 // 4 - 2 as learns, {hash_sql('idx', 23)} % {batches} as batch
        from (select row_number() over (order by idx) - 1 as idx from q_train), n_train""",
        "q_train", "n_train",
    )
    _cte(
        f"{name}_y",
        f"""select r.idx, t.rank, case when p.rank is null then 0.0 else 1.0 end as y from {name}_rows r
        cross join {tags} t left join positives p on p.idx = r.idx and p.rank = t.rank""",
        f"{name}_rows", tags, "positives",
    )
    _cte(
        f"{name}_s0",
        f"""select feature_id, rank, 0.0::double as w, 0.0::double as ms, 0.0::double as mom
        from (select feature_id from {features} union all select -1) cross join {tags}""",
        tags, *needs,
    )


def _training_ctes(
    name: str, tags: str, features: str, values: Callable[[int], str], numbers: tuple[int, int, int],
    loss: str, step_rate: float, needs: tuple[str, ...],
) -> str:
    """The SQL `(rank, feature_id, w)` of a training, whose iterations become expressions.

    `features` lists the features but the bias; `values(i)` selects `(idx, feature_id, value)` in
    iteration i, and -1 gives those that are validated on.
    """
    iterations, score_every, batches = numbers
    decay = 2 * 0.001
    _training_rows_ctes(name, tags, features, batches, needs)

    def outputs(i: int, which: str, weights: str) -> str:
        x = f"select * from ({values(i)}) union all select idx, -1, 1.0 from {name}_rows"
        return f"""select idx, rank, any_value(y) as y, sum(value * w) as z from ({x}) x
            join {name}_rows using (idx) join {weights} using (feature_id) join {name}_y using (idx, rank)
            where {which} group by idx, rank"""

    for i in range(iterations):
        before = f"{name}_s{i}"
        which = f"learns and batch = {i % batches}"
        if loss == "f_measure":
            parts, terms = "1.0 / (1.0 + exp(-z)) as p", ("y * p", "y + p", "y * p * (1 - p)", "p * (1 - p)")
            slope = "2 * hits / (mass * mass) * coalesce(b, 0) - 2 / mass * coalesce(a, 0)"
        else:
            parts, terms = "greatest(1 - (2 * y - 1) * z, 0) as p", ("0", "0", "-2 * (2 * y - 1) * p", "0")
            slope = "coalesce(a, 0) / n"
        hit, mass, first, second = terms
        _cte(f"{name}_p{i}", f"select *, {parts} from ({outputs(i, which, before)})", f"{name}_rows", f"{name}_y", before, *needs)
        _cte(
            f"{name}_t{i}",
            f"select rank, sum({hit}) as hits, sum({mass}) as mass, count(*) as n from {name}_p{i} group by rank",
            f"{name}_p{i}",
        )
        _cte(
            f"{name}_g{i}",
            f"""select feature_id, rank, sum(value * {first}) as a, sum(value * {second}) as b
            from (select * from ({values(i)}) union all select idx, -1, 1.0 from {name}_rows)
            join {name}_p{i} using (idx) group by all""",
            f"{name}_p{i}", f"{name}_rows", *needs,
        )
        _cte(
            f"{name}_s{i + 1}",
            f"""select feature_id, rank, w - mom as w, ms, mom from (
            select feature_id, rank, w, ms, 0.9 * mom + {step_rate} * g / sqrt(ms + 1e-8) as mom from (
            select feature_id, rank, w, 0.9 * ms + (1.0 - 0.9) * g * g as ms, mom, g from (
            select s.feature_id, s.rank, w, ms, mom,
                {slope} + case when s.feature_id = -1 then 0 else {decay} / n * w end as g
            from {before} s join {name}_t{i} using (rank)
            left join {name}_g{i} d on d.feature_id = s.feature_id and d.rank = s.rank)))""",
            before, f"{name}_t{i}", f"{name}_g{i}",
        )
    scored = sorted({*range(score_every, iterations + 1, score_every), iterations})
    for i in scored:
        if loss == "f_measure":
            value = "coalesce(2 * sum(y * p) / nullif(sum(y) + sum(p), 0), 0.0)"
            rows = f"select *, 1.0 / (1.0 + exp(-z)) as p from ({outputs(-1, 'not learns', f'{name}_s{i}')})"
        else:
            value, rows = "-avg(pow(greatest(1 - (2 * y - 1) * z, 0), 2))", outputs(-1, "not learns", f"{name}_s{i}")
        _cte(
            f"{name}_v{i}", f"select rank, {i} as iteration, {value} as score from ({rows}) group by rank",
            f"{name}_s{i}", f"{name}_rows", f"{name}_y", *needs,
        )
    every_score = " union all ".join(f"select * from {name}_v{i}" for i in scored)
    best = f"select rank, min_by(iteration, (-score, iteration)) as iteration from ({every_score}) group by rank"
    states = " union all ".join(f"select {i} as iteration, feature_id, rank, w from {name}_s{i}" for i in scored)
    return with_ctes(
        f"""select rank, feature_id, {r6('w')} as w from ({states}) join ({best}) using (rank, iteration)""",
        *[f"{name}_s{i}" for i in scored], *[f"{name}_v{i}" for i in scored],
    )


def _long_training_sql(
    name: str, tags: str, features: str, values: str, numbers: tuple[int, int, int], step_rate: float,
    needs: tuple[str, ...],
) -> str:
    """`_training_ctes` of the F-measure for many iterations: one expression that is repeated.

    A repetition takes the outputs of the state of iteration i, scores them if i is scored, keeps
    the weights of the best score, and makes the state of i + 1.
    """
    iterations, score_every, batches = numbers
    _training_rows_ctes(name, tags, features, batches, needs)
    _cte(
        f"{name}_x",
        f"""select x.idx, feature_id, value, learns, batch from (select * from ({values}) union all
        select idx, -1, 1.0 from {name}_rows) x join {name}_rows using (idx)""",
        f"{name}_rows", *needs,
    )
    learning = f"(learns and batch = i % {batches})"
    scored = f"(i > 0 and (i % {score_every} = 0 or i = {iterations}))"
    steps = f"""with p as materialized (
        select idx, rank, y, learns, 1.0 / (1.0 + exp(-z)) as p from (
        select idx, rank, learns, sum(value * w) as z
        from {name}_x join (select i, feature_id, rank, w from {name}_steps) using (feature_id)
        where {learning} or (not learns and {scored}) group by idx, rank, learns) join {name}_y using (idx, rank)),
    t as (
        select rank, sum(y * p) as hits, sum(y + p) as mass, count(*) as n from p where learns group by rank),
    v as (
        select rank, coalesce(2 * sum(y * p) / nullif(sum(y) + sum(p), 0), 0.0) as score from p
        where not learns group by rank),
    g as (
        select feature_id, rank, sum(value * y * p * (1 - p)) as a, sum(value * p * (1 - p)) as b
        from (select idx, feature_id, value from {name}_x where learns) join (select * from p where learns)
        using (idx) group by all)
    select feature_id, rank, i + 1 as i, w - mom as w, ms, mom, best, score from (
    select feature_id, rank, i, w, ms, 0.9 * mom + {step_rate} * g / sqrt(ms + 1e-8) as mom, best, score from (
    select feature_id, rank, i, w, 0.9 * ms + (1.0 - 0.9) * g * g as ms, mom, g, best, score from (
    select s.feature_id, s.rank, i, w, ms, mom,
        2 * hits / (mass * mass) * coalesce(b, 0) - 2 / mass * coalesce(a, 0)
            + case when s.feature_id = -1 then 0 else {2 * 0.001} / n * w end as g,
        case when s.score is null or v.score > s.score then w else best end as best,
        case when s.score is null or v.score > s.score then v.score else s.score end as score
    from {name}_steps s join t using (rank) left join v on v.rank = s.rank
    left join g on g.feature_id = s.feature_id and g.rank = s.rank where i <= {iterations})))"""
    start = f"select feature_id, rank, 0 as i, w, ms, mom, w as best, null::double as score from {name}_s0"
    final = f"select rank, feature_id, {r6('best')} as w from {name}_steps where score is not null"
    sql = with_ctes(final, f"{name}_s0", f"{name}_x", f"{name}_y")
    repeated = f"{name}_steps using key (feature_id, rank) as ({start} union (select * from ({steps})))"
    before, _, _ = sql.rpartition("\n" + final)
    return before.replace("with ", "with recursive ", 1) + ",\n" + repeated + "\n" + final


def noisy_sql(step: int) -> str:
    """The projected values of an iteration with its noise; of -1 without."""
    if step < 0:
        return "select idx, dim as feature_id, value from dense"
    level = max(1.0 - step / MARGIN_TRAINING[0], 0.0)
    cell = f"(idx % {PRIME}) * {PROJECTION_DIMS} + dim"
    return f"""select idx, dim as feature_id,
        value + {level} * {normal_noise_sql(cell, MARGIN_NOISE_SEED + 2 * step)} as value from dense"""


_cte(
    "dense",
    f"""select idx, dim, coalesce(p.value, 0) as value
    from (select idx, unnest(range({PROJECTION_DIMS})) as dim from q_train) r left join projected p using (idx, dim)""",
    "q_train", "projected",
)
_cte("dense_ids", f"select unnest(range({PROJECTION_DIMS})) as feature_id")


def detected_sql(tag: str, text: str) -> str:
    return (
        f"(contains({text}, {tag}) or (contains({tag}, '-') and len(list_filter("
        f"string_split({tag}, '-'), lambda x: not contains({text}, x))) = 0))"
    )


_cte(
    "coverage",
    f"""select w.idx,
        sum({detected_sql('tag', 'w.title')}::int) as in_title,
        sum(({detected_sql('tag', 'w.body')} and {detected_sql('tag', 'w.processed')})::int)
            as in_both_bodies,
        sum({detected_sql('tag', 'w.body')}::int) as in_body,
        sum({detected_sql('tag', '(w.title || w.body)')}::int) as in_title_body,
        sum({detected_sql('tag', '(w.title || w.processed)')}::int) as in_title_processed,
        count(*) as n_tags,
        any_value(strlen(w.processed)) as processed_length,
        any_value(strlen(w.body)) as body_length
    from wide w join (select idx, unnest(string_split(tags, ' ')) as tag from q_docs) t
    using (idx) group by w.idx""",
    "wide", "q_docs",
)
_COVERAGE = (
    "in_title", "in_both_bodies", "in_body", "in_title_body", "in_title_processed", "n_tags",
    "processed_length", "body_length",
)


def _bin_sql(p: str) -> str:
    width = f"((n + 1) // {BINS})"
    return f"(({p} + 1) // {width}) as bin, ({p} + 1) // {width} * {width} < n + 1 as inside"


def _top_bin(items: str, name: str, source: str, *needs: str) -> str:
    return with_ctes(
        f"""select bin, {name}, cnt, position from (
        select *, row_number() over (partition by bin order by cnt desc, {name}) as position from (
        select bin, {name}, count(*) as cnt from (
            select unnest({items}) as {name}, {_bin_sql('idx')} from {source}, n_all)
        where inside group by bin, {name})) where position <= 1000""",
        "n_all", *needs,
    )


def oracles() -> dict[str, str]:
    """SQL by query name."""
    o: dict[str, str] = {}
    cols = "idx, title, body, tags"
    o["scan_questions"] = with_ctes(
        'select idx as "Id", title as "Title", body as "Body", tags as "Tags" from q_docs', "q_docs"
    )
    o["scan_test_questions"] = with_ctes(
        f'select test_idx + {FIRST_TEST_ID} as "Id", title as "Title", body as "Body" from q_test',
        "q_test",
    )
    o["write_questions"] = with_ctes(
        f"""select idx as "Id", title as "Title", body as "Body", tags as "Tags" from q_docs
        where idx in (select min(idx) from q_docs group by title)""",
        "q_docs",
    )
    o["row_index"] = "select doc_id, row_number() over (order by text, doc_id) - 1 as row_index from documents"
    o["slice_rows"] = with_ctes(
        "select idx, title from (select *, row_number() over (order by idx) + 1 as line from q_docs),"
        " n_all where line >= n // 4 + 1 and line <= n // 2",
        "q_docs", "n_all",
    )
    o["count_records"] = "select count(*) + 1 as n_records from documents"
    o["model_roundtrip"] = with_ctes(
        f"select 'term' as kind, term as name, feature_id as position, {r6('idf')} as value from train_vocab"
        " union all select 'tag', tag, rank, 0.0 from top"
        f" union all select 'weight', cast(feature_id as varchar), rank, {r6('w')} from weights"
        f" union all select 'weight', '-1', rank, {r6('b')} from bias"
        " union all select 'corpus', 'n_docs', 0, n from n_train",
        "train_vocab", "top", "weights", "bias", "n_train",
    )
    o["project_tags"] = with_ctes("select idx, tags from q_docs", "q_docs")
    o["drop_known"] = with_ctes(
        "select test_idx, title from q_test where test_idx not in (select test_idx from known)",
        "q_test", "known",
    )
    o["tag_detected"] = with_ctes(
        f"""select idx, tag, {detected_sql('tag', 'body')} as detected from
        (select idx, {lower_sql('body')} as body, unnest(string_split(tags, ' ')) as tag from q_docs)""",
        "q_docs",
    )
    o["match_known"] = with_ctes("select test_idx, train_idx from known", "known")
    o["known_tags"] = with_ctes(
        "select test_idx, tags from known join q_train on idx = train_idx", "known", "q_train"
    )
    o["merge_answers"] = with_ctes(
        f"""select t.test_idx + {FIRST_TEST_ID} as "Id",
            coalesce(q.tags, 'guess-' || cast(t.test_idx as varchar)) as "Tags"
        from q_test t left join known using (test_idx) left join q_train q on q.idx = train_idx""",
        "q_test", "known", "q_train",
    )
    o["dedup_by_title"] = with_ctes(
        f"select {cols} from q_docs where idx in (select min(idx) from q_docs group by title)", "q_docs"
    )
    o["first_per_title"] = with_ctes(
        "select title, min(idx) as idx from q_docs group by title", "q_docs"
    )
    o["tag_counts"] = with_ctes("select tag, cnt from all_tagcnt", "all_tagcnt")
    o["tag_occurrences"] = with_ctes(
        "select tag_id, idx from all_rowtags join all_tagids using (tag)", "all_rowtags", "all_tagids"
    )
    o["top_words_by_bin"] = _top_bin(words_sql("text"), "word", "docs", "docs")
    o["top_tags_by_bin"] = _top_bin(words_sql("tags"), "tag", "q_docs", "q_docs")
    o["row_bins"] = with_ctes(
        f"select idx, case when inside then bin end as bin from (select idx, {_bin_sql('idx')} from q_docs, n_all)",
        "q_docs", "n_all",
    )
    o["doc_freq"] = with_ctes("select term, df from docs_df", "docs_df")
    o["term_freq"] = with_ctes("select idx, term, tf from docs_tf", "docs_tf")
    sums = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in _COVERAGE)
    o["tag_coverage"] = with_ctes(f"select {sums} from coverage", "coverage")
    running = ", ".join(f"cast(sum({c}) over (order by idx) as bigint) as {c}" for c in _COVERAGE)
    o["running_coverage"] = with_ctes(f"select idx, {running} from coverage", "coverage")
    o["repeat_rate"] = with_ctes(
        "select (select count(*) from known) as n_known, (select count(*) from q_test) as n_test",
        "known", "q_test",
    )
    o["eval_margin"] = with_ctes(
        f"""select rank, {r6('avg(abs(z - (2 * y - 1)))')} as mean_abs_error,
            {r6('avg(pow(greatest(1 - (2 * y - 1) * z, 0), 2))')} as loss,
            {r6('0.001 * any_value(squares) / count(*)')} as penalty
        from train_y join (select rank, sum(w * w) as squares from weights group by rank) s using (rank)
        group by rank""",
        "train_y", "weights",
    )
    o["f_measure"] = with_ctes(
        f"""select rank, {r6('2 * sum(y * score) / (sum(y) + sum(score))')} as soft_f,
            {r6('2 * sum(y * h) / nullif(sum(y) + sum(h), 0)')} as hard_f
        from (select *, case when score > 0.5 then 1.0 else 0.0 end as h from train_y) group by rank""",
        "train_y",
    )
    o["f_measure"] = o["f_measure"].replace(
        "round(2 * sum(y * h) / nullif(sum(y) + sum(h), 0), 6)",
        "round(coalesce(2 * sum(y * h) / nullif(sum(y) + sum(h), 0), 0.0), 6)",
    )
    stats = 'tag, cnt, tag_id, "offset"'
    o["tag_rank"] = with_ctes(f"select {stats}, rank from all_tagstats", "all_tagstats")
    o["tag_offsets"] = with_ctes(
        f"""select {stats}, coalesce(lead("offset") over (order by tag_id),
            (select cast(sum(cnt) as bigint) from all_tagcnt)) - "offset" as width from all_tagstats""",
        "all_tagstats",
    )
    o["top_tags"] = with_ctes(
        "select rank, tag from all_tagstats where rank between 2 and 17", "all_tagstats"
    )
    o["vocab_index"] = with_ctes("select term, feature_id from docs_vocab", "docs_vocab")
    o["ascii_lower"] = f"select doc_id, {lower_sql('text')} as lowered from documents"
    sep = "'|'"
    o["extract_blocks"] = with_ctes(
        "select idx, "
        + ", ".join(
            f"len({b}) as n_{b}, coalesce(array_to_string({b}, {sep}), '') as {b}" for b in _PATTERNS
        )
        + " from (select * from docs_blocks union all select -1 - idx as idx, * exclude (idx) from pagetext_blocks)",
        "docs_blocks", "pagetext_blocks",
    )
    o["join_fragments"] = with_ctes(
        " union all ".join(
            f"select {idx} as idx, " + ", ".join(f"{join_sql(b)} as {b}" for b in ("p", "li", "code", "pre"))
            + f" from {source}"
            for idx, source in (("idx", "docs_blocks"), ("-1 - idx", "pagetext_blocks"))
        ),
        "docs_blocks", "pagetext_blocks",
    )
    low_html = lower_sql("html")
    o["unescape_angle"] = f"select page_id, {unescape_sql(low_html)} as html from pages"
    o["strip_tags"] = f"select page_id, {tags_sql(low_html)} as html from pages"
    o["strip_brackets"] = with_ctes(
        f"select idx, {brackets_sql('body')} as body from (select * from q_docs union all "
        "select -1 - idx as idx, * exclude (idx) from q_pages)",
        "q_docs", "q_pages",
    )
    o["keep_chars"] = f"select doc_id, {keep_sql(lower_sql('text'))} as kept from documents"
    o["spell_numbers"] = (
        f"select doc_id, {spell_sql('kept')} as spelled from "
        f"(select doc_id, string_split({keep_sql(lower_sql('text'))}, ' ') as kept from documents)"
    )
    o["trim_words"] = (
        f"select doc_id, {trim_sql('kept')} as trimmed from "
        f"(select doc_id, {keep_sql(lower_sql('text'))} as kept from documents)"
    )
    o["clean_title"] = with_ctes("select idx, title from docs", "docs")
    o["process_body"] = with_ctes(
        f"select idx, processed, strlen(processed) as n_bytes from wide", "wide"
    )
    o["clean_questions"] = with_ctes("select idx, text from docs", "docs")
    o["clean_pages"] = with_ctes("select idx, text from pagetext", "pagetext")
    o["tokens"] = with_ctes(
        "select idx, len(tok) as n_tokens, coalesce(array_to_string(tok, ' '), '') as tokens from docs_tokens",
        "docs_tokens",
    )
    o["ngrams"] = with_ctes(
        "select idx, term, count(*) as n from docs_grams group by idx, term", "docs_grams"
    )
    o["vocabulary"] = with_ctes("select term, df from docs_vocab", "docs_vocab")
    o["idf"] = with_ctes(f"select term, {r6('idf')} as idf from docs_vocab", "docs_vocab")
    o["tag_vocab"] = with_ctes("select tag, tag_id from all_tagids", "all_tagids")
    o["tag_ids"] = with_ctes(
        "select idx, tag, tag_id from all_rowtags join all_tagids using (tag)",
        "all_rowtags", "all_tagids",
    )
    o["tfidf"] = with_ctes(f"select idx, term, {r6('value')} as value from docs_x", "docs_x")
    o["tfidf_transform_test"] = with_ctes(
        f"select test_idx, term, feature_id, {r6('value')} as value from test_x", "test_x"
    )
    o["feature_rows"] = with_ctes(
        f"""select idx, count(*) as nnz, min(feature_id) as first_id, max(feature_id) as last_id,
        {r6('sum(value)')} as total, {r6('sum(value * value)')} as norm,
        {r6('sum(value * feature_id)')} as moment from docs_x group by idx""",
        "docs_x",
    )
    o["projection"] = with_ctes("select feature_id, dim, cast(sign as integer) as sign from cells", "cells")
    o["project_features"] = with_ctes(
        f"select idx, dim, {r6('value')} as value from projected", "projected"
    )
    o["projection_wide"] = with_ctes(
        "select feature_id, dim, cast(sign as integer) as sign from wide_cells", "wide_cells"
    )
    o["project_wide"] = with_ctes(
        f"""select idx, cast({WIDE_DIMS} as bigint) as width, {r6('coalesce(sum(value), 0)')} as total,
            {r6('coalesce(sum(value * value), 0)')} as norm, {r6(f'coalesce(sum(value * dim), 0) / {WIDE_DIMS}')} as moment,
            {r6(f'case when count(dim) = {WIDE_DIMS} then max(value) else greatest(coalesce(max(value), 0), 0) end')} as largest
        from q_train left join wide_projected using (idx) group by idx""",
        "q_train", "wide_projected",
    )
    max_steps = f"({NOISE_PASSES} * n // {NOISE_BATCH})"
    o["noise_schedule"] = with_ctes(
        f"""select idx as step, {r6(f'greatest(1.0 - idx / {max_steps}::double, 0.0)')} as level
        from q_docs, n_train""",
        "q_docs", "n_train",
    )
    cell = f"(idx % {PRIME}) * {PROJECTION_DIMS} + dim"
    o["corrupt"] = with_ctes(
        f"""select idx, dim, {r6(f"coalesce(p.value, 0) + 0.5 * {normal_noise_sql(cell, 7)}")} as value
        from (select idx, unnest(range({PROJECTION_DIMS})) as dim from q_train) r
        left join projected p using (idx, dim)""",
        "q_train", "projected",
    )
    o["ovr_targets"] = with_ctes(
        """select q.idx, t.rank, case when p.rank is null then -1 else 1 end as target
        from q_train q cross join top t left join positives p on p.idx = q.idx and p.rank = t.rank""",
        "q_train", "top", "positives",
    )
    o["label_targets"] = "select doc_id, 'quality' as label, 2 * quality - 1 as target from labels union all select doc_id, 'toxic', 2 * toxic - 1 from labels"
    o["split_rows"] = with_ctes(
        """select idx, case when line <= n // 2 then 'train' else 'valid' end as part
        from (select idx, row_number() over (order by idx) + 1 as line from q_docs), n_all
        where line <= n // 2 + n // 4""",
        "q_docs", "n_all",
    )
    o["train_step"] = with_ctes(
        "select rank, term, round(g, 6) + 0.0 as gradient from first_gradient", "first_gradient"
    )
    o["rmsprop_step"] = with_ctes(
        f"""select rank, term, {r6('0.1 * g * g')} as ms, {r6('-mom')} as w, {r6('mom')} as mom from
        (select *, 0.01 * g / sqrt(0.1 * g * g + 1e-8) as mom from first_gradient)""",
        "first_gradient",
    )
    _cte(
        "decay_p",
        """select idx, rank, y, score as p, y * score as yp from train_y join few using (rank)""",
        "train_y", "few",
    )
    _cte(
        "decay_t",
        "select rank, sum(yp) as hits, sum(y + p) as mass, count(*) as n from decay_p group by rank",
        "decay_p",
    )
    _cte(
        "decay_g",
        """select feature_id, rank, sum(value * yp * (1 - p)) as a, sum(value * p * (1 - p)) as b
        from (select idx, feature_id, value from train_x union all select idx, -1, 1.0 from q_train)
        join decay_p using (idx) group by all""",
        "train_x", "q_train", "decay_p",
    )
    o["train_step_decay"] = with_ctes(
        f"""select rank, term, {r6('w')} as w, {r6("""2 * hits / (mass * mass) * b - 2 / mass * a
            + case when term = '' then 0 else 2 * 0.001 / n * w end""")} as gradient
        from (select feature_id, term, rank, w from weights join train_vocab using (feature_id) join few using (rank)
              union all select -1, '', rank, b from bias join few using (rank))
        join decay_g using (feature_id, rank) join decay_t using (rank)""",
        "weights", "train_vocab", "bias", "few", "decay_g", "decay_t",
    )
    tfidf = "select idx, feature_id, value from train_x"
    o["train_tags"] = _training_ctes(
        "few_tags", "few", "train_vocab", lambda i: tfidf, TAG_TRAINING, "f_measure", 0.01, ("train_x", "train_vocab")
    )
    o["train_all_tags"] = _long_training_sql(
        "all_tags", "top", "train_vocab", tfidf, ALL_TRAINING, 0.01, ("train_x", "train_vocab")
    )
    o["train_margin"] = _training_ctes(
        "margin", "few", "dense_ids", noisy_sql, MARGIN_TRAINING, "squared_hinge", MARGIN_STEP_RATE,
        ("dense", "dense_ids"),
    )
    o["occurrence_runs"] = with_ctes(
        f"""select position, tag_id, idx from (
        select row_number() over (order by tag_id, idx) - 1 as position, tag_id, idx
        from all_rowtags join all_tagids using (tag))
        where tag_id in (select tag_id from all_tagstats where rank between {RUN_RANKS[0]} and {RUN_RANKS[1]})""",
        "all_rowtags", "all_tagids", "all_tagstats",
    )
    o["best_iteration"] = with_ctes(
        f"""select rank, iteration, score from (
        select *, row_number() over (partition by rank order by score desc, iteration) as k from (
        select rank, iteration, {r6('2 * sum(y * p) / (sum(y) + sum(p))')} as score from (
            select rank, y, iteration, 1.0 / (1.0 + exp(-z * iteration / 10.0)) as p
            from train_y, (select unnest({list(SCORED_STEPS)}) as iteration))
        group by rank, iteration)) where k = 1""",
        "train_y",
    )
    o["squared_hinge"] = with_ctes(
        f"select idx, rank, {r6('pow(greatest(1 - (2 * y - 1) * z, 0), 2)')} as loss from train_y",
        "train_y",
    )
    o["score_tags"] = with_ctes(
        f"select test_idx, rank, {r6('score')} as score from test_scores", "test_scores"
    )
    o["predict_tags"] = with_ctes("select test_idx, tags from predicted", "predicted")
    o["predict_unanswered"] = with_ctes(
        "select test_idx, tags from predicted where test_idx not in (select test_idx from known)",
        "predicted", "known",
    )
    o["submission"] = with_ctes(
        f"""select p.test_idx + {FIRST_TEST_ID} as "Id", coalesce(q.tags, p.tags) as "Tags"
        from predicted p left join known using (test_idx) left join q_train q on q.idx = train_idx""",
        "predicted", "known", "q_train",
    )
    o["submission_files"] = with_ctes(
        f"""select 'submission' as file, row_number() over (order by p.test_idx) - 1 as position,
            p.test_idx + {FIRST_TEST_ID} as "Id", coalesce(q.tags, p.tags) as "Tags"
        from predicted p left join known using (test_idx) left join q_train q on q.idx = train_idx
        union all
        select 'presubmission', row_number() over (order by test_idx) - 1, null, tags
        from predicted where test_idx not in (select test_idx from known)""",
        "predicted", "known", "q_train",
    )
    o["score_stream"] = o["predict_tags"]
    o["predict_batches"] = o["predict_tags"]
    o["prepare_positions"] = with_ctes(
        """select row_number() over (order by idx) - 1 as position, idx from q_train
        where idx in (select min(idx) from q_train group by title)""",
        "q_train",
    )
    return o
