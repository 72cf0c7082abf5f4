"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from timelore.llm import mixing, url_tree, warc


def warc_sql() -> str:
    letters = " || ".join(f"substr('{warc.LETTERS}', ((v >> {15 - 5 * k}) & 31) + 1, 1)" for k in range(4))
    return f"""
    with rows as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d, sha256(coalesce(html, '')) as s from pages),
    firsts as (select s, max(page_id) as f from rows group by s),
    digests as (select *, list_transform(range(0, 8), lambda i: cast('0x' || substr(d, cast(5 * i + 1 as int), 5) as bigint)) as parts from rows)
    select page_id, cast(n as bigint) as payload_bytes, array_to_string(list_transform(parts, lambda v: {letters}), '') as payload_digest,
        case when page_id = f then 'response' else 'revisit' end as record_type, case when page_id <> f then f end as refers_to, s as payload_sha256
    from digests join firsts using (s)"""


def mixture_sql(temper: float = 0.7, rate: float = 0.6, rounds: int = 80, seed: str = "mix") -> str:
    """Raking within the cells' tokens, in a fixed number of rounds that is far more than the tables need."""
    names = "source, lang, topic, tokens, want, most, " + ", ".join(f"goal_{m}" for m in mixing.MARGINALS)

    def lines(src: str, group: str) -> str:
        order = "order by want / most desc rows between"
        return f"""(select *, coalesce(sum(most) over ({group} {order} unbounded preceding and 1 preceding), 0) as before, sum(want) over ({group} {order} current row and unbounded following) as rest from {src})"""

    def factor(goal: str, group: str) -> str:
        return f"greatest(0, max(case when rest > 0 then ({goal} - before) / rest else 0 end) over ({group}))"

    body = f"(select * from raked where it < {rounds})"
    for m in mixing.MARGINALS:
        body = f"(select it, {names} from (select * replace (want * {factor(f'goal_{m}', f'partition by {m}')} as want) from {lines(body, f'partition by {m}')}))"
    goals = ", ".join(
        f"""v_{m} as (select {m}, cast(sum(tokens) as double) as most, pow(cast(sum(tokens) as double), {temper}) as w from cells group by 1),
        s_{m} as (select *, w / sum(w) over () as want, (select cast({rate} * sum(tokens) as double) from cells) as whole from v_{m}),
        t_{m} as (select {m}, least(most, want * {factor('whole', '')}) as goal_{m} from {lines(f's_{m}', '')})"""
        for m in mixing.MARGINALS
    )
    return f"""
    with recursive docs as (select doc_id, coalesce(source, '{mixing.NULL}') as source, coalesce(lang, '{mixing.NULL}') as lang,
        case when contains(text, ' | ') then 'table' when contains(text, '@') then 'contact' when contains(text, 'http://') or contains(text, 'https://') then 'links'
            when contains(text, 'icense') or contains(text, 'opyright') then 'legal' when contains(text, '!!') or contains(text, '***') then 'noise' else 'prose' end as topic,
        case when coalesce(length(text), 0) = 0 then 0 else length(text) - length(translate(text, ' ' || chr(10) || chr(9), '')) + 1 end as tokens from documents),
    cells as (select source, lang, topic, sum(tokens) as tokens from docs group by all having sum(tokens) > 0), {goals},
    raked as (select 0 as it, source, lang, topic, tokens, cast({rate} * tokens as double) as want, cast(tokens as double) as most, {", ".join(f"goal_{m}" for m in mixing.MARGINALS)} from cells join t_source using (source) join t_lang using (lang) join t_topic using (topic)
        union all select it + 1, {names} from {body}),
    chances as (select source, lang, topic, least(want, most) / most as probability from raked where it = {rounds})
    select doc_id, source, lang, topic, cast(tokens as bigint) as tokens, round(case when tokens = 0 then 1.0 else coalesce(probability, 0) end, 6) as probability from docs left join chances using (source, lang, topic)
    where cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '{mixing.NULL}') || '{seed}'), 1, 8) as bigint) / 4294967296.0 < case when tokens = 0 then 1.0 else coalesce(probability, 0) end"""


def url_sql() -> str:
    names = [f"t{k}" for k in range(1, url_tree.DEPTH + 1)]
    levels, last = [], "typed0"
    for k in range(1, url_tree.DEPTH + 1):
        parent = ", ".join(["host", *names[: k - 1]])
        t = f"t{k}"
        levels.append(f"""k{k} as (select {parent}, {t}, sum(n) as n, sum(good) as good from {last} group by all),
        p{k} as (select *, sum(n) over (partition by {parent}) as an, sum(good) over (partition by {parent}) as ag from k{k}),
        z{k} as (select *, an - n as o, ag - good as og, ag / nullif(an, 0) as pool from p{k}),
        m{k} as (select {parent}, {t}, case when {t} = '' then '' when (case when n >= 5 and o >= 5 and sqrt(pool * (1 - pool) * (1 / n + 1 / o)) > 0 then abs(good / n - og / o) / sqrt(pool * (1 - pool) * (1 / n + 1 / o)) else 0 end) >= {url_tree.Z} or (o = 0 and n >= 5) then {t} else '*' end as new from z{k}),
        typed{k} as (select x.* replace (m.new as {t}) from {last} x join m{k} m using ({parent}, {t}))""")
        last = f"typed{k}"
    keys = ", ".join(["host", *names])
    rules = sorted(url_tree.RULES, key=lambda r: (-len(r[0]), -len(r[1]), r[2] != "block"))
    fits = [(f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v) for h, p, v in rules]
    name = "case " + " ".join(f"when {c} then '{n}'" for c, n, _ in fits) + " end"
    fixed = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in fits) + " end"
    picks = ", ".join(f"coalesce(case when regexp_matches(s[{k}], '^\\d+(\\.\\w+)?$|^[0-9a-fA-F-]{{8,}}$|\\d.*\\d.*\\d') then '*' else s[{k}] end, '') as s{k}" for k in range(1, url_tree.DEPTH + 1))
    first = ", ".join(f"s{k}" for k in range(1, url_tree.DEPTH + 1))
    copies = ", ".join(f"s{k} as t{k}" for k in range(1, url_tree.DEPTH + 1))
    a = url_tree.SMOOTHING
    return f"""
    with cut as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
    parts as (select page_id, host, path, {picks} from (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as s from cut)),
    marks as (select doc_id as page_id, max(quality) as good from labels group by 1),
    typed0 as (select host, {first}, {copies}, count(good) as n, coalesce(sum(good), 0) as good from parts left join marks using (page_id) group by all),
    {", ".join(levels)},
    total as (select case when sum(n) > 0 then sum(good) / sum(n) else 1.0 end as base from {last}),
    hosts as (select host, (sum(good) + {a} * any_value(base)) / (sum(n) + {a}) as hp from {last}, total group by host),
    leaves as (select {keys}, round((sum(good) + {a} * any_value(hp)) / (sum(n) + {a}), 9) as purity from {last} join hosts using (host) group by all),
    tree as (select host, {first}, {', '.join(names)}, purity from {last} join leaves using ({keys}))
    select page_id, host, path, {name} as rule, coalesce({fixed}, case when purity < {url_tree.MIN_PURITY} then 'block' else 'allow' end) as verdict,
        '/' || array_to_string(list_filter([{', '.join(names)}], lambda x: x <> ''), '/') as template, purity from parts left join tree using (host, {first})"""


NEAR_DUP = """
    with recursive words as (select doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as ws from documents where text is not null),
    keyed as (select doc_id, case when len(ws) > 0 then 'w' || array_to_string(ws, ' ') else 'r' || text end as key, ws from words),
    reps as (select key, min(doc_id) as rep, any_value(ws) as ws from keyed group by key),
    grams as (select rep, array_to_string(ws[i : i + 4], ' ') as g from (select rep, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as i from reps where len(ws) > 0)),
    counts as (select rep, g, count(*) as n from grams group by all), totals as (select rep, sum(n) as t from counts group by 1),
    shared as (select a.rep as x, b.rep as y, sum(least(a.n, b.n)) as s from counts a join counts b on a.g = b.g and a.rep < b.rep group by all),
    links as (select x, y from shared join totals p on p.rep = x join totals q on q.rep = y where s >= 0.8 * (p.t + q.t - s)),
    both_ways as (select x, y from links union all select y, x from links),
    reach(id, root) as (select rep, rep from reps union select y, root from reach join both_ways on x = id),
    labels_of as (select id, min(root) as class_id from reach group by id)
    select doc_id, class_id from keyed join reps using (key) join labels_of on id = rep union all select doc_id, doc_id from documents where text is null"""

ORACLE_SQL = {"op3_warc_archive": warc_sql(), "op6_near_dup": NEAR_DUP, "op8_mixture": mixture_sql(), "op9_url_tree": url_sql()}
