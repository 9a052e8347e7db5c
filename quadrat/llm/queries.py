"""Queries over the text tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, exactdup, media, mixing, neardup, packing, secrets, substring, toxicity, warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), vocabulary())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.groups(_docs(spark, sf_dir)).drop("_at")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_docs(spark, sf_dir)).drop("kept_text")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_docs(spark, sf_dir), floor=0).drop("_at")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_docs(spark, sf_dir)).drop("_rid")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir)).drop("_rid")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.format_pairs(chat.batch_negatives(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return rows.withColumns({"chosen_train": chat.shown("chosen_train"), "rejected_train": chat.shown("rejected_train")})


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op7_mixing, op8_exact_dedup, op9_warc, op10_substring_dedup, op5_near_dedup, op3_toxicity, op6_media_columns, op2_secret_scan, op4_chat_format)}



def _secret_sql() -> str:
    """Places from splits and running sums, entropies of every window anew."""
    quoted = [p.replace("'", "''") for p in secrets.PATTERNS]
    parts = " union all ".join(
        f"select doc_id, {k} as kind, unnest(string_split_regex(t, '{p}')) as gap, unnest(regexp_extract_all(t, '{p}', 0)) as m, unnest(range(len(string_split_regex(t, '{p}')))) as nth from d where regexp_matches(t, '{p}')" for k, p in enumerate(quoted)
    )
    names = str(secrets.KINDS)
    masked = "m"
    for part in secrets.ALLOWED_PARTS:
        masked = f"regexp_replace({masked}, '{part}', '{secrets.MASK * len(part)}', 'gi')"
    limits = " ".join(f"when {3 + k} then {secrets.most_sum(bits)}" for k, (_, _, bits) in enumerate(secrets.CLASSES.values()))
    return f"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        p as ({parts}),
        q as (select *, coalesce(sum(length(gap) + length(m)) over (partition by doc_id, kind order by nth rows between unbounded preceding and 1 preceding), 0)::bigint + length(gap) as a from p),
        base as (select doc_id, kind, a, a + length(m) as z from q where m is not null and kind < 3 and (kind > 0 or length(regexp_extract(m, '{quoted[0]}', 2)) >= {secrets.LEAST_VALUE})),
        runs as (select doc_id, kind, a, nth, case when kind = 3 then lower({masked}) else {masked} end as r, regexp_matches(m, '[0-9]') as mixed from q where m is not null and kind >= 3
                 and (regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]') or kind = 4 and not regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]'))
                 and not regexp_matches(m, '{secrets.ALLOWED_RUN}') and not regexp_matches(right(gap, 12), '{secrets.ALLOWED_BEFORE}') and (kind = 3 or not regexp_matches(m, '^[0-9A-Fa-f]+$'))),
        w as (select *, unnest(range(0, length(r) - {secrets.WINDOW - 1})) as i from runs),
        h as (select doc_id, kind, a, nth, i, mixed, contains(substr(r, i + 1, {secrets.WINDOW}), '{secrets.MASK}') as known, list_sum(list_transform(map_values(list_histogram(string_split(substr(r, i + 1, {secrets.WINDOW}), ''))), lambda c: ({secrets.LOGS})[c::bigint + 1])) as s from w),
        found as (select doc_id, kind, a + min(i) as a, a + max(i) + {secrets.WINDOW} as z from h where not known and s <= case when mixed then case kind {limits} end else {secrets.most_sum(secrets.LETTERS_BITS)} end group by doc_id, kind, a, nth),
        everything as (select * from base union all select * from found),
        shown as (select *, ({names})[kind + 1] || ':' || a || ':' || z as x from everything),
        g as (select doc_id, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2, string_agg(x, ',' order by a, kind) filter (kind < 3) as b, string_agg(x, ',' order by a, kind) as s from shown group by doc_id)
        select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans from d left join g using (doc_id)"""


SQL = {
    "op2_secret_scan": _secret_sql(),
    "op7_mixing": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from s),
        o as (select *, sum(3 * source_size) over p - 3 * source_size as c, sum(w) over q as free, sum(source_size) over () as total from w
              window p as (order by 3.0 * source_size / w, w, source rows unbounded preceding), q as (order by 3.0 * source_size / w, w, source rows between current row and unbounded following)),
        l as (select (total - c)::bigint as rest, free::bigint as shares from o where 3 * source_size::hugeint * free >= w * (total - c)::hugeint order by 3.0 * source_size / w, w, source limit 1),
        t as (select source, source_size, case when w::hugeint * rest > 3 * source_size::hugeint * shares then (3 * source_size)::double else (w * rest)::double / shares::double end as target from w, l),
        r as (select d.doc_id, d.size, t.source_size, t.target,
                     case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
                     ('0x' || substr(md5('1|' || coalesce('=' || d.source, '-')), 1, 5))::bigint::double / 1048576.0::double as drawn,
                     row_number() over (partition by d.source order by d.size, md5(d.doc_id::varchar), d.doc_id) as n
              from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target, (least(floor(rate * n + drawn) - floor(rate * (n - 1) + drawn), 3)::bigint * size)::bigint as taken from r""",
    "op8_exact_dedup": r"""
        with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
        select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(t) as text_sha256
        from n window g as (partition by t)""",
    "op9_warc": r"""
        with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest, coalesce(html, '') as h from pages),
        q as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by h) else page_id end as first from p)
        select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
               case when page_id = first then null else first end as refers_to from q""",
    "op10_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as p from d),
        h as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as h from s),
        f as (select h, min(doc_id) as first from h group by h),
        r as (select h.doc_id, list(p) as ps from h join f using (h) where first < h.doc_id group by h.doc_id),
        g as (select doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 50)))) as gone from r),
        k as (select d.doc_id, d.w, len(d.w) as n, coalesce(g.gone, []) as gone from d left join g using (doc_id)),
        x as (select doc_id, n, len(gone) as n_gone, case when len(gone) = 0 then w when len(gone) = n then [] else list_filter(w, lambda x, i: not list_contains(gone, i)) end as kept from k)
        select doc_id, n::bigint as n_words, n_gone::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from x""",
    "op4_chat_format": r"""
        with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls last, role nulls last, text nulls last) as no from conversations),
        l as (select conv_id, max(no) as last from t where role = 'assistant' group by conv_id),
        a as (select t.*, l.last from t left join l using (conv_id)),
        c as (select * from a where no <= last),
        f as (select conv_id, text, row_number() over (order by md5(conv_id::varchar), conv_id) as rank, count(*) over () as n from c where no = last),
        s as (select conv_id as pair_id, 'chosen' as side, no, role, text from c
              union all select conv_id, 'rejected', no, role, text from c where no < last
              union all select c.conv_id, 'rejected', c.no, c.role, g.text from c join f on c.conv_id = f.conv_id join f g on g.rank = f.rank % f.n + 1 where c.no = c.last),
        d as (select pair_id, no, count(distinct side) as n, count(distinct row(role, text)) as k from s group by pair_id, no),
        p as (select pair_id, min(case when n < 2 or k > 1 then no end) as first from d group by pair_id),
        j as (select s.*, first is null or no < first as shared from s join p using (pair_id)),
        k as (select pair_id, case when shared then 'prompt' else side end as part, no, role, text, not shared and role = 'assistant' as trained from j where not shared or side = 'chosen'
              union all select conv_id, 'rest', no, role, text, false from a where last is null or no > last),
        r as (select *, (no - 1) // 256 as segment, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) as head, coalesce(text, '') as content from k),
        e as (select *, head || content || '<|end|>' || chr(10) as rendered from r),
        o as (select *, sum(length(rendered)) over (partition by pair_id, part, segment order by no) - length(rendered) + length(head) as a from e)
        select pair_id, segment::int as segment, coalesce(string_agg(rendered, '' order by no) filter (part = 'prompt'), '') as prompt, coalesce(string_agg(rendered, '' order by no) filter (part = 'chosen'), '') as chosen,
               coalesce(string_agg(rendered, '' order by no) filter (part = 'rejected'), '') as rejected, coalesce(string_agg(rendered, '' order by no) filter (part = 'rest'), '') as rest,
               coalesce(string_agg(a::bigint || ':' || (a + length(content))::bigint, ',' order by no) filter (part = 'chosen' and trained and content <> ''), '') as chosen_train,
               coalesce(string_agg(a::bigint || ':' || (a + length(content))::bigint, ',' order by no) filter (part = 'rejected' and trained and content <> ''), '') as rejected_train
        from o group by pair_id, segment""",
}
