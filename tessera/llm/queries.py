"""The operators' queries over the documents and conversations tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import chat_perspectives
from .common import read_table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .importance import importance_resample
from .language_id import language_id
from .line_dedup import line_dedup
from .mixing import mix
from .near_dedup import near_dedup
from .pii import find_pii
from .piece_bpe import piece_digests
from .pivot_codes import pivot_codes
from .quality_rules import WORDS_AND_PAIRS, quality_rules
from .substring_dedup import substring_dedup


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_perspectives(read_table(spark, sf_dir, "conversations"))


def piece_model() -> str:
    """The file's place, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read_table(spark, sf_dir, "documents"), piece_model())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "n_spans")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), orders=WORDS_AND_PAIRS)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_codes(read_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def _vector_codes_sql(rounds: int = 2) -> str:
    """Every distance worked out; a round's pick and its next codebook are relations of their own."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        pick{k} as materialized (
            select vec_id, part, min(row(d, entry)) as best from (
                select c.vec_id, c.part, b.entry, sum((c.q - b.q) * (c.q - b.q)) as d from comp c join book{k} b on c.part = b.part and c.pos = b.pos group by all)
            group by all)""")
        if k < rounds:
            steps.append(f"""
        book{k + 1} as materialized (
            select b.part, b.entry, b.pos, coalesce(n.q, b.q) as q from book{k} b left join (
                select c.part, p.best[2] as entry, c.pos, cast(floor(sum(c.q) / count(*)) as bigint) as q from comp c join pick{k} p on c.vec_id = p.vec_id and c.part = p.part group by all) n
            on b.part = n.part and b.entry = n.entry and b.pos = n.pos)""")
    return f"""
        with flat as (
            select vec_id, label, len(embedding) // 16 as width, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
        comp as materialized (
            select vec_id, label, i // width as part, i % width as pos, cast(floor(256 * cast(x as double)) as bigint) as q from flat
            where vec_id in (select vec_id from flat group by vec_id having bool_and(x is not null and isfinite(x)))),
        book0 as materialized (
            select part, dense_rank() over (order by vec_id) - 1 as entry, pos, q from comp
            where vec_id in (select distinct vec_id from comp order by vec_id limit 64)),{",".join(steps)},
        coded as (
            select vec_id, string_agg(printf('%02x', best[2]), '' order by part) as code, cast(sum(best[1]) as bigint) as error from pick{rounds} group by vec_id),
        named as (select coded.*, e.label from coded join embeddings e on coded.vec_id = e.vec_id)
        select vec_id, label, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
            (select sha256(string_agg(q, ',' order by part, entry, pos)) from book{rounds}) as codebooks_sha256
        from named"""


SQL = {
    "op1_chat_format": """
        with t as (
            select distinct conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text
            from conversations),
        c as (select *, coalesce(cast(floor(turn / 256) as bigint), -1) as chunk from t),
        p as (select distinct conv_id, role as perspective from t where role <> 'system'),
        r as (
            select c.*, p.perspective, role = perspective as own,
                '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system' else 'user name=' || role end || chr(10) as head,
                c.text || '<|im_end|>' as body
            from c join p on c.conv_id is not distinct from p.conv_id),
        o as (
            select *, cast(coalesce(sum(length(head) + length(body) + 1) over (
                partition by conv_id, perspective, chunk order by turn nulls first, role, text rows between unbounded preceding and 1 preceding), 0) as bigint) as pos
            from r)
        select conv_id, perspective, chunk, count(*) as n_turns, count(*) filter (where own) as n_target_turns,
            string_agg(head || body || chr(10), '' order by turn nulls first, role, text) as text,
            coalesce(string_agg(concat(pos + length(head), ':', pos + length(head) + length(body)), ',' order by turn nulls first, role, text) filter (where own), '') as mask
        from o group by conv_id, perspective, chunk""",
    "op3_exact_dedup": """
        with g as (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1)
        select d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, false) as kept, sha256(g.t) as text_sha256
        from documents d join g on coalesce(d.text, '') = g.t""",
    "op7_line_dedup": r"""
        with lines as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
        keyed as (
            select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
        hot as (select k, max(doc_id) as holder from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
        marked as (select keyed.*, coalesce(keyed.doc_id < hot.holder, false) as gone from keyed left join hot on keyed.k = hot.k)
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
        from marked group by doc_id""",
    "op11_vector_codes": _vector_codes_sql(),
    # CRC-32 of every distinct word, a byte a step, with the table of its 256 remainders.
    "op12_importance_resampling": r"""
        with recursive remainders(i, k, c) as (
            select cast(range as bigint), 0, cast(range as bigint) from range(256)
            union all
            select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from remainders where k < 8),
        steps as materialized (select i, c from remainders where k = 8),
        occ as materialized (
            select doc_id, cast(null as bigint) as item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
            union all
            select null, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
        crc(w, hx, pos, c) as (
            select w, hex(encode(w)), 0, 4294967295 from (select distinct w from occ)
            union all
            select w, hx, pos + 1, xor(crc.c >> 8, steps.c)
            from crc join steps on steps.i = xor(crc.c, cast('0x' || substr(hx, 2 * pos + 1, 2) as bigint)) & 255 where 2 * pos < length(hx)),
        bucketed as materialized (select w, xor(c, 4294967295) % 10000 as bucket from crc where 2 * pos = length(hx)),
        counts as (
            select bucket, count(doc_id) as s, count(item_id) as t from occ join bucketed on occ.w = bucketed.w group by bucket),
        totals as (select count(doc_id) as s_all, count(item_id) as t_all from occ),
        gains as materialized (
            select bucket, cast(floor(1000 * ln((t + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000)))) as bigint) as gain from counts, totals),
        weighed as (
            select occ.doc_id, count(*) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight
            from occ join bucketed on occ.w = bucketed.w join gains on bucketed.bucket = gains.bucket where occ.doc_id is not null group by occ.doc_id),
        scored as (
            select d.doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
            from documents d left join weighed w on d.doc_id = w.doc_id),
        ranked as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as r, (select count(*) from scored where n_features >= 20) as n from scored)
        select doc_id, n_features, weight, score, case when n_features >= 20 and r <= 10 * n // 100 then r end as rank from ranked""",
    "op13_decontamination": r"""
        with d as (
            select row_number() over () as rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words from documents),
        i as (
            select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
        iw as materialized (
            select distinct item_id, k, array_to_string(words[s : s + k - 1], ' ') as w
            from (select *, unnest(range(1, len(words) - k + 2)) as s from (select *, least(len(words), 10) as k from i where len(words) > 0))),
        dw as (
            select rid, k, s, array_to_string(words[s : s + k - 1], ' ') as w
            from (select rid, words, k, unnest(range(1, len(words) - k + 2)) as s from d, (select distinct k from iw) where len(words) >= k)),
        met as materialized (select dw.rid, dw.s, dw.k, iw.item_id from dw join iw on dw.w = iw.w and dw.k = iw.k),
        hit as (
            select rid, count(distinct p) as n from (select rid, unnest(range(s, s + k)) as p from (select distinct rid, s, k from met)) group by rid),
        named as (
            select rid, count(*) as n, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, cast(item_id as varchar) as item_id from met) group by rid)
        select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(named.n, 0) as n_items,
            sha256(coalesce(named.ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
        from d left join hit on d.rid = hit.rid left join named on d.rid = named.rid""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_sentencepiece,
        op3_exact_dedup,
        op4_substring_dedup,
        op5_language_id,
        op6_near_dedup,
        op7_line_dedup,
        op8_pii,
        op9_mixing,
        op10_quality_rules,
        op11_vector_codes,
        op12_importance_resampling,
        op13_decontamination,
    )
}
