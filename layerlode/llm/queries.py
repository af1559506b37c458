"""Queries of the ten operators over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from layerlode.llm.ann import DIGITS, NEIGHBOURS, nearest_neighbours
from layerlode.llm.bpe import bpe_encode
from layerlode.llm.common import table
from layerlode.llm.html import extract_text
from layerlode.llm.kdtree import kd_tree_shards
from layerlode.llm.minhash import near_duplicate_groups
from layerlode.llm.mixing import ALPHAS, ITERATIONS, KEEP, SEED, mix_documents
from layerlode.llm.quantisation import THRESHOLD, near_duplicate_vectors
from layerlode.llm.suffix_tree import suffix_tree_scores
from layerlode.llm.toxicity import toxicity_scores
from layerlode.llm.warc import CHUNK_BYTES, SEGMENT_BYTES, page_records, reassemble


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_tree_shards(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassemble(page_records(table(spark, sf_dir, "pages")))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"))


def _shares(dimension: str) -> str:
    return f"select {dimension} as v, pow(sum(tokens), {ALPHAS[dimension]}) as t from facts group by 1 having sum(tokens) > 0"


def _step(dimension: str, source: str) -> str:
    rest = ", ".join(d for d in ("source", "lang", "topic") if d != dimension)
    return f"""select i, {dimension}, {rest}, tokens, case when sum(w) over (partition by {dimension}) > 0
        then w * want_{dimension} / sum(w) over (partition by {dimension}) else 0 end as w, want_source, want_lang, want_topic from {source}"""


def _fill(source: str, have: str, want: str, amount: str, name: str) -> str:
    """``source`` with a column ``name``: least(have, scale * want) at the scale where they sum to ``amount``.

    In the order of have / want, those before the first whose share at the rest's scale is less than it has are full.
    """
    order = f"(order by {have} / {want} rows between unbounded preceding and current row)"
    return f"""select f.*, case when {want} > 0 then least({have}, coalesce(s.scale * {want}, {have})) else 0 end as {name} from ({source}) f
        left join (select arg_min(scale, ratio) as scale from (
            select {have} / {want} as ratio, greatest({amount} - (sum({have}) over {order} - {have}), 0) / (sum({want}) over () - (sum({want}) over {order} - {want})) as scale
            from ({source}) where {want} > 0) where scale < ratio) s on true"""


def _want(dimension: str) -> str:
    return _fill(f"select v, t / (select sum(t) from ({_shares(dimension)})) as share, have from ({_shares(dimension)}) join (select {dimension} as v, cast(sum(tokens) as double) as have from facts group by 1) using (v)", "have", "share", f"({KEEP} * (select sum(tokens) from cells))", "want")


def _held(dimension: str, source: str) -> str:
    rest = ", ".join(d for d in ("source", "lang", "topic") if d != dimension)
    return f"""select i, {dimension}, {rest}, tokens, weight, least(tokens, case when sum(k) over (partition by {dimension}) > 0
        then k * room_{dimension} / sum(k) over (partition by {dimension}) else 0 end) as k, room_source, room_lang, room_topic from {source}"""


#: Iterative proportional fitting as two recursive queries, a turn being a step for each dimension: exact weights, then
#: shares of at most 1 that keep the budget.
_MIXING_SQL = f"""
with recursive topics as (
    select vec_id, cast(min(label) as varchar) as topic from embeddings where vec_id is not null and label is not null group by vec_id
), facts as (
    select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, coalesce(topic, 'unknown') as topic,
        cast(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) as bigint) as tokens,
        coalesce(cast(doc_id as varchar), 't' || md5(coalesce(text, ''))) as ident
    from documents left join topics on doc_id = vec_id
), cells as (
    select source, lang, topic, cast(sum(tokens) as double) as tokens from facts group by 1, 2, 3
), wants as (
    select c.*, coalesce(s.t, 0) / (select sum(t) from ({_shares("source")})) as want_source,
        coalesce(l.t, 0) / (select sum(t) from ({_shares("lang")})) as want_lang,
        coalesce(p.t, 0) / (select sum(t) from ({_shares("topic")})) as want_topic
    from cells c left join ({_shares("source")}) s on s.v = c.source left join ({_shares("lang")}) l on l.v = c.lang
        left join ({_shares("topic")}) p on p.v = c.topic
), fitted as (
    select 0 as i, source, lang, topic, tokens, tokens / (select sum(tokens) from cells) as w, want_source, want_lang, want_topic from wants
    union all
    select i + 1, source, lang, topic, tokens, w, want_source, want_lang, want_topic
    from ({_step("topic", f"({_step('lang', f'({_step("source", "fitted")})')})")}) where i < {ITERATIONS}
), weights as (
    select source, lang, topic, tokens, case when tokens > 0 then w * sum(tokens) over () / tokens else 0 end as weight, w * sum(tokens) over () as wanted from fitted where i = {ITERATIONS}
), room_s as ({_want("source")}), room_l as ({_want("lang")}), room_t as ({_want("topic")}),
begun as (
    select b.*, coalesce(s.want, 0) as room_source, coalesce(l.want, 0) as room_lang, coalesce(p.want, 0) as room_topic
    from ({_fill("select source, lang, topic, tokens, weight, wanted from weights", "tokens", "wanted", f"({KEEP} * (select sum(tokens) from cells))", "k")}) b
    left join room_s s on s.v = b.source left join room_l l on l.v = b.lang left join room_t p on p.v = b.topic
), held as (
    select 0 as i, source, lang, topic, tokens, weight, k, room_source, room_lang, room_topic from begun
    union all
    select i + 1, source, lang, topic, tokens, weight, k, room_source, room_lang, room_topic
    from ({_held("topic", f"({_held('lang', f'({_held("source", "held")})')})")}) where i < {ITERATIONS}
), last as (
    select source, lang, topic, tokens, weight, k from held where i = {ITERATIONS}
), drawn as (
    select source, lang, topic, weight, case when tokens > 0 then kept / tokens else 0 end as probability
    from ({_fill("select * from last", "tokens", "k", f"({KEEP} * (select sum(tokens) from cells))", "kept")})
)
select doc_id, source, lang, topic, tokens as n_tokens, round(weight, 6) as weight, round(probability, 6) as probability
from facts join drawn using (source, lang, topic)
where cast(('0x' || substr(md5('{SEED}-' || ident), 1, 13)) as bigint) / {float(1 << 52)} < probability
"""

#: The head of 87 bytes, and for each chunk its hexadecimal size and two line ends.
_WARC_SQL = f"""
with sized as (
    select page_id, url, html, octet_length(encode(html)) as n from pages where html is not null
), framed as (
    select *, 87 + (n // {CHUNK_BYTES}) * ({CHUNK_BYTES} + 4 + {len(f"{CHUNK_BYTES:x}")})
        + case when n % {CHUNK_BYTES} > 0 then n % {CHUNK_BYTES} + 4 + length(to_hex(n % {CHUNK_BYTES})) else 0 end + 5 as block from sized
)
select coalesce(cast(page_id as varchar), 'none') || '-' || md5(coalesce(url, '') || html) as record_id, url as target_uri, 200 as status,
    cast((block + {SEGMENT_BYTES - 1}) // {SEGMENT_BYTES} as int) as n_segments, cast(n as bigint) as n_bytes, html as body, cast(null as varchar) as problem
from framed
"""

_VECTORS = "select vec_id, min(cast(embedding as double[])) as v from embeddings where vec_id is not null and len(embedding) > 0 group by vec_id"
_NEIGHBOURS_SQL = f"""
with vectors as ({_VECTORS}), pairs as (
    select a.vec_id, b.vec_id as neighbour_id, round(list_cosine_similarity(a.v, b.v), {DIGITS}) as cosine
    from vectors a join vectors b on a.vec_id <> b.vec_id
), ranked as (
    select *, row_number() over (partition by vec_id order by cosine desc, neighbour_id) as rank from pairs
)
select vec_id, cast(rank as int) as rank, neighbour_id, cosine from ranked where rank <= {NEIGHBOURS}
"""
#: Groups by reachability; the search is approximate, at this size it finds all.
_VECTOR_GROUPS_SQL = f"""
with recursive vectors as ({_VECTORS}), edges as (
    select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
), reach as (
    select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a
), least as (
    select a, least(a, min(b)) as group_id from reach group by a
)
select group_id, count(*) as n_vectors, list_sort(list(a)) as vec_ids from least group by group_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_sharding, op3_mixing, op4_toxicity, op5_near_dedup, op6_warc, op7_html, op8_neighbours, op9_embedding_dedup, op10_bpe)}
ORACLE_SQL: dict[str, str] = {"op3_mixing": _MIXING_SQL, "op6_warc": _WARC_SQL, "op8_neighbours": _NEIGHBOURS_SQL, "op9_embedding_dedup": _VECTOR_GROUPS_SQL}
