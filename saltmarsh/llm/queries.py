"""Queries of the ten operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, html_extract, lm_scoring, mixing, packing, pii, quality_classifier, quality_rules, secrets_scan, simhash, turn_trie

#: Key of the surrogates where the session sets none; real data need a secret one in spark.saltmarsh.surrogates.key.
DEMONSTRATION_KEY = "not a secret"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.saltmarsh.surrogates.key", DEMONSTRATION_KEY)
    return pii.surrogates(table(spark, sf_dir, "documents"), key.encode())


def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ppm_scoring,
        op2_quality_classifier,
        op3_ivf_pq,
        op4_html_extraction,
        op5_secret_scan,
        op6_simhash_golay,
        op7_best_fit_packing,
        op8_mixing,
        op9_pii_surrogates,
        op10_ngram_quality,
        op11_bpe_round_trip,
        op12_source_divergence,
        op13_conversation_trie,
    )
}

#: Every group's share of every kept term, laid out in full and summed.
SOURCE_DIVERGENCE = r"""
with docs as (
    select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
    from documents
),
words as (select lang, source, doc, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
kept as (select lang, term, count(*) as total from words group by lang, term having count(distinct doc) >= 3),
sizes as (select lang, count(*) as v, sum(total) as lang_n from kept group by lang),
counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by lang, source, term),
groups as (select distinct lang, source from docs),
each_term as (
    select g.lang, g.source, k.term, k.total, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as size
    from groups g join kept k using (lang) left join counts c using (lang, source, term)
),
shares as (
    select lang, source, term, n,
        1 + (1000000000::hugeint * (n + 1)) // (size + v)::hugeint as p,
        1 + (1000000000::hugeint * (total + 1)) // (lang_n + v)::hugeint as q
    from each_term join sizes using (lang)
),
pairs as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
    from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by a.lang, a.source, b.source
),
all_pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value
    from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
),
terms as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from shares where n > 0 and p > q),
ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
    from (select * from all_pairs union all select * from terms)
)
select * from ranked where part = 'pair' or rank <= 200
"""

#: A node's key is the text of all turns up to it, with their lengths; its smallest member's path leads through all nodes above it.
CONVERSATION_TRIE = """
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (
            partition by conv_id
            order by turn nulls first, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), length(coalesce(text, ''))
        ) as pos
    from conversations where conv_id is not null
),
convs as (
    select conv_id, conv_id - conv_id % 100 as family,
        xor(list_reduce(
            list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint),
            lambda crc, c: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(crc, c)),
            4294967295::bigint
        ), 4294967295) % 6 as h
    from (select distinct conv_id from turns)
),
rebuilt as (
    select c.conv_id, 0 as own, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.family and t.pos <= c.h
    union all
    select c.conv_id, 1, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h
),
numbered as (
    select *, row_number() over (partition by conv_id order by own, pos) as depth,
        concat(length(role), ':', length(text), ':', role, text) as turn
    from rebuilt
),
path as (
    select conv_id, 0::bigint as depth, '' as key, 0::bigint as size from convs
    union all
    select conv_id, depth, string_agg(turn, '') over (partition by conv_id order by depth), length(text) from numbered
),
steps as (
    select *, lag(key) over (partition by conv_id order by depth) as above, depth = max(depth) over (partition by conv_id) as ends from path
),
nodes as (
    select depth, key, min(conv_id) as conv_id, any_value(above) as above, count(*) as n_convs, any_value(size) as size,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
    from steps group by depth, key
),
children as (select depth - 1 as depth, above as key, count(*) as n_children from nodes where depth > 0 group by all),
counted as (select n.*, coalesce(c.n_children, 0) as n_children from nodes n left join children c using (depth, key)),
subtrees as (
    select p.depth, p.key, count(*) filter (where c.n_children = 0) as n_leaves, sum((c.n_convs - 1) * c.size)::bigint as saved_tokens
    from counted c join path p on p.conv_id = c.conv_id and p.depth <= c.depth
    group by p.depth, p.key
)
select c.conv_id, c.depth, up.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
from counted c join subtrees s using (depth, key) left join nodes up on up.depth = c.depth - 1 and up.key = c.above
"""

ORACLE: dict[str, str] = {"op13_conversation_trie": CONVERSATION_TRIE, "op12_source_divergence": SOURCE_DIVERGENCE}
