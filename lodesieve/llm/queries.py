"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesieve.llm import bpe, chat, contamination, embedding_dedup, langid, minhash, quality, records, token_counts, toxicity
from lodesieve.sources.scratch import Scratch

#: Folder of the tokenizer files; None: that of the installed package.
TOKENIZERS: str | None = None


def tokenizer(name: str, folder: str | None = None) -> str:
    folder = folder or TOKENIZERS
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    extra = spark.sql("select -7L as conv_id, t as turn, element_at(array('user', 'assistant'), cast(t + 1 as int)) as role from range(2) r(t)").withColumn("text", F.lit(text))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    scratch = Scratch(spark, "chat")
    made = scratch.save(chat.format_trees(chat.thread_nodes(spark, turns, scratch), scratch), "made")
    return chat.digests(made)


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(spark, docs, labels.where(remainder(5) != 0))
    return toxicity.scored(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted", "offending")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identified(spark, table(spark, sf_dir, "documents"), remainder(4) != 2)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "xent", "accepted")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")), Scratch(spark, "lengths"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(spark, table(spark, sf_dir, "embeddings"))


def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "records")
    records.write_records(spark, table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 2, scratch.root)
    return records.read_records(spark, scratch.root).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": chat_formatting,
        "op2_toxicity": toxicity_scores,
        "op3_language_id": language_id,
        "op4_minhash_dedup": near_dedup,
        "op5_quality": quality_scores,
        "op6_decontamination": decontamination,
        "op7_token_counts": token_histogram,
        "op8_bpe": bpe_round_trip,
        "op9_embedding_dedup": embedding_near_dedup,
        "op10_token_records": token_records,
    }


#: Distinct five-word shingles (or the whole sequence of one to four words) of a table's texts, as lists of words.
SHINGLES = r"""
select {id} as id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) end) as s
from (select {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from {table} where text is not null)
"""


def oracle_sql() -> dict[str, str]:
    docs, items = SHINGLES.format(id="doc_id", table="documents"), SHINGLES.format(id="item_id", table="benchmark")
    return {
        "op1_chat_formatting": r"""
            with t as (
                select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                union all select -7, n, case n when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(n))
            select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
                coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
                sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
                sum(length('### ' || role || chr(10) || text || chr(10) || '</turn>' || chr(10)) + length(regexp_replace(role || text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\n]', '', 'g')))::bigint as formatted_chars
            from t group by conv_id""",
        "op4_minhash_dedup": f"""
            with recursive s as ({docs}), n as (select id, count(*) as n from s group by id),
            p as (select a.id as u, b.id as v, count(*) as c from s a join s b on a.s = b.s and a.id < b.id group by 1, 2),
            e as (select u, v from p join n x on x.id = u join n y on y.id = v where 100 * c >= 85 * (x.n + y.n - c)),
            both_ways as (select u, v from e union all select v, u from e),
            r(id, c) as (select doc_id, doc_id from documents union select b.v, r.c from r join both_ways b on b.u = r.id where r.c < b.v or r.c < b.u)
            select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.c)::bigint as component_id, d.doc_id = min(r.c) as kept
            from documents d join r on r.id = d.doc_id left join n on n.id = d.doc_id group by d.doc_id, n.n""",
        "op6_decontamination": f"""
            with s as ({docs}), q as ({items}), n as (select id, count(*) as n from q group by id)
            select s.id::bigint as doc_id, q.id::bigint as item_id, count(*)::bigint as shared, n.n::bigint as item_shingles
            from s join q on s.s = q.s join n on n.id = q.id group by all having 100 * count(*) >= 80 * n.n""",
        "op9_embedding_dedup": """
            with recursive v as (select vec_id, embedding::double[] as x from embeddings where embedding is not null),
            g as (select * from v where len(list_filter(x, lambda y: y is null or not isfinite(y))) = 0 and list_dot_product(x, x) > 0),
            e as (select a.vec_id as u, b.vec_id as w from g a join g b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where list_cosine_similarity(a.x, b.x) >= 0.95),
            r(id, c) as (select vec_id, vec_id from embeddings union select e.w, r.c from r join e on e.u = r.id where r.c < e.w or r.c < e.u),
            k as (select u, count(*) as n from e group by u)
            select m.vec_id, coalesce(k.n, 0)::bigint as n_links, min(r.c)::bigint as component_id, m.vec_id = min(r.c) as kept
            from embeddings m join r on r.id = m.vec_id left join k on k.u = m.vec_id group by m.vec_id, k.n""",
    }
