"""The registered queries of the corpus operators and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, decontaminate, embeddings, fim, langid, merkle, mixing, quality, secrets, sharding, simhash, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"), words=3, max_bits=2)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicate(_table(spark, folder, "documents"))


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = sharding.sized(_table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    shards = sharding.shard_by_bytes(docs, 40, "size", ["doc_id", "text_crc32"])
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1)
    model = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, ("doc_id", "held_out"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"), cosine=0.98)


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.grade(docs, toxicity.learn(docs, _table(spark, folder, "labels")))


def op9_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(_table(spark, folder, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(_table(spark, folder, "documents"))[0]


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digests(_table(spark, folder, "documents"))


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(_table(spark, folder, "documents"), path), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    drawn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 0
    found = merkle.manifest(_table(spark, folder, "documents"), tampered=drawn, changed={"n_chars": F.col("n_chars") + 1})
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES.update(
    op1_simhash_near_dedup=op1_simhash_near_dedup,
    op2_decontamination=op2_decontamination,
    op3_substring_dedup=op3_substring_dedup,
    op4_sharding=op4_sharding,
    op5_language_id=op5_language_id,
    op6_secret_scan=op6_secret_scan,
    op7_embedding_near_dedup=op7_embedding_near_dedup,
    op8_toxicity=op8_toxicity,
    op9_source_mixing=op9_source_mixing,
    op10_quality_classifier=op10_quality_classifier,
    op11_fill_in_middle=op11_fill_in_middle,
    op12_bpe=op12_bpe,
    op13_merkle_manifest=op13_merkle_manifest,
)

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

ORACLES["op2_decontamination"] = f"""
with items as (select coalesce(item_id::varchar, '') item, {_WORDS} w from benchmark),
spread as (select item, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from items where len(w) > 0),
asked as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') win from spread),
docs as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
places as (select rid, w, k, unnest(range(1, len(w) - k + 2)) i from docs, (select distinct k from asked)),
hits as (select rid, i, k, item from (select rid, i, k, array_to_string(w[i:i + k - 1], ' ') win from places) join asked using (k, win)),
covered as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + k)) p from hits) group by rid),
named as (select rid, count(distinct item) n_items, string_agg(distinct item, ',' order by item) s from hits group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(s, '')) items_sha256, n is not null contaminated
from docs left join covered using (rid) left join named using (rid)
"""

ORACLES["op4_sharding"] = """
with recursive steps as (
    select b, 0 n, b::bigint c from range(256) t(b)
    union all select b, n + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end from steps where n < 8
),
crc as (select list(c order by b) t from steps where n = 8),
docs as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
sized as (
    select doc_id, length(h) // 2 + 16 as size,
           xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
               lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) as text_crc32
    from docs, crc
),
summed as (select *, sum(size) over (order by doc_id, text_crc32) as upto, sum(size) over () as everything from sized),
cut as (select doc_id, size, text_crc32, least(39, ((2 * upto - size)::hugeint * 40) // (2 * everything))::int as shard from summed)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by doc_id, text_crc32) - 1 as slot, null::int as grown_shard
from cut
"""

ORACLES["op9_source_mixing"] = f"""
with recursive docs as (
    select *, coalesce(source, '(none)') ks, coalesce(lang, '(none)') kl, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint tokens,
           case when text is null then '(none)' when contains({_LOWER}, 'licen') then 'licence' when contains(text, ' | ') then 'table' when contains(text, '@') then 'contact' else 'prose' end topic
    from documents
),
cells as (select ks, kl, topic, sum(tokens)::double t from docs group by all),
source_goals as (select ks, case when sum(t) > 0 then sum(t) ** 0.5 else 0 end a from cells group by ks),
lang_goals as (select kl, case when sum(t) > 0 then sum(t) ** 0.7 else 0 end a from cells group by kl),
topic_goals as (select topic, case when sum(t) > 0 then sum(t) ** 0.7 else 0 end a from cells group by topic),
aimed as (
    select c.*, g.goal * s.a / (select sum(a) from source_goals) gs, g.goal * l.a / (select sum(a) from lang_goals) gl, g.goal * p.a / (select sum(a) from topic_goals) gt
    from cells c join source_goals s using (ks) join lang_goals l using (kl) join topic_goals p using (topic), (select sum(t) * 0.5 goal from cells) g
),
rounds as (
    select *, 0 n, t * 0.5 w from aimed
    union all
    select ks, kl, topic, t, gs, gl, gt, n + 1, least(t, w3)
    from (select *, case when sum(w2) over (partition by topic) > 0 then w2 * gt / sum(w2) over (partition by topic) else 0 end w3
          from (select *, case when sum(w1) over (partition by kl) > 0 then w1 * gl / sum(w1) over (partition by kl) else 0 end w2
                from (select *, case when sum(w) over (partition by ks) > 0 then w * gs / sum(w) over (partition by ks) else 0 end w1 from rounds where n < 12)))
),
chances as (select ks, kl, topic, case when t > 0 then w / t else 1 end p from rounds where n = 12)
select doc_id, source, lang, topic, tokens, round(p, 6) probability,
       ('0x' || substr(md5('9:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 < p kept
from docs join chances using (ks, kl, topic)
"""

ORACLES["op11_fill_in_middle"] = """
with docs as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
drawn as (
    select doc_id, t, length(t) n, ('0x' || substr(h, 1, 8))::bigint % (length(t) + 1) c1, ('0x' || substr(h, 9, 8))::bigint % (length(t) + 1) c2,
           case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
                when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end form
    from docs
),
cut as (select *, t[1:least(c1, c2)] p, t[least(c1, c2) + 1:greatest(c1, c2)] m, t[greatest(c1, c2) + 1:] s from drawn),
made as (select *, case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end o from cut)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
       sha256(o) output_sha256,
       sha256(case form when 'plain' then o
              when 'psm' then substr(split_part(o, '<S>', 1), 4) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<M>', 1)
              else split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2) || substr(split_part(o, '<P>', 1), 4) end) restored_sha256
from made
"""

_PUT = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end"
_FIELDS = " || ".join(_PUT.format(c) for c in ("doc_id", "source", "lang", "{n}", "text"))

ORACLES["op13_merkle_manifest"] = f"""
with recursive steps as (
    select b, 0 n, b::bigint c from range(256) t(b)
    union all select b, n + 1, case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end from steps where n < 8
),
crc as (select list(c order by b) t from steps where n = 8),
named as (select *, hex(encode(coalesce(doc_id::varchar, ''))) h from documents),
leaves as (
    select doc_id, lang, sha256({_FIELDS.format(n="n_chars")}) leaf, sha256({_FIELDS.format(n="(n_chars + 1)")}) altered,
           xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
               lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) % 7 = 0 drawn
    from named, crc
),
placed as (select *, coalesce('=' || lang, '') run, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 spot, count(*) over (partition by lang) n from leaves),
levels as (
    select run, 0 level, spot, n, leaf d from placed
    union all
    select run, level + 1, spot // 2, (n + 1) // 2, sha256(d || coalesce(after, ''))
    from (select *, lead(d) over (partition by run order by spot) as after from levels where n > 1) where spot % 2 = 0
),
subroots as (select run, d, row_number() over (order by run) - 1 spot, count(*) over () n from levels where n = 1),
upper_levels as (
    select 0 level, spot, n, d from subroots
    union all
    select level + 1, spot // 2, (n + 1) // 2, sha256(d || coalesce(after, ''))
    from (select *, lead(d) over (order by spot) as after from upper_levels where n > 1) where spot % 2 = 0
),
inside as (
    select run, spot as place, spot, n, 0 level, '' proof, case when drawn and n_known then altered else leaf end folded
    from (select *, altered is not null n_known from placed)
    union all
    select i.run, place, i.spot // 2, (i.n + 1) // 2, i.level + 1, proof || coalesce(s.d, ''), sha256(case when i.spot % 2 = 0 then folded || coalesce(s.d, '') else s.d || folded end)
    from inside i left join levels s on s.run = i.run and s.level = i.level and s.spot = xor(i.spot, 1) where i.n > 1
),
outside as (
    select i.run, place, u.spot, u.n, 0 level, proof, folded from inside i join subroots u on u.run = i.run where i.n = 1
    union all
    select run, place, i.spot // 2, (i.n + 1) // 2, i.level + 1, proof || coalesce(s.d, ''), sha256(case when i.spot % 2 = 0 then folded || coalesce(s.d, '') else s.d || folded end)
    from outside i left join upper_levels s on s.level = i.level and s.spot = xor(i.spot, 1) where i.n > 1
)
select p.doc_id, p.leaf, u.d subroot, (select d from upper_levels where n = 1) root, sha256(o.proof) proof_sha256, o.folded folded_root,
       o.folded = (select d from upper_levels where n = 1) verified
from placed p join outside o on o.run = p.run and o.place = p.spot and o.n = 1 join subroots u on u.run = p.run
"""
