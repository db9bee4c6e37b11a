"""The queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, collocation, decontamination, media, mixing, near_dedup, packing, quality, substring_dedup, suffix_tree, toxicity, url_reputation, whitening
from quarry.llm.common import id_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = suffix_tree.score_texts(table(spark, sf_dir, "documents"), id_bucket("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_media_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as the 8-bit samples of a WAVE file that is declared plain text, sniffed, corrected and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    stored = docs.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), media.as_wave(media.padded(F.col("data"))).alias("media"), F.lit("text/plain").alias("declared"))
    found = media.sniff(stored, "media", "declared")
    payload = F.substring(F.col("media"), (F.col("sniffed.data_start") + 1).cast("int"), F.col("sniffed.data_length").cast("int"))
    spans = F.array_join(F.transform("sniffed.embedded", lambda s: F.concat_ws(":", s["type"], s["start"], s["length"])), ",")
    return found.withColumn("payload", payload).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), F.octet_length("payload") - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("corrected_type"), F.lit(";valid="), F.col("sniffed.valid").cast("string"), F.lit(";embedded="), spans, F.lit(";"), media.sample_features(F.col("payload"))).alias("feature"),
    )


#: The WAVE file, its digests and levels by bytes; `embedded` is that of texts that have no media of their own, as those of the tables.
OP2_SQL = """
with raw as (select doc_id, encode(coalesce(text, '')) as b from documents),
padded as (select doc_id, octet_length(b) as n, b || unhex(repeat('00', case when n = 0 then 64 else (64 - n % 64) % 64 end)) as payload from raw),
bytes as (select doc_id, i, ('0x' || substr(digits, 2 * i - 1, 2))::int as v from (select doc_id, hex(payload) as digits, unnest(range(1, octet_length(payload) + 1)) as i from padded)),
levels as (
  select doc_id, 'level=' || (sum(v) // count(*)) || ';crossings=' || count(*) filter ((v >= 128) <> (before >= 128)) || ';bands=' || count(*) filter (v < 32) || ',' || count(*) filter (v // 32 = 1) || ',' || count(*) filter (v // 32 = 2)
         || ',' || count(*) filter (v // 32 = 3) || ',' || count(*) filter (v // 32 = 4) || ',' || count(*) filter (v // 32 = 5) || ',' || count(*) filter (v // 32 = 6) || ',' || count(*) filter (v // 32 = 7) as said
  from (select *, lag(v) over (partition by doc_id order by i) as before from bytes) group by doc_id
),
stored as (
  select *, octet_length(payload) as size, hex(payload) as digits,
         'RIFF'::blob || unhex(printf('%02X%02X%02X%02X', (size + 36) & 255, (size + 36) >> 8 & 255, (size + 36) >> 16 & 255, (size + 36) >> 24 & 255)) || 'WAVEfmt '::blob
         || unhex('1000000001000100401F0000401F000001000800') || 'data'::blob || unhex(printf('%02X%02X%02X%02X', size & 255, size >> 8 & 255, size >> 16 & 255, size >> 24 & 255)) || payload as media
  from padded
)
select doc_id, n::bigint as n_bytes, size::bigint as payload_bytes, sha256(payload) as payload_sha256,
       xor(list_reduce(list_transform(range(64), lambda i: ('0x' || substr(digits, len(digits) - 127 + 2 * i, 2))::bigint),
           lambda c, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, byte)), 4294967295::bigint), 4294967295) as tail_crc32,
       octet_length(media)::bigint as media_bytes, sha256(media) as media_sha256, 'audio/wav;valid=true;embedded=;' || said as feature
from stored join levels using (doc_id)
"""


def op3_rabin_karp_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)


_BLANK = r"[\x20\x09-\x0D]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
with parted as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}'), lambda w: w <> '') as ws from documents),
windows as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as said from (select *, unnest(range(1, len(ws) - 48)) as i from parted)),
firsts as (select said, min(doc_id) as least from windows group by said),
gone as (select distinct doc_id, i + o as i from windows join firsts using (said), range(50) r(o) where least < doc_id),
each as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from parted),
kept as (select doc_id, count(*) as n, string_agg(w, ' ' order by i) as said from each anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(said, '')) as kept_sha256 from parted left join kept using (doc_id)
"""


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate_perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("train_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return views.withColumn("train_spans", spans)


OP4_SQL = """
with said as (
  select distinct conv_id, coalesce(turn, -1) as turn, replace(replace(replace(replace(replace(coalesce(role, 'unknown'), '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A') as role,
         replace(coalesce(text, ''), '<|', '< |') as text
  from conversations
),
views as (
  select s.conv_id, v.speaker, cast(floor(s.turn / 256.0) as bigint) as part, s.turn, s.role, s.text, s.role = v.speaker as own,
         case when s.role = v.speaker then '<|assistant|>' when s.role = 'system' then '<|system|>' else '<|user:' || s.role || '|>' end || chr(10) as head
  from said s join (select distinct conv_id, role as speaker from said where role <> 'system') v on s.conv_id is not distinct from v.conv_id
),
placed as (
  select *, coalesce(sum(length(head) + length(text) + 8) over (partition by conv_id, speaker, part order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as pos
  from views
)
select conv_id, speaker, part, cast(count(*) as integer) as n_turns, cast(count(*) filter (own) as integer) as n_trained,
       string_agg(head || text || '<|end|>' || chr(10), '' order by turn, role, text) as rendered,
       coalesce(string_agg(cast(pos + length(head) as bigint) || '-' || cast(pos + length(head) + length(text) + 7 as bigint), ',' order by turn, role, text) filter (own), '') as train_spans
from placed group by conv_id, speaker, part
"""

RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Names are given out below these, so a site is one label more.
SUFFIXES = ("example.com", "example.net", "example.org")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has no labels of its own; the pages that a rule judges are the labelled outcomes."""
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages"), None, RULES, SUFFIXES)
    return judged.withColumn("bad_bound", F.round("bad_bound", 6))


_LAST = r"example\.com|example\.net|example\.org|[^.]+"
_STRENGTH = """select 1 / greatest(0.001::double, least(0.9::double, coalesce(case when sum(n) > count(*) filter (n > 0)
  then (sum(case when n > 0 then n * pow(bad / n - prior, 2) / (prior * (1 - prior)) end) - count(*) filter (n > 0)) / (sum(n) - count(*) filter (n > 0)) else 0.5 end, 0.5))) - 1 from"""
OP9_SQL = f"""
with split as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
),
judged as (
  select *, case
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from split
),
hosts as (
  select host, count(rule)::double as n, count(*) filter (rule in ('example.org/es/', 'example.org/en/1', 'com/de/'))::double as bad,
         regexp_replace(host, '\\.?(:\\d*)?$', '') as site, regexp_matches(site, '^(\\d+\\.)+\\d+$') as numbers,
         case when numbers then '' else regexp_extract(site, '(?:^|\\.)({_LAST})$', 1) end as suffix,
         case when numbers or regexp_extract(site, '(?:^|\\.)([^.]+\\.(?:{_LAST}))$', 1) = '' then site else regexp_extract(site, '(?:^|\\.)([^.]+\\.(?:{_LAST}))$', 1) end as domain
  from judged group by host
),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by domain, suffix),
tops as (select suffix, sum(n) as n, sum(bad) as bad, (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) from hosts) as prior from domains group by suffix),
tops2 as (select suffix, (bad + s * prior) / (n + s) as prior from tops, ({_STRENGTH} tops) t(s)),
domains1 as (select d.*, t.prior from domains d join tops2 t using (suffix)),
domains2 as (select domain, (bad + s * prior) / (n + s) as prior from domains1, ({_STRENGTH} domains1) t(s)),
hosts1 as (select h.*, d.prior from hosts h join domains2 d using (domain)),
hosts2 as (select host, n, (bad + s * prior) / (n + s) as rate, n + s as size from hosts1, ({_STRENGTH} hosts1) t(s)),
bounds as (select host, n, rate - sqrt(rate * (1 - rate) / (size + 1)) as bound from hosts2)
select page_id, host, path, rule,
       case when rule in ('example.org/es/', 'example.org/en/1', 'com/de/') then 'block' when rule is not null then 'allow' when bound >= 0.5 then 'block' else 'allow' end as verdict,
       cast(n as bigint) as n_outcomes, round(bound, 6) as bad_bound
from judged join bounds using (host)
"""


def op5_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.public_tokens())


def op6_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    doc_id = F.nullif("_id", F.lit(near_dedup.LAST))
    return found.select(doc_id.alias("doc_id"), "n_shingles", "component_id", "kept")


OP6_SQL = rf"""
with recursive parted as (select doc_id, list_filter(string_split_regex({_LOW}, '{_BLANK}'), lambda w: w <> '') as ws from documents),
sets as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as said from (select *, unnest(range(1, greatest(2, len(ws) - 3))) as i from parted where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from sets a join sets b on a.said = b.said and a.doc_id < b.doc_id group by all),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
ways as (select a, b from links union all select b, a from links),
reached as (select doc_id, doc_id as other from documents union select doc_id, b from reached join ways on other = a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, min(other) as component_id, doc_id = min(other) as kept from reached left join sizes using (doc_id) group by doc_id, n
"""


def op7_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 4) != 2)
    scored = quality.score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (id_bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id::varchar as item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws, least(10, len(ws)) as m from benchmark),
asked as (select distinct item_id, m, array_to_string(ws[i:i + m - 1], ' ') as said from (select *, unnest(range(1, len(ws) - m + 2)) as i from b where m > 0)),
windows as (select doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') as said from (select *, unnest(range(1, len(ws) - m + 2)) as i from d, (select distinct m from asked) where len(ws) >= m)),
met as (select doc_id, m, i, item_id from windows join asked using (m, said)),
hits as (select doc_id, count(distinct i + o) as n_hit from met, range(10) r(o) where o < m group by doc_id),
names as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as listed from (select distinct doc_id, item_id from met where item_id is not null) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join names using (doc_id)
"""


def op10_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 3) != 1)
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "examples", "terms")


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine_phrases(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
parted as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
totals as (select lang, sum(len(ws))::bigint as n from parted group by lang),
f as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase, count(*)::hugeint as a
      from (select *, unnest(range(1, len(ws) - m + 2)) as i from parted, (select unnest([1, 2, 3, 4]) as m) where len(ws) >= m) group by all having count(*) >= 30),
long as (select *, string_split(phrase, ' ') as ws from f where m > 1),
cuts as (select *, array_to_string(ws[1:k], ' ') as left_part, array_to_string(ws[k + 1:], ' ') as right_part from (select *, unnest(range(1, m)) as k from long)),
scored as (select c.*, x.a as l, y.a as r, 2000000 * c.a // (x.a + y.a) as score from cuts c join f x on x.lang = c.lang and x.phrase = left_part join f y on y.lang = c.lang and y.phrase = right_part),
worst as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (select lang, array_to_string(ws[i:i + w - 1], ' ') as phrase, max(a) as whole from (select *, unnest(range(1, m - w + 2)) as i from long, (select unnest([2, 3]) as w) where w < m) group by all),
kept as (select worst.* from worst left join inner_parts p using (lang, phrase) where p.whole is null or 100 * p.whole < 80 * worst.a)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join totals using (lang) where rank <= 2000
"""


def op12_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op13_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_media_signatures": op2_media_signatures,
    "op3_rabin_karp_windows": op3_rabin_karp_windows,
    "op4_perspective_rotation": op4_perspective_rotation,
    "op5_exact_complement_packing": op5_exact_complement_packing,
    "op6_bayesian_minhash": op6_bayesian_minhash,
    "op7_positive_unlabelled": op7_positive_unlabelled,
    "op8_winnowing": op8_winnowing,
    "op9_host_reputation": op9_host_reputation,
    "op10_nearest_toxic": op10_nearest_toxic,
    "op11_toivonen_phrases": op11_toivonen_phrases,
    "op12_entropy_balancing": op12_entropy_balancing,
    "op13_bidiagonal_whitening": op13_bidiagonal_whitening,
}
ORACLE_SQL = {
    "op2_media_signatures": OP2_SQL,
    "op3_rabin_karp_windows": OP3_SQL,
    "op6_bayesian_minhash": OP6_SQL,
    "op8_winnowing": OP8_SQL,
    "op4_perspective_rotation": OP4_SQL,
    "op9_host_reputation": OP9_SQL,
    "op11_toivonen_phrases": OP11_SQL,
}
