"""The registered query of each operator, with production parameters, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import centroids, lexical_search, lm_scoring, mixing, packing, permutation_index, quality_classifier, quality_rules, secret_scan, sharding, simhash_dedup, substring_dedup, toxicity
from ridgeline.llm.words import bound_batches
from ridgeline.plans.scratch import checkpoint_dir

#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoint_dir(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_report(_table(spark, sf_dir, "documents"))


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# What SQL can express of operators whose whole result it can't: the contract's base columns, by the same operators.


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secret_scan(spark, sf_dir).drop("spans")


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality_rules(spark, sf_dir).drop("anomaly", "kept")


def base_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_simhash, op2_quality_classifier, op3_permutation_index, op4_secret_scan, op5_substring_dedup, op6_extendible_sharding, op7_packing, op8_quality_rules, op9_lm_scoring, op10_mixing, op11_toxicity, op12_centroids, op13_lexical_search, base_secrets, base_rules, base_lm_scores, mixing_targets]
    return {f.__name__: f for f in found}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5_SQL = rf"""
with docs as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
windows as (select r, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) as h from docs, unnest(range(0, greatest(len(w) - 34, 0)::bigint)) as t(i)),
often as (select h from windows group by h having count(*) > 1),
gone as (select r, list(distinct i + k) as places from windows join often using (h), unnest(range(0, 35)) as s(k) group by r),
kept as (select d.r, d.doc_id, d.w, coalesce(len(g.places), 0) as n_removed,
  case when g.places is null then d.w else list_transform(list_filter(list_zip(d.w, range(len(d.w)::bigint)), lambda x: not list_contains(g.places, x[2])), lambda x: x[1]) end as k
  from docs d left join gone g using (r))
select doc_id, len(w)::bigint as n_words, n_removed::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""

OP6_SQL = f"""
with docs as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint as h from documents),
levels as (select doc_id, n_bytes, h, d as depth, h >> (60 - d)::int as node from docs, unnest(range(0, 61)) as t(d)),
sized as (select doc_id, n_bytes, h, depth, sum(n_bytes) over p as total, count(*) over p as rows_in from levels window p as (partition by depth, node)),
least as (select doc_id, n_bytes, h, min(depth) as depth from sized where total <= {SHARD_BYTES} or rows_in = 1 group by all)
select doc_id, n_bytes, depth::int as depth, case when depth = 0 then '' else lpad(bin(h >> (60 - depth)::int), depth::int, '0') end as shard from least
"""


# The contract's expressions.
_ASSIGN = r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_KINDS = (("assign", _ASSIGN, 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))


def _matches(k: int) -> str:
    kind, pattern, group, least = _KINDS[k]
    # A match begins after all pieces between matches, and all matches, that come before it.
    return f"""m{k} as (select r, regexp_extract_all(text, '{pattern}') as ms, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) as gaps from docs where regexp_matches(text, '{pattern}')),
p{k} as (select r, {k} as k, ms[i] as m, (list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as s from m{k}, unnest(range(1, len(ms) + 1)) as t(i)),
s{k} as (select r, k, '{kind}' as kind, s, s + length(m) as e from p{k} where length(regexp_extract(m, '{pattern}', {group})) >= {least})"""


BASE_SECRETS_SQL = f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
{_matches(0)},
{_matches(1)},
{_matches(2)},
spans as (select * from s0 union all select * from s1 union all select * from s2),
found as (select r, count_if(k = 0) as a, count_if(k = 1) as b, count_if(k = 2) as c, string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as base from spans group by r)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256 from docs left join found using (r)
"""

BASE_RULES_SQL = rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
windows as (select r, i, array_to_string(w[i + 1 : i + 5], ' ') as h from docs, unnest(range(0, greatest(len(w) - 4, 0)::bigint)) as t(i)),
often as (select r, h from windows group by r, h having count(*) > 1),
covered as (select r, count(distinct i + k)::bigint as n from windows join often using (r, h), unnest(range(0, 5)) as s(k) group by r),
counted as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(n, 0) as n_repeat_words
  from docs left join covered using (r))
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted
"""

# CRC-32 (its fixed polynomial, bit by bit) of a doc_id's digits.
_CRC = "xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint), lambda c, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda b, i: case when b & 1 = 1 then xor(b >> 1, 3988292384::bigint) else b >> 1 end, xor(c, x)), 4294967295::bigint), 4294967295::bigint)"

BASE_LM_SQL = f"""
with docs as (select row_number() over () as r, doc_id, coalesce({_CRC} % 10 = 0, false) as held_out,
  list_append({_WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, ' ') as ts from documents),
tokens as (select r, held_out, unnest(ts) as t from docs),
counts as (select t, count(*) as c from tokens where not held_out group by t),
total as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from counts),
scored as (select r, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)))) as base from tokens left join counts using (t), total group by r)
select doc_id, held_out, n_tokens::bigint as n_tokens, n_known::bigint as n_known, n as train_tokens, round(base, 4) as base_score from docs join scored using (r), total
"""

# Ordered by the level at which they stop, the sources that do are a prefix.
MIXING_TARGETS_SQL = f"""
with docs as (select doc_id, source, len({_WORDS})::bigint as size from documents),
sources as (select source, sum(size)::bigint as s from docs group by source),
ranked as (select *, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w from sources),
summed as (select *, sum(s) over () - coalesce(sum(3.0::double * s) over p, 0) as rest, sum(w) over () - coalesce(sum(w) over p, 0) as weights from ranked window p as (order by 3.0::double * s / w, source rows between unbounded preceding and 1 preceding)),
level as (select min_by(rest / weights, 3.0::double * s / w) as l from summed where rest / weights <= 3.0::double * s / w)
select doc_id, size, s as source_size, round(least(3.0::double * s, w * l), 4) as target from docs join ranked on docs.source is not distinct from ranked.source, level
"""


_DISTANCE = "list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"


def _round(i: int) -> str:
    """Assignment to the centroids c<i>, and the centroids after it: floors of means, an empty cluster's as it was."""
    return f"""a{i} as materialized (select r, min_by(k, (d, k)) as k, min(d) as d from (select r, k, {_DISTANCE} as d from v, c{i}) group by r),
s{i} as (select k, j, sum(q[j])::bigint as s, count(*) as n from a{i} join v using (r), unnest(range(1, 65)) as t(j) group by k, j),
m{i} as (select k, list((s - ((s % n) + n) % n) // n order by j) as m from s{i} group by k),
c{i + 1} as materialized (select k, coalesce(m, c) as c from c{i} left join m{i} using (k))"""


OP12_SQL = f"""
with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select row_number() over (order by h, q) - 1 as k, q as c from (select sha256('3:' || vec_id) as h, q from v order by h, q limit 8)),
{", ".join(map(_round, range(11)))},
i as (select k, sum(d)::bigint as of_cluster from a10 group by k)
select vec_id, k::int as cluster, d as distance, of_cluster as cluster_inertia, (select sum(d)::bigint from a10) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a10 join v using (r) join i using (k) join c10 using (k)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
with docs as (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
total as (select count(*) filter (len(w) > 0) as n, coalesce(sum(len(w)), 0)::bigint as l from docs),
held as (select r, t, count(*) as tf from (select r, unnest(w) as t from docs) group by r, t),
df as (select t, count(*) as df from held group by t),
asked as (select q, t, count(*) as repeats from (select row_number() over () as q, unnest({_TERMS}) as t from benchmark) group by q, t),
weighed as (select q, t, repeats * floor(1000 * ln((2 * n + 2) / (2 * df + 1)::double))::bigint as w from asked join df using (t), total),
length as (select r, doc_id, 100 - 25 + (25 * len(w) * n) // l as m from docs, total where len(w) > 0),
scored as (select q, r, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from weighed join held using (t) join length using (r) group by q, r having score > 0),
best as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id) as rank from scored join length using (r))
select item_id, rank::int as rank, doc_id, score from best join (select row_number() over () as q, item_id from benchmark) using (q) where rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_centroids": OP12_SQL, "op13_lexical_search": OP13_SQL, "op5_substring_dedup": OP5_SQL, "op6_extendible_sharding": OP6_SQL, "base_secrets": BASE_SECRETS_SQL, "base_rules": BASE_RULES_SQL, "base_lm_scores": BASE_LM_SQL, "mixing_targets": MIXING_TARGETS_SQL}
