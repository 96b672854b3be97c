"""The queries of the training-data operators over a folder of tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, line_crf, mixing, pattern_grammar, pseudonyms, sharding, spelling_variants, suffix_index, token_alignment, token_files, warc_archive, weak_rules
from .shared import new_folder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, folder)


#: The key of the queries' pseudonyms; a user brings a secret one.
DEMONSTRATION_KEY = "a key for demonstration only"


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir), DEMONSTRATION_KEY)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(documents(spark, sf_dir))


def op8_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_grammar.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(documents(spark, sf_dir)).drop("pattern")


def op10_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(documents(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_pseudonyms,
        op3_mix_sources,
        op4_decontamination,
        op5_line_crf,
        op6_shard_bytes,
        op7_jaccard_join,
        op8_pattern_grammar,
        op9_weak_rules,
        op10_suffix_index,
        op11_warc_archive,
        op12_spelling_variants,
        op13_token_alignment,
    )
}
#: All pairs by their common shingles, then reachability.
JACCARD_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) >= 5 then list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) when len(words) > 0 then [array_to_string(words, ' ')] else []::varchar[] end as grams from w),
e as (select doc_id, unnest(grams) as gram from s), n as (select doc_id, len(grams) as n from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
linked as (select x, y from l union all select y, x from l),
reached(doc_id, other) as (select doc_id, doc_id from n union select reached.doc_id, y from reached join linked on other = x)
select n.doc_id, n.n as n_shingles, min(other) as component_id from n join reached on n.doc_id = reached.doc_id group by all"""
#: Every 50-byte string of every text with the smallest doc_id it starts in; runs of those that start in a smaller one go.
REPEATS_SQL = """with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, array_slice(b, i + 1, i + 50) as s from (select doc_id, b, unnest(range(n - 49)) as i from d where n >= 50)),
f as (select s, min(doc_id) as first from w group by s),
r as (select w.doc_id, i from w join f on w.s = f.s where first < w.doc_id),
m as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 else 0 end as new from r),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from m),
gone as (select doc_id, min(i) as a, max(i) + 50 as z from g group by doc_id, run),
ends as (select doc_id, a, z from gone union all select doc_id, n, n from d),
kept as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a, z), 0) as x, a as y from ends),
t as (select k.doc_id, string_agg(hex(array_slice(b, x + 1, y)), '' order by x) as bytes from kept k join d on k.doc_id = d.doc_id where y > x group by 1),
c as (select doc_id, sum(z - a) as removed, count(*) as spans from gone group by 1)
select d.doc_id, d.n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(bytes, ''))) as kept_sha256
from d left join t on d.doc_id = t.doc_id left join c on d.doc_id = c.doc_id"""
#: CRC-32 byte by byte over its table of 256 remainders; shards by the middle of each document's bytes.
SHARDS_SQL = """with tab as (select list_transform(range(256), lambda v: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, v::bigint)) as t),
d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
h as (select doc_id, length(x) // 2 + 1 as size, list_transform(regexp_extract_all(x, '..'), lambda v: ('0x' || v)::bigint) as bytes from d),
c as (select doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as text_crc32 from h, tab),
p as (select *, sum(size) over (order by doc_id) - size as start, sum(size) over () as total from c),
s as (select doc_id, size, text_crc32, least(15, (2 * start + size) * 16 // (2 * total))::integer as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, null::integer as grown_shard from s"""
ARCHIVE_SQL = """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest from pages),
m as (select digest, n, max(page_id) as last from p where n >= 1000 group by all)
select page_id, p.n as payload_bytes, p.digest as payload_digest, case when page_id < last then 'revisit' else 'response' end as record_type, case when page_id < last then last end as refers_to
from p left join m on p.digest = m.digest and p.n = m.n"""
#: Near words by their spellings with one code point left out or blanked (a blank is no letter).
VARIANTS_SQL = r"""with recursive tab as (select list_transform(range(256), lambda v: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, v::bigint)) as t),
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents),
d as (select run, count(*) as times, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as x from r where length(run) >= 7 group by doc_id, run),
h as (select run, times, xor(list_reduce(list_transform(regexp_extract_all(x, '..'), lambda v: ('0x' || v)::bigint), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) as h from d, tab),
o as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, times from h),
v as (select word, sum(times)::bigint as n from o where length(word) >= 7 group by word having sum(times) >= 2),
b as (select distinct word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || ' ' || substr(word, i + 1))) as key from v),
s as (select distinct word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) as key from v),
e as (select x.word, y.word as other, y.n from b x join b y on x.key = y.key and x.word <> y.word union select s.word, v.word, v.n from s join v on s.key = v.word union select v.word, s.word, s.n from s join v on s.key = v.word),
k as (select word, count(*) as n_near, max(n) as best from e group by word),
m as (select e.word, min(other) as other from e join k on e.word = k.word and e.n = k.best group by e.word),
f as (select v.word, case when k.best >= 10 * v.n then other end as form, v.n, coalesce(n_near, 0) as n_near, case when k.best >= 10 * v.n then k.best end as form_n from v left join m on v.word = m.word left join k on v.word = k.word),
w as (select word, word as root from f union all select w.word, f.form from w join f on w.root = f.word where f.form is not null)
select f.word, f.form, w.root, f.n, f.n_near, f.form_n from f join (w join (select word as last from f where form is null) on root = last) w on f.word = w.word"""
SQL: dict[str, str] = {"op6_shard_bytes": SHARDS_SQL, "op7_jaccard_join": JACCARD_SQL, "op10_suffix_index": REPEATS_SQL, "op11_warc_archive": ARCHIVE_SQL, "op12_spelling_variants": VARIANTS_SQL}
