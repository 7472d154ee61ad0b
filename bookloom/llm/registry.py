"""The corpus queries by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import LOWER, UPPER, table
from bookloom.llm.decontaminate import contamination
from bookloom.llm.exact_dedup import exact_dedup
from bookloom.llm.html_extract import extract
from bookloom.llm.jaccard_join import jaccard_join
from bookloom.llm.line_dedup import line_dedup
from bookloom.llm.packing import pack
from bookloom.llm.quality import score
from bookloom.llm.sharding import shard
from bookloom.llm.substring_dedup import substring_dedup
from bookloom.llm.token_counts import token_counts


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers are; only the two queries that need them ask for their package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", F.col("n_words"), F.col("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
}

#: Words as the operators on shingles see them, and the shingles of five of them (or all, if fewer).
_WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Least largest shard by dynamic programming over ordered groups, for one shard after the other, and the greedy cuts it gives.
_CAPACITIES_SQL = ",".join(
    f"""
        f{k} as (select e.j, min(greatest(f.cap, e.total - p.total)) as cap from e join e p on p.j <= e.j join f{k - 1} f on f.j = p.j group by e.j)"""
    for k in range(2, 9)
)
_CUTS_SQL = ",".join(
    f"""
        c{k} as (select max(e.j) as j from e join (select p.total + cap as most from e p join c{k - 1} c on c.j = p.j join best on true) on e.total <= most)"""
    for k in range(1, 8)
)

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
        s as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from d where len(words) >= 13),
        w as (select doc_id, i, words[i:i+12] as run from s),
        m as (select doc_id, i, min(doc_id) over (partition by run) as first_doc from w),
        c as (select distinct doc_id, unnest(range(i, i + 13)) as pos from m where first_doc < doc_id),
        p as (select doc_id, unnest(range(1, len(words) + 1)) as pos, unnest(words) as word from d),
        k as (select p.doc_id, string_agg(word, ' ' order by p.pos) as kept, count(*) as n
              from p anti join c on p.doc_id = c.doc_id and p.pos = c.pos group by p.doc_id)
        select d.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed,
            sha256(coalesce(kept, '')) as kept_sha256
        from d left join k on d.doc_id = k.doc_id""",
    "op2_line_dedup": f"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        l as (select doc_id, unnest(range(len(lines))) as pos, unnest(lines) as line from d),
        k as (select *, translate(trim(line, {_BLANKS_SQL}), '{UPPER}', '{LOWER}') as key from l),
        u as (select key, min(doc_id) as first_doc from k where length(key) >= 10
              group by key having count(distinct doc_id) >= 2),
        v as (select k.*, u.key is not null and k.doc_id > u.first_doc as gone from k left join u using (key))
        select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from v group by doc_id""",
    "op4_exact_dedup": r"""
        with d as (select doc_id, length(coalesce(text, '')) as n,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
        g as (select doc_id, body, first_value(doc_id) over (partition by body order by n desc, doc_id) as keep_id,
                count(*) over (partition by body)::bigint as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from g""",
    "op5_decontamination": f"""
        with b as (select item_id, {_WORDS_SQL} as words from benchmark),
        bn as (select item_id, words, least(len(words), 5) as n from b where len(words) > 0),
        bs as (select distinct item_id, n, words[i:i + n - 1] as s from (select *, unnest(range(1, len(words) - n + 2)) as i from bn)),
        bc as (select item_id, count(*) as shingles from bs group by item_id),
        d as (select doc_id, {_WORDS_SQL} as words from documents),
        dn as (select doc_id, words, n from d join (select distinct n from bn) on len(words) >= n),
        ds as (select distinct doc_id, n, words[i:i + n - 1] as s from (select *, unnest(range(1, len(words) - n + 2)) as i from dn)),
        m as (select doc_id, item_id, count(*) as shared from ds join bs using (n, s) group by all)
        select doc_id, item_id, shared, shingles, shared / shingles as containment from m join bc using (item_id) where shared >= 0.8 * shingles - 1e-9""",
    "op9_jaccard_join": f"""
        with recursive d as (select doc_id, {_WORDS_SQL} as words from documents),
        c as (select words, min(doc_id) as id, least(len(words), 5) as n from d group by words),
        s as (select distinct id, words[i:i + n - 1] as s from (select *, unnest(range(1, len(words) - n + 2)) as i from c where n > 0)),
        k as (select id, count(*) as size from s group by id),
        p as (select a.id as a, b.id as b, count(*) as shared from s a join s b on a.s = b.s and a.id <> b.id group by all),
        l as (select a, b from p join k x on x.id = a join k y on y.id = b where shared >= 0.8 * (x.size + y.size - shared) - 1e-9),
        r as (select id, id as low from c union select l.b, r.low from r join l on l.a = r.id),
        g as (select id, min(low) as low from r group by id),
        n as (select a as id, count(*) as links from l group by a)
        select d.doc_id, g.low as class_id, c.id as rep_id, coalesce(links, 0)::bigint as n_links
        from d join c on c.words = d.words join g on g.id = c.id left join n on n.id = c.id""",
    "op6_sharding": f"""
        with tb as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
        d as (select doc_id, hex(encode(coalesce(text, ''))) as h, sha256(coalesce(text, '')) as digest from documents),
        r as (select doc_id, digest, length(h) // 2 + 1 as size, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint) as b from d),
        g as (select digest, sum(size)::bigint as bytes from r group by digest),
        s as (select digest, row_number() over (order by digest) as j, sum(bytes) over (order by digest)::bigint as total from g),
        e as (select 0::bigint as j, 0::bigint as total union all select j, total from s),
        f1 as (select j, total as cap from e),{_CAPACITIES_SQL},
        best as (select arg_max(cap, j) as cap from f8),
        c0 as (select 0::bigint as j),{_CUTS_SQL},
        ends as ({" union all ".join(f"select j from c{k}" for k in range(1, 8))}),
        w as (select digest, count(*) filter (ends.j < s.j)::int as shard from s join ends on true group by digest)
        select doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::bigint as text_crc32,
            'bytes' as law, shard, row_number() over (partition by shard order by digest[1:2], doc_id % 256, digest, doc_id) - 1 as slot, null::int as grown_shard
        from r join w using (digest) join tb on true""",
}
