"""The queries that apply each corpus operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.llm import bpe, chat, html_text, licences, lines, mixing, nearcopies, periodic, rules, shards, vectors, voting
from kymo.llm.common import table_of


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of what they decode to."""
    return bpe.round_trip(table_of(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    done = html_text.extract(table_of(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns, with recovered roles, as canonical text."""
    return chat.turns_of(table_of(spark, sf_dir, "conversations"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24, near equal in bytes, equal texts together."""
    return shards.shard_by_bytes(table_of(spark, sf_dir, "documents"), 24)


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component."""
    return vectors.near_vectors(table_of(spark, sf_dir, "embeddings"))[0]


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, lines dropped and the digest of what stays."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    done = lines.apply(docs, lines.repeated_lines(docs))
    return done.select("row.doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.text", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts and the verdict of the base rules and the learned list."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.learn_from(docs, table_of(spark, sf_dir, "labels"))
    return rules.judged(docs, learned).select("row.doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept", "rule")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, the licence that it is, and the licence notices among its lines."""
    done = licences.scanned(table_of(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posteriors, rate and copies in the mix."""
    done = mixing.rated(table_of(spark, sf_dir, "documents"), table_of(spark, sf_dir, "labels"), keep=["doc_id"])
    return done.select("row.doc_id", "n_tokens", *[f"p_{d}" for d in mixing.DOMAINS], "rate", "copies")


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-copy component."""
    return nearcopies.near_copies(table_of(spark, sf_dir, "documents"), percent=nearcopies.PERCENT)


def op11_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, the vote of its nearest labelled documents."""
    docs = table_of(spark, sf_dir, "documents").select("doc_id", "text")
    done = voting.scored(docs, voting.learn(docs, table_of(spark, sf_dir, "labels")))
    return done.select("row.doc_id", voting.held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= voting.GOOD_FROM).cast("int").alias("predicted"))


def with_stretches(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of the ids, by checksum, the text repeats its words with one period from some word on.

    With h the checksum of the decimal id, h % 10 = 0 and g = floor(h / 10): word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)) for n words. A row without id or words stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, h.cast("long")).alias("h"))
    cut = chosen.withColumn("words", F.when(F.col("h").isNotNull(), words)).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    placed = cut.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, element_at(words, a + (i - a) % p + 1))), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words, the greatest of them, and digests of all and of the text without the repeats."""
    docs = with_stretches(table_of(spark, sf_dir, "documents").select("doc_id", "text"))
    done = periodic.with_runs(docs).select("row.doc_id", "found.*")
    most = done.withColumn("most", periodic.foremost(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    return most.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period", F.expr("1000 * most.length div most.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_chat": op3_chat,
    "op4_shards": op4_shards,
    "op5_near_vectors": op5_near_vectors,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_licences": op8_licences,
    "op9_mixing": op9_mixing,
    "op10_near_copies": op10_near_copies,
    "op11_votes": op11_votes,
    "op12_periodic": op12_periodic,
}

_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: The checksum of the decimal doc_id, a bit at a time.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a % 2 = 1 then 3988292384 else 0 end) end), 4294967295)"
)

# The licence SQL's own table of spellings and of known lines; digests of entire texts as of their files.
_SPELLINGS = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in (x.split("/") for x in (
    "acknowledgement/acknowledgment analyse/analyze authorisation/authorization authorised/authorized behaviour/behavior catalogue/catalog centre/center favour/favor fulfil/fulfill fulfilment/fulfillment honour/honor "
    "initialise/initialize judgement/judgment labour/labor licence/license licences/licenses licenced/licensed licencee/licensee licencees/licensees licencing/licensing licencor/licensor licencors/licensors merchantibility/merchantability offence/offense organisation/organization practise/practice "
    "programme/program recognise/recognize sublicence/sublicense sublicenced/sublicensed sublicences/sublicenses sublicencing/sublicensing unlicence/unlicense whilst/while wilful/willful"
).split())) + "}"
_PHRASES = ("copyright owner/copyright holder", "copyright owners/copyright holders", "non commercial/noncommercial", "non infringement/noninfringement", "per cent/percent", "sub license/sublicense")
_LINES = (
    ("Apache-2.0-notice", "licensed under the apache license version 2 0"), ("MIT-notice", "released under the mit license"), ("GPL-3.0-notice", "this work is licensed under the gnu general public license version 3"),
    ("CC-BY-NC-4.0-notice", "licensed under cc by nc 4 0"), ("CC-BY-4.0-notice", "licensed under cc by 4 0"), ("CC-BY-SA-4.0-notice", "licensed under cc by sa 4 0"), ("CC0-1.0-notice", "released under cc0 1 0"),
    ("BSD-3-Clause-notice", "released under the bsd 3 clause license"), ("MPL-2.0-notice", "this work is licensed under the mozilla public license version 2 0"),
    ("Apache-2.0-header", "licensed under the apache license version 2 0 the license"), ("GPL-header", "it under the terms of the gnu general public license as published by"),
    ("LGPL-header", "it under the terms of the gnu lesser general public license as published by"), ("AGPL-header", "it under the terms of the gnu affero general public license as published by"),
    ("MPL-2.0-header", "license v 2 0 if a copy of the mpl was not distributed with this"),
    *((f"{x}-tag", "spdx license identifier " + x.lower().replace("-", " ").replace(".", " ")) for x in (
        "AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later "
        "LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib").split()),
)
_TEXTS = (
    ("MIT", "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("ISC", "f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Apache-2.0-terms", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0-terms", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0-terms", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0-terms", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-terms", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-terms", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
)


def _canonical_sql(column: str) -> str:
    """Word by word, unlike the operator: words are cut out, looked up and put together again."""
    words = f"regexp_extract_all(regexp_replace(regexp_replace(lower({column}), '(?m)^[ \\t]*(?:copyright|\\(c\\)|©)[^\\n]*(?:[0-9]{{4}}|\\(c\\)|©)[^\\n]*$', ' ', 'g'), 'all rights reserved', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
    out = f"'  ' || array_to_string(list_transform({words}, lambda w: coalesce({_SPELLINGS}[w], w)), '  ') || '  '"
    for phrase in _PHRASES:
        a, b = (x.replace(" ", "  ") for x in phrase.split("/"))
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim(replace({out}, '  ', ' '))"


ORACLES: dict[str, str] = {
    "op5_near_vectors": """
with recursive links as (
    select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.95
), reach as (
    select vec_id as start, vec_id as node from embeddings union select r.start, l.b from reach r join links l on r.node = l.a
), least as (
    select start, min(node) as component_id from reach group by start
), counted as (
    select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e left join counted c on e.vec_id = c.a join least l on e.vec_id = l.start""",
    "op6_line_dedup": f"""
with split as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents
), numbered as (
    select doc_id, unnest(parts) as line, unnest(generate_series(1, len(parts))) as pos from split
), keyed as (
    select *, {_LOWER.format(f"trim(line, {_BLANK})")} as key from numbered
), common as (
    select key, max(doc_id) as top from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), judged as (
    select k.doc_id, k.pos, k.line, c.key is not null and k.doc_id <> c.top as dropped from keyed k left join common c on k.key = c.key
)
select doc_id, count(*)::bigint as n_lines, sum(dropped::int)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id""",
    "op8_licences": f"""
with texts as (
    select row_number() over () as n, doc_id, text from documents
), units as (
    select n, doc_id, true as whole, text as unit from texts union all select n, doc_id, false, unnest(string_split(text, chr(10))) from texts
), digested as (
    select n, doc_id, whole, sha256({_canonical_sql("unit")}) as digest from units
), known(digest, licence) as (
    select sha256(words), licence from (values {", ".join(f"('{n}', '{w}')" for n, w in _LINES)}) as l(licence, words)
    union all select digest, licence from (values {", ".join(f"('{n}', '{d}')" for n, d in _TEXTS)}) as t(licence, digest)
)
select d.doc_id, max(d.digest) filter (where d.whole) as digest, max(k.licence) filter (where d.whole) as licence,
    coalesce(string_agg(distinct k.licence, ',' order by k.licence) filter (where not d.whole and k.licence is not null), '') as notices
from digested d left join known k on d.digest = k.digest group by d.n, d.doc_id""",
    "op10_near_copies": f"""
with recursive worded as (
    select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[' || chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ']+'), lambda w: w <> '') as words from documents
), shingled as (
    select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, chr(10))]
        else list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], chr(10))) end) as shingle from worded
), sized as (
    select doc_id, count(*) as n from shingled group by doc_id
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as n from shingled a join shingled b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
), links as (
    select c.a, c.b from common c join sized x on c.a = x.doc_id join sized y on c.b = y.doc_id where 100 * c.n >= 85 * (x.n + y.n - c.n)
), reach as (
    select doc_id as start, doc_id as node from documents union select r.start, l.b from reach r join links l on r.node = l.a
), least as (
    select start, min(node) as component_id from reach group by start
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d left join sized s on d.doc_id = s.doc_id join least l on d.doc_id = l.start""",
    "op12_periodic": f"""
with split as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[' || {_BLANK} || ']+'), lambda w: w <> '') as given, {_CRC} as h from documents
), sized as (
    select *, len(given) as n, h // 10 as g from split
), planned as (
    select *, case when n > 0 and h % 10 = 0 then g % n end as a from sized
), worded as (
    select doc_id, n, case when a is null then given else list_transform(generate_series(0, n - 1), lambda i: case when i < a then given[i + 1] else given[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end) end as words from planned
), placed as (
    select doc_id, unnest(words) as word, unnest(generate_series(0, n - 1)) as i from worded
), matched as (
    select x.doc_id, y.i - x.i as q, x.i from placed x join placed y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i
), stretched as (
    select doc_id, q, min(i) as start, count(*) + q as length from (select *, i - row_number() over (partition by doc_id, q order by i) as island from matched) group by doc_id, q, island having count(*) >= q
), runs as (
    select doc_id, start, length, min(q) as period from stretched group by doc_id, start, length having length >= greatest(6, 4 * min(q))
), covered as (
    select distinct doc_id, unnest(generate_series(start + period, start + length - 1)) as i from runs
), collapsed as (
    select p.doc_id, sha256(string_agg(p.word, ' ' order by p.i)) as digest from placed p left join covered c on p.doc_id = c.doc_id and p.i = c.i where c.i is null group by p.doc_id
), ranked as (
    select *, row_number() over (partition by doc_id order by length / period desc, start, period) as place from runs
), listed as (
    select doc_id, count(*) as n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as digest,
        max(start) filter (where place = 1) as start, max(length) filter (where place = 1) as length, max(period) filter (where place = 1) as period
    from ranked group by doc_id
)
select w.doc_id, coalesce(l.n_runs, 0)::bigint as n_runs, l.start::bigint as start, l.length::bigint as length, l.period::bigint as period, (1000 * l.length // l.period)::bigint as exponent_milli,
    coalesce(l.digest, sha256('')) as runs_sha256, coalesce(c.digest, sha256('')) as collapsed_sha256
from worded w left join listed l on w.doc_id = l.doc_id left join collapsed c on w.doc_id = c.doc_id""",
}
