"""The thin queries over the operators: one ``opN_`` of each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hnsw, language, licenses, merkle, mixing, neighbours, sharding, simhash, tokens, toxicity, url_filter, whitening, word_bpe
from .common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language.predicted(spark, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.grams").alias("n_grams"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
    return found.select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document: the licenses found and their spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = docs.select("doc_id", licenses.scanned(spark, F.col("text")).alias("spans"))
    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"])))
    return marked.select("doc_id", F.size("spans").alias("n_spans"), names.alias("licenses"), "spans")


def op4_byte_bpe(spark: SparkSession, sf_dir: str, file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = tokens.read_ranks(public_tokenizers.path(file))
    out = docs.select("doc_id", tokens.token_digests(spark, F.col("text"), ranks, public_tokenizers.PATTERN).alias("t"))
    return out.select("doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def listed_hosts(pages: DataFrame) -> DataFrame:
    """Dated list entries on the table's own hosts, by the digits of the host's MD5.

    One host in four is put on a list, a parent domain in eight, a path in
    sixteen is allowed; entries end and begin again on later days.
    """
    host = url_filter.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct().withColumn("h", F.md5(F.col("host").cast("binary")))

    def digits(a: int, n: int):
        return F.conv(F.substring("h", a, n), 16, 10).cast("int")

    first = F.date_add(F.lit("2024-01-01").cast("date"), digits(3, 2))
    parent = F.regexp_replace("host", r"^[^.]*[.]", "")
    base = hosts.select(
        "host", parent.alias("parent"), digits(1, 1).alias("d"), digits(5, 1).alias("e"), digits(6, 1).alias("p"), first.alias("first"),
        F.element_at(F.array(F.lit("malware"), F.lit("adult"), F.lit("spam"), F.lit("parked")), digits(7, 1) % 4 + 1).alias("list"))
    day = F.col("first")
    on = base.where("d < 4").select("list", F.col("host").alias("pattern"), F.lit("block").alias("verdict"), F.explode(F.array(
        F.struct(F.lit(True).alias("listed"), day.alias("day")), F.struct(F.lit(False).alias("listed"), F.date_add(day, 60).alias("day")),
        F.struct(F.lit(True).alias("listed"), F.date_add(day, 90).alias("day")))).alias("s"))
    above = base.where("e < 2 and parent like '%.%.%'").select("list", F.col("parent").alias("pattern"), F.lit("block").alias("verdict"), F.explode(F.array(
        F.struct(F.lit(True).alias("listed"), day.alias("day")), F.struct(F.lit(False).alias("listed"), F.date_add(day, 120).alias("day")))).alias("s"))
    path = base.where("p = 0").select(F.lit("trusted").alias("list"), F.concat("host", F.lit("/en")).alias("pattern"), F.lit("allow").alias("verdict"),
                                      F.struct(F.lit(True).alias("listed"), F.lit("2024-02-01").cast("date").alias("day")).alias("s"))
    return on.unionByName(above).unionByName(path).select("list", "pattern", "verdict", "s.listed", "s.day")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the entries active on the day of its capture (derived from its id)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")))
    return url_filter.judged(captures, listed_hosts(pages))


BLOCK_ROWS = 16


def target_shares(docs: DataFrame) -> DataFrame:
    """The targets: shares from 1 to 5, dealt to the sources by name, however many there are."""
    return mixing.dealt_shares(docs, "source", most=5)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, target_shares(docs), block_rows=BLOCK_ROWS)


SHARDS = [f"shard-{i:04d}" for i in range(256)]


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in 256 shards."""
    return sharding.placed(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS).select("doc_id", "slot", "shard")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)
    return found.select("vec_id", F.col("n_links").cast("long"), F.col("component_id").cast("long"), "kept")


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, training_labels(spark, sf_dir))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.scored(spark, model, F.col("text")).alias("t"))
    return out.select("doc_id", "held_out", F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
                      F.col("t.hits").alias("n_hits"), F.col("t.quoted").alias("n_quoted"), F.col("t.terms").alias("terms"))


def op11_word_bpe(spark: SparkSession, sf_dir: str, file: str = "word_bpe_49k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path(file), encoding="utf-8") as f:
        definition = f.read()
    out = docs.select("doc_id", word_bpe.token_digests(spark, F.col("text"), definition).alias("t"))
    return out.select("doc_id", "t.n_tokens", "t.ids_sha256", "t.decoded_sha256")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document; one in seven is checked as if its ``n_chars`` had been raised by one."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaf = [merkle.record_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")) for n in (F.col("n_chars"), F.col("n_chars").cast("decimal(20,0)") + 1)]
    rows = docs.select("doc_id", "lang", leaf[0].alias("leaf"), F.when(tampered, leaf[1]).alias("claimed"))
    manifest = merkle.build(rows, "lang", ["doc_id"], "leaf")
    proofs = merkle.prove(manifest, manifest.leaves)
    out = proofs.withColumn("folded_root", merkle.folded(F.coalesce("row.claimed", "row.leaf"), F.col("path")))
    return out.select("row.doc_id", "row.leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("vec_id", F.col("vec_id").cast("long"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_nearest_neighbours, op3_license_scan, op4_byte_bpe, op5_simhash_dedup, op6_url_filter, op7_source_mixing,
    op8_sharding, op9_embedding_dedup, op10_toxicity, op11_word_bpe, op12_merkle_manifest, op13_embedding_whitening)}
ORACLES: dict[str, str] = {
    # whole levels as lists, from the leaves up; then every leaf's siblings, and its fold
    "op12_merkle_manifest": """
        with recursive docs as (
            select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
                   lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 as tampered
            from documents),
        fields as (
            select doc_id, lang, tampered, n_chars, list_aggregate(list_transform([doc_id::varchar, source, lang], lambda f: coalesce(strlen(f) || ':' || f, '-')), 'string_agg', '') as a,
                   coalesce(strlen(text) || ':' || text, '-') as z from docs),
        hashed as (
            select doc_id, lang, sha256(a || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) as leaf,
                   sha256(a || coalesce(strlen((n_chars + coalesce(tampered, false)::int)::varchar) || ':' || (n_chars + coalesce(tampered, false)::int), '-') || z) as claimed from fields),
        leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from hashed),
        up(lang, lvl, l) as (
            select lang, 0, list(leaf order by i) from leaves group by lang union all
            select lang, lvl + 1, list_transform(range(0, (len(l) + 1) // 2), lambda k: sha256(l[2 * k + 1] || coalesce(l[2 * k + 2], ''))) from up where len(l) > 1),
        subs as (select lang, l[1] as subroot, row_number() over (order by lang nulls first) - 1 as g from up where len(l) = 1),
        above(lvl, l) as (
            select 0, list(subroot order by g) from subs union all
            select lvl + 1, list_transform(range(0, (len(l) + 1) // 2), lambda k: sha256(l[2 * k + 1] || coalesce(l[2 * k + 2], ''))) from above where len(l) > 1),
        steps as (
            select n.lang, n.i, u.lvl as no, (n.i >> u.lvl) & 1 as bit, u.l[xor(n.i >> u.lvl, 1) + 1] as sibling
            from leaves n join up u on u.lang is not distinct from n.lang and len(u.l) > 1 union all
            select n.lang, n.i, 1000 + u.lvl, (s.g >> u.lvl) & 1, u.l[xor(s.g >> u.lvl, 1) + 1]
            from leaves n join subs s on s.lang is not distinct from n.lang join above u on len(u.l) > 1),
        paths as (select lang, i, string_agg(sibling, '' order by no) as siblings, list(bit || coalesce(sibling, '') order by no) as path from steps group by lang, i),
        folded as (
            select n.doc_id, n.leaf, s.subroot, (select l[1] from above where len(l) = 1) as root, sha256(coalesce(p.siblings, '')) as proof_sha256,
                   list_reduce(list_prepend(n.claimed, coalesce(p.path, [])), lambda h, s: case when len(s) = 1 then sha256(h) when s[1] = '1' then sha256(s[2:] || h)
                                                                                           else sha256(h || s[2:]) end) as folded_root
            from leaves n join subs s on s.lang is not distinct from n.lang left join paths p on p.lang is not distinct from n.lang and p.i = n.i)
        select *, folded_root = root as verified from folded""",
    # brute force over all pairs, then the closure of the links
    "op9_embedding_dedup": """
        with recursive v as (
            select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (
            select a.vec_id as a, b.vec_id as b from v a join v b
            on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
        select e.vec_id, (select count(*) from links l where l.a = e.vec_id)::bigint as n_links,
               least(e.vec_id, coalesce((select min(b) from reach r where r.a = e.vec_id), e.vec_id)) as component_id,
               e.vec_id = least(e.vec_id, coalesce((select min(b) from reach r where r.a = e.vec_id), e.vec_id)) as kept
        from embeddings e""",
    "op7_source_mixing": f"""
        with recursive names as (
            select source, row_number() over (order by source) as i, 1 + (row_number() over (order by source) - 1) % 5 as a
            from (select distinct source from documents where source is not null)),
        conf as (select list(a order by i) as a, list(source order by i) as s, sum(a)::bigint as p from names),
        edf as (
            select -1::bigint as slot, list_transform(a, lambda x: 0::bigint) as done, 0::bigint as pick, 0::bigint as nth from conf
            union all
            select slot, list_transform(done, lambda x, k: case when k = pick then x + 1 else x end), pick, done[pick] from (
                select e.slot + 1 as slot, e.done, list_min(list_transform(range(1, len(c.a) + 1), lambda k: {{
                    'early': case when floor(e.done[k] * c.p / c.a[k]) > e.slot + 1 then 1 else 0 end,
                    'deadline': ceil((e.done[k] + 1) * c.p / c.a[k])::bigint, 'tight': -floor(e.done[k] * c.p / c.a[k])::bigint,
                    'small': -c.a[k], 'k': k}})).k as pick
                from edf e, conf c where e.slot + 1 < c.p)),
        ranked as (
            select doc_id, source, row_number() over (partition by source order by md5(coalesce(doc_id::varchar, '')), doc_id) - 1 as nth_row from documents),
        blocks as (select *, case when source is not null then nth_row // {BLOCK_ROWS} end as block from ranked)
        select b.doc_id, b.source, b.nth_row, b.block, (b.block // n.a) * c.p + e.slot as slot
        from blocks b cross join conf c left join names n on n.source = b.source left join edf e on e.pick = n.i and e.nth = b.block % n.a and e.slot >= 0""",
    "op6_url_filter": r"""
        with captures as (
            select page_id, url, date '2024-01-01' + ((page_id * 37) % 366)::int as fetched_on,
                   regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':\d*$', '')), '\.$', '') as host,
                   regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)', 1), '/+$', '') as path
            from pages),
        hosts as (select host, md5(host) as h, regexp_replace(host, '^[^.]*[.]', '') as parent from (select distinct host from captures where host <> '')),
        base as (
            select *, ('0x' || h[1])::int as d, ('0x' || h[5])::int as e, ('0x' || h[6])::int as p, date '2024-01-01' + ('0x' || h[3:4])::int as first,
                   (['malware', 'adult', 'spam', 'parked'])[('0x' || h[7])::int % 4 + 1] as list
            from hosts),
        entries as (
            select list, host as pattern, 'block' as verdict, x.listed, first + x.days as day from base, (values (true, 0), (false, 60), (true, 90)) x(listed, days) where d < 4
            union all
            select list, parent, 'block', x.listed, first + x.days from base, (values (true, 0), (false, 120)) x(listed, days) where e < 2 and parent like '%.%.%'
            union all
            select 'trusted', host || '/en', 'allow', true, date '2024-02-01' from base where p = 0),
        days as (select list, pattern, day, bool_and(listed) as listed, min(verdict) as verdict from entries group by list, pattern, day),
        spans as (select *, lead(day) over (partition by list, pattern order by day) as valid_to from days),
        active as (
            select c.page_id, s.* from captures c join spans s
            on s.listed and s.day <= c.fetched_on and (s.valid_to is null or c.fetched_on < s.valid_to)
            and c.host <> '' and (c.host = s.pattern or ends_with(c.host, '.' || s.pattern)
                                  or (contains(s.pattern, '/') and (c.host || c.path = s.pattern or starts_with(c.host || c.path, s.pattern || '/'))))),
        best as (
            select page_id, count(*) as n, min({'a': -length(pattern), 'b': verdict <> 'block', 'l': list, 'k': pattern, 'v': verdict}) as best
            from active group by page_id)
        select c.page_id, c.url, c.fetched_on, coalesce(b.best.v, 'none') as verdict, coalesce(b.n, 0) as n_active, b.best.l as list, b.best.k as pattern
        from captures c left join best b using (page_id)""",
}
