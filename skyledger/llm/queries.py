"""The registered queries of the corpus operators: one ``opN_<name>`` for each, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import cdc_dedup, centroids, decontam, embed_dedup, langid, licenses, maxent_lm, mih, minhash, quality, resampling, sharding, sp_codec
from skyledger.llm.common import fold, table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cuts: null texts stay null, empty ones empty; rows of one id are one document; repeated rows stay."""
    found = cdc_dedup.deduplicated(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    cut = F.aggregate("cdc.spans", F.lit(0), lambda s, x: s + x["stop"] - x["start"])
    return found.select(
        "doc_id", F.size("cdc.spans").alias("n_cuts"), F.col("cdc.words").alias("removed_words"), cut.alias("removed_bytes"),
        F.col("cdc.spans").alias("spans"), "text",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under law ``rows``; null and empty texts have size 8; repeated rows have slots of their own."""
    placed = sharding.documents_sharded(table(spark, sf_dir, "documents", ["doc_id", "text"]), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; ``und`` for texts that are null, empty or without letters; repeated rows stay."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    profiles = langid.learned(docs.where(fold("doc_id", 4) != 2), "text", "lang", F.col("doc_id"))
    found = langid.identified(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and whether they decode to its text; null texts have null ids, empty ones none; repeated rows stay."""
    pieces = sp_codec.read_model(spark)
    found = sp_codec.decoded(sp_codec.encoded(table(spark, sf_dir, "documents", ["doc_id", "text"]), pieces), pieces)
    return found.select("doc_id", "ids", F.size("ids").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


#: The table has no paths: doc_id gives a tree of directories of ten, a hundred and a thousand documents, and the first
#: document of each directory is its licence file.
VIRTUAL_PATH = """concat_ws('/', cast(doc_id div 1000 as string),
    case when doc_id % 1000 = 0 then 'LICENSE'
         when doc_id % 100 = 0 then concat(cast(doc_id div 100 as string), '/LICENSE')
         when doc_id % 10 = 0 then concat(cast(doc_id div 100 as string), '/', cast(doc_id div 10 as string), '/LICENSE')
         else concat(cast(doc_id div 100 as string), '/', cast(doc_id div 10 as string), '/', cast(doc_id as string), '.txt') end)"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, its own or inherited; texts that are null or empty have none of their own; repeated rows stay."""
    files = table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumn("path", F.expr(VIRTUAL_PATH))
    return licenses.scanned(files, "path", "text", "doc_id").withColumnRenamed("id", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the items found in it; texts that are null, empty or without words hold none; repeated rows stay."""
    found = decontam.contaminated(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    return found.withColumnRenamed("id", "doc_id")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and its class; texts that are null, empty or without words are classes of their own; repeated rows share one."""
    found = minhash.classes(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, whatever its text; labels that are null are not learned; repeated rows stay."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"]).where("quality is not null")
    model = quality.fitted(docs.join(labels, "doc_id").where(fold("doc_id", 4) != 2), "text", "quality", F.col("doc_id"))
    found = quality.scored(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component; vectors that are null, zero or not finite and those without a label have none."""
    found = embed_dedup.links(table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document; a null or empty text is one end token; repeated rows stay."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    found, total = maxent_lm.learned_and_scored(docs.where(fold("doc_id", 10) != 0), docs)
    return found.select(
        F.col("id").alias("doc_id"), (fold("id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector of 64 finite components; others, nulls too, have no row; repeated rows stay."""
    found = centroids.clustered(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return found.withColumnRenamed("id", "vec_id")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each whose vec_id is divisible by 50; unusable vectors take no part; repeated rows count once."""
    vectors = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return mih.nearest(vectors, vectors.where("vec_id % 50 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, its score and rank; null and empty texts have no features; repeated rows stay."""
    found = resampling.drawn(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["text"]))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_sharding": op2_sharding,
    "op3_language": op3_language,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_licenses": op5_licenses,
    "op6_decontamination": op6_decontamination,
    "op7_minhash": op7_minhash,
    "op8_quality": op8_quality,
    "op9_embeddings": op9_embeddings,
    "op10_language_model": op10_language_model,
    "op11_centroids": op11_centroids,
    "op12_neighbours": op12_neighbours,
    "op13_resampling": op13_resampling,
}
_SPLIT = "list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({0}), '\\.\\.+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}.]+'), lambda w: regexp_replace(w, '^\\.|\\.$', '', 'g')), lambda w: w <> '')"
_PARAGRAPHS = r"\r?\n[^\p{L}\p{N}\n]*\r?\n"
_PARTS = rf"list_distinct(list_concat(string_split_regex(text, '\r?\n'), string_split_regex(text, '[.!?]+[ \t\r\n]+|{_PARAGRAPHS}'), string_split_regex(text, '{_PARAGRAPHS}'), [text]))"
_NOTICES = ", ".join("({}, '{}', '{}')".format(k, a, b.replace("'", "''")) for k, (a, b) in enumerate(licenses.TEMPLATES))
_LICENCES_SQL = f"""with shape as (select template, license, term, count(*) as tf from (select template, license, unnest({_SPLIT.format('notice')}) as term from (values {_NOTICES}) v(template, license, notice)) t group by all),
files as (select doc_id, text, (doc_id // 1000) || '/' || case when doc_id % 1000 = 0 then 'LICENSE' when doc_id % 100 = 0 then (doc_id // 100) || '/LICENSE' when doc_id % 10 = 0 then (doc_id // 100) || '/' || (doc_id // 10) || '/LICENSE' else (doc_id // 100) || '/' || (doc_id // 10) || '/' || doc_id || '.txt' end as path from documents),
n as (select count(*) as n from files), df as (select term, count(*) as df from (select distinct doc_id, unnest({_SPLIT.format('text')}) as term from files) t where term in (select term from shape) group by 1),
idf as (select term, ln((1 + n) / cast(1 + coalesce(df, 0) as double)) + 1 as idf from (select distinct term from shape) s left join df using (term), n),
weights as (select template, license, term, tf * idf as weight, sqrt(sum(tf * idf * tf * idf) over (partition by template)) as length from shape join idf using (term)),
parts as (select doc_id, {_PARTS} as parts from files), lines as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as k from parts),
terms as (select doc_id, k, term, count(*) as tf from (select doc_id, k, unnest({_SPLIT.format('line')}) as term from lines) t group by all),
vectors as (select doc_id, k, term, w, sqrt(sum(w * w) over (partition by doc_id, k)) as norm from (select doc_id, k, term, tf * coalesce(idf, ln(1 + n) + 1) as w from terms left join idf using (term), n) t),
cosines as (select doc_id, k, template, license, round(sum(w * weight), 6) as shared, round(sum(w * weight) / max(norm) / max(length), 6) as cosine from vectors join weights using (term) group by all having sum(w * weight) / max(norm) / max(length) >= 8e-1 - 1e-12),
own as (select doc_id, license, cosine from (select *, row_number() over (partition by doc_id order by license = '{licenses.RESERVED}', shared desc, cosine desc, template, license) as r from cosines) t where r = 1),
found as (select doc_id, path, license, cosine, regexp_replace(path, '/?[^/]*$', '') as home, regexp_extract(path, '([^/]*)$', 1) as name from files left join own using (doc_id)),
holders as (select home as dir, license as dir_license from (select *, row_number() over (partition by home order by cosine desc, license) as r from found where license is not null and name like 'LICENSE%') t where r = 1),
nearest as (select doc_id, arg_max(dir, length(dir)) as licence_dir, arg_max(dir_license, length(dir)) as dir_license from found join holders on home = dir or starts_with(home, dir || '/') or dir = '' where license is null group by 1)
select doc_id, path, coalesce(license, dir_license) as license, cosine, case when license is not null then 'own' when dir_license is not null then 'inherited' else 'none' end as how, licence_dir from found left join nearest using (doc_id)"""


def _nibbles() -> list[int]:
    """CRC-32 of each half byte, by the reflected polynomial."""
    out = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


def _sharding_sql(walks: int = 8) -> str:
    """Row numbers and the Feistel network in SQL; ``walks`` passes over positions outside [0, n)."""
    digest = "('0x' || substr(md5({0}), 1, 13))::bigint"
    steps, last = [], "w0"
    for walk in range(walks + 1):
        steps.append(f"f{walk}_0 as (select *, x % a as i, x // a as j from {last})")
        for k in range(sharding.ROUNDS):
            mover, other, width = ("i", "j", "a") if k % 2 == 0 else ("j", "i", "b")
            turn = digest.format(f"concat_ws(':', '7', '{k}', {other}::varchar)")
            steps.append(f"f{walk}_{k + 1} as (select * replace (({mover} + {turn} % {width}) % {width} as {mover}) from f{walk}_{k})")
        moved = "i + j * a" if walk == 0 else "case when x >= n then i + j * a else x end"
        last = f"w{walk + 1}"
        steps.append(f"{last} as (select * exclude (i, j) replace ({moved} as x) from f{walk}_{sharding.ROUNDS})")
    key = "concat_ws(chr(1), coalesce(doc_id::varchar, chr(0) || 'null'), size::varchar, text_crc32::varchar)"
    return f"""with h as (select doc_id, text, string_split(hex(encode(coalesce(text, ''))), '') as h from documents),
nib as (select doc_id, text, list_transform(range(0, 2 * octet_length(encode(coalesce(text, '')))), lambda i: (instr('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1)::bigint) as x from h),
d as (select doc_id, octet_length(encode(coalesce(text, ''))) + 8 as size, xor(list_reduce(list_concat([4294967295::bigint], x), lambda c, y: xor(({_nibbles()}::bigint[])[(xor(c, y) & 15) + 1], c >> 4)), 4294967295::bigint) as text_crc32 from nib),
r as (select *, row_number() over (order by {digest.format(key)} % {sharding.BUCKETS}, doc_id nulls first, size, text_crc32) - 1 as x, count(*) over () as n from d),
w0 as (select *, greatest(1, ceil(sqrt(n))::bigint) as a, (n + greatest(1, ceil(sqrt(n))::bigint) - 1) // greatest(1, ceil(sqrt(n))::bigint) as b from r), {", ".join(steps)}
select doc_id, size::bigint as size, text_crc32, 'rows' as law, (x % 24)::int as shard, x // 24 as slot, null::int as grown_shard from {last}"""


_VECTORS_SQL = f"""with recursive v as (select vec_id, label, len(x) as dim, x from (select vec_id, label, embedding::double[] as x from embeddings) t
  where label is not null and len(x) > 0 and len(list_filter(x, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.dim = b.dim and a.vec_id <> b.vec_id where list_cosine_similarity(a.x, b.x) >= {embed_dedup.COSINE}),
reached as (select vec_id, vec_id as other from embeddings union select r.vec_id, l.b from reached r join links l on l.a = r.other),
component as (select vec_id, min(other) as component_id from reached group by 1), degree as (select a as vec_id, count(*) as n_links from links group by 1)
select e.vec_id, coalesce(n_links, 0) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join component using (vec_id) left join degree using (vec_id)"""


def _centroids_sql() -> str:
    """The rounds unrolled: assignments by distance, then floored means of each cluster."""
    steps = []
    for turn in range(centroids.ROUNDS + 1):
        steps.append(f"""a{turn} as (select id, x, m.cluster, m.distance from (select id, x, min(struct_pack(distance := d, cluster := cluster)) as m from (select v.id, v.n, v.x, cluster,
  list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::bigint as d from v, c{turn} c) t group by n, id, x) t)""")
        if turn < centroids.ROUNDS:
            steps.append(f"""s{turn} as (select cluster, i, sum(e)::bigint as s, count(*) as n from (select cluster, unnest(x) as e, generate_subscripts(x, 1) as i from a{turn}) t group by all),
m{turn} as (select cluster, list((s - ((s % n) + n) % n) // n order by i)::bigint[] as x from s{turn} group by cluster), c{turn + 1} as (select cluster, coalesce(m.x, c.x) as x from c{turn} c left join m{turn} m using (cluster))""")
    last = centroids.ROUNDS
    return f"""with v as (select vec_id as id, row_number() over () as n, list_transform(embedding, lambda e: floor({centroids.SCALE} * e::double)::bigint) as x from embeddings
  where len(embedding) = {centroids.DIM} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
c0 as (select (row_number() over (order by h, x) - 1)::int as cluster, x from (select sha256('1:' || coalesce(id::varchar, '')) as h, x from v order by h, x limit {centroids.CLUSTERS}) t), {", ".join(steps)}
select a.id as vec_id, a.cluster, a.distance, (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(a.distance) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{last} a join c{last} c using (cluster)"""


def _resampling_sql(percent: int = 25, least_words: int = 20, seed: int = 7) -> str:
    """Features of every text, the CRC of each different one by nibbles, and integer sums of gains."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    spread = "select n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from {0}"
    n = resampling.BUCKETS
    return f"""with d as (select row_number() over () as n, doc_id, {words} as w from documents), b as (select row_number() over () as n, {words} as w from benchmark),
fd as ({spread.format('d')}), fb as ({spread.format('b')}), f as (select f, string_split(hex(encode(f)), '') as h from (select f from fd union select f from fb) t),
crc as (select f, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(0, len(h)), lambda i: (instr('0123456789ABCDEF', h[xor(i, 1) + 1]) - 1)::bigint)), lambda c, y: xor(({_nibbles()}::bigint[])[(xor(c, y) & 15) + 1], c >> 4)), 4294967295::bigint) % {n} as bucket from f),
s as (select bucket, count(*) as n from fd join crc using (f) group by 1), t as (select bucket, count(*) as n from fb join crc using (f) group by 1),
gain as (select bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select count(*) from fd) + {n}) / ((coalesce(s.n, 0) + 1)::double * ((select count(*) from fb) + {n}))))::bigint as gain from (select unnest(range(0, {n})) as bucket) k left join s using (bucket) left join t using (bucket)),
sums as (select n, sum(gain)::bigint as s, count(*) as k from fd join crc using (f) join gain using (bucket) group by 1),
scored as (select d.n, doc_id, len(w) as words, coalesce(k, 0) as n_features, case when k > 0 then (s - ((s % k) + k) % k) // k else 0 end as weight, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint as h from d left join sums using (n)),
noisy as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored),
placed as (select *, row_number() over (partition by words >= {least_words} order by score desc, doc_id nulls last, n_features) as place, (select count(*) from noisy where words >= {least_words}) * {percent} // 100 as most from noisy)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score, case when words >= {least_words} and place <= most then place end::bigint as rank from placed"""


ORACLES: dict[str, str] = {
    "op2_sharding": _sharding_sql(), "op5_licenses": _LICENCES_SQL, "op9_embeddings": _VECTORS_SQL, "op11_centroids": _centroids_sql(), "op13_resampling": _resampling_sql(),
}
