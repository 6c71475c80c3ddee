"""The operators' queries ``opN_<name>`` and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroid_clusters, chat_format, jaccard_join, language_id, lexical_search, line_dedup, packing, pii, quality_rules, substring_dedup, topk_search, url_filter
from ..session import ship
from .common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
CHAT_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).drop("class_key")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk_search(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(BYTE_BPE)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(documents, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    done = byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    back = chat_format.read_back(chat_format.chat_format(turns, public_tokenizers.path(CHAT_BPE)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out of the language models' fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents.filter(~in_fold(F.col("doc_id"))), public_tokenizers.path(PIECES))
    scored = language_id.predict(documents, model)
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _of(kinds) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(*kinds))


def _spans(kinds) -> Column:
    some = _of(kinds)
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(_of([k])).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(_spans(pii.BASE), 256).alias("base_sha256"), _spans(pii.KINDS).alias("spans"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))
    said = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.withColumn("centroid_sha256", F.sha2(said, 256)).drop("centroid")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipping(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    made = (op1_url_filter, op2_jaccard_join, op3_topk_search, op4_byte_bpe, op5_chat_format, op6_packing, op7_quality_rules, op8_language_id, op9_line_dedup, op10_substring_dedup, op11_lexical_search, op12_pii, op13_centroid_clusters, pipeline)
    return {f.__name__: _shipping(f) for f in made}


_URL = "case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end"
_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER

SQL = {
    "op1_url_filter": f"""
with parts as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from (select page_id, {_URL} as rest from pages)
), judged as (
  select page_id, coalesce(translate(raw, '{_UPPER}', '{_LOWER}'), '') as host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') as path from parts
), rules(rule, verdict) as (values {', '.join(map(str, url_filter.RULES))}
), split_rules as (
  select rule, verdict, split_part(rule, '/', 1) as rule_host, substr(rule, strpos(rule, '/')) as rule_path from rules
), hits as (
  select host, path, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict
  from (select distinct host, path from judged) join split_rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by host, path
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from judged left join hits using (host, path)""",
    "op3_topk_search": """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.n as asker, q.vec_id as query_id, c.vec_id, c.n, list_inner_product(q.w, c.w)::bigint as score
  from v q join v c on q.n <> c.n where q.vec_id % 20 = 0
)
select query_id, row_number() over (partition by asker order by score desc, vec_id, n)::int as rank, vec_id, score
from scored qualify rank <= 20""",
    "op9_line_dedup": """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '%s', '%s') as key from lines
), common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select doc_id, pos, line, (keeper is not null and doc_id <> keeper) as gone from keyed left join common using (key)
)
select doc_id, count(*)::bigint as n_lines, count_if(gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id""" % (_UPPER, _LOWER),
    "op5_chat_format": """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized as (
  select *, length(role) + length(text) + %d
    + len(regexp_extract_all(role || chr(10) || text, '%s')) as chars,
    case when conv_id is null then row_number() over () end as alone from turns
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from sized group by conv_id, alone""" % (
        sum(map(len, (chat_format.TURN, chat_format.TEXT, chat_format.END))),
        "|".join("".join(f"[{c}]" if c in "[]|/<>" else c for c in x).replace("[[]", r"\[").replace("[]]", r"\]") for x in sorted(chat_format.CONTROL, key=len, reverse=True)) + r"|\\",
    ),
}


SQL["op10_substring_dedup"] = """
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents
), windows as (
  select doc_id, p, list_aggregate(w[p:p + 19], 'string_agg', ' ') as words
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from words where len(w) >= 20)
), repeated as (
  select doc_id, p from windows qualify row_number() over (partition by words order by doc_id, p) > 1
), covered as (
  select distinct doc_id, unnest(range(p, p + 20)) as p from repeated
), placed as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from words
), kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by p) as text
  from placed anti join covered using (doc_id, p) group by doc_id
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from words left join kept using (doc_id)"""


SQL["op11_lexical_search"] = f"""
with said as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{lexical_search.TERM}') as w from documents
), held as (
  select *, len(w)::hugeint as n from said where len(w) > 0
), totals as (
  select count(*)::hugeint as docs, sum(n)::hugeint as total from held
), asked as (
  select row_number() over () as i, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{lexical_search.TERM}') as w from benchmark
), wanted as (
  select i, item_id, term, count(*) as times from (select i, item_id, unnest(w) as term from asked) group by all
), found as (
  select d, doc_id, n, term, count(*)::hugeint as tf from (select d, doc_id, n, unnest(w) as term from held)
  where term in (select term from wanted) group by all
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::hugeint as weight from found, totals group by term, docs
), impacts as (
  select d, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) as impact from found join weights using (term), totals
), scored as (
  select i, item_id, d, doc_id, sum(times * impact)::bigint as score from wanted join impacts using (term) group by all
)
select item_id, row_number() over (partition by i order by score desc, doc_id nulls last, d)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 10"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    nearest = """select n, c, s from (
    select n, c, sum((x - y) * (x - y))::bigint as s from parts join c{r} using (i) group by n, c
  ) qualify row_number() over (partition by n order by s, c) = 1"""
    steps = ["""fit as materialized (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)""", """parts as materialized (
  select n, unnest(v) as x, generate_subscripts(v, 1) as i from fit
)""", f"""c0 as materialized (
  select c, unnest(v) as y, generate_subscripts(v, 1) as i from (
    select row_number() over (order by sha256('3:' || coalesce(vec_id::varchar, '')), v) - 1 as c, v from fit qualify c < {k})
)"""]
    for r in range(rounds):
        steps += [f"a{r} as materialized ({nearest.format(r=r)})", f"""c{r + 1} as materialized (
  select c, i, coalesce((t - ((t % m) + m) % m) // m, y)::bigint as y from c{r} left join (
    select c, i, sum(x)::hugeint as t, count(*)::hugeint as m from parts join a{r} using (n) group by c, i) using (c, i)
)"""]
    return "with " + ",\n".join([*steps, f"last as materialized ({nearest.format(r=rounds)})"]) + f"""
select vec_id, c::int as cluster, s as distance, sum(s) over (partition by c)::bigint as cluster_inertia, sum(s) over ()::bigint as inertia, centroid_sha256
from last join fit using (n) join (select c, sha256(string_agg(y::varchar, ',' order by i)) as centroid_sha256 from c{rounds} group by c) using (c)"""


SQL["op13_centroid_clusters"] = _clusters_sql()


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
