"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import chat, decontaminate, embeddings, html_text, language, minhash, packing, store, toxicity, url_filter
from larkspur.llm.runtime import scratch, small_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op1_embedding_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.95),
r AS (SELECT a AS vec_id, a AS o FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.o = l.a),
m AS (SELECT vec_id, min(o) AS c FROM r GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM u LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""


@query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "store")
    store.write_store(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return store.read_digests(spark, path)


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


ORACLES["op3_decontamination"] = r"""
WITH bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS p FROM bi),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
di AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
occ AS (SELECT r, i, di.k, item_id FROM di JOIN win ON di.k = win.k AND array_to_string(di.w[i:i + di.k - 1], ' ') = win.p),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM occ) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


ORACLES["op4_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS o FROM b UNION SELECT r.doc_id, b.b FROM r JOIN b ON r.o = b.a),
m AS (SELECT doc_id, min(o) AS component FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and pages as documents of negative ids (-1 - page_id). A document's source stands for its host."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", "text", F.lit(None).cast("string").alias("declared"), F.col("source").alias("host"))
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    host, _ = url_filter.host_path(F.col("__u"))
    pages = pages.select((-1 - F.col("page_id")).alias("doc_id"), "text", F.col("declared_lang").alias("declared"), F.coalesce("url", F.lit("")).alias("__u")).select("doc_id", "text", "declared", host.alias("host"))
    return language.identify(own.unionByName(pages), language.fit(docs)).withColumn("kept", F.col("accepted"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(F.col("toxic"), 1 - F.col("quality")).alias("bad"))
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, labels)


_SECOND = url_filter._SECOND


def _strength_sql(name: str, source: str, group: str) -> str:
    """The strength of a level's prior, as url_filter.strength has it."""
    return f"""{name} AS (SELECT CASE WHEN sum(f) > 0 THEN CASE WHEN sum(e) > 0 THEN greatest(1.0, least(1000.0, (sum(f) - sum(e)) / sum(e))) ELSE 1000.0 END ELSE 20.0 END AS {name} FROM (
  SELECT a - b * b / n - b / n * (1 - b / n) * (k - 1) AS e, b / n * (1 - b / n) * (n - q / n - (k - 1)) AS f FROM (
    SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS b, sum(n::DOUBLE * n) AS q, sum(bad::DOUBLE * bad / n) AS a FROM {source} WHERE n > 0 {group})))"""


def _side_sql(sign: str) -> str:
    x = f"(ln(0.2 / 0.8) {sign} j * step)"
    return f"list_sum([CASE WHEN j = 0 OR j = {url_filter.STEPS} THEN 1.0::DOUBLE WHEN j % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END * exp(a * {x} - (a + b) * (greatest({x}, 0) + ln(1 + exp(-abs({x})))) - top) for j in range(0, {url_filter.STEPS + 1})])"


ORACLES["op10_url_filters"] = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL AND greatest(toxic, 1 - quality) IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad, CASE WHEN regexp_matches(host, '{_SECOND}') THEN 2 ELSE 1 END AS labels FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h AS (SELECT host, n, bad, array_to_string(list_slice(string_split(host, '.'), -labels - 1, -1), '.') AS dom, array_to_string(list_slice(string_split(host, '.'), -labels, -1), '.') AS suf FROM h0),
d AS (SELECT dom, suf, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY dom, suf),
s AS (SELECT suf, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suf),
t AS (SELECT sum(n) AS tn, sum(bad) AS tb FROM s),
{_strength_sql('k1', 's', '')}, {_strength_sql('k2', 'd', 'GROUP BY suf')}, {_strength_sql('k3', 'h', 'GROUP BY dom, suf')},
s1 AS (SELECT suf, n AS sn, bad AS sb, (tb - bad + 1) / (tn - n + 2) AS sm, tn, k1, k2, k3 FROM s, t, k1, k2, k3),
d1 AS (SELECT dom, suf, n AS dn, bad AS db, (sb - bad + k1 * sm) / (sn - n + k1) AS dm, tn, k2, k3 FROM d JOIN s1 USING (suf)),
m AS (SELECT host, n, bad, (db - bad + k2 * dm) / (dn - n + k2) AS hm, tn, k3 FROM h JOIN d1 USING (dom, suf)),
ab AS (SELECT host, n, tn, (bad + k3 * hm + 0.5)::DOUBLE AS a, (n - bad + k3 * (1 - hm) + 0.5)::DOUBLE AS b FROM m),
w AS (SELECT *, sqrt(1 / a + 1 / b) / 8 AS step, a * ln(a / b) - (a + b) * (greatest(ln(a / b), 0) + ln(1 + exp(-abs(ln(a / b))))) AS top FROM ab),
z AS (SELECT host, n, tn, a, b, {_side_sql('+')} AS above, {_side_sql('-')} AS below FROM w),
r AS (SELECT host, n, CASE WHEN tn > 0 THEN CASE WHEN above + below > 0 THEN above / (above + below) WHEN ln(a / b) > ln(0.2 / 0.8) THEN 1 ELSE 0 END ELSE 0 END AS risk FROM z),
x AS (SELECT p.page_id, p.host, p.path, r.risk, r.n, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p LEFT JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN risk >= 0.975 THEN 'block' ELSE 'allow' END AS verdict, rule IS NOT NULL AS by_rule, CAST(n AS BIGINT) AS host_labelled FROM x
"""


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    path = scratch(spark, "chat")
    chat.write_conversations(chat.format_turns(turns.unionByName(extra)), path)
    return chat.digest(chat.read_conversations(spark, path))


ORACLES["op7_chat_format"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + length(regexp_replace(text, '([<\\[])(\\\\*)(\\|turn\\|>|\\|end\\|>|\\|image\\|>|\\|audio\\|>|\\|document\\|>|s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>)', '\\1\\2#\\3', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
