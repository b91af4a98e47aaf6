"""The query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dialogue, flac, htmltext, langid, packing, periodic, pii, secrets, sharding, simjoin, tokencount, urlfilter
from .common import crc_mod, new_path, table

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


#: Arrivals that the table comes in, and the size of a finished shard.
ARRIVALS, SHARD_BYTES = 13, 128 << 20


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, new_path(spark, "store"), docs.schema, SHARD_BYTES, sole_user=True)
    store.append(docs.withColumn("arrival", crc_mod(F.col("doc_id"), ARRIVALS)), "arrival")
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("text_md5"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.text_features(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one row in five dropped, emptied, shorn of its ends, repeated or given to the user."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    repair = dialogue.Repair(damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = [F.lit(None).cast("long").alias(x) for x in counts]
    null = F.lit(None).cast("string")
    found = rows.select("conv_id", *none, null.alias("audit"), null.alias("repaired_sha256")).unionByName(repair.conversations.withColumn("repaired_sha256", null))
    found = found.unionByName(repair.repaired_digests().select("conv_id", *none, null.alias("audit"), "repaired_sha256"))
    values = [F.coalesce(F.max(x), F.lit(0).cast("long")).alias(x) for x in counts]
    sha = F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256))
    return found.groupBy("conv_id").agg(*values, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), sha.alias("repaired_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of the documents the words from one on repeat with a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.select("doc_id", "text", g.alias("g"), words.alias("words"))
    n = F.size("words")
    docs = docs.select("doc_id", "text", "g", "words", F.when(n > 0, F.col("g") % n).cast("int").alias("a"))
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    docs = docs.select("doc_id", "text", "words", "a", p.alias("p"))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.concat_ws(" ", repeated)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted_periods(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    best = [F.col(f"best.{x}").alias(x) for x in ("start", "length", "period")]
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", "n_runs", *best, exponent.alias("exponent_milli"), F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_personal_data": op3_personal_data,
    "op4_packing": op4_packing,
    "op5_flac": op5_flac,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_html_text": op11_html_text,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOWER.format("text")
_HOST, _REST = _LOWER.format("regexp_extract(rest, '^[^/?#]*')"), "substr(url, strpos(url, '://') + 3)"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

#: The oracle: only what SQL can express; the trained and packed results are tested against plain versions.
ORACLE: dict[str, str] = {
    "op1_sharding": "SELECT doc_id, lang, source, n_chars, CAST(strlen(COALESCE(text, '')) AS BIGINT) AS n_bytes, md5(COALESCE(text, '')) AS text_md5 FROM documents",
    "op6_url_filter": f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN {_REST} END AS rest FROM pages),
p AS (SELECT page_id, COALESCE({_HOST}, '') AS host, COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES {_RULES}) AS v(verdict, h, q)),
m AS (SELECT page_id, host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY 1, 2, 3)
SELECT p.page_id, p.host, p.path, m.rule, COALESCE(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id""",
    "op7_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_TEXT}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 13) AS m, unnest(range(1, CAST(len(w) - least(len(w), 13) + 2 AS BIGINT))) AS p, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g FROM i),
g AS (SELECT doc_id, p, x.m, array_to_string(w[p:p + x.m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, CAST(greatest(len(w) - m + 2, 1) AS BIGINT))) AS p FROM d, (SELECT DISTINCT m FROM win)) AS x),
h AS (SELECT doc_id, item_id, p, g.m FROM g JOIN win USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    # crc32 from its table; costs backwards and letters forwards, a row a step; states and lists count from 1
    "op12_conversation_repair": """WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) AS r(i))),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE COALESCE(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(COALESCE(text, ' '), '.!?', '') ELSE COALESCE(text, ' ') END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, substr(role, 1, 1) AS c FROM d),
f AS (SELECT conv_id, turn, role, text, i, c, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  COALESCE(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), FALSE) AS illegal FROM o),
g AS (SELECT *, CASE fault WHEN 't' THEN 3 ELSE 0 END AS x, fault NOT IN ('b', 'd') AS ok FROM f),
a AS (SELECT conv_id, count(*) AS n, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM g GROUP BY 1),
v(conv_id, i, c) AS (SELECT conv_id, n + 1, [0, 6, 3, 0] FROM a UNION ALL SELECT conv_id, i, [least(b[1], 3 + b[3], 6 + b[4]), least(b[2], 3 + b[3], 6 + b[4]), least(b[3], 3 + b[4]), least(b[4], 3 + b[3])] FROM (SELECT g.conv_id, g.i, [
  least(4 + v.c[1], CASE WHEN ok THEN 3 + x + v.c[3] END, CASE WHEN ok AND g.c = 's' THEN x + v.c[2] WHEN ok AND g.c = 'u' THEN x + v.c[3] END), least(4 + v.c[2], CASE WHEN ok THEN 3 + x + v.c[3] END, CASE WHEN ok AND g.c = 'u' THEN x + v.c[3] END),
  least(4 + v.c[3], CASE WHEN ok THEN 3 + x + v.c[4] END, CASE WHEN ok AND g.c = 'a' THEN x + v.c[4] END), least(4 + v.c[4], CASE WHEN ok THEN 3 + x + v.c[3] END, CASE WHEN ok AND g.c = 'u' THEN x + v.c[3] END)] AS b
  FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i - 1)),
w(conv_id, i, q, audit, repaired) AS (SELECT conv_id, CAST(1 AS BIGINT), 1, '', CAST([] AS VARCHAR[]) FROM a UNION ALL SELECT conv_id, i + CASE e WHEN 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE turned END, audit || e,
  CASE e WHEN 'D' THEN repaired ELSE list_append(repaired, CASE WHEN e = 'K' THEN role ELSE CASE turned WHEN 3 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END) END
  FROM (SELECT s.*, CASE WHEN after IS NOT NULL AND here[q] = 4 + after[q] THEN 'D' WHEN here[q] = 3 + here[turned] THEN 'I' WHEN kept IS NOT NULL AND here[q] = x + after[kept] THEN 'K' ELSE 'R' END AS e
  FROM (SELECT w.*, h.c AS here, n.c AS after, g.role, g.text, g.x, CASE WHEN q = 3 THEN 4 ELSE 3 END AS turned, CASE WHEN NOT ok THEN NULL WHEN q = 1 AND g.c = 's' THEN 2 WHEN q <> 3 AND g.c = 'u' THEN 3 WHEN q = 3 AND g.c = 'a' THEN 4 END AS kept
  FROM w JOIN v AS h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i LEFT JOIN v AS n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.i = w.i + 1 LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i) AS s WHERE after IS NOT NULL OR here[q] > 0)),
z AS (SELECT w.conv_id, audit, repaired FROM w JOIN a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n + 1 AND q IN (1, 4))
SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated, COALESCE(illegal, 0) AS illegal, CAST(COALESCE(v.c[1], 0) AS BIGINT) AS cost, COALESCE(audit, '') AS audit, sha256(COALESCE(array_to_string(repaired, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 1 LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id""",
    # the article of pages that have one, its blocks at the ends of p and h1; by expressions alone
    "op11_html_text": """WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'), lambda t: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
  '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot', '"'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, regexp_replace(array_to_string(list_filter(blocks, lambda t: t <> ''), chr(10)), '&amp($|\n)', '&\1', 'g') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t""",
    "op10_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, CAST(len(w) - 2 AS BIGINT)), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT r.doc_id, COALESCE(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1""",
}
