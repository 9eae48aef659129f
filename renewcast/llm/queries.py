"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewcast.llm import audit, chat, decontam, fim, licenses, minhash, neighbours, packing, quality, suffix_dedup, toxicity, url_filter, warc
from renewcast.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- 10: URL filter

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The synthetic pages carry the id of their document at the end of the path; ``labels`` judges documents.
PAGE_DOCUMENT = r"/([0-9]{1,18})(?:\.html)?/?$"


@query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("ref"), bad.alias("bad")).where("ref IS NOT NULL AND bad IS NOT NULL")
    _, path = url_filter.split_url(F.col("url"))
    ref = F.nullif(F.regexp_extract(path, PAGE_DOCUMENT, 1), F.lit(""))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES, ref=ref)


_SUFFIXES = ", ".join(f"'{x}'" for x in url_filter.SUFFIXES)         # all of two labels
ORACLES["op10_url_filter"] = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
lab AS (
  SELECT doc_id AS ref, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
pr AS (SELECT *, TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT) AS ref FROM p),
seen AS (
  SELECT host, regexp_replace(host, ':[0-9]*$', '') AS nm, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS b
  FROM pr LEFT JOIN lab USING (ref) GROUP BY 1, 2),
part AS (SELECT *, string_split(nm, '.') AS l, regexp_matches(nm, '^([0-9]{1,3}\.){3}[0-9]{1,3}$') OR starts_with(nm, '[') AS ip FROM seen),
hosts AS (
  SELECT host, n, b, CASE WHEN ip THEN nm WHEN array_to_string(l[-2:], '.') IN (SUFFIX_LIST) THEN array_to_string(l[-3:], '.')
                          ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE WHEN ip THEN 'ip' WHEN array_to_string(l[-2:], '.') IN (SUFFIX_LIST) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
  FROM part),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY 1),
lev AS (
  SELECT 'h' AS lev, n, b FROM hosts WHERE n > 0 UNION ALL SELECT 'd', n, b FROM domains WHERE n > 0
  UNION ALL SELECT 's', n, b FROM suffixes WHERE n > 0),
mom AS (SELECT lev, count(*) AS k, sum(n) AS n, sum(b) AS b, sum(n * n) AS nn, sum(b * b / n) AS bb FROM lev GROUP BY 1),
rho AS (
  SELECT lev, CASE WHEN k > 1 AND (b / n) * (1 - b / n) * (n - nn / n - (k - 1)) > 0
    THEN (bb - b / n * b - (k - 1) * (b / n) * (1 - b / n)) / ((b / n) * (1 - b / n) * (n - nn / n - (k - 1))) ELSE 0 END AS r FROM mom),
w AS (SELECT lev, round((1 - least(0.5, greatest(0.002, r))) / least(0.5, greatest(0.002, r)), 6) AS w FROM rho),
ws AS (SELECT coalesce(max(w) FILTER (lev = 'h'), 499) AS wh, coalesce(max(w) FILTER (lev = 'd'), 499) AS wd,
              coalesce(max(w) FILTER (lev = 's'), 499) AS wsu FROM w),
root AS (SELECT (coalesce(sum(b), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS m FROM hosts),
top AS (SELECT suffix, (wsu * m + b) / (wsu + n) AS ms FROM suffixes, ws, root),
mid AS (SELECT domain, (wd * ms + b) / (wd + n) AS md FROM domains JOIN top USING (suffix), ws),
post AS (SELECT host, wh * md + b AS a, wh * (1 - md) + n - b AS be FROM hosts JOIN mid USING (domain), ws),
rate AS (
  SELECT host, a / (a + be) AS bad_rate, a / (a + be) - 1.645 * sqrt(a * be / ((a + be) * (a + be) * (a + be + 1))) AS lower_bound FROM post),
ruled AS (
  SELECT p.*, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                   WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                   WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict,
       round(bad_rate, 6) AS bad_rate, round(lower_bound, 6) AS lower_bound
FROM ruled JOIN rate USING (host)
""".replace("SUFFIX_LIST", _SUFFIXES)


# ---------------------------------------------------------------- 7: chat formatting

#: One more conversation, in another layout, whose texts are control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(PROBE_TEXT).alias("prompt"),
                                  F.lit(PROBE_TEXT).alias("response"))
    records = chat.turn_records(rows).unionByName(probe, allowMissingColumns=True)
    out = chat.format_chats(records)
    back = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), "formatted",
                      chat.unescape(F.concat_ws("", F.filter("segments", lambda s: s["loss"])["text"])).alias("loss"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op7_chat_format"] = """
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(text, '<', '')))
              + 3 * (length(text) - length(replace(text, '[', ''))) AS tl,
            length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(role, '<', '')))
              + 3 * (length(role) - length(replace(role, '[', ''))) + 3 * (length(role) - length(replace(role, chr(10), ''))) AS rl
  FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + rl + 1 + tl + 8)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


# ---------------------------------------------------------------- 8: benchmark decontamination

@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS span
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
lens AS (SELECT DISTINCT n FROM bi),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS span
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN win ON dw.span = win.span AND dw.n = win.n),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""


# ---------------------------------------------------------------- 4: quality rules

@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.fit_lines(docs, table(spark, sf_dir, "labels")))


# ---------------------------------------------------------------- 6: license scan

@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- what SQL can state of operators 4 and 6

@query
def op4_quality_rules__base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


ORACLES["op4_quality_rules__base"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
dup AS (SELECT r, count(*) AS n FROM (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM ln)
        WHERE k > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
wd AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
tri AS (SELECT r, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM wd WINDOW p AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM tri WHERE z IS NOT NULL),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c > 1) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
       coalesce(hit.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(hit.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN dup USING (r) LEFT JOIN hit USING (r)
"""


@query
def op6_license_scan__base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLES["op6_license_scan__base"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wd AS (SELECT r, unnest(w) AS a, unnest(range(len(w))) AS i FROM d),
nx AS (SELECT r, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c, lead(a, 3) OVER p AS e FROM wd WINDOW p AS (PARTITION BY r ORDER BY i)),
pl AS (
  SELECT r, i, 'gpl' AS label FROM nx WHERE a = 'gnu' AND b = 'general' AND c = 'public' AND e = 'license'
  UNION ALL SELECT r, i, 'apache' FROM nx WHERE a = 'apache' AND b = 'license'
  UNION ALL SELECT r, i, 'cc-by' FROM nx WHERE a = 'cc' AND b = 'by'
  UNION ALL SELECT r, i, 'mit' FROM nx WHERE a = 'mit' AND b = 'license'),
g AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM pl GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(labels, '') AS base_labels
FROM d LEFT JOIN g USING (r)
"""


# ---------------------------------------------------------------- 9: WARC

@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.arc_to_warc(warc.pages_to_arc(table(spark, sf_dir, "pages")))
    path = warc.write_warc(warc.mark_revisits(records))
    back = warc.read_warc(spark.read.format("binaryFile").load(path))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS x FROM p),
s AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS best FROM h),
bits AS (SELECT *, list_transform(range(0, 32), lambda k: (
           ('0x' || substr(x, (k * 5 // 20) * 5 + 1, 5))::BIGINT // (32 ** (3 - k % 4))::BIGINT) % 32) AS digits FROM s)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(digits, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM bits
"""


# ---------------------------------------------------------------- 2: toxicity

@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


# ---------------------------------------------------------------- 3: near duplicates

@query
def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))


# ---------------------------------------------------------------- 1: suffix-array dedup

@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of 100 bytes, as hexadecimal text; windows are told by 128 bits of MD5.
ORACLES["op1_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT r, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
gone AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS n FROM win) WHERE n > 1),
mark AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM gone),
run AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM mark) GROUP BY r, g),
cut AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM run
        UNION ALL SELECT r, max(b), NULL FROM run GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * x + 1, coalesce(2 * (y - x), length(h))), '' ORDER BY x) AS h FROM cut JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY r)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""


# ---------------------------------------------------------------- 5: best-fit packing

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


# ---------------------------------------------------------------- 13: fill-in-the-middle

@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS x FROM documents),
h AS (
  SELECT doc_id, text, t, len(t)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
         ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT doc_id, n, form, text, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle,
         array_to_string(t[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


# ---------------------------------------------------------------- 12: filter interaction audit

@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
facts AS (
  SELECT row, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e
  FROM w LEFT JOIN lab USING (doc_id)),
fails AS (SELECT part, good, toxic, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
                 || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS f FROM facts),
pat AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
ord AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
        WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
st AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before
       FROM ord, (SELECT unnest(range(1, 6)) AS step)),
cell AS (
  SELECT part, filter_order, step, x,
         coalesce(sum(n) FILTER (NOT contains(f, x) AND translate(f, before, '') = f), 0) AS kept,
         coalesce(sum(n) FILTER (contains(f, x) AND translate(f, before, '') = f), 0) AS removed,
         coalesce(sum(n) FILTER (contains(f, x) AND translate(f, before, '') <> f), 0) AS redundant,
         coalesce(sum(n) FILTER (f = x), 0) AS unique_fails,
         coalesce(sum(good) FILTER (contains(f, x) AND translate(f, before, '') = f), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (contains(f, x) AND translate(f, before, '') = f), 0) AS toxic_lost
  FROM pat, st GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM cell
"""


# ---------------------------------------------------------------- 11: quality classifier

@query
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neighbours.score_quality(docs, neighbours.learn_space(docs, table(spark, sf_dir, "labels")))
