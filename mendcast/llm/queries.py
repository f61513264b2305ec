"""One query per operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendcast.llm import (
    exact_dedup, fertility, jaccard_join, language_id, lexical_search, license_scan, mixing, packing, periodic_runs, separator_scan,
    suffix_dedup, toxicity, warc,
)
from mendcast.llm.common import table, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op6_exact_dedup", r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
""")
def _(spark, sf):
    return exact_dedup.exact_dedup(table(spark, sf, "documents"))


MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
), s0 AS (SELECT source, sum(n_tokens)::BIGINT AS total, count(*) AS docs FROM d GROUP BY source),
s AS (SELECT *, total / (SELECT sum(total) FROM s0) AS p FROM s0),
b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN flat THEN mid ELSE lo END, CASE WHEN flat THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
          (SELECT ln(sum(exp((lo + hi) / 2 * ln(p)))) - (lo + hi) / 2 * sum(exp((lo + hi) / 2 * ln(p)) * ln(p)) / sum(exp((lo + hi) / 2 * ln(p)))
                  > 0.95 * ln(count(*)) OR max(exp((lo + hi) / 2 * ln(p)) / p) / sum(exp((lo + hi) / 2 * ln(p))) > 4 FROM s WHERE p > 0) AS flat
        FROM b WHERE i < 45)
), x AS (SELECT round(max_by(hi, i), 6) AS t FROM b),
w AS (SELECT source, total, docs, exp(t * ln(p)) / (SELECT sum(exp(t * ln(p))) FROM s, x WHERE p > 0) AS weight FROM s, x WHERE p > 0),
q AS (SELECT *, round(weight * (SELECT sum(total) FROM s))::BIGINT AS budget, ceil(docs / 4096)::BIGINT AS blocks FROM w),
c AS (
  SELECT d.doc_id, d.source, d.n_tokens, q.weight, q.total, q.budget, e.epoch,
         ('0x' || substr(md5('17/' || d.doc_id), 1, 8))::BIGINT % q.blocks AS block, md5('17/' || e.epoch || '/' || d.doc_id) AS ord
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  CROSS JOIN LATERAL (SELECT unnest(range(0, CASE WHEN q.budget % q.total = 0 THEN q.budget // q.total ELSE q.budget // q.total + 1 END)) AS epoch) e
  WHERE q.budget > 0
), k AS (SELECT source, epoch, block, sum(n_tokens) AS in_block,
           md5('17/' || coalesce('s' || source, 'null') || '/' || epoch || '/' || block) AS block_order FROM c GROUP BY ALL),
o AS (SELECT *, coalesce(sum(in_block) OVER (PARTITION BY source, epoch ORDER BY block_order, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
r AS (
  SELECT c.*, o.before + coalesce(sum(n_tokens) OVER (PARTITION BY c.source, c.epoch, c.block ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source AND c.epoch = o.epoch AND c.block = o.block
)
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, epoch, block, round((epoch * total + start)::DOUBLE / budget, 9) AS mix_at
FROM r WHERE epoch < budget // total OR start < budget % total
"""


@query("op8_temperature_mixing", MIX_SQL)
def _(spark, sf):
    return mixing.mix_plan(table(spark, sf, "documents"))


@query("op2_fertility_quality")
def _(spark, sf):
    return fertility.fertility_quality(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op4_separator_scan")
def _(spark, sf):
    return separator_scan.document_token_counts(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@query("op7_gzip_normaliser")
def _(spark, sf):
    return warc.archive_round_trip(table(spark, sf, "pages"), least_bytes=0)


@query("op1_ftrl_language")
def _(spark, sf):
    return language_id.identify_language(table(spark, sf, "documents"))


@query("op9_segment_toxicity")
def _(spark, sf):
    return toxicity.detect_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op10_suffix_dedup")
def _(spark, sf):
    return suffix_dedup.remove_repeats(table(spark, sf, "documents"))


@query("op5_jaccard_join")
def _(spark, sf):
    return jaccard_join.near_duplicate_classes(table(spark, sf, "documents"))


@query("op3_bm25_packing")
def _(spark, sf):
    return packing.pack_by_retrieval(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


#: Words of a column ``text`` as ``p`` (from 0) and ``w``: only A-Z are lower-cased, other ASCII characters than letters and digits separate.
TERMS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op11_hybrid_search", f"""
WITH d AS (SELECT doc_id, unnest({TERMS_SQL}) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM len),
m AS (SELECT doc_id, 50 + (50 * n * docs) // words AS m FROM len, c),
q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS w FROM benchmark),
df AS (SELECT w, count(*) AS df FROM tf WHERE w IN (SELECT w FROM q) GROUP BY w),
wt AS (SELECT w, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS wt FROM df, c),
s AS (SELECT item_id, doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN wt USING (w) JOIN tf USING (w) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50
""")
def _(spark, sf):
    return lexical_search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


def license_sql(templates: license_scan.Templates) -> str:
    """The labels by brute force: every block against every template."""
    def text(w):
        return "'" + w.decode() + "'"

    words = {i: w for w, i in templates.number.items()}
    rows = ", ".join(
        f"({t}, '{templates.labels[t]}', {templates.size[t]}, {len(s)}, {text(words[i])})"
        for t, s in enumerate(templates.sets) for i in sorted(s))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, p, '{label}' AS label FROM near WHERE "
        + " AND ".join(f"{('w', 'w1', 'w2', 'w3')[i]} = {text(w)}" for i, w in enumerate(phrase))
        for label, phrase in zip(templates.phrase_labels, templates.phrases))
    return f"""
WITH d AS (SELECT doc_id, coalesce({TERMS_SQL}, []) AS ws FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS p, unnest(ws) AS w FROM d),
near AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
ph AS ({phrases}),
base AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(label) AS base FROM ph GROUP BY doc_id),
t(t, label, size, n, w) AS (VALUES {rows}),
u AS (SELECT doc_id, t, label, size, n, w, unnest([p // size, p // size - 1]) AS b FROM w JOIN t USING (w)),
h AS (SELECT doc_id, t, label, n, b * size AS begin, (b + 2) * size AS until, list(DISTINCT w) AS ws FROM u WHERE b >= 0
      GROUP BY doc_id, t, label, n, size, b HAVING 100 * count(DISTINCT w) >= {round(100 * license_scan.THRESHOLD)} * n),
less AS (SELECT DISTINCT a.doc_id, a.t, a.begin FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.begin < a.until AND b.until > a.begin
         AND list_has_all(b.ws, a.ws) AND (len(b.ws) > len(a.ws) OR (len(b.ws) = len(a.ws) AND b.n < a.n))),
lab AS (SELECT doc_id, list(label) AS named FROM h ANTI JOIN less USING (doc_id, t, begin) GROUP BY doc_id),
top AS (SELECT doc_id, max(len(ws) / n) AS best FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(base, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base, []) || coalesce(named, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN top USING (doc_id)
"""


@query("op12_license_scan", license_sql(license_scan.Templates()))
def _(spark, sf):
    return license_scan.document_labels(table(spark, sf, "documents"))


@query("op13_periodic_runs")
def _(spark, sf):
    found = periodic_runs.periodic_runs(table(spark, sf, "documents"), prepare=periodic_runs.with_planted_period)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("_best", periodic_runs.best_run(F.col("runs")))
    return best.select(
        F.col("_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
