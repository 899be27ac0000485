"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import alignment, covertree, interactions, lines, mixing, mixture, packing, quality, repeats, secrets, simhash, topk, toxicity

#: Shares and epochs of ``op1_mixing``.
_SHARE, _EPOCHS, _SEED = (9, 10), 3, 42
#: Bytes of a passage (about 50 words) that ``op7_repeats`` reports, beside the longer ones that it removes.
_PASSAGE = 300


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def training_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``labels`` from which models may learn."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.filter(~_held_out())


def _held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Nine tenths of the tokens of ``documents``, shared by domain, language and source."""
    docs = _documents(spark, sf)
    return mixing.mix(docs, mixing.document_levels(), mixing.DOCUMENT_WEIGHTS, _SHARE, _EPOCHS, _SEED)


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    scored = quality.score(docs, quality.fit(docs, training_labels(spark, sf)))
    return scored.withColumn("held_out", _held_out())


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of a text, by hash of the whole of it, are one duplicate cluster; texts without words are in none."""
    return packing.pack(_documents(spark, sf), packing.copies(F.col("text")))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf))


def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(_documents(spark, sf))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Bad text, toxic among bad and among good text, and by these whether it is toxic at all."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    categories = {"p_bad": ~good, "p_toxic_bad": toxic & ~good, "p_toxic_good": toxic & good, "p_toxic": toxic}
    docs = _documents(spark, sf)
    return toxicity.score(docs, toxicity.fit(docs, training_labels(spark, sf), categories))


def op7_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """What goes and what is left, and the bytes in passages that repeat, shorter ones too, which stay."""
    cut = repeats.cut_repeats(_documents(spark, sf), shorter=_PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), "sha256").alias("kept_sha256"),
        F.col("n_shorter").alias("n_passages"), (F.col("n_shorter") > 0).alias("has_passages"),
    )


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that repeat an earlier one, by document and number."""
    return lines.repeated_lines(_documents(spark, sf)).select("doc_id", "line_no")


def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.best_matches(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id % 50 = 0", k=5)


def op10_cover_tree(spark: SparkSession, sf: str) -> DataFrame:
    return covertree.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op11_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Five filters in all orders, by source."""
    docs, labels = _documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    return interactions.audit(docs, labels, interactions.text_failures(F.col("text")), repeats="E")


def op12_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.alignment(_documents(spark, sf))


def op13_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Nine tenths of the documents, by hash of the id, are learned from; all are scored."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0
    scored = mixture.score(_documents(spark, sf), ~held_out)
    return scored.withColumn("held_out", ~F.col("learned")).drop("learned")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_mixing, op2_quality, op3_packing, op4_simhash, op5_secrets, op6_toxicity, op7_repeats, op8_line_dedup,
        op9_topk, op10_cover_tree, op11_interactions, op12_alignment, op13_mixture,
    )
    return {f.__name__: f for f in named}


def _weight_sql(level: str) -> str:
    own = mixing.DOCUMENT_WEIGHTS[level].items()
    return f"CASE {level} " + " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in own) + " ELSE 1 END"


def _mixing_sql() -> str:
    levels = ["domain", "lang", "source"]
    steps = [f"""
docs AS (
  SELECT doc_id, CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'web'
                      WHEN starts_with(source, 'src1') THEN 'books' ELSE 'reference' END AS domain,
         lang, source, coalesce((octet_length(encode(text)) + 3) // 4, 0)::BIGINT AS tokens FROM documents
), stock AS (
  SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM docs GROUP BY ALL
), given0 AS (
  SELECT least(sum(tokens) * {_EPOCHS}, sum(tokens) * {_SHARE[0]} // {_SHARE[1]}) AS given FROM stock
)"""]
    for depth, level in enumerate(levels, 1):
        path, parent = ", ".join(levels[:depth]), levels[: depth - 1]
        join = " AND ".join(f"c.{p} IS NOT DISTINCT FROM g.{p}" for p in parent) or "true"
        family = "PARTITION BY " + ", ".join([*parent, "1"])
        steps.append(f"""
kids{depth} AS (
  SELECT c.*, g.given FROM (
    SELECT {path}, sum(tokens) * {_EPOCHS} AS can, ({_weight_sql(level)})::HUGEINT AS weight FROM stock GROUP BY {path}
  ) c JOIN given{depth - 1} g ON {join}
), part{depth} AS (
  SELECT *, given - coalesce(sum(can) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharers
  FROM kids{depth} WINDOW o AS ({family} ORDER BY can::DOUBLE / weight::DOUBLE, {path})
), unit{depth} AS (
  SELECT *, can * sharers <= rest * weight AS short,
         max(CASE WHEN can * sharers > rest * weight THEN {{'s': sharers, 'r': rest}} END) OVER ({family}) AS unit
  FROM part{depth}
), given{depth} AS (
  SELECT {path}, CASE WHEN short THEN can ELSE unit.r * weight // unit.s END AS given FROM unit{depth}
)""")
    return "WITH " + ",".join(steps) + f"""
, leaf AS (
  SELECT s.domain, s.lang, s.source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs,
         given - CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END * tokens AS last_budget
  FROM stock s JOIN given3 g ON s.domain IS NOT DISTINCT FROM g.domain AND s.lang IS NOT DISTINCT FROM g.lang
       AND s.source IS NOT DISTINCT FROM g.source
), placed AS (
  SELECT d.*, l.epochs, l.last_budget,
         md5('{_SEED}:' || l.epochs || ':' || coalesce(d.doc_id::VARCHAR, 'null')) AS place
  FROM docs d JOIN leaf l ON d.domain IS NOT DISTINCT FROM l.domain AND d.lang IS NOT DISTINCT FROM l.lang
       AND d.source IS NOT DISTINCT FROM l.source
), summed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, tokens
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed
)
SELECT doc_id, domain, lang, source, tokens, epochs::BIGINT AS whole_epochs,
       greatest(0, least(tokens, last_budget - before))::BIGINT AS last_tokens FROM summed"""


def _secrets_sql() -> str:
    kinds = list(secrets.BASE | secrets.WEAK)
    found = " UNION ALL ".join(
        f"""SELECT row, doc_id, {i} AS kind, regexp_extract_all(t, $p$(?s:(.*?))({p})$p$, 1) AS g,
            regexp_extract_all(t, $p$(?s:(.*?))({p})$p$, 2) AS w, regexp_extract_all(t, $p$(?s:(.*?))({p})$p$, 3) AS v
            FROM d WHERE regexp_matches(t, $p${p}$p$)"""
        for i, p in enumerate((secrets.BASE | secrets.WEAK).values())
    )
    names = ", ".join(f"'{k}'" for k in kinds)
    secret = "kind IN (" + ", ".join(str(kinds.index(k)) for k in secrets.SECRET) + ")"

    def beside(these: str, most: int) -> str:
        return f"""(coalesce(max("end") FILTER ({these}) OVER before + {most} > start, false)
            OR coalesce(min(start) FILTER ({these}) OVER after - {most} < "end", false))"""

    near = secrets.SCOPE + 1
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  {found}
), part AS (
  SELECT row, kind, unnest(range(len(g))) AS nth, unnest(g) AS gap, unnest(w) AS width, unnest(v) AS value FROM found
), place AS (
  SELECT *, sum(length(gap) + length(width)) OVER (PARTITION BY row, kind ORDER BY nth)::BIGINT AS "end" FROM part
), span AS (
  SELECT row, kind, "end" - length(width) AS start, "end" FROM place WHERE kind > 0 OR length(value) >= {secrets.SHORTEST_VALUE}
), judged AS (
  SELECT *, kind < {len(secrets.BASE)} AS base, CASE WHEN {secret} THEN {beside("NOT " + secret, near)}
         ELSE {beside(secret, near)} END AND NOT {beside(f"kind < {len(secrets.BASE)}", 0)} AS linked
  FROM span WINDOW before AS (PARTITION BY row ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   after AS (PARTITION BY row ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), kept AS (
  SELECT *, concat_ws(':', [{names}][kind + 1], start, "end") AS shown FROM judged WHERE base OR linked
), listed AS (
  SELECT row, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
         count(*) FILTER (NOT base) AS n, string_agg(shown, ',' ORDER BY start, kind) AS spans,
         string_agg(shown, ',' ORDER BY start, kind) FILTER (base) AS base_spans
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, coalesce(n, 0) AS n_linked,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (row)"""


_LINES = """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT doc_id, line_no, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM line
), shingled AS (
  SELECT doc_id, line_no, list_sort(list_distinct(list_transform(
    range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' ')))) AS tokens
  FROM worded WHERE len(w) > 0
), same AS (
  SELECT tokens, min((doc_id, line_no)) AS first, row_number() OVER () AS id FROM shingled GROUP BY tokens
), held AS (
  SELECT id, first, len(tokens) AS size, unnest(tokens) AS token FROM same
), alike AS (
  SELECT a.id, min(b.first) AS other FROM (
    SELECT x.id AS a, y.id AS b FROM held x JOIN held y ON x.token = y.token AND y.first < x.first
    GROUP BY x.id, y.id, x.size, y.size
    HAVING count(*) * 5 >= (x.size + y.size - count(*)) * 4
  ) JOIN same a ON a.id = a JOIN same b ON b.id = b GROUP BY a.id
)
SELECT doc_id, line_no FROM shingled JOIN same USING (tokens) LEFT JOIN alike USING (id)
WHERE first < (doc_id, line_no) OR other < (doc_id, line_no)"""

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_TOPK = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND {_USABLE}
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER o::INTEGER AS rank, vec_id, score FROM scored
WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER o <= 5"""

_COSINE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93
), reached AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reached r JOIN link l ON r.other = l.a
), component AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN counted USING (vec_id)"""


_AUDIT = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), said AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails
  FROM d LEFT JOIN said USING (doc_id)
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), gone AS (
  SELECT judged.*, o, list_min(list_transform(string_split(fails, ''), lambda f: instr(o, f))) AS place
  FROM judged, orders
), stepped AS (
  SELECT part, o, step, substr(o, step, 1) AS own, good, toxic, fails,
         CASE WHEN fails = '' THEN 9 ELSE place END AS place FROM gone, range(1, 6) AS r(step)
), counted AS (
  SELECT part, o AS filter_order, step::INTEGER AS step, own, count(*) FILTER (place > step) AS kept,
         count(*) FILTER (place = step) AS removed, count(*) FILTER (contains(fails, own) AND place < step) AS redundant,
         count(*) FILTER (fails = own) AS unique_fails, count(*) FILTER (place = step AND good) AS good_lost,
         count(*) FILTER (place = step AND toxic) AS toxic_lost FROM stepped GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express the query; brute-force tests hold the others."""
    return {
        "op1_mixing": _mixing_sql(),
        "op5_secrets": _secrets_sql(),
        "op8_line_dedup": _LINES,
        "op9_topk": _TOPK,
        "op10_cover_tree": _COSINE,
        "op11_interactions": _AUDIT,
    }
