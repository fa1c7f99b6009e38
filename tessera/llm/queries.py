"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import new_path


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op1_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_classifier import fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()), "quality", max_docs=4000)
    return score(docs, model, threshold=0.3).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sentence_pieces import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.hash_tree import cluster, shard

    return shard(table(spark, sf_dir, "documents"), cluster(8), cluster(9))


def op4_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import near_links

    return near_links(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), width=5, threshold=(3, 4)).drop("set_id")


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0).drop("row_hash")


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import ids_crc32, read_tokens, write_tokens

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), end_id=2)
    return ids_crc32(read_tokens(spark, path))


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_templates import drop_recurring

    out = drop_recurring(table(spark, sf_dir, "documents"), min_docs=10, similarity=0.7)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.outlier_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).drop("distance2")


QUERIES = {f.__name__: f for f in (op1_attention_quality, op2_sentence_pieces, op3_hash_tree_shards, op4_itq_near_dedup, op5_suffix_dedup, op6_jaccard_join, op7_pareto_mix, op8_orc_tokens, op9_line_templates, op10_robust_outliers)}
ORACLE: dict[str, str] = {}

#: The sets of word shingles, all pairs that share one, and what links reach.
ORACLE["op6_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT x AS node, y AS other FROM links
  UNION
  SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) m ON m.node = d.doc_id
"""

#: All pairs of a label, in double precision.
ORACLE["op4_itq_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach AS (
  SELECT x AS node, y AS other FROM links UNION SELECT r.node, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, least(d.vec_id, coalesce(m.c, d.vec_id)) AS component_id, d.vec_id = least(d.vec_id, coalesce(m.c, d.vec_id)) AS kept
FROM embeddings d LEFT JOIN (SELECT x, count(*) AS n FROM links GROUP BY x) n ON n.x = d.vec_id
LEFT JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) m ON m.node = d.vec_id
"""



def _pass_sql(n: int, s: str = "s") -> str:
    """One pass over the ranking: what is no longer than the gap, as far as it fits."""
    return f"""
), {s}a{n} AS MATERIALIZED (
  SELECT *, CASE WHEN place IS NOT NULL AND NOT took AND size <= gap THEN sum(CASE WHEN place IS NOT NULL AND NOT took AND size <= gap THEN size END) OVER (PARTITION BY source ORDER BY place NULLS LAST, h, size, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) END AS upto FROM {s}{n}
), {s}{n + 1} AS (
  SELECT * EXCLUDE (upto, gap, took), took OR coalesce(upto <= gap, FALSE) AS took, gap - coalesce(max(CASE WHEN upto <= gap THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM {s}a{n}"""


#: Water-filled targets, digests as random numbers, probabilities held at 1 from the
#: shortest texts on, the ranking by random odds over inclusion odds, and its passes.
ORACLE["op7_pareto_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS top FROM s
), f AS (
  SELECT *, row_number() OVER o AS nth, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl
  FROM w WINDOW o AS (ORDER BY top / w, source NULLS LAST)
), free AS (
  SELECT nth, l / wl AS level FROM f WHERE top * wl >= l * w ORDER BY nth LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN coalesce(nth < (SELECT nth FROM free), TRUE) THEN top ELSE (SELECT level FROM free) * w END AS target FROM f
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-12::DOUBLE) AS sure FROM t
), n AS (
  SELECT *, CASE WHEN rate - sure > 1e-12::DOUBLE THEN target - sure * source_size ELSE 0 END AS need FROM r
), z AS (
  SELECT source, size, sum(n * size) OVER (PARTITION BY source ORDER BY size) - n * size AS below, sum(n * pow(size, 0.75::DOUBLE)) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL)
), y AS (
  SELECT z.source, min({'size': size, 'below': below, 'level': (need - below) / rest}) AS y FROM z JOIN n ON z.source IS NOT DISTINCT FROM n.source
  WHERE (need - below) / rest * pow(size, -0.25::DOUBLE) <= 1 + 1e-12::DOUBLE GROUP BY z.source
), g AS (
  SELECT n.*, coalesce(need - y.below, 0) AS gap, coalesce(y.size, 0) AS free_size, coalesce(y.level, 0) AS level FROM n LEFT JOIN y ON n.source IS NOT DISTINCT FROM y.source
), p AS (
  SELECT d.*, source_size, target, sure, need, gap, free_size, least(1.0::DOUBLE, level * pow(greatest(size, 1), -0.25::DOUBLE)) AS p, (('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), s0 AS (
  SELECT *, FALSE AS took, CASE WHEN gap > 0 AND size > 0 AND size >= free_size AND p > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS place FROM p""" + "".join(map(_pass_sql, range(2))) + """
), b AS MATERIALIZED (
  SELECT *, min(CASE WHEN place IS NOT NULL AND NOT took AND size <= need AND gap > 0.01::DOUBLE * target THEN size END) OVER (PARTITION BY source) AS forced FROM s2
), t0 AS (
  SELECT * EXCLUDE (gap, took, place), FALSE AS took, took AS took1, gap AS gap1, CASE WHEN forced IS NULL THEN 0 ELSE need END AS gap,
         CASE WHEN need > 0 AND size > 0 AND p > 0 AND forced IS NOT NULL THEN CASE WHEN size = forced THEN u / 2 - 1 - size WHEN p >= 1 THEN u - 1 ELSE u * (1 - p) / (u * (1 - p) + p * (1 - u)) END END AS place FROM b""" + "".join(_pass_sql(n, "t") for n in range(2)) + """
), o AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE sure::BIGINT + (CASE WHEN forced IS NOT NULL AND gap < gap1 THEN took ELSE took1 OR size < free_size END)::BIGINT END AS copies FROM t2
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM o
"""

#: All windows of 100 bytes, those with an earlier equal one, and their union.
ORACLE["op5_suffix_dedup"] = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, i, md5(b[i + 1:i + 100]) AS m FROM (SELECT doc_id, b, unnest(range(0, greatest(octet_length(b) - 99, 0))) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS k FROM w) WHERE k > 1
), n AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER o + 100, TRUE)::INT AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n) GROUP BY doc_id, g
), k AS (
  SELECT doc_id, lag(z, 1, 0) OVER o AS x, a AS y, z FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY a)
), p AS (
  SELECT doc_id, x, y FROM k UNION ALL SELECT doc_id, max(z), NULL FROM s GROUP BY doc_id
), c AS (
  SELECT p.doc_id, string_agg(hex(CASE WHEN y IS NULL THEN b[x + 1:] WHEN y > x THEN b[x + 1:y] ELSE ''::BLOB END), '' ORDER BY x) AS h FROM p JOIN d USING (doc_id) GROUP BY p.doc_id
), t AS (
  SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: Counts of tokens by leaf and place, the most frequent 0.7 of each line's, templates
#: in ten documents, and long lines in two.
ORACLE["op9_line_templates"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, list_transform(regexp_extract_all(line, '[^ 	-
]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l
), k AS (
  SELECT doc_id, no, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf, array_to_string(w, ' ') AS m, w FROM w WHERE len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) > 0
), d AS (
  SELECT leaf, m, w, count(*) AS n FROM k GROUP BY ALL
), x AS (
  SELECT * FROM (SELECT leaf, m, n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d) WHERE t <> '<*>'
), c AS (
  SELECT leaf, p, t, sum(n) AS c FROM x GROUP BY ALL
), r AS (
  SELECT leaf, m, p, t, row_number() OVER (PARTITION BY leaf, m ORDER BY c DESC, p) AS k, count(*) OVER (PARTITION BY leaf, m) AS s FROM x JOIN c USING (leaf, p, t)
), q AS (
  SELECT leaf, m, string_agg(p || ':' || t, ' ' ORDER BY p) AS q FROM r WHERE k <= ceil(0.7::DOUBLE * s - 1e-9::DOUBLE) GROUP BY ALL
), f AS (
  SELECT leaf, q, doc_id, no FROM k JOIN q USING (leaf, m)
), g AS (
  SELECT leaf, q, min(doc_id) AS keep FROM f GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10
), e AS (
  SELECT line, min(doc_id) AS keep FROM l WHERE octet_length(encode(line)) >= 100 AND regexp_matches(line, '[^ 	-
]') GROUP BY line HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT doc_id, no FROM f JOIN g USING (leaf, q) WHERE doc_id <> keep UNION SELECT doc_id, no FROM l JOIN e USING (line) WHERE doc_id <> keep
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS t FROM l ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id
), s AS (
  SELECT doc_id, count(*) AS n_dropped FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _draw(name: str, weight: int) -> str:
    return f"-ln((('0x' || substr(md5(key || '|{name}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / {weight}.0::DOUBLE"


def _first(children: dict[str, int]) -> str:
    return "list_min([" + ", ".join(f"{{'d': {_draw(n, w)}, 'n': '{n}'}}" for n, w in sorted(children.items())) + "]).n"


#: crc32 by its table, which a recurrence makes; the descent of the tree; ranks.
ORACLE["op3_hash_tree_shards"] = f"""
WITH RECURSIVE crc(n, c, k) AS (
  SELECT n, n, 0 FROM range(0, 256) t(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY n) AS tab FROM crc WHERE k = 8
), b AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents
), d AS (
  SELECT doc_id, key, len(bytes) + 1 AS size, coalesce(xor(CASE WHEN len(bytes) > 0 THEN list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295::BIGINT) ELSE 4294967295 END, 4294967295), 0) AS text_crc32,
         {_first({"r0": 4, "r1": 4})} AS region, {_first({"r0": 4, "r1": 4, "g8": 1})} AS grown_region FROM b, tab
), k AS (
  SELECT *, CASE region WHEN 'r0' THEN {_first({"r0k0": 2, "r0k1": 2})} ELSE {_first({"r1k0": 2, "r1k1": 2})} END AS rack FROM d
), s AS (
  SELECT *, CAST(CASE rack {" ".join(f"WHEN 'r{i // 4}k{i % 4 // 2}' THEN {_first({str(i): 1, str(i + 1): 1})}" for i in range(0, 8, 2))} END AS INTEGER) AS shard FROM k
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(key || '|' || text_crc32 || '|' || size), doc_id NULLS FIRST) - 1 AS slot, CASE WHEN grown_region = 'g8' THEN 8 ELSE shard END::INTEGER AS grown_shard FROM s
"""


def _outlier_sql(floors: dict[str, float], support: float = 0.75, cutoff: float = 40.0, prior: float = 200.0, tolerance: float = 0.001, most: int = 12) -> str:
    """The rules in SQL: statistics, three starts, and more concentration steps than
    they take to stand still."""
    names, least = list(floors), list(floors.values())
    p = range(len(names))
    terms = {f"m{i}": names[i] for i in p} | {f"s{i}_{j}": f"{names[i]} * {names[j]}" for i in p for j in range(i + 1)}

    def pooled(rows: str, keys: str, wide: str) -> str:
        sums = f"SELECT {keys}, count(*) AS n, {', '.join(f'sum({x}) AS g_{k}' for k, x in terms.items())} FROM ({rows}) GROUP BY ALL"
        return f"SELECT {keys}, {', '.join(f'(g_{k} + {prior}::DOUBLE * sum(g_{k}) OVER (PARTITION BY {wide}) / sum(n) OVER (PARTITION BY {wide})) / (n + {prior}::DOUBLE) AS {k}' for k in terms)} FROM ({sums})"

    chol = []
    for i in p:
        for j in range(i + 1):
            cov = f"s{i}_{j} - m{i} * m{j}" + (f" + {least[i] ** 2}::DOUBLE" if i == j else "") + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            chol.append((f"sqrt(greatest({cov}, {least[i] ** 2 / 100}::DOUBLE))" if i == j else f"({cov}) / l{j}_{j}") + f" AS l{i}_{j}")
    ys = [f"({names[i]} - m{i}" + "".join(f" - l{i}_{k} * y{k}" for k in range(i)) + f") / l{i}_{i} AS y{i}" for i in p]
    d2 = " + ".join(f"y{i} * y{i}" for i in p)
    logdet = " + ".join(f"2 * ln(l{i}_{i})" for i in p)

    def distance(e: str) -> str:
        return f"SELECT *, {d2} AS d2 FROM (SELECT *, {', '.join(ys)} FROM f JOIN (SELECT *, {', '.join(chol)} FROM {e}) USING (gl, gs))"

    start = ", ".join(f"max(CASE WHEN k = {i} THEN q2 END) AS q{i}, max(CASE WHEN k = {i} THEN sd END) AS d{i}" for i in p)
    middle = ", ".join(f"q{i} AS m{i}" for i in p) + ", " + ", ".join(f"q{i} * q{j}" + (f" + d{i} * d{i}" if i == j else "") + f" AS s{i}_{j}" for i in p for j in range(i + 1))
    box = " AND ".join(f"abs({names[i]} - q{i}) <= 2 * greatest(d{i}, {least[i]}::DOUBLE)" for i in p)
    some = ", ".join(terms)
    steps = "".join(
        f""", near{t} AS MATERIALIZED (SELECT gl, gs, st, {", ".join(names)}, floor(ln(d2 + 1e-9::DOUBLE) * 64)::BIGINT AS bin FROM ({distance(f"e{t}")})
), rank{t} AS (
  SELECT gl, gs, st, bin, sum(n) OVER (PARTITION BY gl, gs, st ORDER BY bin) AS c, sum(n) OVER (PARTITION BY gl, gs, st) AS t FROM (SELECT gl, gs, st, bin, count(*) AS n FROM near{t} GROUP BY ALL)
), new{t} AS (
  SELECT *, {logdet} AS det FROM (SELECT *, {", ".join(chol)} FROM ({pooled(f"SELECT * FROM near{t} JOIN (SELECT gl, gs, st, min(bin) AS most FROM rank{t} WHERE c >= {support}::DOUBLE * t GROUP BY ALL) USING (gl, gs, st) WHERE bin <= most", "gl, gs, st", "gl, st")}))
), e{t + 1} AS MATERIALIZED (
  SELECT gl, gs, st, {", ".join(f"CASE WHEN better THEN {k}_1 ELSE {k} END AS {k}" for k in terms)}, CASE WHEN better THEN det_1 ELSE det END AS det
  FROM (SELECT o.*, {", ".join(f"n.{k} AS {k}_1" for k in terms)}, n.det AS det_1, o.det IS NULL OR n.det < o.det - {tolerance}::DOUBLE AS better FROM e{t} o JOIN new{t} n USING (gl, gs, st))
)"""
        for t in range(most)
    )
    return f"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), u AS (
  SELECT *, row_number() OVER () AS id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t
), g AS (
  SELECT id, i, count(*) OVER (PARTITION BY id, s) AS c FROM (SELECT id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM u WHERE len(w) >= 5))
), v AS (
  SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS k FROM g WHERE c > 1) GROUP BY id
), b AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM u LEFT JOIN v USING (id)
), f AS MATERIALIZED (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce('=' || lang, '') AS gl, coalesce('=' || source, '') AS gs,
         ln(greatest(n_words, 1)::DOUBLE) AS _f0, ln(greatest(word_chars, 1) / greatest(n_words, 1)::DOUBLE) AS _f1, ln(1 + 1000.0::DOUBLE * n_symbols / greatest(word_chars, 1)) AS _f2,
         ln(1 + 1000.0::DOUBLE * n_dup_lines / greatest(n_words, 1)::DOUBLE) AS _f3, ln(1 + 1000.0::DOUBLE * n_repeat_words / greatest(n_words, 1)::DOUBLE) AS _f4 FROM b
), h AS (
  SELECT gl, gs, k, bin, sum(n) OVER (PARTITION BY gl, gs, k ORDER BY bin) AS c, sum(n) OVER (PARTITION BY gl, gs, k) AS t
  FROM (SELECT gl, gs, unnest([{", ".join(map(str, p))}]) AS k, unnest([{", ".join(f"floor({n} * 100)::BIGINT" for n in names)}]) AS bin, 1 AS n FROM f)
), q AS (
  SELECT gl, gs, k, min(CASE WHEN c >= 0.5::DOUBLE * t THEN bin END) / 100.0::DOUBLE AS q2, (min(CASE WHEN c >= 0.75::DOUBLE * t THEN bin END) / 100.0::DOUBLE - min(CASE WHEN c >= 0.25::DOUBLE * t THEN bin END) / 100.0::DOUBLE) / 1.35::DOUBLE AS sd FROM h GROUP BY gl, gs, k
), r AS MATERIALIZED (
  SELECT gl, gs, {start} FROM q GROUP BY gl, gs
), e0 AS MATERIALIZED (
  SELECT gl, gs, 0 AS st, {some}, NULL::DOUBLE AS det FROM (SELECT gl, gs, {middle} FROM r)
  UNION ALL SELECT gl, gs, 1, {some}, NULL FROM ({pooled("SELECT * FROM f", "gl, gs", "gl")})
  UNION ALL SELECT gl, gs, 2, {some}, NULL FROM ({pooled(f"SELECT * FROM f JOIN r USING (gl, gs) WHERE {box}", "gl, gs", "gl")})
){steps}, best AS (
  SELECT gl, gs, min({{'det': det, 'st': st, {", ".join(f"'{k}': {k}" for k in terms)}}}) AS e FROM e{most} GROUP BY gl, gs
), estimate AS (
  SELECT gl, gs, {", ".join(f"e.{k} AS {k}" for k in terms)} FROM best
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND d2 <= {cutoff}::DOUBLE AS kept FROM ({distance("estimate")})
"""


def _with_outliers() -> None:
    from tessera.llm.outlier_rules import FEATURES

    ORACLE["op10_robust_outliers"] = _outlier_sql(FEATURES)


_with_outliers()
