"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, exact, langid, merkle, mixing, packing, quality, simhash, substring, topk, toxicity, urls, yinyang
from tidewire.llm.common import id_residue, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_shared(table(spark, sf_dir, "documents"), with_text=False).withColumnRenamed("kept", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


#: Wanted shares of tokens by language.
MIX_WEIGHTS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    domains = mixing.fit_domains(docs, MIX_WEIGHTS)
    members = mixing.member_table(docs, domains)
    return mixing.rates(members, mixing.fit_mix(members, domains, MIX_WEIGHTS)).withColumnRenamed("label", "lang")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"), simhash.EXACT)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels without those held out."""
    return table(spark, sf_dir, "labels").where(id_residue("doc_id", 5) != 0)


def _held_out(modulus: int, remainder: int) -> Column:
    """Rows without an id are not held out; nothing is learnt from them either."""
    return F.coalesce(id_residue("doc_id", modulus) == remainder, F.lit(False)).alias("held_out")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), _labels(spark, sf_dir), cut=0.3)
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(id_residue("doc_id", 4) != 2))
    found = langid.predict_languages(docs, model)
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score", "rejected")


#: Clusters, dimension and rounds.
CLUSTERS, DIM, ROUNDS = 16, 64, 3


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = lambda vec_id: F.sha2(F.concat(F.lit("1:"), vec_id.cast("string")), 256)
    found = yinyang.yinyang(table(spark, sf_dir, "embeddings"), CLUSTERS, DIM, order, rounds=ROUNDS)
    return yinyang.with_inertia(found).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = merkle.leaf_digest(*fields, F.replace("text", F.lit("\n"), F.lit("")))
    probe = F.when((id_residue("doc_id", 2) == 0) & F.contains("text", F.lit("\n")), changed)
    made = merkle.manifest(table(spark, sf_dir, "documents"), merkle.leaf_digest(*fields, F.col("text")), more={"probe": probe})
    told = merkle.folded(made.withColumn("probe", F.coalesce("probe", "leaf")), "probe")
    return told.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_packing, op3_mixing, op4_exact_dedup, op5_url_filter, op6_topk, op7_simhash, op8_quality, op9_toxicity, op10_language, op11_centroids, op12_bpe, op13_manifest)}

_HOST = r"CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = r"CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)



def _rounds_sql() -> str:
    """Assignment and update of each round as common table expressions."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""
        a{k} AS (
            SELECT vec_id, any_value(e) AS e, min({{'d': d, 'c': c}}) AS m
            FROM (SELECT vec_id, v.e, c, list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c{k}.e) + list_inner_product(c{k}.e, c{k}.e) AS d FROM v, c{k}) GROUP BY vec_id
        )""")
        if k < ROUNDS:
            out.append(f"""
        s{k} AS (SELECT c, i, CAST(sum(x) AS HUGEINT) AS t, count(*) AS n FROM (SELECT m.c AS c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{k}) GROUP BY c, i),
        m{k} AS (SELECT c, list(CAST((t - ((t % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS e FROM s{k} GROUP BY c),
        c{k + 1} AS (SELECT c, coalesce(m{k}.e, c{k}.e) AS e FROM c{k} LEFT JOIN m{k} USING (c))""")
    return ",".join(out)


def _leaf_sql(text: str) -> str:
    fields = ", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256(concat({fields}))"


def _climb_sql(start: str) -> str:
    """A recursive step of proof and folded digest from a level to the next."""
    before, after = "coalesce(array_to_string(hs[1 : i % 3], ''), '')", "coalesce(array_to_string(hs[i % 3 + 2 :], ''), '')"
    return f"""
            {start}
            UNION ALL
            SELECT rid, p.tree, p.level + 1, i // 3, proof || {before} || {after}, sha256({before} || fold || {after})
            FROM p JOIN runs ON runs.tree = p.tree AND runs.level = p.level AND runs.parent = i // 3"""


SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ),
        w AS (
            SELECT doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) AS h
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM d WHERE len(ws) >= 50)
        ),
        hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS least FROM w) WHERE least < doc_id),
        t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
        c AS (
            SELECT t.doc_id, p, word, last_value(hit.s IGNORE NULLS) OVER (PARTITION BY t.doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS s
            FROM t LEFT JOIN hit ON hit.doc_id = t.doc_id AND hit.s = t.p
        ),
        k AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (s IS NOT NULL AND p < s + 50) AS n_removed,
                   string_agg(word, ' ' ORDER BY p) FILTER (s IS NULL OR p >= s + 50) AS kept
            FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_url_filter": f"""
        WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        r(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
        fit AS (
            SELECT page_id, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
            FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
        FROM u LEFT JOIN fit ON fit.page_id = u.page_id AND fit.k = 1
    """,
    "op6_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM k WHERE r <= 5
    """,
    "op11_centroids": f"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, e FROM v ORDER BY c LIMIT {CLUSTERS}),{_rounds_sql()},
        t AS (SELECT c, array_to_string(list_transform(e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS told FROM c{ROUNDS})
        SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(told) AS centroid_sha256
        FROM a{ROUNDS} JOIN t ON t.c = m.c
    """,
    "op13_manifest": f"""
        WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
        o AS (
            SELECT row_number() OVER () AS rid, doc_id, leaf, CASE WHEN even AND contains(text, chr(10)) THEN changed ELSE leaf END AS probe,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS leaves, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g
            FROM (
                SELECT *, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS changed,
                       xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, steps[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 2 = 0 AS even
                FROM documents, crc
            )
        ),
        tree AS (
            SELECT g AS tree, 0 AS level, pos AS i, leaf AS h, leaves AS n FROM o
            UNION ALL
            SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY tree, level, i // 3, n
        ),
        sub AS (SELECT tree, h AS subroot, count(*) OVER () AS groups FROM tree WHERE n = 1),
        top AS (
            SELECT -1 AS tree, 0 AS level, tree AS i, subroot AS h, groups AS n FROM sub
            UNION ALL
            SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY tree, level, i // 3, n
        ),
        runs AS (SELECT tree, level, i // 3 AS parent, list(h ORDER BY i) AS hs FROM (SELECT * FROM tree UNION ALL SELECT * FROM top) WHERE n > 1 GROUP BY ALL),
        low AS ({_climb_sql("SELECT rid, g AS tree, 0 AS level, pos AS i, '' AS proof, probe AS fold FROM o").replace("FROM p JOIN", "FROM low p JOIN")}),
        high AS ({_climb_sql("SELECT rid, -1 AS tree, 0 AS level, tree AS i, proof, fold FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS k FROM low) WHERE k = 1").replace("FROM p JOIN", "FROM high p JOIN")})
        SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT h FROM top WHERE n = 1) AS verified
        FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS k FROM high) p JOIN o USING (rid) JOIN sub ON sub.tree = o.g
        WHERE k = 1
    """,
}
