"""The registered queries of this package: digest columns from the operators."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import ann, clustering, lexical, licenses, mixing, near_dedup, quality_classifier, quality_rules, secrets, sentencepiece_bpe, token_store, url_filters, warc
from .common import cut, remove, shared_dir, table

# The rules of op3.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL, END_ID = "word_bpe_49k.json", 2


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs.select("doc_id", "text"), secrets.train(secrets.labelled_samples(docs)))
    as_text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the same number: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")
    labels = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    outcomes = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", "bad")
    return url_filters.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts, own = F.transform("places", lambda x: x["start"]), F.transform("places", lambda x: x["label"])
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(own).alias("base_labels"), join(F.concat(own, F.transform("matches", lambda x: x["template"]))).alias("labels"), "score",
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(cut(warc.read(spark, path, payloads=False)))
    remove(spark, path)  # its records are read
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)", 1).try_cast("long")
    noted = F.col("metadata.fields")
    return captures.select(
        noted["pageId"].cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", noted["payloadBytes"].cast("long")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number(F.col("response.refers_to")).alias("refers_to"),
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def encoded(docs: DataFrame, model_name: str = PIECE_MODEL) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, which replace columns of these names."""

    def digests(texts: pd.Series) -> pd.DataFrame:
        import public_tokenizers

        m = sentencepiece_bpe.model(public_tokenizers.path(model_name))
        out = []
        for text in texts:
            ids = m.encode(text)
            joined = ",".join(map(m.number.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    digests.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    run = pandas_udf(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    new = ("n_tokens", "ids_sha256", "decoded_sha256")
    kept = [F.col(f"_r.`{c}`") for c in docs.columns if c.lower() not in new]
    return docs.select(F.struct("*").alias("_r"), run("text").alias("_e")).select(*kept, "_e.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard and place list those of a document's copies, in order of pass."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    listed = lambda field: F.array_join(F.transform("copies", lambda x: x[field]), ",").alias(field)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", listed("shard"), listed("place"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels.where(~quality_classifier.held_out()))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is read back by its key, through the index; those without one from the shards' own lists."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_store.write(docs, f"{at}/shards", public_tokenizers.path(WORD_MODEL), END_ID)
    stored = cut(token_store.entries(spark, f"{at}/shards"))
    token_store.index(stored, f"{at}/index")
    found = token_store.lookup(spark, f"{at}/index", docs.select(F.col("doc_id").alias("key")))
    found = found.unionByName(stored.where("key is null"))
    read = token_store.fetch(spark, f"{at}/shards", found)
    out = cut(read.select(F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    remove(spark, at)  # all of it is read
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.with_inertia(*clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_secret_scans, op3_url_filters, op4_license_scans, op5_near_dedup,
        op6_warc, op7_sentencepiece, op8_mixing, op9_nearest, op10_quality_classifier,
        op11_token_store, op12_lexical, op13_centroids,
    )}


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN links l ON l.a = r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.s)"""

OP6_SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""


TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {TERMS} AS t FROM documents),
c AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT doc_id, n, x, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS x FROM d) GROUP BY ALL),
f AS (SELECT x, count(*) AS df FROM p GROUP BY x),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS x FROM benchmark),
w AS (SELECT item_id, x, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM q JOIN f USING (x) CROSS JOIN c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM w JOIN p USING (x) CROSS JOIN c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""

OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
""" + "".join(f"""a{i} AS (SELECT vec_id, v.q AS q, arg_min(c, (list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c)) AS c,
      CAST(min(list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS BIGINT) AS d FROM v CROSS JOIN c{i} GROUP BY vec_id, v.q),
""" + (f"""m{i} AS (SELECT c, list(s ORDER BY g) AS q FROM (SELECT c, g, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS s FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS g FROM a{i}) GROUP BY c, g) GROUP BY c),
c{i + 1} AS (SELECT c, CAST(coalesce(m{i}.q, c{i}.q) AS BIGINT[]) AS q FROM c{i} LEFT JOIN m{i} USING (c)),
""" if i < 3 else "") for i in range(4)) + """e AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a3) AS inertia,
       sha256(array_to_string(c3.q, ',')) AS centroid_sha256 FROM a3 JOIN e USING (c) JOIN c3 USING (c)"""


def oracle_sql() -> dict[str, str]:
    """SQL of those queries whose every column SQL can say; the others are tested against plain versions."""
    return {"op5_near_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op12_lexical": OP12_SQL, "op13_centroids": OP13_SQL}
