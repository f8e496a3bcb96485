"""One query per operator over its whole table, and its result in SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicwise.llm import alignment, decontaminate, lattice, licences, maintext, minhash, packing, paragraphs, shards, tokenfile, toxicity, variants, warc
from topicwise.llm.common import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(packing.pack(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, length=2048))


def pieces(sequences: DataFrame) -> DataFrame:
    rows = sequences.select("sequence_id", "ids", F.explode("docs").alias("d"))
    return rows.select(
        "d.doc_id",
        "d.start",
        "d.length",
        F.expr("crc32(substring(ids, CAST(4 * d.offset + 1 AS INT), CAST(4 * d.length AS INT)))").alias("ids_crc32"),
        "d.doc_tokens",
        "sequence_id",
        "d.offset",
    )


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = shards.write_shards(docs, shards=8)
    return shards.read_shards(spark, path, docs.schema).select(
        "record.doc_id",
        F.expr("CAST(coalesce(octet_length(record.text), 0) + 1 AS BIGINT)").alias("size"),
        F.expr("crc32(CAST(coalesce(record.text, '') AS BINARY))").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfile.write_token_files(read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return tokenfile.read_token_files(spark, path)


HELD_OUT = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(f"NOT ({HELD_OUT})")
    rows = toxicity.score(docs, toxicity.train(docs, labels))
    return rows.select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr("CAST(score >= 0.5 AS INT)").alias("predicted")
    )


def archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = dict(pages.dtypes)["page_id"]
    return warc.read_archive(spark, warc.write_archive(pages)).select(
        F.col("id").cast(kind).alias("page_id"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    rows = decontaminate.decontaminate(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), size=13)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"),
    )


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(docs, words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def repeated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per paragraph that is repeated: where it stands, and which document keeps it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = paragraphs.repeated_paragraphs(docs)
    return found.select(
        F.col("doc").alias("doc_id"),
        F.col("place").alias("paragraph"),
        F.col("begin").alias("start"),
        "length",
        F.col("cluster_doc").alias("kept_doc_id"),
        "kept",
    )


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def licences_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = licences.scan(docs, licences.templates(spark))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", "labels").alias("labels"),
        "score",
    )


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.runs(read(spark, sf_dir, "documents").select("doc_id", "text"), at_least=6)
    code = F.crc32(F.concat(F.coalesce(F.col("doc").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = F.pmod(code, F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(code % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))
    rows = variants.variants(variants.vocabulary(words, at_least=5, min_length=6), ratio=5)
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


LICENCE_VALUES = ", ".join(
    f"({i}, '{label}', string_split(replace('{text}', '.', ' '), ' '), {share}, {whole})"
    for i, (label, text, share, whole) in enumerate(
        [(*p, 1.0, "true") for p in licences.PHRASES] + [(*n, licences.CONTAINMENT, "false") for n in licences.NOTICES]
    )
)

QUERIES = {
    "op1_main_text_suffixes": main_texts,
    "op2_pack_concatenate_cut": packed,
    "op3_decontaminate_positional": contaminated,
    "op4_shard_external_shuffle": sharded,
    "op5_paragraph_minhash": repeated_paragraphs,
    "op6_embedding_e8": near_vectors,
    "op7_minhash_tensored": near_duplicates,
    "op8_toxicity_subwords": scored,
    "op9_warc_boundary_chain": archived,
    "op10_token_orc": token_files,
    "op11_license_containment": licences_found,
    "op12_spelling_sorted_list": spelling_variants,
    "op13_align_perfect_hash": aligned,
}

ORACLE = {
    "op3_decontaminate_positional": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), []) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
        p AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
              FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0),
        k AS (SELECT DISTINCT k FROM p),
        o AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, k, unnest(range(1, len(w) - k + 2)) AS t(i)),
        m AS (SELECT doc_id, i, o.k, item_id FROM o JOIN p ON o.k = p.k AND o.g = p.g),
        h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
        n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                     string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op6_embedding_e8": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(b) AS component_id, a = min(b) AS kept
        FROM r LEFT JOIN n USING (a) GROUP BY a""",
    "op7_minhash_tensored": r"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
        e AS (SELECT doc_id, unnest(g) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT c.a, c.b FROM c JOIN s x ON c.a = x.doc_id JOIN s y ON c.b = y.doc_id
              WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT s.doc_id, len(g) AS n_shingles, min(b) AS component_id, s.doc_id = min(b) AS kept
        FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, g""",
    "op9_warc_boundary_chain": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p LEFT JOIN m USING (d)""",
    "op11_license_containment": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), []) AS w FROM documents),
        t AS (SELECT template, label, p, whole, len(p) AS k, len(list_distinct(p)) AS m,
                     greatest(ceil(share * len(list_distinct(p)) - 1e-9), 1) AS need
              FROM (VALUES @VALUES@) AS t(template, label, p, share, whole)),
        b AS (SELECT doc_id, label, whole, p, k, w, b, len(list_distinct(list_intersect(w[b * k + 1:b * k + 2 * k - 1], p))) AS n, m
              FROM (FROM d, t WHERE len(list_intersect(list_distinct(w), p)) >= need), unnest(range(0, len(w) // k + 1)) AS u(b)
              WHERE len(list_intersect(w[b * k + 1:b * k + 2 * k - 1], p)) >= need),
        f AS (SELECT doc_id, label, whole, n / m AS share, CASE WHEN whole THEN
                     list_filter(range(b * k, b * k + k), lambda i: w[i + 1:i + k] = p) ELSE [] END AS places FROM b),
        g AS (SELECT doc_id, sum(len(places)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE whole) AS base_labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
              FROM f WHERE NOT whole OR len(places) > 0 GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN g USING (doc_id)""".replace("@VALUES@", LICENCE_VALUES),
    "op12_spelling_sorted_list": r"""
        WITH RECURSIVE c AS (SELECT list(list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i) ORDER BY i) AS t
              FROM range(256) AS r(i)),
        d AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        g AS (SELECT doc_id, w, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM d WHERE length(w) >= 6 GROUP BY ALL),
        b AS (SELECT w, n, flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
                ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END)) AS y FROM g),
        h AS (SELECT w, n, xor(list_reduce(y, lambda a, x: xor(a // 256, t[xor(a, x) % 256 + 1]), 4294967295), 4294967295) AS h FROM b, c),
        o AS (SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        x AS (SELECT word, i, word[1:i] || word[i + 2:] AS s FROM v, unnest(range(length(word))) AS t(i)),
        p AS (SELECT a.word AS a, b.word AS b FROM x a JOIN x b USING (i, s) WHERE a.word <> b.word
              UNION SELECT x.word, v.word FROM x JOIN v ON x.s = v.word UNION SELECT v.word, x.word FROM x JOIN v ON x.s = v.word),
        k AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r
              FROM p JOIN v ON b = word),
        f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN k.n >= 5 * v.n THEN b END AS form,
                     CASE WHEN k.n >= 5 * v.n THEN k.n END AS form_n FROM v LEFT JOIN k ON a = word AND r = 1),
        z AS (SELECT word, word AS root, form FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON f.word = z.form)
        SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.word = z.word AND z.form IS NULL""",
}
