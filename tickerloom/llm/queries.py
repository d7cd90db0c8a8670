"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Tokenizer file of the token queries.
TOKENIZER = "byte_bpe_50k.json"
#: Second tokenizer of the alignment.
PIECES = "piece_bpe_32k.model"
#: Tokens beyond which op5 marks a text.
TOKEN_LIMIT = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    from .pii import digest

    return digest(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    from .jaccard import similarity_classes

    found = similarity_classes(_table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_token_store(spark, sf_dir):
    from .token_store import token_store

    return token_store(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), end_id=0)


def op4_decontaminate(spark, sf_dir):
    from .decontaminate import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_packing(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op5_token_counts(spark, sf_dir):
    from .common import texts
    from .tokens import count_tokens

    docs = texts(_table(spark, sf_dir, "documents")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = count_tokens(docs, tokenizer_path(TOKENIZER), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op7_lm_scores(spark, sf_dir):
    from .common import crc_remainder
    from .lm import score

    return score(_table(spark, sf_dir, "documents"), crc_remainder("doc_id", 10) == 0)


def op8_language_id(spark, sf_dir):
    from .common import crc_remainder, project
    from .langid import fit, identify

    docs = project(_table(spark, sf_dir, "documents"), doc_id="long", text="string", lang="string")
    held_out = crc_remainder("doc_id", 5) == 0
    model = fit(docs, ~held_out)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_warc(spark, sf_dir):
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark, sf_dir):
    from .quality import report

    return report(_table(spark, sf_dir, "documents"))


def op11_turn_reassembly(spark, sf_dir):
    from .turns import digest

    return digest(_table(spark, sf_dir, "conversations"))


def op12_bpe_codec(spark, sf_dir):
    from .transducer import digest

    return digest(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op13_token_alignment(spark, sf_dir):
    from .alignment import aligned

    return aligned(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), tokenizer_path(PIECES))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_store": op3_token_store,
    "op4_decontaminate": op4_decontaminate,
    "op6_packing": op6_packing,
    "op5_token_counts": op5_token_counts,
    "op7_lm_scores": op7_lm_scores,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_turn_reassembly": op11_turn_reassembly,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_token_alignment": op13_token_alignment,
}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({}), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"
_SOLID = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"

ORACLES: dict[str, str] = {
    "op2_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
             s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, chr(31))] END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
             l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.m)
        SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op10_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             w AS (SELECT doc_id, t, {_WORDS.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
             g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
             r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
             v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
             x AS (SELECT doc_id, unnest(ls) AS l FROM w),
             n AS (SELECT row_number() OVER () AS rid, ls FROM w),
             k AS (SELECT rid, l, (max({{'n': length(l), 't': left(l, 24)}}) OVER (PARTITION BY rid)).t AS kind FROM (SELECT rid, unnest(ls) AS l FROM n)),
             dl AS (SELECT DISTINCT rid, kind, {_PLAIN.format("l")} AS p FROM k WHERE length(l) <= 300),
             cm AS (SELECT p FROM dl GROUP BY p HAVING count(DISTINCT kind) >= greatest(10, (SELECT (count(*) + 999) // 1000 FROM documents)) AND 4 * count(DISTINCT kind) >= count(*)),
             b AS (SELECT doc_id, length(l) AS c, length(regexp_replace(l, '[^\p{{L}}\p{{N}}]+', '', 'g')) * 2 < {_SOLID.format("l")}
                          OR (len(regexp_split_to_array(l, '[|»›·•]|&gt;|  +')) >= 4 AND len({_WORDS.format("l")}) <= 4 * len(regexp_split_to_array(l, '[|»›·•]|&gt;|  +')))
                          OR (regexp_matches(lower(l), 'all rights reserved|cookie|copyright ©|enable javascript|privacy policy|terms of service|terms of use|is licensed under|subscribe to our newsletter|click here to') AND len({_WORDS.format("l")}) <= 40)
                          OR (length(l) <= 300 AND {_PLAIN.format("l")} IN (SELECT p FROM cm)) AS bad FROM x),
             f AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_removed_lines, CAST(sum(c) AS BIGINT) AS line_chars, CAST(coalesce(sum(c) FILTER (NOT bad), 0) AS BIGINT) AS kept_chars FROM b GROUP BY doc_id),
             q AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST({_SOLID.format("t")} AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                          CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
                   FROM w LEFT JOIN v ON v.doc_id = w.doc_id LEFT JOIN f ON f.doc_id = w.doc_id)
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND line_chars - kept_chars <= 0.5 * line_chars AS kept
        FROM q
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
             d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
    """,
}
