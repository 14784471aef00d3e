"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import decontaminate, langid, linededup, neardup, packing, quality, rules, secrets, suffixdedup, tokenalign, urlfilter, warc, whitening
from clausewright.llm.shared import fold, new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, {"doc_id": F.col("doc_id")})
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document, and policy v1."""
    return rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v2 removes, alone and with others, from a stored ledger; texts are read once, to make it."""
    folder = new_folder(spark, "ledger")
    rules.ledger(_table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}).write.parquet(folder)
    return rules.ablation(spark.read.parquet(folder), "v2")


def _byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    cut = packing.pieces(_table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}, _byte_tokenizer())
    return packing.pack(cut, ["doc_id"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC files and read back."""
    folder = new_folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).drop("file")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without lines that ten documents have."""
    return linededup.drop_lines(_table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}).drop("text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs), {"doc_id": F.col("doc_id")})
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their five-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(_table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}).drop("found")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict.

    The document that a page shows is the number in its path, and that document's labels are the page's outcome; pages of
    documents without labels have none.
    """
    pages = _table(spark, sf_dir, "pages")
    shown = F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/(\d{1,18})", 1).try_cast("bigint")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    outcomes = pages.select(shown.alias("doc_id"), "url").join(labels, "doc_id", "left")
    outcomes = outcomes.select(urlfilter.host_of(F.col("url")).alias("host"), urlfilter.outcome(F.col("quality"), F.col("toxic")).alias("bad"))
    return urlfilter.judge(pages, outcomes, {"page_id": F.col("page_id")})


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), {"doc_id": F.col("doc_id")})
    return found.drop("spans")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that an earlier one has."""
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}).drop("text")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between two tokenizers' tokens of every document, and how common their pairs are in all documents."""
    import public_tokenizers

    return tokenalign.align(_table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}, _byte_tokenizer(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), {"vec_id": F.col("vec_id")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_rules": op2_rules,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_secrets": op8_secrets,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
    "rules_ablation": rules_ablation,
}

#: The strength of a level of _URL_FILTER: members (n, bad) of groups (g).
_STRENGTH = """SELECT least(1000.0, greatest(1.0, CASE WHEN sum(x) > 0 AND sum(y) > 0 THEN (sum(y) - sum(x)) / sum(x) ELSE 1000.0 END)) AS m
            FROM (SELECT sum(bad * bad / n) - sum(bad) * p - p * (1 - p) * (count(*) - 1) AS x, p * (1 - p) * (sum(n) - sum(n * n) / sum(n) - (count(*) - 1)) AS y
                  FROM (SELECT *, sum(bad) OVER (PARTITION BY g) / sum(n) OVER (PARTITION BY g) AS p FROM ({}) WHERE n > 0) GROUP BY g, p)"""

#: The beta distribution's value at 0.3 is a sum over its density here, and a continued fraction in the query.
_URL_FILTER = f"""
        WITH p AS (
            SELECT page_id, url, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        o AS (
            SELECT regexp_replace(host, '^.*@|:\\d*$', '', 'g') AS host, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1.0::DOUBLE WHEN l.quality = 1 THEN 0.0 END AS bad
            FROM p LEFT JOIN labels l ON l.doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/(\\d{{1,18}})', 1) AS BIGINT)),
        h AS (
            SELECT host, n, bad, CASE WHEN address THEN host WHEN two IN ({', '.join(f"'{x}'" for x in urlfilter.SUFFIXES)}) THEN two ELSE split_part(host, '.', -1) END AS suffix,
                   CASE WHEN address THEN host ELSE array_to_string(string_split(host, '.')[CASE WHEN two IN ({', '.join(f"'{x}'" for x in urlfilter.SUFFIXES)}) THEN -3 ELSE -2 END:], '.') END AS domain
            FROM (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0) AS bad, array_to_string(string_split(host, '.')[-2:], '.') AS two, regexp_matches(host, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$|^\\[') AS address FROM o WHERE host <> '' GROUP BY host)),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
        s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
        ms AS ({_STRENGTH.format("SELECT n, bad, 0 AS g FROM s")}),
        md AS ({_STRENGTH.format("SELECT n, bad, suffix AS g FROM d")}),
        mh AS ({_STRENGTH.format("SELECT n, bad, domain || ' ' || suffix AS g FROM h")}),
        sp AS (SELECT suffix, n, bad, greatest(0.5, 1 / (1 / (m + 1) + 1 / ((SELECT sum(n) FROM s) + 3)) - 1) AS k FROM s, ms),
        sr AS (SELECT suffix, n + k AS pages, (bad + k * (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM s)) / (n + k) AS rate FROM sp),
        dp AS (SELECT domain, d.suffix, n, bad, rate AS above, greatest(0.5, 1 / (1 / (m + 1) + 1 / (pages + 1)) - 1) AS k FROM d JOIN sr ON d.suffix = sr.suffix, md),
        dr AS (SELECT domain, suffix, n + k AS pages, (bad + k * above) / (n + k) AS rate FROM dp),
        hp AS (SELECT host, n, bad, rate, greatest(0.5, 1 / (1 / (m + 1) + 1 / (pages + 1)) - 1) AS k FROM h JOIN dr ON h.domain = dr.domain AND h.suffix = dr.suffix, mh),
        ab AS (SELECT host, bad + k * rate AS a, n - bad + k * (1 - rate) AS b FROM hp),
        span AS (SELECT *, greatest(0.0, a / (a + b) - 12 * sqrt(a * b / (a + b + 1)) / (a + b)) AS low FROM ab),
        b AS (
            SELECT host FROM span WHERE low >= 0.3 OR list_sum(list_transform(range(4000), lambda i:
                exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(low + (0.3 - low) * (i + 0.5) / 4000) + (b - 1) * ln(1 - low - (0.3 - low) * (i + 0.5) / 4000)))) * (0.3 - low) / 4000 < 0.01),
        v AS (
            SELECT page_id, p.host, path, b.host IS NOT NULL AS bad,
                   CASE WHEN (p.host = 'example.net' OR p.host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                        WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                        WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
                        WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
                        WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' END AS rule
            FROM p LEFT JOIN b ON regexp_replace(p.host, '^.*@|:\\d*$', '', 'g') = b.host)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL OR bad THEN 'block' ELSE 'allow' END AS verdict
        FROM v"""

_RULES = """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
            FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
        rep AS (
            SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS r
            FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
        m AS (
            SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                   (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                   coalesce(rep.r, 0)::BIGINT AS n_repeat_words, len(string_split(t, chr(10)))::BIGINT AS n_lines
            FROM t LEFT JOIN rep ON t.doc_id = rep.doc_id),
        f AS (
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
                   ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
                    + 4 * (100 * n_symbols > 5 * word_chars)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
                    + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT)::BIGINT AS failed FROM m)
        SELECT *, failed & 3 <> 0 AS base_failed, failed & 15 = 0 AS kept FROM f"""

ORACLES: dict[str, str] = {
    "op2_rules": _RULES,
    "rules_ablation": f"""
        WITH led AS ({_RULES}), r AS (SELECT * FROM (VALUES ('few_words', 0), ('repeated_windows', 1), ('symbols', 2), ('duplicate_lines', 3), ('short_words', 4), ('long_words', 5)) t(rule, bit))
        SELECT rule, bit, coalesce(sum(failed >> bit & 1), 0)::BIGINT AS failed, count_if(failed = 1 << bit) AS alone FROM r, led GROUP BY rule, bit""",
    "op9_url_filter": _URL_FILTER,
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> target THEN target END AS refers_to FROM q""",
    "op5_line_dedup": """
        WITH l AS (
            SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
        f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id""",
}
