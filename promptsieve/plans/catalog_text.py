"""Registered queries: text functions over all prompts, documents, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions import text as T
from promptsieve.functions.variant import parse_body
from promptsieve.operators import complexity as C
from promptsieve.plans.traffic import CHAT, PROMPTS, chat, prompts, quoted, table

_Z = r"[\s\p{Z}]"


def phrase_sql(x: str) -> str:
    """First matching phrase in DuckDB; RE2 has no Unicode white space class."""
    found = ", ".join(
        f"nullif(regexp_extract({x}, {quoted(p.replace(chr(92) + 's', _Z))}, 0, 'i'), '')"
        for p in K.SUSPICIOUS_PHRASES
    )
    return f"coalesce({found})"


ZW = quoted(K.ZERO_WIDTH)
LETTERS = r"regexp_replace(text, '[^\p{L}]', '', 'g')"
ROT13 = f"translate({{}}, '{T._ROT13_FROM}', '{T._ROT13_TO}')"
UNHEX = (
    "array_to_string(list_transform(string_split(text, '\\x'), lambda p, i: CASE WHEN i = 1 THEN p "
    "WHEN regexp_matches(p, '^[0-9a-fA-F]{2}') THEN chr(cast('0x' || p[1:2] as integer)) || p[3:] "
    "ELSE '\\x' || p END), '')"
)
URL_DECODED = "url_decode(text)"
B64_TEXTS = (
    f"list_filter(list_transform(regexp_extract_all(text, '{K.BASE64_RUN}'), lambda m: "
    "CASE WHEN length(rtrim(m, '=')) % 4 = 0 OR (length(rtrim(m, '=')) % 4 = 2 AND m LIKE '%==') "
    "OR (length(rtrim(m, '=')) % 4 = 3 AND m LIKE '%=') THEN "
    "TRY(decode(from_base64(rpad(rtrim(m, '='), cast(ceil(length(rtrim(m, '=')) / 4.0) * 4 as integer), '=')))) END), "
    r"lambda d: d IS NOT NULL AND regexp_full_match(d, '(?:[^\p{C}\p{Z}]|[ ])*'))"
)
B64_COUNT = f"len({B64_TEXTS})"


def _count(chars: str) -> str:
    return f"length(text) - length(translate(text, {quoted(chars)}, ''))"


def _over(builder, **columns):
    """Column expressions are made when the query is built: they need a session."""
    return lambda spark, sf: builder(spark, sf).select(
        "request_id", *[make().alias(n) for n, make in columns.items()])


def _sql(select: str, source: str = "prompts", cte: str = PROMPTS) -> str:
    return f"WITH {cte} SELECT request_id, {select} FROM {source}"


def _md5(c):
    return F.md5(c.cast("binary"))


def occurrences_sql(x: str, needles) -> str:
    return " + ".join(
        f"(length({x}) - length(replace({x}, {quoted(n)}, ''))) // {len(n)}" for n in needles)


TOKENS = r"[\p{L}\p{M}]{1,8}|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]{1,4}"


def _sse(spark, sf):
    chunks = table(spark, sf, "conversations").selectExpr(
        "conv_id * 1000 + turn as request_id",
        "'event: x' || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || "
        "'data: [DONE]' || chr(10) as chunk")
    return chunks.select("request_id", _md5(T.sse_data("chunk")).alias("data"))


def _headers(spark, sf):
    return chat(spark, sf).select(
        "request_id", F.to_json(T.redact_headers("headers")).alias("headers"))


def _secret(spark, sf):
    text = F.concat(
        F.lit("use sk-ant-api03-"), F.col("request_id").cast("string"), F.lit(" or sk-"),
        F.col("request_id").cast("string"), F.lit(" with Bearer  abc.DEF_"), F.col("request_id").cast("string"),
        F.lit(" "), F.col("text"))
    return prompts(spark, sf).select("request_id", _md5(T.redact(text)).alias("redacted"))


ENTRIES = {
    "txt_base64_count": (
        _over(prompts, n=lambda: T.count_base64("text").cast("bigint")), _sql(f"{B64_COUNT} AS n")),
    "txt_decoded_fragments": (
        lambda spark, sf: T.explode_decoded(prompts(spark, sf).drop("client_id", "label")).select(
            "request_id", "encoding", "confidence", _md5(F.col("decoded")).alias("decoded")),
        f"WITH {PROMPTS} SELECT request_id, 'base64' AS encoding, 0.9::DOUBLE AS confidence, md5(unnest({B64_TEXTS})) AS decoded FROM prompts "
        f"UNION ALL SELECT request_id, 'url', 0.8::DOUBLE, md5({URL_DECODED}) FROM prompts WHERE regexp_matches(text, '{K.URL_ESCAPE}')"),
    "txt_has_url_encoding": (
        _over(prompts, flag=lambda: T.has_url_encoding("text")), _sql(f"regexp_matches(text, '{K.URL_ESCAPE}') AS flag")),
    "txt_url_decode": (
        _over(prompts, decoded=lambda: _md5(T.url_decode_lenient("text"))), _sql(f"md5({URL_DECODED}) AS decoded")),
    "txt_zero_width_count": (
        _over(prompts, n=lambda: T.zero_width_count("text").cast("bigint")), _sql(f"{_count(K.ZERO_WIDTH)} AS n")),
    "txt_strip_zero_width": (
        _over(prompts, stripped=lambda: _md5(T.strip_zero_width("text"))), _sql(f"md5(translate(text, {ZW}, '')) AS stripped")),
    "txt_has_hex_escapes": (
        _over(prompts, flag=lambda: T.has_hex_escapes("text")), _sql(f"regexp_matches(text, '{K.HEX_ESCAPE}') AS flag")),
    "txt_decode_hex_escapes": (
        _over(prompts, decoded=lambda: _md5(T.decode_hex_escapes("text"))), _sql(f"md5({UNHEX}) AS decoded")),
    "txt_rot13": (
        _over(prompts, rotated=lambda: _md5(T.rot13("text"))), _sql(f"md5({ROT13.format('text')}) AS rotated")),
    "txt_letters_only": (
        _over(prompts, letters=lambda: _md5(T.letters_only("text"))), _sql(f"md5({LETTERS}) AS letters")),
    "txt_confusable_count": (
        _over(prompts, n=lambda: T.confusable_count("text").cast("bigint")), _sql(f"{_count(K.CONFUSABLES)} AS n")),
    "txt_suspicious_phrase": (
        _over(prompts, phrase=lambda: T.suspicious_phrase("text")), _sql(f"{phrase_sql('text')} AS phrase")),
    "txt_count_occurrences": (
        lambda spark, sf: prompts(spark, sf).withColumn("low", F.lower("text")).select(
            "request_id", T.count_occurrences("low", K.SIMPLE_INDICATORS).cast("bigint").alias("n")),
        _sql(f"{occurrences_sql('lower(text)', K.SIMPLE_INDICATORS)} AS n")),
    "txt_redact": (
        _secret,
        "WITH " + PROMPTS + " SELECT request_id, md5(regexp_replace(regexp_replace(regexp_replace("
        "'use sk-ant-api03-' || request_id || ' or sk-' || request_id || ' with Bearer  abc.DEF_' || request_id || ' ' || text, "
        + ", '[REDACTED]', 'g'), ".join(quoted(p) for p in K.SECRET_PATTERNS)
        + ", '[REDACTED]', 'g')) AS redacted FROM prompts"),
    "txt_redact_headers": (
        _headers,
        "WITH " + CHAT + " SELECT request_id, '{\"X-Client-ID\":\"' || h_client || '\",\"X-Forwarded-For\":\"' || "
        "h_forwarded || '\",\"Authorization\":\"[REDACTED]\"}' AS headers FROM chat"),
    "txt_normalize_category": (
        _over(prompts, category=lambda: T.normalize_category(F.replace(F.col("label"), F.lit("-"), F.lit("_")))),
        _sql("label AS category")),
    "txt_sanitize_label": (
        _over(prompts, label=lambda: T.sanitize_label("text")),
        _sql(r"left(array_to_string(regexp_extract_all(text, '[^\p{C}\p{Z}]+|[ ]+'), ''), 200) AS label")),
    "txt_sse_data": (
        _sse,
        "SELECT conv_id * 1000 + turn AS request_id, md5(replace(text, chr(10), ' ')) AS data FROM conversations"),
    "txt_tokens_estimate": (
        _over(prompts, n=lambda: T.tokens_estimate("text").cast("bigint")),
        _sql(f"len(regexp_extract_all(text, '{TOKENS}')) AS n")),
    "txt_prompt_text": (
        lambda spark, sf: chat(spark, sf).select(
            "request_id", C.prompt_text(parse_body(F.col("body"))).alias("prompt")),
        "WITH " + CHAT + " SELECT request_id, CASE WHEN body LIKE 'no json%' THEN NULL ELSE CASE conv_id % 5 "
        "WHEN 0 THEN 'Be brief.' || chr(10) WHEN 1 THEN 'Be kind.' || chr(10) ELSE '' END || CASE turn % 4 "
        "WHEN 0 THEN '' WHEN 1 THEN 'Explain why, step by step: ' WHEN 2 THEN 'Compare the design of ' "
        "ELSE 'hello ' END || text END AS prompt FROM chat"),
}

