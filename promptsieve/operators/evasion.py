"""Evasion signals: encodings and obfuscations that hide a suspicious phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsieve import constants as K
from promptsieve.functions import text as T


def _signal(name: str, condition: Column, details: Column) -> Column:
    description, confidence = K.EVASION_SIGNALS[name]
    return F.when(condition, F.struct(
        F.lit(name).alias("heuristic"), F.lit(description).alias("description"),
        F.lit(confidence).alias("confidence"), details.alias("details"),
    ))


def _hidden(name: str, phrase: Column) -> Column:
    return _signal(name, phrase.isNotNull(), F.concat(F.lit("Hidden: "), phrase))


def evasion_signals(
    df: DataFrame, text: str = "text", max_length: int = K.MAX_TEXT_LENGTH
) -> DataFrame:
    """Append ``signals``: those found, in fixed order, as ARRAY<STRUCT<heuristic,
    description, confidence, details>>."""
    return append_signals(df, text, max_length)


def explode_signals(df: DataFrame) -> DataFrame:
    """One row per signal. An outer generator, so that Spark infers no filter on the array,
    which would compute all signals twice."""
    rest = [c for c in df.columns if c != "signals"]
    return df.select(*rest, F.inline_outer("signals")).where("heuristic is not null")


def append_signals(
    df: DataFrame, text: str, max_length: int = K.MAX_TEXT_LENGTH, first: int | None = None
) -> DataFrame:
    """``evasion_signals`` as a step of other scans; where these have the gates already, in ``_gates``,
    ``first`` is the number of the first one for signals.

    Shared intermediate columns are staged in select steps of their own, so each is computed
    once; every costly step sits behind a cheap condition.
    """
    c = F.col(text)
    kept = [x for x in df.columns if first is None or x != "_gates"]
    if first is None:
        df, first = df.withColumn("_gates", T.phrase_gates(c)), 0

    def rot13_phrase(name: str, letters: bool) -> Column:
        return F.when(F.length(name) >= K.MIN_ROT13_LENGTH, T.gated_phrase(
            name, "_gates", first, rotated=True, letters=letters))

    staged = (
        df.withColumns({
            "_letters": T.gated_letters(text, "_gates", first),
            "_b64": T.gated_base64(text, "_gates", first),
            "_zw": T.zero_width_count(c),
            "_conf": T.confusable_count(c),
            "_hex": T.has_hex_escapes(c),
        })
        .withColumn("_dense", F.when(
            F.length("_letters") < F.length(c) * K.NOISE_RATIO, F.col("_letters")))
        .drop("_letters")
    )
    staged = (
        staged.withColumns({
            "_zw_phrase": F.when(F.col("_zw") > 0, T.suspicious_phrase(T.strip_zero_width(c))),
            "_hex_phrase": F.when(F.col("_hex"), T.suspicious_phrase(T.decode_hex_escapes(c))),
            "_rot": F.coalesce(rot13_phrase(text, False), rot13_phrase("_dense", True)),
            "_joined": T.gated_phrase("_dense", "_gates", first, letters=True),
        })
        .withColumn("_inserted", F.when(
            F.col("_joined").isNotNull() & T.gated_phrase(text, "_gates", first).isNull(), F.col("_joined")))
    )
    found = F.array_compact(F.array(
        _signal("excessive_length", F.length(c) > max_length, F.concat(
            F.lit("Length "), F.length(c).cast("string"), F.lit(f" > {max_length}"))),
        _signal("base64_encoding", F.col("_b64") > 0, F.concat(
            F.lit("Found "), F.col("_b64").cast("string"), F.lit(" encoded segments"))),
        _signal("url_encoding", T.has_url_encoding(c), F.lit("Content appears URL encoded")),
        _signal("unicode_obfuscation", F.col("_conf") > 0, F.concat(
            F.lit("Found "), F.col("_conf").cast("string"), F.lit(" confusable characters"))),
        _signal("zero_width_chars", F.col("_zw") > 0, F.concat(
            F.lit("Found "), F.col("_zw").cast("string"), F.lit(" zero-width characters"))),
        _hidden("zero_width_evasion", F.col("_zw_phrase")),
        _signal("hex_escapes", F.col("_hex"), F.lit("Text contains \\xNN sequences")),
        _hidden("hex_escape_evasion", F.col("_hex_phrase")),
        _hidden("rot13_evasion", F.col("_rot")),
        _hidden("char_insertion_evasion", F.col("_inserted")),
    ))
    return staged.select(*kept, found.alias("signals"))


def as_candidates(signals: Column) -> Column:
    """Every signal votes ``warn`` / ``encoding-bypass`` with its own confidence."""
    return F.transform(signals, lambda s: F.struct(
        F.lit(K.EVASION_ACTION).alias("action"), F.lit(K.EVASION_CATEGORY).alias("category"),
        F.lit(None).cast("string").alias("signature_id"), s.description.alias("detail"),
        s.confidence.alias("confidence"),
    ))
