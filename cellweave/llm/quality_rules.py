r"""Quality rules with adaptive thresholds, in DataFrame functions only.

A base rule removes documents with fewer than 50 words or with over half of their words inside repeated 3-word windows.
For the rest, four ratios are summarised by a mergeable quantile sketch (KLL) for each language and source; sketches of the
sources merge into one per language and one overall. The upper fence of a ratio is its median plus three times the distance
from median to upper quartile, but at least a documented slack above the median, so groups without spread are not cut; mean
word length has a lower fence too. A group of under ``min_rows`` documents uses its language's sketch, a small language the
overall one. Documents are then joined with the fences of their group and filtered.

Words are ``[^\x20\x09-\x0D]+``. A word is in a repeated window if the 64-bit hash of one of its 3-word windows occurs twice
in the document.

Defined cases: null and empty texts have no words and fail the base rule; null language or source is a group of its own;
repeated rows are judged alike; an empty table gives no row; columns other than doc_id, text, lang and source are ignored by
:func:`features` and the query, and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, materialise, set_apart

MIN_WORDS = 50
#: Entries of a sketch; one of up to about this many values is exact, a larger one is off by about 0.1 % of rank.
SKETCH_K = 4096
MIN_ROWS = 30
SPREAD = 3.0
#: The least distance of a fence from the median.
SLACK = {"symbol_ratio": 0.1, "dup_line_ratio": 0.25, "repeat_ratio": 0.2, "mean_word": 2.0}
#: Groups whose fences are broadcast at most; beyond it, the join shuffles and adaptive execution splits hot groups.
BROADCAST_GROUPS = 100_000

_SPACES = " \t\n\u000b\f\r"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts; every document is whole and no row leaves its task."""
    split = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        "lang",
        "source",
        "text",
        _words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("w") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.size("w") - 3),
                    lambda i: F.struct(
                        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")
                    ),
                )
            ),
        ).alias("grams"),
    )
    # Equal hashes are neighbours after the sort; what stays are the starts of repeated windows.
    found = hashed.select(
        *[c for c in hashed.columns if c != "grams"],
        F.sort_array(
            F.transform(
                F.filter(
                    "grams",
                    lambda x, k: (x["h"] == F.get("grams", k - 1)["h"]) | (x["h"] == F.get("grams", k + 1)["h"]),
                ),
                lambda x: x["i"],
            )
        ).alias("starts"),
    )
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    return found.select(
        *[c for c in found.columns if c != "starts"],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratios(feats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return feats.withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / n,
            "mean_word": F.col("word_chars") / n,
        }
    )


def sketches(feats: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One sketch per ratio for each (lang, source), over the documents that pass the base rule."""
    return (
        _ratios(feats.filter(~F.col("base_failed")))
        .groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in SLACK])
    )


def fences(sketched: DataFrame, min_rows: int = MIN_ROWS, k: int = SKETCH_K) -> DataFrame:
    """lang, source and the fences of each ratio, from the group's sketch or a merged one where the group is small."""

    def merged(*by: str) -> DataFrame:
        return sketched.groupBy(*by).agg(
            F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(k)).alias(m) for m in SLACK]
        )

    def limits(df: DataFrame, tag: str) -> DataFrame:
        out = []
        for m, slack in SLACK.items():
            q50 = F.kll_sketch_get_quantile_double(m, F.lit(0.5))
            q75 = F.kll_sketch_get_quantile_double(m, F.lit(0.75))
            out.append((q50 + F.greatest(SPREAD * (q75 - q50), F.lit(slack))).alias(f"{tag}_{m}"))
            if m == "mean_word":
                q25 = F.kll_sketch_get_quantile_double(m, F.lit(0.25))
                out.append((q50 - F.greatest(SPREAD * (q50 - q25), F.lit(slack))).alias(f"{tag}_low_word"))
        keys = [c for c in ("lang", "source") if c in df.columns]
        return df.select(*keys, F.col("n").alias(f"{tag}_n"), *out)

    own = limits(sketched, "own")
    by_lang = limits(merged("lang"), "lang").withColumnRenamed("lang", "lang_key")
    overall = limits(merged(), "all")
    joined = own.join(by_lang, own["lang"].eqNullSafe(by_lang["lang_key"]), "left").join(F.broadcast(overall), how="cross")
    names = [*SLACK, "low_word"]
    return joined.select(
        "lang",
        "source",
        *[
            F.when(F.col("own_n") >= min_rows, F.col(f"own_{m}"))
            .when(F.col("lang_n") >= min_rows, F.col(f"lang_{m}"))
            .otherwise(F.col(f"all_{m}"))
            .alias(f"most_{m}" if m in SLACK else m)
            for m in names
        ],
    )


def judge(feats: DataFrame, limits: DataFrame) -> DataFrame:
    """``feats`` with ``kept``."""
    limits = materialise(limits, "fences")
    small = limits.count() <= BROADCAST_GROUPS
    right = limits.withColumnsRenamed({"lang": "lang_key", "source": "source_key"})
    on = F.col("lang").eqNullSafe(F.col("lang_key")) & F.col("source").eqNullSafe(F.col("source_key"))
    joined = _ratios(feats).join(F.broadcast(right) if small else right, on, "left")
    passed = F.col("mean_word") >= F.col("low_word")
    for m in SLACK:
        passed = passed & (F.col(m) <= F.col(f"most_{m}"))
    return joined.select(*feats.columns, (~F.col("base_failed") & F.coalesce(passed, F.lit(True))).alias("kept"))


def score_documents(docs: DataFrame) -> DataFrame:
    feats = materialise(features(docs), "quality-features")
    return judge(feats, fences(sketches(feats)))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. A row is judged by its text, lang and source, so ids may
    repeat or be null; rows are known by 96 bits of hashes of these."""
    judged = ("text", "lang", "source")
    keyed = set_apart(docs, *judged).withColumn("key", F.struct(F.xxhash64(*judged).alias("a"), F.hash(*judged).alias("b")))
    scored = score_documents(keyed.select(F.col("key").alias("doc_id"), *judged))
    kept = scored.filter("kept").select("doc_id").distinct()
    kept = kept.withColumnRenamed("doc_id", "kept_key")
    return keyed.join(kept, F.col("key") == F.col("kept_key"), "left_semi").drop("key").toDF(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def _sql_limits() -> tuple[str, str]:
    """Fences as SQL: quantiles of a list, as an exact sketch has them (the smallest value of rank q or more)."""
    cols, cases = [], []
    for m, slack in SLACK.items():
        q = lambda p, m=m: f"list_sort(list({m}))[greatest(1, ceil({p} * count(*)))::INT]"
        cols.append(f"{q(0.5)} + greatest({SPREAD} * ({q(0.75)} - {q(0.5)}), {slack}) AS {m}")
        if m == "mean_word":
            cols.append(f"{q(0.5)} - greatest({SPREAD} * ({q(0.5)} - {q(0.25)}), {slack}) AS low_word")
    for m in [*SLACK, "low_word"]:
        cases.append(
            f"CASE WHEN o.n >= {MIN_ROWS} THEN o.{m} WHEN l.n >= {MIN_ROWS} THEN l.{m} ELSE a.{m} END AS most_{m}"
        )
    return ", ".join(cols), ", ".join(cases)


_COLS, _CASES = _sql_limits()
OP8_SQL = rf"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id
), f AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
), r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols / greatest(n_words, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
         n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word
  FROM f
), own AS (SELECT lang, source, count(*) AS n, {_COLS} FROM r WHERE NOT base_failed GROUP BY lang, source),
by_lang AS (SELECT lang, count(*) AS n, {_COLS} FROM r WHERE NOT base_failed GROUP BY lang),
overall AS (SELECT count(*) AS n, {_COLS} FROM r WHERE NOT base_failed),
fences AS (
  SELECT o.lang, o.source, {_CASES}
  FROM own o LEFT JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang, overall a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_ratio <= most_symbol_ratio AND dup_line_ratio <= most_dup_line_ratio
           AND repeat_ratio <= most_repeat_ratio AND mean_word <= most_mean_word AND mean_word >= most_low_word, true) AS kept
FROM r LEFT JOIN fences ON r.lang IS NOT DISTINCT FROM fences.lang AND r.source IS NOT DISTINCT FROM fences.source
"""
