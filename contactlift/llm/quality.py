"""Quality rules: counts over the whole text, and the Jensen-Shannon distance of a document's character-class and
common-word histograms to the reference of its language. DataFrame functions only.

The reference of a language is the mean histogram of all its documents that pass the count rules. A document is
judged by distance only when it has ``min_words`` words and its language has ``min_docs`` such documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlift.llm.store import written

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del"],
}
ANY_WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
SPACES = r"[\x20\x09-\x0D]+"
# A document is too far from its language if its characters are, or if its words are and its characters nearly so.
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.275
MAX_CHAR_WITH_WORD = 0.13


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _without(pattern: str) -> Column:
    return F.length(F.regexp_replace("t", pattern, ""))


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
             key: Column | None = None) -> DataFrame:
    """Counts and histograms per row, and ``key`` if one is given. A generator between the steps keeps Catalyst from inlining the word array
    into every use (a plain projection would be collapsed and the text split again for each word)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang).cast("string").alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).alias("t"), *([] if key is None else [key.alias("key")]))
    rows = rows.select("*", F.expr(rf"inline(array(struct(filter(split(t, r'{SPACES}'), x -> x <> '') AS w)))"))
    rows = rows.withColumn("n", F.size("w"))
    # a 3-word window is a long: the upper bits hash its words, the lower ``b`` bits are its position
    rows = rows.withColumn("b", F.expr("cast(ceil(log2(n + 2)) AS int)"))
    rows = rows.select("*", F.expr("""inline(array(struct(
        if(n < 3, cast(array() AS array<bigint>), sort_array(transform(sequence(0, n - 3), i ->
            shiftleft(shiftright(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b), b) + i))) AS s,
        filter(transform(w, x -> lower(x)), x -> x IN (""" + _quoted(ANY_WORDS) + """)) AS c,
        filter(split(t, '\\n'), x -> length(translate(x, ' \\t\\n\\u000B\\u000C\\r', '')) > 0) AS l)))"""))
    again = """size(array_distinct(flatten(transform(filter(s, (x, i) ->
        coalesce(shiftright(x, b) = shiftright(get(s, i - 1), b), false)
        OR coalesce(shiftright(x, b) = shiftright(get(s, i + 1), b), false)),
        x -> transform(array(0, 1, 2), d -> (x & (shiftleft(1L, b) - 1)) + d)))))"""
    size = F.length("t")
    spaces = size - _without(SPACES)
    symbols = F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long")
    per_word = F.coalesce(*[F.when(F.col("lang") == k, F.expr(
        "array(" + ", ".join(f"size(filter(c, x -> x = '{w}'))" for w in words) + ")"))
        for k, words in COMMON_WORDS.items()], F.array(F.size("c")))
    rows = rows.select(
        "id", "lang", *([] if key is None else ["key"]), F.col("n").cast("long").alias("n_words"),
        (size - spaces).cast("long").alias("word_chars"), symbols.alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(again).cast("long").alias("n_repeat_words"), size.alias("size"), spaces.alias("spaces"),
        (size - _without(r"\p{Ll}+")).alias("lower"), (size - _without(r"\p{Lu}+")).alias("upper"),
        (size - _without("[0-9]+")).alias("digits"), (size - _without(r"[.,;:!?'\"()\-]+")).alias("marks"),
        per_word.alias("common"))
    chars = [F.col(x).cast("double") for x in ("spaces", "lower", "upper", "digits", "marks", "n_symbols")]
    other = F.col("size").cast("double")
    for x in chars:
        other = other - x
    rest = F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "id", "lang", *([] if key is None else ["key"]), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words",
        F.transform(F.array(*chars, other), lambda x: x / F.greatest(F.col("size"), F.lit(1))).alias("p_char"),
        F.transform(F.concat("common", F.array(rest)),
                    lambda x: x.cast("double") / F.greatest(F.col("n_words"), F.lit(1))).alias("p_word"))


def js_distance(p: str, q: str) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two histograms: 0 equal, 1 disjoint."""
    half = f"""aggregate(zip_with({p}, {q}, (x, y) ->
        if(x > 0, x * log2(2 * x / (x + y)), 0D) + if(y > 0, y * log2(2 * y / (x + y)), 0D)), 0D, (a, x) -> a + x) / 2"""
    return F.expr(f"sqrt(greatest({half}, 0D))")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def references(rows: DataFrame, min_words: int) -> DataFrame:
    """Mean histograms by language (``of``), of the rows that pass the count rules."""
    def mean(c: str, n: int) -> Column:
        return F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(n)])

    widest = max(map(len, COMMON_WORDS.values())) + 1
    return (rows.where(~base_failed() & (F.col("n_words") >= min_words)).groupBy(F.col("lang").alias("of"))
            .agg(F.count("*").alias("docs"), mean("p_char", 7).alias("q_char"), mean("p_word", widest).alias("q_word"))
            .withColumn("q_word", F.filter("q_word", lambda x: x.isNotNull())))


def judged(rows: DataFrame, ref: DataFrame, min_words: int, min_docs: int, max_char: float, max_word: float,
           max_char_with_word: float) -> DataFrame:
    """``rows`` with base_failed, char_distance, word_distance and kept."""
    out = rows.join(ref, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("base_failed", base_failed())
    ok = (F.col("n_words") >= min_words) & (F.col("docs") >= min_docs)
    out = out.select("*", F.when(ok, js_distance("p_char", "q_char")).alias("char_distance"),
                     F.when(ok, js_distance("p_word", "q_word")).alias("word_distance"))
    far = (F.col("char_distance") > max_char) | ((F.col("word_distance") > max_word)
                                                 & (F.col("char_distance") > max_char_with_word))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = 50,
            min_docs: int = 20, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
            max_char_with_word: float = MAX_CHAR_WITH_WORD) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, char_distance, word_distance (null where not judged).

    A null or word-free text has no words and fails. Documents with a null or unknown language are compared with
    the mean of their own ``lang`` value too (null is a group of its own), with one common-word bin. Equal rows get
    equal results; a null id is allowed; extra columns are ignored; an empty table gives an empty result.
    """
    rows = written(features(docs, id_col, text, lang), "quality")
    out = judged(rows, written(references(rows, min_words), "references"), min_words, min_docs, max_char, max_word,
                 max_char_with_word)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "char_distance", "word_distance")


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang", min_words: int = 50, min_docs: int = 20,
                   max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
                   max_char_with_word: float = MAX_CHAR_WITH_WORD) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality`` keeps."""
    ref = written(references(features(docs, text, text, lang), min_words), "references")
    rows = features(docs, text, text, lang, key=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    out = judged(rows, ref, min_words, min_docs, max_char, max_word, max_char_with_word)
    return out.where("kept").select("key.*")
