"""Quality rules: repetition and symbol counts, and divergence from language references.

The verdict compares two histograms of a document, character classes and common words, with
those of its language by Jensen-Shannon distance. Too short texts are not judged by distance.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, word_array, written

#: Common words in a reference; languages with fewer labelled texts than MIN_TEXTS use the reference of all languages.
COMMON, MIN_TEXTS = 24, 20
#: Words and characters of which a longer text of a reference weighs; parts of a weight of 1.
TEXT_WORDS, TEXT_CHARS, UNIT = 300, 2000, 1 << 24
#: Up to so many references their words and languages are literals of the query; beyond, texts meet them by joins alone.
MAX_LISTED = 512
#: Parts of a language's words that are ranked by themselves first.
RANKED_PARTS = 64
#: Symbols that count as noise; words of a repetition window; the base rules' limits.
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Documents of fewer words are not judged by distance.
MIN_JUDGED_WORDS = 50
#: The largest distances that a kept document has.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.20, 0.34
#: Character classes in the order in which they are taken out of a text; what is left is the last class.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "space": r"[\x20\x09-\x0D]+", "digit": "[0-9]+", "other_script": r"[^\x00-\x7F]+"}
SPACE, ALL = list(CLASSES).index("space"), "*"


def with_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with class_counts, the code points of a text by class (array of doubles), and `rest`, its characters of the last class.

    Each class is taken out of what the classes before it have left, so that only the first
    pass reads the whole text.
    """
    own = docs.columns
    step = docs.withColumn("_left0", F.col(text))
    for k, pattern in enumerate(CLASSES.values()):
        step = step.select(*own, *[f"_n{i}" for i in range(k)], F.regexp_replace(f"_left{k}", pattern, "").alias(f"_left{k + 1}"), F.length(f"_left{k}").alias("_all"))
        step = step.select(*own, *[f"_n{i}" for i in range(k)], (F.col("_all") - F.length(f"_left{k + 1}")).cast("double").alias(f"_n{k}"), f"_left{k + 1}")
    last = f"_left{len(CLASSES)}"
    return step.select(*own, F.array(*[f"_n{i}" for i in range(len(CLASSES))], F.length(last).cast("double")).alias("class_counts"), F.col(last).alias("rest"))


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms of equal length."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2), F.lit(0.0), lambda a, x: a + x)))


def references(docs: DataFrame) -> DataFrame:
    """(ref_lang, common, ref_words, ref_classes) of each language of `docs(text, lang)`, and of all together under `*`.

    All words and characters of every labelled text count; those of a text longer than
    TEXT_WORDS or TEXT_CHARS count for less, so that it weighs as one of that size and no single
    text makes the reference. Weights are whole numbers of 1 / UNIT, so sums do not depend on
    their order. The words are counted once; the classes come from the distinct words, and what
    words leave of the texts' lengths is white space.
    """

    def weight(most: int, size: Column) -> Column:
        return F.when(size <= most, F.lit(UNIT)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(UNIT * most) / size))).cast("long")

    labelled = docs.where(F.col("lang").isNotNull() & (F.btrim("text", F.lit(SPACES)) != "")).select("lang", "text", F.length("text").cast("long").alias("chars")).withColumn("by_char", weight(TEXT_CHARS, F.col("chars")))
    texts = labelled.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.col("chars") * F.col("by_char")).alias("chars"))
    texts = written(texts, "texts")  # one row a language
    tokens = labelled.select("lang", "by_char", word_array(F.col("text")).alias("w")).select("lang", "by_char", weight(TEXT_WORDS, F.size("w")).alias("by_word"), F.explode("w").alias("word"))
    words = written(tokens.groupBy("lang", "word").agg(F.sum("by_word").alias("n"), F.sum("by_char").alias("m")), "words")
    enough = texts.where((F.col("texts") >= MIN_TEXTS) & (F.col("lang") != ALL)).select("lang")
    everything = words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select(F.lit(ALL).alias("lang"), "word", "n", "m")
    rows = written(words.join(enough, "lang", "left_semi").select("lang", "word", "n", "m").unionByName(everything), "ranked")
    chars = texts.join(enough, "lang", "left_semi").select("lang", "chars").unionByName(texts.select(F.lit(ALL).alias("lang"), "chars"))
    chars = chars.groupBy("lang").agg(F.sum("chars").alias("chars"))
    counts = [F.sum(F.col("m") * F.col("class_counts")[i].cast("long")).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    counted = with_classes(rows, "word").groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.col("m") * F.length("word")).alias("inside"), *counts)
    sizes = [(F.col("chars") - F.col("inside") if i == SPACE else F.col(f"c{i}")).cast("double") for i in range(len(CLASSES) + 1)]
    classes = counted.join(chars, "lang").select("lang", "total", _share(F.array(*sizes)).alias("ref_classes"))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))
    parts = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(RANKED_PARTS))).withColumn("r", first("lang", "part")).where(F.col("r") <= COMMON)
    top = (
        parts.withColumn("r", first("lang"))
        .where(F.col("r") <= COMMON)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
        .join(classes, "lang")
        .select("lang", F.transform("top", lambda x: x["word"]).alias("common"), F.transform("top", lambda x: x["n"] / F.col("total")).alias("f"), "ref_classes")
    )
    return top.select(F.col("lang").alias("ref_lang"), "common", F.concat("f", F.array(F.lit(1.0) - F.aggregate("f", F.lit(0.0), lambda a, x: a + x))).alias("ref_words"), "ref_classes")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the words `w`, the base counts and class_counts of every row.

    A repetition window is told by the 64-bit hash of the hashes of its words: two different
    windows of a text of m words are taken for equal with probability m * m / 2 ** 65.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = with_classes(docs.select("doc_id", "lang", text.alias("text")))
    step = step.select("doc_id", "lang", word_array(F.col("text")).alias("w"), F.split("text", "\n").alias("lines"), "class_counts", F.length("text").alias("n_chars"), (F.length("rest") - F.length(F.translate("rest", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    step = step.select(
        "doc_id",
        "lang",
        "w",
        "class_counts",
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("class_counts")[SPACE]).cast("long").alias("word_chars"),
        F.when(F.size("lines") > 1, F.filter("lines", lambda x: F.btrim(x, F.lit(SPACES)) != "")).otherwise(F.array().cast("array<string>")).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("u"),
    )
    window = F.transform(F.slice("u", 1, F.greatest(F.lit(0), F.size("u") - (WINDOW - 1))), lambda x, i: F.xxhash64(x, *[F.get("u", i + k) for k in range(1, WINDOW)]))
    step = step.select("*", window.alias("h")).drop("u")
    # only texts with a repeated window are sorted
    step = step.withColumn(
        "sorted", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:long,i:int>>"))
    )
    same = lambda x, k: F.coalesce(F.get("sorted", k)["h"] == x["h"], F.lit(False))
    step = step.withColumn("at", F.when(F.size("sorted") > 0, F.sort_array(F.transform(F.filter("sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return step.select(
        "doc_id",
        "lang",
        "w",
        "class_counts",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("at") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )


def judge(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Counts, distances and verdict of every row of `docs(doc_id, text, lang)`.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, word_distance, base_failed, kept.

    Null or empty text: no words, base_failed, not kept. Null lang, or one without a
    reference: compared with all languages together. Without any labelled text there are no
    distances and the base rules alone decide. Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result. `refs` has one short row a
    language and one of all, and is written first, so its size decides how it is joined.
    """
    refs = written(references(docs) if refs is None else refs, "references")
    known = refs.select("ref_lang", "common").limit(MAX_LISTED + 1).collect()
    step = measures(docs)
    if len(known) <= MAX_LISTED:
        langs, common = [r[0] for r in known if r[0] != ALL], sorted({x for r in known for x in r[1]})
        step = step.withColumn("ref_lang", F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(ALL) if langs else F.lit(ALL))
        own = F.filter("w", lambda x: x.isin(common)) if common else F.array().cast("array<string>")
    else:
        step = step.join(refs.where(F.col("ref_lang") != ALL).select(F.col("ref_lang").alias("lang"), "ref_lang"), "lang", "left").withColumn("ref_lang", F.coalesce("ref_lang", F.lit(ALL)))
        own = F.col("w")
    step = step.withColumn("w", F.when(F.col("n_words") >= MIN_JUDGED_WORDS, own))
    step = step.join(refs, "ref_lang", "left")
    judged = (F.col("n_words") >= MIN_JUDGED_WORDS) & F.col("common").isNotNull()
    step = step.withColumn("hits", F.when(judged, F.array_remove(F.transform("w", lambda x: F.array_position("common", x).cast("int")), F.lit(0))))
    counts = F.array(*[(F.size("hits") - F.size(F.array_remove("hits", F.lit(k)))).cast("double") for k in range(1, COMMON + 1)])
    counts = F.slice(counts, F.lit(1), F.size("common"))
    step = step.withColumn("word_counts", F.when(judged, F.concat(counts, F.array((F.col("n_words") - F.size("hits")).cast("double")))))
    step = step.withColumn("class_distance", F.when(judged, js_distance(_share(F.col("class_counts")), F.col("ref_classes"))))
    step = step.withColumn("word_distance", F.when(judged, js_distance(_share(F.col("word_counts")), F.col("ref_words"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    counts_out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return step.select("doc_id", *counts_out, "class_distance", "word_distance", failed.alias("base_failed"), (~failed & near).alias("kept"))
