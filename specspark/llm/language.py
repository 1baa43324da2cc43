"""Language identification by compression.

Each language gets a zstandard raw-content dictionary from a bounded sample of its labelled
texts. A text is encoded once per dictionary; the smallest encoding names the language. The
margin to the second smallest gives the score, and a narrow margin rejects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UNDETERMINED = "und"
#: The sample of each language: at most SLOTS labelled texts, at most PIECE characters from the middle of each.
SLOTS, PIECE = 256, 448
LEVEL = 6
#: A text is encoded in pieces of this many bytes, each against the dictionary, so that all of a long text counts.
CHUNK = 4096
#: A text is rejected if the best encoding is not smaller by this many bytes, and by this share of the encoded text.
MIN_MARGIN_BYTES, MIN_MARGIN_SHARE = 2, 0.001
#: Languages with fewer sample texts, or beyond the MAX_LANGUAGES with most of them, are not learned.
MIN_TEXTS, MAX_LANGUAGES = 3, 256

_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-case letters with single spaces between their runs."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split())


def learn(docs: DataFrame, trained_on: Column) -> dict[str, bytes]:
    """Dictionary of each language, from rows of `docs(doc_id, text, lang)` where `trained_on` holds.

    A row falls into one of SLOTS slots of its language by its doc_id; each slot keeps the row
    with the smallest hash, so the sample is bounded and does not depend on how rows lie. Rows
    where `trained_on` is null, as where doc_id is, are not learned from. Labels with fewer than
    MIN_TEXTS sample texts are not learned.
    """
    middle = F.greatest(F.lit(1), (F.length("text") - F.lit(PIECE)) / 2).cast("int")
    picked = (
        docs.where(trained_on & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(SLOTS)).alias("slot"), F.xxhash64(F.lit(2), "doc_id", "text").alias("h"), F.substring(F.col("text"), middle, F.lit(PIECE)).alias("piece"))
        .groupBy("lang", "slot")
        .agg(F.min_by("piece", F.struct("h", "piece")).alias("piece"))
    )
    picked = written(picked, "pieces")
    enough = picked.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    picked = picked.join(enough.select("lang"), "lang", "left_semi").collect()  # at most MAX_LANGUAGES * SLOTS short rows
    pieces: dict[str, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["slot"])):
        pieces.setdefault(r["lang"], []).append(plain(r["piece"]))
    return {lang: b" ".join(x) for lang, x in pieces.items() if any(x)}


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """All columns of `docs` and lang_pred, score, margin_bytes, accepted; only the text decides.

    Null text or a text without a letter: `und`, score 0, not accepted; so is every text if
    nothing was learned. Ties of size go to the language that sorts first and are not accepted.
    Repeated rows give repeated results; columns of those names are replaced.
    """
    added = ("lang_pred", "score", "margin_bytes", "accepted")
    names = sorted(dictionaries)

    @F.pandas_udf("lang_pred string, score double, margin_bytes long, accepted boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard

        coders = []
        for name in names:
            d = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        if len(coders) == 1:  # against no dictionary at all
            coders.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        for texts in batches:
            rows = []
            for text in texts:
                if not coders or text is None or not _LETTER.search(text):
                    rows.append((UNDETERMINED, 0.0, 0, False))
                    continue
                body = plain(text)
                parts = [body[k : k + CHUNK] for k in range(0, len(body), CHUNK)]
                sizes = [sum(len(c.compress(x)) for x in parts) for c in coders]
                best = min(range(len(names)), key=lambda k: (sizes[k], k))
                rest = [s for k, s in enumerate(sizes) if k != best]
                margin = min(rest) - sizes[best]
                score = 1.0 / (1.0 + sum(2.0 ** -min(500, s - sizes[best]) for s in rest))
                rows.append((names[best], score, margin, margin >= max(MIN_MARGIN_BYTES, MIN_MARGIN_SHARE * len(body))))
            yield pd.DataFrame(rows, columns=list(added))

    kept = [F.col(c) for c in docs.columns if c not in added]
    return docs.select(*kept, predict("text").alias("_found")).select(*kept, *[F.col(f"_found.{c}").alias(c) for c in added])
