"""Language identification (operator 1): compression with one raw-content dictionary per language.

Fitting takes, per language, up to ``DICTIONARY_BYTES`` of normalised text from at most ``SAMPLE_TEXTS`` distinct labelled
texts, chosen by a hash of the text; of a long one only as much as fits. A language with less text than that repeats it up
to the size, so that all dictionaries are alike in size and no language is favoured or weakened by another's. A sample is
at most languages x ``SAMPLE_TEXTS`` texts, cut to the dictionary's size. Identification encodes each whole text, block
by block, with Zstandard under every dictionary and takes the language of the smallest sum; equal sums go to the
language with most labelled texts. ``score`` is the weight of that language when a byte saved counts as ``BYTE_WEIGHT`` nats; if
the margin to the second is below ``min_margin`` of the size, ``rejected`` is true and the prediction is not to be relied on.

Texts are lower-cased and everything but letters, with the marks that follow them, becomes one space. NULL texts and texts
without a letter are ``und`` with score 0. Texts of any length are read whole. If nothing can be learned (no labelled text),
every text is ``und``. Repeated rows and rows with a NULL id are predicted each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DICTIONARY_BYTES = 96 << 10
SAMPLE_TEXTS = 300
BLOCK, LEVEL = 4096, 5
BYTE_WEIGHT = 0.35
NONE = "und"
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
# a run of what is neither a letter nor a mark; the letters that \w takes in addition (digits, numbers, _) are left out too
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+|(?<!\p{L}\p{M}*)\p{M}+")


def normal(text: str | None) -> bytes:
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip().encode()


def fit(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Dictionary per language from rows where ``learn`` holds and the language is known, the most frequent language first."""
    known = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    hashed = known.where(F.char_length("text") > 0).withColumn("h", F.xxhash64("text"))
    counts = hashed.groupBy("lang", "h").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    langs = [r["lang"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
    chosen = counts.select("lang", "h").withColumn("r", rank).where(F.col("r") <= texts).drop("r")
    sample = (
        hashed.join(F.broadcast(chosen), ["lang", "h"])
        .groupBy("lang", "h").agg(F.min(F.substring("text", 1, DICTIONARY_BYTES)).alias("text"))
        # what comes to the driver is about four dictionaries' size per language, as normalising shortens texts
        .withColumn("before", F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce("before", F.lit(0)) < 3 * DICTIONARY_BYTES).orderBy("lang", "h").collect()
    )
    content: dict[str, list[bytes]] = {}
    for r in sample:
        own = content.setdefault(r["lang"], [])
        piece = normal(r["text"])
        if piece and sum(map(len, own)) < DICTIONARY_BYTES:
            own.append(piece)
    found = {lang: b" ".join(x) for lang, x in content.items() if x}
    return {lang: ((found[lang] + b" ") * (DICTIONARY_BYTES // (len(found[lang]) + 1) + 1))[-DICTIONARY_BYTES:] for lang in langs if lang in found}


class Encoders:
    """Compressors of all languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.compress = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(c(b)) for b in blocks) for c in self.compress]

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, float, bool]:
        plain = normal(text)
        if not plain or not self.langs:
            return NONE, 0.0, 0.0, True
        sizes = self.sizes(plain)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        weights = np.exp(-BYTE_WEIGHT * np.minimum(np.array(sizes) - sizes[best], 200.0))
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = (second - sizes[best]) / max(1, sizes[best])
        return self.langs[best], float(1 / weights.sum()), margin, margin < min_margin


def identify(
    docs: DataFrame, dictionaries: dict[str, bytes], held_out: Column | None = None, min_margin: float = 0.01,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            got = [encoders.predict(t.as_py(), min_margin) for t in batch.column(2)]
            lang, score, margin, rejected = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())],
                [c.split()[0] for c in RESULT.split(", ")])

    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"),
        F.col(text_col).alias("text"))
    return own.mapInArrow(predict, RESULT)
