"""Language identification by compression.

A zstandard raw-content dictionary is cut for every language from a bounded sample of labelled
rows. A text goes to the language whose dictionary compresses it best; where the runner-up comes
within ``margin`` of the winner, the prediction is marked as rejected. Unless given, the margin is
found from the sample itself: one half's texts are predicted by the other half's dictionaries. Whole texts are read, in
blocks, so that long texts keep depending on the dictionaries. Only ``text`` and ``lang`` of
training rows are learned from, and only ``text`` is used to predict.

Defined results: a null text, or one without letters, is ``und`` with score 0 and is rejected; null
langs are not learned; ties go to the language that sorts first; repeated rows are predicted
alike; without any training row everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import with_columns

#: The bound of the training sample of a language: rows and characters of each. Every language is learned.
SAMPLE_ROWS, SAMPLE_CHARS = 256, 1500
#: Languages that can be learned; a column with more values holds something else, and is refused.
MOST_LANGUAGES = 512
#: Characters of a text that are compressed at once.
BLOCK = 4096
LEVEL = 6
#: Share by which the second-best result must be larger than the best, where too few texts can be measured.
MARGIN = 0.05
#: The margin is this part of this quantile of the sample's own margins, from as many texts at most and at least.
MARGIN_PART, MARGIN_QUANTILE, MEASURED, LEAST_MEASURED = 0.5, 0.05, 1024, 20
_OTHER = re.compile(r"[\W\d_]+")


def normalised(text: str) -> str:
    """Lower case, with runs of what is neither letter nor mark as a blank; empty if there is no letter."""
    clean = _OTHER.sub(" ", text.lower()).strip()
    return clean if any(map(str.isalpha, clean)) else ""


def training_sample(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``rows`` texts of each language, those with the least hash of doc_id.

    Rows that repeat doc_id and text count once. Ranks are taken in salted groups first, so that the task of a
    frequent language gets 8 x ``rows`` rows at most.
    """
    languages = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"column lang has over {MOST_LANGUAGES} different values; a sample of each would not be bounded")
    key = ["lang", "doc_id", "digest"]
    keyed = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id", F.xxhash64("text").alias("digest"), F.substring("text", 1, chars).alias("text"))
    named = keyed.select(*key).distinct().withColumn("key", F.xxhash64("doc_id")).withColumn("salt", F.pmod("key", F.lit(8)))
    for group in (["lang", "salt"], ["lang"]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("key", "doc_id", "digest"))).where(F.col("rank") <= rows)
    named = named.select("lang", F.col("doc_id").alias("id"), "digest")
    chosen = keyed.join(F.broadcast(named), (keyed.lang == named.lang) & keyed.doc_id.eqNullSafe(named.id) & (keyed.digest == named.digest), "leftsemi")
    return sorted((r.lang, r.text) for r in chosen.groupBy(*key).agg(F.min("text").alias("text")).collect())  # rows a language


def dictionaries(sample: list[tuple[str, str]]) -> dict[str, bytes]:
    out: dict[str, list[str]] = {}
    for lang, text in sample:
        out.setdefault(lang, []).append(normalised(text))
    return {lang: " ".join(dict.fromkeys(texts)).encode() for lang, texts in sorted(out.items())}


class Classifier:
    """Compressors, one a language, made once in a task."""

    def __init__(self, content: dict[str, bytes]):
        self.by = []
        for lang, data in content.items():
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.by.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)))

    def sizes(self, clean: str) -> list[tuple[int, str]]:
        """Compressed size by every language, the best first."""
        blocks = [clean[k : k + BLOCK].encode() for k in range(0, len(clean), BLOCK)]
        return sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in self.by)

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """Language, score and whether the margin suffices."""
        if text is None or not self.by or not (clean := normalised(text)):
            return "und", 0.0, False
        sizes = self.sizes(clean)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        (best, lang), (second, _) = sizes[:2]
        return lang, 1 - best / second, second >= best * (1 + margin)


def sample_margin(sample: list[tuple[str, str]]) -> float:
    """The margin for a sample: letter noise lies below it, nearly all of its rightly predicted texts above.

    Texts are measured by the half of the sample that they are not in.
    """
    halves: tuple[list, list] = ([], [])
    for lang, text in dict.fromkeys(sample):
        halves[zlib.crc32(text.encode()) & 1].append((lang, text))
    found = []
    for mine, other in (halves, halves[::-1]):
        content = dictionaries(other)
        model = Classifier(content)
        for lang, text in mine[:: -(-2 * len(mine) // MEASURED) or 1]:
            if len(content) > 1 and lang in content and (clean := normalised(text)):
                (best, first), (second, _) = model.sizes(clean)[:2]
                if first == lang:
                    found.append(second / best - 1)
    return MARGIN_PART * float(np.quantile(found, MARGIN_QUANTILE)) if len(found) >= LEAST_MEASURED else MARGIN


def identify(documents: DataFrame, training: DataFrame, margin: float | None = None, carry: list[str] = ()) -> DataFrame:
    """doc_id, the columns in ``carry``, lang_pred, score and accepted for every row of ``documents``."""
    sample = training_sample(training)
    content = dictionaries(sample)
    margin = sample_margin(sample) if margin is None else margin
    kept = ["doc_id", *carry]
    shared = documents.sparkSession.sparkContext.broadcast(content)  # MOST_LANGUAGES dictionaries of bounded size at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t.as_py(), margin) for t in batch.column("text")]
            columns = [[x[k] for x in found] for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], [*kept, "lang_pred", "score", "accepted"])

    return documents.select(*dict.fromkeys(["doc_id", "text", *carry])).mapInArrow(run, with_columns(documents, kept, "lang_pred string, score double, accepted boolean"))


def held_out(doc_id="doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(documents, documents.where(~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


SQL = None  # tests check held-out accuracy
